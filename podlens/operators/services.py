"""The service catalog: from annotations to hosts and path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podlens import names
from podlens.functions.domains import split_domains, trimmed, with_default
from podlens.functions.regexes import java_patterns
from podlens.functions.documents import parse_document
from podlens.functions.variants import bind, fields_of, text_of
from podlens.options import ServiceOptions
from podlens.operators.rows import settle

NO_DOMAINS = "no domains annotation"
EMPTY_DOMAINS = "no domain names in the domains annotation"
NO_PATHS = "no paths annotation"
EMPTY_PATHS = "paths annotation is empty"
BAD_PATHS = "paths annotation is not a list of label objects"
EMPTY_LABEL = "empty label"
NO_REGEXPS = "no regexps for a label"
EMPTY_REGEXP = "empty regexp"
BAD_REGEXP = "regexp does not compile"
NO_LABELS = "paths annotation holds no labels"


def _is_null(value: Column) -> Column:
    return F.schema_of_variant(value) == "VOID"


def _regexps(value: Column) -> Column:
    """List of strings; a JSON null counts as empty, any other type makes the list NULL."""
    items = value.try_cast("array<variant>")
    texts = F.transform(items, lambda item: F.when(_is_null(item), F.lit("")).otherwise(text_of(item)))
    valid = F.when(F.forall(texts, lambda text: text.isNotNull()), F.transform(texts, trimmed))
    return F.when(_is_null(value), F.array().cast("array<string>")).otherwise(valid)


def _path_rules(text: Column) -> Column:
    """Ordered (label, regexps) pairs; NULL when the text is not a list of such objects."""

    def rules_of(item: Column) -> Column:
        entries = F.transform(
            F.map_entries(fields_of(item)),
            lambda e: F.struct(e["key"].alias("label"), _regexps(e["value"]).alias("regexps")),
        )
        none = F.array().cast("array<struct<label:string,regexps:array<string>>>")
        return F.when(_is_null(item), none).otherwise(entries)

    def check(document: Column) -> Column:
        items = F.when(_is_null(document), F.array().cast("array<variant>")).otherwise(
            document.try_cast("array<variant>")
        )
        return bind(
            F.transform(items, rules_of),
            lambda lists: F.when(F.forall(lists, lambda rules: rules.isNotNull()), F.flatten(lists)),
        )

    rules = bind(parse_document(text), check)
    return bind(rules, lambda r: F.when(F.forall(r, lambda rule: rule["regexps"].isNotNull()), r))


def _rule_error(rule: Column, translated: Column) -> Column:
    """The first thing wrong with one path rule, NULL when it is fine."""
    broken = F.zip_with(
        rule["regexps"],
        translated,
        lambda source, java: F.when(source == "", F.lit(EMPTY_REGEXP)).when(java.isNull(), F.lit(BAD_REGEXP)),
    )
    return (
        F.when(rule["label"] == "", F.lit(EMPTY_LABEL))
        .when(F.size(rule["regexps"]) == 0, F.lit(NO_REGEXPS))
        .otherwise(F.get(F.array_compact(broken), F.lit(0)))
    )


def validate_services(annotated: DataFrame, options: ServiceOptions = ServiceOptions()) -> DataFrame:
    """``(name, annotations)`` rows with ``domains``, ``paths``, ``error`` and ``skipped``.

    Services that are not switched on are skipped. ``error`` is the first thing wrong with a
    service, NULL when it may be used; admission control allows exactly those.
    """
    annotations = F.col("annotations")
    main, older = annotations[options.domains], annotations[options.deprecated_domains]
    domains = F.when(F.map_contains_key(annotations, options.domains), main).otherwise(older)
    rows = (
        annotated.withColumn("_text", annotations[options.paths])
        .withColumn("_domains", F.coalesce(domains, F.lit("")))
        .withColumn(
            "skipped", ~F.coalesce(annotations[options.enable].isin(*names.ENABLE_VALUES), F.lit(False))
        )
    )
    rows = settle(rows, {"_rules": _path_rules(trimmed(F.col("_text")))})
    rows = rows.withColumn(
        "_java", java_patterns(F.transform(F.col("_rules"), lambda rule: rule["regexps"]))
    )
    faults = F.array_compact(F.zip_with("_rules", "_java", _rule_error))
    error = (
        F.when(F.col("skipped"), F.lit(None).cast("string"))
        .when(F.col("_domains") == "", F.lit(NO_DOMAINS))
        .when(F.size(split_domains(F.col("_domains"))) == 0, F.lit(EMPTY_DOMAINS))
        .when(F.col("_text").isNull(), F.lit(NO_PATHS))
        .when(trimmed(F.col("_text")) == "", F.lit(EMPTY_PATHS))
        .when(F.col("_rules").isNull(), F.lit(BAD_PATHS))
        .when(F.size(faults) > 0, F.get(faults, F.lit(0)))
        .when(F.size("_rules") == 0, F.lit(NO_LABELS))
    )
    paths = F.zip_with(
        "_rules",
        "_java",
        lambda rule, java: F.struct(rule["label"].alias("label"), java.alias("regexps")),
    )
    usable = F.col("error").isNull() & ~F.col("skipped")
    return (
        rows.withColumn("error", error)
        .withColumn("domains", F.when(usable, split_domains(F.col("_domains"))))
        .withColumn("paths", F.when(usable, paths))
        .drop("_text", "_domains", "_rules", "_java")
    )


def usable_services(validated: DataFrame, on_invalid: str = "skip") -> DataFrame:
    """The services in force. ``on_invalid="fail"`` rejects the whole catalog for one bad service."""
    if on_invalid == "skip":
        return validated.where(F.col("error").isNull() & ~F.col("skipped"))
    if on_invalid != "fail":
        raise ValueError(f"on_invalid must be 'skip' or 'fail', not {on_invalid!r}")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(~F.col("skipped"))
    return validated.where(checked.cast("boolean"))


def explode_service_domains(services: DataFrame, default_domain: str) -> DataFrame:
    """One row per host with ``service`` and ``paths``; for a host named twice the later service counts.

    ``ord`` is the position in the catalog; the name decides between equal positions. The choice is an aggregate, so partial results are
    combined before anything is shuffled.
    """
    hosts = F.flatten(F.transform("domains", lambda d: with_default(d, default_domain)))
    return (
        services.select("ord", "name", "paths", F.explode(hosts).alias("host"))
        .groupBy("host")
        .agg(F.max_by(F.struct(F.col("name").alias("service"), "paths"), F.struct("ord", "name")).alias("_last"))
        .select("host", "_last.service", "_last.paths")
    )
