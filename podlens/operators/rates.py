"""Rate rules per container and the replay of throttling over event times."""

from __future__ import annotations

import json
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podlens.functions.regexes import required_literal
from podlens.functions.variants import bind
from podlens.operators.sli import GRAM, LITERAL_PATTERNS
from podlens.options import RateOptions
from podlens.session import scratch_dir, small_side
from podlens.sources.rules import RateRule


def _ordered(rules: list[RateRule]) -> list[RateRule]:
    """Rules with both patterns first, then pod rules, then namespace rules; each in list order."""
    both = [r for r in rules if r.namespace and r.pod]
    pods = [r for r in rules if r.pod and not r.namespace]
    namespaces = [r for r in rules if r.namespace and not r.pod]
    return both + pods + namespaces


def _matches(rule: RateRule, namespace: Column, pod: Column) -> Column:
    tests = []
    if rule.namespace:
        tests.append(namespace.rlike(rule.namespace))
    if rule.pod:
        tests.append(pod.rlike(rule.pod))
    return tests[0] & tests[1] if len(tests) == 2 else tests[0]


def rate_column(
    namespace: Column, pod: Column, rules: list[RateRule], options: RateOptions = RateOptions()
) -> Column:
    """The rate of the first rule that matches, else the default. A NULL name matches no pattern.

    The rules are configuration, so they are written into the expression: no join. Every pattern of a
    short list is compiled once per task; a long list is a constant of which a row tries few rules.
    """
    if options.default_rate < 1:
        raise ValueError("rate must be at least one line per second")
    default = F.lit(float(options.default_rate))
    if len(rules) > LITERAL_PATTERNS:
        return F.coalesce(_indexed_rate(namespace, pod, _ordered(rules)), default)
    # One case with a branch for each rule: it gets longer with the list, not deeper.
    rate = F
    for rule in _ordered(rules):
        rate = rate.when(_matches(rule, namespace, pod), F.lit(float(rule.rate)))
    return default if rate is F else rate.otherwise(default)


_RULE = "struct<ord: int, namespace: string, pod: string, namespace_text: string, pod_text: string, rate: double>"


def _rule_index(rules: list[RateRule]) -> str:
    """The rules as JSON: ``always`` to be tried, and ``buckets`` by the rarest three characters of the text they need."""
    entries = [
        (i, r.namespace, r.pod, required_literal(r.namespace), required_literal(r.pod), float(r.rate)) for i, r in enumerate(rules)
    ]
    grams = []
    for *_, namespace, pod, _ in entries:
        text = pod if len(pod) >= GRAM else namespace
        grams.append({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    times = Counter(gram for own in grams for gram in own)
    always, buckets = [], [[] for _ in range(2 * len(rules))]
    names = ("ord", "namespace", "pod", "namespace_text", "pod_text", "rate")
    for entry, own in zip(entries, grams):
        gram = min(own, key=lambda gram: (times[gram], gram), default=None)
        place = always if gram is None else buckets[zlib.crc32(gram.encode()) % len(buckets)]
        place.append(dict(zip(names, entry)))
    return json.dumps({"always": always, "buckets": buckets})


def _indexed_rate(namespace: Column, pod: Column, rules: list[RateRule]) -> Column:
    """The rate of the first rule that matches, NULL for none; only rules whose text a name may hold are tried.

    The index is a constant: Spark reads its JSON once, when it optimises the query.
    """
    index = F.from_json(F.lit(_rule_index(rules)), f"always array<{_RULE}>, buckets array<array<{_RULE}>>")
    buckets, size = index["buckets"], F.lit(2 * len(rules))

    def found(text: Column) -> Column:
        def under(signs: Column) -> Column:
            starts = F.when(F.size(signs) >= GRAM, F.sequence(F.lit(0), F.size(signs) - GRAM))
            places = F.transform(
                starts, lambda i: F.crc32(F.concat(*[F.get(signs, i + k) for k in range(GRAM)]).cast("binary")) % size
            )
            return F.flatten(F.transform(F.array_distinct(places), lambda place: F.get(buckets, place.cast("int"))))

        return F.coalesce(bind(F.split(text, ""), under), F.array().cast(f"array<{_RULE}>"))

    def matches(rule: Column) -> Column:
        def fits(name: Column, text: str, pattern: str) -> Column:
            return (rule[pattern] == "") | (F.contains(name, rule[text]) & F.rlike(name, rule[pattern]))

        return fits(namespace, "namespace_text", "namespace") & fits(pod, "pod_text", "pod")

    return F.array_min(F.filter(F.concat(index["always"], found(pod), found(namespace)), matches))["rate"]


def resolve_rate(
    pods: DataFrame, rules: list[RateRule], options: RateOptions = RateOptions()
) -> DataFrame:
    """Column ``rate`` for rows with ``namespace`` and ``pod``: one row per pod or container."""
    return pods.withColumn("rate", rate_column(F.col("namespace"), F.col("pod"), rules, options))


def attach_rate(
    lines: DataFrame, catalog: DataFrame, rules: list[RateRule], options: RateOptions = RateOptions()
) -> DataFrame:
    """Rates for lines, resolved once per pod of the container catalog and joined on.

    Only lines of a pod that the catalog does not know are matched with the rules one by one.
    """
    pods = resolve_rate(catalog.select("namespace", "pod").distinct(), rules, options)
    known = pods.withColumnRenamed("rate", "_rate")
    joined = lines.join(small_side(known), ["namespace", "pod"], "left")
    own = rate_column(F.col("namespace"), F.col("pod"), rules, options)
    return joined.withColumn("rate", F.coalesce("_rate", own)).drop("_rate")


def throttle_delay(
    lines: DataFrame,
    limiter: tuple[str, ...] = ("path",),
    seq: str = "seq",
    arrival: str = "arrival",
    slice_width: int = 1_000_000,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Column ``delay``: how long each line would have waited in the token bucket of its log file.

    ``limiter`` names what has a bucket of its own. ``seq`` is the unique integer position of a line
    in it (line number or byte offset), ``arrival`` its time in seconds, ``rate`` the lines per second; the burst is the
    whole part of the rate. With n the rank of a line and a its arrival, a token is free at
    ``n/r + max over earlier lines j of (a_j - (j-1)/r)``, and the burst lets a line in
    ``burst/r`` sooner. A line with several ``reads`` takes a token for each, and its delay is their sum.

    Rank and maximum are running values over a file that may hold a large part of all
    lines. They are therefore built from slices of ``slice_width`` positions, each at most that
    many rows: first within the slices, then over one summary row per slice, then added up.
    Lines are shuffled and sorted once, by file and slice; with their places they are stored in the
    shared scratch folder, and the summary of the slices is joined to that by its measured size.

    ``busy_until`` is the time at which the tokens used so far are all earned again. ``carried`` holds the
    last one of each file (``limiter`` columns and ``busy_until``) from the lines before these, so that
    a file may be replayed in parts; the rate may differ between the parts.
    """
    keys = list(limiter)
    rate = F.col("rate")
    named = {key: F.coalesce(key, F.lit("")) for key in keys}
    place = F.floor(F.col(seq) / F.lit(slice_width)).cast("long")
    reads = F.col("reads") if "reads" in lines.columns else F.lit(1)
    rows = lines.withColumns({**named, "_slice": F.coalesce(place, F.lit(0)), "_reads": reads.cast("long")})
    inside = Window.partitionBy(*keys, "_slice").orderBy(seq)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # ``_n`` is the number of the first token that a line takes.
    local = rows.withColumn("_n", F.sum("_reads").over(upto) - F.col("_reads") + 1).withColumn(
        "_lead", F.max(F.col(arrival) - (F.col("_n") - 1) / rate).over(upto)
    )
    spark, stored = lines.sparkSession, scratch_dir(lines.sparkSession, "throttle")
    local.write.parquet(stored)
    local = spark.read.schema(local.schema).parquet(stored)
    summary = local.groupBy(*keys, "_slice").agg(
        F.max(F.col("_n") + F.col("_reads") - 1).alias("_rows"), F.max("_lead").alias("_top"), F.max("rate").alias("_rate")
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.withColumn("_skip", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    offsets = offsets.withColumn("_carry", F.max(F.col("_top") - F.col("_skip") / F.col("_rate")).over(before))
    if carried is not None:
        known = carried.select(*[F.coalesce(key, F.lit("")).alias(key) for key in keys], F.col("busy_until").alias("_busy"))
        offsets = offsets.join(known, keys, "left").withColumn("_carry", F.greatest("_carry", "_busy"))
    joined = local.join(small_side(offsets.select(*keys, "_slice", "_skip", "_carry")), [*keys, "_slice"])
    lead = F.greatest(F.col("_lead") - F.col("_skip") / rate, F.col("_carry"))
    first = (F.col("_skip") + F.col("_n") - F.floor(rate)) / rate + lead - F.col(arrival)
    busy = (F.col("_skip") + F.col("_n") + F.col("_reads") - 1) / rate + lead
    rows = joined.withColumns({"_first": first, "busy_until": busy.cast("double")})
    # A rate below one line per second has no burst, so no line would ever pass: the delay is NULL.
    # Rules and defaults with such a rate are refused when they are loaded.
    found = rows.withColumn("delay", F.when(rate >= 1, _waiting(F.col("_first"), F.col("_reads"), rate)).cast("double"))
    found = found if carried is not None else found.drop("busy_until")
    return found.drop("_slice", "_n", "_lead", "_skip", "_carry", "_reads", "_first")


def _waiting(first: Column, reads: Column, rate: Column) -> Column:
    """The sum of the delays of ``reads`` tokens: the first waits ``first``, each other 1/rate longer than the one before.

    Tokens that are free already (a wait below zero) add nothing.
    """
    free = F.least(F.greatest(F.ceil(-first * rate), F.lit(0)), reads)
    waiting = reads - free
    steps = (reads * (reads - 1) - free * (free - 1)) / 2
    several = waiting * first + steps / rate
    return F.when(reads == 1, F.greatest(F.lit(0.0), first)).otherwise(F.greatest(F.lit(0.0), several))


def throttling_total(
    delayed: DataFrame,
    running: DataFrame | None = None,
    container: tuple[str, ...] = ("namespace", "pod", "container"),
    sum_scale: int | None = None,
) -> DataFrame:
    """Total ``value`` of the delays per container, over all its files.

    Given the running containers, only theirs are reported: a series ends with its container.
    """
    from podlens.operators.metrics import duration_sum

    keys = list(container)
    totals = delayed.groupBy(*keys).agg(duration_sum(F.col("delay"), sum_scale).alias("value"))
    if running is None:
        return totals
    return totals.join(running.where("running").select(*keys).distinct(), keys, "left_semi")
