"""Service-level indicators: from records to requests matched with services and path labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from podlens import names
from podlens.functions.documents import document, document_value, struct_type
from podlens.functions.lines import cri_time, docker_time, event_time
from podlens.functions.numbers import float_text, integer_text
from podlens.functions.pieces import GRAM, SIZES, passed, piece_keys, sieve
from podlens.functions.regexes import required_literals
from podlens.functions.upstream import total_time_text
from podlens.functions.variants import bind, flag_of, is_object, number_of, text_of
from podlens.operators.parsing import line_content
from podlens.operators.rows import settle
from podlens.options import ParseOptions
from podlens.session import scratch_dir, small_side
from podlens.sources.lines import bounded_lines

# Up to this many path patterns are spelled out as literals, which Spark compiles once per task; more are indexed.
LITERAL_PATTERNS = 200

# The fields of a request next to its mark.
FIELDS = (
    names.KEY_HOST,
    names.KEY_METHOD,
    names.KEY_URI,
    names.KEY_STATUS,
    names.KEY_REQUEST_TIME,
    names.KEY_UPSTREAM_POD,
    names.KEY_UPSTREAM_TOTAL,
)
MARKED = (names.KEY_SLA, *FIELDS)


def _marked(rows: DataFrame, field: Callable[[str], Column], more: dict[str, Column] | None = None) -> DataFrame:
    """Rows with a true mark, with the other fields as VARIANT columns named ``_<key>``.

    The mark is tested first, so other rows cost one field.
    """
    columns = {f"_{key}": field(key) for key in FIELDS}
    return settle(rows, columns | (more or {}), keep=flag_of(field(names.KEY_SLA)))


def _requests(marked: DataFrame, upstream_total: Column) -> DataFrame:
    """The marked rows that have all required fields, as typed request columns."""

    def raw(key: str) -> Column:
        return F.col(f"_{key}")

    status = raw(names.KEY_STATUS)
    typed = {
        "host": text_of(raw(names.KEY_HOST)),
        "pod_name": F.coalesce(text_of(raw(names.KEY_UPSTREAM_POD)), F.lit("")),
        "method": text_of(raw(names.KEY_METHOD)),
        "uri": text_of(raw(names.KEY_URI)),
        "_code": number_of(status),
        "_code_text": text_of(status),
        # Numbers and number texts are read alike, so the type of the time does not matter.
        "_time": F.try_variant_get(raw(names.KEY_REQUEST_TIME), "$", "string"),
        "upstream_total": upstream_total,
    }
    kept = [c for c in marked.columns if not c.startswith("_")]
    rows = marked.select(*kept, *[column.alias(name) for name, column in typed.items()])
    code = F.col("_code")
    whole = F.when((code == F.floor(code)) & (F.abs(code) < F.lit(9.2e18)), code.try_cast("bigint"))
    numbers = {
        "status": F.coalesce(whole, integer_text(F.col("_code_text"))),
        "request_time": float_text(F.col("_time"), specials=True),
    }
    filled = (F.col("host") != "") & (F.col("method") != "") & (F.col("uri") != "")
    found = settle(rows, numbers, keep=filled).where(F.col("status").isNotNull() & F.col("request_time").isNotNull())
    order = ("host", "pod_name", "method", "uri", "status", "request_time", "upstream_total")
    return found.select(*kept, *order)


def extract_sli(records: DataFrame, user_key: str = "") -> DataFrame:
    """The requests among the records; reads the merged record, or the user group if that has a key."""
    record = F.col("record")

    def field(key: str) -> Column:
        if user_key:
            return F.try_variant_get(record[user_key], f"$.{key}", "variant")
        return record[key]

    marked = _marked(records, field).drop("record")
    return _requests(marked, number_of(F.col(f"_{names.KEY_UPSTREAM_TOTAL}")))


def extract_sli_from_lines(lines: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """The same requests straight from raw lines, without building records; adds ``event_time``.

    Only the few request fields are read out of each payload; nothing is flattened or merged. A
    nested object under one of those names has no place in a flat record, so it counts as absent.
    """
    own_keys = (*MARKED, names.KEY_UPSTREAM_TIME)
    outer_keys = (names.KEY_LOG, names.KEY_TIME, *MARKED)
    content, own, outer = F.col("content"), F.col("_own"), F.col("_outer")
    docker = F.col("format") == names.FORMAT_DOCKER

    bounded = bounded_lines(lines.drop("event_time"), options.max_line_bytes)
    rows = line_content(bounded, F.col("format"), struct_type(outer_keys))
    rows = rows.drop("value").select("*", document(content, struct_type(own_keys)).alias("_doc"))
    rows = rows.select("*", document_value(F.col("_doc"), content).alias("_own")).drop("_doc")

    def field(key: str) -> Column:
        if options.user_key or options.cri_key:
            return own[key]
        # A field of the outer line shows where the payload has none, or one that is flattened away.
        absent = own[key].isNull() | (is_object(own[key]) if options.flatten else F.lit(False))
        return F.when(outer[key].isNotNull() & content.isNotNull() & absent, outer[key]).otherwise(own[key])

    time = F.when(docker, docker_time(outer)).otherwise(cri_time(F.col("_head")))
    more = {"_upstream": own[names.KEY_UPSTREAM_TIME], "event_time": event_time(time)}
    marked = _marked(rows, field, more).drop("content", "_own", "_outer", "_head")
    source = F.col("_upstream")
    given = number_of(F.col(f"_{names.KEY_UPSTREAM_TOTAL}"))
    return _requests(marked, F.coalesce(number_of(source), total_time_text(text_of(source)), given))


def with_path_keys(hosts: DataFrame) -> DataFrame:
    """Column ``paths_key``, which names the list of path rules of a host."""
    return hosts.withColumn("paths_key", F.xxhash64(F.to_json("paths")))


def match_service(requests: DataFrame, hosts: DataFrame) -> DataFrame:
    """Requests whose host belongs to a service; adds ``service`` and the path rules."""
    return requests.join(small_side(hosts), "host", "inner")


def first_label(uri: Column, paths: Column) -> Column:
    """The first label with a pattern found in the URI, ``""`` for none: a plain search of all patterns of the row."""
    hits = F.filter(paths, lambda path: F.exists(path["regexps"], lambda regexp: F.rlike(uri, regexp)))
    return F.coalesce(F.get(hits, F.lit(0))["label"], F.lit(""))


_RULE = "struct<ord: int, label: string, regexp: string, literal: string>"
_INDEX = f"struct<always: array<{_RULE}>, buckets: array<array<{_RULE}>>>"


def with_path_index(hosts: DataFrame) -> DataFrame:
    """Column ``path_index`` in place of ``paths``: the rules of a host by a piece of the text they need.

    A rule that needs a text of three characters or more lies in the bucket of the rarest three of them;
    there are twice as many buckets as rules. The others lie in ``always``.
    """
    lists = hosts.select("paths_key", "paths").dropDuplicates(["paths_key"])
    labels = lists.select("paths_key", F.posexplode("paths").alias("at", "path"))
    patterns = labels.select("paths_key", "at", "path.label", F.posexplode("path.regexps").alias("nth", "regexp"))
    literal = required_literals(F.col("regexp"))
    rules = settle(patterns, {"literal": literal}).withColumn("rule", F.struct("at", "nth"))
    grams = F.transform(F.sequence(F.lit(1), F.length("literal") - GRAM + 1), lambda i: F.substring("literal", i, F.lit(GRAM)))
    several = F.when(F.length("literal") >= GRAM, grams).otherwise(F.array().cast("array<string>"))
    spread = rules.select("*", F.explode_outer(several).alias("gram"))
    times = spread.withColumn("times", F.count("*").over(Window.partitionBy("paths_key", "gram")))
    chosen = times.groupBy("paths_key", "rule", "label", "regexp", "literal").agg(
        F.min_by("gram", F.struct("times", "gram")).alias("gram")
    )
    place = Window.partitionBy("paths_key")
    # A list of rules is as long as one annotation of one service.
    number = F.row_number().over(place.orderBy("rule")).alias("ord")
    size = F.greatest(2 * F.count("*").over(place), F.lit(64)).cast("int").alias("size")
    bucket = F.when(F.col("gram").isNotNull(), _bucket(F.col("gram"), F.col("size")))
    dealt = chosen.select("*", number, size).withColumn("bucket", bucket)
    rule = F.struct("ord", "label", "regexp", "literal").cast(_RULE)
    filled = dealt.groupBy("paths_key", "size", "bucket").agg(F.collect_list(rule).alias("rules"))
    none = F.array().cast(f"array<{_RULE}>")
    by_bucket = F.map_from_entries(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "rules"))))
    always = F.coalesce(F.max(F.when(F.col("bucket").isNull(), F.col("rules"))), none)
    tables = filled.groupBy("paths_key", "size").agg(always.alias("always"), by_bucket.alias("filled"))
    buckets = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.col("filled")[i], none))
    index = F.struct("always", buckets.alias("buckets")).cast(_INDEX)
    return hosts.drop("paths").join(tables.select("paths_key", index.alias("path_index")), "paths_key", "left")


def _bucket(gram: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(gram), size).cast("int")


def indexed_label(uri: Column, index: Column) -> Column:
    """As :func:`first_label`, but only rules whose text occurs in the URI are tried."""
    buckets = index["buckets"]

    def candidates(signs: Column) -> Column:
        starts = F.when(F.size(signs) >= GRAM, F.sequence(F.lit(0), F.size(signs) - GRAM))
        grams = F.transform(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda i: F.concat(*[F.get(signs, i + k) for k in range(GRAM)]),
        )
        found = F.flatten(F.transform(F.array_distinct(grams), lambda gram: F.get(buckets, _bucket(gram, F.size(buckets)))))
        return F.array_sort(F.array_distinct(F.concat(index["always"], found)))

    rules = bind(F.split(uri, ""), candidates)
    hits = F.filter(rules, lambda rule: F.contains(uri, rule["literal"]) & F.rlike(uri, rule["regexp"]))
    return F.coalesce(F.get(hits, F.lit(0))["label"], F.lit(""))


def path_lists(hosts: DataFrame) -> DataFrame:
    """``(paths_key, at, label, regexps)``: the path rules of a keyed catalog, a row each in the order of ``at``."""
    listed = hosts.select("paths_key", F.posexplode("paths").alias("at", "path"))
    return listed.select("paths_key", F.col("at").cast("bigint").alias("at"), "path.label", "path.regexps")


def path_rules(lists: DataFrame) -> tuple[list[Row], DataFrame | None]:
    """The patterns of :func:`path_lists`: a few to be tried on every URI, and a table of the others, if there are.

    A rule of the table lies under ``_key``, the rarest piece of its text among those of one length, the greatest
    that the text has. Patterns of a length that few have are not worth the pieces of all URIs; like those that have
    too short a text they are tried as they are, up to :data:`LITERAL_PATTERNS` in all.
    """
    spark = lists.sparkSession
    patterns = lists.select("paths_key", "at", "label", F.posexplode("regexps").alias("nth", "regexp"))
    # Of equal patterns of a list the first one counts.
    rule = F.min(F.struct("at", "nth", "label")).alias("rule")
    first = patterns.where(F.col("regexp").isNotNull()).groupBy("paths_key", "regexp").agg(rule)
    length = F.octet_length("literal")
    size = F.coalesce(*[F.when(length >= n, F.lit(n)) for n in SIZES], F.lit(0))
    rules = settle(first, {"literal": required_literals(F.col("regexp"))}).withColumn("size", size)
    rules = _stored(rules.select("paths_key", "rule.*", "regexp", "literal", "size"), "patterns")
    few, tried = [], 0
    for row in sorted(rules.groupBy("size").count().collect(), key=lambda row: row["count"]):
        tried += row["count"]
        if tried <= LITERAL_PATTERNS:
            few.append(row["size"])
    rest = rules.where(~F.col("size").isin(few)) if few else rules
    literal = rules.where(F.col("size").isin(few)).collect() if few else []
    if tried <= LITERAL_PATTERNS:
        return literal, None
    name = ["paths_key", "at", "nth"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = (batch[column].to_numpy(zero_copy_only=False) for column in ("paths_key", "size"))
            for rows, keys in piece_keys(batch["literal"], lists, {0, *SIZES}, sizes):
                yield _taken(batch.select(name), rows, keys)

    pieces = rest.select(*name, "literal", "size").mapInArrow(spread, "paths_key bigint, at bigint, nth int, _key bigint")
    times = pieces.groupBy("_key").agg(F.count("*").alias("times"))
    # Files tell the size of packed rows, by which Spark would broadcast too much.
    chosen = pieces.join(times.hint("merge"), "_key").groupBy(*name).agg(F.min_by("_key", F.struct("times", "_key")).alias("_key"))
    return literal, _stored(rest.join(chosen.hint("merge"), name), "rules")


def _stored(rows: DataFrame, label: str) -> DataFrame:
    stored = scratch_dir(rows.sparkSession, label)
    rows.write.parquet(stored)
    return rows.sparkSession.read.schema(rows.schema).parquet(stored)


def _taken(batch: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """These rows, each with a key."""
    columns = [column.take(pa.array(rows)) for column in batch.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(keys.view(np.int64))], [*batch.schema.names, "_key"])


def _tried(rules: list[Row], at: str) -> Column:
    """The first of some patterns that is found in the URI, as ``(at, nth, label)``, or NULL."""
    uri, found = F.col("uri"), F
    for row in sorted(rules, key=lambda row: (row["at"], row["nth"])):
        hit = (F.col("paths_key") == row["paths_key"]) & F.contains(uri, F.lit(row["literal"])) & uri.rlike(row["regexp"])
        rule = F.struct(F.lit(row["at"]).alias("at"), F.lit(row["nth"]).alias("nth"), F.lit(row["label"]).alias("label"))
        found = found.when(hit, rule.cast(at))
    return (F.lit(None) if found is F else found).cast(at)


def joined_labels(matched: DataFrame, tried: list[Row], rules: DataFrame | None) -> DataFrame:
    """As :func:`label_path`, by the two parts of :func:`path_rules`.

    No row carries a list of rules. The distinct URIs are joined with the table by those of their pieces that some
    rule lies under, so the join takes in about as many rows as there are URIs that a text of a rule is found in.
    """
    kept = [name for name in matched.columns if name not in ("path", "paths", "paths_key", "path_index")]
    kind = "struct<at: bigint, nth: int, label: string>"
    first, rows = _tried(tried, kind), matched.drop("path")
    if rules is not None:
        sizes = {row["size"] for row in rules.select("size").distinct().collect()}
        keys = rules.select("_key").distinct().toArrow()["_key"].to_numpy()
        words = matched.sparkSession.sparkContext.broadcast(sieve(keys.view(np.uint64)))

        def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch["paths_key"].to_numpy(zero_copy_only=False)
                for places, keys in piece_keys(batch["uri"], lists, sizes):
                    found = passed(keys, words.value)
                    yield _taken(batch, places[found], keys[found])

        uris = matched.where(F.col("uri").isNotNull()).select("paths_key", "uri").distinct()
        pieces = uris.mapInArrow(sifted, "paths_key bigint, uri string, _key bigint")
        met = pieces.join(rules.hint("merge"), ["paths_key", "_key"])
        hits = met.where(F.contains("uri", F.col("literal")) & F.rlike(F.col("uri"), F.col("regexp")))
        labels = hits.groupBy("paths_key", "uri").agg(F.min(F.struct("at", "nth", "label").cast(kind)).alias("_joined"))
        rows, first = rows.join(labels, ["paths_key", "uri"], "left"), F.least(first, F.col("_joined"))
    return rows.select(*kept, F.coalesce(first["label"], F.lit("")).alias("path"))


def literal_rules(hosts: DataFrame) -> list[Row] | None:
    """The distinct path rules of a keyed catalog, or None when there are more than fit in literals."""
    rules = hosts.select("paths_key", "paths").dropDuplicates(["paths_key"])
    number = F.aggregate("paths", F.lit(0), lambda n, path: n + F.size(path["regexps"]))
    # A long list stays where it is.
    short = F.when(F.col("patterns") <= LITERAL_PATTERNS, F.col("paths")).alias("paths")
    counted = rules.withColumn("patterns", number).select("paths_key", short, "patterns")
    rows = counted.limit(LITERAL_PATTERNS + 1).collect()
    patterns = sum(row["patterns"] for row in rows)
    return rows if len(rows) <= LITERAL_PATTERNS and patterns <= LITERAL_PATTERNS else None


def literal_label(uri: Column, paths_key: Column, rules: list[Row]) -> Column:
    """As :func:`first_label`, with the patterns as literals, chosen by ``paths_key``."""
    label = F
    for row in rules:
        for path in row["paths"]:
            for regexp in path["regexps"]:
                label = label.when((paths_key == row["paths_key"]) & uri.rlike(regexp), F.lit(path["label"]))
    return F.lit("") if label is F else label.otherwise(F.lit(""))


def label_path(matched: DataFrame, rules: list[Row] | None = None) -> DataFrame:
    """Column ``path`` with the label of the URI, in the order of the rules; ``""`` for a miss.

    With ``rules`` the patterns are literals, which Spark compiles once per task; without, they come
    from the ``path_index`` of each row, or from its plain ``paths``. A file ``path`` of the lines gives
    way to the label.
    """
    uri = F.col("uri")
    if rules is not None:
        label = literal_label(uri, F.col("paths_key"), rules)
    elif "path_index" in matched.columns:
        label = indexed_label(uri, F.col("path_index"))
    else:
        label = first_label(uri, F.col("paths"))
    return settle(matched.drop("path"), {"path": label}).drop("paths", "paths_key", "path_index")


def prepared_hosts(hosts: DataFrame) -> tuple[DataFrame, list[Row] | None]:
    """Hosts without their path rules, and these: a few as literals, more as an index beside each host.

    The index serves streams, whose rows cannot be brought together again; see :func:`labelled`.
    """
    keyed = with_path_keys(hosts)
    rules = literal_rules(keyed)
    return (with_path_index(keyed) if rules is None else keyed.drop("paths")), rules


def labelled(hosts: DataFrame, match: Callable[[DataFrame], DataFrame], lists: DataFrame | None = None) -> DataFrame:
    """Requests with ``service`` and ``path``; ``match`` joins them with the hosts.

    A long list of rules stays a table, which the URIs are joined with. A stream has the lists as an index.
    ``lists`` are the rules of hosts that have a ``paths_key`` in place of ``paths``; see :func:`indicators`.
    """
    if lists is not None:
        return joined_labels(match(hosts), *path_rules(lists))
    keyed = with_path_keys(hosts)
    rules = literal_rules(keyed)
    if rules is not None:
        return label_path(match(keyed.drop("paths")), rules)
    matched = match(keyed.drop("paths"))
    if matched.isStreaming:
        return label_path(match(with_path_index(keyed)))
    return joined_labels(matched, *path_rules(path_lists(keyed)))


def indicators(requests: DataFrame, hosts: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Requests with ``service`` and ``path``; requests for unknown hosts are left out.

    A list of rules that is too long for one row may stand in ``lists``, for requests that are no stream: hosts then
    name theirs by a whole number, ``paths_key``, and ``lists`` has a row ``(paths_key, at, label, regexps)`` for each
    rule, in the order of the whole number ``at``, which is never NULL where there is a pattern.
    """
    return labelled(hosts, lambda prepared: match_service(requests, prepared), lists)
