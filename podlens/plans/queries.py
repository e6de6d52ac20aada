"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens import names
from podlens.functions.domains import split_domains
from podlens.functions.maps import (
    container_of,
    extend_map,
    flatten_entries,
    namespace_of,
    pod_of,
    project_keys,
)
from podlens.functions.upstream import last_time_text, total_time_text
from podlens.functions.documents import parse_object
from podlens.functions.variants import number_of, text_of
from podlens.operators.enrich import enrich_cri_by_path, enrich_with_metadata, with_ext
from podlens.operators.filters import drop_suppressed, strip_reserved
from podlens.operators.journal import normalise_journal
from podlens.operators.metrics import (
    http_request_count,
    http_request_time,
    http_request_total_count,
    http_upstream_response_time_total,
    log_message_count,
    metric_samples,
    metrics_reset,
    sample_text,
    labels_column,
    with_reads,
    ALL_LABELS,
)
from podlens.operators.output import json_text, to_json_lines, union_outputs
from podlens.operators.parsing import (
    assemble_record,
    parse_cri_lines,
    parse_docker_lines,
    parse_fallback_raw,
    parse_lines,
    parse_user_payload,
)
from podlens.operators.rates import attach_rate, resolve_rate, throttle_delay, throttling_total
from podlens.operators.rows import settle
from podlens.operators.services import explode_service_domains, usable_services, validate_services
from podlens.operators.sli import (
    extract_sli,
    extract_sli_from_lines,
    indicators,
    label_path,
    match_service,
)
from podlens.options import (
    DeliveryOptions,
    MetricOptions,
    ParseOptions,
    RefreshOptions,
    ServiceOptions,
)
from podlens.plans import workload
from podlens.plans.records import record_lines
from podlens.session import configure, configure_state, ensure_parallel, scratch_dir, ship_package
from podlens.sources.containers import (
    container_catalog_cri,
    container_catalog_docker,
    cri_quarantine,
    filter_catalog,
    list_files,
    source_inventory_diff,
)
from podlens.sources.journal import journal_rows, scan_journal_export
from podlens.sources.lines import scan_log_lines, scan_partitioned_lines, split_oversize_lines, stream_log_lines
from podlens.sources.rules import check_rules, load_rate_rules, rules_from_table
from podlens.sources.services import load_exported_services, load_service_annotations
from podlens.streaming.jobs import emit_to_sink, stream_indicators, stream_metrics, stream_records
from podlens.streaming.history import CatalogHistory, RefreshingHistory, indicators_as_of
from podlens.streaming.inventory import LiveInventory
from podlens.streaming.ledger_tail import stream_tail_ledger
from podlens.streaming.live import LiveOptions, LiveSamples, stream_samples
from podlens.streaming.refresh import RefreshingTable
from podlens.streaming.sinks import FileSink, deliver_batches, published_messages, register_sink
from podlens.streaming.tail import stream_tail

Query = Callable[[SparkSession, str], DataFrame]

SPLIT_BYTES = 1000
METRICS = MetricOptions(sum_scale=3)
GROUPED = ParseOptions(user_key="log", cri_key="cri", ext_key="env")

REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark).conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return run(spark, sf_dir)

    REGISTRY[run.__name__] = prepared
    return run


def _text(record: str, key: str) -> Column:
    return text_of(F.col(record)[key])


def _number(record: str, key: str) -> Column:
    return number_of(F.col(record)[key])


# Scans, catalogs and sources


def _by_folder(lines: DataFrame) -> DataFrame:
    folder = F.regexp_extract("path", "folder=([^/]*)", 1)
    line_format = F.regexp_extract("path", "format=([^/]*)", 1)
    return (
        lines.select(folder.alias("folder"), line_format.alias("format"), "value")
        .groupBy("folder", "format")
        .agg(
            F.count("*").alias("n_lines"),
            F.count_if(F.startswith("value", F.lit("event "))).alias("n_plain"),
            F.count_if(F.endswith("value", F.lit("}"))).alias("n_whole"),
            F.sum(F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long")).alias("digest"),
        )
    )


@query
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_folder(scan_log_lines(spark, workload.write_segments(spark, sf_dir)))


@query
def scan_lines_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one format and container; the other folders are not listed."""
    lines = scan_partitioned_lines(spark, workload.write_segments(spark, sf_dir), ["format", "folder", "container"])
    return _by_folder(lines.where((F.col("format") == "docker") & (F.col("container") == "c1")))


@query
def stream_lines_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream."""
    root = workload.write_segments(spark, sf_dir)
    lines = scan_partitioned_lines(spark, root, ["format", "folder", "container"], stream=True)
    return _by_folder(_run_to_parquet(spark, lines.where((F.col("format") == "docker") & (F.col("container") == "c1"))))


@query
def split_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = workload.table(spark, sf_dir, "documents")
    lines = documents.where(F.length("text") > 0).select(
        "doc_id",
        (F.octet_length("text") == F.length("text")).alias("ascii"),
        F.col("text").alias("value"),
    )
    split = split_oversize_lines(lines, SPLIT_BYTES)
    return split.select("doc_id", "chunk", F.when(F.col("ascii"), F.md5("value")).alias("ascii_md5"))


def _run_to_parquet(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    out = scratch_dir(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint")
    writer.format("parquet").trigger(availableNow=True).start(f"{out}/data").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


@query
def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workload.write_segments(spark, sf_dir)
    return _by_folder(_run_to_parquet(spark, stream_log_lines(spark, root)))


@query
def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = workload.write_segments(spark, sf_dir).removeprefix("file:")
    stream = stream_tail(spark, f"{root}/**/*.txt", chunk_bytes=1024 * 1024)
    return _by_folder(_run_to_parquet(spark, stream))


@query
def tail_growing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that grow, are rotated and are emptied between the batches of a stream with a ledger."""
    root, out = scratch_dir(spark, "logs").removeprefix("file:"), scratch_dir(spark, "tail")
    for phase in range(3):
        workload.grow_logs(spark, sf_dir, root, phase, 3)
        lines = stream_tail_ledger(spark, f"{root}/*/*/*.log", f"{out}/ledger", shards=4)
        writer = lines.writeStream.option("checkpointLocation", f"{out}/checkpoint").format("parquet")
        writer.trigger(availableNow=True).start(f"{out}/data").awaitTermination()
    return _by_folder(spark.read.parquet(f"{out}/data"))


@query
def catalog_docker(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = workload.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    labels = F.create_map(
        F.lit(names.LABEL_NAMESPACE),
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")),
        F.lit(names.LABEL_POD),
        F.col("s_name"),
        F.lit(names.LABEL_CONTAINER),
        F.when(F.col("s_acctbal") >= 5000, F.lit("big")),
    )
    config = F.to_json(
        F.struct(
            F.concat(F.lit("id"), key).alias("ID"),
            F.struct((F.col("s_acctbal") >= 0).alias("Running")).alias("State"),
            F.struct(F.map_filter(labels, lambda _, v: v.isNotNull()).alias("Labels")).alias("Config"),
        )
    )
    root = scratch_dir(spark, "configs")
    rows = suppliers.select(config.alias("value"), F.concat(F.lit("id"), key).alias("folder"))
    workload.write_configs(rows, root)
    containers = container_catalog_docker(spark, f"{root}/*/*.txt")
    return containers.select(
        "type",
        "id",
        F.regexp_extract("path", "([^/]*)$", 1).alias("file"),
        "running",
        "namespace",
        "pod",
        "container",
    )


def _pod_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = workload.table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    folder = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("broken"), key)).otherwise(
        F.concat_ws("_", F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")), F.concat(F.lit("pod-"), key), F.concat(F.lit("id"), key))
    )
    file = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("0.log.gz")).otherwise(F.lit("0.log"))
    return customers.select(
        F.concat_ws("/", F.lit("/var/log/pods"), folder, F.lower("c_mktsegment"), file).alias("path")
    )


@query
def catalog_cri(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = container_catalog_cri(_pod_paths(spark, sf_dir))
    return containers.select("type", "id", "path", "running", "namespace", "pod", "container")


@query
def catalog_cri_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cri_quarantine(_pod_paths(spark, sf_dir))


@query
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = container_catalog_cri(_pod_paths(spark, sf_dir))
    return filter_catalog(containers, "/var/log/pods", exclude="house").select("path")


@query
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = workload.table(spark, sf_dir, "customer")
    orders = workload.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/logs/"), F.col("c_custkey").cast("string"))
    ordered = F.concat(F.lit("/logs/"), F.col("o_custkey").cast("string"))
    catalog = customers.where(F.col("c_acctbal") >= 1000).select(
        path.alias("path"), (F.col("c_acctbal") >= 5000).alias("running")
    )
    journal = spark.createDataFrame([(names.JOURNAL_LEDGER_KEY,)], "path string")
    ledger = orders.where(F.col("o_totalprice") > 400000).select(ordered.alias("path")).distinct().unionByName(journal)
    followed = orders.where(F.col("o_orderpriority") == "1-URGENT").select(ordered.alias("path")).distinct()
    ignored = customers.where(F.col("c_mktsegment") == "BUILDING").select(path.alias("path"))
    return source_inventory_diff(ledger, catalog, followed, ignored)


@query
def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes over three snapshots of containers that come, end, go and come back."""
    customers = workload.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    inventory, parts = LiveInventory(spark, scratch_dir(spark, "inventory")), []
    for turn in range(3):
        present = (key + 2 * turn) % 5 != 0
        catalog = customers.where(present).select(
            F.concat(F.lit("/logs/"), key).alias("path"), ((key % 4 != 0) | F.lit(turn < key % 3)).alias("running")
        )
        parts.append(inventory.observe(catalog, turn).select(F.lit(turn).alias("turn"), "path", "change"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _journal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export lines: a unit for every type but clicks, and a time that is no number for errors."""
    events = ensure_parallel(workload.table(spark, sf_dir, "events"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    return events.select(
        F.to_json(
            F.struct(
                F.when(F.col("event_type") == "error", F.lit("never")).otherwise(micros).alias("__REALTIME_TIMESTAMP"),
                F.when(F.col("event_type") != "click", F.concat("event_type", F.lit(".service"))).alias("_SYSTEMD_UNIT"),
                F.col("event_id").cast("string").alias("SYSLOG_PID"),
                F.lit("6").alias("PRIORITY"),
                F.col("props").alias("MESSAGE"),
                F.lit("x").alias("_BOOT_ID"),
            )
        ).alias("value")
    )


@query
def journal_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "journal")
    _journal_text(spark, sf_dir).write.text(root)
    return scan_journal_export(spark, root).select(
        _text("row", "SYSLOG_PID").alias("pid"),
        _text("row", "time").alias("time"),
        _text("row", "_SYSTEMD_UNIT").alias("unit"),
        _text("row", "MESSAGE").alias("message"),
        F.size("row").alias("n_fields"),
    )


@query
def journal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = normalise_journal(journal_rows(_journal_text(spark, sf_dir)))
    return to_json_lines(records)


@query
def rate_rules_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from a file with one entry per nation, in force for every customer."""
    root = scratch_dir(spark, "rules")
    nations = workload.table(spark, sf_dir, "nation")
    entry = F.format_string("- namespace: '^%s$'\n  rate: %d", "n_name", F.col("n_nationkey") + 1)
    text = nations.agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("value"))
    text.coalesce(1).write.text(root)
    rules = check_rules(load_rate_rules(spark, root))
    customers = workload.table(spark, sf_dir, "customer").select(
        F.col("c_custkey"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("namespace"),
        F.col("c_name").alias("pod"),
    )
    return resolve_rate(customers, rules).select("c_custkey", "rate")


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service per customer. The balance and segment decide what is right and wrong with it."""
    customers = workload.table(spark, sf_dir, "customer")
    options = ServiceOptions()
    balance = F.floor(F.col("c_acctbal")).cast("long")
    fault = F.pmod(balance, F.lit(16))
    texts = ["", "{}", "{", "[]", '[{"":[]}]', '[{"l":[]}]', '[{"l":[""]}]', '[{"l":["["]}]', '[{"l":[1]}]', '[{"l":["a"]},]']
    paths = F.lit('[{"all":[".*","abc"]},{"b":["def"]}]')
    for i, text in enumerate(texts):
        paths = F.when(fault == i, F.lit(text)).otherwise(paths)
    key = F.col("c_custkey").cast("string")
    domains = (
        F.when(fault == 10, F.lit(" , "))
        .when(fault == 11, F.lit(""))
        .otherwise(F.concat(F.lit(", h"), key, F.lit(" ,n"), F.col("c_nationkey").cast("string"), F.lit(".test,")))
    )
    enable = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("enable")).when(
        F.col("c_mktsegment") == "MACHINERY", F.lit("no")
    ).otherwise(F.lit("true"))
    annotations = F.map_filter(
        F.create_map(
            F.lit(options.enable),
            enable,
            F.when(F.col("c_mktsegment") == "BUILDING", F.lit(options.deprecated_domains)).otherwise(F.lit(options.domains)),
            domains,
            F.lit(options.paths),
            F.when(fault != 12, paths),
        ),
        lambda _, value: value.isNotNull(),
    )
    return customers.select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), annotations.alias("annotations")
    )


@query
def service_annotations_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "export")
    item = F.struct(F.struct("name", "annotations").alias("metadata"))
    lists = _annotated(spark, sf_dir).select("ord", F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
    lists.repartitionByRange(4, "ord").sortWithinPartitions("ord").select("value").write.text(root)
    services = load_exported_services(spark, root, single_document=False)
    entries = F.transform(F.array_sort(F.map_entries("annotations")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return services.select("ord", "name", F.md5(F.array_join(entries, "\n")).alias("annotations_md5"))


@query
def service_annotations_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A YAML list with one service per nation, matched with the customers of the nation."""
    root = scratch_dir(spark, "annotations")
    nations = workload.table(spark, sf_dir, "nation")
    options = ServiceOptions()
    entry = F.format_string(
        f"- name: %s\n  {options.enable}: true\n  {options.domains}: n%d\n  {options.paths}: '[{{\"all\":[\".*\"]}}]'",
        "n_name",
        F.col("n_nationkey"),
    )
    text = nations.agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("value"))
    text.coalesce(1).write.text(root)
    annotated = load_service_annotations(spark, root)
    hosts = explode_service_domains(usable_services(validate_services(annotated), "fail"), "test")
    customers = workload.table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("host")
    )
    return match_service(customers, hosts).select("c_custkey", "service")


# Line parsing


def _parsed_columns(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "event_id",
        "parse_error",
        F.map_contains_key("user", "msg").alias("is_raw"),
        _text("user", "host").alias("host"),
        _number("user", "client.id").cast("long").alias("client_id"),
        _number("user", names.KEY_UPSTREAM_LAST).alias("upstream_last"),
        _number("user", names.KEY_UPSTREAM_TOTAL).alias("upstream_total"),
        F.size("user").alias("n_user"),
        F.coalesce(F.size("cri"), F.lit(0)).alias("n_cri"),
        F.unix_micros("event_time").alias("event_micros"),
    )


@query
def docker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = workload.read_lines(spark, sf_dir).where(F.col("format") == names.FORMAT_DOCKER)
    return _parsed_columns(parse_docker_lines(lines))


@query
def cri_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = workload.read_lines(spark, sf_dir).where(F.col("format") == names.FORMAT_CRI)
    return _parsed_columns(parse_cri_lines(lines))


@query
def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed_columns(parse_lines(workload.read_lines(spark, sf_dir)))


@query
def user_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``props`` objects as payloads; the texts of the documents are payloads that are no object."""
    events = workload.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("props").alias("content"))
    documents = workload.table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("content"))
    user = parse_user_payload(events.unionByName(documents))
    return user.select("id", _number("user", "k").cast("long").alias("k"), F.md5(_text("user", "msg")).alias("raw_md5"))


@query
def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = workload.table(spark, sf_dir, "events")
    nested = F.concat(
        F.lit('{"a":{"b":'), "props", F.lit(',"e":{},"d":{"x":{"y":{"z":null}}}},"l":[{"x":8}],"t":"'), "event_type", F.lit('"}')
    )
    rows = settle(events, {"fields": parse_object(nested)})
    return rows.select("event_id", json_text(flatten_entries(F.col("fields"))).alias("flat"))


@query
def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = assemble_record(parse_lines(with_ext(workload.read_lines(spark, sf_dir)), GROUPED), GROUPED)
    text = F.col("text")
    return records.select("event_id", json_text(F.col("record")).alias("text")).select(
        "event_id",
        F.get_json_object(text, "$.log.host").alias("host"),
        F.get_json_object(text, "$.log['client.kind']").alias("kind"),
        F.get_json_object(text, "$.cri.stream").alias("stream"),
        F.get_json_object(text, "$.env['kubernetes.pod_name']").alias("pod"),
        F.get_json_object(text, "$.host").alias("top_host"),
    )


@query
def fallback_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = workload.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))
    raw = parse_fallback_raw(documents, ParseOptions(raw_key="log"))
    return raw.select("doc_id", F.md5(_text("user", "log")).alias("raw_md5"), F.size("user").alias("n_user"))


# Scalar and map functions


@query
def upstream_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("upstream_response_time")
    return workload.requests(spark, sf_dir).select(
        "event_id", last_time_text(text).alias("last"), total_time_text(text).alias("total")
    )


def _two_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = workload.table(spark, sf_dir, "events")
    left = F.create_map(F.lit("a"), F.col("event_type").cast("variant"), F.lit("b"), F.col("user_id").cast("variant"))
    right = F.create_map(F.lit("b"), F.col("event_id").cast("variant"), F.lit("c"), F.lit("x").cast("variant"))
    return events.select("event_id", left.alias("left"), right.alias("right"))


@query
def extended_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = extend_map(F.col("left"), F.col("right"))
    return _two_maps(spark, sf_dir).select("event_id", json_text(both).alias("merged"))


@query
def projected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = project_keys(F.col("left"), ["b", "missing"])
    return _two_maps(spark, sf_dir).select("event_id", json_text(kept).alias("kept"))


@query
def label_accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pod is a number for errors, and clicks have no namespace."""
    event_type = F.col("event_type")
    events = workload.table(spark, sf_dir, "events")
    fields = F.create_map(
        F.lit(names.META_POD),
        F.when(event_type == "error", F.col("event_id").cast("variant")).otherwise(event_type.cast("variant")),
        F.when(event_type == "click", F.lit("other")).otherwise(F.lit(names.META_NAMESPACE)),
        F.lit("ns").cast("variant"),
    )
    record = F.col("record")
    return events.select("event_id", fields.alias("record")).select(
        "event_id",
        namespace_of(record).alias("namespace"),
        pod_of(record).alias("pod"),
        container_of(record).alias("container"),
    )


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = workload.read_lines(spark, sf_dir).select("event_id", "value", "path")
    return enrich_with_metadata(lines, workload.catalog(spark, sf_dir))


@query
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enriched(spark, sf_dir).select("event_id", "format", json_text(F.col("ext")).alias("ext"))


@query
def enriched_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = workload.read_lines(spark, sf_dir).where(F.col("format") == names.FORMAT_CRI)
    metadata = enrich_cri_by_path(lines.select("event_id", "value", "path"))
    return metadata.select("event_id", "format", json_text(F.col("ext")).alias("ext"))


# Filters and output


def _records(spark: SparkSession, sf_dir: str, options: ParseOptions = ParseOptions()) -> DataFrame:
    return assemble_record(parse_lines(_enriched(spark, sf_dir), options), options)


@query
def kept_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_suppressed(_records(spark, sf_dir)).select("event_id")


@query
def kept_records_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_suppressed(_records(spark, sf_dir, GROUPED), GROUPED.user_key).select("event_id")


@query
def stripped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = strip_reserved(_records(spark, sf_dir))
    return stripped.select(
        "event_id",
        F.size("record").alias("n_fields"),
        (F.map_contains_key("record", "sla") | F.map_contains_key("record", "logging")).alias("has_reserved"),
    )


@query
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four steps one after the other."""
    return to_json_lines(strip_reserved(drop_suppressed(_records(spark, sf_dir))))


@query
def json_records_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one expression per line."""
    return record_lines(_enriched(spark, sf_dir))


@query
def united_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    journal = to_json_lines(normalise_journal(journal_rows(_journal_text(spark, sf_dir))))
    return union_outputs(record_lines(_enriched(spark, sf_dir)), journal)


# Service catalog and indicators


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_sli_from_lines(workload.read_lines(spark, sf_dir))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators(_requests(spark, sf_dir), workload.hosts(spark))


SLI_COLUMNS = ("event_id", "host", "pod_name", "method", "uri", "status", "request_time", "upstream_total")


@query
def sli_from_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_sli(_records(spark, sf_dir)).select(*SLI_COLUMNS)


@query
def sli_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select(*SLI_COLUMNS)


@query
def validated_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    validated = validate_services(_annotated(spark, sf_dir))
    return validated.select("ord", "skipped", "error", F.array_join("domains", "|").alias("domains"), F.size("paths").alias("n_paths"))


@query
def split_domain_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, an empty part, a blank part and the segment, within outer commas."""
    customers = workload.table(spark, sf_dir, "customer")
    text = F.concat(F.lit(" ,"), "c_name", F.lit(" ,, ,"), "c_mktsegment", F.lit(", "))
    return customers.select("c_custkey", F.array_join(split_domains(text), "|").alias("domains"))


@query
def service_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = usable_services(validate_services(_annotated(spark, sf_dir)))
    return explode_service_domains(services, "cluster.test").select("host", "service")


@query
def matched_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_service(_requests(spark, sf_dir), workload.hosts(spark)).select("event_id", "service")


@query
def labelled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("event_id", "service", "path")


@query
def labelled_paths_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = match_service(_requests(spark, sf_dir), workload.hosts(spark))
    return label_path(matched).select("event_id", "service", "path")


@query
def labelled_paths_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path rule for every customer and one for all of them behind these, over the orders.

    The rules are a row each: as one list they would have to fit in the memory of one task.
    """
    customers = workload.table(spark, sf_dir, "customer")
    own = customers.select(
        F.lit(0).cast("bigint").alias("paths_key"),
        F.col("c_custkey").cast("bigint").alias("at"),
        F.concat(F.lit("c"), F.col("c_custkey")).alias("label"),
        F.array(F.concat(F.lit("^/customer/"), F.col("c_custkey"), F.lit("/"))).alias("regexps"),
    )
    last = F.array(F.lit("/order/[0-9]*5$")).alias("regexps")
    shop = spark.range(1).select(F.col("id").alias("paths_key"), F.lit("shop").alias("host"), F.lit("shop").alias("service"))
    lists = own.unionByName(shop.select("paths_key", F.lit(2**63 - 1).alias("at"), F.lit("all").alias("label"), last))
    orders = workload.table(spark, sf_dir, "orders")
    # Some of the paths name a customer that does not exist.
    customer = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("no"), "o_custkey")).otherwise(F.col("o_custkey").cast("string"))
    uri = F.concat(F.lit("/customer/"), customer, F.lit("/order/"), "o_orderkey")
    requests = orders.select("o_orderkey", F.lit("shop").alias("host"), uri.alias("uri"))
    return indicators(requests, shop, lists).select("o_orderkey", "path")


# Metrics


@query
def request_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http_request_count(_matched(spark, sf_dir))


@query
def request_total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http_request_total_count(_matched(spark, sf_dir))


@query
def request_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http_request_time(_matched(spark, sf_dir), METRICS)


@query
def upstream_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return http_upstream_response_time_total(_matched(spark, sf_dir), METRICS)


@query
def message_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_message_count(workload.read_lines(spark, sf_dir))


@query
def request_count_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = metrics_reset(_matched(spark, sf_dir), "event_time", METRICS)
    counts = http_request_total_count(matched, ["epoch"])
    return counts.select(F.unix_seconds("epoch.start").alias("epoch_start"), "service", "value")


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = workload.read_lines(spark, sf_dir)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / workload.REPLAY_SPEED
    narrow = lines.select("path", "namespace", "pod", "container", F.col("event_id").alias("seq"), seconds.alias("arrival"))
    rated = attach_rate(narrow, workload.catalog(spark, sf_dir), check_rules(workload.RULES))
    return throttle_delay(rated, slice_width=1000)


@query
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_samples = metric_samples(
        _matched(spark, sf_dir), _rounded(_replay(spark, sf_dir)), METRICS
    )
    return all_samples.select(sample_text(F.col("metric"), F.col("labels")).alias("sample"), "value")


# Rate rules


@query
def resolved_rates_long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules for each beginning of a customer's number, over orders, some without a namespace."""
    key = F.col("c_custkey").cast("string")
    begins = workload.table(spark, sf_dir, "customer").select(F.substring(key, 1, 3).cast("long").alias("k")).distinct()
    rules = begins.select(
        F.col("k").alias("ord"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("^ns"), F.col("k") % 7, F.lit("$"))).alias("namespace"),
        F.concat(F.lit("^pod-"), F.col("k")).alias("pod"),
        (F.col("k") + 1).cast("double").alias("rate"),
    )
    more = begins.select(
        (F.col("k") + 1000).alias("ord"),
        F.lit(None).cast("string").alias("namespace"),
        F.concat(F.lit("^pod-"), F.col("k")).alias("pod"),
        F.lit(7.0).alias("rate"),
    )
    orders = workload.table(spark, sf_dir, "orders")
    pods = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("ns"), F.col("o_custkey") % 7)).alias("namespace"),
        F.concat(F.lit("pod-"), F.col("o_custkey")).alias("pod"),
    )
    return resolve_rate(pods, check_rules(rules_from_table(rules.unionByName(more)))).select("o_orderkey", "rate")


@query
def request_time_close_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that six digits cannot tell apart."""
    options = MetricOptions(buckets=(0.1234567, 0.1234568, 50.0, 1234567.0, 1234568.0), sum_scale=3)
    found = http_request_time(_matched(spark, sf_dir), options)
    return found.select("method", "service", "path", "le", "value")


@query
def resolved_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pods = workload.requests(spark, sf_dir).select("namespace", "pod").distinct()
    return resolve_rate(pods, check_rules(workload.RULES))


def _rounded(delayed: DataFrame) -> DataFrame:
    return delayed.withColumn("delay", F.round("delay", 3))


@query
def throttle_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    delays = _rounded(_replay(spark, sf_dir))
    return delays.select(F.col("seq").alias("event_id"), "rate", "delay")


@query
def throttling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = workload.catalog(spark, sf_dir).withColumn("running", F.col("namespace") != "ns3")
    return throttling_total(_rounded(_replay(spark, sf_dir)), running, sum_scale=3)


# Delivery and streaming


def _delivered(spark: SparkSession, folder: str) -> DataFrame:
    return published_messages(spark, folder).groupBy("value").agg(F.count("*").alias("n"))


@query
def delivered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, stored = scratch_dir(spark, "delivered"), scratch_dir(spark, "messages")
    # Three deliveries read what is built once.
    record_lines(_enriched(spark, sf_dir)).write.parquet(stored)
    messages, options = spark.read.schema("value string").parquet(stored), DeliveryOptions(batch_size=100)
    deliver_batches(messages, partial(FileSink, folder), "first", options)
    deliver_batches(messages, partial(FileSink, folder), "second", options)
    # The same run again, dealt into other partitions: it replaces what it sent.
    others = max(3, messages.rdd.getNumPartitions() // 2)
    deliver_batches(messages.repartition(others), partial(FileSink, folder), "second", options)
    return _delivered(spark, folder)


@query
def written_to_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "sink")
    register_sink(spark)
    writer = record_lines(_enriched(spark, sf_dir)).write.format("podlens_sink").mode("append")
    writer = writer.option("sink", "podlens.streaming.sinks:FileSink").option("target", folder)
    writer.option("job", "written").save()
    return _delivered(spark, folder)


@query
def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to JSON records in a sink, with the catalog read again at its interval."""
    root = workload.write_segments(spark, sf_dir)
    folder = scratch_dir(spark, "records")
    catalog = RefreshingTable(spark, lambda: _segment_catalog(spark, root), RefreshOptions().containers)
    job = stream_records(stream_log_lines(spark, root), catalog.current, emit_to_sink(partial(FileSink, folder), "streamed"))
    checkpoint = scratch_dir(spark, "checkpoint")
    job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _delivered(spark, folder)


def _segment_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The containers of the segment files, from their names alone."""
    parts = F.split(F.regexp_extract("path", "folder=([^/]*)", 1), "_")
    return list_files(spark, root).select(
        F.regexp_extract("path", "format=([^/]*)", 1).alias("type"),
        parts[2].alias("id"),
        "path",
        parts[0].alias("namespace"),
        parts[1].alias("pod"),
        F.regexp_extract("path", "container=([^/]*)", 1).alias("container"),
    )


@query
def streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live counter of one run over all segments, as its last update of every series."""
    configure_state(spark)
    root = workload.write_segments(spark, sf_dir)
    lines = stream_log_lines(spark, root).withColumn("format", F.regexp_extract("path", "format=([^/]*)", 1))
    matched = stream_indicators(lines, workload.hosts(spark), watermark="60 days", metric_options=METRICS)
    counts = stream_metrics(matched, "http_request_count", METRICS)
    out = scratch_dir(spark, "live")

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("epoch", "method", "service", "path", "status", "value")
        rows.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{out}/data")

    job = counts.writeStream.outputMode("update").foreachBatch(keep)
    job.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.parquet(f"{out}/data")
    series = ["epoch", "method", "service", "path", "status"]
    return (
        updates.groupBy(*series)
        .agg(F.max_by("value", "batch").alias("value"))
        .select(F.unix_seconds("epoch.start").alias("epoch_start"), *series[1:], "value")
    )


@query
def streamed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container lines and journal rows by one stream with two sources, delivered together."""
    root, journal = workload.write_segments(spark, sf_dir), scratch_dir(spark, "journal")
    # Not more files than cores: each micro-batch takes two, whose lines are dealt to tasks again.
    _journal_text(spark, sf_dir).coalesce(spark.sparkContext.defaultParallelism).write.text(journal)
    folder = scratch_dir(spark, "outputs")
    catalog = RefreshingTable(spark, lambda: _segment_catalog(spark, root), RefreshOptions().containers)
    emit = emit_to_sink(partial(FileSink, folder), "outputs")
    rows = spark.readStream.option("maxFilesPerTrigger", 2).text(journal)
    job = stream_records(stream_log_lines(spark, root, max_files=20), catalog.current, emit, journal=rows)
    checkpoint = scratch_dir(spark, "checkpoint")
    job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return _delivered(spark, folder)


# Spans of days: of a micro-batch of the replay, and of a version of the service catalog.
BATCH_DAYS, VERSION_DAYS = 5, 3


def _live(spark: SparkSession, sf_dir: str, load_hosts, running) -> tuple[LiveSamples, int]:
    """Replay the lines as a stream, with catalogs that are read again before every micro-batch.

    ``load_hosts`` and ``running`` get the number of the span of days that a batch lies in.
    """
    folder, now = scratch_dir(spark, "live"), [0]
    history = RefreshingHistory(
        CatalogHistory(spark, f"{folder}/hosts"),
        lambda: load_hosts(now[0]),
        RefreshOptions().services,
        lambda: now[0] * BATCH_DAYS * 86400.0,
    )
    # Every batch asks for the containers several times.
    workload.catalog(spark, sf_dir).write.parquet(f"{folder}/containers")
    containers = spark.read.parquet(f"{folder}/containers")
    rules = check_rules(workload.RULES)
    options = LiveOptions(metrics=METRICS, slice_width=1000, delay_digits=3)
    live = LiveSamples(
        spark,
        f"{folder}/state",
        lambda: containers.withColumn("running", running(now[0])),
        history.current,
        lambda: rules,
        options,
    )
    done = []

    def update(batch: DataFrame, batch_id: int) -> None:
        first = batch.agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp")))).first()[0]
        now[0] = now[0] if first is None else first // (BATCH_DAYS * 86400)
        live.update(batch.drop("ts"), batch_id)
        done.append(batch_id)

    for lines in workload.stream_spans(spark, sf_dir, BATCH_DAYS):
        job = lines.writeStream.foreachBatch(update).option("checkpointLocation", f"{folder}/checkpoint")
        job.trigger(availableNow=True).start().awaitTermination()
    return live, max(done)


@query
def live_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six metrics of a stream of several batches, added up over the reset periods."""
    live, last = _live(spark, sf_dir, lambda _: workload.hosts(spark), lambda _: F.lit(True))
    sums = live.totals(last).groupBy("metric", *ALL_LABELS).agg(
        F.sum(F.col("value").try_cast("decimal(28,3)")).cast("double").alias("value")
    )
    requests = sums.select(sample_text(F.col("metric"), labels_column(ALL_LABELS)).alias("sample"), "value")
    labels = labels_column(("namespace", "pod", "container"))
    waits = live.throttling(last).select(sample_text(F.lit(names.M_THROTTLE), labels).alias("sample"), "value")
    return requests.unionByName(waits)


@query
def live_counts_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counters while owners, path rules and services change between the batches."""
    live, last = _live(spark, sf_dir, lambda span: workload.hosts_at(spark, span), lambda _: F.lit(True))
    counts = live.totals(last).where(F.col("metric") == names.M_REQUESTS)
    return counts.groupBy(F.unix_seconds("epoch.start").alias("epoch_start"), "service", "path").agg(
        F.sum("value").cast("long").alias("value")
    )


@query
def live_throttling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live delays; the containers of a namespace end before the last batch, and their series with them."""
    last_span = workload.buckets(spark, sf_dir, BATCH_DAYS)[-1]
    running = lambda span: (F.col("namespace") != "ns3") | F.lit(span < last_span)
    live, last = _live(spark, sf_dir, lambda _: workload.hosts(spark), running)
    return live.throttling(last)


@query
def requests_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by what the daily versions of the service catalog said when they happened."""
    history = CatalogHistory(spark, scratch_dir(spark, "history"))
    for span in workload.buckets(spark, sf_dir, VERSION_DAYS):
        history.record(workload.hosts_at(spark, span), datetime.fromtimestamp(span * VERSION_DAYS * 86400, timezone.utc))
    requests = extract_sli_from_lines(workload.read_lines(spark, sf_dir).drop("path"))
    matched = indicators_as_of(requests, history.table())
    return matched.select("event_id", "service", "path")


@query
def message_count_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read, with a piece for every 1000 bytes of the long lines."""
    lines = workload.table(spark, sf_dir, "documents").where(F.length("text") > 0).select(
        F.col("source").alias("namespace"), F.col("lang").alias("pod"), F.lit("texts").alias("container"), F.col("text").alias("value")
    )
    return log_message_count(with_reads(lines, SPLIT_BYTES))


@query
def refreshed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts from a refreshed catalog; the second load fails and leaves the first in force."""
    loads = []

    def load() -> DataFrame:
        loads.append(1)
        if len(loads) > 1:
            raise RuntimeError("service list is not available")
        return workload.hosts(spark)

    catalog = RefreshingTable(spark, load, seconds=0, label="services")
    catalog.current()
    return http_request_total_count(indicators(_requests(spark, sf_dir), catalog.current()))
