import json
import random

import pytest
from pyspark.sql import functions as F

from podlens.operators.enrich import enrich_cri_by_path, enrich_with_metadata
from podlens.operators.journal import journal_errors, normalise_journal
from podlens.operators.metrics import container_samples
from podlens.operators.output import json_text
from podlens.operators.rates import rate_column, resolve_rate, throttle_delay, throttling_total
from podlens.options import ParseOptions, RateOptions
from podlens.plans.records import record_lines
from podlens.session import small_side
from podlens.sources.containers import (
    container_catalog_cri,
    container_catalog_docker,
    cri_quarantine,
    filter_catalog,
    list_files,
)
from podlens.sources.journal import scan_journal_export
from podlens.sources.lines import scan_log_lines, split_oversize_lines
from podlens.sources.rules import InvalidRules, RateRule, check_rules, load_rate_rules, reload_rules


def test_scan(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo\rx\nlast")
    rows = scan_log_lines(spark, str(tmp_path)).collect()
    assert sorted(r.value for r in rows) == ["last", "one", "two\rx"]
    assert {r.path for r in rows} == {str(tmp_path / "a.log")}


def test_oversize_lines_are_split_in_the_record_pipeline(spark):
    lines = spark.createDataFrame([("x" * 25,), ("y" * 10,), ("é" * 6,)], "value string")
    lines = lines.withColumns({"format": F.lit("none"), "ext": F.lit(None).cast("map<string,variant>")})
    found = sorted(json.loads(r.value)["msg"] for r in record_lines(lines, ParseOptions(max_line_bytes=10)).collect())
    assert found == sorted(["x" * 10, "x" * 10, "x" * 5, "y" * 10, "é" * 5, "é"])


def test_oversize(spark):
    lines = spark.createDataFrame([(0, "value1value2value3value4"), (1, "value5"), (2, "ä" * 10)], "i int, value string")
    rows = split_oversize_lines(lines, 15).orderBy("i", "chunk").collect()
    # The buffer of the golden case holds 15 bytes and a terminator.
    assert [r.value for r in rows][:3] == ["value1value2val", "ue3value4", "value5"]
    cut = [r.value for r in rows if r.i == 2]
    assert cut == ["ä" * 7 + "�", "�" + "ä" * 2]
    rows = split_oversize_lines(lines.limit(1), 16).orderBy("chunk").collect()
    assert [r.value for r in rows] == ["value1value2valu", "e3value4"]


def test_docker_catalog(spark, tmp_path):
    folder = tmp_path / "123abc"
    folder.mkdir()
    labels = {"io.kubernetes.pod.namespace": "apples", "io.kubernetes.pod.name": "pod1"}
    config = {"ID": "123abc", "State": {"Running": True, "Pid": 1}, "Config": {"Labels": labels, "Env": ["x"]}}
    (folder / "config.v2.json").write_text(json.dumps(config, indent=1))
    (folder / "123abc-json.log").write_text("x")
    (folder / "123abc-json.log.1").write_text("x")
    row = container_catalog_docker(spark, f"{tmp_path}/*/config.v2.json").collect()[0]
    assert (row.id, row.namespace, row.pod, row.container, row.running) == ("123abc", "apples", "pod1", "", True)
    assert row.path == str(folder / "123abc-json.log")
    logs = list_files(spark, str(tmp_path)).where(F.col("path").contains("-json.log"))
    assert container_catalog_docker(spark, f"{tmp_path}/*/config.v2.json", logs).count() == 2


PATHS = [
    "/var/log/pods/ns_pod_id/app/0.log",
    "/var/log/pods/ns_pod_id_more/app/0.log",
    "/var/log/pods/short_name/app/0.log",
    "/var/log/pods/ns_pod_id/agent-x/0.log",
    "/var/log/pods/ns_pod_id/app/0.log.gz",
    "/var/log/pods/0.log",
    "/elsewhere/ns_pod_id/app/0.log",
]


def test_cri_catalog(spark):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    catalog = container_catalog_cri(paths)
    first = {r.path: (r.namespace, r.pod, r.id, r.container, r.running) for r in catalog.collect()}
    assert first[PATHS[0]] == first[PATHS[1]] == ("ns", "pod", "id", "app", True)
    assert {r.path for r in cri_quarantine(paths).collect()} == {PATHS[2], PATHS[5]}
    kept = filter_catalog(catalog, "/var/log/pods/", exclude="agent")
    assert {r.path for r in kept.collect()} == {PATHS[0], PATHS[1]}


def test_enrichment(spark):
    lines = spark.createDataFrame([("x", PATHS[0]), ("y", "/unknown")], "value string, path string")
    catalog = container_catalog_cri(lines.select("path"))
    rows = enrich_with_metadata(lines, catalog).select("value", "format", json_text(F.col("ext")).alias("ext")).collect()
    ext = {r.value: json.loads(r.ext) for r in rows}
    fixed = {
        "dc": "n3", "purpose": "staging", "type": "containers",
        "kubernetes.node_hostname": "localhost", "logstash_prefix": "k8s-unknown",
    }
    own = {
        "docker.container_id": "id", "kubernetes.pod_name": "pod",
        "kubernetes.namespace_name": "ns", "kubernetes.container_name": "app",
    }
    assert ext == {"x": {**fixed, **own}, "y": fixed}
    by_path = enrich_cri_by_path(lines.where("value = 'x'")).select(json_text(F.col("ext"))).first()[0]
    assert json.loads(by_path) == ext["x"]


def test_only_small_sides_are_broadcast(spark):
    big, small = spark.range(100), spark.range(50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def plan(max_rows):
            joined = big.join(small_side(small, max_rows), "id")
            return joined._jdf.queryExecution().executedPlan().toString()

        assert "BroadcastHashJoin" in plan(50)
        assert "BroadcastHashJoin" not in plan(49)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_journal(spark, tmp_path):
    rows = [
        {"__REALTIME_TIMESTAMP": "1515474468380000", "_SYSTEMD_UNIT": "a.service", "MESSAGE": "m", "X": "y"},
        {"time": "1515474468380000", "MESSAGE": "no unit", "PRIORITY": "6"},
        {"time": "never", "MESSAGE": "bad"},
        {"MESSAGE": "none"},
    ]
    (tmp_path / "j.json").write_text("\n".join(json.dumps(r) for r in rows) + "\nbroken\n")
    journal = scan_journal_export(spark, str(tmp_path / "j.json"))
    assert journal.count() == 4

    def records(options):
        texts = normalise_journal(journal, options).select(json_text(F.col("record"))).collect()
        return sorted((json.loads(r[0]) for r in texts), key=lambda r: json.dumps(r, sort_keys=True))

    ext = {
        "dc": "n3", "purpose": "staging", "logstash_prefix": "k8s-unknown",
        "kubernetes.node_hostname": "localhost", "kubernetes.namespace_name": "journald",
    }
    time = "2018-01-09T05:07:48Z"
    assert records(ParseOptions()) == [
        {"MESSAGE": "m", "SYSTEMD_UNIT": "a.service", "time": time, **ext},
        {"MESSAGE": "no unit", "PRIORITY": "6", "SYSTEMD_UNIT": None, "time": time, **ext},
    ]
    grouped = records(ParseOptions(user_key="u", ext_key="e"))
    assert grouped[0] == {"u": {"MESSAGE": "m", "SYSTEMD_UNIT": "a.service"}, "e": ext, "time": time}
    errors = {json.loads(r[0])["MESSAGE"]: r[1] for r in journal_errors(journal).select(json_text(F.col("row")), "error").collect()}
    assert errors == {"bad": "time of the row is not a number", "none": "row has no time"}


def test_rate_files(spark, tmp_path):
    def load(text):
        (tmp_path / "r.yaml").write_text(text)
        return load_rate_rules(spark, str(tmp_path / "r.yaml"))

    assert load("---\n- namespace: namespace\n  pod: pod\n  rate: 1000\n") == [RateRule("namespace", "pod", 1000.0)]
    assert load("rates:\n  - namespace: a\n    rate: 2\n") == [RateRule("a", "", 2.0)]
    with pytest.raises(ValueError):
        load("---\nnamespace: namespace\nrate: 1000\n")


def rates(spark, rules, pods, default=400.0):
    df = spark.createDataFrame(pods, "namespace string, pod string")
    found = resolve_rate(df, check_rules(rules), RateOptions(default))
    return {(r.namespace, r.pod): r.rate for r in found.collect()}


def test_rates(spark):
    rules = [
        RateRule("", "", -1),
        RateRule("late", "", 3),
        RateRule("", "pod", 5),
        RateRule("namespace", "pod", 2),
        RateRule("namespace", "p", 9),
        RateRule("", r"^\w\d$", 7),
    ]
    pods = [("namespace", "pod"), ("0", "pod"), ("late", "x"), ("0", "x"), ("namespace", "xp"), ("0", "a1"), ("0", "1a")]
    expected = {
        ("namespace", "pod"): 2, ("0", "pod"): 5, ("late", "x"): 3, ("0", "x"): 400,
        ("namespace", "xp"): 9, ("0", "a1"): 7, ("0", "1a"): 400,
    }
    assert rates(spark, rules, pods) == expected
    # More rules than are written out as one expression give the same answers.
    filler = [RateRule("", f"^none{i}$", 1) for i in range(600)]
    assert rates(spark, rules + filler, pods) == expected


def test_rule_reload():
    old = [RateRule("a", "", 1.0)]
    assert reload_rules(old, []) == old
    assert reload_rules(old, [RateRule("b", "", 0.0)]) == old
    assert reload_rules(old, [RateRule("[", "", 1.0)]) == old
    assert reload_rules(old, [RateRule("b", "", 2.0)]) == [RateRule("b", "", 2.0)]
    with pytest.raises(InvalidRules):
        check_rules([RateRule("b", "", -2.0)])


def sequential(arrivals, rate):
    """A token bucket, line by line: tokens refill at the rate up to the burst and may go negative."""
    burst, tokens, last, delays = int(rate), float(int(rate)), None, []
    for now in arrivals:
        if last is not None and now > last:
            tokens = min(float(burst), tokens + (now - last) * rate)
            last = now
        elif last is None:
            last = now
        tokens -= 1
        delays.append(max(0.0, -tokens / rate))
    return delays


@pytest.mark.parametrize("slice_width", [1, 7, 1000])
def test_throttling_against_a_sequential_bucket(spark, slice_width):
    rng = random.Random(5)
    rows, expected = [], {}
    for name, rate, n in (("hot", 5.5, 400), ("warm", 3.0, 60), ("cold", 1000.0, 20)):
        now = 1000.0
        arrivals = []
        for _ in range(n):
            now += rng.choice([0.0, 0.0, 0.05, 0.4, 3.0])
            arrivals.append(now)
        # Positions have gaps and do not start at zero.
        seqs = sorted(rng.sample(range(100, 5000), n))
        for seq, arrival, delay in zip(seqs, arrivals, sequential(arrivals, rate)):
            rows.append((f"/{name}.log", name, "p", "c", seq, arrival, rate))
            expected[name, seq] = delay
    df = spark.createDataFrame(rows, "path string, namespace string, pod string, container string, seq long, arrival double, rate double")
    delayed = throttle_delay(df.repartition(5), slice_width=slice_width)
    found = {(r.namespace, r.seq): r.delay for r in delayed.collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-9 for k in expected)
    assert any(d > 0 for d in expected.values())
    running = spark.createDataFrame([("hot", "p", "c", True), ("warm", "p", "c", False)], "namespace string, pod string, container string, running boolean")
    totals = {r.namespace: r.value for r in throttling_total(delayed, running).collect()}
    assert totals.keys() == {"hot"}
    samples = {(r.metric, r.namespace): r.value for r in container_samples(delayed, running=running).collect()}
    lines = {("log_message_count", "hot"): 400, ("log_message_count", "warm"): 60, ("log_message_count", "cold"): 20}
    assert samples == {**lines, ("container_throttling_delay_seconds_total", "hot"): pytest.approx(totals["hot"])}


def test_container_samples_by_period(spark):
    rows = [("n", "p", "c", 1.0, 0), ("n", "p", "c", 2.0, 0), ("n", "p", "c", 4.0, 1)]
    df = spark.createDataFrame(rows, "namespace string, pod string, container string, delay double, epoch int")
    found = {(r.epoch, r.metric): r.value for r in container_samples(df, by=["epoch"]).collect()}
    delay = "container_throttling_delay_seconds_total"
    assert found == {(0, "log_message_count"): 2, (0, delay): 3.0, (1, "log_message_count"): 1, (1, delay): 4.0}


def test_every_file_has_a_bucket_of_its_own(spark):
    rows = [(f"/{name}.log", "n", "p", "c", i, 1.0, 2.0) for name in "ab" for i in range(4)]
    df = spark.createDataFrame(rows, "path string, namespace string, pod string, container string, seq long, arrival double, rate double")
    delayed = throttle_delay(df)
    assert sorted(r.delay for r in delayed.collect()) == [0.0] * 4 + [0.5] * 2 + [1.0] * 2
    assert [r.value for r in throttling_total(delayed).collect()] == [3.0]


def test_rates_below_one_are_refused_at_load(spark):
    old = [RateRule("", "^a$", 5.0)]
    with pytest.raises(InvalidRules, match="at least one line"):
        check_rules([RateRule("", "^slow$", 0.5)])
    assert reload_rules(old, [RateRule("", "^slow$", 0.5)]) == old
    with pytest.raises(ValueError, match="at least one line"):
        rate_column(F.lit("n"), F.lit("p"), [], RateOptions(default_rate=0.5))
    # A rate that comes from elsewhere spoils its own lines only.
    rows = [("/a", 1, 1.0, 0.5), ("/b", 1, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "path string, seq long, arrival double, rate double")
    assert {r.path: r.delay for r in throttle_delay(df).collect()} == {"/a": None, "/b": 0.0}


@pytest.mark.parametrize("n", [0, 1, 499, 500, 501, 2000])
def test_rules_mean_the_same_in_lists_of_any_length(spark, n):
    rules = check_rules([*[RateRule(f"^none{i}$", f"^none{i}$", 2.0) for i in range(n)], RateRule("", "^pod-1$", 7.0)])
    pods = spark.createDataFrame(
        [("ns", "pod-1"), (None, "pod-1"), ("ns", None), (None, None), ("none3", "none3")], "namespace string, pod string"
    )
    found = [r.rate for r in resolve_rate(pods, rules).collect()]
    assert found == [7.0, 7.0, 1000.0, 1000.0, 2.0 if n > 3 else 1000.0]


def test_lines_are_shuffled_once_for_throttling(spark):
    df = spark.range(1000).selectExpr(
        "concat('/n', id % 3) path", "concat('n', id % 3) namespace", "'p' pod", "'c' container", "id seq", "1.0D * id arrival", "2.0D rate"
    )
    delayed = throttle_delay(df)
    delayed.collect()
    plan = delayed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # What is left is a scan of the placed lines, joined with one row for each slice.
    assert "SortMergeJoin" not in plan and plan.count("Window ") == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_row_tries_few_rules_of_a_long_list(spark, monkeypatch):
    """700 rules, some without text: the rates of the plain list, from an expression without a branch for each."""
    import podlens.operators.rates as rates

    rules = [RateRule("^ns1$" if i % 5 == 0 else "", f"^pod-{i}" + "$" * (i < 500), 10.0 + i) for i in range(600)]
    rules += [RateRule(f"team-{i}", "", 2000.0 + i) for i in range(98)]
    rules += [RateRule("", "[0-9]{5}$", 5000.0), RateRule("é{3}", "", 6000.0)]
    names = [("ns1", f"pod-{i}") for i in range(0, 900, 7)] + [(None, f"pod-{i}") for i in range(0, 900, 11)]
    names += [("team-12", None), ("x-team-97", ""), ("ééé", "p"), ("", "po"), (None, None), ("ns2", "x-12345")]
    pods = spark.createDataFrame(names, "namespace string, pod string")
    checked = check_rules(rules)
    found = resolve_rate(pods, checked)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WHEN (") < 20
    rows = sorted(map(repr, found.collect()))
    monkeypatch.setattr(rates, "LITERAL_PATTERNS", len(checked))
    assert rows == sorted(map(repr, resolve_rate(pods, checked).collect()))
    assert len({r.rate for r in found.collect()}) > 100
