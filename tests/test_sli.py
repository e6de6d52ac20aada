import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from podlens import names
from podlens.functions import pieces
from podlens.functions.domains import split_domains
from podlens.functions.regexes import java_pattern, required_literal
from podlens.operators import metrics
from podlens.operators.parsing import assemble_record, parse_lines
from podlens.operators.services import explode_service_domains, usable_services, validate_services
from podlens.operators.sli import (
    extract_sli,
    extract_sli_from_lines,
    indicators,
    label_path,
    match_service,
    prepared_hosts,
)
from podlens.options import MetricOptions, ParseOptions, ServiceOptions, parse_buckets
from podlens.plans import queries
from podlens.sources.rules import InvalidRules, RateRule, check_rules
from podlens.sources.services import ANNOTATED, load_exported_services, load_service_annotations

OPTIONS = ServiceOptions(default_domain="example.test")
GOOD = '{"sla":true,"host":"h","request_method":"GET","request_uri":"/a","status":200,"request_time":1.5}'


def with_fields(**fields):
    return json.dumps({**json.loads(GOOD), **fields})


def without(key):
    return json.dumps({k: v for k, v in json.loads(GOOD).items() if k != key})


REQUESTS = {
    GOOD: (200, 1.5, "", None),
    with_fields(status="200", request_time="10.1"): (200, 10.1, "", None),
    with_fields(status=2e2): (200, 1.5, "", None),
    with_fields(status=2000000): (2000000, 1.5, "", None),
    with_fields(status="+201"): (201, 1.5, "", None),
    with_fields(status=200.5): None,
    with_fields(status="200.0"): None,
    with_fields(status=" 200"): None,
    with_fields(status=None): None,
    with_fields(request_time="1f"): None,
    with_fields(request_time=True): None,
    with_fields(request_time=[1]): None,
    with_fields(sla="true"): None,
    with_fields(sla=False): None,
    with_fields(host=""): None,
    with_fields(host=1): None,
    with_fields(host={"a": 1}): None,
    without("sla"): None,
    without("request_method"): None,
    without("request_uri"): None,
    without("request_time"): None,
    with_fields(upstream_pod_name="p", upstream_response_time="0.020, 0.078"): (200, 1.5, "p", 0.098),
    with_fields(upstream_pod_name=1, upstream_response_time="-"): (200, 1.5, "", None),
    with_fields(upstream_response_time_total=3): (200, 1.5, "", 3.0),
    with_fields(upstream_response_time_total="3"): (200, 1.5, "", None),
    with_fields(upstream_response_time=2.5): (200, 1.5, "", 2.5),
}


def _found(df):
    return {r.i: (r.status, r.request_time, r.pod_name, r.upstream_total) for r in df.collect()}


@pytest.mark.parametrize("options", [ParseOptions(), ParseOptions(user_key="log", cri_key="cri"), ParseOptions(flatten=False)])
def test_extract(spark, options):
    expected = {i: r for i, r in enumerate(REQUESTS.values()) if r is not None}
    lines = spark.createDataFrame(
        [(i, f"2024-01-01T00:00:00.123456789Z stdout F {t}", "containerd") for i, t in enumerate(REQUESTS)],
        "i int, value string, format string",
    )
    records = assemble_record(parse_lines(lines, options), options)
    assert _found(extract_sli(records, options.user_key)) == expected
    direct = extract_sli_from_lines(lines, options)
    assert _found(direct) == expected
    assert {str(r.event_time) for r in direct.collect()} == {"2024-01-01 00:00:00.123456"}


def test_fields_of_the_outer_line_count(spark):
    payload = json.dumps(without("host"))
    nested = json.dumps(with_fields(host={"a": 1}))
    lines = [
        (0, f'{{"log":{payload},"host":"outer"}}'),
        (1, f'{{"log":{nested},"host":"outer"}}'),
        (2, f'{{"log":{json.dumps(GOOD)},"host":"outer"}}'),
        (3, f'{{"log":{payload}}}'),
    ]
    df = spark.createDataFrame(lines, "i int, value string").withColumn("format", F.lit("docker"))
    for options, expected in (
        (ParseOptions(), {0: "outer", 1: "outer", 2: "h"}),
        (ParseOptions(flatten=False), {0: "outer", 2: "h"}),
        (ParseOptions(cri_key="cri"), {2: "h"}),
    ):
        direct = extract_sli_from_lines(df, options)
        records = extract_sli(assemble_record(parse_lines(df, options), options), options.user_key)
        assert {r.i: r.host for r in direct.collect()} == expected
        assert {r.i: r.host for r in records.collect()} == expected


def annotated(spark, *entries):
    return spark.createDataFrame([(i, f"s{i}", e) for i, e in enumerate(entries)], ANNOTATED)


def service(domains="a.b", paths='[{"all":[".*"]}]', enable="true", **more):
    entry = {OPTIONS.enable: enable, OPTIONS.domains: domains, OPTIONS.paths: paths, **more}
    return {k: v for k, v in entry.items() if v is not None}


def test_validate_services(spark):
    older = OPTIONS.deprecated_domains
    cases = [
        (service(), None),
        (service(paths='[{"label1":[".*","abc"]},{"label2":["def"]}]'), None),
        (service(enable=None), "skipped"),
        (service(enable="yes"), "skipped"),
        (service(enable="enable"), None),
        (service(domains=None), "no domains annotation"),
        (service(domains=None, **{older: "x"}), None),
        (service(domains="", **{older: "x"}), "no domains annotation"),
        (service(domains="   "), "no domain names in the domains annotation"),
        (service(domains=" , "), "no domain names in the domains annotation"),
        (service(paths=None), "no paths annotation"),
        (service(paths=" "), "paths annotation is empty"),
        (service(paths="{}"), "paths annotation is not a list of label objects"),
        (service(paths="{"), "paths annotation is not a list of label objects"),
        (service(paths='[{"a":["b"]}] x'), "paths annotation is not a list of label objects"),
        (service(paths='[{"a":["b"],}]'), "paths annotation is not a list of label objects"),
        (service(paths='[{"a":"b"}]'), "paths annotation is not a list of label objects"),
        (service(paths='[{"a":[1]}]'), "paths annotation is not a list of label objects"),
        (service(paths="[]"), "paths annotation holds no labels"),
        (service(paths="null"), "paths annotation holds no labels"),
        (service(paths='[{"":[]}]'), "empty label"),
        (service(paths='[{"label1":[]}]'), "no regexps for a label"),
        (service(paths='[{"label1":null}]'), "no regexps for a label"),
        (service(paths='[{"label1":[""]}]'), "empty regexp"),
        (service(paths='[{"label1":["a"," "]}]'), "empty regexp"),
        (service(paths='[{"label1":["["]}]'), "regexp does not compile"),
        (service(paths='[{"a":["(?=x)"]},{"":["b"]}]'), "regexp does not compile"),
    ]
    rows = validate_services(annotated(spark, *[c[0] for c in cases]), OPTIONS).orderBy("ord").collect()
    assert ["skipped" if r.skipped else r.error for r in rows] == [c[1] for c in cases]
    assert all((r.paths is not None) == (c[1] is None) for r, c in zip(rows, cases))


def test_invalid_services_fail_or_are_left_out(spark):
    checked = validate_services(annotated(spark, service(), service(paths="["), service(enable="no")), OPTIONS)
    assert [r.name for r in usable_services(checked).collect()] == ["s0"]
    with pytest.raises(Exception, match="not a list"):
        usable_services(checked, "fail").collect()


def test_labels_of_one_object_do_not_mix(spark):
    rows = validate_services(annotated(spark, service(paths='[{"b":["2"],"a":["1"]}]')), OPTIONS).first()
    assert [(p.label, p.regexps) for p in rows.paths] == [("a", ["1"]), ("b", ["2"])]


def test_split_domains(spark):
    cases = {"a,b,c": ["a", "b", "c"], "": [], ", a-domain.test ,": ["a-domain.test"], ",,,,,": [], "a, ,b": ["a", "", "b"]}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", split_domains(F.col("t")).alias("d"))
    assert {r.t: r.d for r in rows.collect()} == cases


def hosts(spark, *entries):
    return explode_service_domains(usable_services(validate_services(annotated(spark, *entries), OPTIONS)), "example.test")


def test_hosts(spark):
    found = hosts(spark, service("test.example.org,test"), service("one.org"), service("one.org,two.org"))
    assert {r.host: r.service for r in found.collect()} == {
        "test.example.org": "s0",
        "test": "s0",
        "test.example.test": "s0",
        "one.org": "s2",
        "two.org": "s2",
    }


def test_first_label_in_order(spark):
    paths = '[{"one":["^/a","b$"]},{"two":["/a"]},{"three":["c"]}]'
    catalog = hosts(spark, service("h.test", paths))
    uris = {"/a": "one", "/xb": "one", "/x/a": "two", "/xcx": "three", "/": ""}
    requests = spark.createDataFrame([("h.test", u) for u in uris] + [("H.TEST", "/a")], "host string, uri string")
    literal = indicators(requests, catalog)
    assert {r.uri: r.path for r in literal.collect()} == uris
    by_column = label_path(match_service(requests, catalog))
    assert {r.uri: r.path for r in by_column.collect()} == uris


ACCEPTED = [
    # pattern, texts where it is found, texts where it is not
    (r"^/a.*\?x", ["/ab?x"], ["/b?x", "x/a?x"]),
    ("(?P<n>a)", ["ba"], ["b"]),
    ("(?P<a_b>x)", ["x"], ["y"]),
    ("(?<n1>a)", ["a"], [""]),
    ("[[:alpha:]_]", ["_", "z"], ["1", "é"]),
    ("^[[:^digit:]]$", ["a", "é", "\n"], ["1"]),
    (r"\w\d", ["a1"], ["é1", "aa", "a٣"]),
    (r"a\++", ["a++"], ["aa"]),
    ("^[*+]+$", ["*+"], ["a"]),
    (r"^\pL+\p{Greek}$", ["aω"], ["aa", "ω"]),
    (r"\p{Han}+", ["漢"], ["a"]),
    (r"^\p{^Greek}$", ["a"], ["ω"]),
    (r"^\P{Greek}$", ["a"], ["ω"]),
    (r"^\p{Any}$", ["\n", "a"], [""]),
    (r"^[\P{Any}a]$", ["a"], ["b"]),
    (r"^[^\P{Any}]$", ["a", "\n"], [""]),
    ("(?i)abc", ["xABc"], ["ab"]),
    ("(?i)é", ["É"], ["e"]),
    ("(?i)s", ["ſ"], ["z"]),
    ("/api/{id}", ["/api/{id}"], ["/api/id"]),
    ("^{$", ["{"], [""]),
    ("^a{,5}$", ["a{,5}"], ["aa"]),
    ("^a{2}$", ["aa"], ["a"]),
    ("^a{2,}?b{0,1}$", ["aaab"], ["ab"]),
    (r"^\0$", ["\0"], ["0"]),
    (r"^\012$", ["\n"], ["012"]),
    (r"^\x41\x{1F600}$", ["A😀"], ["A"]),
    (r"^\Qa.b\E+$", ["a.bb"], ["axb", "a.ba.b"]),
    ("^a.b$", ["a\rb", "a\u2028b", "a\u0085b"], ["a\nb"]),
    ("^(?s:a.b)$", ["a\nb"], ["ab"]),
    ("(?s)^a.(?-s:.)$", ["a\nb"], ["ab\n"]),
    ("(?m)a$", ["a\nb", "ba"], ["b", "a\rb"]),
    ("(?m)^b", ["a\nb"], ["a\rb"]),
    ("(?m)^$", ["a\n"], ["a"]),
    ("a$", ["ba"], ["a\n"]),
    (r"a\z", ["ba"], ["a\n"]),
    (r"^a\b", ["a b", "aé"], ["ab"]),
    (r"a\B", ["ab"], ["a b", "aé"]),
    (r"^\s$", ["\f"], ["\v", "\u00a0"]),
    (r"^[^\S]$", [" "], ["a"]),
    ("[[a]", ["x["], ["b"]),
    ("^[a&&b]+$", ["a&b"], ["c"]),
    ("(?U)^a+$", ["aaa"], ["b"]),
    ("(?iU)^a+$", ["AA"], ["b"]),
    (r"^[\d-z]+$", ["1-z"], ["a"]),
    ("^a}+$", ["a}}"], ["a"]),
    ("^[a[]b]$", ["[b]", "ab]"], ["b]"]),
    ("^[]a]+$", ["]a"], ["b"]),
    ("^[^]a]+$", ["bc"], ["b]"]),
    ("^(a|)$", ["a", ""], ["b"]),
    ("a#b c", ["a#b c"], ["ab c"]),
    (r"^\_\-\/$", ["_-/"], ["_"]),
    ("^(?:(?i)a)b$", ["Ab"], ["AB"]),
    ("a(?i)b|c", ["aB", "C"], ["AB"]),
    ("^*a", ["a"], ["b"]),
    ("((a{10}){10}){10}", ["a" * 1000], ["a" * 999]),
]

REFUSED = [
    "[", "a(", "a)", "(?!a)", "(?=a)", "(?<=a)", "(?>a)", "(?#a)", r"(a)\1", r"(?P<n>a)(?P=n)", "a++", "a**", "a{2}*", "a{2}{3}",
    "a{1001}", "a{3,2}", "(a{100}){11}", "*", "|*", "(*)", r"\8", r"\k", r"\Z", r"\G", r"\R", r"\C", r"\e", r"\é", "\\", "[b-a]",
    r"[a-\d]", "[[:foo:]]", "(?P<a>x)(?P<a>y)", "(?P<>x)", "(?<a-b>x)", "(?x)a", "(?-)", "(?i-)a", r"\pX", r"\p{", r"\p{isGreek}",
    r"\x{110000}", r"\x4", "(" * 1001 + ")" * 1001,
]


def test_accepted_patterns_run_and_mean_the_same(spark):
    rows = [(p, java_pattern(p), text, want) for p, yes, no in ACCEPTED for want, texts in ((True, yes), (False, no)) for text in texts]
    assert all(java is not None for _, java, _, _ in rows)
    frame = spark.createDataFrame(rows, "pattern string, java string, text string, want boolean")
    wrong = frame.where(F.rlike("text", F.col("java")) != F.col("want")).collect()
    assert wrong == []


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused_patterns(pattern):
    assert java_pattern(pattern) is None


def test_java_has_the_last_word(spark):
    """A name that no rule of syntax forbids, but that Java does not know."""
    options = [service("a.test", '[{"x":["\\\\p{Nowhere}"]}]'), service("b.test", '[{"x":["\\\\p{Greek}","/{id}","a{,5}"]}]')]
    rows = validate_services(spark.createDataFrame([(i, "s", a) for i, a in enumerate(options)], ANNOTATED), OPTIONS)
    assert [r.error for r in rows.orderBy("ord").collect()] == ["regexp does not compile", None]
    with pytest.raises(InvalidRules):
        check_rules([RateRule(r"\p{Nowhere}", "", 2.0)])
    assert check_rules([RateRule(r"\p{Latin}", "web-{x}", 2.0)])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1{}()[]|*+?^$.,\\-:&éQEpPdwsximU<>=!", max_size=12))
def test_what_is_accepted_java_accepts(spark, pattern):
    java = java_pattern(pattern)
    if java is not None and "script=" not in java:
        spark._jvm.java.util.regex.Pattern.compile(java)


@pytest.mark.parametrize(
    "pattern, literal",
    [
        ("^/buy", "/buy"), ("abc?d", "ab"), ("ab+cd", "ab"), ("a.bcd", "bcd"), ("a|b", ""), ("(abc)de", "de"), ("x(?:a|b)*yz", "yz"),
        ("(?i)abc", ""), ("[abc]de{2}", "de"), ("a{0}bc", "bc"), (r"\Qa.b\E", "a.b"), ("", ""), (r"/é\.x", "/é.x"), (r"\bab\b", "ab"),
    ],
)
def test_required_literals(pattern, literal):
    assert required_literal(java_pattern(pattern)) == literal


def test_many_rules_are_found_by_their_text(spark, monkeypatch):
    """5,000 rules of two services, some without any text: the same labels as the plain search."""
    rng = random.Random(1)
    parts = ["/item", "/user", "/{id}", "[0-9]+", ".*", "é", "(a|b)", "x?", "/v1", "-"]

    def rules(n):
        made = [[f"l{i}", "^" * rng.randrange(2) + "".join(rng.choices(parts, k=3)) + str(rng.randrange(900))] for i in range(n)]
        made += [["short", "q$"], ["none", "[0-9]{9}"], ["folded", "(?i)ZZZ"]]
        return json.dumps([{label: [pattern]} for label, pattern in made], ensure_ascii=False)

    catalog = hosts(spark, service("a.test", rules(4000)), service("b.test", rules(1000)))
    uris = ["".join(rng.choices(["/item", "/user", "/{id}", "12", "7", "é", "a", "b", "x", "/v1", "-", "q", "zzz"], k=6)) for _ in range(400)]
    uris += ["", "/", "é", "123456789"]
    requests = spark.createDataFrame([(h, u) for u in uris for h in ("a.test", "b.test")], "host string, uri string")
    found = indicators(requests, catalog)
    assert "path_index" in prepared_hosts(catalog)[0].columns
    plain = label_path(match_service(requests, catalog))
    key = ["host", "uri", "path"]
    rows = sorted(map(tuple, found.select(*key).collect()))
    assert rows == sorted(map(tuple, plain.select(*key).collect()))
    assert {"", "short", "folded"} < {path for _, _, path in rows} and len({path for _, _, path in rows}) > 8


def test_service_files(spark, tmp_path):
    text = f"""---
- name: A
  {OPTIONS.enable}: enable
  {OPTIONS.deprecated_domains}: testdomain
  {OPTIONS.paths}: '[{{"all": [".*"]}}]'
- {OPTIONS.enable}: true
  {OPTIONS.domains}: api.example.com
"""
    (tmp_path / "services.yaml").write_text(text)
    rows = load_service_annotations(spark, str(tmp_path / "services.yaml")).collect()
    assert [(r.ord, r.name) for r in rows] == [(0, "A"), (1, "")]
    assert rows[1].annotations[OPTIONS.enable] == "true"
    export = {"items": [{"metadata": {"name": "B", "namespace": "n", "annotations": {"k": "v"}}}, {"metadata": {"name": "C"}}]}
    (tmp_path / "export.json").write_text(json.dumps(export, indent=1))
    rows = load_exported_services(spark, str(tmp_path / "export.json")).orderBy("ord").collect()
    assert [(r.ord, r.name, r.annotations) for r in rows] == [(0, "B", {"k": "v"}), (1, "C", {})]


@pytest.mark.parametrize(
    "bound, text",
    [(0.1234567, "0.1234567"), (1234567, "1.234567e+06"), (100000, "100000"), (0.0001, "0.0001"), (0.00001, "1e-05"), (1.5, "1.5"), (2.0, "2")],
)
def test_bucket_labels_read_back_to_their_bound(bound, text):
    assert metrics.bound_text(bound) == text and float(text) == bound


def test_buckets():
    assert parse_buckets(".01 0.03 2") == (0.01, 0.03, 2.0)
    assert len(MetricOptions().buckets) == 28
    for text in (",.01 .03", "1  2", ""):
        with pytest.raises(ValueError):
            parse_buckets(text)


def end_to_end(spark):
    lines = [
        '{"sla":true,"request_method":"POST","request_uri":"/a","status":200,"host":"api.example.com","request_time":0.010,"upstream_response_time":"0.020, 0.078"}',
        '{"sla":true,"request_method":"POST","request_uri":"/b","status":404,"host":"testdomain.example.test","request_time":0.005,"upstream_response_time":"0.005"}',
        '{"sla":true,"request":"GET /a HTTP/1.0","status":503,"host":"api.example.com","request_time":0.000}',
        '{"sla":true,"request_method":"GET","request_uri":"/miss","status":200,"host":"shop.test","request_time":70,"logging":false}',
    ]
    catalog = hosts(
        spark,
        service(None, **{OPTIONS.deprecated_domains: "testdomain"}, enable="enable"),
        service("api.example.com", enable="enable"),
        service("shop.test", '[{"x":["^/x"]}]'),
    )
    df = spark.createDataFrame([(f"2024-01-01T00:00:00Z stdout F {t}", "containerd") for t in lines], "value string, format string")
    return indicators(extract_sli_from_lines(df), catalog)


def test_metrics_end_to_end(spark):
    matched = end_to_end(spark)
    labels = metrics.labels_column(metrics.ALL_LABELS)
    samples = metrics.request_samples(matched, MetricOptions(sum_scale=6)).select(
        metrics.sample_text(F.col("metric"), labels), "value"
    )
    found = {r[0]: r[1] for r in samples.collect()}
    common = 'method="POST",path="all",service='
    assert found[f'http_request_count{{{common}"s1",status="200",upstream_pod_name=""}}'] == 1
    assert found[f'http_request_time_sum{{{common}"s1",upstream_pod_name=""}}'] == 0.01
    assert found[f'http_request_count{{{common}"s0",status="404",upstream_pod_name=""}}'] == 1
    assert found[f'http_request_time_sum{{{common}"s0",upstream_pod_name=""}}'] == 0.005
    assert found[f'http_upstream_response_time_total_sum{{{common}"s1",upstream_pod_name=""}}'] == 0.098
    assert found[f'http_upstream_response_time_total_count{{{common}"s0",upstream_pod_name=""}}'] == 1
    assert found[f'http_request_time_bucket{{le="0.01",{common}"s1",upstream_pod_name=""}}'] == 1
    # A request that matches no path rule only counts in the total, also when it is not delivered.
    assert found['http_request_total_count{service="s2"}'] == 1
    assert not any('service="s2"' in name for name in found if "total_count" not in name)


def test_histogram_properties(spark):
    matched = end_to_end(spark)
    rows = metrics.http_request_time(matched).collect()
    series = {}
    for r in rows:
        series.setdefault((r.method, r.service, r.path), []).append((float(r.le), r.value, r["count"]))
    for buckets in series.values():
        buckets.sort()
        values = [v for _, v, _ in buckets]
        assert values == sorted(values) and values[-1] == buckets[-1][2]
    detailed = metrics.http_request_count(matched).agg(F.sum("value")).first()[0]
    total = metrics.http_request_total_count(matched).agg(F.sum("value")).first()[0]
    assert detailed == 2 and total == 3
    assert names.M_TOTAL == "http_request_total_count"


def test_long_rule_lists_do_not_travel_with_the_rows(spark):
    """A batch meets its rules by a join: each URI is paired with few of them, and no row holds a list."""
    rules = json.dumps([{f"c{i}": [f"^/customer/{i}/"]} for i in range(600)] + [{"all": ["/order/[0-9]*5$"]}, {"short": ["q$"]}])
    catalog = hosts(spark, service("a.test", rules), service("b.test", rules))
    uris = [f"/customer/{i}/order/{i % 20}" for i in range(0, 1200, 7)] + ["q", "/customer/1/q", "", "/customer/3/order/5", None]
    requests = spark.createDataFrame([(i, h, u) for h in ("a.test", "b.test") for i, u in enumerate([*uris, uris[1]])], "id int, host string, uri string")
    found = indicators(requests, catalog)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "path_index" not in plan and "_key" in plan
    plain = label_path(match_service(requests, catalog))
    key = ["id", "host", "uri", "path"]
    rows = sorted(map(repr, found.select(*key).collect()))
    assert rows == sorted(map(repr, plain.select(*key).collect()))
    assert found.columns == plain.columns and len(rows) == 2 * len(uris) + 2


def test_no_row_holds_the_rules_of_all_customers(spark, tmp_path, monkeypatch):
    spark.range(500).selectExpr("nullif(id, 7) c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(900).selectExpr("id o_orderkey", "id o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    catalogs = []

    def kept(requests, *tables):
        catalogs.extend(tables)
        return indicators(requests, *tables)

    monkeypatch.setattr(queries, "indicators", kept)
    found = {r.o_orderkey: r.path for r in queries.REGISTRY["labelled_paths_indexed"](spark, str(tmp_path)).collect()}
    own = {i: f"c{i}" for i in range(500) if i % 7}
    assert found == {i: own.get(i, "all" if i % 10 == 5 else "") for i in range(900)}
    sizes = [row[0] for table in catalogs for row in table.select(F.octet_length(F.to_json(F.struct("*")))).collect()]
    assert max(sizes) < 200


def test_rules_in_a_table_of_their_own(spark):
    """The same labels as lists in the rows of the hosts, also when rules come twice or patterns are NULL."""
    rng = random.Random(2)
    parts = ["/item/", "/user/long/name/", "é", "[0-9]+", "/v1", "(a|b)", "-"]
    made = [[rng.choice(["^", ""]) + "".join(rng.choices(parts, k=3)) + str(rng.randrange(99)) for _ in range(2)] for _ in range(700)]
    made += [["q$", "^/none"], ["[0-9]{3}"], [None], [], *made[:50]]
    uris = ["".join(rng.choices(["/item/", "/user/long/name/", "é", "17", "5", "/v1", "a", "-", "q"], k=7)) for _ in range(300)] + ["", "/v1", None]
    requests = spark.createDataFrame([(h, u) for u in uris for h in ("a", "b", "c", "x")], "host string, uri string")
    for n in (len(made), 40, 0):
        lists = {1: made[:n], 2: made[:n][::-1], 3: []}
        rows = [(key, at, f"l{at}", regexps) for key, rules in lists.items() for at, regexps in enumerate(rules)]
        table = spark.createDataFrame(rows, "paths_key long, at long, label string, regexps array<string>")
        hosts = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", "s", 3)], "host string, service string, paths_key long")
        whole = [(host, "s", [(f"l{at}", regexps) for at, regexps in enumerate(rules)]) for host, rules in zip("abc", lists.values())]
        plain = label_path(match_service(requests, spark.createDataFrame(
            whole, "host string, service string, paths array<struct<label: string, regexps: array<string>>>"
        )))
        found = indicators(requests, hosts, table)
        key = ["host", "uri", "service", "path"]
        assert found.columns == plain.columns
        assert sorted(map(repr, found.select(*key).collect())) == sorted(map(repr, plain.select(*key).collect()))


def test_pieces_that_nothing_lies_under_do_not_pass(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 100)
    texts = ["", "ab", "/customer/12345/", "é/customer/12345/x", "x" * 300, None]
    array = pa.array(["left out", *texts[:-1]])[1:]
    lists = np.array([4, 4, 4, 4, -1], np.int64)

    def keys(array, lists, sizes, own=None):
        return {(row, key) for rows, found in pieces.piece_keys(array, lists, sizes, own) for row, key in zip(rows.tolist(), found.tolist())}

    for n in (*pieces.SIZES, 0):
        found = keys(array, lists, {n})
        raw = [text.encode() for text in texts[:-1]]
        windows = {(row, text[i : i + n]) for row, text in enumerate(raw) for i in range(len(text) - n + 1 if n else 1)}
        assert len(found) == len(windows)
        # Equal pieces of one list have one key, others do not.
        of_list = {(window, int(lists[row])) for row, window in windows}
        assert len({key for _, key in found}) == len(of_list)
    assert keys(array, lists, {0, *pieces.SIZES}, np.array([0, 3, 6, 12, 24])) == (
        keys(array[:1], lists[:1], {0})
        | {(2, key) for _, key in keys(array[2:3], lists[2:3], {6})}
        | {(3, key) for _, key in keys(array[3:4], lists[3:4], {12})}
        | {(4, key) for _, key in keys(array[4:], lists[4:], {24})}
    )
    assert not keys(array[:0], lists[:0], {0, 3})
    some = np.array(sorted({key for _, key in keys(pa.array([f"/customer/{i}/" for i in range(10_000, 15_000)]), np.zeros(5000, np.int64), {12})}), np.uint64)
    table, others = pieces.sieve(some[::2]), some[1::2]
    assert len(some) > 5000 and pieces.passed(some[::2], table).all()
    assert pieces.passed(others, table).mean() < 0.02
    assert pieces.passed(some[:9], pieces.sieve(some[:1])).tolist()[0]
