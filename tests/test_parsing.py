import json

import pytest
from pyspark.sql import functions as F

from podlens.functions.documents import parse_document, parse_object
from podlens.functions.maps import flatten_entries
from podlens.operators.filters import drop_suppressed, strip_reserved
from podlens.operators.output import json_text, to_json_lines
from podlens.operators.parsing import (
    assemble_record,
    parse_cri_lines,
    parse_docker_lines,
    parse_fallback_raw,
    parse_lines,
)
from podlens.options import ParseOptions
from podlens.plans.records import record_lines

TOP = ParseOptions()
SUB = ParseOptions(user_key="log", cri_key="cri")


def records(spark, lines, options=TOP, parse=parse_lines, ext=None):
    df = spark.createDataFrame([(i, v, f) for i, (v, f) in enumerate(lines)], "i int, value string, format string")
    if ext is not None:
        fields = [x for k, v in ext.items() for x in (F.lit(k), F.lit(v).cast("variant"))]
        df = df.withColumn("ext", F.create_map(*fields))
    rows = assemble_record(parse(df, options), options)
    return [json.loads(r[1]) for r in sorted(rows.select("i", json_text(F.col("record"))).collect())]


def docker(*lines):
    return [(line, "docker") for line in lines]


def test_docker_lines(spark):
    lines = docker(
        '{"log":"hello world", "key1":1}',
        '{"somekey":"hello world"}',
        '{log":"hello world"}',
        '{"log": "{\\"hello\\":\\"world\\",\\"a\\": 1,\\"b\\": null}"}',
        '{"log": 1, "a": 2}',
        "null",
        '{"log":"x"} rest',
    )
    assert records(spark, lines) == [
        {"msg": "hello world", "key1": 1},
        {"msg": '{"somekey":"hello world"}'},
        {"msg": '{log":"hello world"}'},
        {"hello": "world", "a": 1, "b": None},
        {"msg": '{"log": 1, "a": 2}'},
        {"msg": "null"},
        {"msg": '{"log":"x"} rest'},
    ]
    df = spark.createDataFrame(list(enumerate(v for v, _ in lines)), "i int, value string")
    errors = [r.parse_error for r in parse_docker_lines(df).orderBy("i").collect()]
    missing, outer = "line has no payload field", "line is not a JSON object"
    assert errors == [None, missing, outer, None, "payload field is not text", missing, outer]


def test_docker_line_keeps_line_end_of_text(spark):
    assert records(spark, docker('{"log":"text\\n"}')) == [{"msg": "text\n"}]


@pytest.mark.parametrize(
    "options, line, expected",
    [
        (
            SUB,
            '{"log": "{\\"hello\\":\\"world\\",\\"a\\": 1,\\"b\\": null}", "a": "else"}',
            {"log": {"hello": "world", "a": 1, "b": None}, "cri": {"a": "else"}},
        ),
        (
            ParseOptions(user_key="user_log", cri_key="docker", flatten=False),
            '{"time":"T","log":"{\\"time\\":{\\"value\\":1.142}}"}',
            {"user_log": {"time": {"value": 1.142}}, "docker": {"time": "T"}},
        ),
        (
            ParseOptions(user_key="user_log", cri_key="docker"),
            '{"time":"T","log":"{\\"time\\":{\\"value\\":1.142}}"}',
            {"user_log": {"time.value": 1.142}, "docker": {"time": "T"}},
        ),
        (
            ParseOptions(cri_key="docker"),
            '{"time":"T","log":"{\\"time\\":{\\"value\\":1.142}}"}',
            {"time.value": 1.142, "docker": {"time": "T"}},
        ),
        (
            ParseOptions(cri_key="docker", flatten=False),
            '{"time":"T","log":"{\\"time\\":{\\"value\\":1.142}}"}',
            {"time": {"value": 1.142}, "docker": {"time": "T"}},
        ),
        (TOP, '{"time":"T","log":"{\\"time\\":1.142,\\"test\\":\\"value\\"}"}', {"time": 1.142, "test": "value"}),
        (SUB, '{"log":"{}"}', {"log": {}}),
        (ParseOptions(user_key="x", cri_key="x"), '{"a":1,"log":"{\\"b\\":2}"}', {"x": {"b": 2}}),
    ],
)
def test_field_groups(spark, options, line, expected):
    assert records(spark, docker(line), options) == [expected]


def test_metadata_group(spark):
    line, ext = '{"a":"cri","log":"{\\"a\\":\\"user\\"}"}', {"a": "ext"}

    def of(**keys):
        return records(spark, docker(line), ParseOptions(**keys), ext=ext)[0]

    assert of() == {"a": "ext"}
    assert of(ext_key="e") == {"a": "user", "e": {"a": "ext"}}
    assert of(user_key="u", ext_key="u") == {"a": "cri", "u": {"a": "ext"}}
    assert of(cri_key="c", ext_key="c") == {"a": "user", "c": {"a": "ext"}}
    # A user field of that name is no group, so it is replaced.
    assert of(cri_key="a", ext_key="a") == {"a": {"a": "ext"}}
    assert of(ext_key="a") == {"a": {"a": "ext"}}


def test_cri_lines(spark):
    lines = [
        (line, "containerd")
        for line in (
            '{"log":"hello world"}',
            'T stdout F {"hello":"world","a": 1,"b": null}',
            "T stdout F my message",
            "T stdout F a stdout F b",
            "T stderr P part",
            " stdout F x",
            "T stdout F ",
        )
    ]
    plain = [
        {"msg": '{"log":"hello world"}'},
        {"hello": "world", "a": 1, "b": None, "stream": "stdout", "time": "T"},
        {"msg": "my message", "stream": "stdout", "time": "T"},
        {"msg": "b", "stream": "stdout", "time": "T stdout F a"},
        {"msg": "part", "stream": "stderr", "time": "T"},
        {"msg": " stdout F x"},
        {"msg": "", "stream": "stdout", "time": "T"},
    ]
    assert records(spark, lines) == plain
    assert records(spark, lines, parse=parse_cri_lines) == plain
    grouped = records(spark, lines[1:2], SUB)
    assert grouped == [{"log": {"hello": "world", "a": 1, "b": None}, "cri": {"stream": "stdout", "time": "T"}}]


def test_fallback(spark):
    lines = spark.createDataFrame([("test",)], "value string")

    def of(options):
        rows = assemble_record(parse_fallback_raw(lines, options), options)
        return json.loads(to_json_lines(rows).first()[0])

    assert of(ParseOptions(user_key="log")) == {"log": {"msg": "test"}}
    assert of(ParseOptions(raw_key="log")) == {"log": "test"}
    assert records(spark, [("test", "other")], ParseOptions(user_key="log", cri_key="c")) == [{"log": {"msg": "test"}}]


def test_payloads_that_are_no_object(spark):
    texts = ["[1]", "1", "null", "", '"a"', '{"a":1', '{"a":1} x', '{"a":1}{"b":2}', "{'a':1}", '{"a":NaN}', '{"a":1},"x":2']
    lines = [(f"T stdout F {text}", "containerd") for text in texts]
    assert [r["msg"] for r in records(spark, lines)] == texts


def test_flatten(spark):
    cases = {
        '{"a":{"b":"c","l":[1,{"x":1}],"n":1.5,"t":true,"z":null},"e":{},"s":"v"}': {
            "a.b": "c", "a.l": [1, {"x": 1}], "a.n": 1.5, "a.t": True, "a.z": None, "s": "v",
        },
        '{"e":{"e":{}}}': {},
        "{}": {},
        # The later field counts where two come to one key.
        '{"a.b":1,"a":{"b":2}}': {"a.b": 2},
        '{"a":{"b":2},"a.b":1}': {"a.b": 1},
        '{"a":{"b":{"c":{"d":1}}},"l":[]}': {"a.b.c.d": 1, "l": []},
        '{"k":1,"k":2}': {"k": 2},
    }
    depth = 40
    deep = '{"k":' * depth + "1" + "}" * depth
    cases[deep] = {".".join(["k"] * depth): 1}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select(
        "t", json_text(flatten_entries(parse_object(F.col("t"))))
    )
    assert {r[0]: json.loads(r[1]) for r in rows.collect()} == cases


def test_large_integers_stay_exact(spark):
    df = spark.createDataFrame([('{"id":9007199254740993,"big":12345678901234567890}',)], "t string")
    text = df.select(json_text(parse_object(F.col("t")))).first()[0]
    assert json.loads(text) == {"id": 9007199254740993, "big": 12345678901234567890}


def test_output_is_sorted_and_not_escaped(spark):
    line = 'T stdout F {"b":"<&>","a":0.010,"c":[1,2]}'
    df = spark.createDataFrame([(line, "containerd")], "value string, format string")
    expected = '{"a":0.01,"b":"<&>","c":[1,2],"stream":"stdout","time":"T"}'
    assert record_lines(df).first()[0] == expected


@pytest.mark.parametrize(
    "given, last, total",
    [
        ('"-"', None, None),
        ('"0"', 0, 0),
        ('"0.009"', 0.009, 0.009),
        ('"0.009,1.142"', 1.142, 1.151),
        ('"0.009, 1.142, 1.222"', 1.222, 2.373),
        ("1.222", 1.222, 1.222),
        ("[1.142, 1.222]", None, None),
        ('{"value": 1.142}', None, None),
        ('"0.1, -"', None, 0.1),
        ('"1d, 0x1p-2"', None, None),
        ('"inf, 1"', 1, 1),
        ('"nan"', None, None),
        ('"1e400"', None, None),
        ('""', None, None),
        ("null", None, None),
    ],
)
def test_upstream_times(spark, given, last, total):
    record = records(spark, [(f'T stdout F {{"upstream_response_time":{given}}}', "containerd")])[0]
    assert record.get("upstream_response_time_float") == last
    assert record.get("upstream_response_time_total") == total
    assert ("upstream_response_time.value" in record) == given.startswith("{")


def _filtered(spark, texts, user_key=""):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", parse_object(F.col("t")).alias("record")
    )
    kept = strip_reserved(drop_suppressed(rows, user_key), user_key)
    return {r[0]: json.loads(r[1]) for r in kept.select("i", json_text(F.col("record"))).collect()}


def test_filter(spark):
    texts = [
        "{}",
        '{"logging":true,"sla":false}',
        '{"logging":false,"sla":true}',
        '{"logging":"false","sla":"x"}',
        '{"logging":null,"a":1}',
    ]
    assert _filtered(spark, texts) == {0: {}, 1: {}, 3: {}, 4: {"a": 1}}
    grouped = ['{"log":"test"}', '{"log":{"logging":false}}', '{"log":{"sla":true,"a":1},"sla":1}', "{}"]
    assert _filtered(spark, grouped, "log") == {0: {"log": "test"}, 2: {"log": {"a": 1}, "sla": 1}, 3: {}}


def test_documents_are_strict(spark):
    texts = ["[1]", "[1] x", "null", "1", "1 2", "{}", '{"a":1}]', "", "[1],2"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r[0]: r[1] for r in rows.select("t", F.schema_of_variant(parse_document(F.col("t")))).collect()}
    assert {t for t, kind in found.items() if kind is not None} == {"[1]", "null", "1", "{}"}


def test_fused_job_equals_steps(spark):
    lines = [
        ('{"time":"T","log":"{\\"logging\\":false}"}', "docker"),
        ('{"time":"T","log":"{\\"logging\\":true,\\"sla\\":true,\\"a\\":{\\"b\\":1}}"}', "docker"),
        ("plain", "docker"),
        ("T stdout F x", "containerd"),
        ("x", "other"),
    ]
    df = spark.createDataFrame(lines, "value string, format string")
    for options in (TOP, SUB, ParseOptions(user_key="log", ext_key="log", flatten=False)):
        steps = to_json_lines(
            strip_reserved(drop_suppressed(assemble_record(parse_lines(df, options), options), options.user_key), options.user_key)
        )
        assert sorted(r[0] for r in steps.collect()) == sorted(r[0] for r in record_lines(df, options).collect())
        # Every line in comes out, but for the suppressed one.
        assert record_lines(df, options).count() == len(lines) - 1
