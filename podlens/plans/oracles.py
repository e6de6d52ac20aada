"""Plain SQL over the same tables with the answer each query must give.

The statements work from the specification of the lines, not from rendered text, so an error in
parsing shows as a difference.
"""

from __future__ import annotations

from podlens.plans.workload import SPEC

MICROS = "CAST(epoch_us(ts) AS BIGINT)"

W = f"""w AS ({SPEC.format(events="events")}),
l AS (SELECT * FROM w WHERE kind <> 'empty'),
u AS (
  SELECT *,
    CASE WHEN event_id % 6 IN (0, 1, 3) THEN
      CASE event_id % 6 WHEN 0 THEN request_time WHEN 1 THEN CAST(0.078 AS DOUBLE) END END AS up_last,
    CASE event_id % 6
      WHEN 0 THEN request_time
      WHEN 3 THEN request_time
      WHEN 1 THEN CAST(CAST(request_time AS DECIMAL(18,3)) + CAST(0.078 AS DECIMAL(18,3)) AS DOUBLE)
    END AS up_total
  FROM l
),
m AS (
  SELECT *,
    CASE host WHEN 'api.example.com' THEN 'api' WHEN 'shop' THEN 'shop' WHEN 'shop.example.test' THEN 'shop'
              WHEN 'img.example.test' THEN 'img' END AS service,
    CASE WHEN request_uri LIKE '%ts=online%' THEN 'online' WHEN request_uri LIKE '/purchase%' THEN 'buy' ELSE '' END AS path
  FROM u WHERE kind = 'json' AND sla
),
s AS (SELECT * FROM m WHERE service IS NOT NULL),
h AS (SELECT * FROM s WHERE path <> '')
"""


def _w(sql: str) -> str:
    return f"WITH {W} {sql}"


_POD_PATHS = """p AS (
  SELECT *, CAST(c_custkey AS VARCHAR) AS k, 'nation' || CAST(c_nationkey AS VARCHAR) AS namespace,
    CASE WHEN c_acctbal < 0 THEN 'broken' || CAST(c_custkey AS VARCHAR)
      ELSE 'nation' || CAST(c_nationkey AS VARCHAR) || '_pod-' || CAST(c_custkey AS VARCHAR) || '_id' || CAST(c_custkey AS VARCHAR) END AS folder,
    lower(c_mktsegment) AS container,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '0.log.gz' ELSE '0.log' END AS file
  FROM customer),
q AS (SELECT *, '/var/log/pods/' || folder || '/' || container || '/' || file AS path FROM p)"""

_JOURNAL = f"""j AS (
  SELECT *, {MICROS} AS micros,
    CASE WHEN event_type <> 'click' THEN event_type || '.service' END AS unit
  FROM events)"""

_JOURNAL_JSON = """
SELECT '{"MESSAGE":"' || replace(props, '"', '\\"') || '","PRIORITY":"6","SYSLOG_PID":"' || CAST(event_id AS VARCHAR)
  || '","SYSTEMD_UNIT":' || CASE WHEN unit IS NULL THEN 'null' ELSE '"' || unit || '"' END
  || ',"dc":"n3","kubernetes.namespace_name":"journald","kubernetes.node_hostname":"localhost"'
  || ',"logstash_prefix":"k8s-unknown","purpose":"staging","time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"}' AS value
FROM j WHERE event_type <> 'error'"""

# The balance decides what is wrong with the service of a customer.
_SERVICES = """f AS (
  SELECT *, ((CAST(floor(c_acctbal) AS BIGINT) % 16) + 16) % 16 AS fault FROM customer),
v AS (
  SELECT *, c_mktsegment = 'MACHINERY' AS skipped,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL
      WHEN fault = 11 THEN 'no domains annotation'
      WHEN fault = 10 THEN 'no domain names in the domains annotation'
      WHEN fault = 12 THEN 'no paths annotation'
      WHEN fault = 0 THEN 'paths annotation is empty'
      WHEN fault IN (1, 2, 8, 9) THEN 'paths annotation is not a list of label objects'
      WHEN fault = 3 THEN 'paths annotation holds no labels'
      WHEN fault = 4 THEN 'empty label'
      WHEN fault = 5 THEN 'no regexps for a label'
      WHEN fault = 6 THEN 'empty regexp'
      WHEN fault = 7 THEN 'regexp does not compile' END AS error
  FROM f),
x AS (SELECT *, error IS NULL AND NOT skipped AS usable FROM v)"""

_PARSED = f"""
SELECT event_id,
  CASE WHEN kind = 'json' THEN NULL
    WHEN format = 'docker' THEN 'line is not a JSON object'
    WHEN kind = 'plain' THEN 'line does not have the CRI shape' END AS parse_error,
  kind <> 'json' AS is_raw,
  CASE WHEN kind = 'json' THEN host END AS host,
  CASE WHEN kind = 'json' THEN user_id END AS client_id,
  CASE WHEN kind = 'json' THEN up_last END AS upstream_last,
  CASE WHEN kind = 'json' THEN up_total END AS upstream_total,
  CAST(CASE WHEN kind <> 'json' THEN 1 ELSE 9 + CASE WHEN logging IS NULL THEN 0 ELSE 1 END
    + CASE WHEN upstream_response_time IS NULL THEN 0 ELSE 1 END
    + CASE WHEN up_last IS NULL THEN 0 ELSE 1 END + CASE WHEN up_total IS NULL THEN 0 ELSE 1 END END AS INTEGER) AS n_user,
  CAST(CASE WHEN kind = 'json' OR (kind = 'truncated' AND format = 'containerd') THEN 2 ELSE 0 END AS INTEGER) AS n_cri,
  CASE WHEN kind = 'json' OR (kind = 'truncated' AND format = 'containerd') THEN {MICROS} END AS event_micros
FROM u"""

_EXT = """'{"dc":"n3","docker.container_id":"' || id || '","kubernetes.container_name":"' || container
  || '","kubernetes.namespace_name":"' || namespace || '","kubernetes.node_hostname":"localhost","kubernetes.pod_name":"'
  || pod || '","logstash_prefix":"k8s-unknown","purpose":"staging","type":"containers"}'"""

_NUMBER = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"

# The line as it is rendered, for the records that hold it as it came.
_TIME = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
_PAYLOAD = """'{"host":"' || host || '","request_method":"' || request_method || '","request_uri":"' || request_uri
  || '","status":' || CAST(status AS VARCHAR) || ',"request_time":' || CAST(request_time AS VARCHAR)
  || CASE WHEN upstream_response_time IS NULL THEN '' ELSE ',"upstream_response_time":"' || upstream_response_time || '"' END
  || ',"sla":' || CAST(sla AS VARCHAR) || CASE WHEN logging IS NULL THEN '' ELSE ',"logging":' || CAST(logging AS VARCHAR) END
  || ',"client":{"id":' || CAST(user_id AS VARCHAR) || ',"kind":"' || event_type || '","tags":["' || event_type || '","'
  || format || '"]}}'"""


def _escaped(text: str) -> str:
    return f"""replace(replace({text}, '\\', '\\\\'), '"', '\\"')"""


_DOCKER_LINE = f"""'{{"log":"' || {_escaped(_PAYLOAD)} || '\\n","stream":"stdout","time":"' || {_TIME} || '"}}'"""
_CONTENT = f"""CASE WHEN kind = 'plain' THEN 'event ' || CAST(event_id AS VARCHAR)
  WHEN format = 'docker' THEN left({_DOCKER_LINE}, length({_DOCKER_LINE}) - 4)
  ELSE left({_PAYLOAD}, length({_PAYLOAD}) - 4) END"""
_LINE = f"""CASE WHEN kind = 'plain' THEN 'event ' || CAST(event_id AS VARCHAR) ELSE
  left({{0}}, length({{0}}) - CASE WHEN kind = 'truncated' THEN 4 ELSE 0 END) END""".replace(
    "{0}", f"CASE WHEN format = 'docker' THEN {_DOCKER_LINE} ELSE {_TIME} || ' stdout F ' || {_PAYLOAD} END"
)
# All lines of a folder, in any order: the sum of the first 32 bits of their digests.
_SEGMENTS = _w(f"""
SELECT namespace || '_' || pod || '_' || id AS folder, format, count(*) AS n_lines,
  count(*) FILTER (WHERE kind = 'plain') AS n_plain,
  count(*) FILTER (WHERE kind = 'json') AS n_whole,
  CAST(sum(CAST('0x' || left(md5({_LINE}), 8) AS BIGINT)) AS BIGINT) AS digest
FROM l GROUP BY 1, 2""")
_RAW_RECORD = f"""'{{"dc":"n3","docker.container_id":"' || id || '","kubernetes.container_name":"' || container
  || '","kubernetes.namespace_name":"' || namespace || '","kubernetes.node_hostname":"localhost","kubernetes.pod_name":"' || pod
  || '","logstash_prefix":"k8s-unknown","msg":"' || {_escaped(_CONTENT)} || '","purpose":"staging"'
  || CASE WHEN kind = 'truncated' AND format = 'containerd' THEN ',"stream":"stdout","time":"' || {_TIME} || '"' ELSE '' END
  || ',"type":"containers"}}'"""

_RECORD = f"""
SELECT CASE WHEN kind <> 'json' THEN {_RAW_RECORD} ELSE
  '{{"client.id":' || CAST(user_id AS VARCHAR) || ',"client.kind":"' || event_type
  || '","client.tags":["' || event_type || '","' || format || '"],"dc":"n3","docker.container_id":"' || id
  || '","host":"' || host || '","kubernetes.container_name":"' || container
  || '","kubernetes.namespace_name":"' || namespace || '","kubernetes.node_hostname":"localhost","kubernetes.pod_name":"' || pod
  || '","logstash_prefix":"k8s-unknown","purpose":"staging","request_method":"' || request_method
  || '","request_time":' || {_NUMBER.format("request_time")} || ',"request_uri":"' || request_uri
  || '","status":' || CAST(status AS VARCHAR) || ',"stream":"stdout","time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
  || '","type":"containers"'
  || CASE WHEN upstream_response_time IS NULL THEN '' ELSE ',"upstream_response_time":"' || upstream_response_time || '"' END
  || CASE WHEN up_last IS NULL THEN '' ELSE ',"upstream_response_time_float":' || CAST(up_last AS VARCHAR) END
  || CASE WHEN up_total IS NULL THEN '' ELSE ',"upstream_response_time_total":' || CAST(up_total AS VARCHAR) END
  || '}}' END AS value
FROM u WHERE kind <> 'json' OR logging IS NULL OR logging"""

_DELIVERED = _w(f"SELECT value, count(*) AS n FROM ({_RECORD}) GROUP BY value")
_DELIVERED_TWICE = _w(f"SELECT value, 2 * count(*) AS n FROM ({_RECORD}) GROUP BY value")

_SLI = _w("""
SELECT event_id, host, '' AS pod_name, request_method AS method, request_uri AS uri,
  CAST(status AS BIGINT) AS status, request_time, up_total AS upstream_total FROM m""")

_LABELLED = _w("SELECT event_id, service, path FROM s")

_REQUEST_COUNT = """
SELECT request_method AS method, service, path, CAST(status AS VARCHAR) AS status, '' AS upstream_pod_name,
  count(*) AS value FROM h GROUP BY ALL"""

# Bounds with their labels, written out.
_BUCKETS = (
    (0.01, "0.01"), (0.02, "0.02"), (0.04, "0.04"), (0.06, "0.06"), (0.08, "0.08"), (0.1, "0.1"), (0.15,
    "0.15"), (0.2, "0.2"), (0.25, "0.25"), (0.3, "0.3"), (0.4, "0.4"), (0.5, "0.5"), (0.6, "0.6"), (0.7,
    "0.7"), (0.8, "0.8"), (0.9, "0.9"), (1.0, "1"), (1.2, "1.2"), (1.5, "1.5"), (1.75, "1.75"), (2.0, "2"),
    (3.0, "3"), (4.0, "4"), (5.0, "5"), (8.0, "8"), (10.0, "10"), (20.0, "20"), (60.0, "60"),
)
_CLOSE_BUCKETS = (
    (0.1234567, "0.1234567"), (0.1234568, "0.1234568"), (50.0, "50"), (1234567.0, "1.234567e+06"), (1234568.0, "1.234568e+06"),
)


def _histogram(value: str, buckets=_BUCKETS) -> str:
    """Cumulative buckets by label set, over the rows that have the value."""
    rows = f"SELECT request_method AS method, service, path, {value} AS v FROM h WHERE {value} IS NOT NULL"
    counts = ", ".join(f"count(*) FILTER (WHERE v <= {b!r}) AS b{i}" for i, (b, _) in enumerate(buckets))
    grouped = f"""
SELECT method, service, path, CAST(sum(CAST(v AS DECIMAL(18,3))) AS DOUBLE) AS "sum", count(*) AS "count", {counts}
FROM ({rows}) GROUP BY method, service, path"""
    parts = [(f"b{i}", le) for i, (_, le) in enumerate(buckets)] + [('"count"', "+Inf")]
    head = """method, service, path, '' AS upstream_pod_name, "sum", "count\""""
    union = " UNION ALL ".join(f"SELECT {head}, '{le}' AS le, {column} AS value FROM g" for column, le in parts)
    return f"WITH g AS ({grouped}) {union}"


_RATE = """CASE WHEN regexp_matches(namespace, 'ns0') AND regexp_matches(pod, 'pod-0') THEN 2.0
  WHEN regexp_matches(pod, 'pod-1') THEN 5.0 WHEN regexp_matches(namespace, 'ns.*') THEN 10.0 ELSE 1000.0 END"""

# A Docker file is named by the id of its container alone, which goes with the pod here.
_FILE = "format, CASE WHEN format = 'docker' THEN id ELSE namespace || '_' || pod || '_' || container END"

_REPLAY = f"""a AS (
  SELECT event_id, format, namespace, pod, container, CAST({_RATE} AS DOUBLE) AS rate,
    {MICROS} / 1e6 / 10000 AS arrival,
    CAST(row_number() OVER (PARTITION BY {_FILE} ORDER BY event_id) AS DOUBLE) AS n
  FROM l),
t AS (
  SELECT *, max(arrival - (n - 1) / rate) OVER (PARTITION BY {_FILE.replace("id", "pod")} ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lead_time FROM a),
d AS (
  SELECT event_id, namespace, pod, container, rate,
    round(greatest(0.0, (n - floor(rate)) / rate + lead_time - arrival), 3) AS delay FROM t)"""

_CONTAINER = """'{{container="' || container || '",namespace="' || namespace || '",pod="' || pod || '"}}'"""


def _request_sample(metric: str, value: str, extra: str = "", le: str = "") -> str:
    """Text of a sample with the request labels in sorted order."""
    le_part = f"""'le="{le}",' || """ if le else ""
    return f"""SELECT '{metric}{{' || {le_part}'method="' || method || '",path="' || path || '",service="' || service
  || '",{extra}upstream_pod_name=""}}' AS sample, CAST({value} AS DOUBLE) AS value"""


def _histogram_samples(metric: str, value: str) -> str:
    source = f"({_histogram(value)})"
    parts = [
        f"{_request_sample(metric + '_bucket', 'value', le='LE')} FROM {source}".replace(
            """'le="LE",'""", """'le="' || le || '",'"""
        )
    ]
    for suffix, column in (("_sum", '"sum"'), ("_count", '"count"')):
        parts.append(f"{_request_sample(metric + suffix, column)} FROM {source} WHERE le = '+Inf'")
    return " UNION ALL ".join(parts)


_SAMPLES = " UNION ALL ".join(
    [
        """SELECT 'http_request_count{method="' || method || '",path="' || path || '",service="' || service
  || '",status="' || status || '",upstream_pod_name=""}' AS sample, CAST(value AS DOUBLE) AS value FROM ("""
        + _REQUEST_COUNT
        + ")",
        """SELECT 'http_request_total_count{service="' || service || '"}' AS sample, CAST(count(*) AS DOUBLE) AS value
FROM s GROUP BY service""",
        _histogram_samples("http_request_time", "request_time"),
        _histogram_samples("http_upstream_response_time_total", "up_total"),
        f"""SELECT 'log_message_count' || {_CONTAINER.format()} AS sample, CAST(count(*) AS DOUBLE) AS value
FROM l GROUP BY namespace, pod, container""",
        f"""SELECT 'container_throttling_delay_seconds_total' || {_CONTAINER.format()} AS sample,
  CAST(sum(CAST(delay AS DECIMAL(28,3))) AS DOUBLE) AS value FROM d GROUP BY namespace, pod, container""",
    ]
)



def _versions(days: int) -> str:
    """What each version of the host catalog says about every host, with the time it was in force."""
    seconds = days * 86400
    return f"""n AS (
  SELECT unnest(range(CAST(floor(min(epoch(ts)) / {seconds}) AS BIGINT), CAST(floor(max(epoch(ts)) / {seconds}) AS BIGINT) + 1)) AS v
  FROM events),
r AS (
  SELECT v, host,
    CASE host WHEN 'api.example.com' THEN 'api' WHEN 'img.example.test' THEN 'img'
      ELSE CASE WHEN v % 2 = 0 THEN 'shop' ELSE 'store' END END AS owner,
    CASE WHEN v % 3 = 1 THEN '/signup' ELSE '/purchase' END AS bought,
    CASE WHEN v = min(v) OVER () THEN TIMESTAMP '1970-01-01' ELSE make_timestamp(v * {seconds} * 1000000) END AS valid_from,
    make_timestamp((v + 1) * {seconds} * 1000000) AS valid_to
  FROM n, (VALUES ('api.example.com'), ('shop'), ('shop.example.test'), ('img.example.test')) g(host)
  WHERE host <> 'img.example.test' OR v % 4 <> 3),
t AS (
  SELECT event_id, ts, r.owner AS service,
    CASE WHEN request_uri LIKE '%ts=online%' THEN 'online' WHEN starts_with(request_uri, bought) THEN 'buy' ELSE '' END AS path
  FROM u JOIN r ON u.host = r.host AND ts >= valid_from AND ts < valid_to
  WHERE kind = 'json' AND sla)"""


ORACLES: dict[str, str] = {
    "scan_lines": _SEGMENTS,
    "stream_lines": _SEGMENTS,
    "tail_lines": _SEGMENTS,
    "tail_growing_lines": _SEGMENTS,
    "split_oversize": """
WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS n, octet_length(encode(text)) = length(text) AS ascii
           FROM documents WHERE length(text) > 0),
c AS (SELECT *, unnest(range(0, CAST(ceil(n / 1000.0) AS BIGINT))) AS chunk FROM d)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk,
  CASE WHEN ascii THEN md5(substr(text, CAST(chunk * 1000 + 1 AS BIGINT), 1000)) END AS ascii_md5 FROM c""",
    "catalog_docker": """
SELECT 'docker' AS type, 'id' || CAST(s_suppkey AS VARCHAR) AS id, 'id' || CAST(s_suppkey AS VARCHAR) || '-json.log' AS file,
  s_acctbal >= 0 AS running, 'nation' || CAST(s_nationkey AS VARCHAR) AS namespace, s_name AS pod,
  CASE WHEN s_acctbal >= 5000 THEN 'big' ELSE '' END AS container FROM supplier""",
    "catalog_cri": f"""WITH {_POD_PATHS}
SELECT 'containerd' AS type, 'id' || k AS id, path, true AS running, namespace, 'pod-' || k AS pod, container
FROM q WHERE c_acctbal >= 0""",
    "catalog_cri_quarantine": f"""WITH {_POD_PATHS}
SELECT path, 'folder is not namespace_pod_id' AS reason FROM q WHERE c_acctbal < 0""",
    "catalog_filter": f"""WITH {_POD_PATHS}
SELECT path FROM q WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' AND c_mktsegment <> 'HOUSEHOLD'""",
    "inventory_diff": """
WITH c AS (SELECT '/logs/' || CAST(c_custkey AS VARCHAR) AS path, c_acctbal >= 5000 AS running FROM customer WHERE c_acctbal >= 1000),
k AS (SELECT DISTINCT '/logs/' || CAST(o_custkey AS VARCHAR) AS path FROM orders WHERE o_totalprice > 400000),
f AS (SELECT DISTINCT '/logs/' || CAST(o_custkey AS VARCHAR) AS path FROM orders WHERE o_orderpriority = '1-URGENT'),
i AS (SELECT '/logs/' || CAST(c_custkey AS VARCHAR) AS path FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT path, 'orphan' AS change FROM k WHERE path NOT IN (SELECT path FROM c)
UNION ALL SELECT path, 'new' FROM c WHERE path NOT IN (SELECT path FROM f) AND path NOT IN (SELECT path FROM i)
UNION ALL SELECT path, 'finished' FROM c WHERE NOT running AND path IN (SELECT path FROM f)
UNION ALL SELECT path, 'unignored' FROM i WHERE path NOT IN (SELECT path FROM c)""",
    "journal_export": f"""WITH {_JOURNAL}
SELECT CAST(event_id AS VARCHAR) AS pid, CASE WHEN event_type = 'error' THEN 'never' ELSE CAST(micros AS VARCHAR) END AS time,
  unit, props AS message, CAST(CASE WHEN unit IS NULL THEN 5 ELSE 6 END AS INTEGER) AS n_fields FROM j""",
    "journal_records": f"WITH {_JOURNAL} {_JOURNAL_JSON}",
    "rate_rules_file": """
SELECT c_custkey, CAST(c_nationkey + 1 AS DOUBLE) AS rate FROM customer""",
    "service_annotations_export": f"""WITH {_SERVICES}, t AS (
  SELECT *, CASE fault WHEN 0 THEN '' WHEN 1 THEN '{{}}' WHEN 2 THEN '{{' WHEN 3 THEN '[]' WHEN 4 THEN '[{{"":[]}}]'
    WHEN 5 THEN '[{{"l":[]}}]' WHEN 6 THEN '[{{"l":[""]}}]' WHEN 7 THEN '[{{"l":["["]}}]' WHEN 8 THEN '[{{"l":[1]}}]'
    WHEN 9 THEN '[{{"l":["a"]}},]' ELSE '[{{"all":[".*","abc"]}},{{"b":["def"]}}]' END AS paths,
    CASE fault WHEN 10 THEN ' , ' WHEN 11 THEN '' ELSE ', h' || CAST(c_custkey AS VARCHAR) || ' ,n'
      || CAST(c_nationkey AS VARCHAR) || '.test,' END AS domains,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'enable' WHEN 'MACHINERY' THEN 'no' ELSE 'true' END AS enable FROM x)
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS ord, c_name AS name, md5(array_to_string(list_sort(list_filter([
    'podlens.sla/enable=' || enable,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'router.deis.io/domains' ELSE 'podlens.sla/domains' END || '=' || domains,
    CASE WHEN fault <> 12 THEN 'podlens.sla/paths=' || paths END], lambda e: e IS NOT NULL)), chr(10))) AS annotations_md5
FROM t""",
    "service_annotations_file": """
SELECT c_custkey, n_name AS service FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "docker_lines": _w(f"SELECT * FROM ({_PARSED}) WHERE event_id IN (SELECT event_id FROM l WHERE format = 'docker')"),
    "cri_lines": _w(f"SELECT * FROM ({_PARSED}) WHERE event_id IN (SELECT event_id FROM l WHERE format = 'containerd')"),
    "all_lines": _w(_PARSED),
    "user_payload": """
SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL AS raw_md5 FROM events
UNION ALL SELECT -1 - doc_id, NULL, md5(text) FROM documents""",
    "flattened": """
SELECT event_id, '{"a.b.k":' || json_extract_string(props, '$.k') || ',"a.d.x.y.z":null,"l":[{"x":8}],"t":"' || event_type || '"}' AS flat
FROM events""",
    "assembled": _w("""
SELECT event_id, CASE WHEN kind = 'json' THEN host END AS host, CASE WHEN kind = 'json' THEN event_type END AS kind,
  CASE WHEN kind = 'json' OR (kind = 'truncated' AND format = 'containerd') THEN 'stdout' END AS stream,
  pod, CAST(NULL AS VARCHAR) AS top_host FROM l"""),
    "fallback_raw": "SELECT doc_id, md5(text) AS raw_md5, 1 AS n_user FROM documents",
    "upstream_times": _w("""
SELECT event_id, up_last AS last, up_total AS total FROM u
UNION ALL SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN request_time WHEN 1 THEN CAST(0.078 AS DOUBLE) END,
  CASE event_id % 6 WHEN 0 THEN request_time WHEN 3 THEN request_time
    WHEN 1 THEN CAST(CAST(request_time AS DECIMAL(18,3)) + CAST(0.078 AS DECIMAL(18,3)) AS DOUBLE) END
FROM w WHERE kind = 'empty'"""),
    "extended_maps": """
SELECT event_id, '{"a":"' || event_type || '","b":' || CAST(event_id AS VARCHAR) || ',"c":"x"}' AS merged FROM events""",
    "projected_keys": """
SELECT event_id, '{"b":' || CAST(user_id AS VARCHAR) || '}' AS kept FROM events""",
    "label_accessors": """
SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE 'ns' END AS namespace,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS pod, '' AS container FROM events""",
    "enriched": _w(f"SELECT event_id, format, {_EXT} AS ext FROM l"),
    "enriched_by_path": _w(f"SELECT event_id, format, {_EXT} AS ext FROM l WHERE format = 'containerd'"),
    "kept_records": _w("SELECT event_id FROM l WHERE kind <> 'json' OR logging IS NULL OR logging"),
    "kept_records_grouped": _w("SELECT event_id FROM l WHERE kind <> 'json' OR logging IS NULL OR logging"),
    "stripped_records": _w(f"""
SELECT p.event_id, CAST(n_user + n_cri + 9 - CASE WHEN kind = 'json' THEN 1 + CASE WHEN logging IS NULL THEN 0 ELSE 1 END ELSE 0 END AS INTEGER) AS n_fields,
  false AS has_reserved FROM ({_PARSED}) p JOIN u ON p.event_id = u.event_id"""),
    "json_records": _w(_RECORD),
    "json_records_fused": _w(_RECORD),
    "united_outputs": f"WITH {_JOURNAL}, {W} {_RECORD} UNION ALL {_JOURNAL_JSON}",
    "sli_from_records": _SLI,
    "sli_from_lines": _SLI,
    "validated_services": f"""WITH {_SERVICES}
SELECT c_custkey AS ord, skipped, error,
  CASE WHEN usable THEN 'h' || CAST(c_custkey AS VARCHAR) || '|n' || CAST(c_nationkey AS VARCHAR) || '.test' END AS domains,
  CAST(CASE WHEN usable THEN 2 END AS INTEGER) AS n_paths FROM x""",
    "split_domain_lists": """
SELECT c_custkey, c_name || '||' || c_mktsegment AS domains FROM customer""",
    "service_hosts": f"""WITH {_SERVICES},
g AS (SELECT c_custkey, c_name, unnest(['h' || CAST(c_custkey AS VARCHAR), 'h' || CAST(c_custkey AS VARCHAR) || '.cluster.test',
        'n' || CAST(c_nationkey AS VARCHAR) || '.test']) AS host FROM x WHERE usable)
SELECT host, arg_max(c_name, c_custkey) AS service FROM g GROUP BY host""",
    "matched_services": _w("SELECT event_id, service FROM s"),
    "labelled_paths": _LABELLED,
    "labelled_paths_by_column": _LABELLED,
    "labelled_paths_indexed": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND c_custkey IS NOT NULL THEN 'c' || CAST(o_custkey AS VARCHAR)
  WHEN o_orderkey % 10 = 5 THEN 'all' ELSE '' END AS path
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "request_count": _w(_REQUEST_COUNT),
    "request_total_count": _w("SELECT service, count(*) AS value FROM s GROUP BY service"),
    "request_time": _w(f"SELECT * FROM ({_histogram('request_time')})"),
    "upstream_time": _w(f"SELECT * FROM ({_histogram('up_total')})"),
    "message_count": _w("SELECT namespace, pod, container, count(*) AS value FROM l GROUP BY ALL"),
    "request_count_by_epoch": _w(f"""
SELECT CAST(floor({MICROS} / 172800000000) * 172800 AS BIGINT) AS epoch_start, service, count(*) AS value FROM s GROUP BY 1, 2"""),
    "samples": f"WITH {W}, {_REPLAY} {_SAMPLES}",
    "resolved_rates_long_list": """
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 7 END AS ns FROM orders),
p AS (SELECT DISTINCT CAST(left(CAST(c_custkey AS VARCHAR), 3) AS BIGINT) AS k FROM customer),
-- A rule finds all pods whose number starts with its own; the first in the list counts, those with a namespace before the others.
q AS (SELECT o_orderkey, min(k) FILTER (WHERE k % 2 = 0 AND ns = k % 7) AS pair, min(k) FILTER (WHERE k % 2 = 1) AS own, count(*) AS n
  FROM o JOIN p ON starts_with(CAST(o_custkey AS VARCHAR), CAST(k AS VARCHAR)) GROUP BY o_orderkey)
SELECT o.o_orderkey, CAST(coalesce(pair + 1, own + 1, CASE WHEN n > 0 THEN 7 END, 1000) AS DOUBLE) AS rate
FROM o LEFT JOIN q USING (o_orderkey)""",
    "request_time_close_buckets": _w(
        f"SELECT method, service, path, le, value FROM ({_histogram('request_time', _CLOSE_BUCKETS)})"
    ),
    "resolved_rates": _w(f"SELECT DISTINCT namespace, pod, CAST({_RATE} AS DOUBLE) AS rate FROM w"),
    "throttle_delays": f"WITH {W}, {_REPLAY} SELECT event_id, rate, delay FROM d",
    "throttling_totals": f"""WITH {W}, {_REPLAY}
SELECT namespace, pod, container, CAST(sum(CAST(delay AS DECIMAL(28,3))) AS DOUBLE) AS value
FROM d WHERE namespace <> 'ns3' GROUP BY namespace, pod, container""",
    "delivered_batches": _DELIVERED_TWICE,
    "written_to_sink": _DELIVERED,
    "streamed_records": _DELIVERED,
    "streamed_metrics": _w(f"""
SELECT CAST(floor({MICROS} / 172800000000) * 172800 AS BIGINT) AS epoch_start, request_method AS method, service, path,
  CAST(status AS VARCHAR) AS status, count(*) AS value FROM h GROUP BY ALL"""),
    "scan_lines_pruned": f"SELECT * FROM ({_SEGMENTS.replace('FROM l GROUP', "FROM l WHERE format = 'docker' AND container = 'c1' GROUP")})",
    "stream_lines_pruned": f"SELECT * FROM ({_SEGMENTS.replace('FROM l GROUP', "FROM l WHERE format = 'docker' AND container = 'c1' GROUP")})",
    "inventory_changes": """
WITH s AS (
  SELECT c_custkey AS k, t, (c_custkey + 2 * t) % 5 <> 0 AS here, c_custkey % 4 <> 0 OR t < c_custkey % 3 AS runs
  FROM customer, (VALUES (0), (1), (2)) v(t)),
-- The first snapshot starts all; after that a path is followed, or ignored once it was seen not running while followed.
a AS (SELECT k, here AS followed, false AS ignored FROM s WHERE t = 0),
b AS (
  SELECT s.k, here, runs, followed, ignored, here AND NOT followed AND NOT ignored AS started, followed AND here AND NOT runs AS finished
  FROM a JOIN s ON s.k = a.k AND t = 1),
c AS (
  SELECT k, here AND (followed AND runs OR started) AS followed, here AND (ignored OR finished) AS ignored,
    here AND (followed OR ignored OR started) AS known FROM b),
d AS (
  SELECT s.k, here, runs, followed, ignored, known, here AND NOT followed AND NOT ignored AS started,
    followed AND here AND NOT runs AS finished FROM c JOIN s ON s.k = c.k AND t = 2),
e AS (
  SELECT 0 AS turn, k, 'started' AS change FROM a WHERE followed
  UNION ALL SELECT 1, k, 'started' FROM b WHERE started
  UNION ALL SELECT 1, k, 'finished' FROM b WHERE finished
  UNION ALL SELECT 1, k, unnest(['stopped', 'orphaned']) FROM b WHERE followed AND NOT here
  UNION ALL SELECT 2, k, 'started' FROM d WHERE started
  UNION ALL SELECT 2, k, 'finished' FROM d WHERE finished
  UNION ALL SELECT 2, k, 'stopped' FROM d WHERE followed AND NOT here
  UNION ALL SELECT 2, k, 'orphaned' FROM d WHERE known AND NOT here
  UNION ALL SELECT 2, k, 'unignored' FROM d WHERE ignored AND NOT here)
SELECT turn, '/logs/' || CAST(k AS VARCHAR) AS path, change FROM e""",
    "streamed_outputs": f"WITH {_JOURNAL}, {W} SELECT value, count(*) AS n FROM ({_RECORD} UNION ALL {_JOURNAL_JSON}) GROUP BY value",
    "live_samples": f"WITH {W}, {_REPLAY} {_SAMPLES}",
    "live_counts_by_version": f"""WITH {W}, {_versions(5)}
SELECT CAST(floor({MICROS} / 172800000000) * 172800 AS BIGINT) AS epoch_start, service, path, count(*) AS value
FROM t WHERE path <> '' GROUP BY ALL""",
    "live_throttling": f"""WITH {W}, {_REPLAY}
SELECT namespace, pod, container, CAST(sum(CAST(delay AS DECIMAL(28,3))) AS DOUBLE) AS value
FROM d WHERE namespace <> 'ns3' GROUP BY namespace, pod, container""",
    "requests_as_of": f"WITH {W}, {_versions(3)} SELECT event_id, service, path FROM t",
    "message_count_pieces": """
SELECT source AS namespace, lang AS pod, 'texts' AS container,
  CAST(sum(ceil(octet_length(encode(text)) / 1000.0)) AS BIGINT) AS value
FROM documents WHERE length(text) > 0 GROUP BY source, lang""",
    "refreshed_catalog": _w("SELECT service, count(*) AS value FROM s GROUP BY service"),
}
