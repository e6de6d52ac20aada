"""The field, label and annotation names that records and inputs use."""

# Line formats.
FORMAT_DOCKER = "docker"
FORMAT_CRI = "containerd"

# Keys with a meaning inside a log line.
KEY_LOG = "log"
KEY_TIME = "time"
KEY_STREAM = "stream"
KEY_SLA = "sla"
KEY_LOGGING = "logging"

# Access-log keys.
KEY_HOST = "host"
KEY_METHOD = "request_method"
KEY_URI = "request_uri"
KEY_REQUEST_TIME = "request_time"
KEY_STATUS = "status"
KEY_UPSTREAM_POD = "upstream_pod_name"
KEY_UPSTREAM_TIME = "upstream_response_time"
KEY_UPSTREAM_LAST = "upstream_response_time_float"
KEY_UPSTREAM_TOTAL = "upstream_response_time_total"

# Metadata keys added to every record.
META_DC = "dc"
META_PURPOSE = "purpose"
META_PREFIX = "logstash_prefix"
META_TYPE = "type"
META_NODE = "kubernetes.node_hostname"
META_CONTAINER_ID = "docker.container_id"
META_POD = "kubernetes.pod_name"
META_NAMESPACE = "kubernetes.namespace_name"
META_CONTAINER = "kubernetes.container_name"

# Container labels in a Docker config file.
LABEL_NAMESPACE = "io.kubernetes.pod.namespace"
LABEL_POD = "io.kubernetes.pod.name"
LABEL_CONTAINER = "io.kubernetes.container.name"

# Journal fields that are kept, and the values the journal source uses.
JOURNAL_FIELDS = (
    "SYSLOG_IDENTIFIER",
    "PRIORITY",
    "SYSLOG_PID",
    "SYSLOG_FACILITY",
    "SYSTEMD_UNIT",
    "MESSAGE",
)
JOURNAL_UNIT_SOURCE = "_SYSTEMD_UNIT"
JOURNAL_NAMESPACE = "journald"
JOURNAL_LEDGER_KEY = "system.journal"

# Values of the enable annotation that switch a service on, and the older domains annotation.
ENABLE_VALUES = ("true", "enable")
DEPRECATED_DOMAINS_ANNOTATION = "router.deis.io/domains"

# Default upper bounds of histogram buckets, in seconds.
DEFAULT_BUCKETS = (
    "0.01 0.02 0.04 0.06 0.08 0.1 0.15 0.2 0.25 0.3 0.4 0.5 0.6 0.7 0.8 0.9 1 1.2 1.5 1.75 2 3 4 5 8 10 20 60"
)

# Metric names.
M_REQUESTS = "http_request_count"
M_TOTAL = "http_request_total_count"
M_TIME = "http_request_time"
M_UPSTREAM = "http_upstream_response_time_total"
M_MESSAGES = "log_message_count"
M_THROTTLE = "container_throttling_delay_seconds_total"
