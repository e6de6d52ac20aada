"""Options objects. Defaults are the ones users of the agent know."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from podlens import names

BOUND_SYNTAX = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf(?:inity)?))"


def parse_buckets(text: str) -> tuple[float, ...]:
    """Bucket bounds from a single-space-separated list; any bad token is an error."""
    tokens = text.split(" ")
    bad = [token for token in tokens if not re.fullmatch(BOUND_SYNTAX, token)]
    if bad:
        raise ValueError(f"not a bucket bound: {bad[0]!r}")
    return tuple(float(token) for token in tokens)


@dataclass(frozen=True)
class ParseOptions:
    """Where the three field groups of a record go, and how the user payload is unpacked."""

    user_key: str = ""
    cri_key: str = ""
    ext_key: str = ""
    raw_key: str = "msg"
    flatten: bool = True
    max_line_bytes: int = 32000


@dataclass(frozen=True)
class StaticMetadata:
    """Metadata that is the same for every record of one node."""

    dc: str = "n3"
    purpose: str = "staging"
    node_hostname: str = "localhost"
    log_type: str = "containers"
    logstash_prefix: str = "k8s-unknown"

    def fields(self) -> dict[str, str]:
        return {
            names.META_NODE: self.node_hostname,
            names.META_DC: self.dc,
            names.META_PURPOSE: self.purpose,
            names.META_PREFIX: self.logstash_prefix,
            names.META_TYPE: self.log_type,
        }

    def journal_fields(self) -> dict[str, str]:
        """The journal has no log type and a fixed namespace."""
        fields = self.fields()
        del fields[names.META_TYPE]
        fields[names.META_NAMESPACE] = names.JOURNAL_NAMESPACE
        return fields


@dataclass(frozen=True)
class ServiceOptions:
    """Names of the service annotations and the domain that completes short host names."""

    annotation_prefix: str = "podlens.sla"
    default_domain: str = "cluster.test"
    deprecated_domains: str = names.DEPRECATED_DOMAINS_ANNOTATION
    annotation_enable: str | None = None
    annotation_paths: str | None = None
    annotation_domains: str | None = None

    @property
    def enable(self) -> str:
        return self.annotation_enable or f"{self.annotation_prefix}/enable"

    @property
    def paths(self) -> str:
        return self.annotation_paths or f"{self.annotation_prefix}/paths"

    @property
    def domains(self) -> str:
        return self.annotation_domains or f"{self.annotation_prefix}/domains"


@dataclass(frozen=True)
class MetricOptions:
    """Histogram buckets, reset period and the scale used for exact duration sums.

    ``sum_scale`` sums durations as decimals with that many places, which makes the result
    independent of the order of rows and of task retries. ``None`` sums plain doubles.
    """

    buckets: tuple[float, ...] = field(default_factory=lambda: parse_buckets(names.DEFAULT_BUCKETS))
    reset_seconds: int = 172800
    sum_scale: int | None = None


@dataclass(frozen=True)
class RateOptions:
    default_rate: float = 1000.0


@dataclass(frozen=True)
class DeliveryOptions:
    batch_size: int = 1000
    flush_seconds: int = 60
    retry_seconds: float = 3.0
    max_attempts: int = 5


@dataclass(frozen=True)
class RefreshOptions:
    """How often the small tables are read again, in seconds."""

    containers: int = 10
    services: int = 60
    rates: int = 600
