"""Rate rules: a small ordered list, from a config file or a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from podlens.functions.regexes import java_pattern, refused_by_java
from podlens.sources.config import read_list


@dataclass(frozen=True)
class RateRule:
    """Patterns for namespace and pod (``""`` for none) and the allowed lines per second."""

    namespace: str
    pod: str
    rate: float


class InvalidRules(ValueError):
    """A rule list that must not replace the one in force."""


def load_rate_rules(spark: SparkSession, path: str) -> list[RateRule]:
    """Rules from a file: a bare list of maps, or the same list under ``rates``."""
    return [
        RateRule(e.get("namespace") or "", e.get("pod") or "", float(e.get("rate") or 0))
        for e in read_list(spark, path, wrapper="rates")
    ]


def rules_from_table(rules: DataFrame) -> list[RateRule]:
    """Rules from a table with ``ord``, ``namespace``, ``pod`` and ``rate``; it is configuration."""
    rows = rules.orderBy("ord").select("namespace", "pod", "rate").collect()
    return [RateRule(r["namespace"] or "", r["pod"] or "", float(r["rate"])) for r in rows]


def check_rules(rules: list[RateRule]) -> list[RateRule]:
    """The rules that apply, with Java patterns; one bad rule rejects the list.

    A rule without namespace and pod is ignored, so its rate is not looked at.
    """
    checked = []
    for rule in rules:
        if not rule.namespace and not rule.pod:
            continue
        if not rule.rate >= 1:
            # A slower rule has no burst, so it would never let a line pass.
            raise InvalidRules("rate must be at least one line per second")
        namespace, pod = java_pattern(rule.namespace), java_pattern(rule.pod)
        if namespace is None or pod is None:
            raise InvalidRules(f"pattern does not compile: {rule}")
        checked.append(RateRule(namespace, pod, rule.rate))
    if refused_by_java([pattern for rule in checked for pattern in (rule.namespace, rule.pod)]):
        raise InvalidRules("a pattern names an unknown script")
    return checked


def reload_rules(current: list[RateRule], loaded: list[RateRule]) -> list[RateRule]:
    """The rules in force after a reload: an empty or invalid list leaves the old ones."""
    if not loaded:
        return current
    try:
        return check_rules(loaded)
    except InvalidRules:
        return current
