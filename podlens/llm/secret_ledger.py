"""Op 13: secrets in every version of every path, with a ledger of what was scanned already.

A text is known by its digest, a blob, wherever and however often it occurs. The ledger holds which rule
in which version has seen which blob, and what it found. A scan takes the blobs that some rule has not
seen, runs just those rules over each, adds both to the ledger and joins the findings of all rules back
to every row that has the text. No Python runs on texts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podlens.llm.tables import store
from podlens.session import scratch_dir

# Rows of one blob that a task joins with its findings.
COPIES_AT_ONCE = 20_000
# A blob counts as hot from this share of all rows on, so that there are at most so many of them.
HOT_SHARE = 1_000


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters. A changed rule needs a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(letters: str) -> str:
    """A pattern for ASCII letters in either case; other signs stay."""
    return "".join(f"[{sign.upper()}{sign}]" if sign.isalpha() else sign for sign in letters)


_NAMES = either_case("password|passwd|secret|token|api_?key")
BASE_RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
# Published forms of keys and tokens; every repeat has a bound or a fixed beginning.
ADDED_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", "AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"[a-z]{2,12}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@"),
)
RULES = BASE_RULES + ADDED_RULES

_SCANNED = "digest string, rules array<string>, commit string"
_FINDINGS = "digest string, rule string, kind string, start long, end long, commit string"


class BlobLedger:
    """Two tables in a shared folder: rules that have seen a blob, and findings.

    A commit writes its findings before it says that they are complete; findings of a commit that did
    not come to its end are not read, and its blobs are scanned again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        for table, schema in (("scanned", _SCANNED), ("findings", _FINDINGS)):
            columns = [column.split(" ") for column in schema.split(", ")]
            nothing = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in columns])
            nothing.write.mode("append").partitionBy("commit").parquet(f"{folder}/{table}")

    def scanned(self) -> DataFrame:
        return self._spark.read.schema(_SCANNED).parquet(f"{self._folder}/scanned")

    def findings(self) -> DataFrame:
        found = self._spark.read.schema(_FINDINGS).parquet(f"{self._folder}/findings")
        return found.join(self.scanned().select("commit").distinct(), "commit", "left_semi")

    def add(self, findings: DataFrame, scanned: DataFrame) -> None:
        commit = F.lit(uuid.uuid4().hex).alias("commit")
        for table, rows in (("findings", findings), ("scanned", scanned)):
            rows.select("*", commit).write.mode("append").partitionBy("commit").parquet(f"{self._folder}/{table}")


def _matches(text: Column, rule: Rule) -> Column:
    """What lies before each match, the match, and the group that must be long enough, by their lengths.

    A split at the pattern gives the text between matches, so lengths alone tell where a match is.
    """
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("named"),
    )
    return F.transform(
        parts,
        lambda part, nth: F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rule.kind).alias("kind"),
            nth.alias("nth"),
            F.length(part["gap"]).cast("long").alias("gap"),
            F.length(part["whole"]).cast("long").alias("long"),
            (F.length(part["named"]) >= rule.least).alias("holds"),
        ),
    )


_PART = "array<struct<rule string, kind string, nth int, gap bigint, long bigint, holds boolean>>"


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings in ``blobs`` (``digest``, ``text``, ``unseen``: names of the rules to run), with places in code points."""
    text, nothing = F.col("text"), F.array().cast(_PART)
    by_rule = [
        F.when(F.array_contains("unseen", rule.name) & text.rlike(rule.pattern), _matches(text, rule).cast(_PART)).otherwise(nothing)
        for rule in rules
    ]
    parts = blobs.select("digest", F.explode(F.flatten(F.array(*by_rule))).alias("part")).select("digest", "part.*")
    so_far = Window.partitionBy("digest", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("long")).over(so_far)
    # The text behind the last match comes as a part without a match.
    placed = parts.withColumn("end", end).filter("holds")
    return placed.select("digest", "rule", "kind", (F.col("end") - F.col("long")).alias("start"), "end")


def update(ledger: BlobLedger, versions: DataFrame, rules: tuple[Rule, ...]) -> None:
    """Scan what is new in ``versions`` (``digest``, ``text``): unseen pairs of a blob and a rule version."""
    names = F.array(*[F.lit(rule.name) for rule in rules])
    seen = ledger.scanned().groupBy("digest").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    known = versions.select("digest").distinct().join(seen, "digest", "left")
    unseen = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
    waiting = store(known.select("digest", unseen.alias("unseen")).filter("size(unseen) > 0"), "unseen")
    # Copies meet within a task first, so a text that a third of all rows hold is sent once by each.
    blobs = versions.select("digest", "text").dropDuplicates(["digest"]).join(waiting, "digest")
    ledger.add(scan_blobs(blobs, rules), waiting.select("digest", F.col("unseen").alias("rules")))


def _by_copies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Join findings (a row for each digest) to rows, with the rows of hot digests dealt over several tasks."""
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    total = rows.count()
    hot = copies.filter(F.col("copies") > max(COPIES_AT_ONCE, total // HOT_SHARE))
    # At most HOT_SHARE rows, as each stands for more than that share of all rows.
    hot = F.broadcast(hot.select("digest", F.ceil(F.col("copies") / COPIES_AT_ONCE).cast("int").alias("deals")))
    one = F.coalesce("deals", F.lit(1))
    dealt = rows.join(hot, "digest", "left").withColumn("deal", (F.monotonically_increasing_id() % one).cast("int"))
    spread = found.join(hot, "digest", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), one - 1)))
    return dealt.drop("deals").join(spread.drop("deals"), ["digest", "deal"], "left").drop("deal")


def scan_versions(versions: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All rows of ``versions`` without their text, with ``findings`` by the given rules.

    ``versions`` may hold any columns that name a path and a version, other than ``digest``, ``deal``,
    ``deals`` and ``findings``. Null texts count as empty. ``findings`` is an array of ``start``,
    ``place`` (of the kind among the rules), ``kind`` and ``end``, in that order; rows that repeat, or
    have equal texts, have equal findings. An empty table gives no rows. The ledger is brought up to date.
    """
    digested = versions.withColumn("digest", F.sha2(F.coalesce(text, F.lit("")), 256))
    update(ledger, digested.select("digest", F.coalesce(text, F.lit("")).alias("text")), rules)
    place = F.create_map(*[part for i, rule in enumerate(rules) for part in (F.lit(rule.name), F.lit(i))])
    found = ledger.findings().select("digest", "start", place[F.col("rule")].alias("place"), "kind", "end")
    one = F.struct("start", "place", "kind", "end")
    found = found.filter("place is not null").groupBy("digest").agg(F.array_sort(F.collect_list(one)).alias("findings"))
    rows = store(digested.drop(text), "versions")
    nothing = F.array().cast("array<struct<start bigint, place int, kind string, end bigint>>")
    joined = _by_copies(rows, found)
    return joined.withColumn("findings", F.coalesce("findings", nothing)).drop("digest")


def spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def _times(place: int) -> Column:
    return F.size(F.filter("findings", lambda f: f["place"] == place))


def secret_spans(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """Per document the number of findings of each base rule, a digest of these, and all findings.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read.
    """
    spark = docs.sparkSession
    found = scan_versions(docs.select("doc_id", "text"), ledger or BlobLedger(spark, scratch_dir(spark, "ledger")))
    base = F.filter("findings", lambda f: f["place"] < len(BASE_RULES))
    counts = [_times(i).cast("long").alias(f"n_{rule.kind}") for i, rule in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))
