"""From raw documents to packed token sequences, in five stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podlens.llm.mixing import mix
from podlens.llm.near_dedup import near_duplicates
from podlens.llm.packing import pack
from podlens.llm.queries import tokenizer_path
from podlens.llm.site_quality import classify
from podlens.llm.substring_dedup import remove_repeats
from podlens.llm.tables import documents, prepare, stage_tables, store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def releasing(stage: Stage) -> Stage:
    """A stage that drops the working tables of the stages before it, whose results are written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables(docs):
            return stage(spark, docs, sf_dir)

    return run_stage


@releasing
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, as they are."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = classify(docs, labels, F.col("source"), F.col("lang"), tuple(docs.columns))
    return found.filter("kept").select(*[F.col(f"carried_{name}").alias(name) for name in docs.columns])


@releasing
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates.

    Of rows that share an id one stays, the one with the smallest digest of its text. Rows without an
    id are not compared, and stay.
    """
    prepare(spark)
    first = near_duplicates(docs).filter("doc_id = class_id").select(F.col("doc_id").alias("first_id"))
    named = docs.join(first, F.col("doc_id") == F.col("first_id"), "left_semi")
    digest = F.md5(F.coalesce("text", F.lit("")))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(digest))
    one = named.select(*docs.columns, order.alias("nth_of_id")).filter("nth_of_id = 1").select(*docs.columns)
    return one.unionAll(docs.filter("doc_id is null"))


@releasing
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has.

    A text that loses words keeps the others, joined by one space; one that loses all goes.
    """
    prepare(spark)
    others = tuple(name for name in docs.columns if name not in ("doc_id", "text", "n_chars"))
    found = remove_repeats(docs, carry=(*others, "n_chars"), join_all=False)
    changed = F.col("n_removed") > 0
    columns = {name: F.col(f"carried_{name}") for name in others}
    columns["doc_id"], columns["text"] = F.col("doc_id"), F.col("kept")
    columns["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("carried_n_chars"))
    left = found.filter(~changed | (F.col("n_removed") < F.col("n_words")))
    return left.select(*[columns[name].alias(name) for name in docs.columns])


@releasing
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    prepare(spark)
    copies = mix(docs).groupBy(F.col("doc_id").alias("mixed_id"), F.col("digest").alias("mixed_digest"))
    copies = copies.agg(F.max("copies").cast("int").alias("mixed_copies")).filter("mixed_copies > 0")
    same_text = F.md5(F.coalesce("text", F.lit(""))) == F.col("mixed_digest")
    found = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("mixed_id")) & same_text)
    return found.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("mixed_copies")))).select(*docs.columns)


@releasing
def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their token ids."""
    prepare(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("curve_packing", curve_packing),
]

# Learned weights, iterations and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
