"""One query per operator, over the whole documents table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podlens.llm.alignment import align
from podlens.llm.fingerprints import edited_fingerprints
from podlens.llm.license_scan import known_licenses, scan_licenses
from podlens.llm.lm_scoring import score_texts
from podlens.llm.merkle import verified_rows
from podlens.llm.mixing import mix
from podlens.llm.near_dedup import near_duplicates
from podlens.llm.packing import packed_pieces
from podlens.llm.quality_rules import judge
from podlens.llm.secret_ledger import secret_spans
from podlens.llm.sharding import shard_documents
from podlens.llm.site_quality import classify
from podlens.llm.substring_dedup import remove_repeats
from podlens.llm.tables import documents

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(query):
    REGISTRY[query.__name__] = query
    return query


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(documents(spark, sf_dir), tokenizer_path())


@register
def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


@register
def op10_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


@register
def op5_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@register
def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


@register
def op9_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


@register
def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir), known_licenses(spark))


@register
def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = classify(documents(spark, sf_dir), labels, F.col("source"), F.col("lang"))
    return found.withColumnRenamed("carried_doc_id", "doc_id")


@register
def op6_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score_texts(documents(spark, sf_dir), held_out)


@register
def op11_shared_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return align(documents(spark, sf_dir), *paths, public_tokenizers.PATTERN)


@register
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_rows(documents(spark, sf_dir))


@register
def op13_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))
