"""The ten operators over the whole tables, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import table
from .labelled import id_remainder
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality_classifier import fit_quality, score_documents
from .sharding import assign_shards
from .topk import quantise, top_k
from .toxicity import fit_toxicity
from .warc import archive_pages
from .weak_quality import weak_quality


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _scored(scored: DataFrame, fold: tuple[int, int], cut: float) -> DataFrame:
    held_out = F.coalesce(id_remainder("doc_id", fold[0]) == fold[1], F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(score_documents(docs.select("doc_id", "text"), fit_quality(docs, labels)), (3, 1), 0.5)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return _scored(score_documents(docs.select("doc_id", "text"), fit_toxicity(docs, labels)), (4, 2), 0.3)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantise(table(spark, sf_dir, "embeddings")))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = archive_pages(table(spark, sf_dir, "pages"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_line_dedup, op2_best_fit_packing, op3_sharding, op4_quality_classifier, op5_near_dedup,
        op6_toxicity, op7_quality_rules, op8_top_k, op9_prefix_bpe, op10_warc,
    ]
    return {op.__name__: op for op in ops}
