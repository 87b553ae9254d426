"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import discard, shuffle_partitions, written

#: The generator of the published algorithm (Lamping and Veach, 2014).
STEP, SHIFT, SCALE = 2862933555777941757, 33, float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, below ``shards``, of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64)
    place, jump = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        place[live] = jump[live]
        key[live] = key[live] * np.uint64(STEP) + np.uint64(1)
        ratio = SCALE / ((key[live] >> np.uint64(SHIFT)).astype(np.float64) + 1.0)
        jump[live] = ((place[live] + 1) * ratio).astype(np.int64)
        live = live[jump[live] < shards]
    return place


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a stable 64-bit key column; a null key counts as 0."""

    @pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard(F.coalesce(key.cast("long"), F.lit(0)))


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put rows into shards by id alone and number the rows of each shard from 0.

    Returns ``(doc_id, size, text_crc32, shard, slot, grown_shard)``: ``size`` is the
    text's UTF-8 bytes (null: none) plus 8, ``grown_shard`` the shard if there were
    one more.  A null text has the checksum of the empty text.  A null id counts
    as 0.  Rows of one id share a shard and have slots of their own.  Further
    columns are ignored.

    Slots need no task that holds a shard: rows are sorted by shard and id over as
    many range partitions as there are tasks, numbered in each, and moved on by
    the counts of the partitions before.  The numbers of each row are written
    before that, as sorting by range reads its input twice: texts are read once.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    narrow = written(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        jump_shard(F.col(id_col), shards).alias("shard"),
        jump_shard(F.col(id_col), shards + 1).alias("grown_shard"),
        F.spark_partition_id().alias("origin"),  # so that very many rows of one id can be split
    ), "shard-rows")
    order = ["shard", "doc_id", "text_crc32", "size", "origin"]
    sorted_ = written(
        narrow.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()),
        "shards",
    )
    discard(narrow)
    counts = sorted_.groupBy("shard", "part").agg(F.count("*").alias("n"))  # a row for each shard and partition
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = sorted_.withColumn("n", F.row_number().over(within))
    return numbered.join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard"
    )
