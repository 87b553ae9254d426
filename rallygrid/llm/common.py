"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that bounds words and is stripped off line keys.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``.  Only where that is unset and the whole
    of Spark runs in one process, as in tests, a temporary folder is made and set; on
    a cluster its executors could not see it, so there that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rallygrid-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_root(spark)}/rallygrid/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *sort: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: after it, the loss of an executor costs no more than
    the tasks that ran on it.  ``sort`` names columns that order each file.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.sortWithinPartitions(*sort) if sort else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows of an Arrow batch: it is held whole by the JVM and by Python, so with long texts
#: Spark's default of 10,000 would take most of an executor.
ARROW_ROWS = 1_000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in small batches, by workers that give memory back after each partition.

    Spark keeps its Python workers, so what one stage leaves behind would add to
    the next one's.  The size of batches is a setting of the session; it is lowered
    to ``ARROW_ROWS`` where it is larger, and stays so.
    """
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(_ROWS_SETTING)) <= ARROW_ROWS:
        spark.conf.set(_ROWS_SETTING, ARROW_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the operating system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
