"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import discard, mapped, new_folder, shuffle_partitions, written

STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"
KEY = ["h1", "h2"]
DOCS_A_TASK = 2_000  # documents of a batch for each partition of a shuffle


class LineRuns:
    """Sorted runs of ``(h1, h2, n_docs, holder)`` in levels, as tables in the shared folder.

    A run is bucketed by its key into as many files as a shuffle has partitions, each
    sorted, so runs meet bucket by bucket: they are neither shuffled nor sorted again.

    A batch is merge-anti-joined with the runs: keys that no run has yet are fresh
    and take their holder, the largest id of the batch; keys that some run has
    only add to its count.  The batch then becomes a run of level 0.  ``fanout``
    runs of a level are merged into one of the next, so a batch meets a number of
    runs that grows with the logarithm of the batches so far.

    Batches come in falling order of ids, so that the first holder is the largest.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_partitions(spark)
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add ``batch(h1, h2, doc_id)``, a row for each line key of each document."""
        own = batch.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder"))
        for k, run in enumerate(self.runs()):
            own = own.join(run.select(*KEY, F.lit(True).alias(f"in{k}")), KEY, "left")
        fresh = reduce(lambda c, k: c & F.col(f"in{k}").isNull(), range(len(self.runs())), F.lit(True))
        self.levels[0].append(self._run(own.select(*KEY, "n_docs", F.when(fresh, F.col("holder")).alias("holder"))))
        self._compact()

    def _run(self, df: DataFrame) -> DataFrame:
        """Write a run; the catalogue needs to know it only until it is opened."""
        path, name = new_folder(self.spark, "line-run"), f"rallygrid_line_run_{uuid.uuid4().hex}"
        with _sorted_buckets(self.spark):
            df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        run.written_at = path
        return run

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """Two runs at a time, by their order.  A union of runs would be wrong: Spark 4.1 takes it for bucketed when it isn't."""
        merged = runs[0]
        for run in runs[1:]:
            other = run.select(*KEY, F.col("n_docs").alias("n"), F.col("holder").alias("other"))
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))
            merged = merged.join(other, KEY, "full_outer").select(*KEY, n_docs.alias("n_docs"), F.greatest("holder", "other").alias("holder"))
        return merged

    def _compact(self) -> None:
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fanout:
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                old = self.levels[depth]
                self.levels[depth + 1].append(self._run(self._merge(old)))
                self.levels[depth] = []
                discard(*old)

    def repeated(self, min_docs: int) -> DataFrame | None:
        """Keys that ``min_docs`` documents or more hold, with their holder; the runs are closed."""
        if not self.runs():
            return None
        with _sorted_buckets(self.spark):
            found = written(self._merge(self.runs()).where(F.col("n_docs") >= min_docs).select(*KEY, "holder"), "line-shared")
        discard(*self.runs())
        self.levels = [[]]
        return found


@contextmanager
def _sorted_buckets(spark: SparkSession):
    """Let Spark rely on the order of a bucket's one file, for the jobs run inside."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int | None = None,
    fanout: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Drop lines that many documents share from all of them but the one of the largest id.

    Returns ``(doc_id, text, n_lines, n_dropped)``, one row per input row.  A line's
    key is the line without the ASCII white space at its ends and with A-Z
    lower-cased; keys of ``min_chars`` code points or more that stand in
    ``min_docs`` ids or more count as shared.  All lines of such a key go, and stay
    only in the largest id.  What stays is joined by line feeds.

    Documents come in ``batches`` by their ids; unless given, a batch has about
    ``DOCS_A_TASK`` documents for each partition of a shuffle, so their number
    follows the input.

    Null and empty texts are one empty line.  A null id neither counts nor loses
    lines; rows of one id are one document.  The columns named in ``carry`` come
    after the others as they are; further ones are ignored.
    """
    spark = docs.sparkSession
    carried = [F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)
    keys = mapped(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), _keyer(min_chars), "doc_id long, h1 long, h2 long")
    path, schema = new_folder(spark, "line-keys"), "doc_id long, h1 long, h2 long, batch int"
    if batches is None:
        batches = max(1, -(-docs.count() // (DOCS_A_TASK * shuffle_partitions(spark))))
    edges = docs.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.2 / batches) if batches > 1 else []
    number = reduce(lambda c, e: c + (F.col("doc_id") < F.lit(int(e))).cast("int"), edges, F.lit(0))  # 0: the largest ids
    keys.withColumn("batch", number).write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(schema).parquet(path)

    runs = LineRuns(spark, fanout)
    for batch in range(len(edges) + 1):
        runs.add(keys.where(F.col("batch") == batch).select("doc_id", *KEY))
    shared = runs.repeated(min_docs)
    drops = (
        keys.join(shared, KEY).where("doc_id < holder")
        .groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("drops"))
    )
    drops = drops.select("doc_id", F.col("drops.h1").alias("d1"), F.col("drops.h2").alias("d2"))
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("d1", "d2")]
    own = [f"_carry{k}" for k in range(len(carry))]
    joined = docs.where("doc_id IS NOT NULL").join(drops, "doc_id", "left").select("doc_id", "text", "d1", "d2", *own)
    joined = joined.unionByName(docs.where("doc_id IS NULL").select("doc_id", "text", *none, *own))  # these would all meet in one task
    more = [StructField(c.name, c.dataType) for c in joined.schema.fields[4:]]
    schema = StructType([*_DONE.fields, *more])
    done = mapped(joined, _dropper(min_chars), schema)
    return done.toDF(*(f.name for f in _DONE.fields), *carry)


_DONE = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())]
)


def line_key(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """Two signed 64-bit halves of the hash of a line's key; None below ``min_chars``."""
    key = line.strip(STRIPPED).lower()  # bytes: lower() changes A-Z alone
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    code = xxhash.xxh3_128_intdigest(key)
    return (code >> 64) - (1 << 63), (code & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _keyer(min_chars: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, h1, h2 = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {key for line in _raw(text).split(b"\n") if (key := line_key(line, min_chars))}
                ids += [doc_id] * len(found)
                h1 += [key[0] for key in found]
                h2 += [key[1] for key in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, h1, h2)], names=["doc_id", "h1", "h2"])

    return find


def _dropper(min_chars: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, d1, d2 in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                lines = _raw(text).split(b"\n")
                drops = set(zip(d1, d2, strict=True)) if d1 else ()
                kept = [x for x in lines if line_key(x, min_chars) not in drops] if drops else lines
                texts.append(b"\n".join(kept).decode("utf-8", "surrogatepass") if len(kept) < len(lines) else text or "")
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *batch.columns[4:]],
                names=[*_DONE.names, *batch.schema.names[4:]],
            )

    return drop
