"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mapped, written
from .components import connected_components
from .superminhash import band_keys, shingle_sets, signatures

#: 50 bands of 5 registers miss a pair of similarity 0.75 with a chance of 13 in 10 million,
#: and bring a pair of similarity 0.3 together with one of 0.11.
BANDS, ROWS = 50, 5
WIDTH, PERCENT = 5, 75
TEXTS = 1_000  # documents signed at a time
BLOCK, SLICE = 400, 400  # classes that one task indexes, and that pass its index, about


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Group documents whose word-shingle sets overlap by ``percent`` or more.

    Returns ``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    1. Each whole text becomes its shingle set, a digest of that set and its band
       keys.  Equal sets form a class; only its smallest id goes on, so copies
       never meet each other.
    2. In each band, a class is paired with one leader of its bucket, another one
       from band to band.  The pairs are verified on the full sets and joined into
       components.
    3. What the bands still leave open are buckets that hold several components.
       There the classes outside the largest component are compared with all of the
       bucket, or with all of the cluster that such buckets connect, whichever needs
       fewer rows.  ``BLOCK`` of them make an index of shingles, which a ``SLICE`` of
       the others passes in one task.  So no link between classes that some band
       brings together is lost, no task reads a whole group, and a large group of
       near copies makes no rows for its pairs.

    Empty or null texts, and texts of white space, have no shingles and link with
    nothing.  Rows of one id are one document.  A null id takes no part: its
    ``component_id`` is null and it is kept.  Further columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(mapped(docs, _signer(width, bands, rows), "doc_id long, n_shingles long, digest binary, keys array<long>"), "signed")
    linkable = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    usable = signed.where(linkable)
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["digest", "doc_id"], "left_semi")
    banded = reps.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
    # id XOR key orders the ids of a bucket anew in each band, and gives the id back
    buckets = written(
        banded.groupBy("key").agg(F.count("*").alias("n"), F.min(F.expr("id ^ key")).alias("first")).where("n > 1")
        .select("key", F.expr("first ^ key").alias("leader")), "buckets",
    )
    members = written(banded.join(buckets, "key"), "members")
    chosen = docs.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = written(mapped(chosen, _shingler(width), "id long, shingles binary"), "sets")

    tried = written(_pairs(members.select("id", F.col("leader").alias("other"))), "tried")
    links = written(_verified(tried, sets, percent), "links")
    labels = written(connected_components(links), "labels")
    more = written(_across(members, tried, labels, sets, percent), "links")
    merged = written(connected_components(more).select(F.col("id").alias("label"), F.col("label").alias("whole")), "labels")

    of_class = classes.join(labels, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("label", "rep").alias("label"))
    of_class = of_class.join(merged, "label", "left").select("digest", F.coalesce("whole", "label").alias("group"))
    groups = written(of_class, "groups")
    discard(classes, buckets, members, sets, tried, links, labels, more, merged)
    # rows of one id that hold different texts belong to the smallest group among them; what links with nothing needs no join
    found = usable.join(groups, "digest").select("doc_id", "n_shingles", F.col("group").alias("component_id"))
    found = found.unionByName(signed.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _signer(width: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = shingle_sets(part.column(1).to_pylist(), width)
                keys = band_keys(signatures(sets, bands * rows), rows).view(np.int64)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if ok else None for s, ok in zip(sets, full, strict=True)], pa.binary()),
                        pa.array([k if ok else None for k, ok in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "keys"],
                )

    return sign


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _shingler(width: int):
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return shingle


def _across(members: DataFrame, tried: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of one bucket; ``(a, b)`` are labels, enough of them to join what links.

    A unit of work is an open bucket, or the cluster that open buckets connect.
    """
    named = members.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    named = written(named, "named")
    by_bucket = _open(named.select(F.col("key").alias("unit"), "id", "label"))
    ends = named.select("id", "label").distinct()
    ends = tried.join(ends.select(F.col("id").alias("a"), F.col("label").alias("x")), "a").join(ends.select(F.col("id").alias("b"), F.col("label").alias("y")), "b")
    apart = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "apart")
    clusters = written(connected_components(apart).select(F.col("id").alias("label"), F.col("label").alias("cluster")), "clusters")
    # labels of an open bucket are tried with its leader, so they lie in one cluster, which bears one of them
    in_cluster = named.join(clusters, "label").select("cluster", "key", "id", "label")
    by_cluster = _open(in_cluster.select(F.col("cluster").alias("unit"), "id", "label").distinct())
    cost = by_bucket.join(in_cluster.select(F.col("key").alias("unit"), "cluster").distinct(), "unit").groupBy("cluster").agg(F.sum(F.col("n") * F.col("blocks")).alias("cost"))
    whole = by_cluster.join(cost, F.col("unit") == F.col("cluster")).where(F.col("n") * F.col("blocks") <= F.col("cost"))
    whole = written(whole.select("cluster", "main", "n", "blocks"), "open")
    single = in_cluster.join(whole.select("cluster"), "cluster", "left_anti").select(F.col("key").alias("unit"), "id", "label")
    single = single.join(by_bucket.select("unit", "main", "n", "blocks"), "unit").withColumn("kind", F.lit(0))
    rows = in_cluster.join(whole, "cluster").select(F.col("cluster").alias("unit"), "id", "label", "main", "n", "blocks").distinct().withColumn("kind", F.lit(1))
    rows = written(rows.unionByName(single.select(rows.columns)), "open-rows")
    discard(apart, clusters, whole)

    slices = F.ceil(F.col("n") / F.lit(SLICE)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    place = F.pmod(F.xxhash64("id", F.lit(1)), slices).cast("int")
    unit = ["kind", "unit"]
    indexed = rows.where("label <> main").select(*unit, own.alias("block"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(0).alias("role"), "id", "label")
    passing = rows.select(*unit, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), place.alias("slice"), F.lit(1).alias("role"), "id", "label")
    dealt = indexed.unionByName(passing).join(sets, "id").repartition(*unit, "block", "slice").sortWithinPartitions(*unit, "block", "slice", "role", "id")
    return mapped(dealt.select(*unit, "block", "slice", "role", "label", "shingles"), _block_links(percent), "a long, b long")


def _open(named: DataFrame) -> DataFrame:
    """Of ``named(unit, id, label)`` the units that hold several components: their size, largest component and blocks."""
    sizes = named.groupBy("unit", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("unit").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main")
    )
    blocks = F.ceil((F.col("n") - F.col("most")) / F.lit(BLOCK)).cast("int").alias("blocks")
    return largest.where("parts > 1 AND n > 2").select("unit", "main", "n", blocks)  # two have met already


def _block_links(percent: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            a, b = [], []
            names = [batch.column(c).to_pylist() for c in ("kind", "unit", "block", "slice", "role", "label", "shingles")]
            for kind, unit, number, part, role, label, shingles in zip(*names, strict=True):
                if key != (kind, unit, number, part):
                    key, block = (kind, unit, number, part), _Block(percent)
                s = np.frombuffer(shingles, np.uint64)
                if role == 0:
                    block.add(label, s)
                else:
                    found = block.links(label, s)
                    a += [min(label, other) for other in found]
                    b += [max(label, other) for other in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links


class _Block:
    """An index of some shingle sets, and which of their components have met others so far."""

    def __init__(self, percent: int):
        self.percent, self.labels, self.sets, self.parent, self.index = percent, [], [], {}, None

    def add(self, label: int, s: np.ndarray) -> None:
        self.labels.append(label)
        self.sets.append(s)

    def _find(self, label: int) -> int:
        while (up := self.parent.get(label, label)) != label:
            self.parent[label] = self.parent.get(up, up)
            label = up
        return label

    def links(self, label: int, s: np.ndarray) -> list[int]:
        """Labels of indexed sets that ``s`` links with, one for each component it wasn't yet joined to."""
        if not self.sets:
            return []
        if self.index is None:
            shingles = np.concatenate(self.sets)
            order = np.argsort(shingles, kind="stable")
            self.index = shingles[order], np.repeat(np.arange(len(self.sets)), list(map(len, self.sets)))[order]
            self.sizes = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        shingles, owners = self.index
        lo, hi = np.searchsorted(shingles, s), np.searchsorted(shingles, s, side="right")
        n = hi - lo
        hits = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        same = np.bincount(owners[hits], minlength=len(self.sizes))
        out = []
        for k in np.flatnonzero(100 * same >= self.percent * (self.sizes + len(s) - same)):
            x, y = self._find(label), self._find(self.labels[k])
            if x != y:
                self.parent[x] = y
                out.append(self.labels[k])
        return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets overlap enough; both sets of a pair meet in one row."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [_enough(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in both]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    return mapped(both.select("a", "b", "set_a", "set_b"), check, "a long, b long")


def _enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = int(np.count_nonzero(x[at] == y)) if len(x) else 0
    return 100 * same >= percent * (len(x) + len(y) - same) > 0
