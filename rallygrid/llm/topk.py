"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, new_folder, written

#: Score lists that a vector's components are dealt to.  A candidate that reaches the
#: floor reaches its ``LISTS``-th part in some list; more lists hold more that doesn't.
LISTS = 2
CANDIDATES, QUERIES = 1_000, 16_384  # scored at a time; broadcast at a time
QUERY_BYTES = 8 << 20  # of the queries that are broadcast at a time
STRIP = 128  # queries scored at a time, which bounds the score matrices
EXACT, WIDE = float(1 << 53), float(1 << 62)
HIGHEST = (1 << 63) - 1
LOWEST = -HIGHEST
_LARGEST = float((1 << 63) - 1024)


def quantise(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``(vec_id, width, code)``: floor(scale * x) as little-endian 64-bit integers.

    Rows with a null id or vector, or a null or non-finite component, are left out.
    Components beyond 64 bits become the largest of their sign.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, widths, codes = [], [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or vector is None or None in vector:
                    continue
                x = np.asarray(vector, np.float64)
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    widths.append(len(x))
                    with np.errstate(over="ignore"):
                        codes.append(np.clip(np.floor(scale * x), -_LARGEST, _LARGEST).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(widths, pa.int32()), pa.array(codes, pa.binary())], names=["vec_id", "width", "code"])

    return mapped(df.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")), code, "vec_id long, width int, code binary")


def _matrix(codes, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "<i8").reshape(len(codes), width)


class Lists:
    """The score lists of some queries over some candidates of one width.

    A list holds the products over its own components.  ``reach`` bounds what a
    query and a candidate can have in a list (Cauchy-Schwarz), so a list is read
    only where the threshold can be reached.  Where products leave 64 bits the
    scores are computed in whole numbers of any size and saturated, without lists.
    """

    def __init__(self, q: np.ndarray, v: np.ndarray, lists: int):
        width = q.shape[1]
        top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(1, width)
        self.wide, self.shape = top >= WIDE / max(1, lists), (len(q), len(v))
        self.q, self.v = (q.astype(np.float64), v.astype(np.float64)) if top < EXACT else (q, v)
        self.parts = [np.arange(width)[k::lists] for k in range(min(lists, max(1, width)))]
        self.norms = [(np.linalg.norm(q[:, d].astype(np.float64), axis=1), np.linalg.norm(v[:, d].astype(np.float64), axis=1)) for d in self.parts]

    def part(self, n: int, columns=slice(None)) -> np.ndarray:
        """Partial scores of list ``n``."""
        dims = self.parts[n]
        return self.q[:, dims] @ self.v[columns][:, dims].T

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whole scores of pairs."""
        if self.wide:
            found = [int(sum(map(int.__mul__, a, b))) for a, b in zip(self.q[i].tolist(), self.v[j].tolist(), strict=True)]
            return np.array([min(max(s, LOWEST), HIGHEST) for s in found], np.int64)
        return np.einsum("ij,ij->i", self.q[i], self.v[j]).astype(np.int64)

    def heads(self, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs at the head of some list of their query, ``need`` of each list."""
        rows, take = np.arange(self.shape[0]), min(need, self.shape[1])
        if self.wide or take == self.shape[1]:
            i, j = np.divmod(np.arange(self.shape[0] * self.shape[1]), max(1, self.shape[1]))
            return i, j
        best = np.sort(np.concatenate([np.argpartition(-self.part(n), take - 1, axis=1)[:, :take] for n in range(len(self.parts))], axis=1), axis=1)
        first = np.concatenate([np.ones((len(best), 1), bool), best[:, 1:] != best[:, :-1]], axis=1)
        return np.repeat(rows, first.sum(axis=1)), best[first]

    def resolved(self, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Pairs that score their query's floor or more, their scores, and how many were held.

        With ``m`` lists the uniform threshold is an ``m``-th of the floor.  A list
        gives its entries at the threshold or above; a pair that no list gives scores
        below the floor.  Of a held pair, a list that didn't give it adds less than
        the threshold and no more than its reach: where even that stays below the
        floor the pair goes.  The others' missing scores are fetched and added.
        """
        m, (n_q, n_v) = len(self.parts), self.shape
        if self.wide:
            i, j = np.divmod(np.arange(n_q * n_v), max(1, n_v))
            s = self.scores(i, j)
            over = s >= floor[i]
            return i[over], j[over], s[over], len(i)
        cut = floor.astype(np.float64) / m
        least = cut - np.abs(cut) * 1e-9 - 1  # below the threshold by more than it is rounded
        tables, held = [], np.zeros(self.shape, bool)
        for n in range(m):
            a, b = self.norms[n]
            reach = np.flatnonzero((b * a.max(initial=0) >= least.min(initial=np.inf)) if n_q else np.zeros(n_v, bool))
            tables.append((part := self.part(n, reach), at := np.full(n_v, -1)))
            at[reach] = np.arange(len(reach))
            held[:, reach] |= part >= least[:, None]
        i, j = np.nonzero(held)
        total, bound, given = np.zeros(len(i), self.q.dtype), np.zeros(len(i)), []
        for n, (part, at) in enumerate(tables):
            a, b = self.norms[n]
            own = np.where(at[j] >= 0, part[i, at[j]], 0) if part.shape[1] else np.zeros(len(i), self.q.dtype)
            given.append((at[j] >= 0) & (own >= least[i]))
            total += np.where(given[n], own, 0)
            bound += np.where(given[n], own, np.minimum(least[i], a[i] * b[j] * (1 + 1e-9) + 1))
        reaches = floor[i].astype(np.float64)
        stay = np.flatnonzero(bound >= reaches - np.abs(reaches) * 1e-9 - m)
        for n, dims in enumerate(self.parts):
            lacks = stay[~given[n][stay]]
            total[lacks] += np.einsum("ij,ij->i", self.q[i[lacks]][:, dims], self.v[j[lacks]][:, dims])
        i, j, s = i[stay], j[stay], total[stay].astype(np.int64)
        over = s >= floor[i]
        return i[over], j[over], s[over], int(held.sum())


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, lists: int = LISTS, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The ``k`` best scores of each query, exactly; ties go to the smaller id.

    ``vectors(vec_id, width, code)`` is what ``quantise`` returns.  Queries are the
    rows whose id is divisible by ``every``; candidates are all rows of the same
    width but those of the query's own id.  Returns ``(query_id, rank, vec_id, score)``.
    Equal rows count once; an id with several vectors is a candidate with each and is
    asked with each.  With fewer candidates than ``k``, all are returned.  Scores
    beyond 64 bits are saturated.

    Of equal vectors only the ``k + 1`` smallest ids can be among the best, so no
    others go on, and equal queries are searched once.  They leave out different
    ids, so each search gives the ``2 k`` best of what has at most ``k`` rows an id:
    without any one id, ``k`` of them are left.

    Queries are broadcast in parts of at most ``QUERY_BYTES`` (their number follows
    the table, their size doesn't), and candidates stay where they are: neither is
    copied by a shuffle.  Components are dealt to ``lists`` score lists; for each
    part of the queries:

    1. each block of candidates gathers the heads of its lists and gives the best of
       them with their scores; the ``2 k``-th best of all is the floor;
    2. the floor, a safe cutoff, goes to every block, whose lists give the entries at
       its ``lists``-th part or above;
    3. of those that can still reach the floor the scores are resolved exactly, and
       each task gives its ``2 k`` best, so rows out of it don't grow with its input.
    """
    spark, need = vectors.sparkSession, 2 * k
    vectors = written(vectors, "codes")
    nth = F.dense_rank().over(Window.partitionBy("width", "code").orderBy("vec_id"))
    items = written(vectors.withColumn("n", nth).where(F.col("n") <= k + 1).drop("n").dropDuplicates(["vec_id", "code"]).withColumn("copy", F.xxhash64("code")), "items")
    asked = vectors.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "code"])
    query = written(asked.groupBy("width", "code").agg(F.min("vec_id").alias("first")).select(F.xxhash64("first", "code").alias("q"), "width", "code"), "queries")
    n, size = query.agg(F.count("*"), F.coalesce(F.sum(F.length("code") + 16), F.lit(0))).first()
    chunks = max(1, -(-n // queries), -(-size // QUERY_BYTES))
    best = new_folder(spark, "best")
    for chunk in range(chunks):
        part = query.where(F.pmod("q", F.lit(chunks)) == chunk).toPandas()  # some QUERY_BYTES
        asks = {int(w): (p["q"].to_numpy(np.int64), _matrix(p["code"].tolist(), int(w))) for w, p in part.groupby("width")}
        sent = spark.sparkContext.broadcast(asks)
        heads = written(mapped(items, _searcher(sent, None, k, lists, candidates), _FOUND), "heads")
        floors = {r["q"]: r["floor"] for r in _floor(heads, k).collect()}  # a number a query of the part
        cutoff = spark.sparkContext.broadcast(floors)
        third = mapped(items, _searcher(sent, cutoff, k, lists, candidates), _FOUND)
        _best(third, k).write.mode("append").parquet(best)
        sent.unpersist()
        cutoff.unpersist()
    found = spark.read.schema(_FOUND).parquet(best)

    answers = asked.join(query, ["width", "code"]).select(F.col("vec_id").alias("query_id"), "q").join(found, "q").where("query_id <> vec_id")
    nth = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_FOUND = "q long, vec_id long, copy long, score long"


def _best(df: DataFrame, k: int) -> DataFrame:
    """The ``2 k`` best rows of each query, of which at most ``k`` have the same id."""
    of_id = F.row_number().over(Window.partitionBy("q", "vec_id").orderBy(F.desc("score"), "copy"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return df.withColumn("n", of_id).where(F.col("n") <= k).withColumn("n", nth).where(F.col("n") <= 2 * k).drop("n")


def _floor(df: DataFrame, k: int) -> DataFrame:
    """The least score of the ``2 k`` best of each query that has so many."""
    found = _best(df, k).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("floor"))
    return found.where(F.col("n") == 2 * k).select("q", "floor")


class _Kept:
    """For each query the best rows so far, at most ``k`` of an id and ``2 k`` in all."""

    def __init__(self, names: np.ndarray, k: int):
        self.names, self.k, self.rows, self.size = names, k, [], 0

    def add(self, i: np.ndarray, ids: np.ndarray, copies: np.ndarray, scores: np.ndarray) -> None:
        self.rows.append((i, ids, copies, scores))
        self.size += len(i)
        if self.size > 1 << 18:
            self._shrink()

    def _shrink(self) -> None:
        rows = tuple(np.concatenate(c) for c in zip(*self.rows, strict=True))
        i, ids, copies, scores = rows
        rows = self._first(rows, (copies, -scores, ids, i), (i, ids), self.k)
        i, ids, copies, scores = rows
        self.rows, self.size = [self._first(rows, (copies, ids, -scores, i), (i,), 2 * self.k)], 0

    @staticmethod
    def _first(rows: tuple, order: tuple, group: tuple, limit: int) -> tuple:
        """The first ``limit`` rows of each group in that order, whose last key counts most."""
        at = np.lexsort(order)
        new = np.ones(len(at), bool)
        new[1:] = np.any([g[at][1:] != g[at][:-1] for g in group], axis=0)
        starts = np.flatnonzero(new)
        nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        return tuple(c[at[nth < limit]] for c in rows)

    def batch(self) -> pa.RecordBatch:
        self._shrink()
        i, ids, copies, scores = self.rows[0]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.names[i], ids, copies, scores)], names=["q", "vec_id", "copy", "score"])


def _searcher(sent, cutoff, k: int, lists: int, candidates: int):
    """Search a partition's candidates: their lists' heads, or with a cutoff what reaches it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, kept = sent.value, {}
        floors = {w: np.array([cutoff.value.get(q, LOWEST) for q in names.tolist()], np.int64) for w, (names, _) in asks.items()} if cutoff is not None else {}
        for batch in batches:
            for at in range(0, batch.num_rows, candidates):
                part = batch.slice(at, candidates).to_pandas()
                for width, rows in part.groupby("width"):
                    width = int(width)
                    if width not in asks:
                        continue
                    names, q = asks[width]
                    v, ids, copies = _matrix(rows["code"].tolist(), width), rows["vec_id"].to_numpy(np.int64), rows["copy"].to_numpy(np.int64)
                    best = kept.setdefault(width, _Kept(names, k))
                    for lo in range(0, len(q), STRIP):
                        own = Lists(q[lo : lo + STRIP], v, lists)
                        if cutoff is not None:
                            i, j, scores, _ = own.resolved(floors[width][lo : lo + STRIP])
                        else:
                            i, j = own.heads(2 * k)
                            scores = own.scores(i, j)
                        best.add(i + lo, ids[j], copies[j], scores)
        for best in kept.values():
            if best.rows:
                yield best.batch()

    return search
