"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Rows to a task: small edge tables aren't dealt over many files.
TASK_ROWS = 100_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each id of ``edges(a, b)`` with the smallest id that it reaches.

    Returns ``(id, label)``, one row for each id that has an edge to another id.
    Every step is a join and a partial aggregation over tables in the shared
    folder; nothing is gathered on the driver but two numbers a round.  Both sides
    of each join are read from tables, so adaptive execution can split the rows of
    an id that very many others link to.  Nulls and self-loops are ignored.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _fingerprint(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        tasks = -(-2 * state[0] // TASK_ROWS)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), "least")
        large = written(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks), "large"
        )
        small = written(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks), "edges")
        discard(now, least, large, small)
        now = after
        before, state = state, _fingerprint(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    code = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(code), F.sum(F.pmod(code, F.lit(1_000_003)))).first())
