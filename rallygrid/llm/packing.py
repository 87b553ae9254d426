"""Best-fit packing of token sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written
from .tokens import WordEncoder

CAPACITY = 2048
PIECES_A_GROUP = 30_000


def pack_sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Place lengths, in their order, into bins; returns each one's bin and offset.

    ``count[g]`` is the number of open bins with gap ``g``.  An item of length ``s``
    goes where the sum of the squared counts becomes smallest: into a bin of gap
    ``g``, which then counts under ``g - s``, or into a new bin.  Full bins and
    untouched ones don't count.  Of equal choices the smallest gap wins.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for k, s in enumerate(map(int, lengths)):
        if not 0 < s <= capacity:
            raise ValueError(f"a length of {s} doesn't fit {capacity}")
        best, gap = (2 * int(count[capacity - s]) + 1 if s < capacity else 0), capacity
        if count[s]:  # it closes a bin, which only lowers the sum
            best, gap = 1 - 2 * int(count[s]), s
        old = count[s + 1 : capacity]
        new = count[1 : capacity - s]
        change = np.where(old > 0, 2 * (new - old) + 2, 1 << 40)
        if len(change):
            at = int(change.argmin())
            if change[at] < best or change[at] == best and gap == capacity:
                best, gap = int(change[at]), s + 1 + at
        if gap == capacity:
            b, made = made, made + 1
        else:
            b = open_[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            open_[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: full ones, and before them what is left over."""
    head = n % capacity
    pieces = [(0, head)] if head else []
    return pieces + [(at, capacity) for at in range(head, n, capacity)]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    pieces_a_group: int = PIECES_A_GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pack documents into sequences of ``capacity`` tokens at most.

    Returns ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, with
    ``with_ids`` also ``ids``: a row per piece.  A document is the ids of its whole
    text by the byte-level BPE in ``tokenizer`` (a tokenizers JSON file), then
    ``end_id``; a null text is empty, so every row gives one piece at least.  Only
    documents longer than ``capacity`` are cut.

    Full pieces are a sequence each.  The others are dealt by hash into groups of
    about ``pieces_a_group``, whose number follows the input; each group is packed
    longest first, with state of the size of ``capacity``.  Rows of one id are
    packed as documents of their own.  Further columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = written(
        mapped(docs, _cutter(tokenizer, capacity, end_id, with_ids), schema).withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    part = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // pieces_a_group))
    lengths = part.select("row", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("deal"))
    placed = lengths.groupBy("deal").applyInPandas(_packer(capacity), "row long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("long"))
    return part.join(placed, "row").unionByName(full).drop("row")


def _cutter(tokenizer: str, capacity: int, end_id: int, with_ids: bool):
    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_json(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encoder.encode(text or "") + end
                for piece, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                    own = raw[4 * start : 4 * (start + n)]
                    out.append((doc_id, piece, start, n, zlib.crc32(own), *([np.frombuffer(own, "<i4")] if with_ids else [])))
            columns = list(zip(*out, strict=True)) if out else [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return cut_all


def _packer(capacity: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True])
        bins, offsets = pack_sum_of_squares(rows["length"].to_numpy(), capacity)
        return pd.DataFrame({"row": rows["row"], "sequence_id": bins + (int(key[0]) << 32), "offset": offsets})

    return pack
