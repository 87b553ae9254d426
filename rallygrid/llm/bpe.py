"""The prefix-table BPE over a table of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .prefix_bpe import Vocabulary


def encode_documents(
    docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """Encode whole texts to ids and decode the ids again.

    Returns ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, with ``with_ids`` also
    ``ids``, one row per input row.  The ids are those of the rank vocabulary in
    ``ranks_file``, each match of ``pattern`` by itself, without special tokens.  A
    null text is empty and has no ids.  Null and repeated ids go through; further
    columns are ignored.  No row meets another, so there is no shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of_file(ranks_file, pattern)
        decimal = vocabulary.decimal.__getitem__
        for batch in batches:
            n_tokens, coded, decoded, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = vocabulary.encode(text or "")
                n_tokens.append(len(ids))
                coded.append(hashlib.sha256(b",".join(map(decimal, ids))).hexdigest())
                decoded.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.array(ids, np.int32))
            columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(docs, encode, schema)
