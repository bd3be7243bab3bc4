"""Token counts: tables of every prefix's exact count, and the questions they answer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import documents, map_batches

SCHEMA = "doc_id bigint, n_bytes bigint, n_chars bigint, n_tokens bigint, prefixes binary"


def pack_prefixes(deltas: np.ndarray) -> bytes:
    """Differences of neighbouring prefixes' counts: the width of a number, then a number a character."""
    narrow = not len(deltas) or (deltas.min() >= -128 and deltas.max() <= 127)
    return (b"\x01" + deltas.astype("i1").tobytes()) if narrow else (b"\x02" + deltas.astype("<i2").tobytes())


def prefix_counts(prefixes: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters."""
    deltas = np.frombuffer(prefixes, "i1" if prefixes[:1] == b"\x01" else "<i2", offset=1)
    return np.concatenate(([0], np.cumsum(deltas, dtype=np.int64)))


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens.

    Counts may fall as a prefix grows, so it is the last fitting prefix, not the one
    before the first that doesn't fit.
    """
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def prefix_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(SCHEMA) for whole texts: the tokenizer's count at every prefix, without special tokens added.

    A null text is empty: no tokens. Repeated rows give repeated rows.
    """

    def batch(b: pa.RecordBatch) -> pa.Table:
        model = bpe.load(tokenizer)
        texts = b.column(1).to_pylist()
        deltas = list(model.deltas(texts))
        return pa.table(
            {
                "doc_id": b.column(0),
                "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array([int(d.sum(dtype=np.int64)) for d in deltas], pa.int64()),
                "prefixes": pa.array([pack_prefixes(d) for d in deltas], pa.binary()),
            }
        )

    return map_batches(documents(docs, id_col, text_col), batch, SCHEMA, whole=True)


def within_budget(table: DataFrame, budget: int) -> DataFrame:
    """table of prefix_table with over_limit and cut_chars instead of its prefixes.

    cut_chars: characters of the longest prefix that has at most `budget` tokens.
    """

    def batch(b: pa.RecordBatch) -> pa.Table:
        cut = [longest_within(prefix_counts(p), budget) for p in b.column(4).to_pylist()]
        return pa.table({**{n: b.column(n) for n in b.schema.names[:4]}, "cut_chars": pa.array(cut, pa.int64())})

    found = map_batches(table, batch, "doc_id bigint, n_bytes bigint, n_chars bigint, n_tokens bigint, cut_chars bigint")
    return found.withColumn("over_limit", F.col("n_tokens") > budget)


def truncate(docs: DataFrame, table: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their texts cut to at most `budget` tokens, by the stored table: nothing is encoded again."""
    cuts = within_budget(table, budget).select(F.col("doc_id").alias("_cut_id"), "cut_chars").dropDuplicates(["_cut_id"])
    joined = docs.join(cuts, F.col(id_col).cast("bigint").eqNullSafe(F.col("_cut_id")), "left")
    return joined.withColumn(text_col, F.expr(f"substring(`{text_col}`, 1, cast(cut_chars as int))")).drop("_cut_id", "cut_chars")
