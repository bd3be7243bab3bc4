"""What the operators of this subpackage share: tables, shared storage, text helpers."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import beside, shared_dir, ship, shuffled, small, stored  # noqa: F401 - for the other modules, too

#: Bytes of rows that a Python worker handles at once, and that go to it at once.
SLICE = 4_000_000
BYTES, BATCH, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "8388608b", "67108864b"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space that separates words wherever a contract names \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null texts as empty strings."""
    return df.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str | StructType, whole: bool = False
) -> DataFrame:
    """mapInArrow over parts of batches of about SLICE bytes; fn may return None for nothing.

    whole: fn gets whole batches, for it gains by seeing many rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in [batch] if whole else sliced(batch):
                out = fn(part)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        release()

    ship(df.sparkSession)
    _bound(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, column: str, fn: Callable[[tuple, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """applyInArrow over the groups of a column, each of some megabytes at most."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        out = fn(key, group)
        release()
        return out

    ship(df.sparkSession)
    return df.groupBy(column).applyInArrow(run, schema)


def release() -> None:
    """Give freed memory back to the system, as workers live on: Arrow's, and what glibc keeps between blocks in use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def _bound(spark: SparkSession) -> None:
    """Bound the bytes of the batches that go to Python workers, where the session has Spark's default."""
    if spark.conf.get(BYTES) == DEFAULT:
        spark.conf.set(BYTES, BATCH)


@contextmanager
def large_batches(spark: SparkSession) -> Iterator[None]:
    """Spark's default batches for the jobs that run inside: for functions that gain by seeing many rows."""
    before = spark.conf.get(BYTES)
    spark.conf.set(BYTES, DEFAULT if before == BATCH else before)
    try:
        yield
    finally:
        spark.conf.set(BYTES, before)


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of equal numbers of rows and about SLICE bytes each."""
    rows = max(1, batch.num_rows * SLICE // max(batch.nbytes, SLICE))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    if not batch.num_rows:
        yield batch


def utf8(column: pa.Array) -> list[bytes]:
    """The column's strings as UTF-8; null gives b""."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else (lower() would also change other letters).

    Texts of ASCII only take the fast way.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
