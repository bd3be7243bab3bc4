"""What jobs of one session share: this package's modules, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
_written: dict[str, list[str]] = {}
_owners: ContextVar[tuple[list[str], ...]] = ContextVar("owners", default=())


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once an application.

    Functions that run in Python workers are found there by name, also where the
    driver has the package from a folder that workers don't look into.
    """
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    _sent.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir. Only a local session that has none
    gets a temporary one; on a cluster a missing setting is an error, as no folder
    of one machine could serve.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows depends on files that outlive any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for known in (_written.setdefault(df.sparkSession.sparkContext.applicationId, []), *_owners.get()):
        known.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, size: int = 64_000_000) -> bool:
    """Whether df has at most so many rows, of `size` bytes in all by the sum of its columns' lengths: the check before a broadcast."""
    from pyspark.sql import functions as F

    fixed = 8
    sized = F.lit(0).cast("bigint")
    for c, kind in df.dtypes:
        one = F.octet_length(F.col(f"`{c}`")) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))) if "<" in kind else F.lit(fixed)
        sized = sized + F.coalesce(one, F.lit(fixed))
    found = df.select(sized.alias("n")).limit(rows + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("size")).first()
    return found["rows"] <= rows and found["size"] <= size


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides, whatever Spark takes df's size for.

    Spark sizes a table by its compressed files and by its columns' types: what is exploded
    from arrays counts once, and an array as one element. A side of hundreds of megabytes
    may so be sent to the driver for a broadcast.
    """
    return df.hint("merge")


def beside(df: DataFrame, rows: int) -> DataFrame:
    """df as a join's side: broadcast if it is small, else shuffled."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if small(df, rows) else shuffled(df)


def tables_written(spark: SparkSession) -> list[str]:
    """The paths of this application's stored tables, oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, []))


@contextmanager
def owned() -> Iterator[list[str]]:
    """The paths of the tables that are stored inside, oldest first: those of other threads' runs aren't among them."""
    own: list[str] = []
    before = _owners.set((*_owners.get(), own))
    try:
        yield own
    finally:
        _owners.reset(before)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing needs any more; their owner is who called for them."""
    known = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in known:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            known.remove(path)
