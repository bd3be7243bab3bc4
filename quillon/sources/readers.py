"""FASTA, score tables, range tables and BED as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.kmers import CHUNK, numbered
from ..session import ship, stored


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seqname, sequence): a row for each record; a name's first word names it.

    Records are split at lines that begin with >, wherever a file is cut for reading.
    Of records with one name the last in file order counts, as a lookup by name would have it.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("value").alias("r"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("i"))
    body = F.regexp_replace("r", "^>", "")
    rows = raw.where(F.trim(body) != "").select(
        F.regexp_extract(body, r"^\s*(\S*)", 1).alias("seqname"),
        F.regexp_replace(F.regexp_replace(body, r"^[^\n]*\n?", ""), r"\s", "").alias("sequence"),
        F.struct("f", "o", "i").alias("at"),
    )
    return rows.groupBy("seqname").agg(F.max_by("sequence", "at").alias("sequence"))


def read_fasta_parts(spark: SparkSession, path: str, letters: int = CHUNK) -> DataFrame:
    """(seqname, offset, part): records in parts of some `letters` letters, none of which is ever a row as a whole.

    Files are read line by line, cut wherever Spark cuts them; tasks join the lines of
    their stretch into parts. What a stretch begins with belongs to the last record before it:
    running sums over the stretches, a row each, tell which one that is and how far it has
    come. Lines before a file's first header are left out; a line is never cut. Of records with one name the
    last in file order counts.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("i"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["f", "o", "i", "header", "s"]
        held: list[str] = []
        at, size = None, 0
        for b in batches:
            done = []
            for line, f, o, i in zip(*(b.column(c).to_pylist() for c in ("value", "f", "o", "i")), strict=True):
                head = line.startswith(">")
                if at is not None and (head or (f, o) != at[:2] or size >= letters):
                    done.append((*at, "".join(held)))
                    at = None
                if at is None:
                    at, held, size = (f, o, i, (line[1:].split() or [""])[0] if head else None), [], 0
                if not head:
                    held.append("".join(line.split()))
                    size += len(held[-1])
            if done:
                yield pa.record_batch([pa.array(list(x)) if c != "header" else pa.array(list(x), pa.string()) for c, x in zip(names, zip(*done, strict=True), strict=True)], names=names)
        if at is not None:
            yield pa.record_batch([pa.array([x], pa.string() if c == "header" else None) for c, x in zip(names, (*at, "".join(held)), strict=True)], names=names)

    ship(spark)
    pieces = stored(lines.mapInArrow(joined, "f string, o bigint, i bigint, header string, s string"), "pieces").withColumn("n", F.length("s").cast("bigint"))
    # letters are counted through each file; a part's offset is its place less that of its record's header
    inside = Window.partitionBy("f", "o").orderBy("i")
    before = F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pieces.withColumn("place", before)
    rows = rows.withColumn("record", F.last(F.when(F.col("header").isNotNull(), F.struct("i", "header", "place")), True).over(inside))
    earlier = Window.partitionBy("f").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy("f", "o").agg(F.sum("n").alias("all"), F.max("record").alias("last")).withColumn("base", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    named = lambda r: F.when(r.isNotNull(), F.struct("o", r["i"].alias("i"), r["header"].alias("header"), (F.col("base") + r["place"]).alias("place")))
    stretches = stretches.select("f", "o", "base", F.last(named(F.col("last")), True).over(earlier).alias("open"))
    placed = rows.join(stretches, ["f", "o"]).withColumn("record", F.coalesce(named(F.col("record")), F.col("open"))).where("record is not null")
    placed = placed.select(
        F.col("record.header").alias("seqname"), F.struct("f", "record.o", "record.i").alias("record"), (F.col("base") + F.col("place") - F.col("record.place")).alias("offset"), F.col("s").alias("part"), "n"
    )
    final = placed.groupBy("seqname").agg(F.max("record").alias("record"))
    return placed.join(final, ["seqname", "record"]).where("n > 0 or offset = 0").select("seqname", "offset", "part")


def read_scores(spark: SparkSession, path: str, header: bool = False, columns: list[str] | None = None) -> DataFrame:
    """(values array<double>) of a comma-separated table, a row a line that isn't blank.

    Empty fields vanish, the others are trimmed. A field that is no number, or a row of
    another length than the first, stops the query. header: the first line names the
    columns (score_names reads it) and is left out.
    """
    lines = spark.read.text(path)
    lines = (_without_header(lines) if header else lines).where(F.trim("value") != "")
    fields = F.filter(F.split("value", ","), lambda x: x != "")
    numbers = F.transform(fields, lambda x: F.trim(x).try_cast("double"))
    n = len(columns) if columns else len([x for x in (lines.first() or [""])[0].split(",") if x != ""])
    bad = F.exists(numbers, lambda x: x.isNull()) | (F.size(numbers) != n)
    stop = F.raise_error(F.concat(F.lit("not a row of scores: "), F.col("value")))
    return lines.select(F.when(bad, stop).otherwise(numbers).alias("values"))


def _first_line(lines: DataFrame) -> tuple[str, int] | None:
    """The first line of the first file by name that has any, and its id among _named(lines): Spark reads a folder's longest files first."""
    where = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("_i"))
    row = _named(lines).select("value", "_i", where.alias("w")).agg(F.min_by(F.struct("value", "_i"), "w").alias("first")).first()
    return (row["first"]["value"], row["first"]["_i"]) if row["first"] else None


def _named(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_i", F.monotonically_increasing_id())


def _header(lines: DataFrame) -> str:
    """The first line, empty if there is none."""
    found = _first_line(lines)
    return found[0] if found else ""


def _without_header(lines: DataFrame) -> DataFrame:
    """All but the first line: one line goes, not every row that looks like it."""
    found = _first_line(lines)
    return _named(lines).where(F.col("_i") != found[1]).drop("_i") if found else lines


def score_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a table's first line."""
    return [x for x in _header(spark.read.text(path)).split(",") if x != ""]


def read_ranges(spark: SparkSession, path: str, column: str = "counts") -> DataFrame:
    """(seqname, start, stop, values array<double>) of a white-space separated table of genomic
    ranges whose header names its columns and which has a list column `counts`."""
    names = _header(spark.read.text(path)).split()
    for need in ("seqnames", "from", "to", column):
        if need not in names:
            raise ValueError(f"no column {need}")
    rows = _without_header(spark.read.text(path)).where(F.trim("value") != "")
    part = F.split(F.trim("value"), r"\s+")
    at = {n: i for i, n in enumerate(names)}
    return rows.select(
        part[at["seqnames"]].alias("seqname"), part[at["from"]].cast("bigint").alias("start"), part[at["to"]].cast("bigint").alias("stop"),
        F.transform(F.split(part[at[column]], ","), lambda x: x.cast("double")).alias("values"),
    )


def read_score_table(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(values) of a range table if it is one, else of a score table."""
    if {"seqnames", "from", "to", "counts"} <= set(_header(spark.read.text(path)).split()):
        return read_ranges(spark, path).select("values")
    return read_scores(spark, path, header)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): a text's lines numbered from 0, its parts one after the other by their names."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("i"))
    return numbered(stored(raw, "lines"), [F.col("f"), F.col("o")], [F.col("i")], "n").select("n", "value")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(seqname, start, stop): the first three columns, 0-based and half open; track lines go."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*($|#|track|browser)"))
    part = F.split("value", r"\s+")
    return rows.select(part[0].alias("seqname"), part[1].cast("bigint").alias("start"), part[2].cast("bigint").alias("stop"))


def with_ids(df: DataFrame, name: str = "sample_id") -> DataFrame:
    """df with ids from 0 without gaps, in the order in which it is read.

    Rows keep their place in their partition; partitions get offsets from their counts.
    """
    at = stored(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    return numbered(at, [F.shiftright("_at", 33)], [F.col("_at")], name).drop("_at")
