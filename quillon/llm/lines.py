"""Line dedup with Spark's own functions only: per-document bitmaps of lines to drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, beside, documents, stored

#: Documents of one line are dealt over so many sub-groups by their id.
SALTS = 64
#: Broadcast bounds: rows of the frequent-line table and of the bitmap table (common.small bounds bytes, too).
FEW_LINES, FEW_MAPS = 500_000, 500_000


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(key binary(16), doc_id, pos) of every line whose key has min_chars code points.

    A key is the MD5 of the line, stripped of white space at both ends, A-Z lower-cased.
    """
    d = documents(docs, id_col, text_col)
    keys = F.transform(_split(ascii_lower(F.col("text"))), lambda x: F.btrim(x, F.lit(BLANKS)))
    marks = F.transform(keys, lambda x: F.when(F.char_length(x) >= min_chars, F.md5(x)))
    rows = d.select("doc_id", F.posexplode(marks).alias("pos", "mark"))
    return rows.where("mark is not null").select(F.unhex("mark").alias("key"), "doc_id", "pos")


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(key, n_docs, first_doc, first_pos) of the keys found in min_docs documents.

    The rows are range-partitioned by key and a salt of the document, and sorted by
    document and position inside; a stream over that order meets each document's
    first occurrence once. Sub-groups then add up per key, so that a line that every
    document has costs a task no more than its share. Null ids count as one document.
    """
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    ranged = salted.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt", "doc_id", "pos")
    order = Window.partitionBy("key", "salt").orderBy("doc_id", "pos")
    firsts = ranged.withColumn("at", F.row_number().over(order)).withColumn("before", F.lag("doc_id").over(order))
    firsts = firsts.where((F.col("at") == 1) | ~F.col("doc_id").eqNullSafe(F.col("before")))
    found = firsts.groupBy("key").agg(
        F.count("*").alias("n_docs"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "pos")).alias("first")
    )
    return found.where(F.col("n_docs") >= min_docs).select(
        "key", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos")
    )


def drop_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
) -> DataFrame:
    """(doc_id, dropped map<int,bigint>): the lines that each document loses.

    Bit i of word w stands for line 64 * w + i; words without a bit are left out, and
    so are documents that keep every line: a sparse bitmap instead of text.
    keep_first: the first occurrence (smallest doc_id, then position) stays.
    Rows that share an id are one document; null ids likewise.
    """
    lines = stored(line_table(docs, id_col, text_col, min_chars), "lines")
    frequent = stored(frequent_lines(lines, min_docs), "frequent")
    side = beside(frequent, FEW_LINES)
    hits = lines.join(side, "key")
    if keep_first:
        hits = hits.where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))))
    words = hits.groupBy("doc_id", F.expr("pos div 64").cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    return words.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("dropped"))


def _is_dropped(i: Column) -> Column:
    word = F.element_at("dropped", F.floor(i / 64).cast("int"))
    return F.coalesce(F.getbit(word, F.pmod(i, F.lit(64))), F.lit(0)) == 1


def apply_bitmaps(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with columns n_lines, n_dropped and kept (the text that is left) added, in a struct named lines.

    A null or empty text is one empty line.
    """
    maps = stored(maps, "bitmaps")
    side = beside(maps, FEW_MAPS)
    carry = [c for c in docs.columns if c.lower() != "lines"]
    # a carried text goes through a shuffle once, inside its row
    inside = text_col in carry
    own = docs.select(F.struct(*carry).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), *([] if inside else [F.col(text_col).alias("text")]))
    found = own.join(side.withColumnRenamed("doc_id", "at"), F.col("doc_id").eqNullSafe(F.col("at")), "left")
    text = F.col("row")[text_col] if inside else F.col("text")
    found = found.withColumn("text", F.coalesce(text.cast("string"), F.lit("")))
    kept = F.array_join(F.filter(_split(F.col("text")), lambda x, i: ~_is_dropped(i)), "\n")
    count = F.aggregate(F.map_values("dropped"), F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))
    return found.select(
        "row.*",
        F.struct(
            F.size(_split(F.col("text"))).cast("bigint").alias("n_lines"),
            F.coalesce(count, F.lit(0).cast("bigint")).alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        ).alias("lines"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """docs with the struct column lines; see drop_bitmaps and apply_bitmaps."""
    return apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, **rules), id_col, text_col)
