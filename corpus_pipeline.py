"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents. Rows that share a doc_id are one document and go or stay together, those
without an id too. A text of null is empty: quality rules drop it. Repeated rows stay
repeated; packing gives each its pieces. Empty tables give empty tables, and further
columns pass through unchanged, whatever their names, up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, lines, packing, quality, simhash
from quillon.llm.common import beside, stored, table
from quillon.llm.queries import END_ID, SEQUENCE, tokenizer
from quillon.session import owned, remove_tables

#: Bound of a table of ids for a broadcast.
FEW_IDS = 500_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id isn't among ids (column gone)."""
    ids = stored(ids.distinct(), "gone")
    side = beside(ids, FEW_IDS)
    return docs.join(side, docs["doc_id"].eqNullSafe(side["gone"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality(docs, field).where("quality.kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more stay at their first occurrence only.

    n_chars follows the text. A document that loses all of its lines goes.
    """
    found = lines.line_dedup(docs, min_docs=10, min_chars=1, keep_first=True).where("lines.n_dropped < lines.n_lines")
    text = F.when(F.col("lines.n_dropped") > 0, F.col("lines.kept")).otherwise(F.col("text"))
    size = F.when(F.col("lines.n_dropped") > 0, F.char_length("lines.kept").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the smallest id stays.

    Near copies have a Jaccard similarity of five-word shingles of 0.8 or more.
    """
    found = simhash.near_copies(docs, percent=80, shingle=5)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return _without(docs, gone.select(F.col("doc_id").alias("gone")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc_id").alias("gone")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces in sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs, tokenizer(), SEQUENCE, END_ID), SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The line field, fingerprints and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's rows.

    What a stage stored on its way, and its predecessor's result, go once its own result is written.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        last = k + 1 == len(STAGES)
        with owned() as own:
            docs = stage(spark, docs, sf_dir)
            docs = docs if last else stored(docs, name.replace(" ", "-"))
        if not last:
            remove_tables(spark, before + own[:-1])
            before = own[-1:]
    return docs
