"""Content-addressed WARC archives: payload bytes once, record headers apart, records by joins."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small, stored

CRLF = "\r\n"
#: Bound of the table of repeated digests for a broadcast: rows of under 100 bytes.
FEW_DIGESTS = 500_000


@dataclass(frozen=True)
class Archive:
    """Where an archive's two Parquet tables are: payloads (digest, payload) and
    records (page_id, digest, header, in_place)."""

    path: str

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/payloads")

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/records")


def _sha256(payload: Column) -> Column:
    return F.sha2(payload, 256)


def _header(kind: Column, date: str) -> Column:
    """The exact WARC/1.1 header block of a record, its final empty line included."""
    named = lambda n, v: F.concat(F.lit(f"{n}: "), v, F.lit(CRLF))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        named("WARC-Type", kind),
        named("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        named("WARC-Date", F.lit(date)),
        named("WARC-Target-URI", F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        named("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, named("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisit, named("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(""),
        named("Content-Type", F.lit("text/html; charset=utf-8")),
        named("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(
    pages: DataFrame,
    path: str | None = None,
    least: int = 100,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> Archive:
    """A WARC record for each row of pages; equal payloads are stored once.

    Of records with equal payloads of at least `least` bytes the one of the smallest id
    is a response and the others revisit it; shorter payloads are responses each. The
    digest is SHA-256; rows of one digest whose lengths or second hashes differ stop the
    write. A null payload is empty, a null url too. Rows of a null id come last among
    equals; rows that share the smallest id are responses all. Line feeds and carriage
    returns of a url are %-escaped in its header, as no field can hold them. The default
    path is a new folder in the shared one.

    Payloads don't move but for repeated rows; digests, sizes and ids decide.
    """
    spark = pages.sparkSession
    archive = Archive(path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    payload = F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    marked = own.withColumn("digest", _sha256(F.col("payload")))
    heads = stored(marked.select("page_id", "url", "digest", F.octet_length("payload").cast("bigint").alias("size"), F.xxhash64("payload").alias("check")), "heads")
    once = heads.groupBy("digest", "page_id").agg(
        F.count("*").alias("n"), F.min("size").alias("size"), F.max("size").alias("size2"), F.min("check").alias("check"), F.max("check").alias("check2")
    ).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull(), "page_id", "n")).alias("least"), F.sum("n").alias("n"),
        F.min("size").alias("size"), F.max("size2").alias("size2"), F.min("check").alias("check"), F.max("check2").alias("check2"),
    )
    same = (F.col("size") == F.col("size2")) & (F.col("check") == F.col("check2"))
    least_id = F.when(same, F.col("least.page_id")).otherwise(F.raise_error(F.lit("two payloads have one digest")))
    once = stored(once.select("digest", least_id.alias("first"), "n", F.col("least.n").alias("twice")), "digests")
    # a payload stays where its row is: of a digest with several rows that of the smallest id's
    many = once.where("n > 1").select(F.col("digest").alias("many"), F.col("first").alias("least"), "twice")
    side = F.broadcast(many) if small(many, FEW_DIGESTS) else many
    both = marked.join(side, F.col("digest") == F.col("many"), "left")
    both = both.where(F.col("many").isNull() | F.col("page_id").eqNullSafe(F.col("least")))
    kept = both.where(F.coalesce("twice", F.lit(1)) == 1).select("digest", "payload")
    if not many.where("twice > 1").isEmpty():  # rows that share digest and id
        kept = kept.unionByName(both.where("twice > 1").select("digest", "payload").dropDuplicates(["digest"]))
    kept.write.parquet(f"{archive.path}/payloads")
    heads = heads.join(once.select("digest", "first"), "digest")
    kind = F.when((F.col("size") < least) | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit")
    heads.select("page_id", "digest", F.encode(_header(kind, date), "UTF-8").alias("header")).write.parquet(f"{archive.path}/records")
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, record, header, payload, digest): the original records, header and block, by a join on the digest.

    A revisit's block is empty. A stored payload that doesn't have its digest stops the read.
    """
    checked = F.when(_sha256(F.col("payload")) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload has another digest")))
    joined = archive.records(spark).join(archive.payloads(spark).select("digest", checked.alias("payload")), "digest")
    revisit = field(F.decode("header", "UTF-8"), "WARC-Type") == "revisit"
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return joined.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "header", "payload", "digest")


def field(header: Column, name: str) -> Column:
    """A header field's value, null if there is none. Only CRLF ends a field."""
    found = F.regexp_extract(header, rf"(?s)\r\n{name}: (.*?)\r\n", 1)
    return F.when(found != "", found)


def digest_table(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of read_archive's records.

    A record is taken apart again: its header up to the first empty line, then as many
    bytes as it says, then the two line ends. What a response holds is measured and
    hashed; a revisit's block must be empty and its payload is the one joined to it. A
    record of another make stops the query.
    """
    text = F.decode("record", "ISO-8859-1")  # a character a byte
    size = F.instr(text, CRLF + CRLF) + 3
    head = F.decode(F.expr("substring(record, 1, size)"), "UTF-8")
    own = records.withColumn("size", size).withColumn("head", head)
    own = own.withColumn("block", F.expr("substring(record, size + 1, octet_length(record) - size - 4)"))
    kind = field(F.col("head"), "WARC-Type")
    payload = F.when(kind == "revisit", F.col("payload")).otherwise(F.col("block"))
    digest = F.regexp_extract(field(F.col("head"), "WARC-Payload-Digest"), "sha256:([0-9a-f]{64})", 1)
    said = field(F.col("head"), "Content-Length").cast("bigint") == F.octet_length("block")
    right = said & (_sha256(payload) == digest) & F.endswith(F.col("record"), F.lit(b"\r\n\r\n"))
    target = F.regexp_extract(F.coalesce(field(F.col("head"), "WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1)
    return own.select(
        F.regexp_extract(field(F.col("head"), "WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).try_cast("bigint").alias("page_id"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.when(right, digest).otherwise(F.raise_error(F.lit("a record isn't as it was written"))).alias("payload_digest"),
        kind.alias("record_type"),
        target.try_cast("bigint").alias("refers_to"),
    )
