"""Content-addressed archive of web records.

An archive is two tables in one folder. `payloads` holds each different payload
once, under its SHA-256, which is computed again and compared on every read.
`headers` holds the exact header block of each record with the digest of its
payload. Records are rebuilt by a join on the digest, in which a payload that
very many records share is copied to several tasks; what is read of a record
comes from its rebuilt bytes. Records can be written as WARC files, whose
records end in CR LF CR LF: each is a gzip member of its own, after which an
empty member stands.

Of the records with equal payloads of at least REVISIT_LEAST bytes, the one
with the largest id is the response and the rest are revisits of it; smaller
payloads are always responses. Null payloads count as empty, a null url as an
empty one; CR and LF in a url stand as %0D and %0A in its header. Null ids sort
before all others; rows that repeat the id and the payload of the response are
responses too. Payloads of any length are handled row by row. Empty tables give
empty archives. Columns but id, url and html are not read, so their names can't
clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.storage import checkpoint_dir
from .common import join_heavy, join_salted, written

#: Fixed values.
REVISIT_LEAST = 1000
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive are."""

    path: str

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"


def digests(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """page_id, url, payload, its length in bytes, SHA-1 and SHA-256."""
    payload = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    found = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), payload.alias("payload"))
    return found.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload"), "digest": F.sha2("payload", 256)})


def header_block(kind: Column) -> Column:
    """The header of a record as it stands in a file, with the empty line that ends it."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        ("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_sha1"))),
        ("WARC-Refers-To", F.when(kind == "revisit", F.concat(F.lit("<urn:page:"), F.col("owner").cast("string"), F.lit(">")))),
        ("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        ("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    # concat_ws leaves out the fields that are null.
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in fields]
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_LEAST) -> Archive:
    """Writes the two tables. Only distinct payloads of each task are shuffled, and only digests for the headers."""
    archive = Archive(path)
    found = digests(pages, page_id, url, html)
    # First within tasks, then over all: copies don't travel.
    found.select("digest", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(archive.payloads)
    # Only long payloads have owners; the others, of which very many may be equal, meet nobody.
    small = written(found.drop("payload"), "warc-digests")
    long = small.where(F.col("payload_bytes") >= least)
    owners = long.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("__n"))
    marked = join_heavy(long, owners, "digest").unionByName(small.where(F.col("payload_bytes") < least).withColumn("owner", F.lit(None).cast("long")))
    kind = F.when((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("owner")), F.lit("revisit")).otherwise(F.lit("response"))
    marked.select("page_id", "digest", header_block(kind).alias("header")).write.option("compression", "zstd").parquet(archive.headers)
    return archive


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """The payloads, each checked against the digest it is stored under; a damaged one stops the job."""
    found = spark.read.parquet(archive.payloads)
    good = F.sha2("payload", 256) == F.col("digest")
    return found.withColumn("payload", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest")))))


def header_field(name: str) -> Column:
    """The value of the first header line with that name. Lines end in CR LF and nothing else, whatever else a url may hold."""
    lines = F.split("header", CRLF)
    return F.nullif(F.substring(F.get(F.filter(lines, lambda x: x.startswith(f"{name}: ")), F.lit(0)), len(name) + 3, 1 << 30), F.lit(""))


def page_of(name: str) -> Column:
    return F.nullif(F.regexp_extract(header_field(name), r"^<urn:page:(-?[0-9]+)>\z", 1), F.lit("")).cast("long")


def rebuild(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records as bytes, header and body: header, record, and the payload that the record has or stands for. A revisit has no body of its own."""
    full = join_salted(spark.read.parquet(archive.headers), read_payloads(spark, archive), "digest", F.xxhash64("header"))
    body = F.when(header_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return full.select("header", F.concat(F.encode("header", "UTF-8"), body).alias("record"), "payload")


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row for each record, from its rebuilt bytes: what the header says, and length and SHA-1 of the full payload."""
    own = F.substring(F.col("record"), F.octet_length("header") + 1, F.octet_length("record"))
    records = rebuild(spark, archive).select("header", F.when(header_field("WARC-Type") == "revisit", F.col("payload")).otherwise(own).alias("payload"))
    measured = records.select("header", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    return measured.select(
        page_of("WARC-Record-ID").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        header_field("WARC-Type").alias("record_type"),
        page_of("WARC-Refers-To").alias("refers_to"),
        (header_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))).alias("verified"),
        header_field("WARC-Target-URI").alias("url"),
    )


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(9, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def export_warc(spark: SparkSession, archive: Archive, path: str, records_per_file: int = 10_000) -> None:
    """Writes the records as gzipped WARC files of at most so many records, through Spark's writer of lines: a line is a gzip member, and an empty one is what separates lines."""

    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip_member(r + b"\r\n\r\n") for r in batch.column(0).to_pylist()], pa.binary())], names=["member"])

    members = rebuild(spark, archive).select("record").mapInArrow(pack, "member binary")
    writer = members.select(F.col("member").cast("string").alias("value")).write.option("maxRecordsPerFile", records_per_file)
    writer.option("encoding", "ISO-8859-1").option("lineSep", gzip_member(b"").decode("iso-8859-1")).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header and payload of the records in WARC files, plain or gzipped; each file is one task's, held as a whole (2 GB at most) and read by its Content-Length fields."""
    import gzip

    def parse(data: bytes) -> Iterator[tuple[str, bytes]]:
        data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        at = 0
        while (end := data.find(b"\r\n\r\n", at)) >= 0:
            header = data[at : end + 4].decode("utf-8")
            length = next(int(x.split(":", 1)[1]) for x in header.split(CRLF) if x.lower().startswith("content-length:"))
            yield header, data[end + 4 : end + 4 + length]
            at = end + 4 + length + 4

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = list(parse(data))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.binary())], names=["header", "payload"])

    read = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "header string, payload binary")
    return read.select(page_of("WARC-Record-ID").alias("page_id"), "header", "payload")


def new_archive_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
