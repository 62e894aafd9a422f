"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC resource records; records are laid out by offset in archives
of bounded size. Each archive is a tree: leaves hash records, nodes hash the
ordered digests and offset ranges of FAN children. Two replicas are compared
by their roots, and only below nodes that differ is the next level joined, so
an intact replica costs one comparison an archive.

Scale: an archive holds a bounded number of distinct records whatever the
input, so no window or node is large; copies of a record are stored once with
a count. Levels are built bottom up with one aggregate each; their number
follows from the archive size, not from the data.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint, table

ARCHIVE_RECORDS = 4096
FAN = 16


#: Pages have no time of capture, so records carry this one unless told another.
NO_DATE = "1970-01-01T00:00:00Z"


def record_bytes(page_id: Column, url: Column, body: Column, date: str = NO_DATE) -> Column:
    """The whole WARC record of one page, as text in UTF-8; nulls are empty."""
    text = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(text).cast("string"),
        F.lit("\r\n\r\n"),
        text,
        F.lit("\r\n\r\n"),
    )


def manifest(records: DataFrame, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Lay out ``records(page_id, record)``: ``(archive, offset, length, digest,
    page_id, n_copies)``, one row per distinct record.

    Archives are dealt by digest and ordered by (page_id, digest), nulls first;
    identical records are one with their count. Null and empty records take
    no place and are left out. Empty input, empty result.
    """
    hashed = records.select("page_id", F.sha2("record", 256).alias("digest"), F.octet_length("record").alias("length"))
    hashed = hashed.where("length > 0")
    unique = hashed.groupBy("digest").agg(
        F.min("page_id").alias("page_id"),
        F.first("length").cast("long").alias("length"),
        F.count(F.lit(1)).alias("n_copies"),
    )
    unique = shared_checkpoint(unique)
    archives = max(1, -(-unique.count() // archive_records))
    number = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    run = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    return (
        unique.withColumn("archive", F.pmod(number, F.lit(archives)))
        .withColumn("offset", F.sum("length").over(run) - F.col("length"))
        .select("archive", "offset", "length", "digest", "page_id", "n_copies")
    )


def tree_levels(leaves: DataFrame, height: int, fan: int = FAN) -> list[DataFrame]:
    """Levels of the trees over ``leaves(archive, node, offset, length, digest)``,
    leaves first: a node is the digest of its children in order of offset."""
    levels = [leaves.select("archive", "node", "offset", "length", "digest")]
    for _ in range(height):
        child = F.struct("node", F.concat_ws(":", "node", "offset", "length", "digest").alias("text"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["text"]), "|")
        levels.append(
            levels[-1]
            .groupBy("archive", F.floor(F.col("node") / fan).alias("up"))
            .agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sha2(joined, 256).alias("digest"))
            .select("archive", F.col("up").alias("node"), "offset", "length", "digest")
        )
    return levels


def audit(
    source: DataFrame, replica: DataFrame, archive_records: int = ARCHIVE_RECORDS, fan: int = FAN
) -> DataFrame:
    """Locate records that differ: ``(archive, offset, length, status)``.

    ``source`` is a manifest and ``replica`` has ``(archive, offset, length,
    digest)`` as read back at the manifest's offsets; a record that could not
    be read is not in it. Status is ``corrupt``, ``missing`` or ``extra``
    (nothing is recorded at that offset). Intact replicas give no rows. A null
    digest of the replica counts as not read; an empty replica lacks every
    record; an empty source has only extra ones.
    """
    run = Window.partitionBy("archive").orderBy("offset")
    known = source.withColumn("node", F.row_number().over(run).cast("long") - 1)
    known = shared_checkpoint(known.select("archive", "node", "offset", "length", "digest"))
    place = known.select("archive", "offset", "node")
    read = replica.groupBy("archive", "offset").agg(F.min("length").alias("length"), F.min("digest").alias("digest"))
    # An extra record hangs on the node of the last record before it.
    both = place.select("archive", "offset", "node", F.lit(True).alias("known")).join(
        read, ["archive", "offset"], "full"
    )
    before = Window.partitionBy("archive").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    read = both.withColumn("at", F.coalesce("node", F.last("node", True).over(before), F.lit(0).cast("long")))
    extra = read.where("known is null").select("archive", "offset", "length", F.lit("extra").alias("status"))
    read = shared_checkpoint(read.where("known and digest is not null").select("archive", "node", "offset", "length", "digest"))
    height = max(1, math.ceil(math.log(max(2, 4 * archive_records), fan)))
    ours, theirs = tree_levels(known, height, fan), tree_levels(read, height, fan)
    open_ = None
    for a, b in zip(reversed(ours), reversed(theirs)):
        a = a.select("archive", "node", "offset", "length", F.col("digest").alias("want"))
        if open_ is not None:  # only children of nodes that differ
            a = a.join(open_, (a["archive"] == open_["_a"]) & (F.floor(a["node"] / fan) == open_["_n"]), "left_semi")
        b = b.select(F.col("archive").alias("b_archive"), F.col("node").alias("b_node"), F.col("digest").alias("got"))
        bad = a.join(b, (a["archive"] == b["b_archive"]) & (a["node"] == b["b_node"]), "left").where(
            ~F.col("want").eqNullSafe(F.col("got"))
        )
        bad = shared_checkpoint(bad.select("archive", "node", "offset", "length", "got"))
        open_ = bad.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
    status = F.when(F.col("got").isNull(), "missing").otherwise("corrupt")
    return bad.select("archive", "offset", "length", status.alias("status")).unionByName(extra)


def damaged_copy(records: DataFrame, laid: DataFrame) -> DataFrame:
    """A replica of ``records`` with known damage, for the registered query: by
    the last digits of its digest a record is lost or has its last byte cut. Null
    records have no place in ``laid`` and none here; no records, no replica."""
    tail = F.substring("digest", 63, 2)
    cut = F.expr("substring(record, 1, length(record) - 1)")
    raw = records.withColumn("digest", F.sha2("record", 256)).where(tail != "01")
    read = raw.withColumn("record", F.when(tail == "00", cut).otherwise(F.col("record"))).select(
        F.col("digest").alias("of"),
        F.sha2("record", 256).alias("digest"),
        F.octet_length("record").cast("long").alias("length"),
    )
    read = read.groupBy("of").agg(F.first("digest").alias("digest"), F.first("length").alias("length"))
    where = laid.select(F.col("digest").alias("of"), "archive", "offset")
    return read.join(where, "of").select("archive", "offset", "length", "digest")


def write_archives(records: DataFrame, laid: DataFrame, path: str) -> None:
    """Write the archives of a manifest as files, ``archive=N`` each in one file of
    records in order of offset. The text writer ends every row with the line end
    that is taken off the record, so the file is the records and nothing else.
    Copies of a record are written once."""
    own = records.select(F.sha2("record", 256).alias("digest"), "record").dropDuplicates(["digest"])
    rows = laid.select("archive", "offset", "digest").join(own, "digest")
    rows = rows.repartition("archive").sortWithinPartitions("archive", "offset")
    rows = rows.select(F.expr("substring(record, 1, length(record) - 2)").alias("value"), "archive")
    rows.write.mode("errorifexists").option("lineSep", "\r\n").partitionBy("archive").text(path)


HEAD = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)*\r\n")
LENGTH = re.compile(rb"^Content-Length:[ \t]*([0-9]+)[ \t]*\r$", re.I | re.M)


def records_of(data: bytes):
    """``(offset, length)`` of the records of an archive file. What is no record,
    or is cut off, goes up to the next record's head or the end as one piece."""
    at = 0
    while at < len(data):
        head = HEAD.match(data, at)
        size = LENGTH.search(head[0]) if head else None
        end = head.end() + int(size[1]) + 4 if size else 0
        if not size or data[end - 4 : end] != b"\r\n\r\n":
            after = data.find(b"\r\n\r\nWARC/1.", at + 1)
            end = after + 4 if after >= 0 else len(data)
        yield at, end - at
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, offset, length, digest)`` of the records of archive files as
    ``write_archives`` lays them, a replica for ``audit``. An archive file is
    read by one task; ARCHIVE_RECORDS bounds it."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path"), b.column("content")):
                archive, data = int(re.search(r"archive=([0-9]+)", name.as_py())[1]), data.as_py()
                found = [(archive, at, n, hashlib.sha256(data[at : at + n]).hexdigest()) for at, n in records_of(data)]
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                if found:
                    yield pa.RecordBatch.from_arrays(columns, ["archive", "offset", "length", "digest"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select("path", "content").mapInArrow(run, "archive long, offset long, length long, digest string")


def op7_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct page record with its place and what the audit says of a
    damaged copy of the archives."""
    pages = table(spark, sf_dir, "pages")
    records = pages.select("page_id", record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    laid = shared_checkpoint(manifest(records))
    found = audit(laid, damaged_copy(records, laid)).select("archive", "offset", "status")
    return laid.join(found, ["archive", "offset"], "left").select(
        "page_id", "archive", "offset", "length", "digest", "n_copies", F.coalesce("status", F.lit("ok")).alias("status")
    )


OP7_SQL = f"""
WITH r AS (
  SELECT page_id, concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10),
    'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), ''), '>', chr(13), chr(10),
    'WARC-Date: {NO_DATE}', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
    'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10),
    coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record FROM pages),
u AS (
  SELECT sha256(record) AS digest, min(page_id) AS page_id, CAST(min(strlen(record)) AS BIGINT) AS length,
    count(*) AS n_copies FROM r GROUP BY 1),
n AS (SELECT greatest(1, CAST(ceil(count(*) / {ARCHIVE_RECORDS}.0) AS BIGINT)) AS archives FROM u),
p AS (
  SELECT u.*, CAST(CAST('0x' || substr(digest, 1, 8) AS BIGINT) % archives AS BIGINT) AS archive FROM u, n)
SELECT page_id, archive,
  CAST(sum(length) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, digest) - length AS BIGINT) AS "offset",
  length, digest, n_copies,
  CASE substr(digest, 63, 2) WHEN '00' THEN 'corrupt' WHEN '01' THEN 'missing' ELSE 'ok' END AS status
FROM p
"""

QUERIES = {"op7_merkle_audit": op7_merkle_audit}
ORACLES = {"op7_merkle_audit": OP7_SQL}
