"""Reading captured documents, and what is known of their sources."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest_of

VENUE = "struct<external_key:string,name:string,address:string,latitude:string,longitude:string>"
EVENTS = (
    "events array<struct<external_key:string,title:string,kind:string,format:string,starts_at:string,ends_at:string,"
    "description:string,registration_url:string,university_ids:array<string>,department_codes:array<string>,"
    f"program_codes:array<string>,venue:{VENUE}>>"
)
POINTS = (
    "points array<struct<external_key:string,point_type:string,name:string,address:string,latitude:string,"
    "longitude:string,university_ids:array<string>,department_codes:array<string>,program_codes:array<string>>>"
)
EVENT_KINDS = ("additional_education", "open_day", "lecture", "competition", "career", "other")
DROPPED = {"script", "style", "noscript", "svg", "nav", "footer"}


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """``(document, body)`` of whole files."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("document"), F.col("value").alias("body"))


def unpacked(documents: DataFrame, schema: str, field: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON ``documents(document, body)``, and ``(document, reason)`` of
    those that give none to read: not JSON of that shape (also null and empty),
    or without the field. A document with an empty list is in neither."""
    parsed = F.from_json("body", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    marked = documents.select("document", "body", parsed.alias("p")).withColumn(
        "reason",
        F.when(F.col("p").isNull() | F.col("p._broken").isNotNull() | (F.trim("body") == ""), "malformed_document")
        .when(F.col(f"p.{field}").isNull(), "no_records"),
    )
    return (
        marked.where("reason is null").select("document", F.inline(f"p.{field}")),
        marked.where("reason is not null").select("document", "reason"),
    )


def parted(marked: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and refused ones with the documents that gave none."""
    good = marked.where("reason is null").drop("reason")
    return good, marked.where("reason is not null").unionByName(broken, allowMissingColumns=True)


def parse_events(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events of JSON documents, typed, and what is refused with its reason: no
    key, title or zoned start, an unknown kind, an end not after the start, or
    a document that is malformed or has no list of events."""
    rows, broken = unpacked(documents, EVENTS, "events")
    zoned = F.col("starts_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    typed = rows.withColumn(
        "starts", F.when(zoned, F.col("starts_at").try_cast("timestamp"))
    ).withColumn("ends", F.col("ends_at").try_cast("timestamp"))
    why = (
        F.when(F.col("external_key").isNull() | F.col("title").isNull(), "missing_identity")
        .when(~F.coalesce(F.col("kind").isin(*EVENT_KINDS), F.lit(False)), "unknown_kind")
        .when(F.col("starts").isNull(), "bad_start")
        .when(F.col("ends") <= F.col("starts"), "ends_before_start")
    )
    return parted(typed.withColumn("reason", why), broken)


def parse_points(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Campus points with both coordinates or neither, within their bounds, and
    what is refused with its reason."""
    rows, broken = unpacked(documents, POINTS, "points")
    typed = rows.withColumns({f"_{c}": F.col(c).try_cast("decimal(9,6)") for c in ("latitude", "longitude")})
    wrong = [F.col(c).isNotNull() & F.coalesce(~F.col(f"_{c}").between(-top, top), F.lit(True)) for c, top in (("latitude", 90), ("longitude", 180))]
    why = (
        F.when(F.col("external_key").isNull(), "missing_identity")
        .when(F.col("latitude").isNull() != F.col("longitude").isNull(), "one_coordinate")
        .when(wrong[0] | wrong[1], "bad_coordinate")
    )
    typed = typed.withColumn("reason", why).withColumns({c: F.col(f"_{c}") for c in ("latitude", "longitude")})
    return parted(typed.drop("_latitude", "_longitude"), broken)


def read_events_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``parse_events`` of files."""
    return parse_events(documents_of(spark, path))


def read_points_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``parse_points`` of files."""
    return parse_points(documents_of(spark, path))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in DROPPED

    def handle_endtag(self, tag):
        self.depth -= tag in DROPPED and self.depth > 0

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(" ".join(data.split()))


def html_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


def extract_text(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Readable text of pages: without scripts, styles and navigation, one line
    per text node. ``limit`` caps the length where a consumer asks for it."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "text": [html_text(h) for h in pdf["html"]]})

    out = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "html"
    ).mapInPandas(run, "page_id long, text string")
    return out if limit is None else out.withColumn("text", F.substring("text", 1, limit))


def snapshot_outcome(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """New, changed or unchanged against the last successful snapshot."""
    p = prev.select("source_id", F.col("content_hash").alias("_h"))
    j = cur.withColumn("content_hash", F.sha2("body", 256)).join(p, "source_id", "left")
    state = F.when(F.col("_h").isNull(), "new").when(
        F.col("_h") == F.col("content_hash"), "unchanged"
    ).otherwise("changed")
    return j.withColumn("outcome", state).drop("_h", "body")


def due_sources(registry: DataFrame, attempts: DataFrame, now, limit: int = 100) -> DataFrame:
    """Enabled sources to fetch again: never tried, tried at another revision,
    or past their retry time or interval; longest overdue first."""
    w = Window.partitionBy("source_id").orderBy(F.col("revision").desc())
    latest = registry.withColumn("_n", F.row_number().over(w)).where("_n = 1 and enabled").drop("_n")
    last = attempts.groupBy("source_id").agg(
        F.max_by(F.struct("revision", "completed_at", "next_retry_at"), "completed_at").alias("a")
    )
    j = latest.join(last, "source_id", "left")
    due = F.coalesce(
        F.col("a.next_retry_at"),
        F.col("a.completed_at") + F.make_dt_interval(secs=F.col("interval_seconds"))
    )
    j = j.withColumn("due_at", due)
    ready = F.col("a").isNull() | (F.col("a.revision") != F.col("revision")) | (F.col("due_at") <= now)
    return j.where(ready).orderBy(F.col("due_at").asc_nulls_first(), "source_id").limit(limit).drop("a")


def poll_backoff(attempts: DataFrame) -> DataFrame:
    """Retry count (10 at most) inside each failure streak, its delay, and the
    last good hash known at each attempt."""
    w = Window.partitionBy("source_id").orderBy("sequence")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("outcome") == "ok"
    streak = F.sum(F.when(ok, 1).otherwise(0)).over(upto)
    e = attempts.withColumn("_s", streak)
    r = F.sum(F.when(ok, 0).otherwise(1)).over(
        Window.partitionBy("source_id", "_s").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    )
    e = e.withColumn("retry_count", F.least(r, F.lit(10)).cast("int"))
    delay = F.when(ok, F.col("interval_seconds")).otherwise(
        F.least(F.col("interval_seconds") * F.pow(F.lit(2), F.least(F.col("retry_count") - 1, F.lit(10))), F.lit(86400))
    )
    good = F.last(F.when(ok, F.col("content_hash")), ignorenulls=True).over(upto)
    return e.withColumn("delay_seconds", delay.cast("long")).withColumn("last_good_hash", good).drop("_s")


def observation_key(df: DataFrame, fields: list[str], prefix: str = "observation:") -> DataFrame:
    return df.withColumn("observation_key", digest_of(*fields, prefix=prefix))
