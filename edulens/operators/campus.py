"""Events and campus points: filters, links, recommended places, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def find_events(
    events: DataFrame, links: DataFrame, start=None, end=None, kind=None, program_ids: DataFrame | None = None,
    limit: int = 100
) -> DataFrame:
    """Events by date (ends included), kind and linked programs, with the total."""
    out = events
    if start is not None:
        out = out.where(F.to_date("starts_at") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.to_date("starts_at") <= F.lit(end).cast("date"))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if program_ids is not None:
        out = out.join(links.join(program_ids, "program_id", "left_semi"), "event_id", "left_semi")
    total = out.agg(F.count(F.lit(1)).alias("total"))
    # The total is a single row.
    return out.orderBy("starts_at", "event_id").limit(limit).join(F.broadcast(total), F.lit(True))


def find_points(
    points: DataFrame, point_links: DataFrame, events: DataFrame, event_links: DataFrame, wanted: DataFrame
) -> DataFrame:
    """Points linked to a wanted program directly or by an event held there."""
    direct = point_links.join(wanted, "program_id", "left_semi").select("point_id")
    held = events.join(event_links.join(wanted, "program_id", "left_semi"), "event_id", "left_semi").select("point_id")
    return points.join(direct.unionByName(held), "point_id", "left_semi")


def collect_links(entities: DataFrame, links: DataFrame, key: str, linked: str) -> DataFrame:
    per = links.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(linked)), ",").alias("links"), F.count_distinct(linked).alias("n_links")
    )
    return entities.join(per, key, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def recommended_places(events: DataFrame, links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events of wanted programs, told apart by whether they have a point."""
    kept = events.join(links.join(wanted, "program_id", "left_semi"), "event_id", "left_semi")
    return kept.withColumn("has_point", F.col("point_id").isNotNull())


def public_catalog(canonical: DataFrame, overlays: DataFrame, units: DataFrame) -> DataFrame:
    """Programs that are not hidden and whose unit is published, with the
    overlay's title where it has one."""
    j = canonical.join(overlays, "program_id", "left").join(
        units.where("published").select("unit_id"), "unit_id", "left_semi"
    )
    return j.where("coalesce(hidden, false) = false").withColumn("title", F.coalesce("title_override", "name"))


def public_editorial_events(events: DataFrame, targets: DataFrame, units: DataFrame) -> DataFrame:
    """Published events; those for selected units only while one is published."""
    live = targets.join(
        units.where("published").select("unit_id"), "unit_id", "left_semi"
    ).groupBy("event_id").agg(F.count_distinct("unit_id").alias("n_targets"))
    j = events.where("status = 'published'").join(live, "event_id", "left").withColumn(
        "n_targets", F.coalesce("n_targets", F.lit(0))
    )
    return j.where("audience <> 'selected' or n_targets > 0")


def ordered_agenda(agenda: DataFrame) -> DataFrame:
    w = Window.partitionBy("event_id").orderBy("starts_at", "title")
    return agenda.withColumn("place", F.row_number().over(w))
