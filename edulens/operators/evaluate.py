"""Replay accuracy, label support, latency quantiles, funnels and questionnaires."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import json_field


def accuracy(predictions: DataFrame, gold: DataFrame, key: str, fields: list[str]) -> DataFrame:
    g = gold.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    j = predictions.join(g, key)
    return j.agg(
        F.count(F.lit(1)).alias("cases"),
        *[F.round(F.avg(F.col(f).eqNullSafe(F.col(f"_{f}")).cast("double")), 3).alias(f"{f}_accuracy") for f in fields],
    )


def label_support(observations: DataFrame) -> DataFrame:
    return observations.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def latency_report(observations: DataFrame, by: str, value: str, fraction: float = 0.95) -> DataFrame:
    """Median, and the value at index floor((n - 1) x fraction) of the order."""
    w = Window.partitionBy(by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    r = observations.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn(
        "_at", F.floor((n - 1) * fraction)
    )
    return r.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.median(value).alias("p50"), F.max(
            F.when(F.col("_i") == F.col("_at"), F.col(value))
        ).alias("p95")
    )


def funnel(events: DataFrame, now=None, approximate: bool = False) -> DataFrame:
    """Distinct owners per event type, and the mean shortlist size (0..20)."""
    live = events if now is None else events.where(F.col("expires_at") > now)
    size = json_field(F.col("payload"), "$.k", "int")
    owners = F.approx_count_distinct("owner_key") if approximate else F.count_distinct("owner_key")
    return live.groupBy("event_type").agg(
        owners.alias("owners"), F.count(F.lit(1)).alias("events"), F.round(
            F.avg(F.when(size.between(0, 20), size)), 2
        ).alias("average_size")
    )


def conversions(events: DataFrame, base: str, targets: list[str]) -> DataFrame:
    """Owners with each target event in percent of owners with the base event."""
    n = lambda t: F.count_distinct(F.when(F.col("event_type") == t, F.col("owner_key")))
    return events.agg(
        n(base).alias("base_owners"),
        *[F.round(F.try_divide(n(t) * 100.0, F.nullif(n(base), F.lit(0))), 2).alias(f"{t}_percent") for t in targets],
    )


def questionnaire_stats(events: DataFrame) -> DataFrame:
    """Counts per kind, completion rate, median milliseconds between answers."""
    w = Window.partitionBy("owner_key").orderBy("occurred_at", "event_id")
    gap = (F.unix_millis("occurred_at") - F.unix_millis(F.lag("occurred_at").over(w))).alias("gap")
    e = events.select("*", gap)
    return e.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type") == "session_started").alias("started"),
        F.count_if(F.col("event_type") == "final_choice").alias("completed"),
        F.round(
            F.try_divide(
                F.count_if(F.col("event_type") == "final_choice"),
                F.nullif(F.count_if(F.col("event_type") == "session_started"), F.lit(0))
            ),
            4
        ).alias("completion_rate"),
        F.median("gap").alias("median_response_ms"),
    )


def live(events: DataFrame, now) -> DataFrame:
    return events.where(F.col("expires_at") > now)


def purge(events: DataFrame, now, limit: int) -> DataFrame:
    """What stays after the oldest ``limit`` expired rows are deleted."""
    gone = events.where(F.col("expires_at") <= now).orderBy("expires_at", "event_id").limit(limit).select("event_id")
    return events.join(gone, "event_id", "left_anti")


def sliding_rate(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events of the same key in the ``seconds`` up to each event."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds("occurred_at")).rangeBetween(-seconds + 1, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w))
