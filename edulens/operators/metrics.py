"""Typed metric queries over projections: filters, grouping, aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import settled

AGGREGATIONS = ("value", "sum", "mean", "weighted_mean", "min", "max", "median", "count", "distribution")
GROUPS = ("university_id", "direction_id", "program_id")
OPS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, x: c == x,
    "gt": lambda c, x: c > x,
    "gte": lambda c, x: c >= x,
    "lt": lambda c, x: c < x,
    "lte": lambda c, x: c <= x,
}


def scope(df: DataFrame, kind: str, ids: list | DataFrame | None = None) -> DataFrame:
    """ALL, or the rows of given universities, directions or programs. A list
    becomes an IN filter, a DataFrame a semi-join."""
    if kind == "all":
        return df
    column = f"{kind}_id"
    if column not in GROUPS:
        raise ValueError(f"unknown scope {kind}")
    if isinstance(ids, DataFrame):
        return df.join(ids, column, "left_semi")
    return df.where(F.col(column).isin(*ids))


def id_filter(df: DataFrame, **ids: list) -> DataFrame:
    for name, values in ids.items():
        df = scope(df, name.removesuffix("_id"), values)
    return df


def metric_filter(df: DataFrame, code: str, op: str, x: float) -> DataFrame:
    """Programs whose metric passes; a missing value never does. ``df`` has the
    metric as a column, or is a tall ``(program_id, feature, value)``."""
    if code in df.columns:
        return df.where(OPS[op](F.col(code), x))
    return df.where((F.col("feature") == code) & OPS[op](F.col("value"), x))


def feature_filter(projections: DataFrame, metrics: DataFrame, code: str, op: str, x: float) -> DataFrame:
    return projections.join(metric_filter(metrics, code, op, x), "program_id", "left_semi")


def offering_filter(programs: DataFrame, offerings: DataFrame, same_offering: bool = False, **wanted) -> DataFrame:
    """Programs with an offering for each wanted value, by default each filter
    on its own; ``same_offering`` asks for one that meets all."""
    if same_offering:
        for c, v in wanted.items():
            offerings = offerings.where(F.col(c) == v)
        return programs.join(offerings, "program_id", "left_semi")
    found = offerings.groupBy("program_id").agg(*[F.bool_or(F.col(c) == v).alias(f"_{c}") for c, v in wanted.items()])
    for c in wanted:
        found = found.where(F.col(f"_{c}"))
    return programs.join(found, "program_id", "left_semi")


def predicate_filter(
    df: DataFrame, fields: list[str], judge: Callable[[pd.DataFrame], list], max_chars: int = 2000
) -> DataFrame:
    """Rows with the verdict of a user function on batches of allowed fields.

    ``judge`` gets the fields as strings cut to ``max_chars`` and returns True,
    False or None per row; ``kept`` marks True alone, ``reason`` tells the
    other outcomes, an exception being ``unavailable``.
    """
    schema = df.withColumn("verdict", F.lit(None).cast("boolean")).withColumn("reason", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shown = pdf[fields].astype("string").apply(lambda c: c.str.slice(0, max_chars))
            try:
                verdict, reason = list(judge(shown)), None
            except Exception:
                verdict, reason = [None] * len(pdf), "unavailable"
            why = [reason or {True: "matched", False: "not_matched"}.get(v, "indeterminate") for v in verdict]
            yield pdf.assign(verdict=pd.array(verdict, dtype="boolean"), reason=why)

    return df.mapInPandas(run, schema).withColumn("kept", F.coalesce("verdict", F.lit(False)))


def metric_query(
    rows: DataFrame,
    aggregation: str,
    group_by: list[str],
    value: str = "value",
    weight: str = "weight",
    descending: bool = True,
    limit: int | None = 100,
) -> DataFrame:
    """Aggregate ``rows(value, coverage, confidence, weight)`` by one or two keys.

    Nulls are left out. Status is available if none is missing and the mean
    coverage is 1, partial otherwise, insufficient_data if all are missing.
    Rows come by value (missing as -1), then by key.
    """
    if aggregation not in AGGREGATIONS or not 1 <= len(group_by) <= 2 or not set(group_by) <= set(GROUPS):
        raise ValueError("unknown aggregation or grouping")
    v, known = F.col(value), F.col(value).isNotNull()
    w = F.when(known, F.col(weight))
    result = {
        "value": F.avg(v),
        "sum": F.sum(v),
        "mean": F.avg(v),
        "weighted_mean": F.coalesce(F.try_divide(F.sum(v * w), F.nullif(F.sum(w), F.lit(0))), F.avg(v)),
        "min": F.min(v),
        "max": F.max(v),
        "median": F.median(v),
        "count": F.when(F.count(v) > 0, F.count(v).cast("double")),
        "distribution": F.avg(v),
    }[aggregation]
    more = []
    if aggregation == "distribution":
        more = [
            F.min(v).alias("low"),
            *[F.percentile(v, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)],
            F.max(v).alias("high"),
        ]
    out = rows.groupBy(*group_by).agg(
        settled(result, 6).alias("value"),
        settled(F.avg(F.when(known, F.col("coverage"))), 6).alias("coverage"),
        settled(F.avg(F.when(known, F.col("confidence"))), 6).alias("confidence"),
        F.count(F.lit(1)).alias("population"),
        F.count(v).alias("included"),
        *more,
    )
    missing = F.col("population") - F.col("included")
    status = (
        F.when(F.col("included") == 0, "insufficient_data")
        .when((missing == 0) & (F.col("coverage") == 1), "available")
        .otherwise("partial")
    )
    out = out.withColumn("missing", missing).withColumn("status", status)
    return sort_limit(out, "value", group_by, descending, limit)


def sort_limit(
    df: DataFrame, metric: str, keys: list[str], descending: bool = True, limit: int | None = 100
) -> DataFrame:
    by = F.coalesce(F.col(metric), F.lit(-1))
    out = df.orderBy(by.desc() if descending else by.asc(), *keys)
    return out if limit is None else out.limit(limit)


def result_summary(rows: DataFrame) -> DataFrame:
    """One row over a metric query's rows: counts, mean quality, status."""
    s = rows.agg(
        F.sum("population").alias("population"),
        F.sum("included").alias("included"),
        F.sum("missing").alias("missing"),
        settled(F.avg("coverage"), 6).alias("coverage"),
        settled(F.avg("confidence"), 6).alias("confidence"),
        F.bool_and(F.col("status") == "available").alias("_all"),
        F.bool_or(F.col("status") != "insufficient_data").alias("_any"),
    )
    status = F.when(F.col("_all"), "available").when(F.col("_any"), "partial").otherwise("insufficient_data")
    return s.withColumn("status", status).drop("_all", "_any")


def explain_metrics(tall: DataFrame, population: DataFrame) -> DataFrame:
    """Per metric: population, included, missing, evidence. ``tall`` has a row
    per program and metric that is known; ``population`` a row per program."""
    n = population.agg(F.count_distinct("program_id").alias("population"))
    found = tall.groupBy("feature").agg(
        F.count("value").alias("included"), F.sum("evidence_count").alias("evidence_count")
    )
    # The count is a single row.
    return found.join(F.broadcast(n), F.lit(True)).withColumn("missing", F.col("population") - F.col("included"))


def metric_evidence(evidence: DataFrame, programs: DataFrame, codes: list[str]) -> DataFrame:
    return evidence.where(F.col("feature").isin(*codes)).join(programs, "program_id", "left_semi")


def rollup_query(rows: DataFrame, value: str = "value") -> DataFrame:
    """Means by university and direction with subtotals."""
    return rows.rollup("university_id", "direction_id").agg(
        settled(F.avg(value), 6).alias("value"), F.count(value).alias("included")
    )


def distinctive(df: DataFrame, k: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each key."""
    return df.withColumn(
        "place",
        F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ).where(F.col("place") <= k)
