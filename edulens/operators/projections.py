"""Program projections: workload, shares, features, timelines, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reference_data import activity_table
from ..functions.scalars import settled, shares_with_residual


def attach_disciplines(items: DataFrame, disciplines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their discipline, and the items whose discipline is missing."""
    return items.join(disciplines, "discipline_id"), items.join(disciplines, "discipline_id", "left_anti")


def workload(items: DataFrame) -> DataFrame:
    """Totals per program and the basis: hours, else credits, else normalized.
    Credits are null when no item states any."""
    totals = items.groupBy("program_id").agg(
        F.sum("hours").alias("total_hours"),
        F.sum("credits").alias("total_credits"),
        F.count(F.lit(1)).alias("course_count"),
    )
    basis = (
        F.when(F.col("total_hours") > 0, "hours").when(
            F.col("total_credits") > 0, "credits"
        ).otherwise("normalized_workload")
    )
    total = F.when(basis == "hours", F.col("total_hours")).otherwise(F.col("total_credits"))
    return totals.withColumn("basis", basis).withColumn("total_workload", total.cast("double"))


def item_workload(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Each item's load on its program's basis, and the program's total."""
    load = F.when(F.col("basis") == "hours", F.col("hours")).otherwise(F.coalesce("credits", F.lit(0)))
    return items.join(totals.select("program_id", "basis", "total_workload"), "program_id").withColumn(
        "load", load.cast("double")
    )


def area_load(loads: DataFrame, weights: DataFrame) -> DataFrame:
    """Load per program and area. Items of one discipline are summed first, so
    the join carries one row per program and discipline."""
    per = loads.groupBy("program_id", "discipline_id").agg(F.sum("load").alias("load"))
    return (
        per.join(weights, "discipline_id")
        .groupBy("program_id", "area")
        .agg(F.sum(F.col("load") * F.col("weight")).alias("area_load"))
    )


def area_share(loads: DataFrame, weights: DataFrame) -> DataFrame:
    return shares_with_residual(area_load(loads, weights), ["program_id"], "area_load", "area")


def activity_share(loads: DataFrame, weights: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """Shares of the activity signals. The matrix has 22 x 9 rows at most."""
    matrix = activity_table(loads.sparkSession) if matrix is None else matrix
    per = (
        area_load(loads, weights)
        .join(F.broadcast(matrix), "area")
        .groupBy("program_id", "activity")
        .agg(F.sum(F.col("area_load") * F.col("activity_weight")).alias("activity_load"))
    )
    return shares_with_residual(per, ["program_id"], "activity_load", "activity")


def semester_share(loads: DataFrame) -> DataFrame:
    term = F.coalesce(F.col("semester").cast("string"), F.lit("unassigned"))
    per = loads.groupBy("program_id", term.alias("semester")).agg(F.sum("load").alias("semester_load"))
    return shares_with_residual(per, ["program_id"], "semester_load", "semester")


def classify_features(disciplines: DataFrame, rules: DataFrame) -> DataFrame:
    """Best keyword rule per discipline and feature: value, then confidence,
    then the earlier rule. Rules are matched on distinct names only; their
    table is a fixed list of a few dozen rows."""
    names = disciplines.select("name").distinct()
    best = F.max_by(F.struct("value", "confidence", "rule"), F.struct("value", "confidence", -F.col("rule"))).alias("b")
    hits = (
        names.join(F.broadcast(rules), F.expr("contains(name, keyword)"))
        .groupBy("name", "feature")
        .agg(best)
        .select("name", "feature", "b.*")
    )
    return disciplines.select("discipline_id", "name").join(hits, "name").drop("name")


def unknown_features(disciplines: DataFrame, classified: DataFrame, features: list[str]) -> DataFrame:
    """Every discipline and feature; unmatched ones are ``unknown`` with nulls."""
    every = disciplines.select("discipline_id", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    out = every.join(classified, ["discipline_id", "feature"], "left")
    return out.withColumn("status", F.when(F.col("value").isNull(), "unknown").otherwise("available"))


def semantic_metrics(loads: DataFrame, features: DataFrame) -> DataFrame:
    """Per program and feature: value over the whole load, coverage, confidence
    over what is available. ``features(discipline_id, feature, value,
    confidence)``; null values and ``rejected`` reviews do not count."""
    if "review" in features.columns:
        features = features.where("review is null or review <> 'rejected'")
    per = loads.groupBy("program_id", "discipline_id").agg(
        F.sum("load").alias("load"), F.first("total_workload").alias("total"), F.count(F.lit(1)).alias("n")
    )
    return (
        per.join(features.where("value is not null"), "discipline_id")
        .groupBy("program_id", "feature")
        .agg(
            F.sum(F.col("load") * F.col("value")).alias("v"),
            F.sum(F.col("load") * F.col("confidence")).alias("c"),
            F.sum("load").alias("available"),
            F.first("total").alias("total"),
            F.sum("n").alias("evidence_count"),
        )
        .select(
            "program_id",
            "feature",
            settled(F.col("v") / F.col("total"), 6).alias("value"),
            settled(F.col("available") / F.col("total"), 6).alias("coverage"),
            settled(F.try_divide("c", "available"), 6).alias("confidence"),
            "evidence_count",
        )
    )


def feature_timeline(loads: DataFrame, features: DataFrame, force_unit: bool = False) -> DataFrame:
    """Share of a feature per semester, with the first semester that has it.
    Shares are of the program's load; ``force_unit`` scales them to 1."""
    per = (
        loads.join(features.where("value > 0"), "discipline_id")
        .groupBy(
            "program_id", "feature",
            F.coalesce(F.col("semester").cast("string"), F.lit("unassigned")).alias("semester")
        )
        .agg(
            F.sum(F.col("load") * F.col("value")).alias("part"),
            F.first("total_workload").alias("total"),
            F.min("semester").alias("first_semester"),
        )
    )
    if force_unit:
        return shares_with_residual(per, ["program_id", "feature"], "part", "semester")
    return per.withColumn("share", settled(F.col("part") / F.col("total"), 6))


def period_share(timeline: DataFrame, first_year_to: int = 2, late_from: int = 5) -> DataFrame:
    term = F.expr("try_cast(semester AS INT)")
    return timeline.groupBy("program_id", "feature").agg(
        settled(F.sum(F.when(term <= first_year_to, F.col("share")).otherwise(0)), 6).alias("first_year"),
        settled(F.sum(F.when(term >= late_from, F.col("share")).otherwise(0)), 6).alias("late_years"),
        F.min("first_semester").alias("first_semester"),
    )


def assessments(items: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Counts per assessment kind; ``kinds`` maps a mark to a column name."""
    return items.groupBy("program_id").agg(
        *[F.count_if(F.col("assessment") == mark).alias(name) for mark, name in kinds.items()]
    )


def select_basis(coverage: DataFrame, preferred: list[str], threshold: float = 0.8) -> DataFrame:
    """First basis of ``preferred`` whose coverage reaches the threshold; a
    count of courses is comparable at any coverage above 0."""
    picks = [
        F.when(
            F.col(b) > 0 if b == "course_count" else F.col(b) >= threshold,
            F.struct(F.lit(b).alias("b"), F.least(F.col(b), F.lit(1.0)).alias("c"))
        )
        for b in preferred
    ]
    chosen = F.coalesce(*picks)
    status = (
        F.when(chosen.isNull(), "insufficient_data")
        .when((chosen["c"] == 1) | (chosen["b"] == "course_count"), "available")
        .otherwise("partial")
    )
    best = F.greatest(*[F.coalesce(F.col(b), F.lit(0.0)) for b in preferred])
    return coverage.select(
        "program_id",
        chosen["b"].alias("basis"),
        F.coalesce(chosen["c"], best).alias("coverage"),
        status.alias("status"),
    )


def offering_metrics(offerings: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """A program's offering value, only if the filters leave exactly one."""
    kept = offerings if where is None else offerings.where(where)
    one = [F.when(F.count(c) == 1, F.max(c)).alias(c) for c in columns]
    return kept.groupBy("program_id").agg(*one)


def projection_quality(metrics: DataFrame, n_features: int) -> DataFrame:
    """Mean coverage over all features and confidence over available ones."""
    coverage = F.sum("coverage") / n_features
    return metrics.groupBy("program_id").agg(
        settled(coverage, 6).alias("coverage"),
        settled(F.avg(F.when(F.col("value").isNotNull(), F.col("confidence"))), 6).alias("confidence"),
        F.when(coverage >= 1, "available").when(coverage > 0, "partial").otherwise("insufficient_data").alias("status"),
    )


def build_projections(items: DataFrame, weights: DataFrame, features: DataFrame) -> DataFrame:
    """One wide row per program with maps of shares and metrics."""
    totals = workload(items)
    loads = item_workload(items, totals)

    def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(key, value)))
        return df.groupBy("program_id").agg(F.map_from_entries(pairs).alias(name))

    out = totals
    for part in (
        as_map(area_share(loads, weights), "area", "share", "area_share"),
        as_map(activity_share(loads, weights), "activity", "share", "activity_share"),
        as_map(semester_share(loads), "semester", "share", "semester_share"),
        as_map(semantic_metrics(loads, features), "feature", "value", "semantic"),
    ):
        out = out.join(part, "program_id", "left")
    return out
