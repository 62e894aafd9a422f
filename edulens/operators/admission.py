"""Admission fit of applicants with offerings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights and thresholds of the admission fit.
MINIMUM_PART, PASSING_PART, COMPLETENESS_PART = 0.50, 0.35, 0.15
BORDERLINE_RATIO, REALISTIC, BORDERLINE = 85.0, 80, 55


def pick_offering(programs: DataFrame, offerings: DataFrame, year=None, form=None, funding=None) -> DataFrame:
    """The one offering of each program that fits; none or several are a gap."""
    kept = offerings
    for c, v in (("admission_year", year), ("study_form", form), ("funding_type", funding)):
        kept = kept if v is None else kept.where(F.col(c) == v)
    per = kept.groupBy("program_id").agg(F.count(F.lit(1)).alias("n"), F.min("offering_id").alias("only"))
    out = programs.select("program_id").join(per, "program_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        "program_id",
        n.alias("n_offerings"),
        F.when(n == 1, F.col("only")).alias("offering_id"),
        F.when(n == 0, "offering_missing").when(n > 1, "offering_ambiguous").alias("gap"),
    )


def match_exam_scores(exams: DataFrame, scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exams of each (applicant, offering) pair with the applicant's score:
    matched, missing, or ambiguous where several scores have the subject."""
    per = scores.groupBy("applicant_id", "subject").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    j = pairs.join(exams, "offering_id").join(per, ["applicant_id", "subject"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return j.withColumn("resolution", status).withColumn("score", F.when(F.col("n") == 1, F.col("score"))).drop("n")


def select_cutoff(passing: DataFrame, offerings: DataFrame) -> DataFrame:
    """Numeric general cutoff of an offering: of its own funding type, else an
    average or other one, else none."""
    ok = passing.where("status = 'numeric' and competition_type = 'general' and score is not null")
    j = ok.join(offerings.select("offering_id", "funding_type"), "offering_id")
    rank = F.when(F.col("score_type") == F.col("funding_type"), 0).when(F.col("score_type").isin("average", "other"), 1)
    w = Window.partitionBy("offering_id").orderBy("rank", "score")
    return (
        j.withColumn("rank", rank).where("rank is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
        .select("offering_id", F.col("score").alias("cutoff"), "score_type")
    )


def percent(ratio: Column) -> Column:
    """Two places, half up, held to [0, 100]."""
    return F.round(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)) * 100, 8), 2)


def admission_fit(matched: DataFrame, offerings: DataFrame) -> DataFrame:
    """Score, status and data quality per (applicant, offering).

    ``matched`` comes from match_exam_scores, ``offerings`` has the cutoff.
    One shuffle on (applicant, offering); offerings join as they are sized.
    """
    keys = ["applicant_id", "offering_id"]
    known = F.col("score").isNotNull()
    minimum = F.col("minimum_score")
    ratio = F.when(
        known & minimum.isNotNull(),
        F.when(minimum == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("score") / minimum))
    )
    per = matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("n_known"),
        F.count("minimum_score").alias("n_minimum"),
        F.count(ratio).alias("n_ratio"),
        F.avg(ratio).alias("ratio"),
        F.sum("score").alias("total"),
        F.coalesce(F.bool_or(F.col("score") < minimum), F.lit(False)).alias("failed"),
    )
    j = per.join(offerings.select("offering_id", "cutoff"), "offering_id")
    a = F.when(F.col("n_ratio") > 0, percent(F.col("ratio")))
    b = F.when(
        F.col("cutoff").isNotNull() & (F.col("n_known") > 0),
        percent(F.when(F.col("cutoff") == 0, 0.0).otherwise(F.col("total") / F.col("cutoff"))),
    )
    c = percent(F.col("n_known") / F.col("n"))
    j = j.withColumns({"minimum_readiness": a, "passing_readiness": b, "data_completeness": c})
    parts = [
        ("minimum_readiness", MINIMUM_PART), ("passing_readiness", PASSING_PART),
        ("data_completeness", COMPLETENESS_PART)
    ]
    top = sum((F.coalesce(F.col(x) * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    bottom = sum((F.when(F.col(x).isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    j = j.withColumn("fit_score", F.round(F.round(top / bottom, 8)).cast("int"))
    passing = F.col("passing_readiness")
    status = (
        F.when(F.col("failed"), "unlikely")
        .when(F.col("minimum_readiness").isNull() & passing.isNull(), "insufficient_data")
        .when(F.col("n_known") < F.col("n"), "insufficient_data")
        .when(passing < BORDERLINE_RATIO, "unlikely")
        .when(passing < 100, "borderline")
        .when(F.col("fit_score") >= REALISTIC, "realistic")
        .when(F.col("fit_score") >= BORDERLINE, "borderline")
        .otherwise("unlikely")
    )
    some = F.col("minimum_readiness").isNotNull() | passing.isNotNull()
    quality = F.when((F.col("n_known") == F.col("n")) & some, "complete").otherwise("partial")
    return j.withColumn("status", status).withColumn("data_quality", quality).select(
        *keys, "fit_score", "status", "data_quality", "minimum_readiness", "passing_readiness", "data_completeness", F.col("total").alias("applicant_total")
    )


def exam_reasons(matched: DataFrame) -> DataFrame:
    """Per exam: meets, below, no_minimum, or a gap."""
    kind = (
        F.when(F.col("resolution") != "matched", F.concat(F.lit("gap_"), F.col("resolution")))
        .when(F.col("minimum_score").isNull(), "no_minimum")
        .when(F.col("score") >= F.col("minimum_score"), "meets_minimum")
        .otherwise("below_minimum")
    )
    return matched.select("applicant_id", "offering_id", "subject", kind.alias("reason"))


def fit_summary(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("results"), F.count_if(F.col("status") == "insufficient_data").alias("insufficient")
    )


def admission_fit_batch(
    applicants: DataFrame, programs: DataFrame, offerings: DataFrame, exams: DataFrame, **filters
) -> tuple[DataFrame, DataFrame]:
    """Fit of every applicant with the one fitting offering of every program,
    and the programs that are gaps."""
    picked = pick_offering(programs, offerings, **filters)
    chosen = picked.where("offering_id is not null").select("program_id", "offering_id")
    pairs = applicants.select("applicant_id").distinct().join(chosen)
    matched = match_exam_scores(exams, applicants, pairs)
    return admission_fit(
        matched,
        offerings.join(chosen, ["program_id", "offering_id"], "left_semi")
    ), picked.where("gap is not null")


def latest_year(offerings: DataFrame, form: str, funding: str) -> DataFrame:
    kept = offerings.where((F.col("study_form") == form) & (F.col("funding_type") == funding))
    return kept.groupBy("program_id").agg(F.max("admission_year").alias("latest_year"))
