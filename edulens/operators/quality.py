"""Validation, quality gates and reports over canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import follow_chains

LOW_CONFIDENCE = 0.80


def validate(programs: DataFrame, weights: DataFrame, scores: DataFrame) -> DataFrame:
    """Violations ``(check_name, key)``: repeated program ids, weights that do
    not sum to 1, numeric scores without a number or the other way round."""
    repeated = programs.groupBy("program_id").count().where("count > 1")
    uneven = weights.groupBy("discipline_id").agg(
        F.sum(F.col("weight").cast("decimal(12,4)")).alias("s")
    ).where("s <> 1")
    odd = scores.where("(status = 'numeric') <> (score is not null)")
    return (
        repeated.select(F.lit("repeated_program").alias("check_name"), F.col("program_id").cast("string").alias("key"))
        .unionByName(
            uneven.select(
                F.lit("weights_not_one").alias("check_name"), F.col("discipline_id").cast("string").alias("key")
            )
        )
        .unionByName(
            odd.select(F.lit("score_status").alias("check_name"), F.col("score_id").cast("string").alias("key"))
        )
    )


def ratio(part: Column, whole: Column) -> Column:
    """Nothing expected counts as complete."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def identity_continuity(cur: DataFrame, prev: DataFrame, key: str) -> DataFrame:
    """Share of previous identities that are still there."""
    p, c = prev.select(key).distinct(), cur.select(key).distinct()
    both = p.join(c.withColumn("_here", F.lit(1)), key, "left")
    return both.agg(
        F.round(ratio(F.count("_here"), F.count(F.lit(1))), 6).alias("continuity"), F.count(F.lit(1)).alias("previous")
    )


def quality_gate(measures: DataFrame, blocking: dict[str, float], degradable: dict[str, float]) -> DataFrame:
    """Decision per snapshot row of ratios: ``rejected`` if a blocking measure
    is below its floor, ``degraded`` if another is, else ``passed``."""

    def below(floors: dict[str, float]) -> Column:
        return F.array_compact(F.array(*[F.when(F.coalesce(F.col(m), F.lit(0.0)) < x, m) for m, x in floors.items()]))

    out = measures.withColumn("blocking", below(blocking)).withColumn("degrading", below(degradable))
    decision = (
        F.when(F.size("blocking") > 0, "rejected").when(F.size("degrading") > 0, "degraded").otherwise("passed")
    )
    return (
        out.withColumn("decision", decision)
        .withColumn("blocking", F.array_join("blocking", ","))
        .withColumn("degrading", F.array_join("degrading", ","))
    )


def probe(measures: DataFrame, blocking: dict[str, float], degradable: dict[str, float]) -> DataFrame:
    """Health of each source by the gate's own rules, with nothing written:
    whether it would be published, whether anything is below its floor, and what."""
    gated = quality_gate(measures, blocking, degradable)
    problems = F.concat_ws(",", F.nullif(F.col("blocking"), F.lit("")), F.nullif(F.col("degrading"), F.lit("")))
    keys = [c for c in measures.columns if c not in (*blocking, *degradable, "programs")]
    return gated.select(
        *keys, (
            F.col("decision") != "rejected"
        ).alias("healthy"), (F.col("decision") != "passed").alias("needs_attention"),
        F.nullif(problems, F.lit("")).alias("problems"),
    )


def snapshot_measures(
    programs: DataFrame, items: DataFrame, offerings: DataFrame, features: DataFrame, by: str
) -> DataFrame:
    """Coverage ratios of a snapshot, one row per ``by``."""
    has = {"curriculum": items, "admission": offerings}
    out = programs
    for name, df in has.items():
        out = out.join(df.select("program_id").distinct().withColumn(f"_{name}", F.lit(1)), "program_id", "left")
    known = items.select("program_id", "discipline_id").distinct()
    covered = known.join(
        features.select("discipline_id").distinct().withColumn("_f", F.lit(1)), "discipline_id", "left"
    )
    tax = covered.groupBy("program_id").agg(F.count(F.lit(1)).alias("_n"), F.count("_f").alias("_k"))
    out = out.join(tax, "program_id", "left")
    n = F.count(F.lit(1))
    return out.groupBy(by).agg(
        n.alias("programs"),
        F.round(ratio(F.count("_curriculum"), n), 6).alias("curriculum_coverage"),
        F.round(ratio(F.count("_admission"), n), 6).alias("admission_coverage"),
        F.round(
            ratio(F.coalesce(F.sum("_k"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))), 6
        ).alias("taxonomy_coverage"),
    )


def taxonomy_metrics(outcomes: DataFrame, items: DataFrame) -> DataFrame:
    """Counts over classification outcomes ``(discipline_id, name, area, method)``:
    per method, repeated and conflicting names, programs they touch."""
    per_name = outcomes.groupBy("name").agg(
        F.count(F.lit(1)).alias("variants"), F.count_distinct("area").alias("areas")
    )
    names = per_name.agg(
        F.sum(F.greatest(F.lit(0), F.col("variants") - 1)).alias("duplicate_keys"),
        F.count_if(F.col("areas") > 1).alias("conflicting_names"),
    )
    open_ = outcomes.where("method = 'unresolved'").select("discipline_id")
    touched = items.join(open_, "discipline_id", "left_semi").agg(
        F.count_distinct("program_id").alias("unresolved_programs")
    )
    totals = outcomes.agg(
        F.count(F.lit(1)).alias("disciplines"),
        F.count_if(F.col("method") == "keyword").alias("by_keyword"),
        F.count_if(F.col("method") == "unresolved").alias("unresolved"),
        F.round(F.avg((F.col("method") != "unresolved").cast("double")), 6).alias("coverage"),
    )
    return totals.crossJoin(names).crossJoin(touched)  # single rows


def disciplines_per_area(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("area").agg(F.count_distinct("discipline_id").alias("disciplines"))


def provenance_report(df: DataFrame, snapshots: DataFrame, table: str) -> DataFrame:
    """Rows without a snapshot, run, locator or known source, for one table."""
    seen = snapshots.select(F.col("snapshot_id").alias("_id")).distinct().withColumn("_seen", F.lit(1))
    j = df.join(seen, df["snapshot_id"] == F.col("_id"), "left")
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return j.agg(
        F.lit(table).alias("table_name"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_seen").isNull()).alias("missing_snapshot"),
        F.count_if(F.col("run_id").isNull()).alias("missing_run"),
        F.count_if(blank("locator")).alias("missing_locator"),
    )


def semantic_quality(values: DataFrame) -> DataFrame:
    usable = F.col("value").isNotNull() & ~F.coalesce(F.col("review") == "rejected", F.lit(False))
    n = F.count(F.lit(1))
    return values.agg(
        n.alias("n_values"),
        F.count_if(usable).alias("available"),
        F.count_if(F.col("value").isNull()).alias("unresolved"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"),
        F.count_if(F.col("review") == "rejected").alias("rejected"),
        F.round(F.count_if(usable) / n, 6).alias("available_rate"),
    )


def unknown_queue(outcomes: DataFrame, items: DataFrame) -> DataFrame:
    """Unresolved names with how often and in how many programs they occur."""
    open_ = outcomes.where("method = 'unresolved'").select("discipline_id", "name")
    per = items.groupBy("program_id", "discipline_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("captured_at").alias("first"), F.max("captured_at").alias("last")
    )
    return (
        per.join(open_, "discipline_id")
        .groupBy("name")
        .agg(
            F.sum("n").alias("occurrences"),
            F.array_join(F.array_sort(F.collect_set("program_id")), ",").alias("programs"),
            F.min("first").alias("first_seen"),
            F.max("last").alias("last_seen"),
        )
    )


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """Follow ``(alias, target)`` chains of any length: final target, steps, and
    whether the chain runs into a cycle (target null)."""
    pick = aliases.groupBy("alias").agg(
        F.min("target").alias("target"), (F.count_distinct("target") > 1).alias("conflicting")
    )
    ends = follow_chains(pick, "alias", "target")
    out = pick.select("alias", "conflicting").join(ends, F.col("alias").eqNullSafe(F.col("node")))
    return out.select(
        "alias", F.when(
            ~F.col("cyclic"), F.col("target")
        ).alias("target"), F.when(~F.col("cyclic"), F.col("steps")).alias("steps"), "cyclic", "conflicting"
    )


def release_report(rules: DataFrame) -> DataFrame:
    """Rules per route, benefit and status, with what blocks their release."""
    return rules.groupBy(F.concat_ws(":", "route", "benefit_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "review").alias("review"),
        F.count_if(F.col("status") == "stale").alias("stale"),
        F.count_if(
            F.col("target_subject").isNull() & (F.col("benefit_type") == "hundred_points")
        ).alias("missing_subject"),
        F.count_if(F.col("confirmation").isNull()).alias("missing_confirmation"),
    )
