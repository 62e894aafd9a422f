"""Constraint outcomes, candidate partitions, shortlists and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def constraint_outcomes(offerings: DataFrame, constraints: DataFrame) -> DataFrame:
    """``constraints(request_id, field, value)`` against every program's
    offerings: true if any matches, insufficient if none does but some value
    is unknown, else false."""
    tall = offerings.select(
        "program_id",
        F.inline(
            F.array(
                F.struct(F.lit("year").alias("field"), F.col("admission_year").cast("string").alias("actual")),
                F.struct(F.lit("form").alias("field"), F.col("study_form").alias("actual")),
                F.struct(F.lit("funding").alias("field"), F.col("funding_type").alias("actual")),
            )
        ),
    )
    facts = tall.groupBy("program_id", "field", "actual").agg(F.count(F.lit(1)).alias("n"))
    j = constraints.join(facts, "field")
    match = F.coalesce(F.col("actual") == F.col("value"), F.lit(False))
    per = j.groupBy("request_id", "program_id", "field").agg(
        F.bool_or(match).alias("m"), F.bool_or(F.col("actual").isNull()).alias("u")
    )
    outcome = F.when(F.col("m"), "satisfied").when(F.col("u"), "insufficient_data").otherwise("violated")
    return per.select("request_id", "program_id", "field", outcome.alias("outcome"))


def tuition_outcome(offerings: DataFrame, limits: DataFrame) -> DataFrame:
    """Cheapest paid offering that fits against ``limits(request_id, max_tuition)``:
    ``not_applicable`` without a paid one, ``insufficient_data`` without a
    price in RUB."""
    paid = offerings.where("funding_type <> 'budget'")
    price = F.when(F.col("currency") == "RUB", F.col("tuition"))
    per = offerings.select("program_id").distinct().join(
        paid.groupBy("program_id").agg(
            F.min(price).alias("cheapest"), F.count(F.lit(1)).alias("n")
        ), "program_id", "left"
    )
    outcome = (
        F.when(F.col("n").isNull(), "not_applicable")
        .when(F.col("cheapest").isNull(), "insufficient_data")
        .when(F.col("cheapest") <= F.col("max_tuition"), "satisfied")
        .otherwise("violated")
    )
    return per.join(limits).select("request_id", "program_id", "cheapest", outcome.alias("outcome"))


def drop_chosen(programs: DataFrame, *chosen: DataFrame) -> DataFrame:
    for c in chosen:
        programs = programs.join(c, ["request_id", "program_id"], "left_anti")
    return programs


def partition_candidates(
    scored: DataFrame, primary: int = 3, alternatives: int = 2, diagnostics: int = 20
) -> DataFrame:
    """Each candidate's part: ``primary``, ``alternative``, ``insufficient`` or
    ``ineligible``. The usable ones are ranked by fit; the others are cut to
    ``diagnostics`` a request, which is what the report shows."""
    kind = (
        F.when((F.col("fit_status") == "unlikely") | F.col("violated"), "ineligible")
        .when((F.col("fit_status") == "insufficient_data") | F.col("insufficient"), "insufficient")
        .otherwise("usable")
    )
    w = Window.partitionBy("request_id", "kind").orderBy(F.col("content_fit").desc_nulls_last(), "program_id")
    out = scored.withColumn("kind", kind).withColumn("n", F.row_number().over(w))
    part = F.when(F.col("kind") != "usable", F.col("kind")).when(F.col("n") <= primary, "primary").when(
        F.col("n") <= primary + alternatives, "alternative"
    )
    kept = F.when(F.col("kind") == "usable", F.col("n") <= primary + alternatives).otherwise(F.col("n") <= diagnostics)
    return out.withColumn("part", part).where(kept).drop("kind")


def suggest(requests: DataFrame, fits: DataFrame, outcomes: DataFrame, admission: DataFrame) -> DataFrame:
    """Shortlist per request from content fit, constraint outcomes and admission
    fit, with how complete the facts behind it are."""
    per = outcomes.groupBy("request_id", "program_id").agg(
        F.bool_or(F.col("outcome") == "violated").alias("violated"),
        F.bool_or(F.col("outcome") == "insufficient_data").alias("insufficient"),
        F.count_if(F.col("outcome") == "satisfied").alias("satisfied"),
    )
    j = requests.join(fits, "profile_id").join(per, ["request_id", "program_id"], "left").join(
        admission.select(
            "applicant_id", "program_id", F.col("status").alias("fit_status")
        ), ["applicant_id", "program_id"], "left"
    )
    j = j.withColumns(
        {"violated": F.coalesce("violated", F.lit(False)), "insufficient": F.coalesce("insufficient", F.lit(False))}
    )
    facts = F.array(F.col("content_fit").isNotNull(), F.col("fit_status").isNotNull(), F.col("satisfied").isNotNull())
    complete = F.size(F.filter(facts, lambda x: x)) / F.size(facts)
    return partition_candidates(j.withColumn("completeness", F.round(complete, 4)))


def plan_steps(recommendations: DataFrame, events: DataFrame, now) -> DataFrame:
    """Numbered steps of a plan: explore the first program, compare the first
    two, then the linked events to come, by start."""
    explore = recommendations.where("place = 1").select(
        "profile_id", F.lit(1).alias("o"), F.lit("explore").alias("step"),
        F.col("program_id").cast("string").alias("what"), F.lit(None).cast("timestamp").alias("starts_at")
    )
    pair = recommendations.where("place <= 2").groupBy("profile_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", "program_id"))), lambda s: s["program_id"].cast("string")
            ),
            ","
        ).alias("what"),
        F.count(F.lit(1)).alias("n")
    )
    compare = pair.where("n = 2").select(
        "profile_id", F.lit(2).alias("o"), F.lit("compare").alias("step"), "what",
        F.lit(None).cast("timestamp").alias("starts_at")
    )
    linked = recommendations.join(
        events.where(F.col("starts_at") > now), "program_id"
    ).groupBy("profile_id", "event_id").agg(F.min("starts_at").alias("starts_at"))
    attend = linked.select(
        "profile_id", F.lit(3).alias("o"), F.lit("attend").alias("step"),
        F.col("event_id").cast("string").alias("what"), "starts_at"
    )
    w = Window.partitionBy("profile_id").orderBy("o", "starts_at", "what")
    return explore.unionByName(compare).unionByName(attend).withColumn("step_number", F.row_number().over(w)).drop("o")


def personal_plan(recommendations: DataFrame, events: DataFrame, links: DataFrame, now) -> DataFrame:
    """``plan_steps`` with the place of each event to attend: ``point_id`` and
    whether it has one (null for steps that are no event)."""
    steps = plan_steps(recommendations, events.join(links, "event_id"), now)
    at = events.select(
        F.col("event_id").cast("string").alias("what"), F.lit("attend").alias("step"), "point_id"
    ).distinct()
    out = steps.join(at, ["step", "what"], "left")
    return out.withColumn("has_point", F.when(F.col("step") == "attend", F.col("point_id").isNotNull()))


def candidate_snapshot(
    programs: DataFrame, fingerprints: DataFrame, offerings: DataFrame, universities: DataFrame
) -> DataFrame:
    """Every program with what is known of it; ``repeated`` marks programs with
    more than one fingerprint, which are not to be used."""
    f = fingerprints.groupBy("program_id").agg(
        F.count(F.lit(1)).alias("n_fingerprints"), F.min("fingerprint").alias("fingerprint")
    )
    o = offerings.groupBy("program_id").agg(F.count(F.lit(1)).alias("n_offerings"))
    out = programs.join(f, "program_id", "left").join(o, "program_id", "left").join(
        universities, "university_id", "left"
    )
    return out.withColumn("repeated", F.coalesce(F.col("n_fingerprints") > 1, F.lit(False)))


def decision_state(events: DataFrame) -> DataFrame:
    """State per owner after all decision events, in order.

    ``events(owner_key, seq, action, program_id)``; actions add, remove,
    exclude, restore, choose. A fold per owner: illegal actions (adding an
    excluded program, removing or choosing one not on the list) change
    nothing but are counted.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "action", "program_id")))
    zero = F.struct(
        F.array().cast("array<bigint>").alias("shortlist"),
        F.array().cast("array<bigint>").alias("excluded"),
        F.lit(None).cast("bigint").alias("choice"),
        F.lit(0).alias("revision"),
        F.lit(0).alias("rejected"),
    )

    def fold(s, e):
        p, on = e["program_id"], F.array_contains(s["shortlist"], e["program_id"])
        out = F.array_contains(s["excluded"], p)
        a = e["action"]
        ok = (
            ((a == "add") & ~on & ~out) | ((a == "remove") & on) | ((a == "exclude") & ~out) | ((a == "restore") & out) | ((a == "choose") & on)
        )
        short = F.when(ok & (a == "add"), F.array_append(s["shortlist"], p)).when(
            ok & a.isin("remove", "exclude"), F.array_remove(s["shortlist"], p)
        ).otherwise(s["shortlist"])
        excl = F.when(
            ok & (a == "exclude"), F.array_append(s["excluded"], p)
        ).when(ok & (a == "restore"), F.array_remove(s["excluded"], p)).otherwise(s["excluded"])
        gone = ok & a.isin("remove", "exclude") & (s["choice"] == p)
        choice = F.when(ok & (a == "choose"), p).when(
            F.coalesce(gone, F.lit(False)), F.lit(None).cast("bigint")
        ).otherwise(s["choice"])
        return F.struct(
            short.alias("shortlist"), excl.alias("excluded"), choice.alias("choice"),
            (s["revision"] + ok.cast("int")).alias("revision"), (s["rejected"] + (~ok).cast("int")).alias("rejected"),
        )

    return events.groupBy("owner_key").agg(F.aggregate(ordered, zero, fold).alias("s")).select("owner_key", "s.*")
