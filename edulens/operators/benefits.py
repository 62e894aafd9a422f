"""Admission benefits: eligibility, confirmation, achievements, final score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUS_ORDER = ("insufficient_data", "not_eligible", "review_required", "eligible")


def rule_scope(rules: DataFrame, targets: DataFrame, programs: DataFrame) -> DataFrame:
    """Verdict of each rule for each program of its university.

    ``targets(rule_id, mode, kind, value, excluded)``; kinds ``program`` and
    ``direction``, mode ``all``, ``only`` or ``except``. A null value is an
    unresolved target and asks for review.
    """
    t = targets.select("rule_id", "kind", "value")
    unresolved = t.where(
        "kind is not null and value is null"
    ).select("rule_id").distinct().withColumn("open", F.lit(True))
    named = []  # programs that a target names, found by the target's own value
    for kind, column in (("program", "program_id"), ("direction", "direction_id")):
        own = programs.select("program_id", F.col(column).cast("string").alias("value"))
        named.append(t.where(F.col("kind") == kind).join(own, "value").select("rule_id", "program_id"))
    hits = named[0].unionByName(named[1]).distinct().withColumn("hit", F.lit(True))
    own = rules.select("rule_id", "university_id", "mode").join(unresolved, "rule_id", "left")
    pairs = own.join(
        programs.select("program_id", "university_id"), "university_id"
    ).join(hits, ["rule_id", "program_id"], "left")
    hit = pairs.withColumns({"hit": F.coalesce("hit", F.lit(False)), "open": F.coalesce("open", F.lit(False))})
    verdict = (
        F.when(F.col("mode") == "all", "applies")
        .when(F.col("open") & ~F.col("hit"), "review_required")
        .when(F.col("mode") == "only", F.when(F.col("hit"), "applies").otherwise("outside"))
        .otherwise(F.when(F.col("hit"), "outside").otherwise("applies"))
    )
    return hit.select("rule_id", "program_id", verdict.alias("scope"))


def alike(programs: DataFrame, targets: DataFrame) -> DataFrame:
    """``programs(program_id, university_id, direction_id, stands_for)``: one of
    each group that every rule treats alike, with the size of the group.

    A program that a target names stands alone. Others of a university go
    together by direction where a target names that, and all the rest is one
    group. What holds for some program, or counts programs, follows from these.
    """
    t = targets.where("value is not null")
    by = lambda kind: t.where(F.col("kind") == kind).select(F.col("value").alias(f"_{kind}")).distinct()
    p = programs.select("program_id", "university_id", "direction_id")
    p = p.join(by("program"), F.col("program_id").cast("string") == F.col("_program"), "left")
    p = p.join(by("direction"), F.col("direction_id").cast("string") == F.col("_direction"), "left")
    p = p.withColumn("_direction", F.when(F.col("_program").isNull(), F.col("_direction")))
    return p.groupBy("university_id", "_program", "_direction").agg(
        F.min(F.struct("program_id", "direction_id")).alias("p"), F.count_distinct("program_id").alias("stands_for")
    ).select("p.program_id", "university_id", "p.direction_id", "stands_for")


def rules_for_programs(rules: DataFrame, scoped: DataFrame, with_review: bool = False) -> DataFrame:
    kept = scoped.where(F.col("scope").isin(*(["applies", "review_required"] if with_review else ["applies"])))
    return rules.join(kept, "rule_id")


def rules_for_olympiad(rules: DataFrame, targets: DataFrame, programs: DataFrame) -> DataFrame:
    """Per olympiad: how many rules and programs it opens, by groups of programs
    that are ``alike``."""
    groups = alike(programs, targets)
    scoped = rule_scope(rules, targets, groups).where("scope = 'applies'")
    held = rules.select("olympiad_id", "rule_id").join(scoped, "rule_id").select("olympiad_id", "program_id").distinct()
    opened = held.join(groups.select("program_id", "stands_for"), "program_id").groupBy("olympiad_id").agg(
        F.sum("stands_for").alias("programs")
    )
    own = rules.groupBy("olympiad_id").agg(F.count_distinct("rule_id").alias("rules"))
    return own.join(opened, "olympiad_id", "left").withColumn("programs", F.coalesce("programs", F.lit(0)))


def confirm(facts: DataFrame, needed: DataFrame, scores: DataFrame) -> DataFrame:
    """Whether a fact is confirmed by an exam: per (fact, rule) ``confirmed``
    if any listed subject has the score, ``not_confirmed`` if all known ones
    fall short, ``missing_score`` if none is known, ``not_required`` if the
    rule lists none."""
    j = facts.join(needed, "rule_id", "left").join(scores, ["applicant_id", "subject"], "left")
    per = j.groupBy("applicant_id", "fact_id", "rule_id").agg(
        F.coalesce(F.bool_or(F.col("score") >= F.col("threshold")), F.lit(False)).alias("yes"),
        F.count("score").alias("known"),
        F.count("threshold").alias("listed"),
    )
    state = (
        F.when(
            F.col("listed") == 0, "not_required"
        ).when(F.col("yes"), "confirmed").when(F.col("known") > 0, "not_confirmed").otherwise("missing_score")
    )
    return per.select("applicant_id", "fact_id", "rule_id", state.alias("confirmation"))


def benefit_outcomes(facts: DataFrame, rules: DataFrame, scoped: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``(applicant_id, program_id, rule_id, route, outcome, rank)`` of every rule
    that a fact meets on its olympiad."""
    level = F.col("level") <= F.col("max_level")
    j = facts.join(rules.drop("university_id", "mode"), "olympiad_id")
    j = j.join(confirmed, ["applicant_id", "fact_id", "rule_id"], "left").join(scoped, "rule_id")
    fresh = F.col("result_year") >= F.col("min_year")
    status = (
        F.when(F.col("status") != "active", "review_required")
        .when((F.col("scope") == "outside") | ~level | ~fresh, "not_eligible")
        .when(F.col("scope") == "review_required", "review_required")
        .when(F.col("confirmation") == "missing_score", "insufficient_data")
        .when(F.col("confirmation") == "not_confirmed", "not_eligible")
        .when(F.col("route") == "special", "review_required")
        .otherwise("eligible")
    )
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("outcome"))
    return j.withColumn("outcome", status).withColumn("rank", rank)


def best_outcome():
    """Of the rules for a program the one with the best outcome, admission without
    exams first, then by id."""
    return F.max_by(
        F.struct("route", "rule_id", "outcome"),
        F.struct("rank", (F.col("route") == "bvi").alias("b"), (-F.col("rule_id")).alias("r"))
    ).alias("b")


def benefit_eligibility(facts: DataFrame, rules: DataFrame, scoped: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Best outcome per (applicant, program), with the route of the best rule
    (admission without exams first). Facts and rules meet on the olympiad."""
    return (
        benefit_outcomes(facts, rules, scoped, confirmed)
        .groupBy("applicant_id", "program_id").agg(best_outcome(), F.count_distinct("rule_id").alias("rules_seen"))
        .select(
            "applicant_id", "program_id", F.col("b.outcome").alias("status"), F.col("b.route").alias("route"),
            F.col("b.rule_id").alias("rule_id"), "rules_seen"
        )
    )


def best_rules(
    facts: DataFrame, rules: DataFrame, targets: DataFrame, programs: DataFrame, confirmed: DataFrame
) -> DataFrame:
    """Distinct ``(applicant_id, status, route, rule_id)`` of ``benefit_eligibility``:
    the rules that are best for some program, found on groups of programs that
    are ``alike``, so rows grow with applicants and groups and not with programs."""
    scoped = rule_scope(rules, targets, alike(programs, targets))
    best = benefit_outcomes(facts, rules, scoped, confirmed).groupBy("applicant_id", "program_id").agg(best_outcome())
    return best.select("applicant_id", F.col("b.outcome").alias("status"), "b.route", "b.rule_id").distinct()


def hundred_points(matched: DataFrame, rights: DataFrame) -> DataFrame:
    """Exam scores with 100 where an accepted right names the subject."""
    r = rights.select("applicant_id", "subject").distinct().withColumn("_full", F.lit(100.0))
    return matched.join(r, ["applicant_id", "subject"], "left").withColumn(
        "effective", F.coalesce("_full", "score")
    ).drop("_full")


def best_choice_exams(exams: DataFrame) -> DataFrame:
    """Best valid scores of each choice group: up to ``group_max``, and only if
    ``group_min`` are valid."""
    keys = ["applicant_id", "offering_id", "group_id"]
    w = Window.partitionBy(*keys).orderBy(F.col("effective").desc(), "subject")
    ok = exams.where("effective is not null and (minimum_score is null or effective >= minimum_score)")
    ranked = ok.withColumn("n", F.row_number().over(w)).withColumn(
        "valid", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )
    return ranked.where("n <= group_max and valid >= group_min")


def dedupe_achievements(facts: DataFrame) -> DataFrame:
    """First fact per (code, year) in source order, then the best per combination."""
    a = Window.partitionBy("applicant_id", "code", "year").orderBy("place")
    b = Window.partitionBy("applicant_id", "combination").orderBy(F.col("points").desc(), "place", "code", "year")
    once = facts.withColumn("_n", F.row_number().over(a)).where("_n = 1")
    ranked = once.withColumn("_n", F.when(F.col("combination").isNull(), 1).otherwise(F.row_number().over(b)))
    return ranked.where("_n = 1").drop("_n")


def apply_caps(awards: DataFrame, global_cap: float) -> DataFrame:
    """Points after a cap per category and one over all, used up in source order."""
    cat = Window.partitionBy("applicant_id", "category").orderBy("place", "code", "year").rowsBetween(
        Window.unboundedPreceding, -1
    )
    all_ = Window.partitionBy("applicant_id").orderBy("place", "code", "year").rowsBetween(
        Window.unboundedPreceding, -1
    )
    used = F.least(F.col("category_cap"), F.coalesce(F.sum("points").over(cat), F.lit(0.0)))
    inner = awards.withColumn("in_category", F.least("points", F.greatest(F.lit(0.0), F.col("category_cap") - used)))
    spent = F.coalesce(F.sum("in_category").over(all_), F.lit(0.0))
    return inner.withColumn("award", F.least("in_category", F.greatest(F.lit(0.0), F.lit(global_cap) - spent)))


def achievements(facts: DataFrame, rules: DataFrame, global_cap: float = 10.0) -> DataFrame:
    """Awarded points of each proven achievement, after dedup and caps."""
    j = facts.where("evidence").join(rules, "code")
    return apply_caps(dedupe_achievements(j), global_cap)


def competitive_score(matched: DataFrame, awards: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """Total of effective scores and awarded points per (applicant, offering):
    ``failed`` below a minimum, ``partial`` with a score missing, and
    ``not_applicable`` for applicants admitted without exams."""
    keys = ["applicant_id", "offering_id"]
    per = matched.groupBy(*keys).agg(
        F.sum("effective").alias("exam_points"),
        F.coalesce(F.bool_or(F.col("effective") < F.col("minimum_score")), F.lit(False)).alias("failed"),
        F.count_if(F.col("effective").isNull()).alias("missing"),
    )
    extra = awards.groupBy("applicant_id").agg(F.sum("award").alias("bonus"))
    out = per.join(extra, "applicant_id", "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    bvi = F.lit(False)
    if eligible is not None:
        free = eligible.where(
            "status = 'eligible' and route = 'bvi'"
        ).select("applicant_id").distinct().withColumn("_bvi", F.lit(True))
        out, bvi = out.join(free, "applicant_id", "left"), F.coalesce(F.col("_bvi"), F.lit(False))
    status = F.when(bvi, "not_applicable").when(F.col("failed"), "failed").when(
        F.col("missing") > 0, "partial"
    ).otherwise("complete")
    total = F.when(status != "not_applicable", F.coalesce("exam_points", F.lit(0.0)) + F.col("bonus"))
    return out.select(*keys, total.alias("total"), status.alias("status"), "missing")


def admission_decision(scores: DataFrame, facts: DataFrame, rights: DataFrame) -> DataFrame:
    """Achievements that an accepted right has not already used."""
    used = rights.select("applicant_id", "code").distinct()
    return scores.join(
        facts.join(used, ["applicant_id", "code"], "left_anti").groupBy("applicant_id").agg(
            F.count(F.lit(1)).alias("free_achievements")
        ),
        "applicant_id", "left"
    )


def verify_selection(selected: DataFrame, active: DataFrame) -> DataFrame:
    """Rules whose hash differs or that only one side has; none means exact."""
    a = selected.select("rule_id", F.col("content_hash").alias("selected"))
    b = active.select("rule_id", F.col("content_hash").alias("active"))
    return a.join(b, "rule_id", "full").where(~F.col("selected").eqNullSafe(F.col("active")))
