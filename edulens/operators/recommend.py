"""Fingerprints, profiles, content fit, ranking, reasons and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reference_data import activity_table
from ..functions.lineage import settle, settle_table
from ..functions.scalars import dot, settled
from .policy import alike, first_of

# Weights of the content fit and of the evidence parts.
SUBJECT, ACTIVITY, DISTINCTIVE, ANTI = 0.55, 0.25, 0.20, 0.60
PROFILE_PART, CATALOG_PART, FRESHNESS_PART = 0.50, 0.30, 0.20
NEUTRAL = 50.0
PROFILE_BLOCK = 20_000


def distinctive_subjects(loads: DataFrame, disciplines: DataFrame, k: int = 8) -> DataFrame:
    """Per program the ``k`` names with the highest share x (1 - df / N)."""
    named = loads.join(disciplines.select("discipline_id", "name"), "discipline_id")
    per = named.groupBy("program_id", "name").agg(
        F.sum("load").alias("load"), F.first("total_workload").alias("total"), F.min("discipline_id").alias("discipline_id")
    )
    df = per.groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    n = per.agg(F.count_distinct("program_id").alias("n"))
    share = F.col("load") / F.col("total")
    # The number of programs is a single row.
    scored = per.join(df, "name").join(F.broadcast(n), F.lit(True)).select(
        "program_id",
        "name",
        "discipline_id",
        settled(share, 6).alias("share"),
        settled(share * (1 - F.col("df") / F.col("n")), 6).alias("distinctiveness"),
    )
    rank = Window.partitionBy("program_id").orderBy(F.col("distinctiveness").desc(), F.col("share").desc(), "name")
    return scored.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)


def build_profiles(answers: DataFrame, options: DataFrame) -> DataFrame:
    """Tall profile weights ``(profile_id, kind, key, weight)`` from answers.

    Preferences of a kind are scaled to sum to 1; anti-interest is the sum of
    weight x intensity, held to [0, 1].
    """
    hits = answers.join(options, ["question_id", "option_id"])
    sums = hits.groupBy("profile_id", "kind", "key").agg(F.sum(F.col("weight") * F.col("intensity")).alias("w"))
    own = Window.partitionBy("profile_id", "kind")
    share = F.when(F.col("kind") == "negative", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("w")))).otherwise(
        F.col("w") / F.sum("w").over(own)
    )
    return sums.where("w > 0").withColumn("weight", F.round(share, 6)).drop("w")


def profile_confidence(answers: DataFrame, n_questions: int) -> DataFrame:
    """Answered share plus a tenth for up to two adaptive answers, held to 1."""
    base = F.count_if((F.col("state") == "answered") & ~F.col("adaptive")) / n_questions
    more = F.least(F.lit(2), F.count_if((F.col("state") == "answered") & F.col("adaptive"))) * 0.1
    worth = F.when(F.col("state") == "answered", 1.0).when(F.col("state") == "uncertain", 0.25).otherwise(0.0)
    return answers.groupBy("profile_id").agg(
        F.round(F.least(F.lit(1.0), base + more), 4).alias("confidence"),
        F.round(F.avg(worth), 4).alias("dimension_confidence"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
    )


def _maps(df: DataFrame, key: str, **columns) -> DataFrame:
    """One row per ``key``: for each name a map of ``(item, value)`` pairs that are not null."""
    made = [F.map_from_entries(F.array_sort(F.collect_list(pair))).alias(name) for name, pair in columns.items()]
    return df.groupBy(key).agg(*made)


def content_fit(
    profiles: DataFrame, area_share: DataFrame, activity_share: DataFrame, subjects: DataFrame
) -> DataFrame:
    """``pair_fit`` of every profile with every program, found once for profiles
    with the very same weights and given to each of them."""
    groups = alike(profiles.select("profile_id", "kind", "key", "weight"), "profile_id")
    found = pair_fit(first_of(profiles, "profile_id", groups), area_share, activity_share, subjects)
    found, own = found.withColumnRenamed("profile_id", "like"), groups
    at = ["like"]
    if groups.count() <= PROFILE_BLOCK:
        own = F.broadcast(own)
    else:  # a large group is cut into parts, so that no key has all the rows
        parts = max(1, 256 // groups.where("profile_id = like").count())
        found = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        own = own.withColumn("_part", F.pmod(F.xxhash64("profile_id"), F.lit(parts)).cast("int"))
        at = ["like", "_part"]
    return found.join(own, at).select("profile_id", *[c for c in found.columns if c not in at])


def best_fit(
    profiles: DataFrame, area_share: DataFrame, activity_share: DataFrame, subjects: DataFrame, programs: DataFrame, k: int = 10
) -> DataFrame:
    """``rank_fit`` of ``content_fit``: profiles with the very same weights have one
    ranking, so pairs are made for one of them only."""
    groups = alike(profiles.select("profile_id", "kind", "key", "weight"), "profile_id")
    found = pair_fit(first_of(profiles, "profile_id", groups), area_share, activity_share, subjects)
    top = settle_table(rank_fit(found.join(programs, "program_id"), k).withColumnRenamed("profile_id", "like"))
    return top.join(groups, "like").drop("like")


def pair_fit(
    profiles: DataFrame, area_share: DataFrame, activity_share: DataFrame, subjects: DataFrame
) -> DataFrame:
    """Content fit of every profile with every program.

    ``profiles`` is tall (build_profiles), shares are tall, ``subjects`` has
    (program_id, area, distinctiveness). Each profile and each program becomes
    one row of maps with a fixed number of keys, so a pair is scored where it is
    made and nothing is shuffled per key; a preference that is missing counts as
    NEUTRAL. The output is profiles x programs by definition: give a query set
    of profiles and rank with best_fit, which keeps the best of each task first.
    """
    tall = profiles.groupBy("profile_id", "kind", "key").agg(F.sum("weight").alias("weight"))
    of = lambda kind: F.when(F.col("kind") == kind, F.struct("key", "weight"))
    wanted = _maps(tall, "profile_id", p_subject=of("subject"), p_activity=of("activity"), p_anti=of("negative"))
    # An area's affinity for a profile: its own weight and that of its activities.
    matrix = activity_table(profiles.sparkSession)
    own = tall.where("kind = 'subject'").select("profile_id", "key", (F.col("weight") * 0.7).alias("weight"))
    via = tall.where("kind = 'activity'").join(F.broadcast(matrix), F.col("key") == F.col("activity"))
    via = via.select(
        "profile_id", F.col("area").alias("key"),
        (F.col("weight") * F.col("activity_weight") * 0.3).alias("weight")
    )
    affinity = own.unionByName(via).groupBy("profile_id", "key").agg(F.sum("weight").alias("weight"))
    wanted = wanted.join(_maps(affinity, "profile_id", p_distinctive=F.struct("key", "weight")), "profile_id", "left")

    dist = subjects.groupBy("program_id", "area").agg(F.sum("distinctiveness").alias("share"))
    offered = _maps(area_share, "program_id", area=F.struct(F.col("area"), F.col("share")))
    offered = offered.join(
        _maps(activity_share, "program_id", activity=F.struct("activity", "share")), "program_id", "left"
    )
    offered = offered.join(_maps(dist, "program_id", distinct=F.struct("area", "share")), "program_id", "left")
    total = subjects.groupBy("program_id").agg(F.sum("distinctiveness").alias("d_total"))
    offered = offered.join(total, "program_id", "left")

    points = lambda a, b: F.coalesce(dot(F.col(a), F.col(b)), F.lit(0.0)) * 100
    # The query set goes to the programs where it is small; else Spark pairs blocks of both.
    wanted = F.broadcast(wanted) if wanted.count() <= PROFILE_BLOCK else wanted
    out = offered.crossJoin(wanted).withColumns(
        {
            "has_subject": F.size("p_subject") > 0,
            "has_activity": F.size("p_activity") > 0,
            "s_subject": points("p_subject", "area"),
            "s_activity": points("p_activity", "activity"),
            "s_anti": points("p_anti", "area"),
            "s_distinctive": points("p_distinctive", "distinct"),
        }
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    subject = F.when(F.col("has_subject"), z("s_subject")).otherwise(NEUTRAL)
    activity = F.when(F.col("has_activity"), z("s_activity")).otherwise(NEUTRAL)
    some = (F.col("has_subject") | F.col("has_activity")) & (F.col("d_total") > 0)
    unlike = F.when(some, z("s_distinctive") / F.col("d_total")).otherwise(NEUTRAL)
    raw = SUBJECT * subject + ACTIVITY * activity + DISTINCTIVE * unlike - ANTI * z("s_anti")
    return out.select(
        "profile_id",
        "program_id",
        settled(subject, 4).alias("subject_fit"),
        settled(activity, 4).alias("activity_fit"),
        settled(unlike, 4).alias("distinctive_fit"),
        settled(z("s_anti"), 4).alias("anti_penalty"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.round(raw, 6)).cast("int"))).alias("content_fit"),
    )


def rank_fit(scores: DataFrame, k: int = 10) -> DataFrame:
    order = [F.col("content_fit").desc(), F.col("subject_fit").desc(), "code", "program_id"]
    w = Window.partitionBy("profile_id").orderBy(*order)
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def fit_reasons(
    profiles: DataFrame, area_share: DataFrame, activity_share: DataFrame, subjects: DataFrame,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Up to eight reasons a pair: 3 subjects, 2 activities, 3 against, 2 distinctive.
    With ``pairs(profile_id, program_id)`` only those are looked at: a profile's
    keys go to its own programs, and no key brings all of its holders together."""
    p = profiles.select("profile_id", "kind", "key", "weight")
    at = ["key"]
    if pairs is not None:
        p, at = p.join(pairs.select("profile_id", "program_id").distinct(), "profile_id"), ["program_id", "key"]
    area = area_share.select("program_id", F.col("area").alias("key"), "share")
    act = activity_share.select("program_id", F.col("activity").alias("key"), "share")
    dist = subjects.groupBy("program_id", F.col("area").alias("key")).agg(F.max("distinctiveness").alias("share"))
    found = (
        p.where("kind = 'subject'").join(area, at)
        .unionByName(p.where("kind = 'activity'").join(act, at))
        .unionByName(p.where("kind = 'negative'").join(area, at))
        .unionByName(p.where("kind = 'subject'").join(dist, at).withColumn("kind", F.lit("distinctive")))
        .where("share > 0")
    )
    caps = F.create_map(
        *[F.lit(x) for kv in {"subject": 3, "activity": 2, "negative": 3, "distinctive": 2}.items() for x in kv]
    )
    strength = settled(F.col("weight") * F.col("share"), 6)
    w = Window.partitionBy("profile_id", "program_id", "kind").orderBy(F.col("strength").desc(), "key")
    all_ = Window.partitionBy("profile_id", "program_id").orderBy("kind", "n")
    return (
        found.withColumn("strength", strength)
        .withColumn("n", F.row_number().over(w))
        .where(F.col("n") <= caps[F.col("kind")])
        .withColumn("place", F.row_number().over(all_))
        .where("place <= 8")
        .select("profile_id", "program_id", "kind", "n", "key", "strength")
    )


def recommend(
    profiles: DataFrame, area_share: DataFrame, activity_share: DataFrame, subjects: DataFrame, programs: DataFrame, evidence: DataFrame, k: int = 10
) -> DataFrame:
    """The ``k`` best programs of every profile, 20 at most, each with its place,
    scores, ``reasons`` in order and the reliability of what is behind it.

    ``programs(program_id, code)``; ``evidence`` as ``recommendation_evidence``
    takes it, by profile_id. Profiles without evidence are ``not_available``.
    """
    if not 1 <= k <= 20:
        raise ValueError("k is from 1 to 20")
    # What is known of the programs is made once, for the ranking and the reasons.
    sides = (("area", area_share, "area", "share"), ("activity", activity_share, "activity", "share"), ("distinct", subjects, "area", "distinctiveness"))
    known = settle_table(reduce(DataFrame.unionByName, [
        df.select("program_id", F.lit(side).alias("side"), F.col(key).alias("key"), F.col(value).alias("value")) for side, df, key, value in sides
    ]))
    area_share, activity_share, subjects = (
        known.where(F.col("side") == side).select("program_id", F.col("key").alias(key), F.col("value").alias(value)) for side, _, key, value in sides
    )
    top = best_fit(profiles, area_share, activity_share, subjects, programs, k)
    top = settle(top)  # its scores are made once for the reasons and the result
    why = fit_reasons(profiles, area_share, activity_share, subjects, top)
    parts = F.array_sort(F.collect_list(F.struct("kind", "n", "key", "strength")))
    why = why.groupBy("profile_id", "program_id").agg(parts.alias("reasons"))
    behind = recommendation_evidence(evidence).select("profile_id", "reliability", "reliability_status")
    out = top.join(why, ["profile_id", "program_id"], "left").join(behind, "profile_id", "left")
    none = F.array().cast(why.schema["reasons"].dataType)
    return out.withColumn("reasons", F.coalesce("reasons", none)).withColumn(
        "reliability_status", F.coalesce("reliability_status", F.lit("not_available"))
    )


def recommendation_evidence(rows: DataFrame) -> DataFrame:
    """Reliability of ``rows(profile_confidence, worst_gap, n_runs, rows_without_run,
    n_sources)``: weighted over the parts that are known, null without a
    profile or with fewer than two parts."""
    catalog = (
        F.when(F.col("worst_gap") == "blocking", F.lit(None).cast("double"))
        .when(F.col("worst_gap") == "degradable", 0.75)
        .when(F.col("worst_gap") == "informational", 0.9)
        .otherwise(1.0)
    )
    fresh = F.when(
        F.col("n_sources") > 0,
        F.when(
            (F.col("n_runs") == 1) & (F.col("rows_without_run") == 0), 1.0
        ).when(F.col("n_runs") > 0, 0.75).otherwise(0.5),
    )
    out = rows.withColumn("catalog", catalog).withColumn("freshness", fresh)
    parts = [("profile_confidence", PROFILE_PART), ("catalog", CATALOG_PART), ("freshness", FRESHNESS_PART)]
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    bottom = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    known = sum((F.col(c).isNotNull().cast("int") for c, _ in parts), F.lit(0))
    value = F.when(F.col("profile_confidence").isNotNull() & (known >= 2), F.round(F.round(top / bottom, 8), 4))
    status = F.when(value.isNull(), "not_available").when(known == 3, "available").otherwise("partial")
    return out.withColumn("reliability", value).withColumn("reliability_status", status)


def signals_used(has_subject, has_activity, has_negative, has_distinctive, has_terms):
    """Names of the signals behind a recommendation, in alphabetical order."""
    return F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.array(
                    F.when(has_subject, "profile_subject_preference"),
                    F.when(has_subject | has_negative, "curriculum_area_share"),
                    F.when(has_activity, "profile_activity_preference"),
                    F.when(has_activity, "curriculum_activity_mapping"),
                    F.when(has_negative, "profile_anti_interest"),
                    F.when((has_subject | has_activity) & has_distinctive, "distinctive_subject"),
                    F.when(has_terms, "semester_distribution"),
                )
            )
        )
    )


def adaptive_dimensions(top: DataFrame, confidence: DataFrame, k: int = 2, min_spread: float = 0.08) -> DataFrame:
    """Dimensions that would tell a profile's best programs apart: spread at
    least ``min_spread``, by min(1, spread x (0.5 + mean) x (1 - confidence))."""
    d = top.groupBy("profile_id", "dimension").agg(
        (F.max("value") - F.min("value")).alias("spread"), F.avg("value").alias("mean")
    )
    d = d.where(F.round("spread", 9) >= min_spread).join(confidence, "profile_id")
    s = settled(F.least(F.lit(1.0), F.col("spread") * (0.5 + F.col("mean")) * (1 - F.col("confidence"))), 6)
    w = Window.partitionBy("profile_id").orderBy(F.col("significance").desc(), "dimension")
    return d.withColumn("significance", s).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def ranking_stability(snapshots: DataFrame) -> DataFrame:
    """Each ranking against the one before: ``ids`` and ``scores`` in order."""
    w = Window.partitionBy("profile_id").orderBy("revision")
    prev_ids, prev_scores = F.lag("ids").over(w), F.lag("scores").over(w)
    delta = F.array_max(
        F.zip_with("scores", "_scores", lambda a, b: F.abs(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))))
    )
    df = snapshots.withColumn("_ids", prev_ids).withColumn("_scores", prev_scores).withColumn("delta", delta)
    same = F.slice("ids", 1, 3) == F.slice("_ids", 1, 3)
    state = (
        F.when(F.col("_ids").isNull(), "first")
        .when(same & (F.col("delta") == 0), "stable")
        .when(same & (F.col("delta") <= 3), "low_impact")
        .otherwise("changed")
    )
    return df.withColumn("stability", state).drop("_ids", "_scores")


def discriminating_dimensions(top2: DataFrame, gap: int = 5, least: float = 0.12, k: int = 4) -> DataFrame:
    """Dimensions on which a profile's two best programs, at most ``gap`` points
    apart, differ by ``least`` or more. ``top2`` is tall: (profile_id, place,
    content_fit, dimension, value)."""
    one = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    d = top2.groupBy("profile_id", "dimension").agg(
        F.coalesce(one(1, "value"), F.lit(0.0)).alias("a"), F.coalesce(one(2, "value"), F.lit(0.0)).alias("b")
    )
    close = top2.groupBy("profile_id").agg(
        (one(1, "content_fit") - one(2, "content_fit")).alias("points")
    ).where(F.col("points") <= gap)
    d = d.join(close, "profile_id").withColumn(
        "delta", F.round(F.col("a") - F.col("b"), 6)
    ).where(F.abs("delta") >= least)
    w = Window.partitionBy("profile_id").orderBy(F.abs("delta").desc(), "dimension")
    return d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
