"""Ordered dedup, merges, diffs and identity resolution of raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in source order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_known(col: str, order: Column) -> Column:
    """First non-null value of a group in the given order."""
    return F.min_by(col, F.when(F.col(col).isNotNull(), order))


def collapse_rows(rows: DataFrame, order: Column) -> DataFrame:
    """One row per (program, discipline, semester): most hours, other facts
    from the first row that knows them, assessments in order of appearance."""
    kinds = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("assessment").alias("a"))))
    return rows.groupBy("program_id", "discipline_id", "semester").agg(
        F.max("hours").alias("hours"),
        first_known("credits", order).alias("credits"),
        F.min("position").alias("position"),
        F.array_join(F.array_distinct(F.transform(kinds, lambda k: k["a"])), ",").alias("assessments"),
        F.count(F.lit(1)).alias("merged"),
    )


def merge_offerings(records: DataFrame, keys: list[str], scalars: list[str], order: Column) -> DataFrame:
    """Records of one offering become one, each scalar from the first that has it."""
    return records.groupBy(*keys).agg(
        *[first_known(c, order).alias(c) for c in scalars], F.count(F.lit(1)).alias("merged")
    )


def merge_children(children: DataFrame, parent: list[str], child: list[str], order: list[Column | str]) -> DataFrame:
    return dedupe_first(children, [*parent, *child], order)


def merge_passing_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """One score per key: from an enrollment order if any, the lowest number,
    then the least provenance."""
    return dedupe_first(
        scores, keys, [F.col("is_order").desc(), F.col("score").asc_nulls_last(), "content_hash", "locator"]
    )


def derive_cutoffs(rows: DataFrame) -> DataFrame:
    """Lowest admitted score per (direction, funding, competition).

    Repeats of a (direction, row, competition) collapse to the lowest number;
    a number replaces admission without exams (null score). ``disputed``
    counts rows whose repeats gave different numbers.
    """
    keys = ["direction_id", "funding_type", "competition_type"]
    once = rows.groupBy(*keys, "row_key").agg(
        F.min("score").alias("score"), (F.count_distinct("score") > 1).cast("int").alias("disputed")
    )
    return once.groupBy(*keys).agg(
        F.min("score").alias("cutoff"),
        F.count("score").alias("admitted_by_score"),
        F.count_if(F.col("score").isNull()).alias("admitted_without_exams"),
        F.sum("disputed").alias("disputed"),
    )


def resolve_targets(records: DataFrame, programs: DataFrame) -> DataFrame:
    """Programs a raw record means: its program code, or all of its direction."""
    p = programs.select("program_id", F.col("code").alias("_code"), F.col("direction_id").alias("_direction"))
    by_code = records.where("scope = 'program'").join(p, F.lower(F.trim("target")) == F.lower(F.trim("_code")))
    by_direction = records.where("scope = 'direction'").join(p, F.col("target") == F.col("_direction").cast("string"))
    return by_code.unionByName(by_direction).drop("_code", "_direction")


def conflicts(df: DataFrame, identity: list[str], value: str) -> DataFrame:
    """Identities with two or more different values."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*identity)
        .agg(
            F.count_distinct(value).alias("n_values"), F.count(F.lit(1)).alias("n_records"), F.min(value).alias("low"),
            F.max(value).alias("high")
        )
        .where("n_values >= 2")
    )


def diff_sources(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Documents added, removed or changed between ``(source_id, content_hash)`` tables."""
    a = prev.select("source_id", F.col("content_hash").alias("before"))
    b = cur.select("source_id", F.col("content_hash").alias("after"))
    change = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before") != F.col("after"), "changed")
    )
    return a.join(b, "source_id", "full").withColumn("change", change).where("change is not null")


def stale_rules(prev_rules: DataFrame, cur_rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rule ids with ``added``, ``removed`` (and so stale), or ``stale`` for
    rules kept from a changed or removed document."""
    gone = prev_rules.join(cur_rules, "rule_id", "left_anti").select("rule_id", F.lit("removed").alias("state"))
    new = cur_rules.join(prev_rules, "rule_id", "left_anti").select("rule_id", F.lit("added").alias("state"))
    touched = changes.where("change <> 'added'").select("source_id")
    kept = cur_rules.join(prev_rules, "rule_id", "left_semi").join(touched, "source_id", "left_semi")
    return gone.unionByName(new).unionByName(kept.select("rule_id", F.lit("stale").alias("state")))


def coverage_status(expected: Column, found: Column, review: Column) -> Column:
    return (
        F.when(
            (found >= expected) & (review == 0), "complete"
        ).when(found >= expected, "review_required").otherwise("partial")
    )


def latest_curriculum(items: DataFrame, curricula: DataFrame) -> DataFrame:
    """Items of each program's newest curriculum, in their printed order."""
    w = Window.partitionBy("program_id").orderBy(F.col("education_year").desc(), "curriculum_id")
    last = curricula.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    place = Window.partitionBy("curriculum_id").orderBy(
        F.col("semester").asc_nulls_last(), F.col("position").asc_nulls_last(), "discipline_id", "source_row"
    )
    return items.join(last.select("curriculum_id", "education_year"), "curriculum_id").withColumn(
        "place", F.row_number().over(place)
    )


def catalog(programs: DataFrame, university: int, limit: int = 100) -> DataFrame:
    return programs.where(F.col("university_id") == university).orderBy("code", "program_id").limit(limit)


def added_removed(prev: DataFrame, cur: DataFrame, key: str) -> DataFrame:
    a = prev.select(key).distinct()
    b = cur.select(key).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(
        a.exceptAll(b).withColumn("change", F.lit("removed"))
    )


def union_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
