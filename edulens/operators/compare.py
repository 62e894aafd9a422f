"""Curriculum alignment, pair comparison, key differences and trade-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import settled


def program_pairs(selection: DataFrame, key: str = "selection_id") -> DataFrame:
    """All ordered pairs of the few programs in each selection, by ``place``."""
    a = selection.select(key, F.col("program_id").alias("a"), F.col("place").alias("pa"))
    b = selection.select(key, F.col("program_id").alias("b"), F.col("place").alias("pb"))
    return a.join(b, key).where("pa < pb").drop("pa", "pb")


def align_curricula(rows: DataFrame, pairs: DataFrame, semester: int | None = None) -> DataFrame:
    """Rows of both programs of each pair side by side on (name, semester).

    ``rows(program_id, name, semester, hours, credits)`` has one row per key;
    a null semester matches a null one. One shuffle of the pairs' rows.
    """
    if semester is not None:
        rows = rows.where(F.col("semester") == semester)
    side = F.explode(
        F.array(
            F.struct(F.col("a").alias("program_id"), F.lit(0).alias("side")),
            F.struct(F.col("b").alias("program_id"), F.lit(1).alias("side"))
        )
    )
    wanted = pairs.select("a", "b", side.alias("s")).select("a", "b", "s.program_id", "s.side")
    joined = wanted.join(rows, "program_id")
    one = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    out = joined.groupBy("a", "b", "name", "semester").agg(
        F.bool_or(F.col("side") == 0).alias("_a"),
        F.bool_or(F.col("side") == 1).alias("_b"),
        *[one(c, s).alias(f"{c}_{'ab'[s]}") for c in ("hours", "credits") for s in (0, 1)],
    )
    same = F.col("hours_a").eqNullSafe(F.col("hours_b")) & F.col("credits_a").eqNullSafe(F.col("credits_b"))
    status = (
        F.when(~F.col("_b"), "only_a").when(~F.col("_a"), "only_b").when(same, "both").otherwise("different")
    )
    return (
        out.withColumn("status", status)
        .withColumn("hours_delta", F.coalesce("hours_b", F.lit(0)) - F.coalesce("hours_a", F.lit(0)))
        .withColumn("credits_delta", F.coalesce("credits_b", F.lit(0)) - F.coalesce("credits_a", F.lit(0)))
        .drop("_a", "_b")
    )


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("program_id").agg(
        F.sum("hours").alias("hours"), F.sum(F.coalesce("credits", F.lit(0))).alias("credits")
    )


def area_distribution(area_load: DataFrame) -> DataFrame:
    """Shares to 4 places; what rounding leaves goes to the largest share."""
    own = Window.partitionBy("program_id")
    rank = own.orderBy(F.col("raw").desc(), "area")
    raw = settled(F.col("area_load") / F.sum("area_load").over(own), 4)
    df = area_load.withColumn("raw", raw).withColumn("place", F.row_number().over(rank))
    rest = 1 - F.sum("raw").over(own)
    share = F.round(F.col("raw") + F.when(F.col("place") == 1, rest).otherwise(0), 4)
    return df.withColumn("share", share).select("program_id", "area", "share", "place")


def key_differences(
    pairs: DataFrame, program_totals: DataFrame, shares: DataFrame, aligned: DataFrame, k: int = 8
) -> DataFrame:
    """Per pair: hours, credits, the ``k`` largest area gaps and discipline gaps."""

    def both(df: DataFrame, cols: list[str], on: list[str]) -> DataFrame:
        a = df.select(F.col("program_id").alias("a"), *on, *[F.col(c).alias(f"{c}_a") for c in cols])
        b = df.select(F.col("program_id").alias("b"), *on, *[F.col(c).alias(f"{c}_b") for c in cols])
        if not on:
            return pairs.join(a, "a").join(b, "b")
        left = pairs.join(a, "a")
        right = pairs.join(b, "b")
        return left.join(right, ["a", "b", *on], "full")

    t = both(program_totals, ["hours", "credits"], [])
    sums = t.select(
        "a", "b",
        F.expr(
            "stack(2, 'hours', double(hours_b - hours_a), 'credits', double(credits_b - credits_a))"
        ).alias("kind", "delta")
    )
    sums = sums.select("a", "b", "kind", F.lit("total").alias("key"), "delta")
    gap = F.coalesce("share_b", F.lit(0.0)) - F.coalesce("share_a", F.lit(0.0))
    areas = both(shares, ["share"], ["area"]).select(
        "a", "b", F.lit("area").alias("kind"), F.col("area").alias("key"), F.round(gap, 4).alias("delta")
    )
    strength = F.greatest(F.abs("hours_delta"), F.abs("credits_delta")).cast("double")
    signed = F.when(
        F.abs("hours_delta") >= F.abs("credits_delta"), F.col("hours_delta")
    ).otherwise(F.col("credits_delta"))
    label = F.concat_ws("@", "name", F.coalesce(F.col("semester").cast("string"), F.lit("-")))
    subjects = aligned.where(strength > 0).select(
        "a", "b", F.lit("discipline").alias("kind"), label.alias("key"), signed.cast("double").alias("delta")
    )
    rank = Window.partitionBy("a", "b", "kind").orderBy(F.abs("delta").desc(), "key")
    return (
        sums.unionByName(areas.where("delta <> 0"))
        .unionByName(subjects)
        .withColumn("place", F.row_number().over(rank))
        .where(F.col("place") <= k)
        .withColumn(
            "direction",
            F.when(F.col("delta") > 0, "more_in_b").when(F.col("delta") < 0, "more_in_a").otherwise("equal")
        )
    )


def tradeoffs(differences: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` directional area and discipline gaps, told from both sides."""
    rank = Window.partitionBy("a", "b").orderBy(F.when(F.col("kind") == "area", 0).otherwise(1), "place")
    top = differences.where(
        "kind in ('area', 'discipline') and direction <> 'equal'"
    ).withColumn("n", F.row_number().over(rank))
    sides = F.array(
        F.struct(F.col("a").alias("program_id"), (F.col("direction") == "more_in_a").alias("gains")),
        F.struct(F.col("b").alias("program_id"), (F.col("direction") == "more_in_b").alias("gains")),
    )
    return top.where(F.col("n") <= k).select(
        "a", "b", "n", "kind", "key", F.explode(sides).alias("s")
    ).select("a", "b", "n", "kind", "key", "s.*")


def summary_gaps(selection: DataFrame, rows: DataFrame) -> DataFrame:
    """Selected programs without a curriculum."""
    return selection.join(rows.select("program_id"), "program_id", "left_anti")


def vector_delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Differences over the union of the keys of two vectors."""
    x, y = a.select(key, F.col(value).alias("_a")), b.select(key, F.col(value).alias("_b"))
    delta = F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))
    return x.join(y, key, "full").select(key, F.round(delta, 6).alias("delta"))
