"""Dependency graphs: cycles, and what a change touches with the path that leads there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settle_table


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without an edge in or without one out are taken away
    until none is left of them; such nodes lie on no cycle."""
    before = edges.count()
    while before:
        starts = edges.select(F.col("source").alias("_n")).distinct()
        ends = edges.select(F.col("target").alias("_m")).distinct()
        kept = edges.join(starts, edges["target"] == starts["_n"], "left_semi")
        edges = settle_table(kept.join(ends, kept["source"] == ends["_m"], "left_semi"))
        now = edges.count()
        if now == before:
            break
        before = now
    return edges


def strong_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node on a cycle of ``edges(source, target)``;
    the component is its smallest node. A node that is its own target counts.

    Forward and backward reach with trimming: every node takes the smallest node
    that reaches it; those nodes that keep their own start components, which are
    what reaches them within their colour. Rows are linear in the edges; a reach
    takes as many rounds as its longest path, of which trimming leaves only
    those between cycles. Null ends and repeats are ignored; an empty table gives
    an empty result.
    """
    whole = edges.select("source", "target").where("source is not null and target is not null").distinct()
    loops = whole.where("source = target").select(F.col("source").alias("node"))
    left = _trimmed(settle_table(whole.where("source <> target")))
    found = []
    while not left.isEmpty():
        colour = settle_table(left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("c", F.col("node")))
        while True:
            reach = left.join(colour, left["source"] == colour["node"]).groupBy("target").agg(F.min("c").alias("r"))
            better = reach.withColumnRenamed("target", "node")
            moved = colour.join(better, "node", "left").select("node", F.least("c", "r").alias("c"), (F.col("r") < F.col("c")).alias("m"))
            moved = settle_table(moved)
            colour = moved.select("node", "c")
            if moved.where("m").isEmpty():
                break
        source, target = (colour.select(F.col("node").alias(n), F.col("c").alias(f"_{n}")) for n in ("source", "target"))
        inside = settle_table(left.join(source, "source").join(target, "target").where("_source = _target").select("source", "target"))
        front = colour.where("node = c").select("node", F.col("c").alias("component"))
        seen = [settle_table(front)]
        while True:
            back = inside.join(seen[-1], inside["target"] == seen[-1]["node"]).select(F.col("source").alias("node"), "component")
            known = reduce(DataFrame.unionByName, seen)
            back = settle_table(back.distinct().join(known.select("node"), "node", "left_anti"))
            if back.isEmpty():
                break
            seen.append(back)
        done = settle_table(reduce(DataFrame.unionByName, seen))
        found.append(done)
        gone = done.select("node")
        left = left.join(gone.withColumnRenamed("node", "source"), "source", "left_anti")
        left = _trimmed(settle_table(left.join(gone.withColumnRenamed("node", "target"), "target", "left_anti")))
    empty = loops.limit(0).select("node", F.col("node").alias("component"))
    parts = reduce(DataFrame.unionByName, found, empty)
    larger = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    parts = parts.join(larger, "component", "left_semi").select("node", "component")
    alone = loops.join(parts.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return parts.unionByName(alone)


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with ``cyclic``: whether the edge lies on a cycle."""
    known = settle_table(strong_components(edges))
    a = known.select(F.col("node").alias("source"), F.col("component").alias("_a"))
    b = known.select(F.col("node").alias("target"), F.col("component").alias("_b"))
    on = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return edges.join(a, "source", "left").join(b, "target", "left").withColumn("cyclic", on).select(*edges.columns, "cyclic")


def impact_paths(
    changed: DataFrame, edges: DataFrame, max_depth: int = 8, max_objects: int = 1000
) -> DataFrame:
    """``(request, node, distance, root, path, rank, leads_on, kept)``: what the
    changes of each request reach.

    ``changed(request, root, rank)``, ``edges(edge_id, source, target)``. A node
    has one row a request: its least distance, and of the ways of that length the
    smallest by root and then by edge ids, as ``path``. ``rank`` is the highest of
    the changes that reach it within ``max_depth`` steps. ``leads_on``: at the
    last depth, with more behind it. ``kept``: among the request's nearest and
    smallest ``max_objects``. All changes go together, so rows are linear in the
    nodes and edges that a request reaches and not in its changes. A changed node
    is listed only where another one reaches it.
    """
    step = edges.select("edge_id", F.col("source").alias("node"), "target")
    roots = changed.groupBy("request", "root").agg(F.max("rank").alias("rank"))
    none = F.array().cast(f"array<{dict(edges.dtypes)['edge_id']}>")
    front = settle_table(roots.select("request", F.col("root").alias("node"), "root", none.alias("path"), "rank"))
    own, levels, ranks = front.select("request", "node"), [], []
    for depth in range(1, max_depth + 1):
        way = F.struct("root", F.array_append("path", F.col("edge_id")).alias("path"))
        reached = front.join(step, "node").where("node <> target").groupBy("request", F.col("target").alias("node")).agg(
            F.min(F.when(F.col("path").isNotNull(), way)).alias("way"), F.max("rank").alias("rank")
        )
        front = settle_table(reached.select("request", "node", "way.root", "way.path", "rank"))
        if front.isEmpty():
            break
        ranks.append(front.select("request", "node", "rank"))
        new = front.where("path is not null")
        for seen in levels:
            new = new.join(seen.select("request", "node"), ["request", "node"], "left_anti")
        new = settle_table(new.withColumn("distance", F.lit(depth)))
        levels.append(new)
        # Nodes seen before go on with their rank only.
        fresh = new.select("request", "node", F.lit(True).alias("fresh"))
        front = settle_table(front.join(fresh, ["request", "node"], "left").withColumn("path", F.when(F.col("fresh"), F.col("path"))).drop("fresh"))
    if not levels:
        levels = [front.limit(0).withColumn("distance", F.lit(0))]
        ranks = [front.limit(0).select("request", "node", "rank")]
    best = reduce(DataFrame.unionByName, ranks).groupBy("request", "node").agg(F.max("rank").alias("rank"))
    found = reduce(DataFrame.unionByName, levels).drop("rank").join(best, ["request", "node"])
    origin = changed.select("request", F.col("root").alias("node")).distinct().withColumn("_own", F.lit(True))
    leads = step.select("node").distinct().withColumn("_more", F.lit(True))
    found = found.join(leads, "node", "left").join(origin, ["request", "node"], "left")
    first = F.row_number().over(Window.partitionBy("request").orderBy("distance", "node"))
    return found.select(
        "request", "node", "distance", "root", "path", "rank",
        ((F.col("distance") == max_depth) & F.col("_more").isNotNull()).alias("leads_on"), (first <= max_objects).alias("kept"),
    )


def impact_summary(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """``(request, objects, cycles, truncated, status, rank)`` of ``impact_paths``:
    ``partial`` where a reached edge lies on a cycle, the cap cut something or the
    last depth leads on; then the rank is unknown (null)."""
    on = cyclic_edges(edges).where("cyclic").select("edge_id", F.col("source").alias("node"))
    cycles = paths.select("request", "node").join(on, "node").groupBy("request").agg(F.count_distinct("edge_id").alias("cycles"))
    sums = paths.groupBy("request").agg(
        F.count_if("kept").alias("objects"), F.bool_or(F.col("leads_on") | ~F.col("kept")).alias("truncated"), F.max("rank").alias("rank")
    )
    sums = sums.join(cycles, "request", "left").withColumn("cycles", F.coalesce("cycles", F.lit(0)))
    partial = F.col("truncated") | (F.col("cycles") > 0)
    return sums.select(
        "request", "objects", "cycles", "truncated", F.when(partial, "partial").otherwise("complete").alias("status"),
        F.when(~partial, F.col("rank")).alias("rank"),
    )
