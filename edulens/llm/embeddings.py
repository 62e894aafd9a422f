"""Embedding near-duplicates by dual traversal of cover trees.

Vectors of one label form a cover tree whose upper levels are DataFrames: a
cell with more points than a chunk is split around centres that lie farther
apart than the level's radius, radii halve from level to level, and a cell's
centre stays one below. Pairs of cells descend level by level, and a pair goes
on only if its centres are no farther apart than both covering radii and the
threshold allow. For pairs of chunks that survive, each side is a cover tree in
memory that is walked in the same way, so what reaches its leaves is compared
exactly.

Scale: equal vectors are one point with a count; links are counted and turned
into a spanning forest inside the task, never emitted as pairs; a chunk holds a
bounded number of points even when one label has most of them. Where vectors of
a label are nearly orthogonal no metric bound prunes, and the work is that of
every chunk pair, in matrix products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, merge_labels, shared_checkpoint, table

THRESHOLD = 0.93
CHUNK = 4096
MAX_CENTRES = 64
LEVELS = 4  # radii 1, 1/2, 1/4, 1/8; the threshold is a distance of 0.37
#: Points of a cell among which its centres are sought. Up to 1000 of them Spark
#: takes from each task before it shuffles (WindowGroupLimit).
SAMPLE = 1000
SLICE = 8192  # points that meet the centres of their cell in one group
BLOCK = 1024  # points of one tree in memory
SLACK = 1e-9


def chord(cos: np.ndarray) -> np.ndarray:
    """Euclidean distance of unit vectors from their cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def cover_tree(x: np.ndarray, floor: float = 0.2) -> list[dict]:
    """Nested levels of a cover tree over unit vectors.

    A level has ``centre`` (row of x), ``parent`` (node of the level above) and
    ``reach``, the largest distance from the centre to a point below it. Level
    radii halve from 2 to ``floor``; the last level is the points themselves.
    """
    n = len(x)
    node = np.zeros(n, np.int64)  # node of the current level that covers a point
    d = chord(x @ x[0])
    levels = [{"centre": np.array([0]), "parent": np.array([0]), "reach": np.array([d.max()])}]
    radius = 1.0
    while radius >= floor:
        centre, parent, reach = [], [], []
        below = np.empty(n, np.int64)
        order = np.argsort(node, kind="stable")
        for rows in np.split(order, np.nonzero(np.diff(node[order]))[0] + 1):
            left, first = rows, levels[-1]["centre"][node[rows[0]]]
            while len(left):
                c = first if first in left else left[0]  # a centre stays one level down
                d = chord(x[left] @ x[c])
                near = d <= radius
                near[left == c] = True
                below[left[near]] = len(centre)
                centre.append(c)
                parent.append(node[c])
                reach.append(d[near].max())
                left = left[~near]
                first = left[0] if len(left) else -1
        levels.append({"centre": np.array(centre), "parent": np.array(parent), "reach": np.array(reach)})
        node, radius = below, radius / 2
    levels.append({"centre": np.arange(n), "parent": node, "reach": np.zeros(n)})
    return levels


def dual_traverse(a: np.ndarray, b: np.ndarray, threshold: float, ta=None, tb=None) -> np.ndarray:
    """Index pairs (i, j) with cosine >= threshold between the rows of a and b,
    whose cover trees are ``ta`` and ``tb``."""
    t = chord(np.array(threshold)) + SLACK
    ta, tb = ta or cover_tree(a), tb or cover_tree(b)
    open_ = np.ones((1, 1), bool)
    ka, kb = np.zeros(1, np.int64), np.zeros(1, np.int64)  # nodes that still have a partner
    for la, lb in zip(ta, tb):
        pa = np.full(max(ka) + 1, -1)
        pa[ka] = np.arange(len(ka))
        pb = np.full(max(kb) + 1, -1)
        pb[kb] = np.arange(len(kb))

        def kept(level, pos):
            known = level["parent"] < len(pos)
            return np.nonzero(known & (pos[np.where(known, level["parent"], 0)] >= 0))[0]

        ka2, kb2 = kept(la, pa), kept(lb, pb)
        cos = a[la["centre"][ka2]] @ b[lb["centre"][kb2]].T
        inherit = open_[pa[la["parent"][ka2]]][:, pb[lb["parent"][kb2]]]
        if la is ta[-1]:
            i, j = np.nonzero(inherit & (cos >= threshold))
            return np.stack([ka2[i], kb2[j]], axis=1)
        open_ = inherit & (chord(cos) <= t + la["reach"][ka2][:, None] + lb["reach"][kb2][None])
        rows, cols = open_.any(axis=1), open_.any(axis=0)
        if not rows.any():
            return np.zeros((0, 2), np.int64)
        open_, ka, kb = open_[rows][:, cols], ka2[rows], kb2[cols]
    raise AssertionError("trees have the same number of levels")


def unit_links(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Link counts and a spanning forest of one pair of chunks.

    ``side`` 0 and 1 are the two chunks; a chunk paired with itself has side 0
    only. Returns (cid, links, root): other vectors linked within this pair,
    and the point that ``cid`` hangs on (itself for a root).
    """
    x = np.stack(pdf["unit"].to_numpy()).astype(np.float64)
    mult, cid, side = pdf["n"].to_numpy(np.int64), pdf["cid"].to_numpy(np.int64), pdf["side"].to_numpy()
    left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
    own = not len(right)
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))

    def trees(rows):
        blocks = [rows[k : k + BLOCK] for k in range(0, len(rows), BLOCK)]
        return [(r, x[r], cover_tree(x[r])) for r in blocks]

    lefts = trees(left)
    for k, (p, a, ta) in enumerate(lefts):
        for q, b, tb in lefts[k:] if own else trees(right):
            pairs = dual_traverse(a, b, threshold, ta, tb)
            i, j = p[pairs[:, 0]], q[pairs[:, 1]]
            keep = i != j if p is not q else i < j
            i, j = i[keep], j[keep]
            np.add.at(links, i, mult[j])
            np.add.at(links, j, mult[i])
            label = merge_labels(label, i, j)
    found = np.nonzero(links)[0]
    return pd.DataFrame({"cid": cid[found], "links": links[found], "root": cid[label[found]]})


def thinned(x: np.ndarray, radius: float, least: int) -> np.ndarray:
    """Rows of x that lie more than ``radius`` from every row taken before. Where
    more than MAX_CENTRES do, the radius finds no structure and the first
    ``least`` are taken."""
    kept = [0]
    far = chord(x @ x[0])
    while (far > radius).any():
        kept.append(int(np.argmax(far > radius)))
        if len(kept) > MAX_CENTRES:
            return np.array(kept[:least])
        far = np.minimum(far, chord(x @ x[kept[-1]]))
    return np.array(kept)


PLACED = "label string, cell string, cid long, n long, unit array<double>"


def first_of_cells(large: DataFrame) -> DataFrame:
    """The first SAMPLE points of each cell, numbered ``c``, in the order of a hash;
    so the first of a cell, its centre, is first in its child too."""
    order = Window.partitionBy("label", "cell").orderBy(F.xxhash64("cid", F.lit(7)), "cid")
    numbered = large.withColumn("c", F.row_number().over(order)).where(F.col("c") <= SAMPLE)
    return numbered.select("label", "cell", "wanted", "slices", "c", "unit")


def split_cells(placed: DataFrame, radius: float) -> DataFrame:
    """``placed`` with cells of more than CHUNK points split: ``cell`` becomes
    that of the nearest centre, at ``far``; ``parent`` is the cell before."""
    sizes = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CHUNK)
    wanted = F.least(F.lit(MAX_CENTRES), 2 * F.ceil(F.col("size") / CHUNK))
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    sizes = shared_checkpoint(sizes.select("label", "cell", wanted.alias("wanted"), slices.alias("slices")))
    large = placed.join(sizes, ["label", "cell"])
    sample = first_of_cells(large)

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("c")["unit"].to_numpy()).astype(np.float64)
        first = pdf.iloc[0]
        c = x[thinned(x, radius, int(first["wanted"]))]
        return pd.DataFrame({"of": [first["label"]], "in": [first["cell"]], "slices": [first["slices"]], "centres": [c.ravel()]})

    net = sample.groupBy("label", "cell").applyInPandas(centres, "of string, in string, slices int, centres array<double>")
    shared = net.select("of", "in", "centres", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"))
    dealt = large.withColumn("slice", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("slices")).cast("int"))

    def nearest(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns=["wanted", "slices", "slice"])
        if not len(pdf):
            return pdf.assign(parent="", far=0.0, centre=None)
        x = np.stack(pdf["unit"].to_numpy()).astype(np.float64)
        centre = np.asarray(own["centres"].iloc[0], np.float64).reshape(-1, x.shape[1])
        cos = x @ centre.T
        near = cos.argmax(axis=1)
        child = pdf["cell"] + "." + near.astype(str)
        told = pd.Series(near).duplicated().to_numpy()  # a centre goes with one of its points only
        mid = [None if again else centre[k] for k, again in zip(near, told)]
        return pdf.assign(parent=pdf["cell"], cell=child, far=chord(cos.max(axis=1)), centre=mid)

    split = (
        dealt.groupBy("label", "cell", "slice")
        .cogroup(shared.groupBy("of", "in", "part"))
        .applyInPandas(nearest, f"{PLACED}, parent string, far double, centre array<double>")
    )
    return shared_checkpoint(split)


def euclid(a: str, b: str):
    square = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def chunk_pairs(points: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The chunks of ``points``, as ``(label, cell, cid, n, unit)``, and the pairs
    ``(label, a, b)`` of cells, a <= b, that may hold links."""
    t = math.sqrt(2 - 2 * threshold) + SLACK
    open_ = points.select("label", F.lit("0").alias("cell"), "cid", "n", "unit")
    placed: list[DataFrame] = []
    pairs = open_.select("label", F.col("cell").alias("a"), F.col("cell").alias("b")).distinct()
    for level in range(LEVELS):
        split = split_cells(open_, 0.5**level)
        small = open_.join(split.select("label", F.col("parent").alias("cell")).distinct(), ["label", "cell"], "left_anti")
        placed.append(small.select("label", "cell", "cid", "n", "unit"))
        made = split.groupBy("label", "parent", "cell").agg(F.max("far").alias("reach"), F.first("centre", ignorenulls=True).alias("mid"))
        open_ = split.select("label", "cell", "cid", "n", "unit")
        pairs = shared_checkpoint(descend(pairs, shared_checkpoint(made), t))
        if split.isEmpty():
            break
    # Where no radius parts a cell, a hash does; all parts keep its place in the pairs.
    parts = open_.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    dealt = open_.join(shared_checkpoint(parts), ["label", "cell"])
    cell = F.concat("cell", F.lit("#"), F.pmod(F.xxhash64("cid", F.lit(3)), F.col("parts")))
    dealt = dealt.select("label", F.col("cell").alias("parent"), cell.alias("cell"), "cid", "n", "unit")
    made = dealt.select("label", "parent", "cell").distinct()
    none = F.lit(None)
    made = made.select("*", none.cast("double").alias("reach"), none.cast("array<double>").alias("mid"))
    pairs = shared_checkpoint(descend(pairs, made, t).select("label", "a", "b"))
    placed.append(dealt.select("label", "cell", "cid", "n", "unit"))
    chunks = placed[0]
    for more in placed[1:]:
        chunks = chunks.unionByName(more)
    return chunks, pairs


def embedding_links(points: DataFrame, threshold: float) -> DataFrame:
    """(cid, links, root) of every chunk pair, for points of equal label."""
    chunks, pairs = chunk_pairs(points, threshold)
    sides = F.array(
        F.struct(F.col("a").alias("cell"), F.lit(0).alias("side")),
        F.when(F.col("a") != F.col("b"), F.struct(F.col("b").alias("cell"), F.lit(1).alias("side"))),
    )
    units = pairs.select("label", F.xxhash64("label", "a", "b").alias("work"), F.explode(sides).alias("e"))
    units = units.where("e is not null").select("label", "work", "e.*")
    sent = chunks.join(units, ["label", "cell"]).select("work", "side", "cid", "n", "unit")
    return sent.groupBy("work").applyInPandas(
        lambda pdf: unit_links(pdf, threshold), "cid long, links long, root long"
    )


def descend(pairs: DataFrame, made: DataFrame, t: float) -> DataFrame:
    """Pairs of cells one level down: those of ``made(label, parent, cell, reach,
    mid)`` in place of their parents, where the triangle inequality allows a
    pair within t. Cells without children stay; a cell that is not split by
    distance has no centre and is never ruled out."""
    down = pairs
    for side in ("a", "b"):
        child = made.select(
            "label", F.col("parent").alias(side), F.col("cell").alias(f"{side}_new"), F.col("reach").alias(f"{side}_reach"), F.col("mid").alias(f"{side}_mid")
        )
        keep = [c for c in down.columns if c not in ("label", side, f"{side}_reach", f"{side}_mid")]
        old = [F.col(c).alias(f"old_{c}") for c in (f"{side}_reach", f"{side}_mid") if c in down.columns]
        down = down.select("label", side, *keep, *old).join(child, ["label", side], "left")
        new = [F.coalesce(f"{side}_new", side).alias(side)]
        for c in (f"{side}_reach", f"{side}_mid"):
            new.append((F.coalesce(c, f"old_{c}") if f"old_{c}" in down.columns else F.col(c)).alias(c))
        down = down.select("label", *keep, *new)
    apart = euclid("a_mid", "b_mid") > F.col("a_reach") + F.col("b_reach") + t
    return down.where((F.col("a") <= F.col("b")) & ~F.coalesce(apart, F.lit(False)))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of
    ``vectors(vec_id, embedding, label)``.

    Only rows of one non-null label and one width are compared. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows
    without a label, link with nothing and are kept as their own component.
    Equal vectors link with each other. Repeated rows count as other vectors.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).withColumn("ok", F.coalesce(F.col("label").isNotNull() & ~bad & some, F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.col("embedding")))
    rows = rows.withColumn("label", F.when(F.col("ok"), F.concat_ws(":", "label", F.size("embedding"))))
    classes = rows.where("ok").groupBy("label", "key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    biggest = F.array_max(F.transform("key", lambda v: F.abs(v)))
    scaled = F.transform("key", lambda v: v / biggest)  # squares neither overflow nor vanish
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, v: s + v * v))
    classes = shared_checkpoint(
        classes.withColumn("scaled", scaled)
        .withColumn("unit", F.transform("scaled", lambda v: v / norm))
        .select(F.monotonically_increasing_id().alias("cid"), "label", "key", "low", "n", "unit")
    )
    found = shared_checkpoint(embedding_links(classes.select("label", "cid", "n", "unit"), threshold))
    links = shared_checkpoint(found.groupBy("cid").agg(F.sum("links").alias("links")))
    comp = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    comp = comp.join(classes.select(F.col("cid").alias("node"), "low"), "node")
    comp = shared_checkpoint(comp)
    least = comp.groupBy("component").agg(F.min("low").alias("least"))
    comp = comp.join(shared_checkpoint(least), "component").select(F.col("node").alias("cid"), "least")
    facts = (
        classes.join(links, "cid", "left")
        .join(comp, "cid", "left")
        .select(
            "label",
            "key",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("least", "low").alias("component_id"),
        )
    )
    good = rows.where("ok").join(facts, ["label", "key"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.col("ok")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    out = good.unionByName(rest)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_cover_tree": op4_cover_tree}
ORACLES: dict[str, str] = {}
