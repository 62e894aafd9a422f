"""SimHash near-duplicates through a distributed vantage-point tree.

Fingerprints are partitioned by their Hamming distance to vantage points. At a
node the near side takes everything up to the median plus the radius, the far
side everything beyond the median. By the triangle inequality a pair within the
radius is then together on one side, so every such pair meets in some leaf, and
only the fingerprints just beyond a median go both ways. Inside a leaf the same
tree goes on in memory down to blocks compared directly.

Scale: copies collapse to one fingerprint before anything is shuffled; leaves
emit a spanning forest of their links, never all pairs. The top tree is built
from a sample of about ``SAMPLE * 2**MAX_DEPTH`` fingerprints at most and is
all that is broadcast. A level sends about 1.2 copies of a fingerprint, which
is what exactness at radius 2 costs in 64 nearly independent bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, shared_checkpoint, spanning_forest, table

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
LEAF = 16384
MIN_DEPTH, MAX_DEPTH = 6, 16
SAMPLE = 8
BLOCK = 256
HELD_EDGES = 1_000_000
SIMILARITY = 0.8
#: Bounds of a block of a family whose parts are compared.
FAMILY_ROWS, FAMILY_BYTES = 1024, 16_000_000
COLUMNS = 4096  # shingles in a matrix at once


@dataclass(frozen=True)
class Nearness:
    """What counts as near, and how the trees look for it."""

    shingle: int
    words: int  # 64-bit words of a fingerprint
    radius: int  # differing bits over all words
    overlap: int  # bits beyond a median that both sides get
    trees: int
    coarse: int = 64  # bits of the tree's own word, beyond which a pair is not looked at
    forests: int = 1  # edge-disjoint forests that a leaf emits


EXACT = Nearness(SHINGLE_WORDS, 1, RADIUS, RADIUS, 1)
# Candidates for similarity 0.8: such sets have a cosine of 0.89, so 15 % of the
# bits differ: 39 of 256, with a standard deviation of 5.8. Unrelated texts
# differ in 128, give or take 8.
SIMILAR = Nearness(5, 4, 56, 3, 3, coarse=21, forests=2)


def shingle_hashes(text: str | None, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the k-word shingles of one text, repeats included; of the whole
    word sequence if it is shorter; none if there are no words.

    bytes.lower() touches A-Z only and bytes.split() cuts at 0x20 and 0x09-0x0D.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= k:
        return np.array([digest(joined, seed)][: len(parts)], np.uint64)
    length = np.fromiter(map(len, parts), np.int64, len(parts))
    end = np.cumsum(length + 1) - 1
    spans = zip((end - length)[: 1 - k].tolist(), end[k - 1 :].tolist())
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(h: np.ndarray, words: int = 1) -> list[int]:
    """SimHash of a text's shingle hashes, as signed 64-bit words; the first is
    the plain one, more come from remixing the hashes. Without shingles every
    word is 0."""
    out = []
    for _ in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            bits = np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8)).reshape(-1, 64)
            ones += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h)).view(">i8")[0]))
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return out


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, text)``: rows are told apart by their id and a hash of their text."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")
    )


def fingerprints(rows: DataFrame, k: int = SHINGLE_WORDS, words: int = 1, sets: bool = False) -> DataFrame:
    """``(doc_id, h, same, f0, f1, ...)`` for every row of ``keyed``; null and
    blank texts have 0 in every word. ``same`` is a hash of the set of shingles
    where ``sets`` are wanted, else 0."""
    names = ["same", *[f"f{w}" for w in range(words)]]

    def facts(text: str | None) -> list[int]:
        h = shingle_hashes(text, k)
        same = xxhash.xxh64_intdigest(np.unique(h).tobytes()) if sets else 0
        return [same - (same >> 63 << 64), *fingerprint(h, words)]

    def run(batches):
        for b in batches:
            found = np.array([facts(t.as_py()) for t in b.column("text")], np.int64).reshape(-1, words + 1)
            columns = [b.column("doc_id"), b.column("h"), *map(pa.array, found.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", *names])

    return rows.mapInArrow(run, "doc_id long, h long, " + ", ".join(f"{n} long" for n in names))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def build_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and median radii of a complete tree in heap order."""
    size = 2**depth - 1
    point, radius = np.zeros(size, np.uint64), np.full(size, 32, np.int16)
    parts = {0: sample}
    for node in range(size):
        own = parts.pop(node, sample[:0])
        if len(own):
            point[node] = own[0]
            d = distance(own, own[0])
            rest = np.sort(d[1:]) if len(d) > 1 else d
            radius[node] = rest[(len(rest) - 1) // 2]
            parts[2 * node + 1], parts[2 * node + 2] = own[d <= radius[node]], own[d > radius[node]]
    return point, radius


def route(fp: np.ndarray, point: np.ndarray, radius: np.ndarray, depth: int, t: int):
    """(row, leaf) of every leaf that a fingerprint goes to."""
    row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    for _ in range(depth):
        d, mu = distance(fp[row], point[node]), radius[node]
        near, far = d <= mu + t, d > mu
        row, node = (
            np.concatenate([row[near], row[far]]),
            np.concatenate([2 * node[near] + 1, 2 * node[far] + 2]),
        )
    return row, node


def link_leaf(fp: np.ndarray, t: int):
    """Yield (i, j, bits) of pairs i < j within t, by the tree inside a leaf; a
    pair may come more than once."""
    todo = [np.arange(len(fp))]
    while todo:
        p = todo.pop()
        if len(p) > BLOCK:
            d = distance(fp[p], fp[p[len(p) // 2]])
            mu = np.sort(d)[(len(d) - 1) // 2]
            near, far = p[d <= mu + t], p[d > mu]
            if max(len(near), len(far)) <= 0.9 * len(p):
                todo += [near, far]
                continue
        for a in range(0, len(p), BLOCK):
            for b in range(a, len(p), 4096):
                pp, qq = p[a : a + BLOCK], p[b : b + 4096]
                d = np.bitwise_count(fp[pp][:, None] ^ fp[qq][None])
                i, j = np.nonzero((d <= t) & (pp[:, None] < qq[None]))
                yield pp[i], qq[j], d[i, j].astype(np.int64)


def compare_leaf(fp: np.ndarray, word: int, coarse: int, radius: int):
    """Yield (i, j, bits) of pairs i < j within ``radius`` over all words, looked
    at in full where word ``word`` alone is within ``coarse``."""
    for a in range(0, len(fp), BLOCK):
        p = fp[a : a + BLOCK]
        for b in range(a, len(fp), 1024):
            q = fp[b : b + 1024]
            i, j = np.nonzero(np.bitwise_count(p[:, word][:, None] ^ q[:, word][None]) <= coarse)
            ahead = a + i < b + j
            i, j = i[ahead], j[ahead]
            d = np.bitwise_count(p[i] ^ q[j]).sum(axis=1, dtype=np.int64)
            near = d <= radius
            yield a + i[near], b + j[near], d[near]


def leaf_forest(pdf: pd.DataFrame, near: Nearness) -> pd.DataFrame:
    """Spanning forests of least bits over the links of one leaf, as (a, b) row numbers."""
    pdf = pdf.sort_values("row", ignore_index=True)
    fp = pdf[[f"f{w}" for w in range(near.words)]].to_numpy(np.int64).view(np.uint64)

    def thin(parts: list) -> np.ndarray:
        rest, kept = np.concatenate(parts, axis=1), []
        for _ in range(near.forests):
            pick = spanning_forest(len(fp), *rest)
            kept.append(rest[:, pick])
            rest = np.delete(rest, pick, axis=1)
        return np.concatenate(kept, axis=1)

    if near.words == 1:
        found = link_leaf(fp[:, 0], near.radius)
    else:
        found = compare_leaf(fp, int(pdf["leaf"].iloc[0] >> 32), near.coarse, near.radius)
    held, size = [np.zeros((3, 0), np.int64)], 0
    for edges in found:
        held.append(np.stack(edges))
        size += len(edges[0])
        if size > HELD_EDGES:
            held, size = [thin(held)], 0
    row = pdf["row"].to_numpy(np.int64)
    a, b, _ = thin(held)
    return pd.DataFrame({"a": row[a], "b": row[b]})


def near_links(uniq: DataFrame, near: Nearness) -> DataFrame:
    """Edges ``(a, b)`` between rows of ``uniq(row, f0, f1, ...)`` that connect
    the fingerprints reachable by steps within ``near.radius``.

    With ``radius <= overlap`` every link is found. Beyond that, the distances
    of two fingerprints to a vantage point still differ by about the root of
    their own distance only, and each of ``near.trees`` trees on its own word
    is another chance to meet.
    """
    n = uniq.count()
    depth = min(MAX_DEPTH, max(MIN_DEPTH, math.ceil(math.log2(max(n, 1) / LEAF))))
    names = [f"f{w}" for w in range(near.words)]
    share = min(1.0, SAMPLE * 2**depth / max(n, 1))  # of the hash range, so about that share of the rows
    below = F.lit(int(-(2**63) + share * (2**64 - 1025)))
    rows = uniq.where(F.xxhash64("f0", F.lit(1)) <= below).select(*names).collect()
    sample = np.array(sorted(rows), np.int64).reshape(-1, near.words).view(np.uint64)
    np.random.default_rng(SEED).shuffle(sample)
    trees = uniq.sparkSession.sparkContext.broadcast(
        [build_tree(sample[:, w], depth) for w in range(near.trees)]
    )

    def assign(batches):
        for pdf in batches:
            for w, (point, mu) in enumerate(trees.value):
                fp = pdf[f"f{w}"].to_numpy(np.int64).view(np.uint64)
                row, leaf = route(fp, point, mu, depth, near.overlap)
                yield pdf.iloc[row].assign(leaf=leaf + (w << 32))

    columns = "row long, " + ", ".join(f"{n} long" for n in names) + ", leaf long"
    placed = uniq.select("row", *names).mapInPandas(assign, columns)
    return placed.groupBy("leaf").applyInPandas(lambda pdf: leaf_forest(pdf, near), "a long, b long")


def shingle_sets(links: DataFrame, uniq: DataFrame, rows: DataFrame, near: Nearness) -> DataFrame:
    """``(row, shingles)`` for every row that has a link: 32 bits of each shingle's
    hash, sorted. Texts of one set are one row of ``uniq``, under the text of its
    first row."""

    def sets(batches):
        for b in batches:
            found = [np.unique(shingle_hashes(t.as_py(), near.shingle).astype("<u4")) for t in b.column("text")]
            data = pa.array([s.tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), data], ["row", "shingles"])

    ends = links.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    key = uniq.join(ends, "row").select("row", "low.*")
    texts = rows.select("text", "h", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"))
    texts = texts.join(key, ["none", "id", "h"]).select("row", "text").dropDuplicates(["row"])
    return shared_checkpoint(texts.mapInArrow(sets, "row long, shingles binary"))


def confirmed(links: DataFrame, own: DataFrame) -> DataFrame:
    """The links whose sets of shingles are similar by SIMILARITY or more. Sets
    travel with links, one or two a text."""

    def similar(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("left"), b.column("right")):
                x, y = (np.frombuffer(s.as_py(), "<u4") for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = own.select(F.col("row").alias("a"), F.col("shingles").alias("left"))
    right = own.select(F.col("row").alias("b"), F.col("shingles").alias("right"))
    pairs = links.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return shared_checkpoint(pairs.mapInArrow(similar, "a long, b long"))


def verified_pairs(row: np.ndarray, label: np.ndarray, side: np.ndarray, fp: np.ndarray, sets: list, radius: int):
    """Edges that join parts of two blocks of one family (``side`` 0 and 1, or 0
    alone), each confirmed on the sets. Parts that are joined are not compared
    again; every other pair within ``radius`` bits of different parts is."""
    size = np.array([len(s) for s in sets])
    one = not side.any()
    first = np.nonzero(side == 0)[0]
    second = first if one else np.nonzero(side == 1)[0]
    both = in_common(sets, first, second)
    part = np.unique(label, return_inverse=True)[1]
    found = []
    for i, x in enumerate(first):
        near = np.minimum(size[second], size[x]) >= SIMILARITY * np.maximum(size[second], size[x])
        near &= (part[second] != part[x]) & (both[i] >= SIMILARITY * (size[x] + size[second] - both[i]))
        other = second[near]
        if one:
            other = other[other > x]
        other = other[np.bitwise_count(fp[other] ^ fp[x]).sum(axis=1, dtype=np.int64) <= radius]
        for y in other:
            if part[y] != part[x]:
                found.append((row[x], row[y]))
                part[part == part[y]] = part[x]
    return found


def in_common(sets: list, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets ``first`` has in common with each of
    ``second``: products of 0-1 matrices over the shingles that two sets have."""
    out = np.zeros((len(first), len(second)), np.float32)
    every = np.concatenate(sets)
    if not len(every):
        return out
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = times[column] > 1
    row, column = row[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[a:b], column[a:b] - at] = 1
        out += held[first] @ held[second].T
    return out


def family_links(links: DataFrame, held: DataFrame, own: DataFrame, uniq: DataFrame, near: Nearness) -> DataFrame:
    """Further edges, so that nothing is lost where links of a forest failed.

    A family is what ``links`` connect, whether they held or not: forests span a
    leaf's candidates, so every pair of candidates lies in one family. Where the
    links that held leave a family in parts, the parts are compared with their
    sets, in pairs of blocks of a bounded number of rows and bytes. Blocks of one
    part are not paired with each other, so a large part that holds together is
    sent once a block of the rest.
    """
    names = [f"f{w}" for w in range(near.words)]
    label = connected_components(held).select(F.col("node").alias("row"), F.col("component").alias("label"))
    members = connected_components(links).select(F.col("node").alias("row"), F.col("component").alias("family"))
    members = members.join(label, "row", "left").withColumn("label", F.coalesce("label", "row"))
    members = shared_checkpoint(members.join(own.select("row", F.length("shingles").alias("bytes")), "row"))
    apart = members.groupBy("family").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    open_ = shared_checkpoint(members.join(shared_checkpoint(apart.select("family")), "family"))

    weight = F.lit(1 / FAMILY_ROWS) + F.col("bytes") / FAMILY_BYTES
    parts = open_.groupBy("family", "label").agg(F.sum(weight).alias("w"))
    few = parts.where("w < 1").groupBy("family").agg(F.ceil(F.sum("w")).alias("n"))
    parts = parts.join(few, "family", "left").select(
        "family", "label", F.when(F.col("w") >= 1, F.col("label")).otherwise(-1).alias("part"),
        F.when(F.col("w") >= 1, F.ceil("w")).otherwise(F.col("n")).alias("n"),
    )
    placed = open_.join(shared_checkpoint(parts), ["family", "label"])
    by = F.when(F.col("part") >= 0, F.col("row")).otherwise(F.col("label"))
    block = F.struct("part", F.pmod(F.xxhash64(by), F.col("n")).alias("k")).alias("block")
    placed = shared_checkpoint(placed.select("row", "family", "label", block))
    blocks = placed.select("family", "block").distinct()
    first, second = (blocks.select("family", F.col("block").alias(c)) for c in ("x", "y"))
    pure = (F.col("x.part") == F.col("y.part")) & (F.col("x.part") >= 0)
    pairs = shared_checkpoint(first.join(second, "family").where((F.col("x") <= F.col("y")) & ~pure))
    sent = [
        placed.withColumnRenamed("block", c).join(pairs if c == "x" else pairs.where("x <> y"), ["family", c])
        .select("row", "label", "family", "x", "y", F.lit(k).alias("side"))
        for k, c in enumerate(("x", "y"))
    ]
    held_rows = own.join(uniq.select("row", *names), "row")
    sent = sent[0].unionByName(sent[1]).join(held_rows, "row")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "row"], ignore_index=True)
        fp = pdf[names].to_numpy(np.int64).view(np.uint64)
        sets = [np.frombuffer(s, "<u4") for s in pdf["shingles"]]
        edges = verified_pairs(*(pdf[c].to_numpy() for c in ("row", "label", "side")), fp, sets, near.radius)
        return pd.DataFrame(edges, columns=["a", "b"], dtype=np.int64)

    return sent.groupBy("family", "x", "y").applyInPandas(compare, "a long, b long")


def similar_links(links: DataFrame, uniq: DataFrame, rows: DataFrame, near: Nearness) -> DataFrame:
    """Edges confirmed on the sets of shingles that connect all that ``links`` and
    the other candidates of their families connect."""
    links = shared_checkpoint(links.distinct())
    own = shingle_sets(links, uniq, rows, near)
    held = confirmed(links, own)
    return held.unionByName(shared_checkpoint(family_links(links, held, own, uniq, near)))


def groups(rows: DataFrame, near: Nearness, check: bool = False) -> DataFrame:
    """``(doc_id, h, f0, ..., least)`` for every row of ``keyed``; ``least`` is
    ``struct<none, id, h>`` of the first row of its group, those without an id
    last. With ``check`` links are confirmed on the sets of shingles, also those
    between texts of one fingerprint."""
    names = [f"f{w}" for w in range(near.words)]
    fps = shared_checkpoint(fingerprints(rows, near.shingle, near.words, check))
    names.append("same")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    uniq = fps.groupBy(*names).agg(F.min(first).alias("low"))
    uniq = shared_checkpoint(uniq.withColumn("row", F.monotonically_increasing_id()))
    links = near_links(uniq, near)
    comp = connected_components(similar_links(links, uniq, rows, near) if check else links)
    comp = shared_checkpoint(comp.join(uniq.select(F.col("row").alias("node"), "low"), "node"))
    least = shared_checkpoint(comp.groupBy("component").agg(F.min("low").alias("least")))
    linked = comp.join(least, "component").select(F.col("node").alias("row"), "least")
    classes = uniq.join(linked, "row", "left").select(*names, F.coalesce("least", "low").alias("least"))
    return fps.join(classes, names)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest non-null id reachable by links of at most
    RADIUS differing bits (null only if no reachable row has an id). Repeated
    rows are kept; other columns are not looked at; an empty table gives an
    empty result.
    """
    return groups(keyed(docs, id_col, text_col), EXACT).select(
        "doc_id",
        F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"),
        F.when(~F.col("least.none"), F.col("least.id")).alias("component_id"),
    )


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates at SIMILAR (five-word
    shingles, similarity of 0.8 or more, confirmed on the sets) the row with the
    smallest id stays, unchanged; rows without an id come last, and of repeated
    rows one stays. Different texts under one id are different documents. Null,
    empty and blank texts are one group; an empty table gives an empty result;
    columns may have any name.
    """
    whole = docs.select(F.struct("*").alias("doc"))
    found = groups(keyed(whole, "doc.doc_id", "doc.text"), SIMILAR, check=True)
    own = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h")]
    keep = found.where(F.struct(*own) == F.col("least")).select("least.*").distinct()
    rows = whole.withColumns({"doc_id": F.col("doc.doc_id").cast("long"), "h": F.xxhash64("doc.text")})
    keys = ["none", "id", "h"]
    kept = rows.select("doc", *own).join(keep, keys, "left_semi").dropDuplicates(keys)
    return kept.select("doc.*")


QUERIES = {"op1_simhash_vptree": op1_simhash_vptree}
ORACLES: dict[str, str] = {}
