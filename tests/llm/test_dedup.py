"""Near-duplicates, embeddings and substrings against brute force, and edges."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from edulens.llm import common, embeddings, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def reach(ids, linked):
    """Smallest id that each index reaches."""
    out = [None] * len(ids)
    for i in range(len(ids)):
        if out[i] is None:
            todo, seen = [i], {i}
            while todo:
                k = todo.pop()
                for j in range(len(ids)):
                    if j not in seen and linked[k][j]:
                        seen.add(j)
                        todo.append(j)
            low = min((ids[k] for k in seen if ids[k] is not None), default=None)
            for k in seen:
                out[k] = low if low is not None else "none"
    return [None if x == "none" else x for x in out]


def simhash_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def some_texts(seed=1, n=80):
    rng = random.Random(seed)
    words = [f"wörd{k}" for k in range(60)]
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 400)))
        out.append(t)
        if rng.random() < 0.4:
            parts = t.split()
            parts[rng.randrange(len(parts))] = "other"
            out.append(" ".join(parts))
    return out


def test_simhash_equals_brute_force(spark):
    texts = some_texts() + [None, "", "  \n", "A", "a", "a b", "A B"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "a", "x", "y", 1), (3, texts[3], None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()]
    f = [simhash_brute(t) for _, t, *_ in rows]
    comp = reach([r[0] for r in rows], [[bin(a ^ b).count("1") <= 2 for b in f] for a in f])
    want = [(r[0], f"{x:016x}", c) for r, x, c in zip(rows, f, comp)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_trees_find_all_pairs_in_memory():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near, np.arange(40, dtype=np.uint64)]))
    tree = simhash.build_tree(fp[:200], 6)
    row, leaf = simhash.route(fp, *tree, 6, 2)
    assert set(row) == set(range(len(fp)))
    found = set()
    for k in np.unique(leaf):
        own = row[leaf == k]
        for i, j, bits in simhash.link_leaf(fp[own], 2):
            assert (np.bitwise_count(fp[own[i]] ^ fp[own[j]]) == bits).all()
            found |= {tuple(sorted(p)) for p in zip(own[i], own[j])}
    want = {(i, j) for i in range(len(fp)) for j in np.nonzero(np.bitwise_count(fp[i] ^ fp) <= 2)[0] if i < j}
    assert found == want


def family_texts(changed, families=4, size=300, words=304, seed=9):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"w{f}x{k}" for k in range(words)]
        for _ in range(size):
            own = base[:]
            for p in rng.sample(range(words), changed):
                own[p] = f"r{rng.randrange(10**9)}"
            out.append(" ".join(own))
    return out


def kept_exactly(texts):
    """Rows that exact grouping at 0.8 on five-word shingle sets leaves."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label, holders = np.arange(len(sets)), {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        both = Counter(j for x in s for j in holders[x] if j < i)
        j = [j for j, n in both.items() if n >= 0.8 * (len(s) + len(sets[j]) - n)]
        label = common.merge_labels(label, np.full(len(j), i), np.array(j, np.int64))
    return set(np.unique(label).tolist())


@pytest.mark.parametrize("changed,rows_a_block", [(5, 1024), (4, 1024), (5, 40), (4, 40)])
def test_families_near_the_threshold_lose_no_links(spark, monkeypatch, changed, rows_a_block):
    monkeypatch.setattr(simhash, "FAMILY_ROWS", rows_a_block)
    texts = family_texts(changed)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark, df, "").select("doc_id").collect()}
    want = kept_exactly(texts)
    assert want <= got  # nothing goes that exact grouping keeps
    assert len(texts) - len(got) >= 0.95 * (len(texts) - len(want))


@pytest.mark.parametrize("depth", [6, 10, 14])
def test_copies_of_a_fingerprint_grow_slowly(depth):
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**64 - 1, 200_000, dtype=np.uint64)
    row, _ = simhash.route(fp, *simhash.build_tree(fp[: 8 * 2**depth], depth), depth, simhash.RADIUS)
    assert len(row) <= 1.27**depth * len(fp)


def test_leaf_forests_span_and_do_not_share_edges():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, (40, 4), dtype=np.uint64)
    fp = np.repeat(base, 20, axis=0)
    for w in range(4):
        fp[:, w] ^= np.uint64(1) << rng.integers(0, 63, len(fp)).astype(np.uint64)
    pdf = pd.DataFrame(fp.view(np.int64), columns=["f0", "f1", "f2", "f3"]).assign(row=np.arange(len(fp)) * 3, leaf=0)
    got = simhash.leaf_forest(pdf, simhash.SIMILAR)
    assert len(got) == len(got.drop_duplicates()) <= 2 * len(fp)
    label = common.merge_labels(np.arange(len(fp)), got["a"].to_numpy() // 3, got["b"].to_numpy() // 3)
    assert (label == np.repeat(np.arange(40) * 20, 20)).all()


def test_stage_confirms_similarity_and_recalls_near_copies(spark):
    """Edited copies on both sides of similarity 0.8, against the sets themselves."""
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        t = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts.append(t)
        for edits in (3, 6, 8, 12, 20):
            c = list(t)
            for k in rng.sample(range(300), edits):
                c[k] = "edit"
            texts.append(c)
    df = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark, df, "").collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(296)} for t in texts]
    linked = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    want = {i for i, c in enumerate(reach(list(range(len(texts))), linked)) if i == c}
    assert want <= kept  # nothing goes that is not similar
    assert len(kept - want) <= 0.03 * (len(texts) - len(want))


def test_stage_bears_any_columns_and_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "x"), (2, None, "z"), (3, "", "z"), (None, b, "n"), (None, "own text", "n"), (None, "own text", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = ["h", "f0", "id", "none", "least", "low", "row", "_id", "_key", "leaf", "doc"]
    for name in own:
        df = df.withColumn(name, F.lit(name))
    got = simhash.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (1, b), (2, None), (None, "own text")], key=str)
    assert all(r[n] == n for r in got.collect() for n in own)
    assert simhash.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_components_of_a_hub(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 3000) for k in range(1, 3000, 7)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.component for r in got} == {0} and len(got) == 3000 + len(range(1, 3000, 7))


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(30)]
    rows = []
    for k, t in enumerate(base):
        rows += [(10 * k, t, "en", "s", len(t)), (10 * k + 1, t, "en", "s", len(t))]
        parts = t.split()
        parts[rng.randrange(300)] = "edited"
        rows.append((10 * k + 2, " ".join(parts), "en", "s", 1))
    rows += [(None, "no id here", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = simhash.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted([10 * k for k in range(30)] + [None], key=str)


def test_components_settle_on_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (None, 3), (7, 3)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 60)
    monkeypatch.setattr(embeddings, "MAX_CENTRES", 3)
    rng = np.random.default_rng(0)
    base, rows = rng.normal(size=(15, 8)), []
    for k in range(240):
        v = base[rng.integers(15)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.2, 0.5])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    bad = [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf")] * 8, [None] * 8]
    rows += [(900 + i, v, 1) for i, v in enumerate(bad)] + [(910, [1.0, 2.0], 1), (911, [2.0, 4.0], 1), (912, [1.0, 2.0], None), (None, [1.0, 2.0], 1)]

    def fine(r):
        return r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    def close(a, b):
        if not (fine(a) and fine(b)) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1], float), np.array(b[1], float)
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93

    linked = [[a is not b and close(a, b) for b in rows] for a in rows]
    comp = reach([r[0] for r in rows], linked)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(df).collect()), key=str)
    assert got == sorted(((r[0], sum(l), c) for r, l, c in zip(rows, linked, comp)), key=str)
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def substrings_brute(rows, n):
    data = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_long_texts_are_named_piece_by_piece(monkeypatch):
    rng = random.Random(2)
    texts = sorted((rng.randbytes(k) for k in (150, 3000, 260, 9000, 220)), key=lambda t: hashlib.sha256(t).hexdigest())
    pdf = pd.DataFrame(
        {
            "digest": [[hashlib.sha256(t).hexdigest() for t in texts]], "n": [[1] * len(texts)],
            "size": [[len(t) for t in texts]], "data": [zstandard.ZstdCompressor().compress(b"".join(texts))],
        }
    )
    block = substrings.Block(pdf, 200)
    whole = block.named(block.round1(), 68, True)
    for chunk in (100, 701, 4000):
        monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
        assert all((a == b).all() for a, b in zip(whole, block.named(block.round1(), 68, True)))
    assert len(whole[0]) == sum(map(len, block.round1())) > 500


@pytest.mark.parametrize("n", [200, 50])
def test_substrings_equal_brute_force(spark, n):
    rng = random.Random(n)
    rnd = lambda k: "".join(rng.choice("abcdefgh é\n") for _ in range(k))
    shared = [rnd(int(n * f)) for f in (0.8, 0.99, 1, 1.01, 1.3, 1.7, 3, 8)]
    rows = []
    for i in range(90):
        t = rnd(rng.randint(0, 4 * n))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            p = p[rng.randint(0, n // 4) :][: rng.randint(n // 2, 8 * n)]
            c = rng.randint(0, len(t))
            t = t[:c] + p + t[c:]
        rows.append((i, t))
    rows += [(500, "ab" * n), (501, None), (502, ""), (503, rows[3][1]), (504, rows[3][1]), (504, rows[3][1]), (505, "z" * (n - 1)), (506, "z" * (n - 1)), (507, "y" * n), (None, "q" * (n + 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(None if pd.isna(x) else x for x in r) for r in substrings.remove_repeats(df, n).collect()), key=str)
    assert got == substrings_brute(rows, n)


def test_substrings_empty_table_and_stage(spark):
    df = spark.createDataFrame([], DOCS)
    assert substrings.remove_repeats(df).count() == 0
    long = "".join(chr(97 + i * i % 26) for i in range(300)) + "é" * 20
    rows = [(1, "start " + long, "en", "s", 9), (2, long + " end", "en", "s", 9), (3, "clean", "en", "s", 5), (4, None, "en", "s", None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in substrings.cut_repeats(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got == {1: ("start ", 6), 2: (" end", 4), 3: ("clean", 5), 4: (None, None)}


def test_centres_are_sought_without_sorting_whole_cells(spark):
    large = spark.range(5000).selectExpr("string(id % 2) AS label", "string(id % 2) AS cell", "id AS cid", "2L AS wanted", "1 AS slices", "array(1.0D) AS unit")
    first = embeddings.first_of_cells(large)
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    assert first.count() == 2 * embeddings.SAMPLE
