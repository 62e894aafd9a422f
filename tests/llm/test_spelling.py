"""Spelling variants against every pair of words compared in plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from edulens.llm import spelling

DOCS = "doc_id long, text string"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def corpus(seed=3):
    rng = random.Random(seed)
    seeds = ["spelling", "Variante", "großartig", "éléphant", "aaaaaaaa", "aaaabaaa", "ÉLÉPHANT", "naïveté×÷", "zzzzzzz"]
    pool = []
    for s in seeds:
        pool += [s] * 150
        for _ in range(12):
            p = rng.randrange(len(s))
            pool += [s[:p] + s[p + 1 :], s[:p] + rng.choice("aezéß") + s[p:], s[:p] + rng.choice("bqüA") + s[p + 1 :]] * rng.choice([1, 3, 16])
    rows = []
    for i in range(300):
        rows.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) + rng.choice([".", "\n", "1x", "_"])))
    chain = ["chainword"] * 2 + ["chainwords"] * 25 + ["chainswords"] * 300
    rows.append((10**12 + 1, " ".join(chain)))
    rows += [(7, None), (8, ""), (None, "spelling spelling éléphant"), (9, "x" * 3000 + " " + "y" * 3000), (10, "x" * 3000 + " " + "y" * 3000)]
    return rows + rows[:5]


@pytest.mark.parametrize("at_once", [spelling.FILTER_WORDS, 40])
def test_variants_equal_all_pairs(spark, at_once):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = spelling.spelling_variants(df, at_once=at_once)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[1] and r[1] != r[2] for r in want)


def test_clashing_columns_and_empty(spark):
    rows = [(1, "spelling spelling spellings spellings", "w", 3), (2, None, "x", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    assert sorted(map(tuple, spelling.spelling_variants(df).collect())) == plain([r[:2] for r in rows])
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    held, others = rng.integers(0, 2**63, 20000).astype(np.uint64), rng.integers(0, 2**63, 20000).astype(np.uint64)
    blocks = 20000 * spelling.BITS_PER_WORD // 512
    slots = np.zeros(blocks * spelling.BLOCK_SLOTS, np.uint64)
    for slot, mask in spelling.places(held, blocks):
        np.bitwise_or.at(slots, slot, mask)
    assert len(spelling.in_filter(slots, held)) == len(held)
    assert len(spelling.in_filter(slots, others)) < 100


def test_whole_table(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    assert sorted(map(tuple, spelling.op11_spelling_variants(spark, "/root/testdata/sf0.001").collect())) == plain(rows)
