"""Phrases against counts of all n-grams in plain Python, and the SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from edulens.llm import phrases

DOCS = "doc_id long, text string, lang string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_count, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for m in (1, 2, 3, 4):
                for i in range(len(ws) - m + 1):
                    f[lang or "und", tuple(ws[i : i + m])] += 1
    f = {k: c for k, c in f.items() if c >= min_count}
    most = Counter()
    for (lang, g), c in f.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                most[lang, g[i : i + m]] = max(most[lang, g[i : i + m]], c)
    found = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and not (most[lang, g] and 100 * most[lang, g] >= 80 * a):
            score, k = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
            found.setdefault(lang, []).append((-score, -a, " ".join(g), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted(
        (lang, r, p, -a, x, y, n[lang], -s)
        for lang, all_ in found.items()
        for r, (s, a, p, x, y) in enumerate(sorted(all_)[:top], 1)
    )


def corpus(seed=5, n=120):
    rng = random.Random(seed)
    words = ["of", "The", "new", "york", "times", "straße", "日本", "a\u00a0b", "x", "é"]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(0, 80)):
            out.append(rng.choice(["new York times", "in the of", "a a a a a", *words, *words]))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "\x0b", "!"]))
        rows.append(("".join(out), rng.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), (" \t. ", "de"), ("only one", "fr")] + rows[:4]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("shard_words,block", [(phrases.SHARD_WORDS, phrases.BLOCK_BYTES), (50, 40), (7, 10)])
def test_phrases_equal_plain_counts(spark, monkeypatch, shard_words, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    rows = corpus()
    got = phrases.collocations(table(spark, rows).repartition(3), min_count=5, top=40, shard_words=shard_words)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 40)


def test_one_text_over_many_shards_counts_each_phrase_once():
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "b", "cc", "ddd", "e.", "verylongword" * 9]) for _ in range(3000))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "z z"])], ["lang", "text"])
    got, words = Counter(), Counter()
    for row in phrases.make_shards([batch], 0, 64, 50):
        listed = next(phrases.list_words([row.select(["shard", "words"])]))
        own = listed.column("word").to_pylist()
        words.update(dict(zip(own, listed.column("n").to_pylist())))
        for part in row.column("tokens")[0].as_py():
            at, follows, seen = phrases.unpack(part)
            for found, n in phrases.phrases(phrases.indexed(at + 1, follows, seen, 4), 4):
                for r, c in zip(found.tolist(), n.tolist()):
                    got[tuple(own[x - 1] for x in r)] += c
    want, want_words = Counter(), Counter()
    for piece in [*text.split("."), "z z"]:
        ws = piece.split()
        want_words.update(ws)
        for m in (2, 3, 4):
            want.update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    assert +got == want and words == want_words


def test_index_extends_both_ways():
    rng = np.random.default_rng(2)
    text = np.append(np.concatenate([[0], rng.integers(0, 5, 400)]), 0)
    index = phrases.FMIndex(text, 4)
    word, iv = index.words()
    row, right, pair = index.extend_right(iv)
    back, left, triple = index.extend_left(pair)
    got = {(int(a), int(word[row[b]]), int(right[b])): int(n) for b, a, n in zip(back, left, index.count(triple))}
    want = Counter(tuple(t) for t in np.stack([text[:-2], text[1:-1], text[2:]], 1).tolist() if 0 not in t)
    assert got == dict(want)


def test_empty_clashing_and_long(spark):
    rows = corpus(n=30)
    df = table(spark, rows).selectExpr("*", "1 AS n", "2 AS word", "3 AS key", "4 AS rank", "'p' AS phrase")
    assert phrases.collocations(df.limit(0)).count() == 0
    assert sorted(map(tuple, phrases.collocations(df, min_count=3).collect())) == plain(rows, 3, 2000)
    long_ = [("new york times " * 200_000, "en"), ("", None)]
    assert sorted(map(tuple, phrases.collocations(table(spark, long_)).collect())) == plain(long_, 30, 2000)


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(phrases.ORACLES["op12_phrase_collocations"]).fetchall()
    got = phrases.op12_phrase_collocations(spark, sf)
    assert [d[0] for d in con.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


@pytest.mark.parametrize("least", [30, 400])
def test_only_phrases_that_may_be_frequent_leave_their_shards(least):
    rng = random.Random(3)
    said = [rng.choice(["new york times", *(f"w{rng.randrange(500)}" for _ in range(30))]) for _ in range(30_000)]
    texts = [" ".join(said[at : at + 3000]) for at in range(0, len(said), 3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    rows = [r.drop_columns("size") for r in phrases.make_shards([batch], 0, 2000, 500)]
    sent = pa.Table.from_batches([b for r in rows for b in phrases.send_slots([r], 17, 12, 4, least)])
    assert len(rows) > 1 and sent.get_total_buffer_size() < 2 * 4 * 30_000
    left = {}
    for of in set(sent.column("range").to_pylist()):
        for x in phrases.slots_left(sent.filter(pc.field("range") == of), 12, least).to_pylist():
            left.setdefault(x["shard"], []).append({"range": x["range"], "slots": x["slots"]})
    got = Counter()
    for r in rows:
        own = r.append_column("left", pa.array([left.get(r.column("shard")[0].as_py())]))
        for packed in phrases.count_left([own], 17, 12, 4):
            for at in range(packed.num_rows):
                for x in phrases.add_counts(pa.Table.from_batches([packed.slice(at, 1)]), 1).to_pylist():
                    got[x["lang"], tuple(x["phrase"].split())] += x["f"]
    want = Counter({("en", ()): sum(len(t.split()) for t in texts)})
    for t in texts:
        ws = t.split()
        for m in (1, 2, 3, 4):
            want.update(("en", tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    frequent = {g for g, f in want.items() if f >= least}
    assert ("en", ("new", "york", "times")) in frequent
    assert all(got[g] == f for g, f in want.items() if g in frequent or g in got)
    assert len(got) - len(frequent) < 0.01 * len(want)


def test_rare_phrases_take_little_shuffle(spark):
    rng = np.random.default_rng(4)
    rows = [(" ".join(f"w{x}" for x in rng.integers(0, 3000, 10_000)), "en") for _ in range(40)]
    df = table(spark, rows).repartition(2).localCheckpoint()

    def written():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    before = written()
    assert phrases.collocations(df).count() == 0
    assert 0 < written() - before < 8 * 400_000


@pytest.mark.parametrize("bits", [20, 32, 34])
def test_slots_of_any_width_are_sent_whole(bits):
    rng = random.Random(6)
    text = " ".join(rng.choice(["a", "b.", *(f"w{x}" for x in range(300))]) for _ in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    for row in phrases.make_shards([batch], 0, 300, 100):
        row = row.drop_columns("size")
        listed = pa.Table.from_batches(phrases.list_words([row.select(["shard", "words"])]))
        want = Counter()
        for part in row.column("tokens")[0].as_py():
            at, follows, _ = phrases.unpack(part)
            for own in phrases.phrase_hashes(phrases.word_hashes(listed)[at], follows, 4):
                want.update(phrases.slot(own, bits).tolist())
        for least in (1, 2, 4):
            sent = pa.Table.from_batches(phrases.send_slots([row], bits, bits - 8, 4, least))
            got = set()
            for x in range(sent.num_rows):
                for left in phrases.slots_left(sent.slice(x, 1), bits - 8, least).to_pylist() if bits < 32 else ():
                    own = phrases.unpack_slots(phrases.zstandard.decompress(left["slots"]))
                    got.update((own + (left["range"] << bits - 8)).tolist())
            if bits < 32:
                assert got == {k for k, n in want.items() if n >= least}
            raw = [phrases.zstandard.decompress(x) for x in sent.column("slots").to_pylist()]
            of = sent.column("range").to_pylist()
            sent_ = [(phrases.unpack_slots(x[: len(x) // 5 * 4]) + (z << bits - 8)).tolist() for x, z in zip(raw, of)]
            assert sorted(x for s in sent_ for x in s) == sorted(want)
            assert sum(sum(x[len(x) // 5 * 4 :]) for x in raw) == sum(min(n, least) for n in want.values())
