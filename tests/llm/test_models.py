"""Scores and verdicts of whole queries against plain versions, and exact ids."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from edulens.llm import language, quality_model, rules, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 2**60 + 1  # no double holds it


def corpus(seed, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        vocab = [f"w{rng.randrange(rng.choice([8, 40, 400]))}" for _ in range(30)]
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 260)))
        if rng.random() < 0.4:
            t += "\n" + "\n".join(rng.choice(["a line of words", "x # y", "| $ | $"]) for _ in range(rng.randint(1, 30)))
        out.append(t)
    return out + [None, "", "123", "word " * 500, " ".join(f"v{k}" for k in range(20_000))]


def frame(spark, texts):
    rows = [(BIG + k, t, None, "s", None) for k, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_scores_equal_a_dense_pairwise_sum(spark):
    texts = corpus(1)
    model = np.random.default_rng(2).normal(0, 0.3, (1 + quality_model.SIZE, 1 + quality_model.RANK))
    model = model.astype(np.float32).astype(np.float64)
    got = {r.doc_id: r for r in quality_model.classify(frame(spark, texts), model).collect()}
    assert None in got and len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        idx, val = quality_model.features(t)
        w, v = model[1 + idx, 0], model[1 + idx, 1:] * val[:, None].astype(np.float64)
        pair = v @ v.T
        z = model[0, 0] + w @ val + (pair.sum() - np.trace(pair)) / 2
        want = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert np.isclose(got[BIG + k].score, want, atol=1e-6), k
        assert got[BIG + k].predicted == int(got[BIG + k].score >= 0.3)
    assert quality_model.classify(frame(spark, texts).limit(0), model).count() == 0


def test_decoding_equals_a_loop_over_codewords(spark):
    texts = corpus(3)
    names, rng = ["a", "b", "c", "d", "e"], np.random.default_rng(4)
    code = language.codewords(5)
    bits = code.shape[1]
    model = {"names": names, "code": code, "w": rng.normal(0, 2, (language.BUCKETS, bits)), "b": rng.normal(size=bits), "trust": rng.uniform(0.1, 1, bits)}
    got = {r.doc_id: r for r in language.identify(frame(spark, texts), model).collect()}
    for k, t in enumerate(texts):
        r = got[BIG + k]
        if not t or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        f = language.ngrams(t) @ model["w"] + model["b"]
        loss = [sum(model["trust"][j] * np.log1p(np.exp(-code[i, j] * f[j])) for j in range(bits)) / model["trust"].sum() * bits for i in range(5)]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        assert r.lang_pred == names[int(np.argmin(loss))] and np.isclose(r.score, p.max())
        assert r.ambiguous == bool(np.sort(p)[-1] - np.sort(p)[-2] < language.MARGIN)


def test_training_takes_the_same_text_of_a_repeated_id(spark):
    rows = [(k % 40, f"text {k} " + "ab cd " * (k % 7), "xy"[k % 2], None, None) for k in range(160)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    one, two = (spark.createDataFrame(r, DOCS).repartition(3) for r in (rows, rows[::-1]))
    assert (quality_model.train(one, labels) == quality_model.train(two, labels)).all()
    a, b = language.train(one), language.train(two)
    assert a["names"] == b["names"] and (a["w"] == b["w"]).all()


def verdict_brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    chars = sum(map(len, words))
    grams = lambda n: [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]

    def inside(n):
        count = Counter(grams(n))
        return {k for i, g in enumerate(grams(n)) if count[g] > 1 for k in range(i, i + n)}

    bad = len(words) < 50 or 100 * len(inside(3)) > 50 * len(words)
    for n, most in rules.TOP_SHARE.items():
        top = Counter(grams(n)).most_common()
        ties = [g for g, c in top if c == top[0][1] and c > 1]
        if ties and all(top[0][1] * sum(map(len, g)) / chars > most for g in ties):
            bad = True
        elif any(top[0][1] * sum(map(len, g)) / chars > most for g in ties):
            return None  # the verdict rests on which of equally frequent n-grams is taken
    for n, most in rules.REPEAT_SHARE.items():
        bad |= bool(chars) and sum(len(words[k]) for k in inside(n)) / chars > most
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    bad |= bool(lines) and len(again) > rules.LINE_SHARE * len(lines)
    bad |= bool(lines) and sum(map(len, again)) > rules.LINE_CHARS * sum(map(len, lines))
    bad |= bool(words) and len(re.findall(r"[#*$%&|<>]", t)) > rules.SYMBOL_WORD_SHARE * len(words)
    return not bad


def test_verdicts_equal_brute_force(spark):
    texts = corpus(5)
    got = {r.doc_id: r.kept for r in rules.quality_rules(frame(spark, texts)).collect()}
    want = {BIG + k: verdict_brute(t) for k, t in enumerate(texts)}
    assert all(got[k] == v for k, v in want.items() if v is not None)
    assert {True, False} <= set(want.values())


def test_vendor_and_live_spans_equal_brute_force(spark):
    rng = random.Random(7)
    key = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwz0123456789") for _ in range(n))
    shared = key(30)
    texts = [f"doc {k} token={shared} tail" for k in range(6)]  # six sources hold it
    texts += [f"é ghp_{key(24)} and api_key: '{key(20)}' end {k}" for k in range(8)]
    texts += ["secret=aaaaaaaaaaaaaaaaaaaa", "password=your_example_key_1234567", "xoxb-1234567890ab", None, ""]
    df = spark.createDataFrame([(k, t, "en", f"s{k}", None) for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assign = re.compile(secrets.ASSIGN, re.A)
    owners = Counter(m[2] for t in texts if t for m in assign.finditer(t))
    for k, t in enumerate(texts):
        want = [(m.start(), "vendor", m.end()) for m in re.finditer(secrets.VENDOR, t or "")]
        values = [(m[0], m.start(), m.end()) for m in re.finditer(secrets.VENDOR, t or "")]
        values += [(m[2], m.start(2), m.end(2)) for m in assign.finditer(t or "") if len(m[2]) >= 6]
        for v, a, b in values:
            fits = len(v) >= 16 and len(set(v)) >= 8 and not re.search(secrets.PLACEHOLDER, v)
            if fits and owners[v] <= secrets.MAX_OWNERS:
                want.append((a, "live", b))
        spans = [s.split(":") for s in got[k].spans.split(",") if s]
        assert sorted((int(a), n, int(b)) for n, a, b in spans if n in ("vendor", "live")) == sorted(set(want)), t
