"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; one binary linear classifier over
hashed character n-grams predicts each bit. Decoding takes the codeword with
the least logistic loss against all bits, each bit weighted by how reliable it
was in training; a small gap to the second codeword is flagged as ambiguous.

Scale: fitted in one task on at most SAMPLE rows, picked by a hash of the id;
the model has a fixed size and is broadcast; prediction is one pass.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

SAMPLE = 4000
BUCKETS = 4096
ORDERS = (1, 2, 3)
EXTRA_BITS = 15
EPOCHS, RATE, DECAY = 60, 0.5, 1e-4
MARGIN = 0.10
UNKNOWN = "und"
_NOT_LETTER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    m = _LETTER.search(text)
    return bool(m) and (m[0].isalpha() or any(c.isalpha() for c in text))


def ngrams(text: str) -> np.ndarray:
    """Root counts of hashed byte n-grams of the letters, with unit length."""
    raw = (" " + _NOT_LETTER.sub(" ", text.lower()) + " ").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS)
    code = np.zeros(len(b), np.uint32)
    for n in ORDERS:
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
        h = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20)
        out += np.bincount(h, minlength=BUCKETS)[:BUCKETS]
    out = np.sqrt(out)
    return out / (np.sqrt((out**2).sum()) or 1.0)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: all ways to split up to seven languages, else
    random balanced splits, of which the best separated set is taken."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        split = np.arange(1, 2 ** (n - 1))
        bits = (split[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.concatenate([np.ones((1, len(split))), 1.0 - 2.0 * bits])
    rng, width = np.random.default_rng(5), EXTRA_BITS * int(np.ceil(np.log2(n)))
    best, gap = None, -1
    for _ in range(50):
        code = np.stack([rng.permutation(np.where(np.arange(n) % 2, 1.0, -1.0)) for _ in range(width)], axis=1)
        far = (width - (code @ code.T - 2 * width * np.eye(n)).max()) / 2
        if far > gap:
            best, gap = code, far
    return best


def fit(x: np.ndarray, lang: np.ndarray) -> dict:
    """Codewords, weights, biases and reliabilities for the languages seen."""
    names = sorted(set(lang.tolist()))
    code = codewords(len(names))
    if not names:
        return {"names": [], "code": code, "w": np.zeros((BUCKETS, 1)), "b": np.zeros(1), "trust": np.ones(1)}
    y = code[np.searchsorted(names, lang)]
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    seen_w, seen_b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    # Rare languages weigh as much as common ones.
    share = np.bincount(np.searchsorted(names, lang), minlength=len(names))
    weight = (len(lang) / len(names) / share)[np.searchsorted(names, lang)][:, None] / len(lang)
    for _ in range(EPOCHS):
        g = -y * weight / (1 + np.exp(np.clip(y * (x @ w.astype(x.dtype) + b), -30, 30)))
        gw, gb = x.T @ g.astype(x.dtype) + DECAY * w, g.sum(axis=0)
        seen_w += gw**2
        seen_b += gb**2
        w -= RATE * gw / np.sqrt(seen_w)
        b -= RATE * gb / np.sqrt(seen_b)
    right = ((x @ w + b > 0) == (y > 0)).mean(axis=0)
    return {"names": names, "code": code, "w": w, "b": b, "trust": np.clip(2 * right - 1, 0.05, 1.0)}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language number, its probability, and whether it is ambiguous."""
    f = x @ model["w"] + model["b"]
    loss = np.log1p(np.exp(-np.clip(f[:, None, :] * model["code"][None], -30, 30))) @ model["trust"]
    loss /= model["trust"].sum() / model["code"].shape[1]
    p = np.exp(loss.min(axis=1, keepdims=True) - loss)
    p /= p.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    top = np.sort(p, axis=1)
    gap = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0.0)
    return best, p[np.arange(len(x)), best], gap < MARGIN


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` rows that have a text with a letter and a
    language and are not held out. Without any, nothing is learned."""
    ids = (
        docs.where("lang is not null and doc_id is not null")
        .where(~_held_out())
        .select(F.col("doc_id").cast("long").alias("doc_id"))
        .distinct()
        .orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id")
        .limit(sample)
    )
    # At most ``sample`` ids, so the side is broadcast.
    chosen = docs.where("lang is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang")

    def extract(batches):
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["text"]]]
            x = [ngrams(t).astype(np.float32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "x": x})

    rows = chosen.mapInPandas(extract, "doc_id long, lang string, x binary")
    # Of different texts under one id always the same one is learned.
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "x")).alias("one")).select("doc_id", "one.*")

    def run(batches):
        pdf = pd.concat([*batches, pd.DataFrame({"doc_id": [], "lang": [], "x": []})])
        pdf = pdf.drop_duplicates().sort_values(["doc_id", "lang", "x"]).head(sample)
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(-1, BUCKETS)
        m = fit(x, np.array(pdf["lang"].tolist(), dtype=object))
        yield pd.DataFrame(
            {
                "names": [m["names"]],
                "code": [m["code"].astype("<f8").tobytes()],
                "w": [m["w"].astype("<f8").tobytes()],
                "b": [m["b"].astype("<f8").tobytes()],
                "trust": [m["trust"].astype("<f8").tobytes()],
            }
        )

    out = "names array<string>, code binary, w binary, b binary, trust binary"
    r = rows.repartition(1).mapInPandas(run, out).first()
    names, b = list(r["names"]), np.frombuffer(bytes(r["b"]), "<f8")
    return {
        "names": names,
        "code": np.frombuffer(bytes(r["code"]), "<f8").reshape(len(names), -1) if names else np.zeros((0, 1)),
        "w": np.frombuffer(bytes(r["w"]), "<f8").reshape(BUCKETS, -1),
        "b": b,
        "trust": np.frombuffer(bytes(r["trust"]), "<f8"),
    }


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)`` of every row.

    ``und`` with score 0 for texts that are null or have no letter, and for
    all texts if no language was learned. Repeated rows are read each, other
    columns are not looked at, and an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(pdf):
        m = shared.value
        lang = np.full(len(pdf), UNKNOWN, dtype=object)
        score, unsure = np.zeros(len(pdf)), np.ones(len(pdf), bool)
        known = [k for k, t in enumerate(pdf["text"]) if m["names"] and has_letter(t)]
        for at in range(0, len(known), 512):
            part = known[at : at + 512]
            x = np.stack([ngrams(pdf["text"].iloc[k]) for k in part])
            best, p, close = decode(m, x)
            lang[part] = np.array(m["names"], dtype=object)[best]
            score[part], unsure[part] = p, close
        return pd.DataFrame({"held_out": pdf["held_out"], "lang_pred": lang, "score": score, "ambiguous": unsure})

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text")
    return map_texts(named, run, "held_out boolean, lang_pred string, score double, ambiguous boolean")


def op10_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op10_output_codes": op10_output_codes}
ORACLES: dict[str, str] = {}
