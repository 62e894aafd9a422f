"""Quality classifier: a factorisation machine over hashed words and structure.

A text's features are its hashed words and a one-hot bin of each structure
statistic and of its recorded length. The score is linear plus all pairwise
products of low-rank factors, in linear time by
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``.

Scale: fitted in one task on at most SAMPLE labelled rows, picked by a hash of
the id; the model is a fixed-size array that is broadcast; scoring is one pass
without a shuffle.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

SAMPLE = 16_000
WORD_BITS = 14
BINS = 16
RANK = 4
EPOCHS, MIN_STEPS, BATCH, RATE, DECAY = 8, 800, 64, 0.05, 1e-5
CUT = 0.3
SLICE = 500  # texts scored together

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_MARKS = re.compile(r"[!?.,;:]")
STATS = 12
SIZE = (1 << WORD_BITS) + STATS * BINS


def structure(text: str, words: list[str], n_chars) -> np.ndarray:
    """Structure statistics and metadata, each in [0, 1]."""
    n, size = max(1, len(words)), max(1, len(text))
    lower = text.lower()
    letters = sum(map(len, words)) or 1
    pairs = list(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(a == b for a, b in pairs)
    recorded = size if n_chars is None or n_chars != n_chars else max(1, n_chars)
    return np.array(
        [
            min(1.0, len(_SYMBOLS.findall(text)) / n),
            sum(a != b for a, b in zip(text, lower)) / size if len(lower) == len(text) else 0.5,
            len(set(words)) / n,
            1.0 - len(set(pairs)) / max(1, len(pairs)),
            same / n,
            min(1.0, text.count("!") / n),
            min(1.0, text.count("|") / n),
            min(1.0, len(_MARKS.findall(text)) / n),
            min(1.0, letters / n / 20),
            1.0 - len(set(lines)) / max(1, len(lines)),
            min(1.0, np.log1p(n) / 12),
            min(1.0, np.log1p(recorded) / 14),
        ]
    )


def features(text: str | None, n_chars=None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features (indices, values): words by root frequency with unit
    length in all, then one bin per statistic. The same for null and empty."""
    text = text or ""
    words = text.split()
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    at = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w in count), np.int64, len(count))
    val = np.sqrt(np.fromiter(count.values(), np.float64, len(count)))
    dense = np.bincount(at & ((1 << WORD_BITS) - 1), val) if len(at) else np.zeros(1)
    idx = np.nonzero(dense)[0]
    val = dense[idx] / (np.sqrt((dense[idx] ** 2).sum()) or 1.0)
    bins = np.minimum(BINS - 1, np.ceil(structure(text, words, n_chars) ** 0.5 * (BINS - 1))).astype(np.int64)
    own = (1 << WORD_BITS) + np.arange(STATS) * BINS + bins
    return np.concatenate([idx, own]).astype(np.int32), np.concatenate([val, np.ones(STATS)]).astype(np.float32)


def margin(model: np.ndarray, idx: np.ndarray, val: np.ndarray, row: np.ndarray, n: int) -> tuple:
    """Scores of n rows stored one after another, and the factor sums."""
    bias, w, v = model[0, 0], model[1:, 0], model[1:, 1:]
    vx = v[idx] * val[:, None]
    total = np.stack([np.bincount(row, vx[:, f], n) for f in range(v.shape[1])], axis=1)
    square = np.bincount(row, (vx**2).sum(axis=1), n)
    linear = np.bincount(row, w[idx] * val, n)
    return bias + linear + 0.5 * ((total**2).sum(axis=1) - square), total, vx


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Adagrad on the logistic loss, in a fixed order; (1 + SIZE, 1 + RANK)."""
    rng = np.random.default_rng(11)
    model = np.zeros((1 + SIZE, 1 + RANK))
    model[1:, 1:] = rng.normal(0, 0.02, (SIZE, RANK))
    y_all = np.array([y for *_, y in rows])
    if not len(rows) or y_all.min() == y_all.max():
        model[1:, 1:] = 0
        model[0, 0] = 0.0 if not len(rows) else (4.0 if y_all.max() else -4.0)
        return model
    seen = np.full_like(model, 1e-6)
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = [rows[k] for k in order[at : at + BATCH]]
            idx = np.concatenate([p[0] for p in pick])
            val = np.concatenate([p[1] for p in pick]).astype(np.float64)
            row = np.repeat(np.arange(len(pick)), [len(p[0]) for p in pick])
            z, total, vx = margin(model, idx, val, row, len(pick))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([p[2] for p in pick])) / len(pick)
            grad_v = g[row][:, None] * (val[:, None] * total[row] - val[:, None] * vx)
            grad = np.concatenate([(g[row] * val)[:, None], grad_v], axis=1)
            used, inv = np.unique(idx, return_inverse=True)
            step = np.stack([np.bincount(inv, grad[:, c], len(used)) for c in range(1 + RANK)], axis=1)
            step += DECAY * model[1 + used]
            seen[1 + used] += step**2
            model[1 + used] -= RATE * step / np.sqrt(seen[1 + used])
            seen[0, 0] += g.sum() ** 2
            model[0, 0] -= RATE * g.sum() / np.sqrt(seen[0, 0])
    return model


def _held_out(modulus: int, remainder: int):
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.pmod(key, F.lit(modulus)) == remainder


def with_length(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", chars.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Fit on at most ``sample`` rows of ``labels(doc_id, quality)`` that are
    not held out. Labels other than 0 and 1 and null ids are left out; an id
    with both labels is left out too. Without rows the score is 0.5."""
    known = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("y"), F.max("quality").alias("top"))
        .where("y = top")
        .where(~_held_out(5, 0))
    )
    picked = known.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(sample).select("doc_id", "y")
    # At most ``sample`` ids, so the side is broadcast.
    chosen = with_length(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "n_chars", "y")

    def extract(batches):
        for pdf in batches:
            got = [features(t, c) for t, c in zip(pdf["text"], pdf["n_chars"])]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "y": pdf["y"],
                    "idx": [i.tobytes() for i, _ in got],
                    "val": [v.tobytes() for _, v in got],
                }
            )

    rows = chosen.mapInPandas(extract, "doc_id long, y int, idx binary, val binary")
    # Of different texts under one id always the same one is learned.
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct("idx", "val")).alias("x")).select("doc_id", "y", "x.*")

    def run(batches):
        pdf = pd.concat([*batches, pd.DataFrame({"doc_id": [], "y": [], "idx": [], "val": []})])
        pdf = pdf.drop_duplicates().sort_values(["doc_id", "idx"])
        data = [
            (np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), int(y))
            for i, v, y in zip(pdf["idx"], pdf["val"], pdf["y"])
        ]
        yield pd.DataFrame({"model": [fit(data).astype(np.float32).tobytes()]})

    raw = rows.repartition(1).mapInPandas(run, "model binary").first()[0]
    return np.frombuffer(bytes(raw), np.float32).reshape(1 + SIZE, 1 + RANK).astype(np.float64)


def classify(docs: DataFrame, model: np.ndarray, cut: float = CUT) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row. Null and empty
    texts are scored like any other; a table without ``n_chars`` is scored by
    the texts' own lengths. Repeated rows are scored each, other columns are not
    looked at, and an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def run(pdf):
        weights, score = shared.value.astype(np.float64), [np.zeros(0)]
        for at in range(0, len(pdf), SLICE):
            part = pdf.iloc[at : at + SLICE]
            got = [features(t, c) for t, c in zip(part["text"], part["n_chars"])]
            row = np.repeat(np.arange(len(got)), [len(i) for i, _ in got])
            idx, val = (np.concatenate(x) for x in zip(*got))
            z = margin(weights, idx, val.astype(np.float64), row, len(got))[0]
            score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        score = np.concatenate(score)
        return pd.DataFrame({"held_out": pdf["held_out"], "score": score, "predicted": (score >= cut).astype(np.int32)})

    named = with_length(docs).withColumn("held_out", _held_out(5, 0))
    return map_texts(named, run, "held_out boolean, score double, predicted int")


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_factorisation_machine": op8_factorisation_machine}
ORACLES: dict[str, str] = {}
