"""Quality rules on repetition: characters inside repeated n-grams and lines.

Words become 64-bit values once; rolling combinations of neighbouring values
give the n-grams of every length, and a sort finds those that come twice.

Scale: one pass without a shuffle; a text is the unit of work.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

MIN_WORDS = 50
# Largest share of word characters that the most frequent n-gram may cover.
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
# Largest share of word characters inside n-grams that come twice or more.
REPEAT_SHARE = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
# Largest shares of lines, and of their characters, that repeat an earlier line.
LINE_SHARE, LINE_CHARS = 0.50, 0.50
SYMBOL_WORD_SHARE = 0.30
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD2
    return h ^ (h >> np.uint64(29))


def word_values(words: list[str]) -> np.ndarray:
    """A value per word, the same for the same word of this text."""
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    return mix((ids + np.uint64(1)) * _ODD)


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """A value per window of n words, from the window shorter by one."""
    h = values
    for k in range(1, n):
        h = mix(h[:-1] * _ODD + values[k:])
    return h


def repeated(h: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Which windows come twice or more; the top window's count and place."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    start = np.nonzero(new)[0]
    count = np.diff(np.append(start, len(s)))
    mask = np.zeros(len(s), bool)
    mask[order] = np.repeat(count > 1, count)
    top = int(count.argmax())
    return mask, int(count[top]), int(order[start[top]])


def covered(mask: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside at least one marked window."""
    edge = np.zeros(size + 1, np.int64)
    edge[: len(mask)] += mask
    edge[n : n + len(mask)] -= mask
    return np.cumsum(edge[:size]) > 0


def measure(text: str | None) -> dict:
    """Base counts, repetition shares and the verdict of one whole text."""
    text = text or ""
    words = _WORD.findall(text)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    chars = int(lens.sum())
    seen: set[str] = set()
    n_lines = n_dup_lines = line_chars = dup_chars = 0
    for line in text.split("\n"):
        if not _WORD.search(line):
            continue
        n_lines += 1
        line_chars += len(line)
        if line in seen:
            n_dup_lines += 1
            dup_chars += len(line)
        else:
            seen.add(line)
    values = word_values(words)
    n_repeat = 0
    top_share, repeat_share = 0.0, 0.0
    reasons = []
    h = values
    for n in range(2, 11):
        if len(words) < n:
            break
        h = mix(h[:-1] * _ODD + values[n - 1 :])
        mask, count, at = repeated(h)
        if n == 3:
            n_repeat = int(covered(mask, 3, len(words)).sum())
        if n in TOP_SHARE:
            share = count * int(lens[at : at + n].sum()) / chars if count > 1 else 0.0
            top_share = max(top_share, share)
            if share > TOP_SHARE[n]:
                reasons.append(f"top_{n}gram")
        if n in REPEAT_SHARE:
            if not mask.any():  # longer windows cannot repeat either
                break
            share = int(lens[covered(mask, n, len(words))].sum()) / chars
            repeat_share = max(repeat_share, share)
            if share > REPEAT_SHARE[n]:
                reasons.append(f"repeat_{n}gram")
    if n_lines and n_dup_lines > LINE_SHARE * n_lines:
        reasons.append("dup_lines")
    if line_chars and dup_chars > LINE_CHARS * line_chars:
        reasons.append("dup_line_chars")
    n_symbols = len(_SYMBOLS.findall(text))
    if words and n_symbols > SYMBOL_WORD_SHARE * len(words):
        reasons.append("symbols")
    failed = len(words) < MIN_WORDS or 100 * n_repeat > 50 * len(words)
    return {
        "n_words": len(words),
        "word_chars": chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": not failed and not reasons,
        "top_ngram_share": float(top_share),
        "repeat_char_share": float(repeat_share),
        "reasons": ",".join(reasons),
    }


COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, top_ngram_share double, repeat_char_share double, reasons string"
)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)`` with the rules' counts and
    verdict. Null and blank texts have no words and fail the base rules;
    repeated rows are judged alike; other columns are not looked at; an empty
    table gives an empty result."""

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(named, lambda pdf: pd.DataFrame([measure(t) for t in pdf["text"]]), COLUMNS)


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the rules reject go, null, empty and blank texts
    among them; the rest, repeated rows and columns of any name included, are
    unchanged. An empty table gives an empty result."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([measure(t.as_py())["kept"] for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op6_repetition_rules": op6_repetition_rules}
ORACLES: dict[str, str] = {}
