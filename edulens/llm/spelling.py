"""Spelling variants: words one edit apart, found through broadcast Bloom filters.

The vocabulary is sharded by word length and each shard gets a blocked Bloom
filter. Every word generates its deletions, which are probed in the filter one
length down, and its replacements by larger characters, probed in its own; an
insertion is the other word's deletion and a smaller replacement the other
word's larger one, so each pair is generated from one side only. The hash of an
edit follows from the word's prefix sums, so edits are strings only where a
filter says yes. These positives alone are shuffled, to a join with the
vocabulary that removes the false ones.

Scale: occurrences are counted map-side and only words of two or more are kept.
A round broadcasts filters over at most ``FILTER_WORDS`` words (2 bytes each);
a larger vocabulary takes more rounds, a length with more words than that is
cut by hash. A word has at most 90 neighbours per place, so no key is hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, shuffle_width, table

MIN_CHARS = 7
MIN_COUNT = 2
FORM_TIMES = 10
TYPO_EVERY = 31
#: A run shorter than MIN_CHARS gives no word, so only longer ones are matched.
RUN = rf"[A-Za-zÀ-ÿ]{{{MIN_CHARS},}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FILTER_WORDS = 4_000_000
BITS_PER_WORD = 16
BLOCK_SLOTS = 8  # 64-bit words of a block
PROBES = 7  # 9 bits each of one 64-bit hash
CELLS = 1_000_000  # edits held at once

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = np.uint64(pow(BASE, -1, 2**64))
#: A fixed 64-bit value per code point up to U+00FF.
SYMBOL = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(BASE)
    return np.cumprod(out, dtype=np.uint64)


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def word_hashes(points: np.ndarray) -> np.ndarray:
    return (SYMBOL[points] * powers(points.shape[1])).sum(axis=1, dtype=np.uint64)


@dataclass(frozen=True)
class Shard:
    """The words of one length, or one hash part of them."""

    length: int
    part: int
    parts: int
    blocks: int
    alphabet: tuple[int, ...]  # code points that words of the length hold


def places(h: np.ndarray, blocks: int):
    """Yield (slot, mask) of each of the PROBES bits of the hashes."""
    x = mix(h)
    first = ((x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64) * BLOCK_SLOTS
    y = mix(x + np.uint64(BASE))
    for k in range(PROBES):
        bit = (y >> np.uint64(9 * k)) & np.uint64(511)
        yield first + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63))


def in_filter(slots: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter holds; each bit is looked up only for
    those that passed the ones before."""
    left = np.arange(len(h))
    x = mix(h)
    first = ((x >> np.uint64(32)) * np.uint64(len(slots) // BLOCK_SLOTS) >> np.uint64(32)).astype(np.int64) * BLOCK_SLOTS
    y = mix(x + np.uint64(BASE))
    for _ in range(PROBES):
        bit = y & np.uint64(511)
        hit = slots[first + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)
        keep = np.nonzero(hit)[0]
        left, first, y = left[keep], first[keep], y[keep] >> np.uint64(9)
    return left


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the words of at least MIN_CHARS characters and MIN_COUNT
    occurrences. Runs of letters are lower-cased in A-Z; of a run whose checksum
    with its document's id divides by TYPO_EVERY one character is deleted. A null
    id counts as the empty text."""
    own = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(own.alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), 0)).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % TYPO_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= MIN_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def rounds(vocab: DataFrame, at_once: int) -> list[list[Shard]]:
    """Shards of the vocabulary, in rounds of about ``at_once`` words."""
    chars = F.collect_set(F.ascii("c")).alias("alphabet")
    sized = vocab.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    letters = vocab.select(F.length("word").alias("length"), F.explode(F.array_distinct(F.split("word", ""))).alias("c"))
    letters = letters.where("c <> ''").groupBy("length").agg(chars)
    out, room = [], 0
    for r in sorted(sized.join(letters, "length").collect()):
        parts = math.ceil(r.n / at_once)
        each = math.ceil(r.n / parts)
        blocks = max(1, math.ceil(each * BITS_PER_WORD / (64 * BLOCK_SLOTS)))
        for part in range(parts):
            if each > room:
                out.append([])
                room = at_once
            out[-1].append(Shard(r.length, part, parts, blocks, tuple(sorted(r.alphabet))))
            room -= each
    return out


def part_of(parts: int):
    return F.pmod(F.xxhash64("word"), F.lit(parts))


def filters(vocab: DataFrame, shards: list[Shard]) -> list[np.ndarray]:
    """The Bloom filter of every shard."""
    mine = [(F.length("word") == s.length) & (part_of(s.parts) == s.part) for s in shards]
    number = F.coalesce(*[F.when(m, F.lit(k)) for k, m in enumerate(mine)])
    rows = vocab.select(number.alias("shard"), "word").where("shard is not null")

    def bits(batches):
        for b in batches:
            pdf = b.to_pandas()
            for k, words in pdf.groupby("shard")["word"]:
                for slot, mask in places(word_hashes(codes(words.tolist())), shards[k].blocks):
                    columns = [pa.array(np.full(len(slot), k, np.int32)), pa.array(slot), pa.array(mask.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["shard", "slot", "mask"])

    found = rows.mapInArrow(bits, "shard int, slot long, mask long")
    found = found.groupBy("shard", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    shard, slot, mask = (found.column(c).to_numpy() for c in ("shard", "slot", "mask"))
    out = []
    for k, s in enumerate(shards):
        slots = np.zeros(s.blocks * BLOCK_SLOTS, np.uint64)
        slots[slot[shard == k]] = mask[shard == k].view(np.uint64)
        out.append(slots)
    return out


def probes(points: np.ndarray, shards: list[tuple[Shard, np.ndarray]]):
    """Yield ``(row, place, code)`` arrays of the edits of words of one length that
    a filter holds; a code of -1 is a deletion. Of a run of equal characters
    only the last is deleted, so no edit comes twice from one word."""
    n, length = points.shape
    power = powers(length)
    terms = SYMBOL[points] * power
    upto = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    whole = upto[:, -1]
    for shard, slots in shards:
        if shard.length == length - 1:
            last = np.ones((n, length), bool)
            last[:, :-1] = points[:, :-1] != points[:, 1:]
            row, at = np.nonzero(last)
            h = upto[row, at] + (whole[row] - upto[row, at + 1]) * BASE_INVERSE
            hit = in_filter(slots, h)
            yield row[hit], at[hit], np.full(len(hit), -1)
        elif shard.length == length:
            rest = whole[:, None] - terms
            for c in shard.alphabet:
                row, at = np.nonzero(points < c)
                hit = in_filter(slots, rest[row, at] + SYMBOL[c] * power[at])
                yield row[hit], at[hit], np.full(len(hit), c)


def candidates(vocab: DataFrame, shards: list[Shard]) -> DataFrame:
    """``(word, n, near)``: edits of vocabulary words that a filter of ``shards`` holds."""
    held = vocab.sparkSession.sparkContext.broadcast(list(zip(shards, filters(vocab, shards))))
    lengths = {s.length for s in shards}
    asked = vocab.where(F.length("word").isin(*lengths, *(n + 1 for n in lengths)))

    def run(batches):
        for b in batches:
            pdf = b.to_pandas()
            size = pdf["word"].str.len()
            for length, group in pdf.groupby(size):
                step = max(1, CELLS // length)
                for a in range(0, len(group), step):
                    words, n = group["word"].iloc[a : a + step].tolist(), group["n"].to_numpy()[a : a + step]
                    for row, at, code in probes(codes(words), held.value):
                        edits = (
                            words[r][:p] + (chr(c) if c >= 0 else "") + words[r][p + 1 :]
                            for r, p, c in zip(row.tolist(), at.tolist(), code.tolist())
                        )
                        columns = [pa.array([words[r] for r in row.tolist()], pa.string()), pa.array(n[row])]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(edits, pa.string())], ["word", "n", "near"])

    return asked.mapInArrow(run, "word string, n long, near string")


def near_words(vocab: DataFrame, at_once: int = FILTER_WORDS) -> DataFrame:
    """``(word, n, near, near_n)`` for every ordered pair of words of ``vocab(word,
    n)`` that differ by one inserted, deleted or replaced code point. Words hold
    a-z and U+00C0 to U+00FF only and are distinct. An empty vocabulary gives an
    empty result."""
    other = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = vocab.sparkSession.createDataFrame([], "word string, n long, near string, near_n long")
    for shards in rounds(vocab, at_once):
        found = candidates(vocab, shards).join(other, "near").select("word", "n", "near", "near_n")
        pairs = pairs.unionByName(shared_checkpoint(found))
    swapped = pairs.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
    )
    return pairs.unionByName(swapped)


def follow(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words that have a form: the end of the chain of forms.
    Pointers are doubled until none moves; a form has ten times the occurrences,
    so chains are short and have no cycles."""
    own = shared_checkpoint(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = own.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = own.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next")
        moved = shared_checkpoint(moved)
        own = moved.select("word", "root")
        if moved.where("next is not null").isEmpty():
            return own


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_once: int = FILTER_WORDS
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``docs``.

    The form is the near word with most occurrences (ties: smallest in code-point
    order) if it has at least FORM_TIMES those of the word, else null; the root is
    the last of the chain of forms. Null and empty texts have no words, repeated
    rows count again, other columns are not looked at, an empty table gives an
    empty result.
    """
    counted = word_counts(docs, id_col, text_col)
    vocab = shared_checkpoint(counted.repartition(shuffle_width(docs.sparkSession), "word"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(vocab, at_once).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    most = -F.col("best.less")
    enough = most >= F.col("n") * FORM_TIMES
    forms = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"), F.when(enough, most).alias("form_n"),
    )
    forms = shared_checkpoint(forms)
    return forms.join(follow(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES: dict[str, str] = {}
