"""Removal of long repeated substrings by a distributed difference cover.

Every pair of places has a shift below the period V at which both fall on the
cover, so two equal strings of ``min_len`` bytes share a sampled place whose
next ``min_len - V + 1`` bytes are equal. The rounds follow the difference-cover
suffix sort, cut off at the length that matters:

1. Sampled places are named by triples, and triples of triples recursively, up
   to that prefix, and the names sorted; neighbours with equal names repeat.
2. Repeated samples are named over ``min_len + V - 1`` bytes. If that repeats,
   so does every place between this sample and the next one it stands for.
3. A repeated sample is open while some place that it may stand for is not yet
   known to repeat. Its equals elsewhere are told, even if they are not open.
4. The places near these samples, the unsampled remainder, are merged in by
   names of exactly ``min_len`` bytes, and neighbours compared again.

A name is a hash of the names below it, so it needs no round of its own. Names
of rounds 1 and 3 only select (40 bits and their bucket); those of rounds 2 and
4 decide and have 96 bits.

Scale: texts are shuffled once, after copies collapse to one per input
partition; later rounds move only names and one bit back for each. A block of
texts and a bucket of names are bounded whatever the input, and a name is sent
once a block, so common passages do not pile up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import replace_text, shared_checkpoint, shuffle_width, table

MIN_LEN = 200
BLOCK_BYTES = 2_000_000
CHUNK_BYTES = 500_000
PACK_BYTES = 16_000_000
BUCKET_BYTES = 16_000_000
DECIDE = 12  # bytes of a name that decides; one that selects has 5
# Perfect difference sets, modulus -> residues.
COVERS = {
    7: [0, 1, 3],
    13: [0, 1, 3, 9],
    31: [1, 5, 11, 24, 25, 27],
    57: [0, 1, 3, 13, 32, 36, 43, 52],
    133: [1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121],
}
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_SEEDS = np.array([0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def cover_for(min_len: int) -> tuple[int, np.ndarray]:
    """The largest period that leaves a third of ``min_len`` to be named."""
    period = max((v for v in COVERS if 3 * v <= 2 * min_len), default=None)
    if period is None:
        raise ValueError("min_len is too small for a difference cover")
    return period, np.array(sorted(COVERS[period]))


def triple(a: np.ndarray, b: np.ndarray, c: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = a * _K[0]
    h += b * _K[1]
    h ^= h >> np.uint64(29)
    h += c * _K[2]
    h += seed
    h ^= h >> np.uint64(32)
    h *= _K[3]
    h ^= h >> np.uint64(29)
    return h


class Names:
    """Names of substrings of a buffer, from triples of bytes upwards."""

    def __init__(self, buf: np.ndarray, seed: np.uint64):
        self.seed = seed
        x = buf.astype(np.uint64)
        self.level = {1: x}
        for n in (1, 3, 9):
            h = self.level[n]
            if len(h) <= 2 * n:
                break
            self.level[3 * n] = triple(h[: -2 * n], h[n:-n], h[2 * n :], seed)
            if n > 1:
                del self.level[n]

    def at(self, pos: np.ndarray, length: int) -> np.ndarray:
        """The name of ``length`` bytes from each place."""
        if length in self.level:
            return self.level[length][pos]
        part = 3 ** int(np.log(length + 0.5) / np.log(3))
        if part == length:
            part //= 3
        mid = (length - part) // 2
        return triple(
            self.at(pos, part), self.at(pos + mid, part), self.at(pos + length - part, part), self.seed
        )


class Block:
    """The distinct texts of one block, in a fixed order, and their rounds."""

    def __init__(self, pdf: pd.DataFrame, min_len: int):
        self.n: dict[str, int] = {}
        texts: dict[str, bytes] = {}
        unpack = zstandard.ZstdDecompressor()
        for digests, counts, sizes, data in zip(pdf["digest"], pdf["n"], pdf["size"], pdf["data"]):
            whole, at = unpack.decompress(data) if len(data) else b"", 0
            for d, k, size in zip(digests, counts, sizes):
                self.n[d] = self.n.get(d, 0) + int(k)
                if size >= 0:
                    texts[d] = whole[at : at + size]
                    at += size
        self.digest = sorted(texts)
        self.text = [texts[d] for d in self.digest]
        self.min_len = min_len
        self.period, self.cover = cover_for(min_len)
        longest = max(map(len, self.text), default=0)
        turns = np.arange(0, longest + self.period, self.period)
        self.places = (turns[:, None] + self.cover[None]).ravel()

    def samples(self, size: int) -> np.ndarray:
        if size < self.min_len:
            return self.places[:0]
        return self.places[: np.searchsorted(self.places, size - (self.min_len - self.period + 1), "right")]

    def chunks(self, wanted=None):
        """(document numbers, their first bytes, buffer) of long enough texts."""
        docs, starts, size = [], [], 0
        for k, t in enumerate(self.text):
            if len(t) < self.min_len or (wanted is not None and not wanted[k]):
                continue
            if docs and size + len(t) > CHUNK_BYTES:
                yield docs, starts, np.frombuffer(b"".join(self.text[d] for d in docs), np.uint8)
                docs, starts, size = [], [], 0
            docs.append(k)
            starts.append(size)
            size += len(t)
        if docs:
            yield docs, starts, np.frombuffer(b"".join(self.text[d] for d in docs), np.uint8)

    def named(self, per_doc: list[np.ndarray], length: int, both: bool) -> list[np.ndarray]:
        """Names (one or two 64-bit halves) at the given places of each text."""
        out = [[] for _ in range(1 + both)]
        for docs, starts, buf in self.chunks([len(p) > 0 for p in per_doc]):
            pos = np.concatenate([per_doc[d] + s for d, s in zip(docs, starts)])
            # A long text goes piece by piece, each with the bytes that its last names reach over.
            for at in range(0, len(buf), CHUNK_BYTES):
                low, high = np.searchsorted(pos, [at, at + CHUNK_BYTES])
                if low < high:
                    part = buf[at : at + CHUNK_BYTES + length]
                    for half, seed in zip(out, _SEEDS):
                        half.append(Names(part, seed).at(pos[low:high] - at, length))
        return [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in out]

    def split(self, flat: np.ndarray, per_doc: list[np.ndarray]) -> list[np.ndarray]:
        return np.split(flat, np.cumsum([len(p) for p in per_doc])[:-1]) if per_doc else []

    def round1(self) -> list[np.ndarray]:
        return [self.samples(len(t)) for t in self.text]

    def round2(self, hit1: list[np.ndarray]) -> list[np.ndarray]:
        """Repeated samples with room for the longer name."""
        reach = self.min_len + self.period - 1
        return [p[h & (p + reach <= len(t))] for p, h, t in zip(self.round1(), hit1, self.text)]

    def near(self, size: int, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Which of ``size`` places lie in one of the ranges [first, after)."""
        edge = np.zeros(size + 1, np.int32)
        np.add.at(edge, first.clip(0, size), 1)
        np.add.at(edge, after.clip(0, size), -1)
        return np.cumsum(edge[:size], dtype=np.int32) > 0

    def known(self, hit1, hit2) -> list[np.ndarray]:
        """Places that repeat because the longer name of a sample does."""
        return [
            self.near(max(0, len(t) - self.min_len + 1), q[h], q[h] + self.period)
            for t, q, h in zip(self.text, self.round2(hit1), hit2)
        ]

    def round3(self, hit1, hit2) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Repeated samples, and which of them stand for a place still open."""
        places, open_ = [], []
        for p, h, sure in zip(self.round1(), hit1, self.known(hit1, hit2)):
            count = np.concatenate([[0], np.cumsum(~sure)])
            q = p[h]
            low, high = (q - self.period + 1).clip(0, len(sure)), (q + 1).clip(0, len(sure))
            places.append(q)
            open_.append(count[high] > count[low])
        return places, open_

    def round4(self, hit1, hit2, hit3) -> list[np.ndarray]:
        """Places that samples with an open equal may stand for."""
        found = []
        for t, p, h1, h3 in zip(self.text, self.round1(), hit1, hit3):
            q = p[h1][h3]
            found.append(np.nonzero(self.near(max(0, len(t) - self.min_len + 1), q - self.period + 1, q + 1))[0])
        return found


def distinct(halves: list[np.ndarray]):
    """Sort order, first-of-its-name mask and number of its name, in order."""
    order = np.lexsort(halves[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([h[order][1:] != h[order][:-1] for h in halves], axis=0)
    return order, new, np.cumsum(new) - 1


def send(block: int, halves: list[np.ndarray], buckets: int, told: np.ndarray | None = None) -> list[tuple]:
    """Rows (bucket, block, kind, data): each distinct name of the block once,
    in round 3 with a byte that says whether any of its places tells it."""
    order, new, number = distinct(halves)
    name = [h[order][new] for h in halves]
    bucket = ((name[0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    own, cut = np.unique(bucket, return_index=True)  # buckets that get any, in order
    cut = [*cut.tolist(), len(bucket)]
    if len(name) == 2:
        raw = np.ascontiguousarray(np.stack(name, axis=1)).view(np.uint8)[:, :DECIDE]
        raw = np.ascontiguousarray(raw)
    else:
        raw = name[0][:, None].view(np.uint8)[:, :5]
        if told is not None:
            any_ = np.bincount(number, weights=told[order], minlength=len(raw)) > 0
            raw = np.concatenate([raw, any_[:, None].astype(np.uint8)], axis=1)
        raw = np.ascontiguousarray(raw)
    return [(int(b), block, 0, raw[x:y].tobytes()) for b, x, y in zip(own, cut, cut[1:])]


def answer(halves: list[np.ndarray], back: pd.DataFrame, told: np.ndarray | None = None) -> np.ndarray:
    """For each name as sent: does it come twice in this block or in another?
    In round 3: is it told, here or in another?"""
    order, new, number = distinct(halves)
    back = back[back["kind"] == 0].sort_values("bucket")
    flags = [
        np.unpackbits(np.frombuffer(d, np.uint8), count=n).astype(bool) for d, n in zip(back["data"], back["size"])
    ]
    elsewhere = np.concatenate(flags) if flags else np.zeros(0, bool)
    if told is None:
        here = np.bincount(number, minlength=len(elsewhere)) > 1
    else:
        here = np.bincount(number, weights=told[order], minlength=len(elsewhere)) > 0
    out = np.zeros(len(order), bool)
    out[order] = (elsewhere | here)[number]
    return out


def meet(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """One bucket of names from all blocks: which ones do two blocks have, or
    in round 3, which does any block tell? Rows of another kind only pass
    through, back to their block."""
    own = pdf[pdf["kind"] == 0]
    other = pdf[pdf["kind"] != 0].assign(size=0)
    out = [other[["block", "bucket", "kind", "data", "size"]]]
    if len(own):
        sizes = [len(d) // width for d in own["data"]]
        raw = np.frombuffer(b"".join(own["data"]), np.uint8).reshape(-1, width)
        told = raw[:, 5] if width == 6 else None
        raw = np.pad(raw[:, :5], ((0, 0), (0, 3))) if width < 8 else np.pad(raw, ((0, 0), (0, 16 - width)))
        halves = np.ascontiguousarray(raw).view("<u8")
        order, new, number = distinct([halves[:, k] for k in range(halves.shape[1])])
        hit = np.zeros(len(order), bool)
        if told is None:
            hit[order] = (np.bincount(number) > 1)[number]
        else:
            hit[order] = (np.bincount(number, weights=told[order]) > 0)[number]
        data = [np.packbits(h).tobytes() for h in np.split(hit, np.cumsum(sizes)[:-1])]
        out.append(own[["block", "bucket", "kind"]].assign(data=data, size=sizes))
    return pd.concat(out, ignore_index=True)


SENT = "bucket int, block int, kind int, data binary"
BACK = "block int, bucket int, kind int, data binary, size int"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "block", "kind", "data"])


def _bits(back: pd.DataFrame, kind: int, per_doc: list[np.ndarray], block: Block) -> list[np.ndarray]:
    n = sum(map(len, per_doc))
    data = back[back["kind"] == kind]["data"].iloc[0]
    return block.split(np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool), per_doc)


def _flat(hits: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(hits) if hits else np.zeros(0, bool)


def _pack(hits: list[np.ndarray]) -> bytes:
    return np.packbits(_flat(hits)).tobytes()


def repeated_spans(docs: DataFrame, min_len: int = MIN_LEN, keep_text: bool = False) -> DataFrame:
    """Per distinct text: ``(digest, n_bytes, n_removed, n_spans, kept_sha256)``
    and, with ``keep_text``, the remaining text ``kept`` without cut characters.

    ``docs`` has ``digest`` (of the text) and ``text`` as binary.
    """
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    width = shuffle_width(spark)
    n_blocks = max(-(-int(total) // BLOCK_BYTES), width)
    n_buckets = max(-(-int(total) // BUCKET_BYTES), -(-width // 2))

    def collapse(batches):
        """Texts of each block packed together, each text once per input
        partition; how often it came again follows at the end (size -1)."""
        more: dict[str, int] = {}
        press = zstandard.ZstdCompressor(level=3)

        def packs(rows):
            by_block: dict[int, list] = {}
            for digest, n, text in rows:
                by_block.setdefault(int(digest[:15], 16) % n_blocks, []).append((digest, n, text))
            return pd.DataFrame(
                [
                    (
                        block,
                        [d for d, *_ in own],
                        [n for _, n, _ in own],
                        [-1 if t is None else len(t) for *_, t in own],
                        press.compress(b"".join(t or b"" for *_, t in own)),
                    )
                    for block, own in by_block.items()
                ],
                columns=["block", "digest", "n", "size", "data"],
            )

        rows, held = [], 0
        for pdf in batches:
            for digest, text in zip(pdf["digest"], pdf["text"]):
                if digest in more:
                    more[digest] += 1
                else:
                    more[digest] = 0
                    rows.append((digest, 1, bytes(text)))
                    held += len(text)
            if held > PACK_BYTES:
                yield packs(rows)
                rows, held = [], 0
        yield packs(rows)
        yield packs((d, n, None) for d, n in more.items() if n)

    texts = docs.select("digest", "text").mapInPandas(
        collapse, "block int, digest array<string>, n array<long>, size array<int>, data binary"
    )
    texts = texts.repartition(width, "block")
    by_block = texts.groupBy("block")

    prefix = min_len - cover_for(min_len)[0] + 1
    longer = min_len + cover_for(min_len)[0] - 1

    def first(pdf):
        b = Block(pdf, min_len)
        return _frame(send(int(pdf["block"].iloc[0]), b.named(b.round1(), prefix, False), n_buckets))

    def second(pdf, back):
        if not len(pdf):
            return _frame([])
        b, block = Block(pdf, min_len), int(pdf["block"].iloc[0])
        per_doc = b.round1()
        hit1 = b.split(answer(b.named(per_doc, prefix, False), back), per_doc)
        names = b.named(b.round2(hit1), longer, True)
        return _frame([*send(block, names, n_buckets), (block % n_buckets, block, 1, _pack(hit1))])

    def third(pdf, back):
        if not len(pdf):
            return _frame([])
        b, block = Block(pdf, min_len), int(pdf["block"].iloc[0])
        hit1 = _bits(back, 1, b.round1(), b)
        per_doc = b.round2(hit1)
        hit2 = b.split(answer(b.named(per_doc, longer, True), back), per_doc)
        places, open_ = b.round3(hit1, hit2)
        rows = send(block, b.named(places, prefix, False), n_buckets, _flat(open_))
        return _frame([*rows, (block % n_buckets, block, 1, _pack(hit1)), (block % n_buckets, block, 2, _pack(hit2))])

    def fourth(pdf, back):
        if not len(pdf):
            return _frame([])
        b, block = Block(pdf, min_len), int(pdf["block"].iloc[0])
        hit1 = _bits(back, 1, b.round1(), b)
        hit2 = _bits(back, 2, b.round2(hit1), b)
        places, open_ = b.round3(hit1, hit2)
        hit3 = b.split(answer(b.named(places, prefix, False), back, _flat(open_)), places)
        rows = send(block, b.named(b.round4(hit1, hit2, hit3), min_len, True), n_buckets)
        return _frame([*rows, *((block % n_buckets, block, k + 1, _pack(h)) for k, h in enumerate((hit1, hit2, hit3)))])

    def last(pdf, back):
        columns = ["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        b = Block(pdf, min_len)
        hit1 = _bits(back, 1, b.round1(), b)
        hit2 = _bits(back, 2, b.round2(hit1), b)
        hit3 = _bits(back, 3, b.round3(hit1, hit2)[0], b)
        places = b.round4(hit1, hit2, hit3)
        hit4 = b.split(answer(b.named(places, min_len, True), back), places)
        rows = []
        for digest, text, own, hit, sure in zip(b.digest, b.text, places, hit4, b.known(hit1, hit2)):
            sure[own[hit]] = True
            sure |= b.n[digest] > 1
            gone = b.near(len(text), np.nonzero(sure)[0], np.nonzero(sure)[0] + min_len)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            row = (digest, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
            rows.append((*row, kept.decode("utf-8", "ignore")) if keep_text else row)
        return pd.DataFrame(rows, columns=columns)

    def back(sent: DataFrame, width: int) -> DataFrame:
        return sent.groupBy("bucket").applyInPandas(lambda pdf: meet(pdf, width), BACK)

    found = back(by_block.applyInPandas(first, SENT), 5)
    found = back(by_block.cogroup(found.groupBy("block")).applyInPandas(second, SENT), DECIDE)
    found = back(by_block.cogroup(found.groupBy("block")).applyInPandas(third, SENT), 6)
    found = back(by_block.cogroup(found.groupBy("block")).applyInPandas(fourth, SENT), DECIDE)
    out = "digest string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    return by_block.cogroup(found.groupBy("block")).applyInPandas(last, out)


def _prepared(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    return docs.select(F.sha2(raw, 256).alias("digest"), raw.alias("text"))


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``docs``.

    Null texts are empty. A row that comes twice repeats itself, so its text
    goes if it has ``min_len`` bytes. Empty tables give empty results; other
    columns are not looked at.
    """
    found = repeated_spans(_prepared(docs), min_len)
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(raw, 256).alias("digest"))
    return ids.join(found, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose every repeated string of ``MIN_LEN`` bytes.

    A character cut in two by a byte boundary goes whole. Null texts stay
    null, empty ones empty; a row that comes twice loses its text if that has
    ``MIN_LEN`` bytes. Other columns, of any name, stay as they are but for
    ``n_chars``, which follows the text. An empty table gives an empty result.
    """
    found = repeated_spans(_prepared(docs), MIN_LEN, keep_text=True).where("n_removed > 0").select("digest", "kept")
    whole = docs.select(F.struct("*").alias("doc"))  # own names beside any column's
    raw = F.encode(F.coalesce(F.col("doc.text"), F.lit("")), "utf-8")
    joined = whole.withColumn("digest", F.sha2(raw, 256)).join(found, "digest", "left")
    changed = F.col("kept").isNotNull() & F.col("doc.text").isNotNull()
    return replace_text(joined, changed, F.col("kept")).select("doc.*")


QUERIES = {"op5_suffix_array": op5_suffix_array}
ORACLES: dict[str, str] = {}
