"""Phrase collocations from FM-indexes over word ids, one index per shard.

Texts become shards of word ids. An index of a shard holds the words before the
sorted suffixes and the words after the sorted prefixes, both sorted to a few
words deep only. A phrase is an interval in either order; extending it to the
left or the right splits its interval by the neighbouring words and keeps the
other one in step, so all phrases of a depth come with their counts. Counts are
summed across shards.

Scale: nearly all phrases are rare, so shards first add up short hashes of all
phrases of up to four words (a count-min sketch with one hash, dealt by ranges of
hashes; about a byte each). A sum is never below the count of a phrase, so what
stays below the least count is dropped and nothing frequent is. The hashes that
are left go back to the shards that sent them through a join, never a broadcast,
and the indexes count only such phrases, spelled out, exactly. A phrase that is
frequent has frequent parts, so longer ones are sought only along those that are
left. A shard holds a bounded number of words of any languages; a text
larger than that is cut, and the next shard sees the last words before the cut
without counting them. The ranking is by range partitions, so a language that
holds most rows is in no single task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_checkpoint, shuffle_width, table

DEPTH = 4
MIN_COUNT = 30
TOP = 2000
SCORE_SCALE = 2_000_000
COVER_PERCENT = 80
SHARD_WORDS = 1 << 19
#: Shards that share a list of words; what they emit is added up first.
TOGETHER = 4
BLOCK_BYTES = 1 << 20
#: Most distinct words of a row of shards, and rows of a partition, as powers of two.
PLACE_BITS, SEQUENCE_BITS = 25, 13
#: Odd factors of phrase hashes.
MIX, SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
#: Counters of the sketch that are added up at once, as a power of two.
RANGE_BITS = 22

#: What each byte is: 0 in a word, 1 between words, 2 between pieces.
CLASS = np.zeros(256, np.uint8)
CLASS[list(b" \t")] = 1
CLASS[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

SHARDS = "shard long, tokens array<binary>, words binary, size long"
SENT = "range long, shard long, slots binary"
PACKED = "range long, lang string, counts binary"


def cut_words(raw: np.ndarray) -> tuple[pa.Array, np.ndarray, bool]:
    """The lower-cased words of some bytes; for each whether it follows the one
    before in its piece (the first: the bytes' begin); whether a piece ends
    after the last."""
    kind = CLASS[raw]
    word = kind == 0
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    breaks = np.cumsum(kind == 2)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    data = [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[raw[word]])]
    follows = np.diff(breaks[start], prepend=0) == 0
    after = len(breaks) > 0 and breaks[-1] > (breaks[start[-1]] if len(start) else 0)
    return pa.Array.from_buffers(pa.binary(), len(start), data), follows, bool(after)


def windows(raw: np.ndarray, size: int):
    """Parts of some bytes of about ``size``, cut between words."""
    at = 0
    while at < len(raw):
        upto = at + size
        while upto < len(raw):
            gaps = np.flatnonzero(CLASS[raw[at:upto]])
            if len(gaps):
                upto = at + gaps[-1] + 1
                break
            upto += size
        yield raw[at:upto]
        at = upto


def blocks(batches, size: int):
    """``(lang, bytes, whether they go on with the text before)`` from batches of
    ``(lang, text)``; many short texts in one, a long text in several."""
    held: dict[str, list] = {}
    room: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1).cast(pa.binary())):
            lang, raw = lang.as_py(), text.as_py()
            if len(raw) > size:
                for k, part in enumerate(windows(np.frombuffer(raw, np.uint8), size)):
                    yield lang, part, k > 0
                continue
            held.setdefault(lang, []).append(raw)
            room[lang] = room.get(lang, 0) + len(raw)
            if room[lang] > size:
                yield lang, np.frombuffer(b"\n".join(held.pop(lang)), np.uint8), False
                room[lang] = 0
    for lang, texts in held.items():
        yield lang, np.frombuffer(b"\n".join(texts), np.uint8), False


def pack(ids: np.ndarray, follows: np.ndarray, seen: np.ndarray) -> bytes:
    """Word ids with two flags each: follows the word before; was counted elsewhere."""
    return zstandard.compress((ids.astype(np.uint32) << 2 | seen.astype(np.uint32) << 1 | follows).tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = np.frombuffer(zstandard.decompress(data), np.uint32)
    return (t >> 2).astype(np.int64), (t & 1).astype(bool), (t >> 1 & 1).astype(bool)


def shards_row(shards: list[dict[str, list]], number: int) -> pa.RecordBatch:
    """Shards with one list of words, each from lists of (words, follows, seen) by
    language."""
    tokens: list[list] = [[] for _ in shards]
    words, base, size = [], 0, 0
    for lang in sorted(set().union(*shards)):
        parts = [[x for x in held.get(lang, ())] for held in shards]
        coded = pa.concat_arrays([x[0] for p in parts for x in p]).dictionary_encode()
        at, own, done = coded.indices.to_numpy(), coded.dictionary.cast(pa.string()), 0
        n = np.zeros(len(own), np.int64)
        for k, p in enumerate(parts):
            if p:
                follows, seen = (np.concatenate([x[c] for x in p]) for c in (1, 2))
                mine = at[done : done + len(seen)]
                n += np.bincount(mine[~seen], minlength=len(own))
                tokens[k].append((mine + base, follows, seen))
                done += len(seen)
        words.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, pa.array(n)], ["lang", "word", "n"]))
        base += len(own)
        size += int(n.sum())
    if base >> PLACE_BITS:
        raise ValueError("too many distinct words in a shard")
    data = [pack(*(np.concatenate(x) for x in zip(*t))) for t in tokens]
    listed = pa.BufferOutputStream()
    with pa.ipc.new_stream(listed, words[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for w in words:
            out.write_batch(w)
    columns = [pa.array([number]), pa.array([data], pa.list_(pa.binary())), pa.array([listed.getvalue().to_pybytes()], pa.binary()), pa.array([size])]
    return pa.RecordBatch.from_arrays(columns, ["shard", "tokens", "words", "size"])


def list_words(batches):
    """``(shard, at, lang, word, n)`` of the words of shards, numbered from 0."""
    for b in batches:
        for shard, words in zip(*b.columns):
            base = 0
            for w in pa.ipc.open_stream(words.as_py()):
                n = w.num_rows
                columns = [pa.array(np.full(n, shard.as_py())), pa.array(np.arange(base, base + n)), *w.columns]
                whole = pa.RecordBatch.from_arrays(columns, ["shard", "at", *w.schema.names])
                yield from (whole.slice(k, 50_000) for k in range(0, n, 50_000))
                base += n


def make_shards(batches, partition: int, shard_words: int, block_bytes: int, depth: int = DEPTH):
    """Shards of at least ``shard_words`` words (the last: any number), in rows of
    TOGETHER shards."""
    held: dict[str, list] = {}
    full: list[dict] = []
    size = made = 0
    tail, tail_follows, open_, cut = None, None, False, False
    for lang, raw, more in blocks(batches, block_bytes):
        words, follows, after = cut_words(raw)
        seen = np.zeros(len(words), bool)
        if not more:
            tail, open_, cut = None, False, False
        new_tail = words if tail is None else pa.concat_arrays([tail, words])
        new_follows = follows.copy()
        if len(words):
            new_follows[0] = follows[0] = follows[0] and open_
        if tail is not None:
            new_follows = np.concatenate([tail_follows, new_follows])
        if cut and len(words) and follows[0]:  # the shard before ended inside this piece
            seen = np.concatenate([np.ones(len(tail), bool), seen])
            words, follows = new_tail, new_follows
        if len(words):
            follows = follows.copy()
            if cut:
                follows[0] = False
            held.setdefault(lang, []).append((words, follows, seen))
            size += len(words)
            cut = False
        keep = max(0, len(new_tail) - (depth - 1))
        tail, tail_follows = new_tail[keep:], new_follows[keep:]
        open_ = not after and (len(words) > 0 or open_)
        if size >= shard_words:
            full.append(held)
            held, size, cut = {}, 0, True
        if len(full) == TOGETHER:
            yield shards_row(full, partition << SEQUENCE_BITS | made)
            made, full = made + 1, []
            if made >> SEQUENCE_BITS:
                raise ValueError("too many shards in a partition")
    if held:
        full.append(held)
    if full:
        yield shards_row(full, partition << SEQUENCE_BITS | made)


def with_breaks(ids: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words as one text with a 0 before each piece and at the end, and the
    place of each word in it."""
    place = np.arange(len(ids)) + np.cumsum(~follows)
    text = np.zeros(place[-1] + 2 if len(ids) else 1, np.int64)
    text[place] = ids
    return text, place


class Side:
    """One direction of an index: suffixes sorted to ``depth`` words (nothing
    counts beyond a 0) and the word before each."""

    def __init__(self, text: np.ndarray, depth: int):
        keys = [text]
        while len(keys) < depth:
            ahead = np.append(keys[-1][1:], 0)
            ahead[text == 0] = 0
            keys.append(ahead)
        size = np.int64(text.max() + 1)
        pairs = [keys[k] * size + keys[k + 1] if k + 1 < depth else keys[k] for k in range(0, depth, 2)]
        self.order = np.lexsort(pairs[::-1]) if len(pairs) > 1 else np.argsort(pairs[0], kind="stable")
        self.before = text[self.order - 1]
        self.n = len(text)
        by_word = np.argsort(self.before, kind="stable")
        self.occurrences = self.before[by_word] * self.n + by_word


@dataclass
class Intervals:
    """Phrases as intervals: begins among suffixes and among prefixes, and size."""

    left: np.ndarray
    right: np.ndarray
    size: np.ndarray


class FMIndex:
    """Bidirectional index of a text of word ids from 1 up, with 0 between pieces."""

    def __init__(self, text: np.ndarray, depth: int, seen: np.ndarray | None = None):
        """``seen``: places of the text whose phrases, ending there, are not counted."""
        self.symbols = int(text.max()) + 1
        self.before, self.after = Side(text, depth), Side(text[::-1], depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        own = np.ones(len(text), np.int64) if seen is None else 1 - seen.astype(np.int64)
        self.counted = np.concatenate([[0], np.cumsum(own[::-1][self.after.order])])

    def words(self) -> tuple[np.ndarray, Intervals]:
        word = np.arange(1, self.symbols)
        return word, Intervals(self.first[word], self.first[word], np.diff(self.first)[word])

    def count(self, iv: Intervals) -> np.ndarray:
        return self.counted[iv.right + iv.size] - self.counted[iv.right]

    def _split(self, side: Side, near: np.ndarray, far: np.ndarray, size: np.ndarray):
        end = np.cumsum(size)
        row = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(row)) - (end - size)[row]
        key, n = np.unique(row * self.symbols + side.before[near[row] + inside], return_counts=True)
        row, word = key // self.symbols, key % self.symbols
        smaller = np.cumsum(n) - n
        smaller -= (end - size)[row]
        keep = word > 0
        row, word, n, smaller = row[keep], word[keep], n[keep], smaller[keep]
        return row, word, np.searchsorted(side.occurrences, word * side.n + near[row]), far[row] + smaller, n

    def extend_left(self, iv: Intervals) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """``(row, word, intervals)`` of every word before every phrase."""
        row, word, left, right, n = self._split(self.before, iv.left, iv.right, iv.size)
        return row, word, Intervals(left, right, n)

    def extend_right(self, iv: Intervals) -> tuple[np.ndarray, np.ndarray, Intervals]:
        row, word, right, left, n = self._split(self.after, iv.right, iv.left, iv.size)
        return row, word, Intervals(left, right, n)


def phrases(index: FMIndex, depth: int, left=None):
    """Yield ``(words, count)`` of all phrases of 2, 3, ... ``depth`` words, a row
    each, extended to the left and to the right in turn; where ``left`` tells which
    rows are left, only those are yielded and extended."""
    word, iv = index.words()
    rows = word[:, None]
    for n in range(2, depth + 1):
        row, word, iv = index.extend_left(iv) if n % 2 == 0 else index.extend_right(iv)
        parts = [word[:, None], rows[row]] if n % 2 == 0 else [rows[row], word[:, None]]
        rows = np.concatenate(parts, axis=1)
        if left is not None:
            good = left(rows)
            rows, iv = rows[good], Intervals(iv.left[good], iv.right[good], iv.size[good])
        yield rows, index.count(iv)


def word_hashes(listed: pa.Table) -> np.ndarray:
    """64 bits of each word and its language, the same in every shard."""
    lang, word = (listed.column(c).to_numpy() for c in ("lang", "word"))
    return pd.util.hash_array(word, categorize=False) * MIX + pd.util.hash_array(lang)


def slot(code: np.ndarray, bits: int) -> np.ndarray:
    return (code * SPREAD) >> np.uint64(64 - bits)


def phrase_hashes(code: np.ndarray, follows: np.ndarray, depth: int):
    """Hashes of all phrases of 1, 2, ... ``depth`` words from those of a shard's words."""
    start, own = np.arange(len(code)), code
    yield own
    for k in range(1, depth):
        start = start[: np.searchsorted(start, len(code) - k)]
        inside = follows[start + k]
        own, start = own[: len(start)][inside], start[inside]
        own = own * MIX + code[start + k]
        yield own


def pack_slots(slots: np.ndarray) -> bytes:
    """Rising numbers below 2^32 as gaps, byte by byte of all of them."""
    return np.diff(slots, prepend=slots.dtype.type(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_slots(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(gaps).view("<u4").ravel(), dtype=np.int64)


def shard_rows(batch: pa.RecordBatch):
    """``(words, columns)`` of each row of shards, the words as a table."""
    for at in range(batch.num_rows):
        one = batch.slice(at, 1)
        yield pa.Table.from_batches(list_words([one.select(["shard", "words"])])), {c: one.column(c)[0].as_py() for c in one.schema.names if c != "words"}


def send_slots(batches, bits: int, range_bits: int, depth: int, min_count: int):
    """``(range, shard, slots)``: slots of all phrases of a row of shards, with how
    often each occurs, in ranges of 2^range_bits. Counts beyond ``min_count`` say
    no more than that, and a phrase seen in two shards may count twice here."""
    kind = np.min_scalar_type(min_count)
    for b in batches:
        for listed, row in shard_rows(b):
            own, found = word_hashes(listed), []
            for part in row["tokens"]:
                at, follows, _ = unpack(part)
                found += (slot(g, bits).astype(np.uint32 if bits <= 32 else np.uint64) for g in phrase_hashes(own[at], follows, depth))
            found = np.concatenate(found)
            found.sort()
            first = np.flatnonzero(np.diff(found, prepend=~found[:1]))
            n = np.minimum(np.diff(first, append=len(found)), min_count).astype(kind)
            slots = found[first].astype(np.int64)
            del found, first
            of = slots >> range_bits
            edge = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(slots))
            sent = [
                zstandard.compress(pack_slots(slots[x:y] - (of[x] << range_bits)) + n[x:y].tobytes(), 1)
                for x, y in zip(edge[:-1], edge[1:])
            ]
            columns = [pa.array(of[edge[:-1]]), pa.array(np.full(len(sent), row["shard"])), pa.array(sent, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["range", "shard", "slots"])


def slots_left(sent: pa.Table, range_bits: int, min_count: int) -> pa.Table:
    """For each shard its slots of a range whose counts come to ``min_count``."""
    kind = np.min_scalar_type(min_count)
    total = np.zeros(1 << range_bits, np.int64)

    def slots(data):
        raw = zstandard.decompress(data.as_py())
        size = len(raw) // (4 + kind.itemsize)
        return unpack_slots(raw[: 4 * size]), np.frombuffer(raw[4 * size :], kind)

    for data in sent.column("slots"):
        at, n = slots(data)
        total[at] += n
    kept = []
    for data in sent.column("slots"):
        at = slots(data)[0]
        at = at[total[at] >= min_count]
        kept.append(zstandard.compress(pack_slots(at), 1) if len(at) else None)
    return sent.set_column(sent.schema.get_field_index("slots"), "slots", pa.array(kept, pa.binary())).filter(pc.is_valid(pa.array(kept, pa.binary())))


def added_up(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of keys and a last one of counts, a row per key with its sum."""
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.lexsort(columns[-2::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
    start = np.flatnonzero(new)
    return [*(c[start] for c in columns[:-1]), np.add.reduceat(columns[-1], start) if len(start) else columns[-1]]


def indexed(word: np.ndarray, follows: np.ndarray, seen: np.ndarray, depth: int) -> FMIndex:
    text, place = with_breaks(word, follows)
    mark = np.zeros(len(text), bool)
    mark[place] = seen
    return FMIndex(text, depth, mark)


def packed_counts(of: np.ndarray, lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """``(range, lang, counts)``: sorted phrases of a range and language, compressed
    with their counts."""
    rows = pa.table({"range": of, "lang": lang.dictionary_encode().indices, "phrase": phrase, "n": n})
    rows = rows.add_column(4, "at", pa.array(np.arange(len(n)))).sort_by([(c, "ascending") for c in ("range", "lang", "phrase")])
    of, code, n, at = (rows.column(c).to_numpy() for c in ("range", "lang", "n", "at"))
    wide = pa.large_string()
    text = pc.binary_join_element_wise(rows.column("phrase").combine_chunks().cast(wide), pa.scalar("", wide), pa.scalar("\n", wide))
    _, offsets, data = text.buffers()
    offsets, data = np.frombuffer(offsets, np.int64, len(text) + 1), memoryview(data or b"")
    edge = np.append(np.flatnonzero((np.diff(of, prepend=-2) != 0) | (np.diff(code, prepend=-1) != 0)), len(n))
    packed = []
    for x, y in zip(edge[:-1], edge[1:]):
        size = np.array([y - x], "<i8").tobytes()
        counts = n[x:y].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
        packed.append(zstandard.compress(size + counts + bytes(data[offsets[x] : offsets[y]]), 3))
    columns = [pa.array(of[edge[:-1]]), lang.take(pa.array(at[edge[:-1]])), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["range", "lang", "counts"])


def add_counts(packed: pa.Table, min_count: int) -> pa.Table:
    """``(lang, phrase, f)`` of the phrases of a range and language with at least
    ``min_count``; the empty phrase always stays."""
    phrase, counts = [], []
    for data in packed.column("counts"):
        raw = zstandard.decompress(data.as_py())
        end = 8 + 8 * int.from_bytes(raw[:8], "little")
        counts.append(np.ascontiguousarray(np.frombuffer(raw[8:end], np.uint8).reshape(8, -1).T).view("<i8").ravel())
        phrase += raw[end:].decode().split("\n")[:-1]
    rows = pa.table({"phrase": pa.array(phrase, pa.string()), "f": np.concatenate(counts)})
    rows = rows.group_by("phrase").aggregate([("f", "sum")])
    rows = rows.filter((pc.field("f_sum") >= min_count) | (pc.field("phrase") == ""))
    lang = pa.array([packed.column("lang")[0].as_py()] * rows.num_rows, pa.string())
    return pa.table({"lang": lang, "phrase": rows.column("phrase"), "f": rows.column("f_sum")})


def count_left(batches, bits: int, range_bits: int, depth: int):
    """``packed_counts`` of the words and phrases whose slots are left, from rows
    of shards with ``left``, a list of (range, slots); and in range -1 the number
    of words of each language, as the empty phrase."""
    for b in batches:
        for listed, row in shard_rows(b):
            n = listed.column("n").to_numpy()
            every = listed.group_by("lang").aggregate([("n", "sum")])
            langs, ns = (every.column(c).combine_chunks() for c in ("lang", "n_sum"))
            yield packed_counts(np.full(len(langs), -1), langs, pa.array([""] * len(langs)), ns.to_numpy())
            parts = [unpack_slots(zstandard.decompress(x["slots"])) + (x["range"] << range_bits) for x in row["left"] or ()]
            if not parts:
                continue
            slots = np.sort(np.concatenate(parts)).astype(np.uint64)

            def is_left(code):
                own = slot(code, bits)
                return slots[np.minimum(np.searchsorted(slots, own), len(slots) - 1)] == own

            def range_of(code):
                return (slot(code, bits) >> np.uint64(range_bits)).astype(np.int64)

            code = word_hashes(listed)
            at_left = np.flatnonzero(is_left(code))
            new = np.zeros(len(code), np.int64)
            new[at_left] = np.arange(1, len(at_left) + 1)
            code = np.append(np.uint64(0), code[at_left])
            lang, word = (listed.column(c).combine_chunks().take(pa.array(at_left)) for c in ("lang", "word"))
            of, n, counted = range_of(code[1:]), n[at_left], n[at_left] > 0
            yield packed_counts(of[counted], lang.filter(pa.array(counted)), word.filter(pa.array(counted)), n[counted])

            def row_hashes(rows):
                own = code[rows[:, 0]]
                for k in range(1, rows.shape[1]):
                    own = np.where(rows[:, k] > 0, own * MIX + code[rows[:, k]], own)
                return own

            def rows_left(rows):
                return is_left(row_hashes(rows))

            found = None
            for part in row["tokens"]:
                at, follows, seen = unpack(part)
                at = new[at]
                joined = follows & (at > 0) & np.append(False, at[:-1] > 0)
                second = np.flatnonzero(joined)
                joined[second] = rows_left(np.stack([at[second - 1], at[second]], axis=1))
                kept = joined | np.append(joined[1:], False)
                if not kept.any():
                    continue
                for rows, n in phrases(indexed(at[kept], joined[kept], seen[kept], depth), depth, rows_left):
                    rows, n = rows[n > 0], n[n > 0]
                    blank = np.zeros(len(n), np.int64)
                    own = [rows[:, k] if k < rows.shape[1] else blank for k in range(depth)] + [n]
                    found = own if found is None else added_up([found, own])
            if found is not None:
                spelled = [word.take(pa.array(c - 1, mask=c == 0)) for c in found[:-1]]
                phrase = pc.binary_join_element_wise(*spelled, " ", null_handling="skip")
                of = range_of(row_hashes(np.stack(found[:-1], axis=1)))
                yield packed_counts(of, lang.take(pa.array(found[0] - 1)), phrase, found[-1])


def phrase_counts(docs: DataFrame, lang_col: str, text_col: str, min_count: int, depth: int, shard_words: int):
    """``(totals, counts)``: ``(lang, n)`` of all words, and ``(lang, phrase, f)``
    of the frequent phrases of 1 to ``depth`` words, joined by spaces."""
    texts = docs.select(F.coalesce(lang_col, F.lit("und")).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def cut(batches):
        return make_shards(batches, TaskContext.get().partitionId(), shard_words, BLOCK_BYTES, depth)

    shards = shared_checkpoint(texts.where("text is not null").mapInArrow(cut, SHARDS))
    # As many slots as words or more; as many ranges as tasks or more, of bounded size.
    size = shards.agg(F.sum("size")).first()[0] or 0
    ranges = (2 * shuffle_width(docs.sparkSession)).bit_length()
    bits = max(ranges, size.bit_length())
    range_bits = min(RANGE_BITS, bits - ranges)

    sent = shards.drop("size").mapInArrow(lambda batches: send_slots(batches, bits, range_bits, depth, min_count), SENT)
    left = sent.groupBy("range").applyInArrow(lambda sent: slots_left(sent, range_bits, min_count), SENT)
    left = left.groupBy("shard").agg(F.collect_list(F.struct("range", "slots")).alias("left"))
    found = shards.drop("size").join(left, "shard", "left")
    found = found.mapInArrow(lambda batches: count_left(batches, bits, range_bits, depth), PACKED)
    counts = found.groupBy("range", "lang").applyInArrow(
        lambda packed: add_counts(packed, min_count), "lang string, phrase string, f long"
    )
    counts = shared_checkpoint(counts)
    return counts.where("phrase = ''").select("lang", F.col("f").alias("n")), counts.where("phrase <> ''")


def best_cuts(counts: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of every phrase of two words or more by
    its lowest-scoring cut; ties go to the first."""
    sized = counts.select("lang", "phrase", F.split("phrase", " ").alias("key"), F.col("f").alias("a")).where(F.size("key") > 1)
    cut = sized.select("*", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    head, rest = (F.array_join(F.expr(f"slice(key, {x})"), " ") for x in ("1, k", "k + 1, size(key)"))
    cut = cut.select("lang", "phrase", "a", "k", head.alias("head"), rest.alias("rest"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    exact = f"(cast({SCORE_SCALE} as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + r)"
    scored = cut.select("lang", "phrase", F.struct(F.expr(exact).alias("score"), "k", "a", "l", "r").alias("s"))
    scored = scored.groupBy("lang", "phrase").agg(F.min("s").alias("s"))
    return scored.select("lang", "phrase", "s.a", "s.l", "s.r", "s.score")


def uncovered(scored: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Phrases that no longer phrase holds with ``percent`` of their occurrences."""
    parts = counts.select("lang", F.split("phrase", " ").alias("key"), "f").where(F.size("key") > 2)
    parts = parts.select("*", F.explode(F.sequence(F.lit(2), F.size("key") - 1)).alias("m"))
    parts = parts.select("*", F.explode(F.expr("sequence(1, size(key) - m + 1)")).alias("at"))
    parts = parts.select("lang", F.array_join(F.expr("slice(key, at, m)"), " ").alias("phrase"), "f")
    top = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    held = F.coalesce(F.col("most"), F.lit(0)).cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * percent
    return scored.join(top, ["lang", "phrase"], "left").where(~held).drop("most")


def ranked(rows: DataFrame, by: list, top: int) -> DataFrame:
    """The first ``top`` rows of each ``lang`` in the order ``by``, with ``rank``,
    by sorted ranges whose sizes are added up."""
    spark = rows.sparkSession
    laid = rows.repartitionByRange(shuffle_width(spark), "lang", *by).withColumn("part", F.spark_partition_id())
    laid = shared_checkpoint(laid)
    sizes = laid.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("lang", "part", F.coalesce(before, F.lit(0)).alias("before")).where(F.col("before") < top)
    number = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by)).cast("long")
    placed = laid.join(sizes, ["lang", "part"]).withColumn("rank", F.col("before") + number)
    return placed.where(F.col("rank") <= top).drop("part", "before")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    min_count: int = MIN_COUNT,
    depth: int = DEPTH,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    Null and empty texts have no words; a null language is ``und``; repeated rows
    count again; other columns are not looked at; an empty table gives an empty
    result. Ties in score and count go by the phrase in code-point order.
    """
    totals, counts = phrase_counts(docs, lang_col, text_col, min_count, depth, shard_words)
    rows = shared_checkpoint(uncovered(best_cuts(counts), counts, COVER_PERCENT))
    found = ranked(rows, [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top)
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_phrase_collocations": op12_phrase_collocations}
ORACLES = {
    "op12_phrase_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed
), grams AS (
  SELECT lang, ws[i:i + m - 1] AS g, count(*) AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(ws) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE len(g) = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM grams WHERE f >= {MIN_COUNT}
), cuts AS (
  SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM frequent WHERE len(g) > 1
), scored AS (
  SELECT c.lang, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, ({SCORE_SCALE}::HUGEINT * c.f) // (x.f + y.f) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.g = c.g[1:c.k]
  JOIN frequent y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), sizes AS (
  SELECT lang, g, f, unnest(range(2, len(g))) AS m FROM frequent WHERE len(g) > 2
), parts AS (
  SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS i FROM sizes
), cover AS (
  SELECT lang, g[i:i + m - 1] AS g, max(f) AS most FROM parts GROUP BY ALL
), kept AS (
  SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.g = b.g
  WHERE c.most IS NULL OR 100 * c.most < {COVER_PERCENT} * b.a
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, t.n, score::BIGINT AS score FROM placed JOIN totals t USING (lang) WHERE rank <= {TOP}
""",
}
