"""SentencePiece encoding and decoding with byte-exact source offsets.

The normaliser walks the model's compiled character map itself, taking the
longest rule at each place, and records for every normalised byte the source
byte it came from. The normalised text is merged into pieces here, by the
model's scores; their lengths give the pieces' normalised bounds, and the
alignment projects these to spans of the original UTF-8 bytes.

Scale: one pass without a shuffle; a text is the unit of work, and the arrays
kept for it are a small multiple of its length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()
CACHE_RUNS = 300_000
SHORT_RUN = 48
NO_PAIR = 1 << 30
SLICE = 400  # texts encoded together
_RUN = re.compile("▁*[^▁]+|▁+")


class Merger:
    """Pieces of normalised text: neighbours are merged, the best-scored pair
    first and the leftmost of equals, until no two make a piece. Characters
    that are no piece become their bytes."""

    def __init__(self, model):
        kinds = model.SentencePiece
        order = {score: k for k, score in enumerate(sorted({-p.score for p in model.pieces}))}
        self.rank = {p.piece: order[-p.score] for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        # Every pair of pieces that makes a piece, by one number: rank and piece made.
        # Beyond the pieces come the characters that are none.
        self.size, self.base = len(model.pieces), len(model.pieces) + 0x110000
        made = sorted(
            (self.id[p[:k]] * self.base + self.id[p[k:]], self.rank[p], own)
            for p, own in self.id.items()
            for k in range(1, len(p))
            if p[:k] in self.id and p[k:] in self.id
        )
        self.pair, self.pair_rank, self.pair_made = np.array(made or [(-1, 0, 0)], np.int64).T.copy()
        single = sorted((ord(p), k) for p, k in self.id.items() if len(p) == 1)
        self.char, self.char_id = np.array(single or [(-1, 0)], np.int64).T.copy()

    def _at(self, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def many(self, texts: list[str]) -> list[bytes]:
        """``ids`` of each text, as little-endian bytes; short ones together, one
        merge of each at a time."""
        out: list[bytes | None] = [None] * len(texts)
        short = [k for k, t in enumerate(texts) if 0 < len(t) <= SHORT_RUN]
        code = np.frombuffer("".join([texts[k] for k in short]).encode("utf-32-le"), "<u4").astype(np.int64)
        at, known = self._at(self.char, code)
        run = np.repeat(np.arange(len(short)), [len(texts[k]) for k in short])
        sym = np.where(known, self.char_id[at], self.size + code)
        while len(sym):
            # ``rank`` of a place is that of the pair it makes with the next place.
            at, is_pair = self._at(self.pair, sym[:-1] * self.base + sym[1:])
            is_pair &= run[:-1] == run[1:]
            rank = np.append(np.where(is_pair, self.pair_rank[at], NO_PAIR), NO_PAIR)
            made = np.append(self.pair_made[at], 0)
            key = rank * len(sym) + np.arange(len(sym))  # the leftmost of equals
            first = np.nonzero(np.append(True, run[1:] != run[:-1]))[0]
            best = np.minimum.reduceat(key, first)
            going = best < NO_PAIR * len(sym)
            ended = np.repeat(~going, np.diff(np.append(first, len(sym))))
            if ended.any():
                self._put(out, short, sym[ended], run[ended])
            place = best[going] % len(sym)
            sym[place] = made[place]
            stay = ~ended
            stay[place + 1] = False
            sym, run = sym[stay], run[stay]
        return [r if r is not None else np.array(self.ids(t), "<i4").tobytes() for r, t in zip(out, texts)]

    def _put(self, out: list, short: list[int], sym: np.ndarray, run: np.ndarray) -> None:
        raw = sym.astype("<i4").tobytes()
        first = np.nonzero(np.append(True, run[1:] != run[:-1]))[0]
        cut = np.append(first, len(sym)).tolist()
        odd = set(run[sym >= self.size].tolist())
        for k, a, b in zip(run[first].tolist(), cut, cut[1:]):
            out[short[k]] = raw[4 * a : 4 * b] if k not in odd else self._bytes(sym[a:b].tolist())

    def _bytes(self, sym: list[int]) -> bytes:
        ids = [[k] if k < self.size else [self.byte[c] for c in chr(k - self.size).encode()] for k in sym]
        return np.array(sum(ids, []), "<i4").tobytes()

    def ids(self, text: str) -> list[int]:
        part, rank = list(text), self.rank.get
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int, j: int):
            r = rank(part[i] + part[j])
            if r is not None:  # rank, place and length in one number
                heapq.heappush(heap, (r << 64) | (i << 32) | (len(part[i]) + len(part[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            top = heapq.heappop(heap)
            i, size = (top >> 32) & 0xFFFFFFFF, top & 0xFFFFFFFF
            j = right[i]
            if not part[i] or j < 0 or len(part[i]) + len(part[j]) != size:
                continue  # a part of this pair went into another
            part[i] += part[j]
            part[j] = ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        out = []
        for piece in filter(None, part):
            k = self.id.get(piece)
            out += [k] if k is not None else [self.byte[c] for c in piece.encode()]
        return out


class CharMap:
    """The compiled character map: a little-endian size, a double-array trie of
    that many bytes, then the zero-terminated replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.unit = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.text = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest source prefix with a rule, and its replacement."""
        unit, found = self.unit, None
        if not unit:
            return None
        node = 0
        node ^= self._offset(unit[node])
        for k in range(at, len(data)):
            c = data[k]
            node ^= c
            if node >= len(unit) or (unit[node] & ((1 << 31) | 0xFF)) != c:
                break
            leaf = (unit[node] >> 8) & 1
            node ^= self._offset(unit[node])
            if leaf:
                start = unit[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.text[start : self.text.index(b"\0", start)])
        return found

    @staticmethod
    def _offset(u: int) -> int:
        return (u >> 10) << ((u & (1 << 9)) >> 6)


def _char_len(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def normalize(data: bytes, rules: CharMap, dummy_prefix=True, squeeze=False, escape=True):
    """Normalised bytes, and the source byte of each of them plus of the end."""
    if not data:
        return b"", np.zeros(1, np.int64)
    space = SPACE if escape else b" "
    if not rules.unit and not squeeze:
        raw = np.frombuffer(data, np.uint8)
        width = np.where(raw == 32, len(space), 1) if escape else np.ones(len(raw), np.int64)
        align = np.repeat(np.arange(len(raw)), width)
        text = data.replace(b" ", space)
        if dummy_prefix:
            text, align = space + text, np.concatenate([np.zeros(len(space), np.int64), align])
        return text, np.append(align, len(data))
    parts: list[tuple[bytes, int]] = []
    at = 0
    while at < len(data):
        hit = rules.longest(data, at)
        n, new = hit or (_char_len(data[at]), data[at : at + _char_len(data[at])])
        parts.append((new, at))
        at += n
    end = len(data)
    if squeeze:  # no space at either end, single ones between
        lead = 0
        while lead < len(parts) and parts[lead][0].strip(b" ") == b"":
            lead += 1
        parts = parts[lead:]
    out, align, spaced = bytearray(), [], squeeze
    if parts and dummy_prefix:
        out += space
        align += [parts[0][1]] * len(space)
    for new, src in parts:
        if squeeze and spaced:
            new = new.lstrip(b" ")
        if not new:
            continue
        for c in new:
            add = space if c == 32 else bytes([c])
            out += add
            align += [src] * len(add)
        spaced = squeeze and new.endswith(b" ")
    if squeeze:
        while out.endswith(space):
            del out[len(out) - len(space) :]
            end = align[len(out)]
            del align[len(out) :]
    return bytes(out), np.array([*align, end], np.int64)


class Encoder:
    """Normalise, merge and align one text; decode many."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = spm.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, model.SentencePiece
        self.rules = CharMap(spec.precompiled_charsmap)
        self.spec = (spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        # Models without byte pieces, or with pieces matched ahead of the merges, are left to the library.
        self.own = (
            model.trainer_spec.model_type == model.trainer_spec.BPE
            and model.trainer_spec.byte_fallback
            and not any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        )
        # A merge needs a piece that spans it. Where no piece has a space mark after another character, the
        # runs that start at a mark are merged on their own and remembered.
        mark = SPACE.decode()
        self.apart = not any(mark in p.piece.lstrip(mark) for p in model.pieces)
        self.merger = Merger(model)
        self.known: dict[str, bytes] = {}
        self.unknown = self.sp.unk_id()

    def ids(self, texts: list[str], norms: list[str]) -> list[np.ndarray]:
        """Ids of normalised texts."""
        if not self.own:
            return [np.array(self.sp.encode(t, add_bos=False, add_eos=False), np.int32) for t in texts]
        cuts = [_RUN.findall(n) if self.apart or not n else [n] for n in norms]
        if len(self.known) > CACHE_RUNS:
            self.known.clear()
        new = list(set().union(*cuts).difference(self.known))
        self.known.update(zip(new, self.merger.many(new)))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, runs)), "<i4") for runs in cuts]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids and byte spans (n, 2) in the source of each text."""
        aligned = [normalize(t.encode(), self.rules, *self.spec) for t in texts]
        out = []
        for text, (norm, align), ids in zip(texts, aligned, self.ids(texts, [n.decode() for n, _ in aligned])):
            size = self.width[ids]
            holes = np.nonzero(ids == self.unknown)[0]
            if len(holes):  # an unknown piece covers as many bytes as the library says
                for k, piece in zip(holes, np.array(self.sp.encode(text, out_type=str), object)[holes]):
                    size[k] = len(piece.encode())
            end = np.cumsum(size)
            if (int(end[-1]) if len(end) else 0) != len(norm):
                raise ValueError("pieces do not cover the normalised text")
            out.append((ids, np.stack([align[end - size], align[end]], axis=1)))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, spans)``: ids and ``struct<begin,end>`` byte spans.

    Null and empty texts give empty arrays; a null doc_id stays null; repeated
    rows are encoded each; other columns are not looked at; an empty table gives
    an empty result.
    """
    where = path or public_tokenizers.path(MODEL)

    def run(batches):
        for doc_ids, texts in text_slices(batches, SLICE):
            got = encoder(where).encode_all([t or "" for t in texts])
            columns = [
                pa.array(doc_ids, pa.int64()),
                pa.array([ids for ids, _ in got], pa.list_(pa.int32())),
                pa.array([[{"begin": a, "end": b} for a, b in s.tolist()] for _, s in got], SPANS),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "spans"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>, spans array<struct<begin:long,end:long>>")


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32)`` per row.

    The same encoder as ``encode_documents``, digested in the task so that ids
    need not be written. Null and empty texts have no tokens and the digests
    of empty strings; rows repeat as they do in the input; an empty table gives
    an empty result.
    """
    where = path or public_tokenizers.path(MODEL)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]

    def run(batches):
        own = encoder(where)
        decimal = [str(k) for k in range(len(own.width))]
        for doc_ids, texts in text_slices(batches, SLICE):
            rows = []
            for ids, spans in own.encode_all([t or "" for t in texts]):
                plain = ids.tolist()
                listed = ",".join([decimal[k] for k in plain])
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in (listed, own.sp.decode(plain))]
                rows.append((len(plain), *digests, zlib.crc32(spans.astype("<i8", copy=False))))
            columns = [pa.array(doc_ids, pa.int64())]
            columns += [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return _texts(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
ORACLES: dict[str, str] = {}
