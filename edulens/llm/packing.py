"""Best-fit packing of tokenized documents by hierarchical residual packing.

Documents become token pieces; full pieces are sequences at once. The rest are
dealt to groups that pack best-fit decreasing on their own and let go of their
nearly full bins. Underfull bins are dealt again, each as one item, to ever
fewer groups, until one group is left or merging stops helping.

Scale: only piece digests (never token ids or texts) are shuffled; a group
holds a bounded number of items whatever the input; every round shuffles
underfull bins only.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_checkpoint, table, text_slices

CAPACITY = 1024
END_ID = 2
NEARLY_FULL = 0.98
GROUP_ITEMS = 8192
GROUP_BINS = 256
TOKENIZER = "byte_bpe_50k"
CACHE_RUNS = 300_000

# Characters whose class is the same to every regex engine; a run with any
# other goes through the tokenizer itself.
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-ɏ]")
_GAP = re.compile(r" \s")
_LEAD = re.compile(r" (?=\S)")


class TextEncoder:
    """text -> little-endian uint32 ids, as the tokenizer file gives them.

    A space before a visible character always begins a pre-token, and merges
    never cross pre-tokens. So a text is cut there into runs, each distinct run
    is encoded once, and the new runs of many texts are encoded together: the
    ids of a run are those that cover its bytes.
    """

    def __init__(self, name: str):
        import tiktoken

        self.file = public_tokenizers.path(f"{name}.json")
        with open(self.file) as f:
            self.specials = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.width[k] = len(token)
        self.bpe = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.known: dict[str, bytes] = {}
        self._whole = None

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text from the tokenizer itself, loaded when first needed."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.file)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4")

    def cut(self, text: str) -> list[str] | None:
        """The runs of a text, all but the first without their leading space."""
        if any(s in text for s in self.specials):
            return None
        return _LEAD.split(text) if _GAP.search(text) else text.split(" ")

    def learn(self, runs: list[str], encode) -> None:
        """Encode space-led runs together and keep the ids of each."""
        if not runs:
            return
        text = " " + " ".join(runs)
        ids = encode(text).astype("<u4")
        data = np.frombuffer(text.encode(), np.uint8)
        end = np.append(np.flatnonzero(data == 32)[1:], len(data))
        if len(end) > len(runs):  # some run ends in more space
            end = np.cumsum([len(r.encode()) + 1 for r in runs])
        at = np.cumsum(self.width[ids])
        cut = np.searchsorted(at, end) + 1
        if at[-1] != end[-1] or (at[cut - 1] != end).any():
            raise ValueError("tokens do not end where runs end")
        raw, cut = ids.tobytes(), (4 * cut).tolist()
        self.known.update(zip(runs, map(raw.__getitem__, map(slice, [0, *cut], cut))))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        if len(self.known) > CACHE_RUNS:
            self.known.clear()
        new = set().union(*(c[1:] for c in cuts if c)).difference(self.known)
        odd = {r for r in new if _OTHER.search(r)} if _OTHER.search(" ".join(new)) else set()
        self.learn(list(new - odd), self.bpe.encode_to_numpy)
        self.learn(list(odd), self.whole)
        known, out = self.known.__getitem__, []
        for text, runs in zip(texts, cuts):
            if runs is None:
                out.append(self.whole(text).tobytes())
            else:
                first = self.whole(runs[0]) if _OTHER.search(runs[0]) else self.bpe.encode_to_numpy(runs[0])
                out.append(first.astype("<u4").tobytes() + b"".join(map(known, runs[1:])))
        return out


@lru_cache(maxsize=2)
def text_encoder(name: str) -> TextEncoder:
    return TextEncoder(name)


PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every row of ``docs``.

    A null text is empty and still yields its end id; a null doc_id stays null.
    Only documents longer than ``capacity`` are cut; their first piece takes the
    remainder. Repeated rows are encoded each; other columns are not looked at;
    an empty table gives an empty result.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = text_encoder(tokenizer).encode_all
        for ids, texts in text_slices(batches):
            rows = []
            for doc_id, raw in zip(ids, encode([t or "" for t in texts])):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                rows += [
                    (doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for k, (a, b) in enumerate(pairwise(cuts))
                ]
            columns = zip(*rows) if rows else [[]] * len(PIECE)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECE)], schema=PIECE)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item indexes of each bin. Open bins are kept by
    residual; a bit set finds the tightest that still fits."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room.setdefault(room - s, []).append(b)
        rooms |= 1 << (room - s)
    return bins


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, size long"


def pack_round(rows: DataFrame, groups: int, seed: int, capacity: int) -> DataFrame:
    """One best-fit round over bins dealt to ``groups`` groups.

    ``rows`` are pieces with their ``bin``, ``offset`` in it and its ``size``;
    bins packed together become one, under the number of the first.
    """

    def run(part: pa.Table) -> pa.Table:
        bins, offset, size = (part[c].to_numpy() for c in ("bin", "offset", "size"))
        own, first, which = np.unique(bins, return_index=True, return_inverse=True)
        sizes = size[first]
        new, base, total = np.empty_like(own), np.empty_like(own), np.empty_like(own)
        for members in best_fit(sizes.tolist(), capacity):
            ends = np.cumsum(sizes[members])
            new[members], base[members], total[members] = own[members[0]], ends - sizes[members], ends[-1]
        out = part.drop_columns(["bin", "offset", "size"])
        for name, column in (("bin", new[which]), ("offset", offset + base[which]), ("size", total[which])):
            out = out.append_column(name, pa.array(column))
        return out.drop_columns(["g"])

    dealt = rows.withColumn("g", F.pmod(F.xxhash64("bin", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, PLACED)


def pack(parts: DataFrame, capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Place pieces into sequences: adds ``sequence_id`` and ``offset``.

    Every input row is placed exactly once, repeated rows each on their own;
    an empty table gives an empty result.
    """
    keep = shared_checkpoint(parts.withColumn("bin", F.monotonically_increasing_id()))
    rows = keep.select("*", F.lit(0).cast("long").alias("offset"), F.col("length").alias("size"))
    full = F.col("size") >= int(capacity * nearly_full)
    bins = F.count_if(F.col("offset") == 0)  # each bin has one piece there
    done, open_ = [rows.where(full)], rows.where(~full)
    left = open_.select(bins).first()[0]
    groups, seed = max(1, -(-left // GROUP_ITEMS)), 0
    while left:
        made = shared_checkpoint(pack_round(open_, groups, seed, capacity))
        done.append(made.where(full))
        open_ = made.where(~full)
        was, left = left, open_.select(bins).first()[0]
        if groups == 1 or (seed and left > 0.97 * was):
            done.append(open_)
            break
        groups, seed = max(1, min(groups - 1, -(-left // GROUP_BINS))), seed + 1
    placed = reduce(DataFrame.unionByName, done)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row per piece of every document it is given. A null
    text is one end id, a repeated row is packed again, other columns are not
    looked at, and an empty table gives an empty result."""
    return pack(pieces(docs))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
