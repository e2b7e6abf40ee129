"""Best-fit packing of token sequences by exact-complement hashing.

A document longer than a sequence is cut into full pieces, the remainder first. The plan is made on the histogram of piece
lengths (one count a length, so its size is the sequence length, not the data's): for the longest length left, the index of
single, pair and triple sums of available lengths names what fills its gap exactly, used as often as the counts allow; what
can't be completed goes best-fit, longest first, into the fullest open sequence that holds it. Pieces then take the places of
the plan by their rank in their length, ranked in salted groups, so no length gathers in one task.
Full pieces need no plan and no rank: each is a sequence of its own, with a negative number.
Defined results: null or empty text is the end token alone; the vocabulary's special entry in a text is its id, as `tokenizers` reads
it; repeated rows, with equal or null keys too, are packed each on its own; texts of any length are tokenised whole; extra columns
are not read, whatever their names; an empty table packs to none."""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.batches import small_batches, stored

#: Tokens of a sequence, the id that ends a document, and the vocabulary's entry that isn't text.
CAPACITY, END, SPECIAL = 1024, 2, "<|endoftext|>"


class Tokens:
    """Token bytes (little-endian unsigned 32-bit ids) of a text, from the vocabulary of a byte-level BPE file.

    The special entry is one token wherever it stands; the text between is split and merged on its own.
    The published split pattern looks ahead only to cut runs of white space; a text without such a run takes the same
    pattern without the look-ahead, which is faster and splits alike."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])} | vocab
        chars = _byte_chars()
        ranks = {bytes(chars[c] for c in w): i for w, i in vocab.items() if w != SPECIAL}
        self._special = np.array([special[SPECIAL]], "<u4").tobytes() if SPECIAL in special else b""
        make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._full = make("full", public_tokenizers.PATTERN)
        self._plain = make("plain", public_tokenizers.PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s"))
        self._run = re.compile(r"\s\s")

    def encode(self, text: str) -> bytes:
        if self._special and SPECIAL in text:
            return self._special.join(map(self._encode, text.split(SPECIAL)))
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        enc = self._full if self._run.search(text) else self._plain
        return array("I", enc.encode_ordinary(text)).tobytes()


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies (a fixed, public rule)."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + n)] = b
            n += 1
    return out


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity if n exceeds it."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


PIECES = StructType([StructField(c, LongType()) for c in ("doc_id", "piece", "start", "length", "ids_crc32")])


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32. One map over whole texts."""
    rows = small_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        tok = Tokens(path)
        for b in batches:
            out = [[], [], [], [], []]
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = tok.encode(t or "") + tail
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for col, v in zip(out, (i, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], PIECES.names)

    return rows.mapInArrow(run, PIECES)


def complete(gap: int, counts: np.ndarray, own: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to gap, the longest first part that works. own: a length already used once."""
    counts[own] -= 1
    try:
        if counts[gap] > 0:
            return (gap,)
        have = np.flatnonzero(counts[: gap + 1] > 0)
        have = have[have > 0]
        if not len(have):
            return None
        other = gap - have
        pair = (counts[other] > 0) & (other > 0) & ((other != have) | (counts[have] > 1))
        if pair.any():
            a = int(have[pair].max())
            return (a, gap - a)
        for a in have[::-1].tolist():
            rest = gap - a
            b = have[have <= min(a, rest - 1)]
            if not len(b):
                continue
            c = rest - b
            ok = (c > 0) & (c <= b) & (counts[c] > 0)
            used = 1 + (b == a)
            ok &= counts[b] >= used
            ok &= counts[c] >= 1 + (c == a) + (c == b)
            if ok.any():
                b1 = int(b[ok].max())
                return (a, b1, rest - b1)
        return None
    finally:
        counts[own] += 1


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Packing of piece lengths: (lengths of one sequence, how many such sequences). Uses every piece once."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    done: list[tuple[tuple[int, ...], int]] = []
    open_: list[list] = []  # [room, lengths, how many]
    if counts[capacity]:
        done.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    for n in range(capacity - 1, 0, -1):
        while counts[n] > 0:
            with_ = complete(capacity - n, counts, n)
            if with_ is None:
                break
            combo = (n, *with_)
            need: dict[int, int] = {}
            for x in combo:
                need[x] = need.get(x, 0) + 1
            times = min(int(counts[x]) // k for x, k in need.items())
            for x, k in need.items():
                counts[x] -= times * k
            done.append((combo, times))
        left = int(counts[n])
        counts[n] = 0
        while left > 0:
            # the fullest open sequence with room for n
            at = bisect_left(open_, [n])
            if at < len(open_):
                room, lengths, k = open_.pop(at)
                fits = room // n
                times = min(k, left // fits) if left >= fits else 0
                if times:
                    new = (lengths + (n,) * fits, times, room - fits * n)
                    left -= times * fits
                else:
                    new = (lengths + (n,) * left, 1, room - left * n)
                    times, left = 1, 0
                if k > times:
                    insort(open_, [room, lengths, k - times])
                if new[2]:
                    insort(open_, [new[2], new[0], new[1]])
                else:
                    done.append((new[0], new[1]))
            else:
                fits = min(capacity // n, left)
                times = left // fits
                insort(open_, [capacity - fits * n, (n,) * fits, times])
                left -= times * fits
    return done + [(lengths, k) for _, lengths, k in open_]


def slots(packing: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """The plan as arrays sorted by (length, first rank): length, first rank, first sequence, offset of the piece in it.

    Ranks of a length from `first` on take the consecutive sequences from `sequence` on, at that offset."""
    rows, base, used = [], 0, {}
    for lengths, times in packing:
        at = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), base, at))
            used[n] = used.get(n, 0) + times
            at += n
        base += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


#: Pieces of one length that are ranked together; a length with more is dealt to groups by a salt, to at least SPREAD if it has a few hundred a group.
GROUP, SPREAD = 100_000, 64


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """Every piece with its place. Texts are tokenised once; then only five integers a piece move, and none of a full piece.

    On the driver are the counts by length (at most `capacity` rows) and those by length and salt (a row a `group` of pieces beyond capacity * SPREAD)."""
    spark = docs.sparkSession
    own = stored(pieces(docs, path, key, text, capacity, end), "pieces")
    full, rest = own.where(F.col("length") == capacity), own.where(F.col("length") < capacity)
    histogram = {r.length: r.n for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = [1] * capacity
    for n, count in histogram.items():
        salts[n] = max(-(-count // group), min(SPREAD, count // 256), 1)
    many = F.array(*map(F.lit, salts))[F.col("length").cast("int")]
    rest = rest.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), many).cast("int"))
    before, at = {}, {}
    if max(salts) > 1:
        for r in sorted(rest.groupBy("length", "salt").agg(F.count("*").alias("n")).collect(), key=lambda r: (r.length, r.salt)):
            before[r.length, r.salt] = at.get(r.length, 0)
            at[r.length] = at.get(r.length, 0) + r.n
    table = spark.sparkContext.broadcast((slots(plan(histogram, capacity)), before))
    w = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rest.withColumn("rank", F.row_number().over(w).cast("long") - 1)
    out = StructType([*PIECES.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(batches):
        (length, first, sequence, at), start = table.value
        key_of = length * (1 << 42) + first
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            if start:
                rank = rank + np.array([start[x] for x in zip(n.tolist(), b.column("salt").to_numpy().tolist())], np.int64)
            i = np.searchsorted(key_of, n * (1 << 42) + rank, "right") - 1
            cols = [b.column(c) for c in PIECES.names] + [pa.array(sequence[i] + rank - first[i]), pa.array(at[i])]
            yield pa.RecordBatch.from_arrays(cols, out.names)

    alone = full.select(*PIECES.names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(run, out).unionByName(alone)
