"""Arrow-batch plumbing shared by the operators: whole texts in, columns out, no Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quern.sources.shared import discard, drop_path, scratch, small_batches, stored  # noqa: F401

#: Bytes of text that one numpy step handles; a longer text is a step of its own.
CHUNK_BYTES = 2 << 20
#: Odd multiplier of the polynomial word hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    arr = col.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose text is about `most` bytes each; at least one row."""
    if not batch.num_rows:
        return
    _, off = text_buffers(batch.column(name))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, batch.num_rows, lo + 8192)
        yield batch.slice(lo, hi - lo)
        lo = hi


def add_columns(df: DataFrame, text: str, make: Callable, fields: list[StructField], drop: tuple[str, ...] = (), most: int = CHUNK_BYTES) -> DataFrame:
    """df with columns computed from whole texts by `make()(text array) -> list of arrays`.

    Input columns named like a new one are replaced. `make` runs once per task."""
    new = {f.name for f in fields} | set(drop)
    keep = [f for f in df.schema.fields if f.name not in new]
    out = StructType(keep + fields)
    names = [f.name for f in keep]

    def run(batches):
        f, schema = make(), None
        for b in batches:
            for part in slices(b, text, most):
                cols = f(part.column(text))
                arrays = [part.column(n) for n in names] + [c if isinstance(c, pa.Array) else pa.array(c) for c in cols]
                yield pa.RecordBatch.from_arrays(arrays, [x.name for x in out.fields])

    return small_batches(df).mapInArrow(run, out)


def filter_rows(df: DataFrame, text: str, make: Callable, most: int = CHUNK_BYTES) -> DataFrame:
    """The rows of df, all columns untouched, where `make()(text array)` is true."""

    def run(batches):
        f = make()
        for b in batches:
            for part in slices(b, text, most):
                yield part.filter(pa.array(np.asarray(f(part.column(text)), bool)))

    return small_batches(df).mapInArrow(run, df.schema)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES + 4096, 1 << int(n).bit_length() if n > CHUNK_BYTES + 4096 else 0)
    if size not in _powers:
        _powers.clear()
        both = []
        for m in (BASE, INVERSE):
            a = np.full(size + 1, m, U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[size] = both
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of bytes outside `space`, never across documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ns = ~space[data]
    first, last = ns.copy(), ns.copy()
    first[1:] &= ~ns[:-1]
    last[:-1] &= ~ns[1:]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] = ns[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = ns[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands. Spans ascend; long data is read in chunks of whole spans."""
    if len(data) > 2 * CHUNK_BYTES and len(starts) > 1:
        out, lo = np.empty(len(starts), U), 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, "right")))
            a, b = int(starts[lo]), int(ends[hi - 1])
            out[lo:hi] = _span_hash(data[a:b], starts[lo:hi] - a, ends[lo:hi] - a)
            lo = hi
        return out
    return _span_hash(data, starts, ends)


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data))
    c = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(U))


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k-word shingle. A text of 1 to k-1 words has one shingle, all its words; none has none."""
    count = np.bincount(doc, minlength=n_docs)
    n = len(h)
    m = [U(pow(BASE, 3 * j + 1, 1 << 64)) for j in range(k)]
    if n >= k:
        s = np.zeros(n - k + 1, U)
        for j in range(k):
            s += h[j : n - k + 1 + j] * m[j]
        ok = doc[: n - k + 1] == doc[k - 1 :]
        s, d = mix(s[ok]), doc[: n - k + 1][ok]
    else:
        s, d = np.zeros(0, U), np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    extra, of = [], []
    for c in range(1, k):
        who = np.flatnonzero(count == c)
        if len(who):
            t = np.full(len(who), U(c), U)
            for j in range(c):
                t += h[first[who] + j] * m[j]
            extra.append(mix(t))
            of.append(who)
    if extra:
        s, d = np.concatenate([s, *extra]), np.concatenate([d, *of])
        o = np.argsort(d, kind="stable")
        s, d = s[o], d[o]
    return s, d


def split_by(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of each document's run in an array sorted by document."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


#: Parts that the keys of a sampled group are dealt to; each gives its share.
SAMPLE_SALTS = 50


def sample_ids(df: DataFrame, key: str, group: str, per_group: int, salt: int = 0) -> DataFrame:
    """At most about per_group keys of each group, the smallest by hash of each of SAMPLE_SALTS parts of the group.

    Only keys are shuffled, and no task gets more than its part of a group, of which each map task sends at most that part's share."""
    keys = df.select(key, group).distinct().withColumn("_salt", F.pmod(F.xxhash64(F.col(key), F.lit(salt + 1)), F.lit(SAMPLE_SALTS)).cast("int"))
    order = Window.partitionBy(group, "_salt").orderBy(F.xxhash64(F.col(key), F.lit(salt)), F.col(key))
    return keys.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= -(-per_group // SAMPLE_SALTS)).select(key, group)
