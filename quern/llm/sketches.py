"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the k smallest distinct 64-bit shingle hashes, so the sketch of a union is the k smallest of two sketches.
Text form: base64 of the little-endian hashes in ascending order; the empty text's is ''. Equal texts have equal sketches.
Defined results: null text counts as empty; two empty sketches have likeness 1, an empty and a non-empty one 0; equal keys
and null ones (first) are ordered by text; repeated rows are each other's next; a one-row table is its own next document; texts of
any length are read whole; extra columns are not read, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import shingles, slices, small_batches, span_hash, text_buffers, words_of

#: Hashes that a sketch keeps: the standard error of a resemblance is at most 0.5 / sqrt(K).
K = 128


def sketches(col: pa.Array, k: int = K, width: int = 5) -> list[np.ndarray]:
    """The bottom-k sketch of every text."""
    data, off = text_buffers(col)
    starts, ends, doc = words_of(data, off)
    n = len(off) - 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    s, d = shingles(span_hash(data, starts, ends), doc, n, width)
    cut = np.searchsorted(d, np.arange(n + 1))
    out = []
    for i in range(n):
        x = s[cut[i] : cut[i + 1]]
        if len(x) > 8 * k:
            few = np.unique(np.partition(x, 4 * k)[: 4 * k])
            x = few if len(few) >= k else np.unique(x)
        else:
            x = np.unique(x)
        out.append(x[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the share of the union's bottom-k that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    new = np.append(True, ~twice)
    cut = np.searchsorted(np.cumsum(new), k, "right")  # entries of the k smallest distinct values
    return float(np.count_nonzero(twice[: max(cut - 1, 0)])) / min(k, int(np.count_nonzero(new)))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated distinct shingles; exact while the sketch isn't full."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    j, u = resemblance(a, b, k), distinct_count(merge(a, b, k), k)
    return min(1.0, j * u / max(distinct_count(a, k), 1.0))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decode(s: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s or ""), "<u8").astype(np.uint64)


def edited(text: str, other: str) -> str:
    """The last half (rounded down) of text replaced by as many first code points of other, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


NAMES = [c.split(" ")[0] for c in OUT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Ranges at most: the driver holds two numbers a range.
MOST_RANGES = 20_000


def _rows(ids: list, texts: list[str], nexts: list[str], own: list[np.ndarray], following: list[np.ndarray], k: int) -> dict:
    new = [edited(t, n) for t, n in zip(texts, nexts)]
    sk = []
    lo = size = 0
    for i, t in enumerate(new):
        size += len(t)
        if size > 2_000_000 or i == len(new) - 1:
            sk += sketches(pa.array(new[lo : i + 1], pa.string()), k)
            lo, size = i + 1, 0
    return {
        "doc_id": ids, "n_chars": [len(t) for t in texts], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new], "fingerprint": [encode(x) for x in own],
        "edited_fingerprint": [encode(x) for x in sk], "near_edited": [resemblance(a, b, k) for a, b in zip(own, sk)], "near_next": [resemblance(a, b, k) for a, b in zip(own, following)],
    }


def fingerprints(docs: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """docs with column `fingerprint`, one map, no shuffle."""
    from pyspark.sql.types import StringType, StructField

    from quern.llm.batches import add_columns

    return add_columns(docs, text, lambda: lambda col: [pa.array([encode(x) for x in sketches(col, k)], pa.string())], [StructField("fingerprint", StringType())])


def neighbour_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, bytes_per_range: int = 16 << 20, least_bytes: int = 1 << 20) -> DataFrame:
    """Every text against its edited text and against the next text by key.

    Keys are cut into ranges at approximate quantiles. The first row of each range is copied to the range before it (the
    very first to the last) as a sentinel, so one shuffle of the texts puts every row beside its successor; a task streams
    its ranges in order and holds one row back. On the driver are only the ranges' bounds and least keys. Skew can't gather:
    ranges are cut by key, and keys hardly repeat."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = small_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(MOST_RANGES, max(-(-total // bytes_per_range), min(4 * spark.sparkContext.defaultParallelism, -(-total // least_bytes)))))
    order = rows.withColumn("_at", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("double"))
    marks = order.agg(F.percentile_approx("_at", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = [-float("inf"), *sorted(set(marks or [])), float("inf")]
    if len(cuts) > 2:
        ranged = Bucketizer(splits=cuts, inputCol="_at", outputCol="_range").transform(order).withColumn("_range", F.col("_range").cast("int"))
    else:
        ranged = order.withColumn("_range", F.lit(0))
    least = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.min("_at")).collect()}
    filled = sorted(least)
    before = dict(zip(filled, filled[-1:] + filled[:-1]))
    ranged = ranged.withColumn("_sentinel", F.lit(False))
    if filled:
        firsts = spark.createDataFrame([(least[r], r, before[r]) for r in filled], "_at double, _range int, _to int")
        heads = ranged.join(F.broadcast(firsts), ["_at", "_range"]).groupBy("_to").agg(F.min(F.struct("doc_id", "text")).alias("_head"))
        heads = heads.select(F.col("_head.doc_id").alias("doc_id"), F.col("_head.text").alias("text"), F.col("_to").alias("_range"), F.lit(True).alias("_sentinel"))
        ranged = ranged.select("doc_id", "text", "_range", "_sentinel").unionByName(heads)
    else:
        ranged = ranged.select("doc_id", "text", "_range", "_sentinel")

    def run(batches):
        back = None  # (range, id, text, sketch) of the row not yet paired
        for b in batches:
            for s in slices(b, "text"):
                cols = [s.column(c).to_pylist() for c in ("_range", "_sentinel", "doc_id", "text")] + [sketches(s.column("text"), k)]
                if back is not None:
                    cols = [[x, *c] for x, c in zip(back, cols)]
                r, last, ids, texts, own = cols
                pairs = [i for i in range(len(ids) - 1) if r[i] == r[i + 1] and not last[i]]
                if pairs:
                    got = _rows([ids[i] for i in pairs], [texts[i] for i in pairs], [texts[i + 1] for i in pairs], [own[i] for i in pairs], [own[i + 1] for i in pairs], k)
                    yield pa.RecordBatch.from_arrays([pa.array(got[c], t) for c, t in zip(NAMES, TYPES)], NAMES)
                back = [c[-1] for c in cols]

    # a range is a partition of its own
    return ranged.repartitionById(max([0, *filled]) + 1, F.col("_range")).sortWithinPartitions("_range", "_sentinel", "doc_id", "text").mapInArrow(run, OUT)
