"""Shared runs of text between collections, and nearest vectors with a shuffled control."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import byte_pairs
from quern.sources.shared import stored


def word_grams(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, pos, gram hash) of every k-word window."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    # a word is hashed once; windows are of hashes
    rows = df.select(key, F.transform(words, lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= k)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.xxhash64(F.slice("w", i, k)))
    return rows.select(key, F.posexplode(grams).alias("pos", "gram"))


def gram_overlap(a: DataFrame, a_key: str, b: DataFrame, b_key: str, text: str, k: int = 8) -> DataFrame:
    """Distinct shared k-grams of each pair, and the share of b's that they are. b is the smaller collection."""
    right = word_grams(b, b_key, text, k).select(b_key, "gram").distinct()
    size = right.groupBy(b_key).agg(F.count("*").alias("item_kgrams"))
    left = word_grams(a, a_key, text, k).select(a_key, "gram").join(right.select("gram").distinct(), "gram", "left_semi").distinct()
    pairs = left.join(right, "gram").groupBy(a_key, b_key).agg(F.count("*").alias("shared_kgrams"))
    return pairs.join(size, b_key).withColumn("containment", F.round(F.col("shared_kgrams") / F.col("item_kgrams"), 6))


def longest_shared(a: DataFrame, a_key: str, b: DataFrame, b_key: str, text: str, k: int = 8) -> DataFrame:
    """Longest run of words that a pair shares (at least k): matches on one diagonal, consecutive, are one run."""
    right = word_grams(b, b_key, text, k).withColumnRenamed("pos", "q")
    hits = word_grams(a, a_key, text, k).join(right, "gram").withColumn("d", F.col("pos") - F.col("q"))
    w = Window.partitionBy(a_key, b_key, "d").orderBy("pos")
    run = hits.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy(a_key, b_key, "d", "g").agg(F.count("*").alias("n"))
    return run.groupBy(a_key, b_key).agg((F.max("n") + (k - 1)).alias("longest_words"), F.count("*").alias("regions"))


#: Queries that travel with the tasks at once; more go in several blocks, each met by all rows. Rows of one numpy step, pairs of a task.
QUERY_BLOCK, STEP, TASK_PAIRS = 10_000, 4096, 20_000_000


def _places(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(values by place and row, which of them are known, lengths) of a column of lists. None: all are known."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    d = int(size.max()) if len(size) else 0
    if not flat.null_count and (size == d).all():
        return np.ascontiguousarray(values.reshape(len(size), d).T), None, size
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    table, known = np.zeros((d, len(size))), np.zeros((d, len(size)), bool)
    table[place, row], known[place, row] = values, flat.is_valid().to_numpy(zero_copy_only=False)
    return table, known, size


def _distances(q: np.ndarray, known: np.ndarray | None, size: int, rows: np.ndarray, there: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """(mean absolute differences of a query to rows, which of them exist): summed place by place in order, over the places known on both sides."""
    d = min(len(q), len(rows))
    total, step = np.zeros(rows.shape[1]), np.empty(rows.shape[1])
    if known is None and there is None and len(q) == len(rows) and d:
        for k in range(d):
            np.subtract(rows[k], q[k], out=step)
            np.abs(step, out=step)
            np.add(total, step, out=total)
        return total / size, None
    exist = np.zeros(rows.shape[1], bool)
    for k in range(d):
        if known is None or known[k]:
            on = np.ones(len(step), bool) if there is None else there[k]
            total[on] += np.abs(rows[k][on] - q[k])
            exist |= on
    return total / max(size, 1), exist


class Nearest:
    """Of one query: the distances that can be the least when rounded to six places, each with its least key."""

    fields, schema = ("neighbour", "mad"), "neighbour long, mad double"

    def __init__(self):
        self.key, self.mad, self.other = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, keys: np.ndarray, cols: list[tuple[np.ndarray, np.ndarray | None]]) -> None:
        mad, exist = cols[0]
        if exist is not None:
            if not exist.all():
                least = int(keys[~exist].min())
                self.other = least if self.other is None else min(self.other, least)
            keys, mad = keys[exist], mad[exist]
        if not len(mad):
            return
        low = np.fmin(np.fmin.reduce(mad), self.mad[0] if len(self.mad) else np.nan)
        at = np.flatnonzero(mad <= low + 1.001e-6) if low == low else np.arange(len(mad))
        if len(at):
            key, mad = np.append(self.key, keys[at]), np.append(self.mad, mad[at])
            order = np.lexsort((key, mad))
            key, mad = key[order], mad[order]
            # a greater distance counts only with a smaller key than all before it
            keep = np.append(True, key[1:] < np.minimum.accumulate(key)[:-1]) & ~(mad > low + 1.001e-6)
            self.key, self.mad = key[keep], mad[keep]

    def rows(self) -> list[tuple]:
        return [*zip(self.key.tolist(), self.mad.tolist()), *([] if self.other is None else [(self.other, None)])]


class Least:
    """Of one query: the least distance to each of two columns."""

    fields, schema = ("m", "s"), "m double, s double"

    def __init__(self):
        self.low, self.met = [None, None], False

    def add(self, keys: np.ndarray, cols: list[tuple[np.ndarray, np.ndarray | None]]) -> None:
        self.met |= len(keys) > 0
        for i, (mad, exist) in enumerate(cols):
            mad = mad if exist is None else mad[exist]
            if len(mad):
                low = float(np.fmin.reduce(mad))
                self.low[i] = low if self.low[i] is None else float(np.fmin(low, self.low[i]))

    def rows(self) -> list[tuple]:
        return [tuple(self.low)] if self.met else []


def _scan(block: pa.Table, vectors: list[str], keep: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What `keep` keeps of a block of queries (query, qv) against a task's rows (key, vectors). No pair is ever a row."""
    names = block.column("query").to_numpy()
    q, known, size = _places(block.column("qv"))
    q, known = np.ascontiguousarray(q.T), None if known is None else np.ascontiguousarray(known.T)

    def run(batches):
        best = [keep() for _ in names]
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                keys, cols = part.column("key").to_numpy(), [_places(part.column(v)) for v in vectors]
                for i, name in enumerate(names.tolist()):
                    got = [_distances(q[i], None if known is None else known[i], int(size[i]), rows, there) for rows, there, _ in cols]
                    other = keys != name
                    if other.all():
                        best[i].add(keys, got)
                    else:
                        best[i].add(keys[other], [(d[other], None if e is None else e[other]) for d, e in got])
        rows = [(n, *r) for n, x in zip(names.tolist(), best) for r in x.rows()]
        types = [pa.int64(), *(pa.float64() if f != "neighbour" else pa.int64() for f in keep.fields)]
        for lo in range(0, len(rows), STEP):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + STEP]), types)], ["query", *keep.fields])

    return run


def against_all(queries: DataFrame, rows: DataFrame, key: str, vector: str, others: list[str], keep: type, best: Callable[[DataFrame], DataFrame], most: int = QUERY_BLOCK) -> DataFrame:
    """`best` of what `keep` keeps of a stated query set against all other rows, in blocks of about `most` queries; keys are whole numbers.

    Every pair is measured, in the tasks that read the rows: a task holds one step of rows and a block of queries, and returns a few rows a query."""
    q = queries.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query"), F.col(vector).alias("qv"))
    r = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), vector, *others)
    n = q.count()
    parts = max(1, -(-n // most))
    tasks = -(-r.count() * min(n, most) // TASK_PAIRS)
    if tasks > 1:
        r = r.repartition(tasks)
    done = []
    for i in range(parts):
        block = (q.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == i) if parts > 1 else q).toArrow()
        out = best(r.mapInArrow(_scan(block, [vector, *others], keep), f"query long, {keep.schema}"))
        done.append(stored(out, "nearest") if parts > 1 else out)
    kind = dict(rows.dtypes)[key]
    out = reduce(DataFrame.unionByName, done)
    return out.select(*[F.col(c).cast(kind).alias(c) if c in ("query", "neighbour") else c for c in out.columns])


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Best neighbour of each query among all rows by the mean absolute difference to six places, then by key. Unknown distances come last."""

    def best(kept):
        mad = F.round("mad", 6)
        low = F.min(F.struct(mad.isNull().alias("no"), mad.alias("mad"), "neighbour")).alias("b")
        return kept.groupBy("query").agg(low).select("query", F.col("b.neighbour").alias("neighbour"), F.col("b.mad").alias("mad"))

    return against_all(queries, rows, key, vector, [], Nearest, best)


def _regions(a: DataFrame, a_key: str, right: DataFrame, b_key: str, text: str, k: int) -> DataFrame:
    hits = word_grams(a, a_key, text, k).join(right, "gram").withColumn("d", F.col("pos") - F.col("q"))
    w = Window.partitionBy(a_key, b_key, "d").orderBy("pos")
    run = hits.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy(a_key, b_key, "d", "g").agg(F.min("pos").cast("long").alias("doc_start"), F.count("*").alias("n"))
    return run.select(a_key, b_key, "doc_start", (F.col("doc_start") - F.col("d")).alias("item_start"), (F.col("n") + (k - 1)).alias("words"))


def shared_regions(a: DataFrame, a_key: str, b: DataFrame, b_key: str, text: str, k: int = 8) -> DataFrame:
    """Every maximal run of at least k words that a pair shares: its places in both texts (from 0) and its words."""
    return _regions(a, a_key, word_grams(b, b_key, text, k).withColumnRenamed("pos", "q"), b_key, text, k)


def novel_runs(a: DataFrame, a_key: str, b: DataFrame, b_key: str, known: DataFrame, known_key: str, text: str, k: int = 8) -> DataFrame:
    """Shared runs by content, each once, with the pairs and the texts of a that have it. Grams of `known` break runs.

    b is the smaller collection: its grams alone are looked up in `known`, before they meet a. Null and short texts have no grams."""
    grams = word_grams(b, b_key, text, k).withColumnRenamed("pos", "q")
    seen = word_grams(known, known_key, text, k).select("gram").join(grams.select("gram").distinct(), "gram", "left_semi").distinct()
    regions = _regions(a, a_key, grams.join(seen, "gram", "left_anti"), b_key, text, k)
    words = b.select(b_key, F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ").alias("w"))
    run = F.array_join(F.slice("w", (F.col("item_start") + 1).cast("int"), F.col("words").cast("int")), " ")
    placed = regions.join(words, b_key).select(a_key, b_key, "words", F.sha1(F.encode(run, "UTF-8")).alias("run_sha1"))
    return placed.groupBy("run_sha1", "words").agg(F.count("*").alias("places"), F.count_distinct(a_key).alias("texts"))


def byte_diffs(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, at, length) of every island of differing bytes of two strings laid side by side; the rest of the longer differs.

    Each row is worked on where it lies, in time linear in its bytes. Null counts as empty; equal strings give no row."""
    pairs = lambda c: byte_pairs(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))
    rows = df.select(key, F.zip_with(pairs(a), pairs(b), lambda p, q: ~p.eqNullSafe(q)).alias("d"))
    no = F.lit(False)

    def edges(beside):
        flags = F.zip_with("d", beside, lambda x, y: F.coalesce(x, no) & ~F.coalesce(y, no))
        return F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())

    starts, ends = edges(F.concat(F.array(no), "d")), edges(F.slice("d", F.lit(2), F.size("d")))
    islands = rows.select(key, F.explode(F.zip_with(starts, ends, lambda s, e: F.struct(s.cast("long").alias("at"), (e - s + 1).cast("long").alias("length")))).alias("i"))
    return islands.select(key, "i.at", "i.length")


def separation(queries: DataFrame, rows: DataFrame, key: str, vector: str, least: float = 1.5, order: list[int] | None = None) -> DataFrame:
    """Best distance of each query beside its best distance to the same rows with their places reversed, or in `order`, and the factor between them."""
    control = F.reverse(vector) if order is None else F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.get(vector, i))

    def best(kept):
        low = kept.groupBy("query").agg(F.min("m").alias("m"), F.min("s").alias("s"))
        # an exact copy leaves no finite factor
        factor = F.when(F.col("m") == 0, F.when(F.col("s") == 0, F.lit(float("nan"))).otherwise(F.col("s") + F.lit(float("inf")))).otherwise(F.try_divide("s", "m"))
        return low.select("query", F.round("m", 6).alias("mad"), F.round("s", 6).alias("control"), F.round(factor, 4).alias("factor"), (F.col("s") >= least * F.col("m")).alias("separates"))

    return against_all(queries, rows.select(key, vector, control.alias("_control")), key, vector, ["_control"], Least, best)
