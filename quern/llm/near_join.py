"""N-gram Jaccard join: MinHash banding, then exact verification on full sets of word n-grams.

1. Texts with equal n-gram sets form a class; its least key represents it, and only representatives go on.
2. Band and row counts follow from the target recall at the threshold. Bands shuffle on their hash; buckets of one are dropped.
3. A bucket is streamed in the order of the keys' hashes, so that buckets share leaders, against its leaders, not in all pairs: a member joins each leader it resembles by
   signature (estimate over LOOSE) and becomes a leader if it follows none (estimate over TIGHT). Large buckets are salted,
   and their leaders meet in a second pass. This yields candidate components. They hold the linked pairs: of two members the
   later one meets the leader that the earlier one follows, and distances 1 - J add up, so a pair at 0.8 whose first text is
   within 0.2 of its leader has its second within 0.4 (J 0.6). What can be lost are pairs whose estimates stray far to the wrong
   side in every one of the buckets they share.
4. Components get the full n-gram sets of their texts and count every pair at or over the threshold by products of 0/1
   matrices, in blocks of bounded size, so a component of any size is spread over tasks. Links come out as counts and as
   spanning edges, never as all pairs; components of the verified edges are the result's classes.

Defined results: null text counts as empty; texts without a word are copies of each other; repeated rows are copies; a null
key is less than any other; rows that share a key, null or not, are joined each by its own text; extra columns are not read; an
empty table gives an empty result."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import U, discard, mix, shingles, slices, small_batches, span_hash, stored, text_buffers, words_of

#: Signature estimates at which a text follows a leader, and at which it is connected to one.
TIGHT, LOOSE, MEET = 0.8, 0.45, 0.1
#: Members of a bucket that one task streams, and texts and n-grams of a block of exact verification.
SUB_BUCKET, BLOCK, BLOCK_GRAMS = 1024, 512, 2_000_000
#: Parts into which labels and groups are dealt where many rows ask for one of them.
SALTS = 16
NO_KEY = -(1 << 63)


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    @property
    def size(self) -> int:
        return self.bands * self.rows


def choose_bands(threshold: float, recall: float = 0.9999, most: int = 128) -> Banding:
    """The most rows a band, and for them the fewest bands, that find a pair at the threshold with at least this probability."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = Banding(bands, rows)
    if best is None:
        raise ValueError("no banding of so few hashes reaches the recall")
    return best


def grams_of(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(distinct n-gram hash, text) sorted by text and hash."""
    data, off = text_buffers(col)
    starts, ends, doc = words_of(data, off)
    n = len(off) - 1
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64), n
    s, d = shingles(span_hash(data, starts, ends), doc, n, width)
    o = np.lexsort((s, d))
    s, d = s[o], d[o]
    new = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))
    return s[new], d[new], n


def signatures(s: np.ndarray, d: np.ndarray, n: int, size: int) -> np.ndarray:
    """(n, size) 32-bit MinHash values; texts without n-grams have all ones."""
    out = np.full((n, size), 0xFFFFFFFF, np.uint32)
    if len(s):
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        who = d[first]
        x = (s >> U(32)).astype(np.uint32) ^ s.astype(np.uint32)
        rng = np.random.default_rng(20)
        a = rng.integers(0, 1 << 32, size, np.uint32) | np.uint32(1)
        b = rng.integers(0, 1 << 32, size, np.uint32)
        for j in range(size):
            y = (x ^ b[j]) * a[j]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[who, j] = np.minimum.reduceat(y, first)
    return out


def _classes(rows: DataFrame, width: int, banding: Banding) -> DataFrame:
    rows = small_batches(rows.select("id", "text"))

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                s, d, n = grams_of(part.column("text"), width)
                sig = signatures(s, d, n, banding.size)
                first = np.searchsorted(d, np.arange(n + 1))
                pad = np.append(np.cumsum(mix(s)), U(0)) if len(s) else np.zeros(1, U)
                pad2 = np.append(np.cumsum(mix(s ^ U(0x5851F42D4C957F2D))), U(0)) if len(s) else np.zeros(1, U)
                sums = [np.where(first[1:] > 0, p[first[1:] - 1], U(0)) - np.where(first[:-1] > 0, p[first[:-1] - 1], U(0)) for p in (pad, pad2)]
                keys = np.zeros((n, banding.bands), U)
                for j in range(banding.bands):
                    k = np.full(n, U(j + 1))
                    for i in range(banding.rows):
                        k = mix(k ^ sig[:, j * banding.rows + i].astype(U))
                    keys[:, j] = k
                off = pa.array(np.arange(0, n * banding.bands + 1, banding.bands), pa.int32())
                short = (sig & np.uint32(0xFFFF)).astype("<u2")
                cols = [part.column("id"), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(np.diff(first)), pa.ListArray.from_arrays(off, pa.array(keys.reshape(-1).view(np.int64))), pa.array([r.tobytes() for r in short], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "set1", "set2", "grams", "keys", "sig"])

    return rows.mapInArrow(run, "id long, set1 long, set2 long, grams long, keys array<long>, sig binary")


class Leaders:
    """Leaders of one bucket, and which of them are connected: a bucket yields a spanning forest, fewer edges than members."""

    def __init__(self):
        self.ids: list[int] = []
        self.sigs: list[np.ndarray] = []
        self.above: list[int] = []

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def stream(self, sigs: np.ndarray, ids: np.ndarray, tight: float, loose: float, out: list) -> None:
        """Members against all leaders. A member joins each leader over loose, by an edge if that connects anything new; one that
        no leader over tight follows becomes a leader, met by all."""
        size = sigs.shape[1]
        free = np.ones(len(ids), bool)
        linked = np.full(len(ids), -1)

        def meet(n: int) -> None:
            same = (sigs == self.sigs[n]).sum(1)
            close = np.flatnonzero((same >= loose * size) & (ids != self.ids[n]))
            new = close[linked[close] < 0]
            out.extend((int(i), self.ids[n]) for i in ids[new].tolist())
            linked[new] = n
            old, at = np.unique(linked[close], return_index=True)
            for leader, where in zip(old.tolist(), at.tolist()):
                a, b = self.root(leader), self.root(n)
                if a != b:
                    self.above[a] = b
                    out.append((int(ids[close[where]]), self.ids[n]))
            free[same >= tight * size] = False

        for n in range(len(self.ids)):
            meet(n)
        while free.any():
            i = int(free.argmax())
            free[i] = False
            n = len(self.ids)
            self.ids.append(int(ids[i]))
            self.sigs.append(sigs[i].copy())
            self.above.append(n if linked[i] < 0 else self.root(int(linked[i])))
            meet(n)


def _bucket_edges(rows: DataFrame, size: int, tight: float, loose: float, leaders_too: bool) -> DataFrame:
    """rows: bucket, salt, salts, id, sig, sorted and kept together by (bucket, salt). Edges, and of salted buckets the leaders."""

    def run(batches):
        now, leaders, out, led = None, Leaders(), [], []

        def flush(force):
            if out and (force or len(out) > 20_000):
                a = np.array(out, np.int64)
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1]), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], ["a", "b", "bucket", "sig"])
            if led and (force or len(led) > 5_000):
                rowsl = list(led)
                led.clear()
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rowsl], pa.int64()), pa.nulls(len(rowsl), pa.int64()), pa.array([r[1] for r in rowsl], pa.int64()), pa.array([r[2] for r in rowsl], pa.binary())], ["a", "b", "bucket", "sig"])

        def close():
            if now is not None and now[2] > 1 and leaders_too:
                led.extend((lid, now[0], ls.tobytes()) for lid, ls in zip(leaders.ids, leaders.sigs))

        for b in batches:
            if not b.num_rows:
                continue
            bucket, salt, salts, ids = (b.column(c).to_numpy() for c in ("bucket", "salt", "salts", "id"))
            data, _ = text_buffers(b.column("sig"))
            sigs = data.view("<u2").reshape(len(ids), size)
            cut = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])))
            for lo, hi in zip(cut, np.append(cut[1:], len(ids))):
                k = (int(bucket[lo]), int(salt[lo]), int(salts[lo]))
                if k != now:
                    close()
                    now, leaders = k, Leaders()
                leaders.stream(sigs[lo:hi], ids[lo:hi], tight, loose, out)
                yield from flush(False)
        close()
        yield from flush(True)

    return rows.mapInArrow(run, "a long, b long, bucket long, sig binary")


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of edges (a, b): label is the least id of its component.

    Least-label steps with pointer jumping; every round is a table in the shared folder. Rounds grow with the logarithm of
    the longest chain. Labels are joined by key, and a hub's messages are pre-aggregated, so no node gathers its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        told = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.select("id", "label").join(told, "id").select("id", "label", F.least("label", "near").alias("new"))
        # many nodes ask for the label of one: those asked for are few, and are dealt to every salt
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far")).join(step.select("new").distinct(), "new", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        step = step.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        nxt = stored(step.join(jump, ["new", "salt"]).select("id", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("moved")), "labels")
        discard(labels)
        labels, done = nxt, nxt.where("moved").limit(1).count() == 0
        if done:
            discard(both)
            return labels


def block_links(sets: list[np.ndarray], others: list[np.ndarray] | None, threshold: float, most: int = 4096) -> np.ndarray:
    """Boolean matrix: which of sets and others (or sets among themselves) have Jaccard similarity at or over the threshold."""
    m = len(sets)
    every = sets + (others or [])
    size = np.array([len(x) for x in every], np.int64)
    of = np.repeat(np.arange(len(every)), size)
    gram = np.concatenate(every) if len(of) else np.zeros(0, U)
    _, col, count = np.unique(gram, return_inverse=True, return_counts=True)
    ok = count[col] > 1
    shared = np.cumsum(count > 1) - 1
    col, of = shared[col[ok]], of[ok]
    o = np.argsort(col, kind="stable")
    col, of = col[o], of[o]
    right = slice(m, None) if others is not None else slice(None)
    both = np.zeros((m, len(every[right])), np.float32)
    width = max(64, min(most, 32_000_000 // max(1, len(every))))
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        x = np.zeros((len(every), min(width, int(col[-1]) + 1 - lo)), np.float32)
        x[of[i:j], col[i:j] - lo] = 1
        both += x[:m] @ x[right].T
    total = size[:m, None] + size[right][None]
    link = both * (1 + threshold) >= threshold * total - 1e-6
    link &= total > 0
    return link


def _verify(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: task, side (0 or 1), id, copies, sets (binary of sorted hashes), alone (one block holds the component), sorted by task.

    Per text: links counted here, weighted by copies, and an edge to its local root."""

    def run(batches):
        def work(k, ids, side, copies, sets, alone):
            order = np.argsort(ids, kind="stable")
            ids, side, copies = ids[order], side[order], copies[order]
            sets = [sets[i] for i in order]
            left = np.flatnonzero(side == 0)
            r = np.flatnonzero(side == 1)
            if len(r):
                link = block_links([sets[i] for i in left], [sets[i] for i in r], threshold)
                n = np.zeros(len(ids), np.int64)
                n[left] = link @ copies[r]
                n[r] = link.T @ copies[left]
                full = np.zeros((len(ids), len(ids)), bool)
                full[np.ix_(left, r)] = link
                full[np.ix_(r, left)] = link.T
            else:
                full = block_links(sets, None, threshold)
                np.fill_diagonal(full, False)
                n = full @ copies
            root = np.full(len(ids), -1)
            for i in range(len(ids)):
                if root[i] < 0:
                    root[i], edge = i, np.array([i])
                    while len(edge):
                        new = full[edge].any(0) & (root < 0)
                        root[new] = i
                        edge = np.flatnonzero(new)
            return ids, n.astype(np.int64), ids[root], np.full(len(ids), alone)

        now, held = None, []

        def close():
            ids = np.concatenate([h[0] for h in held])
            got = work(now, ids, *(np.concatenate([h[j] for h in held]) for j in (1, 2)), [s for h in held for s in h[3]], bool(held[0][4]))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["id", "links", "root", "alone"])

        for b in batches:
            if not b.num_rows:
                continue
            task = b.column("task").to_numpy()
            data, off = text_buffers(b.column("sets"))
            cols = [b.column(c).to_numpy() for c in ("id", "side", "copies")]
            alone = b.column("alone").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            for lo, hi in zip(cut, np.append(cut[1:], len(task))):
                if now is not None and now != task[lo]:
                    yield close()
                    held = []
                now = task[lo]
                held.append((*(c[lo:hi] for c in cols), [data[off[i] : off[i + 1]].copy().view("<u8") for i in range(lo, hi)], alone[lo]))
        if held:
            yield close()

    return rows.mapInArrow(run, "id long, links long, root long, alone boolean")


def _key(key: str):
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))


def _row(key: str, text: str):
    """Identity of a row where keys repeat: rows with one key and one text share it, others don't."""
    return F.xxhash64(_key(key), F.coalesce(F.col(text), F.lit("")))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row a document: doc_id, class_id (least key of its linked group), copy_of (least key with the same n-grams), n_links.

    n_links counts the other documents, copies included, whose Jaccard similarity is at or over the threshold. Options as of _near."""
    back = lambda c: F.when(F.col(c) != NO_KEY, F.col(c))
    if not _repeats(docs, key):
        got = _near(docs.select(_key(key).alias("id"), F.col(text).alias("text")), False, **options)
        return got.select(back("id").alias("doc_id"), back("class").alias("class_id"), back("copy").alias("copy_of"), "n_links")
    got, names = _by_row(docs, key, text, **options)
    each = got.select("id", "class", "copy").distinct().join(names, "id")
    got = got.join(names, "id").join(each.groupBy("class").agg(F.min("key").alias("class_id")), "class").join(each.groupBy("copy").agg(F.min("key").alias("copy_of")), "copy")
    return got.select(back("key").alias("doc_id"), back("class_id").alias("class_id"), back("copy_of").alias("copy_of"), "n_links")


def _by_row(docs: DataFrame, key: str, text: str, **options) -> tuple[DataFrame, DataFrame]:
    """_near's result on row identities, and the key of each identity."""
    got = _near(docs.select(_row(key, text).alias("id"), F.col(text).alias("text")), True, **options)
    return stored(got, "near-rows"), docs.select(_row(key, text).alias("id"), _key(key).alias("key")).distinct()


def _near(docs: DataFrame, repeats: bool, width: int = 5, threshold: float = 0.8, recall: float = 0.9999, sub_bucket: int = SUB_BUCKET, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(id, class, copy, n_links) of every row of docs (id, text): least id of its linked group, and of those with the same n-grams. repeats: ids may, with equal texts."""
    spark = docs.sparkSession
    banding = choose_bands(threshold, recall)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    all_ = stored(_classes(docs, width, banding), "near-classes")
    groups = all_.groupBy("set1", "set2", "grams").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    groups = stored(groups, "near-groups")
    reps = all_.join(groups.where("grams > 0").select(F.col("rep").alias("id"), "set1", "set2", "grams", "copies"), ["id", "set1", "set2", "grams"]).dropDuplicates(["id"])
    reps = stored(reps.select("id", "copies", "grams", "keys", "sig"), "near-reps")
    keyed = reps.select("id", F.explode("keys").alias("bucket"))
    busy = keyed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    rows = keyed.join(busy, "bucket").withColumn("salts", F.ceil(F.col("m") / sub_bucket).cast("long")).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    rows = rows.join(reps.select("id", "sig"), "id").select("bucket", "salt", "salts", "id", "sig", F.xxhash64("id").alias("order"))
    rows = small_batches(rows).repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "order", "id")
    first = stored(_bucket_edges(rows, banding.size, TIGHT, LOOSE, True), "near-edges")
    led = first.where("bucket is not null").select("bucket", F.lit(0).cast("long").alias("salt"), F.lit(1).cast("long").alias("salts"), F.col("a").alias("id"), "sig")
    second = _bucket_edges(led.repartition(parts, "bucket").sortWithinPartitions("bucket", "id"), banding.size, TIGHT, MEET, False)
    edges = first.where("b is not null").select("a", "b").unionByName(second.where("b is not null").select("a", "b")).distinct()
    labels = connected(edges)
    discard(first)
    comp = labels.select("id", "label").join(reps.select("id", "copies", "grams"), "id")
    sizes = comp.groupBy("label").agg(F.count("*").alias("m"), F.sum("grams").alias("g")).withColumn("blocks", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("g") / block_grams)).cast("long"))
    comp = comp.join(sizes.select("label", "blocks"), "label").withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")))
    comp = stored(comp, "near-components")

    def to_sets(batches):
        for b in batches:
            for part in slices(b, "text"):
                s, d, n = grams_of(part.column("text"), width)
                first_ = np.searchsorted(d, np.arange(n + 1))
                raw = [s[first_[i] : first_[i + 1]].astype("<u8").tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("id", "label", "copies", "blocks", "block")] + [pa.array(raw, pa.binary())], ["id", "label", "copies", "blocks", "block", "sets"])

    texts = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    full = small_batches(texts.join(comp.select("id", "label", "copies", "blocks", "block"), "id")).mapInArrow(to_sets, "id long, label long, copies long, blocks long, block long, sets binary")
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    full = full.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    full = full.select(F.xxhash64("label", "low", "high").alias("task"), F.when((F.col("block") == F.col("high")) & (F.col("low") != F.col("high")), 1).otherwise(0).alias("side"), "id", "copies", "sets", (F.col("blocks") == 1).alias("alone"))
    full = full.dropDuplicates(["task", "side", "id"]) if repeats else full
    got = stored(_verify(full.repartition(parts, "task").sortWithinPartitions("task"), threshold), "near-links")
    links = got.groupBy("id").agg(F.sum("links").alias("links"))
    spread = got.where("not alone").select(F.col("id").alias("a"), F.col("root").alias("b"))
    roots = got.where("alone").select("id", F.col("root").alias("label"))
    joined = connected(spread) if spread.limit(1).count() else None
    if joined:
        roots = roots.unionByName(joined.select("id", "label"))
    result = links.join(roots, "id").select(F.col("id").alias("rep"), F.col("links"), F.col("label").alias("root"))
    # a group is joined with its result once; a text without copies is its group, and copies look theirs up dealt by a salt
    each = stored(groups.join(result, "rep", "left").select("rep", "set1", "set2", "grams", "copies", F.coalesce("root", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-result")
    discard(groups, reps, labels, comp, got, *([joined] if joined else []))
    alone = each.where("copies = 1").select(F.col("rep").alias("id"), "class", F.col("rep").alias("copy"), "n_links")
    several = each.where("copies > 1").drop("copies").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = all_.select("id", "set1", "set2", "grams").withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return rows.join(several, ["set1", "set2", "grams", "salt"]).select("id", "class", F.col("rep").alias("copy"), "n_links").unionByName(alone)


def _repeats(docs: DataFrame, key: str) -> bool:
    r = docs.agg(F.count("*").alias("n"), F.count_distinct(_key(key)).alias("d")).first()
    return r.n != r.d


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without all but one document, the least-keyed, of each linked group; same columns. Rows that only share a key all stay."""
    if not _repeats(docs, key):
        kept = _near(docs.select(_key(key).alias("id"), F.col(text).alias("text")), False, **options).where(F.col("id") == F.col("class")).select(F.col("id").alias("_kept"))
        return docs.join(kept, _key(key) == kept["_kept"], "left_semi")
    got, names = _by_row(docs, key, text, **options)
    kept = got.select("id", "class").distinct().join(names, "id").groupBy("class").agg(F.min(F.struct("key", "id")).alias("least")).select(F.col("least.id").alias("_row"))
    return docs.withColumn("_row", _row(key, text)).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
