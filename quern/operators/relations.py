"""References, lookups, intervals and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import discard, stored


def resolve(df: DataFrame, field: str, target: DataFrame, target_key: str) -> DataFrame:
    """References of a field, distinct values, resolved references and the residue.

    Values are counted before the join, so a hot value is one row of it."""
    values = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("v")).agg(F.count("*").alias("n"))
    hit = values.join(target.select(F.col(target_key).alias("v"), F.lit(1).alias("hit")).distinct(), "v", "left")
    return hit.agg(F.lit(field).alias("field"), F.coalesce(F.sum("n"), F.lit(0)).alias("references"), F.count("*").alias("distinct_values"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("resolved")).withColumn("residue", F.col("references") - F.col("resolved"))


def discover(values: DataFrame, pools: DataFrame, threshold: float = 0.9) -> DataFrame:
    """values (field, v), pools (pool, v): the pool that holds the largest share of a field's distinct values, if at or over threshold."""
    v = values.select("field", "v").distinct()
    size = v.groupBy("field").agg(F.count("*").alias("values"))
    hits = v.join(pools.select("pool", "v").distinct(), "v").groupBy("field", "pool").agg(F.count("*").alias("matched"))
    best = hits.groupBy("field").agg(F.min(F.struct((-F.col("matched")).alias("m"), "pool")).alias("b"))
    out = best.join(size, "field").select("field", F.col("b.pool").alias("pool"), (-F.col("b.m")).alias("matched"), "values")
    return out.withColumn("share", F.round(F.col("matched") / F.col("values"), 6)).where(F.col("matched") >= threshold * F.col("values"))


def priority_lookup(df: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """First table, in order of label, that has the key: one union and one grouped minimum instead of a join a table."""
    pool = None
    for label in sorted(tables):
        t = tables[label].select(F.col(tables[label].columns[0]).alias("_k"), F.lit(label).alias("label"))
        pool = t if pool is None else pool.unionByName(t)
    return df.join(pool.groupBy("_k").agg(F.min("label").alias("label")), F.col(key) == F.col("_k"), "left").drop("_k")


def as_of(df: DataFrame, group: str, order: str, mark: str) -> DataFrame:
    """The last mark at or before each row of its group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("last_mark", F.last(mark, ignorenulls=True).over(w))


def in_intervals(points: DataFrame, point: str, intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Point-in-interval by equi-join on buckets of `width`: an interval is repeated once a bucket, a point never."""
    spread = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    hit = points.withColumn("_b", F.floor(F.col(point) / width)).join(spread, "_b")
    return hit.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_b")


def tiling(df: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Gaps, overlaps and reach of intervals over an address space."""
    w = Window.partitionBy(group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_r", F.coalesce(reach, F.col(start)))
    gap, lap = F.greatest(F.col(start) - F.col("_r"), F.lit(0)), F.greatest(F.least(F.col("_r"), F.col(end)) - F.col(start), F.lit(0))
    return marked.groupBy(group).agg(F.count("*").alias("parts"), F.sum(gap).alias("gap"), F.sum(lap).alias("overlap"), F.max(end).alias("reach"))


def first_claimant(df: DataFrame, unit: str, owner: str, precedence: str) -> DataFrame:
    """Owner of each unit by precedence, and how many claimed it."""
    return df.groupBy(unit).agg(F.min_by(owner, F.struct(precedence, owner)).alias("owner"), F.count_distinct(owner).alias("claims"))


def islands(df: DataFrame, group: str, at: str) -> DataFrame:
    """Runs of consecutive integers. A null is a run of its own.

    One sort: a run's ends are seen beside their neighbours, so no table of values or of runs is held in memory."""
    w = Window.partitionBy(group).orderBy(F.asc_nulls_first(at))
    apart = lambda x, y: F.coalesce(F.try_subtract(x, y) > 1, F.lit(True))
    before, after, none = F.lag(at).over(w), F.lead(at).over(w), F.col(at).isNull()
    starts = F.when(none, F.lag(F.lit(1)).over(w).isNull()).otherwise(apart(F.col(at), before))
    ends = F.when(none, F.lead(F.lit(1)).over(w).isNull() | after.isNotNull()).otherwise(apart(after, F.col(at)))
    edge = df.select(group, at, starts.alias("_s"), ends.alias("_e")).where("_s or _e")
    last = F.when(F.col("_e"), F.col(at)).otherwise(F.lead(at).over(w))
    runs = edge.select(group, F.col(at).alias("first"), last.alias("last"), "_s").where("_s")
    return runs.select(group, "first", "last", F.coalesce(F.col("last") - F.col("first") + 1, F.lit(1)).cast("long").alias("length"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes with successors and no predecessor."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def walks(edges: DataFrame, most: int | None = None) -> DataFrame:
    """From each root along nodes with exactly one successor, until none, several or a node of the walk again: (root, last, steps).

    With `most`, a walk also ends after so many steps."""
    same = F.col("_least").isNotNull() & (F.col("_least") == F.col("_most")) & (F.col("_n") == F.col("_known"))
    nodes = edges.where("src is not null").groupBy("src").agg(F.min("dst").alias("_least"), F.max("dst").alias("_most"), F.count("*").alias("_n"), F.count("dst").alias("_known"))
    reached = edges.where("dst is not null").select(F.col("dst").alias("src"), F.lit(True).alias("_reached")).distinct()
    nodes = stored(nodes.select("src", F.when(same, F.col("_least")).alias("dst")).join(reached, "src", "left").select("src", "dst", F.col("_reached").isNull().alias("top")), "nodes")
    only, tops = nodes.where("dst is not null").select("src", "dst"), nodes.where("top").select(F.col("src").alias("root"), F.col("dst").alias("to"))
    if most is not None:
        at = tops.select("root", F.col("root").alias("last"), F.lit(0).cast("long").alias("steps"))
        for _ in range(most):
            at = at.join(only, at["last"] == only["src"], "left").select("root", F.coalesce("dst", "last").alias("last"), (F.col("steps") + F.when(F.col("dst").isNotNull(), 1).otherwise(0)).alias("steps"))
        return at
    # roots are often most of the nodes and nothing leads to them: only the others are walked again and again, and a root joins its successor's end once
    only = nodes.where("dst is not null and not top").select("src", "dst")
    ends, turning = _ends(only)
    if not turning:
        return _from_tops(tops, ends)
    ring = _rings(ends, only)
    ends, _ = _ends(only.join(ring.select(F.col("entry").alias("src")), "src", "left_anti"))
    out = _from_tops(tops, ends).withColumnRenamed("last", "entry")
    return out.join(ring, "entry", "left").select("root", F.coalesce("before", "entry").alias("last"), (F.col("steps") + F.coalesce(F.col("length") - 1, F.lit(0))).cast("long").alias("steps"))


def _from_tops(tops: DataFrame, ends: DataFrame) -> DataFrame:
    """(root, last, steps) of roots (root, to) whose successor's end, if it has one of its own, is in ends."""
    first = F.when(F.col("to").isNull(), 0).otherwise(1)
    found = tops.join(ends.select(F.col("src").alias("to"), "last", "steps"), "to", "left")
    return found.select("root", F.coalesce("last", "to", "root").alias("last"), (first + F.coalesce("steps", F.lit(0))).cast("long").alias("steps"))


def _doubled(at: DataFrame) -> DataFrame:
    """Each row of at (src, last, steps) taken on by its last node's own row; `moved` if there is one."""
    on = at.select(F.col("src").alias("last"), F.col("last").alias("far"), F.col("steps").alias("more"))
    return stored(at.join(on, "last", "left").select("src", F.coalesce("far", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved")), "walks")


def _ends(only: DataFrame) -> tuple[DataFrame, int]:
    """(src, last, steps, moved) by pointer doubling, and how many rows run into a cycle: those, and only those, still move.

    While a row moves that has an end, one has its end a step beyond the last leap and stops next, so an unchanged count means that none is left."""
    at, before = stored(only.select("src", F.col("dst").alias("last"), F.lit(1).cast("long").alias("steps")), "walks"), None
    while True:
        done, at = at, _doubled(at.select("src", "last", "steps"))
        discard(done)
        moved = at.where("moved").count()
        if moved in (0, before):
            return at, moved
        before = moved


def _rings(ends: DataFrame, only: DataFrame) -> DataFrame:
    """(entry, before, length) of the nodes on cycles: before is the one whose successor is entry."""
    at = ends.where("moved").select("src", "last", "steps")
    while True:
        # leaps over the longest tail end on cycles, whose successors are as many again
        held = stored(at.select(F.col("last").alias("src")).distinct().join(only, "src"), "rings")
        if held.select("dst").distinct().count() == held.count():
            break
        at = _doubled(at).select("src", "last", "steps")
    near = stored(held.select("src", F.col("dst").alias("at"), F.least("src", "dst").alias("least")), "rings")
    while True:
        # the least node of ever longer stretches, until it is the cycle's
        on = near.select(F.col("src").alias("at"), F.col("at").alias("far"), F.col("least").alias("other"))
        step = stored(near.join(on, "at").select("src", F.col("far").alias("at"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("fell")), "rings")
        near = step.select("src", "at", "least")
        if not step.where("fell").limit(1).count():
            break
    size = near.groupBy("least").agg(F.count("*").alias("length"))
    return stored(held.join(near.join(size, "least").select("src", "length"), "src").select(F.col("dst").alias("entry"), F.col("src").alias("before"), "length"), "rings")


def ambiguous(df: DataFrame, name: str, home: str) -> DataFrame:
    """Names that live in more than one home."""
    return df.groupBy(F.col(name).alias("name")).agg(F.count_distinct(home).alias("homes"), F.count("*").alias("n")).where("homes > 1")


def folded(path):
    """A path as a case-blind file system sees it."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def resolve_folded(links: DataFrame, field: str, weight: str, target: DataFrame, key: str) -> DataFrame:
    """Case-blind references (with counts) found and not found among the targets."""
    known = target.where(F.col(key).isNotNull()).select(folded(F.col(key)).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    by = links.groupBy(folded(F.col(field)).alias("_k")).agg(F.sum(weight).alias("_n"))
    return by.join(known, "_k", "left").groupBy(F.coalesce("_hit", F.lit(False)).alias("resolved")).agg(F.count("*").alias("targets"), F.sum("_n").alias("links"))


def order_comparison(df: DataFrame, group: str, first: list[str], second: list[str]) -> DataFrame:
    """Places of a group's rows under two orders: how many agree, and the furthest move."""
    a, b = (F.row_number().over(Window.partitionBy(group).orderBy(*o)) for o in (first, second))
    return df.select(group, a.alias("a"), b.alias("b")).groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("in_place"), F.max(F.abs(F.col("a") - F.col("b"))).cast("long").alias("furthest"))


def named_keys(keys: DataFrame, key: str, names: DataFrame, name: str, functions: dict) -> DataFrame:
    """Names whose value under one of the functions is a key: each name is hashed once a function, then one equi-join."""
    cells = F.array(*[F.struct(F.lit(fn).alias("fn"), c.alias(key)) for fn, c in functions.items()])
    return names.select(name, F.inline(cells)).join(keys, key).select("fn", name, key)


def table_coverage(names: DataFrame, name: str, table: DataFrame, key: str) -> DataFrame:
    """How many of the distinct names a table knows."""
    known = table.select(F.col(key).alias("_k")).where("_k is not null").distinct().withColumn("_hit", F.lit(1))
    own = names.select(F.col(name).alias("_k")).where("_k is not null").distinct()
    rows = own.join(known, "_k", "left").agg(F.count("*").alias("names"), F.count("_hit").alias("covered"))
    return rows.withColumn("covered_pct", F.round(F.col("covered") * 100.0 / F.col("names"), 4))


def field_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, field, old, new, change) of every field that differs between two versions of records, and of records in one only.

    One full outer join on the key; values are compared as text, nulls equal."""
    names = [c for c in old.columns if c != key]
    side = lambda df, tag: df.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in names]).alias(tag))
    both = side(old, "_old").join(side(new, "_new"), key, "full")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_old.{c}").alias("old"), F.col(f"_new.{c}").alias("new")) for c in names])
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed").alias("change")
    return both.select(key, change, F.inline(cells)).where(~F.col("old").eqNullSafe(F.col("new")))


def edit_classes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, verdict, fields): same; translation where only text fields differ, with text on both sides; structure for any other change; added, removed.

    One full outer join on the key; a null against a value is a change of structure."""
    fields = [(c, kind) for c, kind in old.dtypes if c != key]
    side = lambda df, tag: df.select(key, F.struct(*[F.col(c) for c, _ in fields]).alias(tag))
    both = side(old, "_old").join(side(new, "_new"), key, "full")
    number = lambda tests: sum((F.when(x, 1).otherwise(0) for x in tests), F.lit(0))
    differs = {c: ~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c, _ in fields}
    reworded = [differs[c] & F.col(f"_old.{c}").isNotNull() & F.col(f"_new.{c}").isNotNull() for c, kind in fields if kind == "string"]
    counted = both.select(key, "_old", "_new", number(differs.values()).alias("n"), number(reworded).alias("texts"))
    verdict = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("n") == 0, "same").when(F.col("n") == F.col("texts"), "translation").otherwise("structure")
    return counted.select(key, verdict.alias("verdict"), F.col("n").alias("fields"))


def owned(df: DataFrame, file: str, start: str, end: str, claimant: str, order: list[str]) -> DataFrame:
    """(file, owner, bytes): each place of a file belongs to the first claimant in order whose intervals [start, end) cover it; uncovered places to none.

    Claims are counted a boundary before the sweep, so repeated intervals are one row of it. Empty, null and unlisted claims count for nothing."""
    ends = F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")))
    marks = df.where((F.col(end) > F.col(start)) & F.col(claimant).isin(order)).select(file, claimant, F.inline(ends))
    open_ = [f"_open{i}" for i in range(len(order))]
    steps = marks.groupBy(file, "at").agg(*[F.coalesce(F.sum(F.when(F.col(claimant) == c, F.col("step"))), F.lit(0)).alias(o) for c, o in zip(order, open_)])
    w = Window.partitionBy(file).orderBy("at")
    swept = steps.select(file, (F.lead("at").over(w) - F.col("at")).alias("bytes"), *[F.sum(o).over(w).alias(o) for o in open_])
    owner = F.coalesce(*[F.when(F.col(o) > 0, c) for c, o in zip(order, open_)])
    return swept.select(file, owner.alias("owner"), "bytes").where("owner is not null").groupBy(file, "owner").agg(F.sum("bytes").alias("bytes"))
