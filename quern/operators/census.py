"""Counts, shares, rollups and outliers over files (rows) and their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """Percentage of whole, null over an empty population."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def by_key(df: DataFrame, keys: list[str], size: str) -> DataFrame:
    """files, bytes and share of all bytes by key. The total is one row of partial sums, joined by broadcast."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    total = groups.agg(F.sum("bytes").alias("denominator"))
    return groups.join(F.broadcast(total)).withColumn("share_pct", share(F.col("bytes"), F.col("denominator")))


def rolled_up(df: DataFrame, outer: str, inner: str, size: str) -> DataFrame:
    """Counts and bytes by (outer, inner), by outer, and in all; level 0, 1, 3 tells them apart."""
    return df.rollup(outer, inner).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.grouping_id().alias("level"))


def reconciled(rollup: DataFrame, size: str = "bytes") -> DataFrame:
    """Sum of the leaves, the grand total and the residue, which must be 0."""
    leaves = F.sum(F.when(F.col("level") == 0, F.col(size)))
    total = F.sum(F.when(F.col("level") == 3, F.col(size)))
    return rollup.agg(leaves.alias("leaves"), total.alias("total"), (leaves - total).alias("residue"))


def assigned(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """How many groups claim each item: matched is 1 for all if the groups are exhaustive and exclusive."""
    hits = sum((F.when(c, 1).otherwise(0) for c in rules.values()), F.lit(0))
    name = F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules.items()], F.lit("unassigned"))
    return df.select(name.alias("grp"), hits.alias("matched")).groupBy("grp", "matched").agg(F.count("*").alias("items"))


def upper_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sorted[n // 2] per group, of exact counts: distinct values are pre-aggregated, so a hot group's rows don't meet."""
    tally = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = tally.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return run.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min(value).alias("upper_median"), F.max("all").alias("group_n"))


def size_outliers(df: DataFrame, keys: list[str], size: str, low: float = 0.05, high: float = 12.0, least: int = 4) -> DataFrame:
    """Rows whose size is far from their group's upper median."""
    med = upper_medians(df, keys, size).where((F.col("group_n") >= least) & (F.col("upper_median") != 0))
    out = df.join(med, keys).withColumn("ratio", F.round(F.col(size) / F.col("upper_median"), 6))
    return out.where((F.col(size) / F.col("upper_median") < low) | (F.col(size) / F.col("upper_median") > high))


def largest(df: DataFrame, size: str, key: str, k: int = 12) -> DataFrame:
    """Top-k report with the population beside it."""
    total = df.agg(F.count("*").alias("population"))
    return df.orderBy(F.desc(size), key).limit(k).join(F.broadcast(total))


def tiers(df: DataFrame, path: str, rules: list[tuple[str, str]], otherwise: str) -> DataFrame:
    """Rows by the first rule (pattern, tier) that their path matches."""
    tier = F.lit(otherwise)
    for pattern, name in reversed(rules):
        tier = F.when(F.col(path).rlike(pattern), name).otherwise(tier)
    return df.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def two_denominators(df: DataFrame, content: str, flag: Column) -> DataFrame:
    """A flag counted over files and over distinct contents."""
    by = df.groupBy(content).agg(F.count("*").alias("n"), F.count_if(flag).alias("k"))
    return by.agg(F.sum("n").alias("files"), F.sum("k").alias("files_flagged"), F.count("*").alias("contents"), F.count_if(F.col("k") > 0).alias("contents_flagged"))


def true_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median (mean of the middle two) and mean per group, of exact counts: distinct values are pre-aggregated, so a hot group's rows don't meet."""
    tally = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    run = tally.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy(value))).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    middle = (F.min(F.when(F.col("upto") >= low, F.col(value))) + F.min(F.when(F.col("upto") >= high, F.col(value)))) / 2
    return run.groupBy(*keys).agg(middle.cast("double").alias("median"), F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 4).alias("mean"))


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """A line of text a row: text columns to the left, numbers to the right, each cut to its width; null is blank."""
    kinds = dict(df.dtypes)
    cell = lambda c, n: (F.rpad if kinds[c] == "string" else F.lpad)(F.coalesce(F.col(c).cast("string"), F.lit("")), n, " ")
    return df.select(F.concat_ws(" ", *[cell(c, n) for c, n in widths.items()]).alias("line"))


def set_sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of two collections, shared and together, and the residue that must be 0. Null is no key."""
    sides = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))).where(F.col(key).isNotNull())
    each = sides.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = each.agg(F.count_if(F.col("a") == 1).alias("in_a"), F.count_if(F.col("b") == 1).alias("in_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"), F.count("*").alias("together"))
    return n.withColumn("residue", F.col("in_a") + F.col("in_b") - F.col("shared") - F.col("together"))
