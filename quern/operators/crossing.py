"""Content identity: hashes, copies, crossings between collections, differences and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SHA-1 of no bytes, and the least sizes of a crossing-rate table.
EMPTY = "da39a3ee5e6b4b0d3255bfef95601890afd80709"
LEAST_SIZES = (0, 1, 4, 8, 16, 32, 64, 128, 256, 1024, 4096, 65536)


def hashed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    content = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return df.select(F.sha1(content).alias("sha1"), F.octet_length(content).cast("long").alias("size"), *keep)


def redundancy(hashes: DataFrame) -> DataFrame:
    """Stored against distinct bytes; one size a hash."""
    by = hashes.groupBy("sha1").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    out = by.agg(F.sum("n").alias("leaves"), F.count("*").alias("distinct_sha1"), F.sum(F.col("n") * F.col("size")).alias("stored_bytes"), F.sum("size").alias("distinct_bytes"))
    out = out.withColumn("redundant_bytes", F.col("stored_bytes") - F.col("distinct_bytes"))
    return out.withColumn("redundant_pct", F.round(F.try_divide(F.col("redundant_bytes") * 100.0, F.col("stored_bytes")), 4)).withColumn("copies", F.col("leaves") - F.col("distinct_sha1"))


def dup_groups(hashes: DataFrame, key: str) -> DataFrame:
    return hashes.groupBy("sha1").agg(F.count("*").alias("copies"), F.max("size").alias("size"), F.min(key).alias("first_key")).where("copies > 1")


def within_across(hashes: DataFrame, owner: str) -> DataFrame:
    """Copies inside an owner, and hashes it shares with others."""
    per = hashes.groupBy("sha1", owner).agg(F.count("*").alias("n"), F.max("size").alias("size"))
    owners = per.groupBy("sha1").agg(F.count("*").alias("owners"))
    both = per.join(owners, "sha1")
    return both.groupBy(owner).agg(F.sum(F.col("n") - 1).alias("redundant_copies"), F.sum((F.col("n") - 1) * F.col("size")).alias("redundant_bytes"), F.count_if(F.col("owners") > 1).alias("shared_hashes"))


def crossings(mine: DataFrame, theirs: DataFrame, present: bool = True) -> DataFrame:
    """My distinct hashes that are (not) in the other collection; the empty content never crosses."""
    own = mine.where(F.col("sha1") != EMPTY).groupBy("sha1").agg(F.max("size").alias("size"), F.min("doc_id").alias("doc_id"))
    return own.join(theirs.where(F.col("sha1") != EMPTY).select("sha1").distinct(), "sha1", "left_semi" if present else "left_anti")


def crossing_rates(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Population, crossings and rate by least size. Each hash is read once: thresholds are columns, unpivoted at the end."""
    own = mine.where(F.col("sha1") != EMPTY).groupBy("sha1").agg(F.max("size").alias("size"))
    other = theirs.where(F.col("sha1") != EMPTY).select("sha1").distinct().withColumn("hit", F.lit(1))
    both = own.join(other, "sha1", "left")
    cells = [F.struct(F.lit(t).cast("long").alias("min_bytes"), F.count_if(F.col("size") >= t).alias("population"), F.count_if((F.col("size") >= t) & F.col("hit").isNotNull()).alias("crossings")) for t in LEAST_SIZES]
    rows = both.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))
    return rows.withColumn("rate_pct", F.round(F.try_divide(F.col("crossings") * 100.0, F.col("population")), 4))


def regions(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Venn regions of single-column sets: keys in each combination of membership."""
    flags = None
    for name, df in sets.items():
        tagged = df.select(key, *[F.lit(n == name).alias(n) for n in sets])
        flags = tagged if flags is None else flags.unionByName(tagged)
    member = flags.groupBy(key).agg(*[F.max(n).alias(n) for n in sets])
    return member.groupBy(*sets).agg(F.count("*").alias("keys"))


def tree_diff(a: DataFrame, b: DataFrame, key: str, content: str) -> DataFrame:
    """added, gone, changed, same by key; null-safe on content."""
    x, y = a.select(key, F.col(content).alias("was"), F.lit(1).alias("in_a")), b.select(key, F.col(content).alias("now"), F.lit(1).alias("in_b"))
    verdict = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "gone").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return x.join(y, key, "full_outer").withColumn("verdict", verdict)


def sibling_mirror(hashes: DataFrame, sibling: str) -> DataFrame:
    """Hashes by how many siblings hold them."""
    return hashes.groupBy("sha1").agg(F.count_distinct(sibling).alias("siblings"), F.max("size").alias("size")).groupBy("siblings").agg(F.count("*").alias("hashes"), F.sum("size").alias("bytes"))


def mirror_matrix(hashes: DataFrame, sibling: str) -> DataFrame:
    """Shared hashes of each pair of siblings, from each hash's set of siblings (as long as there are siblings, not rows)."""
    sets = hashes.groupBy("sha1").agg(F.collect_set(sibling).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def subset(a: DataFrame, b: DataFrame, key: str = "sha1") -> DataFrame:
    """One row: whether every key of a is one of b's, and how many aren't."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")
    return left.agg(F.count("*").alias("missing")).select((F.col("missing") == 0).alias("within"), "missing")
