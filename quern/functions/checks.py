"""Checks that refuse empty populations and unreconciled results."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """A query's population or result isn't what it must be."""


def require_non_empty(df: DataFrame, why: str) -> DataFrame:
    if df.limit(1).count() == 0:
        raise Refused(f"empty population: {why}")
    return df


def expect(df: DataFrame, rows: int, what: str) -> DataFrame:
    got = df.count()
    if got != rows:
        raise Refused(f"{what}: {got} rows, expected {rows}")
    return df


def require_zero(df: DataFrame, column: str, what: str) -> DataFrame:
    """Refuse if any row of column isn't 0."""
    if df.where(F.coalesce(F.col(column), F.lit(0)) != 0).limit(1).count():
        raise Refused(f"{what}: {column} is not 0")
    return df


def controls(counts: DataFrame) -> DataFrame:
    """Verdict of a needle table with kinds must_hit and must_miss."""
    hit = F.coalesce(F.min(F.when(F.col("kind") == "must_hit", F.col("hits") > 0)), F.lit(False))
    miss = F.coalesce(F.min(F.when(F.col("kind") == "must_miss", F.col("hits") == 0)), F.lit(False))
    return counts.agg(hit.alias("positive_ok"), miss.alias("negative_ok"), (hit & miss).alias("verdict"))


def without(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of other names; a name that excludes nothing is an error."""
    seen = {r[0] for r in df.where(F.col(column).isin(names)).select(column).distinct().collect()}
    if idle := sorted(set(names) - seen):
        raise Refused(f"exclusions that match nothing: {idle}")
    return df.where(~F.col(column).isin(names) | F.col(column).isNull())


def seeded_order(n: int, seed: int) -> list[int]:
    """The places 0 to n - 1 in an order that depends on the seed alone."""
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


def derived_needles(df: DataFrame, text: str, seed: int) -> dict[str, str]:
    """must_hit: the commonest lower-case word of four letters or more (ties: the last by code). must_miss: its letters in a seeded order."""
    words = df.select(F.explode(F.regexp_extract_all(text, F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    best = words.agg(F.max(F.struct("n", "w")).alias("b")).first().b
    if best is None:
        raise Refused("no word to derive a control from")
    return {"must_hit": best.w, "must_miss": "".join(best.w[i] for i in seeded_order(len(best.w), seed))}
