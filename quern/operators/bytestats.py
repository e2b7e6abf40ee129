"""Statistics of bytes: entropy, histograms, repeated blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import small_batches


def entropy(df: DataFrame, text: str, key: str, digits: int = 4) -> DataFrame:
    """Bits a character of each text, -sum(p log2 p), without a shuffle: characters are counted inside the row. Empty or null: 0."""

    @F.pandas_udf("double")
    def bits(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            k = np.unique(np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
            p = k / max(k.sum(), 1)
            out.append(float(-(p * np.log2(p)).sum()) if len(k) > 1 else 0.0)
        return pd.Series(out, dtype="float64")

    return small_batches(df).select(key, F.round(bits(text), digits).alias("entropy"), F.length(text).cast("long").alias("chars"))


def histogram(df: DataFrame, text: str) -> DataFrame:
    """Characters by code point; exploded counts are combined before the shuffle."""
    return df.select(F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy(F.ascii("c").cast("long").alias("code")).agg(F.count("*").alias("n"))


def block_repeats(df: DataFrame, text: str, key: str, width: int = 64) -> DataFrame:
    """Aligned blocks of width characters that occur more than once: hash, times, owners."""
    # cut once from the front: a text's blocks cost its length
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(.{{{width}}})"), 1)
    blocks = df.select(key, F.explode(cut).alias("b")).select(key, F.sha1(F.encode("b", "UTF-8")).alias("block"))
    return blocks.groupBy("block", key).agg(F.count("*").alias("n")).groupBy("block").agg(F.sum("n").alias("times"), F.count("*").alias("owners")).where("times > 1")


def entropy_blocks(df: DataFrame, text: str, key: str, width: int, over: float) -> DataFrame:
    """Blocks of each non-empty text, their highest entropy in bits a character, and how many reach `over`.

    Counting characters of many blocks inside a row is vectorised in Arrow batches: exploding them would shuffle every character."""

    @F.pandas_udf("blocks long, most double, over long")
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            block = np.arange(len(code)) // width
            at, k = np.unique(block << 21 | code, return_counts=True)
            at >>= 21
            p = k / np.bincount(block)[at]
            h = np.round(-np.bincount(at, p * np.log2(p)), 4)
            rows.append((len(h), h.max(), int((h >= over).sum())))
        return pd.DataFrame(rows, columns=["blocks", "most", "over"])

    return small_batches(df).where(F.length(text) > 0).select(key, measure(text).alias("m")).select(key, "m.*")


def birthday(df: DataFrame, text: str, width: int) -> DataFrame:
    """Blocks, and the collisions expected of as many random 128-bit values."""
    n = F.col("blocks")
    return df.agg(F.sum(F.floor(F.length(text) / width)).alias("blocks")).select("blocks", (n.cast("double") * (n - 1) / 2 / F.pow(F.lit(2.0), F.lit(128))).alias("expected_collisions"))
