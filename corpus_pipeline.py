"""Corpus pipeline over `documents`: toxicity, quality rules, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents: the first two drop what they reject, the third keeps one document of each near-duplicate group, the fourth masks
personal data in `text` (and recounts n_chars), the last returns the pieces of the packed sequences.
Nulls, empty texts, ties and repeated rows have the operators' defined results; extra columns pass through all but the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import near_join, packing, pii, suffix_quality, toxicity
from quern.llm.batches import drop_path, scratch
from quern.llm.queries import remainder, table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    return toxicity.keep_clean(docs, net)


def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_quality.keep_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.learn(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_repetitive),
    ("near_duplicates", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The trained network of the first stage can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a Parquet table in the shared folder, reread by the next and then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
