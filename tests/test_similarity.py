"""Nearest vectors and their controls: odd vectors against the queries' SQL, and that no pair becomes a row of the plan."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.operators import similarity
from quern.plans import catalog
from tests.test_catalog import plain

NAMES = ["mad_nearest", "mad_permuted_control", "mad_shuffled_control"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Copies, ties to six places, unknown and missing values, short and empty lists, repeated and null keys."""
    path = str(tmp_path_factory.mktemp("odd"))
    some = [[((i * 37 + k * 11) % 101) / 7 for k in range(6)] for i in range(330)]
    rows = [(i, some[i]) for i in range(330)] + [(400 + i, some[100]) for i in range(9)]
    rows += [(7, [x + 3e-7 for x in some[200]]), (8, [x + 4e-7 for x in some[200]]), (300, [x + 1e-7 for x in some[200]])]
    rows += [(500, None), (501, None), (502, [None] * 6), (503, [1.0, None, 3.0, 4.0, None, 6.0]), (600, [1.0, 2.0]), (601, [1.0, 2.5]), (700, []), (800, [1.0, None, 3.5, 4.0, 5.0, 6.0]), (None, some[0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("most", [10_000, 2])
def test_odd_vectors(spark, odd, monkeypatch, name, most):
    monkeypatch.setattr(similarity.against_all, "__defaults__", (most,))
    monkeypatch.setattr(similarity, "TASK_PAIRS", 1000)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{odd}/embeddings.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, odd)
    rel = duck.sql(catalog.ORACLE[name])
    assert rel.columns == df.columns
    assert plain(df.collect()) == plain(rel.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_pairs_are_no_rows(spark, odd, name):
    plan = catalog.QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keys_keep_their_type(spark):
    rows = spark.range(300).select(F.col("id").cast("int").alias("k"), F.array(F.col("id").cast("double")).alias("v"))
    got = similarity.nearest(rows.where("k = 0"), rows, "k", "v")
    assert got.dtypes[:2] == [("query", "int"), ("neighbour", "int")] and tuple(got.first()) == (0, 1, 1.0)
