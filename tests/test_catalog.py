"""Every registered query against its SQL on DuckDB, over whole tables."""

import os

import duckdb
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(tuple("%.6g" % v if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    if name in catalog.ORACLE:
        rel = duck.sql(catalog.ORACLE[name])
        assert sorted(rel.columns) == cols
        want = [tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall()]
        assert plain(got) == plain(want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())


def test_name_hashes_by_published_values(spark):
    from pyspark.sql import functions as F

    from quern.functions import text

    fox = "The quick brown fox jumps over the lazy dog"
    got = {r.n: (r.e, r.j) for r in spark.createDataFrame([("a",), (fox,), ("",)], "n string").select("n", text.elf(F.col("n")).alias("e"), text.one_at_a_time(F.col("n")).alias("j")).collect()}
    assert got["a"] == (97, 0xCA2E9442) and got[fox][1] == 0x519E91F5 and got[""] == (0, 0)
    h = 0
    for c in fox.encode():
        h = (h << 4) + c
        g = h & 0xF0000000
        h = (h ^ g >> 24) & ~g & 0xFFFFFFFF
    assert got[fox][0] == h
