"""Python workers of the catalogue get bounded batches, whatever the session was set to before."""

import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"
BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


@pytest.mark.parametrize("name", ["coverage_account", "source_zip", "source_packed", "entropy_by_doc", "weighted_entropy", "entropy_blocks"])
def test_bounded_batches(spark, name):
    for k in BOUNDS:
        spark.conf.unset(k)
    catalog.QUERIES[name](spark, SF)
    assert {k: int(spark.conf.get(k)) for k in BOUNDS} == BOUNDS
