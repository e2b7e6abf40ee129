"""The folder that driver and executors share: fresh paths in it, and tables that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir. A local session without one gets a folder of its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.startswith("local"):
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quern-"))
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return f"{base.rstrip('/')}/quern/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system interface."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got.stored_at = path
    return got


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made from them must be stored itself."""
    for t in tables:
        drop_path(t.sparkSession, t.stored_at)


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the bytes that one Arrow batch brings to a Python worker."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df
