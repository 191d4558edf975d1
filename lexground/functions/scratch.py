"""Folders for tables that a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder in ``spark.checkpoint.dir``. Where none is set, local mode makes a local folder, and a
    cluster raises ValueError, as its executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexground-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` and read it again, so that rounds of a loop don't grow one plan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str | list[str], name: str = "buckets", buckets: int | None = None) -> DataFrame:
    """Write ``df`` as a table of ``buckets`` buckets of ``key``, a column or several (by default as many as shuffles have partitions) and read it back. Tables with
    the same buckets are joined and grouped by ``key`` where their files lie, so the rounds of a loop don't move them. A frame that comes from
    such a table needs no shuffle to be written with the same buckets."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = f"{name.replace('-', '_')}_{path.rsplit('-', 1)[1]}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [key] if isinstance(key, str) else key
    df.write.format("parquet").option("path", path).bucketBy(n, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:]).saveAsTable(table)
    return spark.table(table)
