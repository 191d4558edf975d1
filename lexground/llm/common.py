"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.scratch import cut as materialise
from ..functions.scratch import scratch as scratch_path

__all__ = ["bound_batches", "ddl", "fresh", "in_fold", "materialise", "reclaim", "scratch_path", "text_key", "whole_ids", "without"]


def reclaim(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver's JVM has collected their plans, which
    without pressure on its memory may take longer than the job."""
    for _ in range(2):  # some plans are held by others that go first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts and pages can be long, so fewer rows go to Python at once than Spark's default of 10,000, unless the session has a
    setting of its own. A batch of 10,000 long texts may exceed what an Arrow string column can hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def in_fold(id_col: str, folds: int = 5) -> Column:
    """True for the held-out fold: crc32 of the id as text, modulo ``folds``, is 0 (a null id counts as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """Raise ValueError for ids that are no whole numbers: an operator that orders by them would otherwise order by what a cast leaves."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"{id_col} must be a whole number, not {kind.simpleString()}: number the rows first")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that a result is about to add (compared as Spark does, without case)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that ``df`` does not have, for columns that only live within an operator."""
    low = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
