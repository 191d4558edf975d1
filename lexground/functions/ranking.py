"""Row numbers in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def numbered(df: DataFrame, *order, name: str = "idx") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order``. Rows are range-partitioned and sorted, and each partition's first number is the sum
    of the sizes before it; only the table of partition sizes meets in one task. Ties are in any order."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written, so that partitions and places stay as they are.
    held = cut(placed.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")), "numbered")
    sizes = held.groupBy("_p").agg(F.count("*").alias("_n"))
    first = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return held.join(first, "_p").select(*df.columns, (F.col("_o") + F.col("_i")).alias(name))
