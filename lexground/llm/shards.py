"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, overfull ranges cut again.

DataFrame functions only. Records go to many fine ranges of the key; each range is small enough for one task. The exact
size of every range gives each record its exact place on the line of all bytes in key order, and a shard is an equal
piece of that line: shard sizes differ by one record at most, whatever the keys and sizes. Sampled splitters alone can't promise
that, as a quantile of a sample is off by its sampling error: they cut the ranges, and the ranges' exact sums place the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, whole_ids

#: Splitters, and keys drawn to choose them, at most: both bound what the driver holds.
MOST_RANGES, DRAWS_PER_RANGE = 8192, 32


def _range_of(key: str, splitters: list[int]) -> Column:
    """Number of splitters at or below the key: a binary search as an expression."""
    if not splitters:
        return F.lit(0)
    steps = [1 << k for k in range(len(splitters).bit_length() - 1, -1, -1)]
    held, n = F.lit(splitters).cast("array<bigint>"), len(splitters)
    return F.aggregate(
        F.lit(steps).cast("array<int>"),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(held, F.least(at + step, F.lit(n)) - 1) <= F.col(key)), at + step).otherwise(at),
    )


def _of_range(r: str, values: dict[int, int], last: int, other: int) -> Column:
    """The value of range ``r``, from an array with one number for each range."""
    return F.get(F.lit([values.get(i, other) for i in range(last + 1)]).cast("array<bigint>"), F.col(r)) if values else F.lit(other)


def _splitters(rows: DataFrame, ranges: int, total: int, seed: int) -> list[int]:
    """Quantile boundaries of a sample in which a record is drawn with a chance in proportion to its size."""
    if ranges < 2 or not total:
        return []
    draws = F.col("size") * (ranges * DRAWS_PER_RANGE / total)
    uniform = F.pmod(F.xxhash64("key", "tie", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.withColumn("w", (F.floor(draws) + (uniform < draws - F.floor(draws)).cast("long"))).where("w > 0")
    marks = sample.groupBy("key").agg(F.sum("w").alias("w")).agg(F.percentile("key", F.lit([i / ranges for i in range(1, ranges)]).cast("array<double>"), F.col("w"))).first()[0]
    return sorted({int(m) for m in marks or []})


def range_partition(records: DataFrame, ranges: int, seed: int = 7, rounds: int = 4) -> DataFrame:
    """``records(key bigint, tie bigint, size bigint)`` with ``part``, a number that grows with the key.

    A range of over twice the mean size is cut again by splitters sampled in it alone, up to ``rounds`` times; a range of one
    key (a hot one) is cut by a hash of ``tie``. So every part is small, and the order of parts is the order of keys.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    found = _splitters(records, ranges, total, seed)
    out = records
    for r in range(rounds):
        placed = out.withColumn("r", _range_of("key", found))
        sizes = placed.groupBy("r").agg(F.sum("size").alias("s"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        heavy = sizes.where((F.col("s") > 2 * total / max(ranges, 1)) & (F.col("lo") < F.col("hi"))).collect()
        if not heavy or len(found) >= 4 * MOST_RANGES:
            break
        inside = placed.where(_of_range("r", {h.r: 1 for h in heavy}, len(found), 0) == 1).drop("r")
        mass = sum(h.s for h in heavy)
        more = _splitters(inside, max(2, 2 * round(mass * ranges / max(total, 1))), mass, seed + r + 1) + [h.hi for h in heavy]
        if set(more) <= set(found):
            break
        found = sorted({*found, *more})
    placed = out.withColumn("r", _range_of("key", found))
    sizes = placed.groupBy("r").agg(F.sum("size").alias("s"))
    heavy = sizes.where(F.col("s") > 4 * total / max(ranges, 1)).collect()
    cut = _of_range("r", {h.r: int(2 * h.s * ranges / total) for h in heavy}, len(found), 1)  # one key alone fills these
    return placed.withColumn("sub", F.pmod(F.xxhash64("tie"), cut).cast("long")).withColumn("part", F.struct("r", "sub")).drop("r", "sub")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, seed: int = 7) -> DataFrame:
    """One row per document: the id, ``size`` (UTF-8 bytes of the text, null 0, plus 8), ``text_crc32``, ``shard`` and ``slot``.

    Key order is id order; a null id counts as the least; ids that are no whole numbers raise ValueError; equal ids are in any fixed order. A record that starts at byte b of
    all N bytes in key order is in shard floor(b * shards / N); ``slot`` numbers a shard's records from 0 without gaps.
    Repeated rows are records of their own. Empty tables give no row. Columns other than id and text are not read.
    """
    whole_ids(docs, id_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # Written once: the tie of a row must not change when a task runs again.
    slim = materialise(slim.withColumns({"key": F.coalesce(F.col("id"), F.lit(-(2**63))).cast("long"), "tie": F.monotonically_increasing_id()}), "shards-slim")
    rows = slim.count()
    ranges = ranges or int(min(MOST_RANGES, max(4 * shards, rows // 250_000)))
    placed = range_partition(slim, ranges, seed)
    sums = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row per range: a window over this table is bounded by the number of ranges.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.sum("bytes").over(everything).alias("total"))
    inner = Window.partitionBy("part").orderBy("key", "tie")
    lines = placed.join(F.broadcast(starts), "part").withColumns(
        {
            "b": F.col("b0") + F.sum("size").over(inner) - F.col("size"),
            "i": F.col("n0") + F.row_number().over(inner) - 1,
        }
    )
    lines = lines.withColumn("shard", F.expr(f"cast((b * cast({shards} as decimal(10,0))) div total as int)"))
    lines = materialise(lines.select("id", "size", "text_crc32", "shard", "i"), "shards-lines")
    first = lines.groupBy("shard").agg(F.min("i").alias("i0"))
    return lines.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("i") - F.col("i0")).alias("slot"))
