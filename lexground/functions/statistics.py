"""Sums over vectors that leave a task as a few rows, so that no row is ever made for each number of each vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed

#: Numbers of vectors that a task adds up at once.
MOST = 1_000_000


def vector_sums(vectors: DataFrame, key: str = "k", squares: bool = True) -> DataFrame:
    """(key, dim, n, total, squares) of ``vectors(key, vec)``: each task adds its vectors up by key, and Spark adds up the tasks' sums: keys
    times dimensions times tasks rows. A task that meets over 10,000 keys passes its sums on and begins anew. Null keys are a key; null
    vectors are left out; a table without vectors gives no row."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            rows = list(held.items())
            cols = [pa.array([k for k, _ in rows], schema.field(0).type), pa.array([v[0] for _, v in rows], pa.int64())]
            cols += [pa.array([v[i].tolist() for _, v in rows], pa.list_(pa.float64())) for i in (1, 2)]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for whole in batches:
            whole = whole.filter(whole.column(1).is_valid())
            for lo, hi in packed.groups(np.diff(packed.lists(whole.column(1))[0]), MOST):
                batch = whole.slice(lo, hi - lo)
                x, column = packed.matrix(batch.column(1)), batch.column(0).dictionary_encode("encode")
                at, names = column.indices.to_numpy(), column.dictionary.to_pylist()
                order = np.argsort(at, kind="stable")
                begin = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
                n, total, sq = np.diff(np.r_[begin, len(at)]), np.add.reduceat(x[order], begin, 0), np.add.reduceat(x[order] ** 2, begin, 0)
                for i, g in enumerate(at[order][begin]):
                    old = held.get(names[g])
                    held[names[g]] = (n[i], total[i], sq[i]) if old is None else (old[0] + n[i], old[1] + total[i], old[2] + sq[i])
                if len(held) > 10_000:
                    yield out()
        if held:
            yield out()

    ddl = f"{key} {kind}, n long, total array<double>, squares array<double>"
    schema = vectors.sparkSession.createDataFrame([], ddl).toArrow().schema
    sums = vectors.select(key, "vec").mapInArrow(run, ddl)
    flat = sums.select(key, "n", F.posexplode(F.arrays_zip("total", "squares")).alias("dim", "x"))
    out = flat.groupBy(key, "dim").agg(F.sum("n").alias("n"), F.sum("x.total").alias("total"), F.sum("x.squares").alias("squares"))
    return out if squares else out.drop("squares")


def weighted_sums(weights: DataFrame, vectors: DataFrame, on: list[str]) -> DataFrame:
    """(k, dim, weight, total): sum of w and of w times vec over ``weights(*on, k, w)`` and ``vectors(*on, vec)``. A vector's weights come as
    one row, each task takes one matrix product a batch, and Spark adds up the tasks' sums."""
    both = weights.groupBy(*on).agg(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), F.col("w").cast("double").alias("w"))).alias("kw")).join(vectors.select(*on, "vec"), on).select("kw", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, total = np.zeros(0), np.zeros((0, 0))
        for batch in batches:
            offsets, values = packed.lists(batch.column("kw"))
            if not len(values):
                continue
            k, w, x = np.asarray(values.field(0)), np.asarray(values.field(1)), packed.matrix(batch.column("vec"))
            size = max(len(mass), int(k.max()) + 1)
            mass = np.r_[mass, np.zeros(size - len(mass))]
            total = np.vstack([total.reshape(-1, x.shape[1]), np.zeros((size - len(total), x.shape[1]))])
            np.add.at(mass, k, w)
            for lo, hi in packed.groups(np.full(len(x), size), 4_000_000):
                own = slice(offsets[lo], offsets[hi])
                dense = np.zeros((hi - lo, size))
                np.add.at(dense, (np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), k[own]), w[own])
                total += dense.T @ x[lo:hi]
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(mass), dtype=np.int32), "weight": mass, "total": pa.array(list(total), pa.list_(pa.float64()))})

    sums = both.mapInArrow(run, "k int, weight double, total array<double>")
    return sums.select("k", "weight", F.posexplode("total").alias("dim", "x")).groupBy("k", "dim").agg(F.sum("weight").alias("weight"), F.sum("x").alias("total"))
