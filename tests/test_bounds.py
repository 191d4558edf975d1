"""What a task holds does not grow with its Arrow batch."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from lexground.functions import statistics as st
from lexground.operators import acoustic as ac
from lexground.operators import models as md


def test_own_vectors_are_taken_out_in_parts():
    rng = np.random.default_rng(0)
    n, d, k = 1500, 64, 4
    x, of, held = rng.normal(size=(n * 12, d)), np.repeat(np.arange(n), 12), np.repeat(np.arange(n), 3)
    args = held, rng.integers(0, k, n * 3), x[: n * 3], np.full(k, 1e5), np.zeros((k, d)), np.zeros(d), 1.0, 1.0
    tracemalloc.start()
    ac._less_own(np.zeros((len(x), k)), x, of, *args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # 43,000 rows of 64 numbers at once take twice that


def test_parts_of_a_batch_add_up(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(int(i % 3), rng.normal(size=4).tolist()) for i in range(40)], "k int, vec array<double>")
    cap = spark.createDataFrame([(e, t, t % 2) for e in range(9) for t in range(3)], "example_idx long, t int, w int")
    im = spark.createDataFrame([(e, j, k, 0.1 + e + j + k) for e in range(9) for j in range(2) for k in range(2)], "example_idx long, j int, k int, q double")
    table = spark.createDataFrame([(w, k, 0.3 + 0.4 * (w == k)) for w in range(2) for k in range(2)], "w int, k int, p double")
    results = []
    for most, structs in ((st.MOST, md.STRUCTS), (10, 8)):
        monkeypatch.setattr(st, "MOST", most)
        monkeypatch.setattr(md, "STRUCTS", structs)
        sums = {(r.k, r.dim): (r.n, r.total, r.squares) for r in st.vector_sums(rows).collect()}
        counts, ll = md.mixture_counts(md.pack_mixture(cap, im).coalesce(1), table)
        results.append([sums, {(r.w, r.k): r.c for r in counts.collect()}, {r.example_idx: r.loglik for r in ll.collect()}])
    assert len(results[0][0]) == 12 and len(results[0][2]) == 9 and np.isclose(sum(results[0][1].values()), 9 * 2 * 3 / 3)
    for a, b in zip(*results, strict=True):
        assert a.keys() == b.keys() and all(np.allclose(a[x], b[x]) for x in a)
    parts = counts.agg(F.count("*").alias("n")).first().n
    assert parts == 4
