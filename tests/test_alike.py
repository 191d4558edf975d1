"""E steps of many examples at once against one by one."""

import numpy as np
import pandas as pd

from lexground.functions import kernels as kn
from lexground.operators import models as md


def test_many_examples_at_once(monkeypatch):
    rng = np.random.default_rng(7)
    n, k, steps = 3, 4, 5
    pi, b = rng.dirichlet(np.ones(k), (6, n)), rng.uniform(0.01, 1, (6, steps, k))
    init, trans = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n), n)
    for counts in ("all", "first"):
        many, each = kn.hmm_estep_many(pi, init, trans, b, counts), [kn.hmm_estep(p, init, trans, e, counts) for p, e in zip(pi, b, strict=True)]
        assert all(np.allclose(many[c], sum(e[c] for e in each)) for c in ("init", "trans", "loglik"))
        assert all(np.allclose(many[c], [e[c] for e in each]) for c in ("gamma", "concept"))


def test_examples_of_one_shape_are_packed(monkeypatch):
    """Ragged examples, some without regions or positions; each comes once, with its own emissions."""
    obs = np.random.default_rng(8).uniform(size=(3, 4))
    shapes = [(2, 3), (1, 2), (2, 3), (0, 2), (2, 0), (2, 3), (1, 1)]
    rows = pd.DataFrame({"post": [[np.full(3, i)] * n for i, (n, _) in enumerate(shapes)], "tokens": [[i % 4] * t for i, (_, t) in enumerate(shapes)]})
    seen = []
    monkeypatch.setattr(md, "MOST", 2 * 3 * 2 * 9)  # two of the largest
    for at, pi, x, emit in md._alike(rows, obs):
        assert len(at) <= 2 or pi.shape[1] == 1
        for i, p, t, e in zip(at, pi, x, emit, strict=True):
            assert p.shape == (shapes[i][0], 3) and (p == i).all() and t.tolist() == [i % 4] * shapes[i][1] and np.allclose(e, obs[:, t].T)
            seen.append(int(i))
    assert sorted(seen) == [0, 1, 2, 5, 6]


def test_symbol_counts_leave_a_task_in_few_batches(spark):
    rng = np.random.default_rng(9)
    one = lambda n, k: rng.dirichlet(np.ones(k), n).tolist()
    table = spark.createDataFrame([(e, one(4, 3), one(2, 2)) for e in range(50)], "example_idx long, tokens array<array<double>>, post array<array<double>>").coalesce(1)
    params = md.start_params([2], 2, 3, np.array([[0.5, 0.3, 0.2], [0.1, 0.2, 0.7]]))
    counts = md.symbol_counts(table, params)
    batches = counts.mapInArrow(lambda bs: (b.select(["p"]).slice(0, 1) for b in bs if b.num_rows), "p double").count()
    assert counts.count() == 50 * 12 and batches == 1
    assert np.allclose([r.s for r in counts.groupBy("example_idx", "idx").agg({"p": "sum"}).withColumnRenamed("sum(p)", "s").collect()], 1)
