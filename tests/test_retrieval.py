"""Block kernels, exact pruning and sampled impostors against plain loops."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexground.operators import retrieval as rt
from lexground.plans.retrieval import QUERIES

PLAIN = {"sisa": lambda m: m.mean(), "misa": lambda m: m.max(0).mean(), "sima": lambda m: m.max(1).mean()}


def clustered(seed, n, centres=6, spread=0.05, dims=4):
    """Images and captions of ragged sizes, each near one of a few far centres."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 5
    side = lambda most: {e: middle[e % centres] + rng.normal(0, spread, (int(rng.integers(1, most)), dims)) for e in range(n)}
    return side(5), side(7)


def frame(spark, side):
    return spark.createDataFrame([(e, i, v.tolist()) for e, x in side.items() for i, v in enumerate(x)], "example_idx long, idx int, vec array<double>").repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["sisa", "misa", "sima"])
def test_scores_of_ragged_blocks(spark, kind, monkeypatch):
    monkeypatch.setattr(rt, "MOST", 50)
    im, cap = clustered(1, 17, spread=1.0)
    got = {(r.row, r.col): r.value for r in rt.match_similarity(frame(spark, im), frame(spark, cap), kind, 4).collect()}
    assert len(got) == 17 * 17
    assert all(np.isclose(v, PLAIN[kind](im[c] @ cap[r].T)) for (r, c), v in got.items())


@pytest.mark.parametrize("kind", ["sisa", "misa", "sima"])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_pruned_results_are_those_of_all_pairs(spark, kind, spread):
    im, cap = clustered(3, 60, spread=spread)
    cap[7] = im[3].copy()  # equal vectors
    im[11] = im[3].copy()
    a, b = frame(spark, im), frame(spark, cap)
    all_ = rt.match_similarity(a, b, kind).cache()
    assert rows_of(rt.best_in_blocks(a, b, kind, 4, 6)) == rows_of(rt.top_k(all_, 4))
    assert rows_of(rt.recall_in_blocks(a, b, kind, (1, 5, 20), 6)) == rows_of(rt.recall_at_k(all_, (1, 5, 20)))


@pytest.mark.parametrize("kind", ["sisa", "misa", "sima"])
def test_fewer_blocks_are_scored_where_vectors_cluster(spark, kind):
    counts = {}
    for spread in (0.05, 30.0):
        im, cap = clustered(5, 120, centres=10, spread=spread)
        a, b = rt.group(rt.pack(frame(spark, im)), 8), rt.group(rt.pack(frame(spark, cap)), 8)
        every = a.select("group", "sub").distinct().count() * b.select("group", "sub").distinct().count()
        counts[spread] = rt.surviving(a, b, kind, keep=2).count() / every
    assert counts[0.05] < 0.5 and counts[0.05] < counts[30.0] <= 1


def test_examples_without_the_other_side(spark):
    im, cap = clustered(6, 12)
    del cap[3], im[5]
    a, b = frame(spark, im), frame(spark, cap)
    all_ = rt.match_similarity(a, b, "misa").cache()
    assert rows_of(rt.best_in_blocks(a, b, "misa", 3, 4)) == rows_of(rt.top_k(all_, 3))
    assert {r.recall for r in rt.recall_in_blocks(a, b, "misa", (12,), 4).collect()} == {1.0}
    assert rt.best_in_blocks(a.limit(0), b, "sisa", 3).count() == 0


def test_margin_loss_scores_three_pairs_an_item(spark):
    im, cap = clustered(8, 25, spread=2.0)
    a, b = frame(spark, im), frame(spark, cap)
    picked = {r.id: r for r in rt.impostors(spark.createDataFrame([(e,) for e in im], "id long"), 4).collect()}
    assert set(picked) == set(im) and all(r.caption != i and r.image != i for i, r in picked.items())
    assert len({r.caption for r in picked.values()}) == 25  # each is an impostor once
    score = lambda i, j: PLAIN["misa"](im[i] @ cap[j].T)
    want = np.mean([max(0, 1 + score(i, r.caption) - score(i, i)) + max(0, 1 + score(r.image, i) - score(i, i)) for i, r in picked.items()])
    assert np.isclose(rt.margin_loss(a, b, "misa", 1.0, 4).first().loss, want)
    assert rt.margin_loss(a.where(F.col("example_idx") == 0), b, "misa", 1.0, 4).first().loss is None


def test_blocks_grow_with_the_examples():
    """Every block meets the others: at 256 examples a block, a hundred thousand examples are moved some four hundred times."""
    assert rt.block_of(10) == rt.SMALL and all(n / rt.block_of(n) <= rt.FEW for n in (2048, 4000, rt.FEW * rt.LARGE)) and rt.block_of(10**9) == rt.LARGE
    assert 120_000 / rt.block_of(120_000) < 80


def test_blocks_meet_without_a_shuffle(spark):
    """A shuffle would copy each side once for every block of the other."""
    im, cap = clustered(9, 40)
    plan = rt.match_similarity(frame(spark, im), frame(spark, cap), "sisa", 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_examples_beyond_a_row_are_cut_into_several(spark, monkeypatch):
    im, cap = clustered(10, 15, spread=1.0)
    a, b = frame(spark, im), frame(spark, cap)
    want = rows_of(rt.match_similarity(a, b, "misa"))
    best = rows_of(rt.best_in_blocks(a, b, "misa", 3))
    monkeypatch.setattr(rt, "HELD", 30)  # of four dimensions and one to six vectors an example
    assert len(want) == 15 * 15 and rows_of(rt.match_similarity(a, b, "misa")) == want and rows_of(rt.best_in_blocks(a, b, "misa", 3)) == best


def packed_side(side):
    return np.concatenate(list(side.values())), np.r_[0, np.cumsum([len(v) for v in side.values()])]


@pytest.mark.parametrize("kind", ["misa", "sima"])
def test_kernels_hold_few_products(kind):
    """All products of a pair of blocks are beyond a core's cache, and were walked through twice."""
    rng = np.random.default_rng(11)
    side = {e: rng.normal(size=(5, 4)) for e in range(300)}
    tracemalloc.start()
    got = rt.similarity_of(kind)(*packed_side(side), *packed_side(side))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (300, 300) and held < 0.5 * 8 * 1500**2


@pytest.mark.parametrize("kind", ["misa", "sima"])
@pytest.mark.parametrize("step", [1, 60, 10**6])
def test_kernels_in_steps(kind, step, monkeypatch):
    monkeypatch.setattr(rt, "STEP", step)
    for im, cap in (clustered(12, 19, spread=1.0), clustered(13, 1), ({e: np.full((3, 2), -1.0 - e) for e in range(4)}, {e: np.full((2, 2), 1.0 + e) for e in range(5)})):
        want = [[PLAIN[kind](x @ y.T) for x in im.values()] for y in cap.values()]
        assert np.allclose(rt._scored(rt.similarity_of(kind), packed_side(im), packed_side(cap)), want, atol=1e-10)


def test_scores_are_rounded_as_by_spark(spark):
    rng = np.random.default_rng(14)
    many = np.r_[rng.normal(size=2000) * 10.0 ** rng.integers(-7, 6, 2000), (rng.integers(-(10**8), 10**8, 2000) + 0.5) / 1e5, 9999.999995, -123456789.123455, 1e12, -4e-6, 5e-6, 0.0]
    scores = np.r_[np.round(many, 11) + 0.0, np.inf, -np.inf, np.nan]
    want = [r.v for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(scores)], "i int, v double").select("i", F.round("v", 5).alias("v")).orderBy("i").collect()]
    assert list(map(repr, rt._half_up(scores, 5).tolist())) == list(map(repr, want))


@pytest.mark.parametrize("kind", ["sisa", "misa", "sima"])
def test_tasks_round_the_scores_of_all_pairs(spark, kind):
    """Spark's round makes a decimal of every value, which took longer than the score."""
    plan = QUERIES[f"r2_{kind}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "round(" not in plan


def test_batches_of_all_pairs_are_bounded(monkeypatch):
    monkeypatch.setattr(rt, "in_blocks", lambda a, b, pairs, kernel, found, schema: found)
    monkeypatch.setattr(rt, "every_pair", lambda *_: (None, None))
    values = np.arange(600.0 * 700).reshape(600, 700)
    parts = list(rt.score_blocks(None, None, None)(np.arange(600), np.arange(700), values))
    assert max(len(p["value"]) for p in parts) <= rt.ROWS
    row, col, value = (np.concatenate([p[c] for p in parts]) for c in ("row", "col", "value"))
    assert (value == values[row, col]).all() and len(set(zip(row, col, strict=True))) == values.size
