"""M10 and M17 against plain loops with the same uniforms, and S6 with a class in several files."""

import glob
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexground.functions import kernels as kn
from lexground.operators import models as md
from lexground.sources import files


def sampled(words, log_p, max_len, key):
    """A segmentation drawn backward, by plain sums."""
    n = len(words)
    alpha = [0.0] + [-np.inf] * n
    for e in range(1, n + 1):
        alpha[e] = float(kn.log_sum_exp(np.array([alpha[s] + log_p(s, e) for s in range(max(0, e - max_len), e)])))
    u, ends, e = kn.uniforms(key, n + 1), [], n
    while e:
        ends.append(e)
        starts = list(range(max(0, e - max_len), e))
        w = np.array([alpha[s] + log_p(s, e) for s in starts])
        c = np.cumsum(np.exp(w - w.max()))
        e = starts[min(int(np.searchsorted(c, u[e] * c[-1], "right")), len(c) - 1)]
    return ends[::-1]


def crp_by_hand(captions, alpha, rounds, seed, max_len):
    every = Counter(t for c in captions.values() for t in c)
    prior = {t: n / every.total() for t, n in every.items()}
    state = None
    for r in range(rounds):
        counts = Counter(w for ws in state.values() for w in ws) if state else None
        new = {}
        for ex, words in captions.items():
            own = Counter(state[ex]) if state else None

            def log_p(s, e, words=words, own=own):
                p0 = float(np.exp(sum(np.log(prior[t]) for t in words[s:e])))
                name = ",".join(words[s:e])
                return np.log(p0) if counts is None else np.log((alpha * p0 + counts[name] - own[name]) / (alpha + counts.total() - own.total()))

            ends = sampled(words, log_p, max_len, (ex + 1) * 0x9E3779B97F4A7C15 ^ seed + r)
            new[ex] = [",".join(words[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        state = new
    return state


def test_crp_rounds_by_hand(spark):
    rng = random.Random(3)
    captions = {ex: [rng.choice("abc") for _ in range(rng.randrange(1, 12))] for ex in range(25)}
    tokens = spark.createDataFrame([(ex, i, t) for ex, c in captions.items() for i, t in enumerate(c)], "example_idx long, pos int, token string").repartition(4)
    for block in (1_000_000, 20):
        out = {}
        for r in md.crp_segment(tokens, 0.8, 4, 11, 3, block).orderBy("example_idx", "start").collect():
            out.setdefault(r.example_idx, []).append(r.segment)
        assert out == crp_by_hand(captions, 0.8, 4, 11, 3)


def test_examples_stay_where_they_lie(spark):
    """The draw reads the packed examples without an exchange; only what it is told is shuffled."""
    tokens = spark.createDataFrame([(e, i, "ab"[i % 2]) for e in range(30) for i in range(4)], "example_idx long, pos int, token string")
    held = md._pack_tokens(tokens, md.phone_prior(tokens), 10)
    told = spark.createDataFrame([(0, None, None, "a", 3)], "block int, example_idx long, segments array<string>, segment string, n long")
    drawn = held.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(md._crp_draw(1.0, 5, 1, 3), "block int, example_idx long, ends array<int>, segments array<string>")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and drawn.count() == 30


def test_hmm_rounds_by_hand(spark):
    """Two rounds of training are E steps of each example, sums, floored normalisation and a gradient step."""
    rng = np.random.default_rng(2)
    v, mu = 4, rng.normal(size=(3, 2)) * 2
    images = {e: rng.normal(size=(2 + e % 2, 2)) * 2 for e in range(10)}
    captions = {e: [int(w) for w in rng.integers(0, v, 3 + e % 3)] for e in range(10)}
    tokens = spark.createDataFrame([(e, t, w) for e, c in captions.items() for t, w in enumerate(c)], "example_idx long, t int, w int")
    vectors = spark.createDataFrame([(e, i, x.tolist()) for e, xs in images.items() for i, x in enumerate(xs)], "example_idx long, idx int, vec array<double>")
    obs = rng.dirichlet(np.ones(v), 3)
    params, centres, curve = md.train_hmm(tokens, vectors, mu, v, 2, 0.2, 1.5, obs)

    mine, c, lls = md.start_params([2, 3], 3, v, obs), mu.copy(), []
    for _ in range(2):
        init, trans, seen, ll = {n: np.zeros(n) for n in (2, 3)}, {n: np.zeros((n, n)) for n in (2, 3)}, np.zeros((3, v)), 0.0
        step = np.zeros_like(c)
        for e, xs in images.items():
            pi, n = kn.rbf_posterior(xs, c, 1.5), len(xs)
            found = kn.hmm_estep(pi, mine["init"][n], mine["trans"][n], mine["obs"][:, captions[e]].T)
            init[n] += found["init"]
            trans[n] += found["trans"]
            np.add.at(seen.T, captions[e], found["gamma"])
            ll += found["loglik"]
            delta = found["concept"] - pi
            step += delta.T @ xs - c * delta.sum(0)[:, None]
        lls.append(ll / 10)
        c = c + 0.2 / (10 * 1.5) * step
        norm = lambda x: np.maximum(x, 1e-100) / np.maximum(x, 1e-100).sum(-1, keepdims=True)
        mine = {"init": {n: norm(x) for n, x in init.items()}, "trans": {n: norm(x) for n, x in trans.items()}, "obs": norm(seen)}
    assert np.allclose(curve, lls) and np.allclose(centres, c)
    assert np.allclose(params["obs"], mine["obs"]) and all(np.allclose(params["trans"][n], mine["trans"][n]) for n in (2, 3))


def test_a_large_class_is_cut_into_files(spark, tmp_path):
    rows = [(e, s, s + 3, "hot" if e % 3 else f"c{e}") for e in range(60) for s in range(0, 40, 4)]
    found = spark.createDataFrame(rows, "example_idx long, start int, end int, label string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files.write_classes(found, f"file://{tmp_path}/classes")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = [open(f).read().splitlines() for f in glob.glob(f"{tmp_path}/classes/part-*")]
    assert len([p for p in parts if p]) > 1 and all(p[0].startswith("Class ") for p in parts if p)
    got = files.read_classes(spark, f"file://{tmp_path}/classes")
    sizes = sorted(r["count"] for r in got.groupBy("class_id").count().collect())
    want = Counter(r[3] for r in rows)
    assert sizes == sorted(want.values()) and got.where(F.col("class_id").isNull()).count() == 0
