"""M8 to M10, M25 and M27 by brute force: packed segmentation, own counts taken out, one round of flat and of hierarchical words."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexground.functions import kernels as kn
from lexground.functions import packed as pk
from lexground.functions.scratch import bucketed
from lexground.functions.statistics import vector_sums, weighted_sums
from lexground.operators import acoustic as ac
from lexground.operators import models as md

MU0, VAR, VAR0 = 0.1, 0.7, 4.0


def all_splits(n):
    for bits in itertools.product([0, 1], repeat=max(n - 1, 0)):
        yield tuple([i + 1 for i in range(n - 1) if bits[i]] + [n])


def batch(sizes, most, seed):
    """Random spans of several examples: a list of {(s, e): log p}, and the packed band."""
    rng = np.random.default_rng(seed)
    tables = [{(s, e): float(rng.normal()) for e in range(1, n + 1) for s in range(max(0, e - most), e) if e - s == 1 or rng.random() < 0.9} for n in sizes]
    first = np.r_[0, np.cumsum([n + 1 for n in sizes])]
    of, start, end, log_p = (np.array(x) for x in zip(*[(i, s, e, v) for i, t in enumerate(tables) for (s, e), v in t.items()], strict=True))
    return tables, first, pk.bands(first, of, start, end, log_p)


def ends(rows, first, n):
    of, _, end = pk.ends_of(rows, first)
    return [tuple(end[of == i]) for i in range(n)]


def test_packed_segmentation_against_all_paths():
    sizes = [6, 1, 3, 7, 2]
    tables, first, band = batch(sizes, 3, 2)
    got, alpha = ends(pk.viterbi(band, first), first, 5), pk.forward(band, first)
    for i, n in enumerate(sizes):
        score = {p: sum(tables[i].get(s, -np.inf) for s in zip((0, *p[:-1]), p, strict=True)) for p in all_splits(n)}
        assert got[i] == max(score, key=score.get)
        assert np.isclose(alpha[first[i + 1] - 1], kn.log_sum_exp(np.array(list(score.values()))))


def test_packed_draws_follow_the_weights_and_not_the_batch():
    sizes = [5, 2, 4]
    tables, first, band = batch(sizes, 3, 4)
    draws = Counter(ends(pk.sample(band, first, 0.8, [k, k * 7919 + 1, k * 31]), first, 3)[0] for k in range(3000))
    score = {p: sum(tables[0].get(s, -np.inf) for s in zip((0, *p[:-1]), p, strict=True)) for p in all_splits(5)}
    # Backward steps with temperature: the last span by alpha^(1/temp) and so on; recomputed step by step.
    alpha = pk.forward(band, first)
    def chance(p):
        out, e = 1.0, 5
        for s in reversed((0, *p[:-1])):
            w = {a: math.exp((alpha[a] + tables[0][a, e]) / 0.8) for a in range(e) if (a, e) in tables[0]}
            out, e = out * w.get(s, 0.0) / sum(w.values()), s
        return out
    for p in score:
        assert abs(draws[p] / 3000 - chance(p)) < 0.04
    alone = pk.bands(np.array([0, 6]), *[np.array(x) for x in zip(*[(0, s, e, v) for (s, e), v in tables[0].items()], strict=True)])
    assert [ends(pk.sample(band, first, 0.8, [k, 1, 2]), first, 3)[0] for k in range(50)] == [ends(pk.sample(alone, np.array([0, 6]), 0.8, [k]), np.array([0, 6]), 1)[0] for k in range(50)]


def test_nothing_feasible_is_still_cut(spark):
    band = np.full((5, 3), -np.inf)
    assert ends(pk.viterbi(band, np.array([0, 5])), np.array([0, 5]), 1) == [(1, 2, 3, 4)]
    spans = spark.createDataFrame([(7, 0, 2, -1.0), (7, 2, 4, -1.0), (8, 0, 1, 0.0)], "example_idx long, start int, end int, log_p double")
    assert sorted(map(tuple, md.segment_viterbi(spans).collect())) == [(7, 0, 2), (7, 2, 4), (8, 0, 1)]
    assert md.segment_viterbi(spans.limit(0)).count() == 0


def test_vector_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(k), rng.normal(size=3).tolist()) for i, k in enumerate(rng.integers(0, 5, 200))]
    v = spark.createDataFrame([*rows, (500, 2, None), (501, None, [1.0, 2.0, 3.0])], "i long, k int, vec array<double>").repartition(7)
    got = {(r.k, r.dim): (r.n, r.total, r.squares) for r in vector_sums(v).collect()}
    for k in range(5):
        x = np.array([vec for _, g, vec in rows if g == k])
        for d in range(3):
            assert np.allclose(got[k, d], (len(x), x[:, d].sum(), (x[:, d] ** 2).sum()))
    assert got[None, 1] == (1, 2.0, 4.0) and vector_sums(v.limit(0)).count() == 0
    w = spark.createDataFrame([(i, k, 0.1 * i * k) for i in range(200) for k in (0, 3)], "i long, k int, w double")
    sums = {(r.k, r.dim): (r.weight, r.total) for r in weighted_sums(w, v, ["i"]).collect()}
    x = np.array([vec for _, _, vec in rows])
    assert np.allclose(sums[3, 2], (0.3 * np.arange(200).sum(), (0.3 * np.arange(200) * x[:, 2]).sum()))
    plan = weighted_sums(w, v, ["i"])._jdf.queryExecution().toString()
    assert "posexplode(vec" not in plan


def test_own_vector_is_taken_out(spark):
    """Each row's densities and prior are those of a fit without it."""
    rng = np.random.default_rng(5)
    x, k = rng.normal(size=(30, 2)) * 2, np.r_[rng.integers(0, 3, 29), 3]  # component 3 has one vector
    n = np.bincount(k, minlength=5).astype(float)
    total = np.zeros((5, 2))
    np.add.at(total, k, x)
    want = []
    for i in range(30):
        n1, t1 = n.copy(), total.copy()
        n1[k[i]] -= 1
        t1[k[i]] -= x[i]
        d = kn.log_densities(x[i : i + 1], *kn.component_posterior(n1, t1, np.full(2, MU0), VAR, VAR0))[0]
        want.append(int((d + kn.component_log_prior(n1, 1.5)).argmax()))
    rows = [(i, 0, x[i].tolist(), int(k[i])) for i in range(30)]
    v = spark.createDataFrame(rows, "example_idx long, idx int, vec array<double>, k int")
    got = {r.example_idx: r.k for r in md.gmm_assign(v, n, total, np.full(2, MU0), VAR, VAR0, 1.5, own="k").collect()}
    assert [got[i] for i in range(30)] == want
    plain = {r.example_idx: r.k for r in md.gmm_assign(v, n, total, np.full(2, MU0), VAR, VAR0, 1.5).collect()}
    assert plain != got


def test_draws_without_own_counts_find_the_clusters(spark):
    rng = np.random.default_rng(8)
    rows = [(i, j, (np.array([6.0 * (i % 3), 0.0]) + rng.normal(0, 0.3, 2)).tolist(), int(rng.integers(0, 3))) for i in range(60) for j in range(2)]
    v = spark.createDataFrame(rows, "example_idx long, idx int, vec array<double>, k int")
    state, curve = md.gmm_rounds(v, v.select("example_idx", "idx", "k"), 3, np.zeros(2), 0.1, 30.0, 1.0, 8, seed=4)
    assert len(curve) == 8 and curve[-1] > curve[0]
    assert state.count() == 120


def brute_flat(tables, state, comps, alpha):
    """One flat round, example by example: everything refitted without the example's own chosen candidates."""
    out = {}
    for ex, cands in tables.items():
        rest = [(tables[o][i][3], k) for o, (at, ks) in state.items() if o != ex for i, k in zip(at, ks, strict=True)]
        n, total = np.zeros(comps), np.zeros((comps, 2))
        for x, k in rest:
            n[k] += 1
            total[k] += x
        mean, prec = kn.component_posterior(n, total, np.full(2, MU0), VAR, VAR0)
        prior = np.log(alpha / comps + n) - np.log(n.sum() + alpha)
        logits = kn.log_densities(np.array([c[3] for c in cands]), mean, prec) + prior
        score = kn.log_sum_exp(logits) * np.array([c[2] for c in cands])
        spot = {(c[0], c[1]): i for i, c in enumerate(cands)}
        length = max(c[1] for c in cands)
        best = max((sum(score[spot[s]] for s in zip((0, *p[:-1]), p, strict=True)), p) for p in all_splits(length) if all(s in spot for s in zip((0, *p[:-1]), p, strict=True)))[1]
        chosen = [spot[s] for s in zip((0, *best[:-1]), best, strict=True)]
        out[ex] = (chosen, [int(logits[i].argmax()) for i in chosen])
    return out


def test_flat_round_by_refitting(spark):
    rng = np.random.default_rng(12)
    tables, rows = {}, []
    for ex in range(6):
        length = 1 + ex % 4
        cands = sorted(((e, s) for e in range(1, length + 1) for s in range(max(0, e - 3), e)))
        tables[ex] = [(s, e, float(e - s), rng.normal(size=2) * 3) for e, s in cands]
        rows += [(ex, s, e, int(d), x.tolist()) for s, e, d, x in tables[ex]]
    cands = spark.createDataFrame(rows, "example_idx long, start int, end int, dur int, vec array<double>")
    state = {ex: (at := [len(t) - 1] if ex % 2 else list(range(min(2, len(t)))), [int(k) for k in rng.integers(0, 3, len(at))]) for ex, t in tables.items()}
    n, total = np.zeros(3), np.zeros((3, 2))
    for ex, (at, ks) in state.items():
        for i, k in zip(at, ks, strict=True):
            n[k] += 1
            total[k] += tables[ex][i][3]
    held = ac.pack_candidates(cands, 1, 3).join(spark.createDataFrame([(e, a, k) for e, (a, k) in state.items()], "example_idx long, at array<int>, k array<int>"), "example_idx")
    held = held.withColumn("prior", F.lit(None).cast("array<double>"))
    got = ac.acoustic_round(held, n, total, np.full(2, MU0), VAR, VAR0, 1.3, 1.0, "duration", None, 0.0, False, 0, False).collect()
    assert {r.example_idx: (r["at"], r.k) for r in got} == brute_flat(tables, state, 3, 1.3)


def test_rounds_of_packed_examples_move_nothing(spark):
    """The join of the packed table with a round's result has no exchange."""
    rows = [(e, i, [float(e), float(i)]) for e in range(20) for i in range(4)]
    slices = spark.createDataFrame(rows, "example_idx long, idx int, vec array<double>")
    held = bucketed(ac.pack_slices(slices, 3, 1), "example_idx", "test-held")
    state = bucketed(held.select("example_idx", F.size("units").alias("n")).repartition(3), "example_idx", "test-state")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    both = held.join(state, "example_idx")
    plan = both._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and both.count() == 20


def test_acoustic_segmentation_covers(spark):
    cands = spark.createDataFrame([(e, s, t, t - s, [float(s), float(t), 1.0]) for e in range(2) for s in range(3) for t in range(s + 1, 4)], "example_idx long, start int, end int, dur int, vec array<double>")
    for length_term, temp in (("duration", None), ("poisson", 0.7)):
        out = ac.segment_acoustic(cands, 2, np.zeros(3), 1.0, 1.0, 1.0, 2, 1, length_term=length_term, temp=temp)
        assert sorted(map(tuple, out.groupBy("example_idx").agg(F.sum(F.col("end") - F.col("start"))).collect())) == [(0, 3), (1, 3)]


def test_component_prior_follows_the_image(spark):
    """Component 0 is said of concept 0 and component 1 of concept 1: an image of concept 1 expects component 1."""
    state = spark.createDataFrame([(e, [e % 2]) for e in range(20)], "example_idx long, k array<int>")
    posts = spark.createDataFrame([(e, [(0, [0.99, 0.01] if e % 2 == 0 else [0.01, 0.99])]) for e in range(20)], "example_idx long, posts array<struct<idx:int,post:array<double>>>")
    got = {r.example_idx: np.exp(r.prior) for r in ac.component_prior(state, posts, 2, inner=8).collect()}
    assert len(got) == 20 and all(np.isclose(p.sum(), 1) and p[e % 2] > 0.7 for e, p in got.items())


def plain_words(slices, units_of, words_of, m, limit, alpha, p, most, penalty, eps=1e-30):
    """One hierarchical round with best segmentations and room in the table: refitted without each example, spans scored one by one."""
    out = {}
    for ex, xs in slices.items():
        n, total, table = np.zeros(m), np.zeros((m, 2)), Counter()
        for o, us in units_of.items():
            if o != ex:
                for x, u in zip(slices[o], us, strict=True):
                    n[u] += 1
                    total[u] += x
                table.update(words_of[o])
        mean, prec = kn.component_posterior(n, total, np.full(2, MU0), VAR, VAR0)
        lse = lambda v: float(kn.log_sum_exp(np.array(v)))
        score = {}
        for s in range(len(xs)):
            for e in range(s + 1, min(len(xs), s + most) + 1):
                ld = kn.log_densities(xs[s:e], mean, prec)
                size = e - s
                words = [w for w in table if len(w) == size]
                active = [sum(ld[t, u] for t, u in enumerate(w)) / size for w in words]
                rest = sum(lse(row) for row in ld) / size
                if active:
                    rest += math.log(max(1 - math.exp(min(lse(active) - rest, 0)), eps))
                lik = [*active, rest]
                prior = [math.log(alpha / limit + table[w]) - math.log(sum(table.values()) + alpha) for w in words]
                prior.append(math.log(p) + (size - 1) * math.log(1 - p) - size * math.log(m))
                score[s, e] = lse([a + b - lse(lik) for a, b in zip(prior, lik, strict=True)]) + penalty
        splits = [q for q in all_splits(len(xs)) if all(s in score for s in zip((0, *q[:-1]), q, strict=True))]
        best = max(splits, key=lambda q: sum(score[s] for s in zip((0, *q[:-1]), q, strict=True)))
        ld = kn.log_densities(xs, mean, prec)
        out[ex] = (list(best), [",".join(str(int(u)) for u in ld[s:e].argmax(1)) for s, e in zip((0, *best[:-1]), best, strict=True)])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchical_round_by_refitting(spark, seed):
    rng = np.random.default_rng(seed)
    m, limit, alpha, most = 4, 50, 1.2, 3
    slices = {ex: rng.normal(size=(int(rng.integers(1, 6)), 2)) * 3 for ex in range(7)}
    units_of = {ex: [int(u) for u in rng.integers(0, m, len(x))] for ex, x in slices.items()}
    words_of = {}
    for ex, us in units_of.items():
        cuts = [0, *sorted(set(int(c) for c in rng.integers(1, len(us) + 1, 3)) - {len(us)}), len(us)]
        cuts = [c for i, c in enumerate(cuts) if i == 0 or c > cuts[i - 1]]
        words_of[ex] = [tuple(us[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    table = dict(Counter(w for ws in words_of.values() for w in ws))
    n, total = np.zeros(m), np.zeros((m, 2))
    for ex, us in units_of.items():
        np.add.at(n, us, 1)
        np.add.at(total, us, slices[ex])
    rows = [(ex, x.tolist(), units_of[ex], [",".join(map(str, w)) for w in words_of[ex]], None) for ex, x in slices.items()]
    held = spark.createDataFrame(rows, "example_idx long, vecs array<array<double>>, units array<int>, words array<string>, prior map<string,double>")
    got = ac.word_round(held, table, n, total, np.full(2, MU0), VAR, VAR0, alpha, limit, most, 0.5, None, -0.3, 0).collect()
    want = plain_words(slices, units_of, words_of, m, limit, alpha, 0.5, most, -0.3)
    assert {r.example_idx: (r.ends, r.words) for r in got} == want
    assert all(r.units == [int(u) for w in r.words for u in w.split(",")] for r in got)


def test_words_within_the_limit(spark):
    drawn = spark.createDataFrame([(["1", "2,2", "3"], [None, None, "9"]), (["1", "4", "2,2"], [None] * 3), (["1", "5,5,5"], [None] * 2)], "words array<string>, others array<string>")
    assert set(ac.admit(drawn, {(7,): 4}, 2)) == {(7,), (1,), (2, 2), (5, 5, 5)}
    assert set(ac.admit(drawn, {(7,): 4, (8,): 1}, 2)) == {(7,), (8,), (2, 2), (5, 5, 5)}
    held = spark.createDataFrame([(0, [[0.0], [1.0], [5.0]], [1, 3], ["6", "2,4"], ["7", None])], "example_idx long, vecs array<array<double>>, ends array<int>, words array<string>, others array<string>")
    n, total = np.array([3.0, 3.0]), np.array([[0.0], [15.0]])
    row = ac.settle(held, {(7,): 0, (0, 0): 0, (0, 1): 0}, n, total, np.zeros(1), 1.0, 4.0).first()
    assert row.words == ["7", "0,1"] and row.units == [7, 0, 1]


def planted(seed=3):
    """Sentences of three planted words over four units far apart."""
    rng = np.random.default_rng(seed)
    words, rows = [(0, 1), (2,), (3, 2, 0)], []
    for ex in range(60):
        line = [u for _ in range(3) for u in words[rng.integers(0, 3)]]
        rows += [(ex, i, (np.array([8.0 * (u % 2), 8.0 * (u // 2)]) + rng.normal(0, 0.2, 2)).tolist(), u) for i, u in enumerate(line)]
    return rows


@pytest.mark.parametrize("temp", [None, 1.0])
def test_likelihood_of_words_rises(spark, temp):
    rng = np.random.default_rng(1)
    rows = [(e, i, v, u if rng.random() < 0.6 else int(rng.integers(0, 4))) for e, i, v, u in planted()]  # units start partly wrong
    slices = spark.createDataFrame(rows, "example_idx long, idx int, vec array<double>, unit int")
    spans, words, curve = ac.segment_words(slices, 4, 30, np.full(2, 4.0), 0.1, 30.0, 1.0, 4, 2, most=3, temp=temp)
    assert curve[-1] >= curve[0]
    covered = {r.example_idx: r.n for r in spans.groupBy("example_idx").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    sizes = Counter(e for e, *_ in rows)
    assert covered == dict(sizes)
    assert words.count() <= 30 + 3 and words.agg(F.sum("n")).first()[0] == spans.count()
    assert all(len(r.word.split(",")) == r.end - r.start for r in spans.collect())


def test_words_realigned_with_images(spark):
    slices = spark.createDataFrame([(*r[:3], r[3]) for r in planted()], "example_idx long, idx int, vec array<double>, unit int")
    images = spark.createDataFrame([(e, 0, [0.9, 0.1] if e % 2 else [0.2, 0.8]) for e in range(60)], "example_idx long, idx int, post array<double>")
    spans, words, _ = ac.segment_words(slices, 4, 3, np.full(2, 4.0), 0.1, 30.0, 1.0, 2, 2, most=3, images=images)
    assert spans.count() and words.count() <= 6
    empty, none, _ = ac.segment_words(slices.limit(0), 4, 3, np.full(2, 4.0), 0.1, 30.0, 1.0, 1, 2)
    assert empty.count() == 0 and none.count() == 0
