"""Hand-computed cases, each with the rule that it decides."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexground.functions import kernels as kn
from lexground.functions.segments import block_mean, fourier, interpolate, merge_levels
from lexground.functions.sequences import edit_counts
from lexground.operators import evaluation as ev
from lexground.operators import examples as ex
from lexground.operators import models as md
from lexground.operators import retrieval as rt
from lexground.operators import text as tx
from lexground.operators import timeline as tl


def ali(spark, values, example=0):
    return spark.createDataFrame([(example, t, v) for t, v in enumerate(values)], "example_idx long, t int, value int")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_runs(spark):
    assert rows(tl.runs(ali(spark, [0, 0, 1, 1, 1, 0])), "start", "end", "value") == [(0, 2, 0), (2, 5, 1), (5, 6, 0)]
    # A last run of length one is kept.
    assert rows(tl.runs(ali(spark, [0, 0, 1])), "start", "end", "value") == [(0, 2, 0), (2, 3, 1)]
    assert tl.runs(ali(spark, [])).count() == 0


def test_runs_do_not_depend_on_partitions(spark):
    a = ali(spark, [0, 1, 1, 2, 2, 2, 0, 0]).union(ali(spark, [3, 3, 1], 1))
    assert rows(tl.runs(a.repartition(1)), "example_idx", "start", "end", "value") == rows(tl.runs(a.repartition(7)), "example_idx", "start", "end", "value")


def test_iou(spark):
    got = spark.range(1).select(tl.iou(F.lit(0), F.lit(4), F.lit(2), F.lit(6)).alias("a"), tl.iou(F.lit(0), F.lit(2), F.lit(2), F.lit(4)).alias("b"), tl.iou(F.lit(1), F.lit(1), F.lit(1), F.lit(1)).alias("c")).first()
    assert (round(got.a, 6), got.b, got.c) == (round(1 / 3, 6), 0.0, 1.0)


def test_merge_boxes_gives_the_true_hull(spark):
    b = spark.createDataFrame([(1, "c", 10, 10, 10, 10), (1, "c", 5, 12, 5, 20)], "image_id long, class string, x int, y int, w int, h int")
    assert rows(ex.merge_boxes(b), "x", "y", "w", "h") == [(5, 10, 15, 22)]


def test_times_to_frames_keeps_what_exceeds_the_last_kept(spark):
    times = spark.createDataFrame([(0, i, f * 1.0) for i, f in enumerate([5, 6, 7])], "example_idx long, pos int, t double")
    frames = spark.createDataFrame([(0, f, f, f + 1) for f in range(20)], "example_idx long, frame int, s0 long, s1 long")
    assert rows(tl.times_to_frames(times, frames, 1.0), "lm_idx", "frame") == [(0, 0), (1, 6), (2, 8)]


def test_boundaries_to_segments_drops_empty_ones(spark):
    bits = spark.createDataFrame([(0, t, b) for t, b in enumerate([1, 0, 1, 1])], "example_idx long, t int, bit int")
    assert rows(tl.boundaries_to_segments(bits), "start", "end") == [(0, 2), (2, 3)]


def test_collapse(spark):
    best = [0, 3, 3, 0, 3, 5, 5, 0]
    s = spark.createDataFrame([(0, t, c, 1.0 if c == b else 0.0) for t, b in enumerate(best) for c in range(6)], "example_idx long, t int, class int, value double")
    assert rows(ev.ctc_collapse(s), "pos", "symbol") == [(0, 3), (1, 3), (2, 5)]


def test_edit_counts():
    assert edit_counts(list("abc"), list("axcd")) == (2, 1, 0, 1)
    assert edit_counts([], list("ab")) == (0, 0, 0, 2) and edit_counts(list("ab"), []) == (0, 0, 2, 0)


def test_grouping_against_pairs(spark):
    rng = np.random.default_rng(1)
    d = [(int(rng.integers(3)), int(rng.integers(2)), int(s), int(s + rng.integers(1, 4)), str(rng.choice(["a", "b", "c"]))) for s in rng.integers(0, 20, 40)]
    d = sorted(set(d))
    got = ev.grouping(spark.createDataFrame(d, "class_id int, example_idx long, onset int, offset int, ngram string")).first()
    apart = lambda x, y: x[1] != y[1] or x[3] <= y[2] or y[3] <= x[2]
    tok = lambda x: (x[1], x[2], x[3])
    found, gold, both = {}, {}, {}
    for x, y in itertools.permutations(d, 2):
        if x[0] == y[0]:
            found.setdefault(x[4], set()).add(tok(x))
        if x[4] == y[4] and apart(x, y):
            gold.setdefault(x[4], set()).add(tok(x))
            if x[0] == y[0]:
                both.setdefault(x[4], set()).add(tok(x))
    n = lambda s: {k: len(v) for k, v in s.items()}
    f, g, b = n(found), n(gold), n(both)
    p = sum(f[t] / sum(f.values()) * b.get(t, 0) / f[t] for t in f)
    r = sum(g[t] / sum(g.values()) * b.get(t, 0) / g[t] for t in g)
    assert (round(got.precision, 9), round(got.recall, 9)) == (round(p, 9), round(r, 9))


def test_gold_landmarks_skip_and_floor(spark):
    p = spark.createDataFrame([(0, 0, 0, "a", 0, 25), (0, 1, 0, "#", 25, 90), (0, 2, 1, "b", 90, 92)], "example_idx long, t int, word int, value string, begin int, end int")
    assert rows(tl.gold_landmarks(p), "lm_idx", "frame") == [(0, 0), (1, 2), (2, 3)]


def test_block_mean_rules():
    x = np.arange(7.0)[:, None]
    assert block_mean(x, 3).ravel().tolist() == [0.5, 2.5, 4.5]  # cut to 6
    assert block_mean(np.arange(8.0)[:, None], 3).ravel().tolist() == [1.0, 4.0, 20 / 3]  # last frame repeated to 9
    assert block_mean(np.array([[1.0], [2.0]]), 3).ravel().tolist() == [1.0, 1.0, 2.0]  # each frame repeated, then cut


def test_fourier_and_interpolation():
    t = np.arange(8) / 8
    x = np.cos(2 * math.pi * t)[:, None]
    assert np.allclose(fourier(x, 16)[::2], x) and np.allclose(fourier(fourier(x, 16), 8), x)
    assert np.allclose(interpolate(np.array([[0.0], [2.0]]), 3).ravel(), [0, 1, 2])


def test_dendrogram_merges_the_close_pair():
    x = np.array([[0.0], [0.1], [5.0], [9.0]])
    assert merge_levels(x, 1)[0] == [0, 2, 4]  # 0.1 and 4 are below both neighbours, 4.9 is not


def hmm_case(seed=3):
    rng = np.random.default_rng(seed)
    n, k, steps = 2, 3, 4
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return norm(rng.random((n, k))), norm(rng.random(n)), norm(rng.random((n, n))), rng.random((steps, k))


def test_hmm_against_all_paths():
    pi, init, trans, b = hmm_case()
    n, k = pi.shape
    total, gamma, xi = 0.0, np.zeros((len(b), n, k)), np.zeros((len(b), n, n))
    for path in itertools.product(itertools.product(range(n), range(k)), repeat=len(b)):
        p = 1.0
        for t, (i, c) in enumerate(path):
            if t == 0:
                p *= init[i] * pi[i, c]
            else:
                i0, c0 = path[t - 1]
                p *= trans[i, i] * (c == c0) if i == i0 else trans[i0, i] * pi[i, c]
            p *= b[t, c]
        total += p
        for t, (i, c) in enumerate(path):
            gamma[t, i, c] += p
            if t:
                xi[t, path[t - 1][0], i] += p
    e = kn.hmm_estep(pi, init, trans, b)
    assert np.isclose(e["loglik"], math.log(total))
    assert np.allclose(e["gamma"], gamma.sum(1) / total)
    assert np.allclose(e["trans"], (xi / total).sum(0))
    assert np.allclose(e["init"].sum(), len(b)) and np.isclose(e["trans"].sum(), len(b) - 1)
    for i in range(n):
        like = []
        for c in range(k):
            held = pi.copy()
            held[i] = np.eye(k)[c]
            like.append(kn.hmm_forward(held, init, trans, b)[1].sum() + math.log(pi[i, c]))
        assert np.allclose(e["concept"][i], np.exp(like - kn.log_sum_exp(np.array(like))))


def test_hmm_does_not_underflow():
    pi, init, trans, b = hmm_case()
    assert np.isfinite(kn.hmm_estep(pi, init, trans, np.tile(b * 1e-30, (100, 1)))["loglik"])


def test_viterbi_ties_take_the_lowest_region():
    assert kn.hmm_viterbi(np.full((3, 2), 0.5), np.full(3, 1 / 3), np.full((3, 3), 1 / 3), np.ones((4, 2)))[0].tolist() == [0, 0, 0, 0]


def test_tiny_pairs_align(spark):
    """Three captions and one-hot regions: position t belongs to region t."""
    caps, regions = [(0, 1), (1, 2), (2, 0)], np.eye(3)
    tokens = spark.createDataFrame([(e, t, w) for e, c in enumerate(caps) for t, w in enumerate(c)], "example_idx long, t int, w int")
    vectors = spark.createDataFrame([(e, i, [float(x) for x in regions[w]]) for e, c in enumerate(caps) for i, w in enumerate(c)], "example_idx long, idx int, vec array<double>")
    obs = (np.ones((3, 3)) + 0.2 * np.eye(3)) / 3.2
    params, mu, curve = md.train_hmm(tokens, vectors, regions, 3, 4, 0.0, 0.1, obs)
    assert all(b >= a - 1e-9 for a, b in zip(curve, curve[1:], strict=False))
    got = md.align_viterbi(md.pack_examples(tokens, md.posteriors(vectors, mu, 0.1)), params)
    assert rows(got, "example_idx", "t", "region") == [(e, t, t) for e in range(3) for t in range(2)]


def test_mixture_likelihood_rises(spark):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([(e, t, int(rng.integers(4))) for e in range(6) for t in range(3)], "example_idx long, t int, w int")
    q = spark.createDataFrame([(e, j, k, float(rng.random())) for e in range(6) for j in range(2) for k in range(3)], "example_idx long, j int, k int, q double")
    table = spark.createDataFrame([(w, k, 1 / 3 + 0.01 * ((w + k) % 3 - 1)) for w in range(4) for k in range(3)], "w int, k int, p double")
    out, curve = md.train_mixture(pairs, q, table, 4, 1e-6, 3)
    assert curve[-1] >= curve[0]
    assert all(abs(r.s - 1) < 1e-9 for r in out.groupBy("w").agg(F.sum("p").alias("s")).collect())


def test_crp_segmentation_covers_every_caption(spark):
    tok = spark.createDataFrame([(e, i, c) for e, s in enumerate(["abab", "ab", "cab"]) for i, c in enumerate(s)], "example_idx long, pos int, token string")
    out = md.crp_segment(tok, 1.0, 3, 1, 3)
    covered = out.groupBy("example_idx").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    assert rows(covered, "example_idx", "n") == [(0, 4), (1, 2), (2, 3)]
    again = md.crp_segment(tok.repartition(5), 1.0, 3, 1, 3)
    assert rows(out, "example_idx", "start", "end") == rows(again, "example_idx", "start", "end")


def test_gaussian_concepts_are_recovered(spark):
    c = spark.createDataFrame([(i // 4, i % 4, i % 3) for i in range(120)], "example_idx long, idx int, concept int")
    v = ex.synthetic_vectors(c, 2, 7)
    mu = md.matrix(md.kmeans(v, 3, 1))
    near = md.assign_nearest(v, mu).join(c, ["example_idx", "idx"])
    assert near.select("concept", "k").distinct().count() == 3


def test_log_marginal_is_the_product_of_predictives():
    x, mu0, var, var0 = np.array([[0.3], [1.2], [-0.5]]), np.zeros(1), 0.7, 2.0
    chain, n, total = 0.0, np.zeros(1), np.zeros((1, 1))
    for row in x:
        mean, prec = kn.component_posterior(n, total, mu0, var, var0)
        if not n[0]:
            prec = np.array([1 / (var + var0)])
        chain += kn.log_densities(row[None], mean, prec)[0, 0]
        n, total = n + 1, total + row
    assert np.isclose(chain, kn.log_marginal(3, x.sum(0), (x**2).sum(0), mu0, var, var0))


def test_expand_person(spark):
    e = spark.createDataFrame([(0, ["person", "dog"], "m ae n"), (1, ["person"], "x"), (2, ["dog"], "m ae n")], "example_idx long, concepts array<string>, phones string")
    rule = {"man": "m ae n"}
    assert rows(tx.expand_person(e, rule), "example_idx", "concepts") == [(0, ["dog", "man"]), (1, ["person"]), (2, ["dog"])]
    assert rows(tx.expand_person(e, rule, keep=False), "example_idx", "concepts")[1] == (1, [])


def test_stress_mark_and_unknown(spark):
    tok = spark.createDataFrame([(0, 0, "cat"), (0, 1, "zzz")], "example_idx long, pos int, token string")
    lex = spark.createDataFrame([("cat", ["ˈk", "ae", "t"])], "word string, phones array<string>")
    assert [r[2] for r in rows(tx.to_phones(tok, lex), "pos", "phone_pos", "phone")] == ["k", "ae", "t", "UNK"]


def test_power_law_invariants(spark):
    inst = spark.createDataFrame([(f"c{i % 5}", i) for i in range(500)], "concept string, instance long")
    s = ex.power_law_sample(inst, 1.0, 40, 3, 2)
    assert s.select("instance").distinct().count() == s.count()
    assert s.groupBy("example", "concept").count().where("count > 1").count() == 0


def test_folds_cover(spark):
    f = ex.assign_folds(spark.range(1000), 5, 1, "id")
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 5 and min(sizes) > 150


def test_top_k_and_recall(spark):
    m = [[3.0, 1.0], [2.0, 0.0]]
    s = spark.createDataFrame([(i, j, v) for i, r in enumerate(m) for j, v in enumerate(r)], "row long, col long, value double")
    assert rows(rt.recall_at_k(s, (1, 2)), "side", "k", "recall") == [("col", 1, 0.5), ("col", 2, 1.0), ("row", 1, 0.5), ("row", 2, 1.0)]
    assert rows(rt.top_k(s, 1), "side", "query", "hit") == [("col", 0, 0), ("col", 1, 0), ("row", 0, 0), ("row", 1, 0)]


@pytest.mark.parametrize("kind", ["sisa", "misa", "sima"])
def test_match_similarity(spark, kind):
    im = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [2.0])], "example_idx long, idx int, vec array<double>")
    cap = spark.createDataFrame([(0, 0, [2.0]), (0, 1, [3.0])], "example_idx long, idx int, vec array<double>")
    got = rt.match_similarity(im, cap, kind).first().value
    m = np.array([[2.0, 3.0], [4.0, 6.0]])
    assert got == {"sisa": m.mean(), "misa": m.max(0).mean(), "sima": m.max(1).mean()}[kind]


def test_snap_boundaries(spark):
    lm = spark.createDataFrame([(0, f) for f in (0, 10, 20)], "example_idx long, frame long")
    b = spark.createDataFrame([(0, x) for x in (0, 4, 5, 6, 19, 35)], "example_idx long, b long")
    assert rows(tl.snap_boundaries(b, lm), "b", "frame") == [(0, 0), (4, 0), (5, 0), (6, 10), (19, 20), (35, 20)]


def test_numbered_is_gapless_and_in_order(spark):
    from lexground.functions.ranking import numbered

    df = spark.createDataFrame([(f"w{i * 7919 % 1000:04d}",) for i in range(1000)], "word string").repartition(6)
    got = sorted((r.idx, r.word) for r in numbered(df, "word").collect())
    assert got == list(enumerate(sorted(f"w{i:04d}" for i in range(1000))))


def test_dendrogram_by_cosine():
    x = np.array([[1.0, 0.0], [2.0, 0.1], [0.0, 1.0], [-1.0, 0.0]])
    assert merge_levels(x, 1, "cosine")[0] == [0, 2, 3, 4]
    big = np.random.default_rng(1).normal(size=(50, 7))
    d = np.sqrt(((big[:, None] - big[None]) ** 2).sum(-1))
    gap = [np.inf, *(d[i - 1, i] for i in range(1, 50)), np.inf]
    assert merge_levels(big, 1)[0] == [0, *(i for i in range(1, 50) if not (gap[i] < gap[i - 1] and gap[i] < gap[i + 1])), 50]


def test_dropped_components_are_assigned_again(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0.0, 0.0], [9.0, 9.0], [0.4, 0.1]])
    labels = [0] * 9 + [1] * 8 + [2] * 3
    rows = [(i // 5, i % 5, [float(v) for v in centres[k] + rng.normal(0, 0.1, 2)], k) for i, k in enumerate(labels)]
    t = spark.createDataFrame(rows, "example_idx long, idx int, vec array<double>, k int")
    got = {(r.example_idx, r.idx): r.k for r in md.shrink_and_assign(t, t.select("example_idx", "idx", "k"), 2, np.zeros(2), 0.1, 4.0).collect()}
    assert [got[i // 5, i % 5] for i in range(20)] == [0] * 9 + [1] * 8 + [0] * 3


def test_power_law_leaves_nothing_over(spark):
    rows = [(c, c * 100 + i) for c, n in enumerate((30, 30, 9, 9, 9, 2)) for i in range(n)]
    got = ex.power_law_sample(spark.createDataFrame(rows, "concept int, instance int"), 1.0, 12, 3, 1).collect()
    assert len(got) == 36 and len({r.instance for r in got}) == 36 and len({(r.example, r.concept) for r in got}) == 36
    assert {sum(r.example == e for r in got) for e in range(12)} == {3}


def test_tokens_match_by_intervals(spark):
    """Against all pairs, with units of very different lengths."""
    rng = np.random.default_rng(11)
    pred, gold = ([(int(e), int(a), int(a + max(1, rng.integers(0, 2 ** rng.integers(0, 7)))), f"l{rng.integers(3)}") for e in range(3) for a in rng.choice(200, 25, replace=False)] for _ in range(2))
    schema = "example_idx long, start int, end int, label string"
    got = {(r.gold, r.pred): r.n for r in ev.token_confusion(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema)).collect()}
    want = {}
    for e, s, t, label in gold:
        fits = []
        for e2, a, b, other in pred:
            both = max(0, min(t, b) - max(s, a))
            if e2 == e and (abs(s - a) <= 1 and abs(t - b) <= 1 or both / (t - s + b - a - both) > 0.5):
                fits.append((a, b, other))
        if fits:
            key = label, min(fits)[2]
            want[key] = want.get(key, 0) + 1
    assert got == want
    ends = {(e, b) for e, _, b, _ in pred}
    assert ev.boundary_f1(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema)).first().hits == sum(any((e, t + k) in ends for k in range(-2, 3)) for e, _, t, _ in gold)


def test_edit_distances_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(2)), [f"s{x}" for x in rng.integers(0, 300, rng.integers(0, 6))]) for _ in range(40)]
    t = spark.createDataFrame(rows, "class_id int, phones array<string>")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    pairs = [distance(a, b) / max(1, len(a), len(b)) for (c, a), (d, b) in itertools.combinations(rows, 2) if c == d]
    for block in (1000, 7):
        r = ev.ned(t, block=block).first()
        assert r.pairs == len(pairs) and abs(r.ned - sum(pairs) / len(pairs)) < 1e-9


def test_scratch_folder_must_be_shared():
    from types import SimpleNamespace as Box

    from lexground.functions.scratch import scratch

    session = lambda master, root: Box(conf=Box(get=lambda *_: root), sparkContext=Box(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    assert scratch(session("yarn", "hdfs://x/y/"), "t").startswith("hdfs://x/y/t-") and scratch(session("local[2]", None), "t").startswith("file:")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:1"):
        with pytest.raises(ValueError):
            scratch(session(master, None), "t")


def test_retrieval_in_blocks(spark):
    """Small blocks give what the table of all scores gives; values are whole, so there are ties."""
    rng = np.random.default_rng(5)
    rows = [(e, i, [float(v) for v in rng.integers(0, 2, 3)]) for e in range(23) for i in range(2)]
    im = spark.createDataFrame(rows, "example_idx long, idx int, vec array<double>")
    cap = spark.createDataFrame([(e, i, v[::-1]) for e, i, v in rows], "example_idx long, idx int, vec array<double>")
    all_ = rt.match_similarity(im, cap, "misa").cache()
    assert rows_of(rt.recall_in_blocks(im, cap, "misa", (1, 3), 5)) == rows_of(rt.recall_at_k(all_, (1, 3)))
    assert rows_of(rt.best_in_blocks(im, cap, "misa", 2, 5)) == rows_of(rt.top_k(all_, 2))
    assert np.isclose(rt.softmax_loss_in_blocks(im, cap, "misa", 5).first().loss, rt.softmax_loss(all_).first().loss)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_own_priors_and_scaled_densities(spark):
    x, n = np.array([0.2, 0.9]), np.array([3.0, 1.0])
    total = np.array([[0.3, 0.3], [2.0, 2.0]])
    own = [math.log(0.1), math.log(0.9)]
    mean, prec = kn.component_posterior(n, total, np.zeros(2), 1.0, 2.0)
    d = kn.log_densities(x[None], mean, prec)[0]
    for prior in (None, own):
        schema = "example_idx long, idx int, vec array<double>" + (", prior array<double>" if prior else "")
        t = spark.createDataFrame([(0, 0, x.tolist(), *([prior] if prior else []))], schema)
        p = np.array(prior) if prior else kn.component_log_prior(n, 1.0)
        for scale in (False, True):
            want = np.log(np.exp(d + p).sum()) - (np.log(np.exp(d).sum()) if scale else 0)
            assert np.isclose(md.log_predictive(t, n, total, np.zeros(2), 1.0, 2.0, 1.0, scale).first().log_marginal, want)


def hmm_tables(spark, examples=12, frames=3, seed=4):
    """Two kinds of regions far apart; each token stands near its region's kind."""
    rng = np.random.default_rng(seed)
    kinds = [[int(k) for k in rng.permutation(2)] for _ in range(examples)]
    spot = np.array([[0.0, 0.0], [4.0, 4.0]])
    near = lambda k: [float(x) for x in spot[k] + rng.normal(0, 0.3, 2)]
    regions = [(e, i, near(k)) for e, own in enumerate(kinds) for i, k in enumerate(own)]
    said = [(e, t, own[t % 2]) for e, own in enumerate(kinds) for t in range(frames)]
    vec = "example_idx long, idx int, vec array<double>"
    return spark.createDataFrame(regions, vec), spark.createDataFrame(said, "example_idx long, t int, w int"), spark.createDataFrame([(e, t, near(k)) for e, t, k in said], vec), spot


def test_acoustic_training_moves_frame_centroids(spark):
    regions, _, frames, spot = hmm_tables(spark)
    start = spot + 0.5
    obs = np.array([[0.6, 0.4], [0.4, 0.6]])
    params, _, curve = md.train_hmm(None, regions, spot, 2, 4, 2.0, 1.0, obs, frames=frames, frame_centroids=start)
    assert np.abs(params["frames"] - spot).sum() < np.abs(start - spot).sum() and curve[-1] > curve[0]
    assert params["obs"][0, 0] > obs[0, 0] + 0.05 and params["obs"][1, 1] > obs[1, 1] + 0.05  # sharper each round


def test_symbol_counts_against_all_symbols(spark):
    """Soft symbols are a sum over hard ones: their posterior by trying each symbol at a frame."""
    pi, init, trans, _ = hmm_case()
    rng = np.random.default_rng(9)
    soft = rng.random((4, 2))
    obs = np.array([[0.7, 0.3], [0.2, 0.8], [0.5, 0.5]])
    e = spark.createDataFrame([(0, soft.tolist(), pi.tolist())], "example_idx long, tokens array<array<double>>, post array<array<double>>")
    got = {(r.idx, r.k): r.p for r in md.symbol_counts(e, {"init": {2: init}, "trans": {2: trans}, "obs": obs}).collect()}
    like = lambda x: math.exp(kn.hmm_estep(pi, init, trans, x @ obs.T)["loglik"])
    for t in range(4):
        for v in range(2):
            one = soft.copy()
            one[t] = 0
            one[t, v] = soft[t, v]
            assert np.isclose(got[t, v], like(one) / like(soft))


def test_training_on_segments_smooths_by_the_base(spark):
    regions, said, _, spot = hmm_tables(spark)
    base = np.array([2.0, 1.0, 1.0])
    params, _, _ = md.train_hmm(said, regions, spot, 3, 3, 0.0, 1.0, base=base, alpha=2.0)
    assert np.allclose(params["obs"].sum(1), 1) and (params["obs"][:, 2] > 0.01).all()
