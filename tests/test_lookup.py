"""M1 for many partitions at once and lookups of hot and rare words, by brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexground.functions.lookup import looked_up
from lexground.operators import models as md
from lexground.operators import text as tx


def lloyd(x, mu, rounds):
    for _ in range(rounds):
        near = ((x[:, None] - mu[None]) ** 2).sum(2).argmin(1)
        mu = np.array([x[near == k].mean(0) if (near == k).any() else mu[k] for k in range(len(mu))])
    return mu


def test_rounds_of_all_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{i % 7}" if i % 50 else None, rng.normal(size=3).tolist()) for i in range(700)]
    v = spark.createDataFrame(rows, "part string, vec array<double>").repartition(5)
    start = {f"p{g}": rng.normal(size=(4, 3)) for g in range(7)}
    start["p3"][2] += 100  # nothing is near this one
    table = spark.createDataFrame([(p, k, m.tolist()) for p, mu in start.items() for k, m in enumerate(mu)], "part string, k int, vec array<double>")
    got = {(r.part, r.k): r.vec for r in md.kmeans(v, 4, partition="part", rounds=5, tol=0.0, start=table).collect()}
    for p, mu in start.items():
        want = lloyd(np.array([x for q, x in rows if q == p]), mu, 5)
        assert all(np.allclose(got[p, k], want[k]) for k in range(4))
    assert len(got) == 28


def test_jobs_do_not_grow_with_the_partitions(spark):
    rng = np.random.default_rng(2)
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for parts in (2, 40):
        v = spark.createDataFrame([(i % parts, rng.normal(size=2).tolist()) for i in range(400)], "part int, vec array<double>")
        spark.sparkContext.setJobGroup(f"parts-{parts}", "kmeans")
        assert md.kmeans(v, 2, 1, "part", rounds=2, tol=0.0).count() == 2 * parts
        counts.append(len(tracker.getJobIdsForGroup(f"parts-{parts}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_start_of_few_and_equal_vectors(spark):
    v = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (0, [5.0]), (1, [2.0]), (1, None)], "part int, vec array<double>")
    got = sorted(map(tuple, md.kmeans(v.where("vec IS NOT NULL"), 3, 1, "part").select("part", "vec").collect()))
    assert got == [(0, [1.0]), (0, [5.0]), (1, [2.0])]
    assert md.kmeans(v.limit(0), 3).count() == 0


def test_far_clusters_are_found(spark):
    rng = np.random.default_rng(4)
    middle = np.array([[0, 0], [9, 0], [0, 9], [9, 9.0]])
    v = spark.createDataFrame([(i, (middle[i % 4] + rng.normal(0, 0.1, 2)).tolist()) for i in range(200)], "id int, vec array<double>")
    found = np.array([r.vec for r in md.kmeans(v, 4, 3).collect()])
    assert all(np.abs(found - m).sum(1).min() < 0.2 for m in middle)


def words(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice(["the", "the", "the", "of", None, f"w{rng.randrange(300)}"])) for i in range(n)]


def test_hot_and_rare_words_are_looked_up_alike(spark):
    rows = words(1, 3000)
    tokens = spark.createDataFrame(rows, "i int, token string").repartition(4)
    table = spark.createDataFrame([("the", "T"), *[(f"w{k}", f"v{k}") for k in range(0, 300, 2)]], "word string, value string")
    held = dict(table.collect())
    want = sorted((i, repr(held.get(t))) for i, t in rows)
    for most in (1, 20, 10_000):
        got = looked_up(tokens, table, most=most)
        assert got.columns == ["i", "token", "value"]
        assert sorted((r.i, repr(r.value)) for r in got.collect()) == want
    assert looked_up(tokens, table.limit(0)).where("value IS NOT NULL").count() == 0


def test_small_tables_move_no_token(spark):
    tokens = spark.createDataFrame([(0, i, f"W{i}") for i in range(50)], "example_idx long, pos int, token string")
    lemmas = spark.createDataFrame([("w1", "w"), ("w2", "x")], "word string, lemma string")
    stop = spark.createDataFrame([("x",)], "word string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    out = tx.normalize_tokens(tokens, lemmas, stop)
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plan and out.count() == 49
    assert {r.token for r in out.where("pos < 4").collect()} == {"w0", "w", "w3"}


def test_rare_tokens_alone_are_dealt_out(spark):
    tokens = spark.createDataFrame(words(3, 2000), "i int, token string")
    table = spark.createDataFrame([(f"w{k}", k) for k in range(300)], "word string, value int")
    moved = looked_up(tokens, table, most=50)
    assert moved.where(F.col("token") == "the").count() == sum(t == "the" for _, t in words(3, 2000))
