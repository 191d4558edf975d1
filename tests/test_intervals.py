"""Interval joins on grids and sweeps against all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexground.operators import evaluation as ev
from lexground.operators import timeline as tl


def some(rng, n, examples, longest, whole=True):
    out = []
    for _ in range(n):
        a = rng.randrange(60) if whole else rng.random() * 60
        out.append((rng.randrange(examples), a, a + (rng.choice([0, 1, 2, 5, longest]) if whole else rng.random() * longest)))
    return out


def frame(spark, rows, a="start", b="end", kind="long", **more):
    out = spark.createDataFrame(rows, f"example_idx long, {a} {kind}, {b} {kind}")
    return out.select("*", *[F.lit(v).alias(k) for k, v in more.items()])


@pytest.mark.parametrize(("seed", "whole"), [(1, True), (2, True), (3, False)])
def test_join_is_all_pairs_that_meet(spark, seed, whole):
    rng, kind = random.Random(seed), "long" if whole else "double"
    left, right = some(rng, 60, 4, 40, whole), some(rng, 70, 4, 25, whole)
    left += left[:3]
    got = sorted(map(tuple, tl.interval_join(frame(spark, left, kind=kind), frame(spark, right, "rs", "re", kind)).select("example_idx", "start", "end", "rs", "re").collect()))
    assert got == sorted((e, a, b, c, d) for e, a, b in left for f, c, d in right if e == f and c <= b and d >= a)


def test_join_of_nothing(spark):
    none = frame(spark, [(0, 1, 2)]).limit(0)
    assert tl.interval_join(none, frame(spark, [(0, 1, 2)], "rs", "re")).count() == 0
    assert tl.interval_join(frame(spark, [(0, 1, 2)]), none.withColumnsRenamed({"start": "rs", "end": "re"})).count() == 0
    assert ev.word_iou(frame(spark, [(0, 1, 2)]), none).first().iou == 0.0


def overlap(a, b, c, d):
    return max(0, min(b, d) - max(a, c))


@pytest.mark.parametrize("seed", [4, 5])
def test_iou_and_coverage_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pred, gold = some(rng, 50, 3, 30), some(rng, 50, 3, 30)
    hull = lambda p, g: max(p[2], g[2]) - min(p[1], g[1])
    iou = lambda p, g: 1.0 if hull(p, g) == 0 else overlap(*p[1:], *g[1:]) / hull(p, g)
    best = [max((iou(p, g) for g in gold if g[0] == p[0]), default=0.0) for p in set(pred)]
    assert abs(ev.word_iou(frame(spark, pred), frame(spark, gold)).first().iou - sum(best) / len(best)) < 1e-12
    row = ev.coverage(frame(spark, pred), frame(spark, gold)).first()
    assert (row.covered, row.n) == (sum(any(p[0] == g[0] and p[1] <= g[1] and p[2] >= g[2] for p in pred) for g in gold), len(gold))


def test_one_example_of_many_intervals(spark):
    """A hundred thousand intervals of one example, with a few long ones among them, take seconds."""
    n = 100_000
    base = spark.range(n).select(F.lit(0).cast("long").alias("example_idx"), (F.col("id") * 10).alias("start"))
    pred = base.select("example_idx", "start", (F.col("start") + F.when(F.col("start") % 100_000 == 0, 4000).otherwise(9)).alias("end"))
    gold = base.select("example_idx", (F.col("start") + 3).alias("start"), (F.col("start") + 12).alias("end"))
    words = gold.select("example_idx", "start", "end", F.lit("a").alias("ngram"))
    began = time.time()
    assert 0.4 < ev.word_iou(pred, gold).first().iou < 0.6
    assert ev.coverage(pred, gold).first().covered > 0
    assert ev.token_type(pred.withColumn("ngram", F.lit("a")), words).first().token_precision > 0.9
    assert ev.transcribe(pred, gold.withColumn("phone", F.lit("p"))).count() == n
    assert time.time() - began < 90
    plan = tl.interval_join(pred, gold.withColumnsRenamed({"start": "rs", "end": "re"}))._jdf.queryExecution().executedPlan().toString()
    assert "_cell" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_frame_accuracy_makes_no_row_a_frame(spark):
    """Sides of different units, nulls and units without frames, against the join of all frames; and units of a billion frames."""
    rng = random.Random(5)
    side = lambda: [(x, t, rng.choice(["a", "b", None]), rng.choice([0, 1, 2, 7])) for x in range(9) for t in range(rng.randrange(12))]
    pred, gold = (spark.createDataFrame(side(), "example_idx long, t int, value string, dur int") for _ in range(2))
    want = ev.alignment_accuracy(tl.expand_to_frames(pred), tl.expand_to_frames(gold), "frame").first()
    got = ev.frame_accuracy(tl.unit_spans(pred), tl.unit_spans(gold)).first()
    assert got.n == want.n > 0 and got.accuracy == pytest.approx(want.accuracy)
    none = ev.frame_accuracy(tl.unit_spans(pred.limit(0)), tl.unit_spans(gold)).first()
    assert none.n == 0 and none.accuracy is None
    long = [spark.createDataFrame([(1, 0, "a", n), (1, 1, "b", 3_000_000_000 - n)], "example_idx long, t int, value string, dur long") for n in (1_000_000_000, 2_000_000_000)]
    assert tuple(ev.frame_accuracy(*map(tl.unit_spans, long)).first()) == (pytest.approx(2 / 3), 3_000_000_000)
