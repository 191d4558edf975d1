"""Queries of the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..operators import reports as rp
from . import fixtures as fx
from .evaluation import rounded, value
from .fixtures import REGIONS, RUNS, UNITS

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return put


@register("d1_concepts", "SELECT p_brand AS concept, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part WHERE p_brand <> 'Brand#1' GROUP BY p_brand ORDER BY n DESC, concept LIMIT 12")
def d1_concepts(spark, d):
    return rounded(rp.concept_distribution(fx.table(spark, d, "part").select(F.col("p_brand").alias("concept")), 12, "Brand#1"), "share")


@register("d2_lengths", f"WITH {RUNS}, l AS (SELECT e - s AS length, count(*) AS n FROM gr GROUP BY 1) SELECT CAST(length AS INTEGER) AS length, n, round(n / sum(n) OVER (), 6) AS share, round(sum(length * n) OVER () / sum(n) OVER (), 6) AS mean FROM l")
def d2_lengths(spark, d):
    return rounded(rp.length_distribution(value(fx.units(spark, d), "gold")), "share", "mean")


F1 = f"{UNITS}, f AS (SELECT concept, count(*) FILTER (gold = concept) AS n, count(*) FILTER (pred = concept) AS m, count(*) FILTER (gold = concept AND pred = concept) AS h FROM units, (SELECT DISTINCT gold AS concept FROM units) GROUP BY concept), f1 AS (SELECT concept, n, h / n AS recall, h / m AS precision, 2 * (h / n) * (h / m) / (h / n + h / m) AS f1 FROM f)"


def f1(spark, d):
    return rp.concept_f1(fx.units(spark, d))


@register("d3_concept_f1", f"WITH {F1} SELECT concept, n, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM f1")
def d3_concept_f1(spark, d):
    return rounded(f1(spark, d), "recall", "precision", "f1")


@register("d3_best_and_worst", f"WITH {F1} SELECT * FROM (SELECT 'best' AS side, concept, round(f1, 6) AS f1 FROM f1 ORDER BY f1.f1 DESC, concept LIMIT 2) UNION ALL SELECT * FROM (SELECT 'worst', concept, round(f1, 6) FROM f1 ORDER BY f1.f1, concept LIMIT 2)")
def d3_best_and_worst(spark, d):
    return rounded(rp.best_and_worst(f1(spark, d), 2).select("side", "concept", "f1"), "f1")


@register("d4_by_frequency", f"WITH {F1}, b AS (SELECT *, ntile(3) OVER (ORDER BY n, concept) AS bin FROM f1) SELECT CAST(bin AS INTEGER) AS bin, min(n) AS lowest, max(n) AS highest, round(avg(f1), 6) AS f1 FROM b GROUP BY bin")
def d4_by_frequency(spark, d):
    return rounded(rp.f1_by_frequency(f1(spark, d), 3), "f1")


@register("d5_histogram", f"WITH {F1} SELECT CAST(least(floor(f1 * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM f1 GROUP BY 1")
def d5_histogram(spark, d):
    return rp.f1_histogram(f1(spark, d))


@register("d6_counts_by_iteration", f"WITH {UNITS} SELECT gold AS word, CAST(count(*) FILTER (t % 3 = 0) AS BIGINT) AS \"0\", CAST(count(*) FILTER (t % 3 = 1) AS BIGINT) AS \"1\", CAST(count(*) FILTER (t % 3 = 2) AS BIGINT) AS \"2\" FROM units WHERE gold IN ('view', 'click') GROUP BY gold")
def d6_counts_by_iteration(spark, d):
    u = fx.units(spark, d).select((F.col("t") % 3).alias("iteration"), F.col("gold").alias("word"), F.lit(1).alias("weight"))
    return rp.counts_by_iteration(u, u.select("word").distinct().where("word in ('view', 'click')"), [0, 1, 2])


@register("d7_curves", f"WITH {UNITS} SELECT gold AS model, CAST(t % 4 AS INTEGER) AS iteration, round(avg(dur), 6) AS value FROM units GROUP BY ALL")
def d7_curves(spark, d):
    path = scratch(spark, "curves")
    rows = fx.units(spark, d).groupBy(F.col("gold").alias("model"), (F.col("t") % 4).alias("i")).agg(F.avg("dur").alias("v"))
    rows.write.partitionBy("model").csv(path)
    return rounded(rp.curves(spark, f"{path}/model=*", "v"), "value")


SC = f"{REGIONS}, s AS (SELECT example_idx, idx AS t, unnest(range(0, 64)) AS i, unnest(vec) AS v FROM regions)"


def weights(spark, d, absolute: bool):
    s = fx.regions(spark, d).select("example_idx", F.col("idx").alias("t"), F.posexplode("vec").alias("i", "value"))
    return s.withColumn("value", F.abs("value")) if absolute else s


@register("d8_weights", f"WITH {SC} SELECT example_idx, t, CAST(i AS INTEGER) AS i, round(abs(v) / sum(abs(v)) OVER (PARTITION BY example_idx, t), 6) AS weight FROM s")
def d8_weights(spark, d):
    return rounded(rp.alignment_weights(weights(spark, d, True)), "weight")


@register("d8_softmax_weights", f"WITH {SC} SELECT example_idx, t, CAST(i AS INTEGER) AS i, round(exp(v / 0.5) / sum(exp(v / 0.5)) OVER (PARTITION BY example_idx, t), 6) AS weight FROM s")
def d8_softmax_weights(spark, d):
    return rounded(rp.alignment_weights(weights(spark, d, False), 0.5), "weight")


@register("d8_gold_matrix", f"WITH {REGIONS} SELECT example_idx, idx AS t, CAST(i AS INTEGER) AS i, CASE WHEN i = label THEN 1 ELSE 0 END AS weight FROM regions, range(0, 10) r(i)")
def d8_gold_matrix(spark, d):
    r = fx.regions(spark, d)
    return rp.gold_matrix(r.select("example_idx", F.col("idx").alias("t"), F.col("label").alias("value")), r.select("example_idx").distinct().withColumn("n", F.lit(10)))
