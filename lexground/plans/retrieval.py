"""Queries of the retrieval operators: every image's regions against the first three regions of every image as a caption."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from . import fixtures as fx
from . import models as pm
from .evaluation import rounded

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return put


DOTS = f"{fx.REGIONS}, dt AS (SELECT b.example_idx AS row, a.example_idx AS col, a.idx AS i, b.idx AS f, list_dot_product(a.vec, b.vec) AS x FROM regions a, regions b)"
SISA = f"{DOTS}, sc AS (SELECT row, col, avg(x) AS value FROM dt GROUP BY ALL)"


def sides(spark, d):
    r = fx.regions(spark, d)
    return r, r


@register("r1_pairs", f"WITH {pm.TERMS}, x AS (SELECT c.example_idx AS row, q.example_idx AS col, j, t, sum(p * q) AS a FROM pairs c JOIN tb USING (w) JOIN q USING (k) GROUP BY ALL), m AS (SELECT row, col, j, greatest(max(a), 1e-30) AS m FROM x GROUP BY ALL) SELECT row, col, round(sum(ln(m)), 5) AS value FROM m GROUP BY ALL")
def r1_pairs(spark, d):
    q = pm.likelihoods(spark, d).withColumnRenamed("j", "idx")
    return rt.score_pairs(pm.pairs(spark, d), q, pm.start_table(spark, d)).withColumn("value", F.round("value", 5))


for _kind, _sql in (("sisa", "SELECT row, col, avg(x) AS value FROM dt GROUP BY ALL"), ("misa", "SELECT row, col, avg(m) AS value FROM (SELECT row, col, f, max(x) AS m FROM dt GROUP BY ALL) GROUP BY ALL"), ("sima", "SELECT row, col, avg(m) AS value FROM (SELECT row, col, i, max(x) AS m FROM dt GROUP BY ALL) GROUP BY ALL")):

    @register(f"r2_{_kind}", f"WITH {DOTS}, v AS ({_sql}) SELECT row, col, round(value, 5) + 0 AS value FROM v")
    def r2_similarity(spark, d, kind=_kind):
        return rt.match_similarity(*sides(spark, d), kind, digits=5)


@register("r3_top_k", f"WITH {SISA}, b AS (SELECT 'row' AS side, row AS query, col AS hit, value FROM sc UNION ALL SELECT 'col', col, row, value FROM sc), k AS (SELECT *, row_number() OVER (PARTITION BY side, query ORDER BY value DESC, hit) AS rank FROM b) SELECT side, query, hit, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def r3_top_k(spark, d):
    return rt.best_in_blocks(*sides(spark, d), "sisa", 5)


@register("r4_recall", f"""WITH {SISA}, o AS (SELECT row AS id, value AS v FROM sc WHERE row = col), r AS (SELECT 'row' AS side, row AS id, count(*) FILTER (value > v) + 1 AS rank FROM sc JOIN o ON row = id GROUP BY ALL UNION ALL SELECT 'col', col, count(*) FILTER (value > v) + 1 FROM sc JOIN o ON col = id GROUP BY ALL)
SELECT side, CAST(k AS INTEGER) AS k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM r, (VALUES (1), (5), (10)) n(k) GROUP BY ALL""")
def r4_recall(spark, d):
    return rounded(rt.recall_in_blocks(*sides(spark, d)), "recall")


@register("r5_matchmap", f"WITH {fx.REGIONS}, x AS (SELECT a.example_idx, b.idx AS f, a.idx AS region, row_number() OVER (PARTITION BY a.example_idx, b.idx ORDER BY list_dot_product(a.vec, b.vec) DESC, a.idx) AS r FROM regions a JOIN regions b ON a.example_idx = b.example_idx) SELECT example_idx, CAST(f * 4 + o AS INTEGER) AS t, region FROM x, range(0, 4) n(o) WHERE r = 1 AND f * 4 + o < 18")
def r5_matchmap(spark, d):
    im, cap = sides(spark, d)
    return rt.align_matchmap(im, cap, 4, im.select("example_idx").distinct().withColumn("n", F.lit(18)))


@register("r6_margin_loss")
def r6_margin_loss(spark, d):
    return rounded(rt.margin_loss(*sides(spark, d), "sisa", 1.0, 3), "loss")


@register("r6_softmax_loss", f"WITH {SISA}, a AS (SELECT row AS id, max(value) + ln(sum(exp(value - m))) AS z FROM (SELECT *, max(value) OVER (PARTITION BY row) AS m FROM sc) GROUP BY row), b AS (SELECT col AS id, max(value) + ln(sum(exp(value - m))) AS y FROM (SELECT *, max(value) OVER (PARTITION BY col) AS m FROM sc) GROUP BY col) SELECT round(-avg(2 * value - z - y), 5) AS loss FROM sc JOIN a ON row = a.id JOIN b ON row = b.id WHERE row = col")
def r6_softmax_loss(spark, d):
    return rt.softmax_loss_in_blocks(*sides(spark, d)).withColumn("loss", F.round("loss", 5))
