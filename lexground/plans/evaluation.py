"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import timeline as tl
from . import fixtures as fx
from .fixtures import RUNS, UNITS

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return put


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def both(spark, d):
    u = fx.units(spark, d)
    return tl.runs(u, "pred").withColumnRenamed("pred", "label"), tl.runs(u, "gold").withColumnRenamed("gold", "label")


def value(df, name):
    return df.select("example_idx", "t", F.col(name).alias("value"), "dur")


CONF = f"{UNITS}, c AS (SELECT pred, gold, count(*) AS n FROM units GROUP BY ALL)"
MACRO = """r AS (SELECT avg(x) AS recall FROM (SELECT max(n) / sum(n) AS x FROM {c} GROUP BY {g})), p AS (SELECT avg(x) AS precision FROM (SELECT max(n) / sum(n) AS x FROM {c} GROUP BY {p}))
SELECT round(recall, 6) AS recall, round(precision, 6) AS precision, round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r, p"""
IOU = "CASE WHEN greatest({e1}, {e2}) - least({s1}, {s2}) = 0 THEN 1.0 ELSE greatest(0, least({e1}, {e2}) - greatest({s1}, {s2})) / (greatest({e1}, {e2}) - least({s1}, {s2})) END"
G_P = IOU.format(s1="g.s", e1="g.e", s2="p.s", e2="p.e")


@register("e1_confusion", f"WITH {CONF} SELECT pred, gold, n, round(n / sum(n) OVER (PARTITION BY gold), 6) AS share FROM c")
def e1_confusion(spark, d):
    return rounded(ev.confusion(fx.units(spark, d)), "share")


@register("e1_purity", f"WITH {CONF} SELECT round(avg(m), 6) AS purity FROM (SELECT gold, max(n) / sum(n) AS m FROM c GROUP BY gold)")
def e1_purity(spark, d):
    return rounded(ev.purity(ev.confusion(fx.units(spark, d))), "purity")


@register("e2_cluster_f1", f"WITH {CONF}, {MACRO.format(c='c', g='gold', p='pred')}")
def e2_cluster_f1(spark, d):
    return rounded(ev.cluster_f1(ev.confusion(fx.units(spark, d))), "recall", "precision", "f1")


@register("e3_word_confusion", f"""WITH {RUNS}, v AS (SELECT g.example_idx, g.s, g.label AS gold, u.pred, count(*) AS n FROM gr g JOIN units u ON g.example_idx = u.example_idx AND u.t >= g.s AND u.t < g.e GROUP BY ALL),
m AS (SELECT gold, pred FROM (SELECT *, row_number() OVER (PARTITION BY example_idx, s ORDER BY n DESC, pred) AS k FROM v) WHERE k = 1), c AS (SELECT pred, gold, count(*) AS n FROM m GROUP BY ALL)
SELECT pred, gold, n, round(n / sum(n) OVER (PARTITION BY gold), 6) AS share FROM c""")
def e3_word_confusion(spark, d):
    return rounded(ev.word_confusion(fx.units(spark, d)), "share")


@register("e4_alignment_f1", f"WITH {UNITS}, r AS (SELECT gold, greatest(sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) / count(*), 1e-17) AS x FROM units WHERE t < 2000 GROUP BY gold) SELECT round(count(*) / sum(1 / x), 6) AS f1 FROM r")
def e4_alignment_f1(spark, d):
    return rounded(ev.alignment_f1(fx.units(spark, d), 2000), "f1")


@register("e5_accuracy", f"WITH {UNITS} SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM units")
def e5_accuracy(spark, d):
    u = fx.units(spark, d)
    return rounded(ev.alignment_accuracy(value(u, "pred"), value(u, "gold")), "accuracy")


@register("e5_frame_accuracy", f"WITH {UNITS} SELECT round(sum(CASE WHEN gold = pred THEN dur ELSE 0 END) / sum(dur), 6) AS accuracy, CAST(sum(dur) AS BIGINT) AS n FROM units")
def e5_frame_accuracy(spark, d):
    u = fx.units(spark, d)
    return rounded(ev.frame_accuracy(tl.unit_spans(value(u, "pred")), tl.unit_spans(value(u, "gold"))), "accuracy")


@register("e6_word_iou", f"WITH {RUNS}, b AS (SELECT p.example_idx, p.s, max({G_P}) AS best FROM pr p LEFT JOIN gr g ON p.example_idx = g.example_idx GROUP BY ALL) SELECT round(avg(best), 6) AS iou FROM b")
def e6_word_iou(spark, d):
    return rounded(ev.word_iou(*both(spark, d)), "iou")


@register("e7_boundary_f1", f"""WITH {RUNS}, h AS (SELECT count(*) AS hits FROM gr g WHERE EXISTS (SELECT 1 FROM pr p WHERE p.example_idx = g.example_idx AND abs(p.e - g.e) <= 1)), n AS (SELECT (SELECT count(*) FROM gr) AS n_gold, (SELECT count(*) FROM pr) AS n_pred)
SELECT hits, n_gold, n_pred, round(hits / n_gold, 6) AS recall, round(hits / n_pred, 6) AS precision, round(2 * (hits / n_gold) * (hits / n_pred) / (hits / n_gold + hits / n_pred), 6) AS f1 FROM h, n""")
def e7_boundary_f1(spark, d):
    return rounded(ev.boundary_f1(*both(spark, d), tol=1), "recall", "precision", "f1")


TOKEN = f"""{RUNS}, m AS (SELECT g.label AS gold, p.label AS pred, row_number() OVER (PARTITION BY g.example_idx, g.s ORDER BY p.s) AS k FROM gr g JOIN pr p ON g.example_idx = p.example_idx AND ((abs(g.s - p.s) <= 1 AND abs(g.e - p.e) <= 1) OR {G_P} > 0.5)),
c AS (SELECT gold, pred, count(*) AS n FROM m WHERE k = 1 GROUP BY ALL)"""


@register("e8_token_confusion", f"WITH {TOKEN} SELECT * FROM c")
def e8_token_confusion(spark, d):
    return ev.token_confusion(*both(spark, d))


@register("e8_macro_scores", f"WITH {TOKEN}, {MACRO.format(c='c', g='pred', p='gold')}")
def e8_macro_scores(spark, d):
    return rounded(ev.macro_scores(ev.token_confusion(*both(spark, d))), "recall", "precision", "f1")


@register("e9_boundary_sets", f"""WITH {RUNS}, f AS (SELECT count(*) AS found FROM (SELECT * FROM ((SELECT example_idx, s AS b FROM pr INTERSECT SELECT example_idx, s FROM gr) UNION (SELECT example_idx, e FROM pr INTERSECT SELECT example_idx, e FROM gr)))),
n AS (SELECT count(*) AS n_disc FROM (SELECT example_idx, s FROM pr UNION SELECT example_idx, e FROM pr)), m AS (SELECT count(*) AS n_gold FROM (SELECT example_idx, s FROM gr UNION SELECT example_idx, e FROM gr))
SELECT found, n_disc, n_gold, round(found / n_disc, 6) AS precision, round(found / n_gold, 6) AS recall, round(2 * (found / n_disc) * (found / n_gold) / (found / n_disc + found / n_gold), 6) AS f1 FROM f, n, m""")
def e9_boundary_sets(spark, d):
    return rounded(ev.boundary_sets(*both(spark, d)), "precision", "recall", "f1")


#: Predicted runs with the gold labels inside as phones.
GRAMS = f"""{RUNS}, iv AS (SELECT p.label AS class_id, p.example_idx, p.s, p.e, string_agg(u.gold, ',' ORDER BY u.t) AS ngram FROM pr p JOIN units u ON p.example_idx = u.example_idx AND u.t >= p.s AND u.t < p.e GROUP BY ALL),
wd AS (SELECT g.example_idx, g.s, g.e, string_agg(u.gold, ',' ORDER BY u.t) AS ngram FROM gr g JOIN units u ON g.example_idx = u.example_idx AND u.t >= g.s AND u.t < g.e GROUP BY ALL)"""


def phones(spark, d):
    return fx.units(spark, d).select("example_idx", F.col("t").alias("start"), (F.col("t") + 1).alias("end"), F.col("gold").alias("phone"))


def intervals(spark, d):
    pred, gold = both(spark, d)
    return ev.transcribe(pred.withColumnRenamed("label", "class_id"), phones(spark, d)), ev.transcribe(gold.select("example_idx", "start", "end"), phones(spark, d))


@register("e10_grouping", f"""WITH {GRAMS}, apart AS (SELECT a.example_idx AS x, a.s, a.ngram, a.class_id, b.class_id AS other FROM iv a JOIN iv b ON a.ngram = b.ngram AND (a.example_idx <> b.example_idx OR a.e <= b.s OR b.e <= a.s)),
gold AS (SELECT ngram, count(DISTINCT (x, s)) AS n FROM apart GROUP BY ngram), mix AS (SELECT ngram, count(DISTINCT (x, s)) AS n FROM apart WHERE class_id = other GROUP BY ngram),
found AS (SELECT ngram, count(DISTINCT (example_idx, s)) AS n FROM iv WHERE class_id IN (SELECT class_id FROM iv GROUP BY class_id HAVING count(*) > 1) GROUP BY ngram),
s AS (SELECT coalesce((SELECT sum(mix.n) FROM mix JOIN found USING (ngram)) / (SELECT sum(n) FROM found), 0) AS p, coalesce((SELECT sum(mix.n) FROM mix JOIN gold USING (ngram)) / (SELECT sum(n) FROM gold), 0) AS r)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""")
def e10_grouping(spark, d):
    return rounded(ev.grouping(intervals(spark, d)[0]), "precision", "recall", "f1")


@register("e11_token_type", f"""WITH {GRAMS}, o AS (SELECT iv.example_idx, iv.s, iv.ngram, wd.s AS ws, wd.ngram AS wn, row_number() OVER (PARTITION BY iv.example_idx, iv.s ORDER BY least(iv.e, wd.e) - greatest(iv.s, wd.s) DESC, wd.s) AS k
FROM iv JOIN wd ON iv.example_idx = wd.example_idx AND wd.s < iv.e AND wd.e > iv.s), h AS (SELECT count(DISTINCT (example_idx, ws)) AS a, count(DISTINCT ngram) AS b FROM o WHERE k = 1 AND ngram = wn),
n AS (SELECT count(*) AS c, count(DISTINCT ngram) AS d FROM iv), m AS (SELECT count(*) AS e, count(DISTINCT ngram) AS f FROM wd)
SELECT round(a / c, 6) AS token_precision, round(a / e, 6) AS token_recall, round(2 * (a / c) * (a / e) / (a / c + a / e), 6) AS token_f1, round(b / d, 6) AS type_precision, round(b / f, 6) AS type_recall, round(2 * (b / d) * (b / f) / (b / d + b / f), 6) AS type_f1 FROM h, n, m""")
def e11_token_type(spark, d):
    found, words = intervals(spark, d)
    return rounded(ev.token_type(found, words), "token_precision", "token_recall", "token_f1", "type_precision", "type_recall", "type_f1")


@register("e12_coverage", f"WITH {RUNS}, c AS (SELECT count(*) AS covered FROM units u WHERE EXISTS (SELECT 1 FROM pr p WHERE p.example_idx = u.example_idx AND p.e - p.s > 1 AND p.s <= u.t AND p.e > u.t)), n AS (SELECT count(*) AS n FROM units) SELECT covered, n, round(covered / n, 6) AS coverage FROM c, n")
def e12_coverage(spark, d):
    return rounded(ev.coverage(both(spark, d)[0].where("end - start > 1"), phones(spark, d)), "coverage")


@register("e12_ned", f"""WITH {GRAMS}, k AS (SELECT class_id, string_agg(left(x, 1), '' ORDER BY i) AS w, example_idx, s FROM (SELECT *, unnest(string_split(ngram, ',')) AS x, unnest(range(1, CAST(len(string_split(ngram, ',')) + 1 AS BIGINT))) AS i FROM iv) GROUP BY class_id, example_idx, s),
c AS (SELECT class_id, w, count(*) AS n FROM k GROUP BY ALL), p AS (SELECT a.n * b.n AS n, levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w)) AS x FROM c a JOIN c b ON a.class_id = b.class_id AND a.w < b.w UNION ALL SELECT n * (n - 1) / 2, 0 FROM c)
SELECT CAST(sum(n) AS BIGINT) AS pairs, round(sum(n * x) / sum(n), 6) AS ned FROM p""")
def e12_ned(spark, d):
    found = intervals(spark, d)[0]
    return rounded(ev.ned(found.select("class_id", F.split("ngram", ",").alias("phones"))), "ned")


@register("e13_error_rate", f"""WITH {UNITS}, w AS (SELECT example_idx, string_agg(left(gold, 1), '' ORDER BY t) AS a, string_agg(left(pred, 1), '' ORDER BY t) AS b FROM units GROUP BY example_idx)
SELECT CAST(sum(length(a)) AS BIGINT) AS ref_length, CAST(sum(levenshtein(a, b)) AS BIGINT) AS distance, round(sum(levenshtein(a, b)) / sum(length(a)), 6) AS rate FROM w""")
def e13_error_rate(spark, d):
    seq = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("t", c))), lambda x: x[c])
    pairs = fx.units(spark, d).groupBy("example_idx").agg(seq("gold").alias("ref"), seq("pred").alias("hyp"))
    return rounded(ev.error_rate(pairs).select("ref_length", "distance", "rate"), "rate")


SCORES = f"{fx.REGIONS}, scores AS (SELECT example_idx, idx AS t, unnest(range(0, 64)) AS class, unnest(vec) AS value FROM regions)"


@register("e14_ctc_collapse", f"""WITH {SCORES}, b AS (SELECT example_idx, t, CAST(class AS INTEGER) AS symbol FROM (SELECT *, row_number() OVER (PARTITION BY example_idx, t ORDER BY value DESC, class) AS k FROM scores) WHERE k = 1),
f AS (SELECT * FROM (SELECT *, lag(symbol) OVER (PARTITION BY example_idx ORDER BY t) AS was FROM b) WHERE (was IS NULL OR was <> symbol) AND symbol <> 0)
SELECT example_idx, CAST(row_number() OVER (PARTITION BY example_idx ORDER BY t) - 1 AS INTEGER) AS pos, symbol FROM f""")
def e14_ctc_collapse(spark, d):
    return ev.ctc_collapse(fx.regions(spark, d).select("example_idx", F.col("idx").alias("t"), F.posexplode("vec").alias("class", "value")))


@register("e15_prf", f"""WITH {UNITS}, c AS (SELECT CAST(example_idx % 5 AS INTEGER) AS fold, sum(CASE WHEN gold = 'view' AND pred = 'view' THEN 1 ELSE 0 END) AS h, sum(CASE WHEN pred = 'view' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN gold = 'view' THEN 1 ELSE 0 END) AS g FROM units GROUP BY 1)
SELECT fold, round(h / f, 6) AS precision, round(h / g, 6) AS recall, round(2 * (h / f) * (h / g) / (h / f + h / g), 6) AS f1 FROM c""")
def e15_prf(spark, d):
    is_ = lambda c: (F.col(c) == "view").cast("int")
    counts = fx.units(spark, d).groupBy((F.col("example_idx") % 5).cast("int").alias("fold")).agg(F.sum(is_("gold") * is_("pred")).alias("h"), F.sum(is_("pred")).alias("f"), F.sum(is_("gold")).alias("g"))
    return rounded(ev.prf(counts, "h", "f", "g"), "precision", "recall", "f1")


@register("e16_fold_summary", f"WITH {UNITS}, s AS (SELECT gold AS model, example_idx % 5 AS fold, avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END) AS value FROM units GROUP BY ALL) SELECT model, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, count(*) AS folds FROM s GROUP BY model")
def e16_fold_summary(spark, d):
    s = fx.units(spark, d).groupBy(F.col("gold").alias("model"), F.col("example_idx") % 5).agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("value"))
    return rounded(ev.fold_summary(s), "mean", "deviation")


@register("e17_roc", f"""WITH {UNITS}, s AS (SELECT pred AS concept, dur AS score, sum(CASE WHEN gold = pred THEN 1 ELSE 0 END) AS p, sum(CASE WHEN gold <> pred THEN 1 ELSE 0 END) AS n FROM units GROUP BY ALL)
SELECT concept, score, round(sum(p) OVER w / greatest(sum(p) OVER (PARTITION BY concept), 1), 6) AS tpr, round(sum(n) OVER w / greatest(sum(n) OVER (PARTITION BY concept), 1), 6) AS fpr FROM s WINDOW w AS (PARTITION BY concept ORDER BY score DESC)""")
def e17_roc(spark, d):
    return rounded(ev.roc(fx.units(spark, d).select(F.col("pred").alias("concept"), (F.col("gold") == F.col("pred")).alias("truth"), F.col("dur").alias("score"))), "tpr", "fpr")


@register("e18_class_accuracy", f"WITH {UNITS} SELECT gold, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM units GROUP BY gold ORDER BY 2 DESC, 1 LIMIT 10")
def e18_class_accuracy(spark, d):
    return rounded(ev.class_accuracy(fx.units(spark, d)), "accuracy")


@register("e19_posterior_gap", "WITH r AS (SELECT CAST(label AS INTEGER) AS iteration, unnest(CAST(embedding[1:32] AS DOUBLE[])) AS a, unnest(CAST(embedding[33:64] AS DOUBLE[])) AS b FROM embeddings) SELECT iteration, round(sum(abs(a - b)) / count(*), 6) AS gap FROM r GROUP BY iteration")
def e19_posterior_gap(spark, d):
    return rounded(ev.posterior_gap(fx.regions(spark, d).select(F.col("label").cast("int").alias("iteration"), F.explode(F.arrays_zip(F.slice("vec", 1, 32).alias("a"), F.slice("vec", 33, 32).alias("b"))).alias("x")).select("iteration", "x.a", "x.b")), "gap")
