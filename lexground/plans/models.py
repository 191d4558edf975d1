"""Queries of the model operators, on the image regions of the embeddings table and captions made of their labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators import acoustic as ac
from ..operators import models as md
from ..operators import timeline as tl
from . import fixtures as fx
from .evaluation import GRAMS, intervals, rounded
from .fixtures import REGIONS, UNITS

QUERIES, SQL = {}, {}
WIDTH, K, DIM = 64.0, 10, 64


def register(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return put


#: Centroids are the means of the labels; a caption is NULL (10) and then its regions' labels.
MU = f"""{REGIONS}, rx AS (SELECT example_idx, idx, label, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM regions), mu AS (SELECT label AS k, dim, avg(x) AS m FROM rx GROUP BY ALL)"""
POST = f"""{MU}, ds AS (SELECT example_idx, idx, k, sum((x - m) * (x - m)) AS d FROM rx JOIN mu USING (dim) GROUP BY ALL), q AS (SELECT example_idx, idx AS j, k, exp(-d / 64) AS q FROM ds),
post AS (SELECT example_idx, j AS idx, k, q / sum(q) OVER (PARTITION BY example_idx, j) AS p FROM q)"""
PAIRS = "pairs AS (SELECT example_idx, idx + 1 AS t, label AS w FROM regions UNION ALL SELECT DISTINCT example_idx, 0, 10 FROM regions)"
TABLE = "tb AS (SELECT CAST(w AS INTEGER) AS w, CAST(k AS INTEGER) AS k, (1.0::DOUBLE + CASE WHEN w = k THEN 1 ELSE 0 END) / (10.0::DOUBLE + CASE WHEN w < 10 THEN 1 ELSE 0 END) AS p FROM range(0, 11) a(w), range(0, 10) b(k))"
TERMS = f"{POST}, {PAIRS}, {TABLE}, a AS (SELECT example_idx, t, w, j, sum(p * q) AS a FROM pairs JOIN q USING (example_idx) JOIN tb USING (w, k) GROUP BY ALL)"


def centers(spark, d) -> np.ndarray:
    """Means of the labels; a table of ten rows."""
    r = fx.regions(spark, d).select("label", F.posexplode("vec").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("m")).collect()
    out = np.zeros((K, DIM))
    for x in r:
        out[x.label, x.dim] = x.m
    return out


def likelihoods(spark, d):
    """(example_idx, j, k, q)"""
    post = fx.regions(spark, d).select("example_idx", "idx", F.posexplode("vec").alias("dim", "x"))
    mu = fx.regions(spark, d).select(F.col("label").alias("k"), F.posexplode("vec").alias("dim", "x")).groupBy("k", "dim").agg(F.avg("x").alias("m"))
    return post.join(mu, "dim").groupBy("example_idx", F.col("idx").alias("j"), "k").agg(F.exp(-F.sum((F.col("x") - F.col("m")) ** 2) / WIDTH).alias("q"))


def long_post(spark, d):
    return md.posteriors(fx.regions(spark, d), centers(spark, d), WIDTH).select("example_idx", "idx", F.posexplode("post").alias("k", "p"))


def pairs(spark, d):
    r = fx.regions(spark, d)
    return r.select("example_idx", (F.col("idx") + 1).alias("t"), F.col("label").alias("w")).union(r.select("example_idx", F.lit(0), F.lit(10)).distinct())


def start_table(spark, d):
    labels = fx.regions(spark, d).select("label").distinct()
    w = labels.select(F.col("label").alias("w")).union(labels.agg(F.max("label") + 1))
    both = w.select("w", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("k"))
    return both.select("w", "k", ((1.0 + (F.col("w") == F.col("k")).cast("double")) / (10.0 + (F.col("w") < 10).cast("double"))).alias("p"))


@register("m1_kmeans")
def m1_kmeans(spark, d):
    found = md.kmeans(fx.regions(spark, d), 5, 1)
    return found.select("k", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 6))


@register("m1_kmeans_by_label")
def m1_kmeans_by_label(spark, d):
    found = md.kmeans(fx.regions(spark, d), 2, 1, "label")
    return found.select("label", "k", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 6))


def lloyd_sql(rounds: int) -> str:
    """Rounds from the means of the labels: every vector to its nearest centroid, centroids to the means."""
    out = [f"WITH {MU}, c0 AS (SELECT k, dim, m FROM mu)"]
    for r in range(rounds):
        out.append(f"""n{r} AS (SELECT example_idx, idx, k FROM (SELECT *, row_number() OVER (PARTITION BY example_idx, idx ORDER BY d, k) AS r FROM (SELECT example_idx, idx, k, sum((x - m) * (x - m)) AS d FROM rx JOIN c{r} USING (dim) GROUP BY ALL)) WHERE r = 1),
        g{r} AS (SELECT k, dim, avg(x) AS m FROM rx JOIN n{r} USING (example_idx, idx) GROUP BY ALL),
        c{r + 1} AS (SELECT k, dim, coalesce(g{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN g{r} USING (k, dim))""")
    return ", ".join(out) + f" SELECT CAST(k AS INTEGER) AS k, CAST(dim AS INTEGER) AS dim, round(m, 5) AS value FROM c{rounds}"


@register("m1_kmeans_from_labels", lloyd_sql(3))
def m1_kmeans_from_labels(spark, d):
    """Three rounds of ten centroids that start as the means of the labels."""
    r = fx.regions(spark, d)
    start = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centers(spark, d))], "k int, vec array<double>")
    found = md.kmeans(r, K, start=start, rounds=3, tol=0.0)
    return found.select("k", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 5))


@register("m2_posteriors", f"WITH {POST} SELECT example_idx, idx, k, round(p, 6) AS p FROM post")
def m2_posteriors(spark, d):
    return rounded(long_post(spark, d), "p")


@register("m3_nearest", f"WITH {POST} SELECT example_idx, idx, k FROM (SELECT *, row_number() OVER (PARTITION BY example_idx, idx ORDER BY d, k) AS r FROM ds) WHERE r = 1")
def m3_nearest(spark, d):
    return md.assign_nearest(fx.regions(spark, d), centers(spark, d))


@register("m4_image_prior", f"WITH {POST} SELECT example_idx, k, round(ln(avg(p)), 5) AS log_p FROM post GROUP BY ALL")
def m4_image_prior(spark, d):
    return md.image_prior(md.posteriors(fx.regions(spark, d), centers(spark, d), WIDTH)).withColumn("log_p", F.round("log_p", 5))


PRIOR = "pr0 AS (SELECT gold AS token, count(*) / sum(count(*)) OVER () AS p FROM units GROUP BY gold)"


def gold_tokens(spark, d):
    return fx.units(spark, d).select("example_idx", F.col("t").alias("pos"), F.col("gold").alias("token"))


@register("m5_phone_prior", f"WITH {UNITS}, {PRIOR} SELECT token, round(p, 6) AS p FROM pr0")
def m5_phone_prior(spark, d):
    return rounded(md.phone_prior(gold_tokens(spark, d)), "p")


@register("m5_segment_prior", f"WITH {GRAMS}, {PRIOR}, s AS (SELECT DISTINCT ngram FROM iv) SELECT ngram AS segment, round(sum(ln(p)), 6) AS log_p FROM (SELECT ngram, unnest(string_split(ngram, ',')) AS token FROM s) JOIN pr0 USING (token) GROUP BY ngram")
def m5_segment_prior(spark, d):
    s = intervals(spark, d)[0].select(F.col("ngram").alias("segment"))
    return rounded(md.segment_prior(s, md.phone_prior(gold_tokens(spark, d))), "log_p")


@register("m5_length_prior", f"WITH {GRAMS} SELECT DISTINCT ngram AS segment, round(ln(0.4 / 0.6) + len(string_split(ngram, ',')) * ln(0.6 / 5), 6) AS log_p FROM iv")
def m5_length_prior(spark, d):
    return rounded(md.length_prior(intervals(spark, d)[0].select(F.col("ngram").alias("segment")).distinct(), 0.4, 5), "log_p")


SEATS = f"{UNITS}, {PRIOR}, ct AS (SELECT CAST(t % 5 AS INTEGER) AS k, gold AS word, CAST(sum(dur) AS DOUBLE) AS weight FROM units GROUP BY ALL)"


def seats(spark, d):
    return md.crp_counts(fx.units(spark, d).select((F.col("t") % 5).cast("int").alias("k"), F.col("gold").alias("word"), F.col("dur").cast("double").alias("w")))


def base(spark, d):
    return md.phone_prior(gold_tokens(spark, d)).select(F.col("token").alias("word"), F.log("p").alias("log_p"))


@register("m6_crp_prob", f"WITH {SEATS} SELECT k, word, round((2 * p + weight) / (2 + sum(weight) OVER (PARTITION BY k)), 6) AS p FROM ct JOIN pr0 ON word = token")
def m6_crp_prob(spark, d):
    return rounded(md.crp_prob(seats(spark, d), base(spark, d), 2.0), "p")


@register("m6_crp_loglik", f"WITH {SEATS} SELECT k, round(lgamma(2) - lgamma(2 + sum(weight)) + sum(lgamma(weight + 2 * p) - lgamma(2 * p)), 3) AS loglik FROM ct JOIN pr0 ON word = token GROUP BY k")
def m6_crp_loglik(spark, d):
    return md.crp_loglik(seats(spark, d), base(spark, d), 2.0).withColumn("loglik", F.round("loglik", 3))


SPANS = f"""{GRAMS}, {PRIOR}, x AS (SELECT u.example_idx, u.t AS s, n, string_agg(v.gold, ',' ORDER BY v.t) AS seg, sum(ln(p)) AS l FROM units u CROSS JOIN range(1, 4) r(n) JOIN units v ON v.example_idx = u.example_idx AND v.t >= u.t AND v.t < u.t + n JOIN pr0 ON v.gold = token GROUP BY ALL HAVING count(*) = n),
c AS (SELECT ngram, count(*) AS n, sum(count(*)) OVER () AS total FROM iv GROUP BY ngram),
sp AS (SELECT example_idx, s AS start, CAST(s + x.n AS INTEGER) AS "end", CASE WHEN c.n IS NULL THEN ln(3.0 / (3 + (SELECT max(total) FROM c))) + l ELSE ln((3 * exp(l) + c.n) / (3 + total)) END AS log_p FROM x LEFT JOIN c ON seg = ngram)"""


@register("m7_span_scores", f'WITH {SPANS} SELECT example_idx, start, "end", round(log_p, 5) AS log_p FROM sp')
def m7_span_scores(spark, d):
    return scored_spans(spark, d).select("example_idx", "start", "end", F.round("log_p", 5).alias("log_p"))


def scored_spans(spark, d):
    tok = gold_tokens(spark, d)
    words = intervals(spark, d)[0].groupBy(F.lit(0).alias("k"), F.col("ngram").alias("word")).agg(F.count("*").cast("double").alias("weight"))
    prior = md.phone_prior(tok)
    probs = md.crp_prob(words, md.segment_prior(words.select(F.col("word").alias("segment")), prior).withColumnRenamed("segment", "word"), 3.0).select("word", "p")
    total = words.agg(F.sum("weight")).first()[0]
    return md.span_scores(md.spans(tok, 3), probs, prior, 3.0, total)


@register("m8_viterbi", f"""WITH RECURSIVE {SPANS}, ends AS (SELECT example_idx, "end" AS e, list(log_p ORDER BY "end" - start) AS p FROM sp GROUP BY ALL),
v(example_idx, e, best, back) AS (SELECT DISTINCT example_idx, 0, [0.0::DOUBLE], CAST([] AS BIGINT[]) FROM sp UNION ALL
SELECT example_idx, e, list_append(best, list_max(tried)), list_append(back, len(tried) + 1 - list_position(list_reverse(tried), list_max(tried)))
FROM (SELECT v.example_idx, ends.e, best, back, list_transform(p, lambda q, l: q + best[ends.e - l + 1]) AS tried FROM v JOIN ends ON ends.example_idx = v.example_idx AND ends.e = v.e + 1)),
cuts(example_idx, e, back) AS (SELECT example_idx, max(e), max_by(back, e) FROM v GROUP BY example_idx UNION ALL SELECT example_idx, e - back[e], back FROM cuts WHERE e - back[e] > 0)
SELECT example_idx, CAST(e - back[e] AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM cuts""")
def m8_viterbi(spark, d):
    return md.segment_viterbi(scored_spans(spark, d))


@register("m9_sample")
def m9_sample(spark, d):
    return md.segment_sample(scored_spans(spark, d), 1.0, 3)


@register("m10_crp_segment")
def m10_crp_segment(spark, d):
    return md.crp_segment(gold_tokens(spark, d), 1.0, 2, 5, 4)


@register("m11_mixture_round", f"""WITH {TERMS}, c AS (SELECT *, a / sum(a) OVER (PARTITION BY example_idx, j) AS c FROM a), n AS (SELECT w, k, sum(c * p) AS c FROM c JOIN (SELECT example_idx, idx AS j, k, p FROM post) USING (example_idx, j) GROUP BY ALL)
SELECT tb.w, tb.k, round((2.0 / 10 + coalesce(c, 0)) / (2.0 + sum(coalesce(c, 0)) OVER (PARTITION BY tb.w)), 6) AS p FROM tb LEFT JOIN n ON tb.w = n.w AND tb.k = n.k""")
def m11_mixture_round(spark, d):
    return rounded(md.mixture_round(pairs(spark, d), likelihoods(spark, d), start_table(spark, d), 2.0, K)[0], "p")


@register("m11_mixture_loglik", f"WITH {TERMS}, l AS (SELECT example_idx, j, ln(avg(a)) AS l FROM a GROUP BY ALL) SELECT example_idx, round(sum(l), 5) AS loglik FROM l GROUP BY example_idx")
def m11_mixture_loglik(spark, d):
    return md.mixture_round(pairs(spark, d), likelihoods(spark, d), start_table(spark, d), 2.0, K)[1].withColumn("loglik", F.round("loglik", 5))


def mixture_sql(rounds: int) -> str:
    """t0 is the start table, and t1 to t<rounds> follow from one another."""
    out = ["t0 AS (SELECT * FROM tb)"]
    for r in range(rounds):
        out.append(f"a{r} AS (SELECT example_idx, t, w, j, sum(p * q) AS a FROM pairs JOIN q USING (example_idx) JOIN t{r} USING (w, k) GROUP BY ALL)")
        out.append(f"s{r} AS (SELECT *, a / sum(a) OVER (PARTITION BY example_idx, j) AS c FROM a{r})")
        out.append(f"n{r} AS (SELECT w, k, sum(c * p) AS c FROM s{r} JOIN (SELECT example_idx, idx AS j, k, p FROM post) USING (example_idx, j) GROUP BY ALL)")
        out.append(f"t{r + 1} AS (SELECT w, k, (2.0::DOUBLE / 10 + coalesce(c, 0)) / (2.0::DOUBLE + sum(coalesce(c, 0)) OVER (PARTITION BY w)) AS p FROM t{r} LEFT JOIN n{r} USING (w, k))")
    return ", ".join(out)


@register("m11_train_mixture", f"WITH {TERMS}, {mixture_sql(3)} SELECT w, k, round(p, 6) AS p FROM t3")
def m11_train_mixture(spark, d):
    return rounded(md.train_mixture(pairs(spark, d), cut(likelihoods(spark, d)), start_table(spark, d), 3, 2.0, K)[0], "p")


@register("m12_centroids", f"""WITH {TERMS}, c AS (SELECT example_idx, k, avg(p) AS c FROM pairs JOIN tb USING (w) GROUP BY ALL), w AS (SELECT example_idx, idx, k, p * c / sum(p * c) OVER (PARTITION BY example_idx, idx) AS w FROM post JOIN c USING (example_idx, k))
SELECT k, CAST(dim AS INTEGER) AS dim, round(sum(w * x) / sum(w), 6) AS value FROM w JOIN rx USING (example_idx, idx) GROUP BY ALL""")
def m12_centroids(spark, d):
    return rounded(md.update_centroids(pairs(spark, d), long_post(spark, d), start_table(spark, d), fx.regions(spark, d)), "value")


@register("m13_align", f"WITH {TERMS} SELECT example_idx, j, CAST(arg_max(t, (a, -t)) AS INTEGER) AS t FROM a GROUP BY ALL")
def m13_align(spark, d):
    return md.align_mixture(md.mixture_terms(pairs(spark, d), likelihoods(spark, d), start_table(spark, d)))[0]


SQL["m13_align"] = f"WITH {TERMS} SELECT example_idx, j, CAST(t AS INTEGER) AS t FROM (SELECT *, row_number() OVER (PARTITION BY example_idx, j ORDER BY round(a, 12) DESC, t) AS r FROM a) WHERE r = 1"


@register("m13_scores", f"WITH {TERMS}, m AS (SELECT example_idx, j, greatest(max(a), 1e-30) AS m FROM a GROUP BY ALL) SELECT example_idx, round(sum(ln(m)), 5) AS log_score FROM m GROUP BY example_idx")
def m13_scores(spark, d):
    return md.align_mixture(md.mixture_terms(pairs(spark, d), likelihoods(spark, d), start_table(spark, d)))[1].withColumn("log_score", F.round("log_score", 5))


def hmm_inputs(spark, d):
    """Examples, and parameters whose concepts prefer their own label, whose early regions come first and whose jumps are short."""
    post = md.posteriors(fx.regions(spark, d), centers(spark, d), WIDTH)
    tokens = fx.regions(spark, d).select("example_idx", F.col("idx").alias("t"), F.col("label").alias("w"))
    lengths = [r[0] for r in post.groupBy("example_idx").count().select("count").distinct().collect()]
    params = md.start_params(lengths, K, K, (np.ones((K, K)) + np.eye(K)) / (K + 1))
    for n in lengths:
        at = np.arange(n)
        first, jump = 1 / (at + 1), 1 / (1 + np.abs(at[:, None] - at[None]))
        params["init"][n], params["trans"][n] = first / first.sum(), jump / jump.sum(1, keepdims=True)
    return md.pack_examples(tokens, post), params


# The same model in SQL, unrolled over the five tokens of an example at most; a table's last example may have fewer.
HMM = f"""{POST}, sz AS (SELECT example_idx, count(*) AS n FROM regions GROUP BY example_idx), ns AS (SELECT DISTINCT n FROM sz),
ini AS (SELECT n, i, 1.0::DOUBLE / (i + 1) / sum(1.0::DOUBLE / (i + 1)) OVER (PARTITION BY n) AS v FROM ns, range(0, 5) r(i) WHERE i < n),
tr AS (SELECT n, i, j, 1.0::DOUBLE / (1 + abs(i - j)) / sum(1.0::DOUBLE / (1 + abs(i - j))) OVER (PARTITION BY n, i) AS v FROM ns, range(0, 5) a(i), range(0, 5) b(j) WHERE i < n AND j < n),
em AS (SELECT example_idx, idx AS t, label AS w, k, (1 + CASE WHEN k = label THEN 1 ELSE 0 END) / 11.0::DOUBLE AS b FROM regions, range(0, 10) r(k))"""


def forward_sql(pi: str = "post", keys: str = "example_idx") -> str:
    """f0 to f4: joint weights of the tokens up to t and of the state (region, concept)."""
    out = [f"f0 AS (SELECT {keys}, idx, k, v * p * b AS f FROM {pi} JOIN sz USING (example_idx) JOIN ini ON ini.n = sz.n AND ini.i = idx JOIN em USING (example_idx, k) WHERE t = 0)"]
    for t in range(1, 5):
        out.append(f"o{t} AS (SELECT {keys}, idx, sum(f) AS own FROM f{t - 1} GROUP BY ALL)")
        out.append(f"c{t} AS (SELECT {keys}, tr.j AS idx, sum(CASE WHEN tr.i <> tr.j THEN own * v ELSE 0 END) AS came FROM o{t} JOIN sz USING (example_idx) JOIN tr ON tr.n = sz.n AND tr.i = o{t}.idx GROUP BY ALL)")
        out.append(f"f{t} AS (SELECT {keys}, idx, k, (v * f + came * p) * b AS f FROM f{t - 1} JOIN c{t} USING ({keys}, idx) JOIN {pi} USING ({keys}, idx, k) JOIN sz USING (example_idx) JOIN tr ON tr.n = sz.n AND tr.i = idx AND tr.j = idx JOIN em USING (example_idx, k) WHERE t = {t})")
    return ", ".join(out)


LIKE = "lk AS (SELECT example_idx, sum(f) AS z FROM f4 GROUP BY example_idx)"


def last_sql(keys: str = "example_idx") -> str:
    """fl: the joint weights at each example's own last token."""
    return "fl AS (" + " UNION ALL ".join(f"SELECT {keys}, f FROM f{t} JOIN sz USING (example_idx) WHERE sz.n = {t + 1}" for t in range(5)) + ")"


LIKES = f"{last_sql()}, lk AS (SELECT example_idx, sum(f) AS z FROM fl GROUP BY example_idx)"


def backward_sql() -> str:
    """b4 to b0: weights of the tokens after t given the state; n4 to n1 with the token's own emission, e4 to e1 summed over concepts."""
    ends = lambda t: f"SELECT example_idx, idx, k, 1.0::DOUBLE AS v FROM post JOIN sz USING (example_idx) WHERE sz.n = {t + 1}"
    out = [f"b4 AS ({ends(4)})"]
    for t in range(4, 0, -1):
        out.append(f"n{t} AS (SELECT example_idx, idx, k, b{t}.v * b AS x FROM b{t} JOIN em USING (example_idx, k) WHERE t = {t})")
        out.append(f"e{t} AS (SELECT example_idx, idx, sum(p * x) AS enter FROM n{t} JOIN post USING (example_idx, idx, k) GROUP BY ALL)")
        out.append(f"m{t} AS (SELECT example_idx, tr.i AS idx, sum(CASE WHEN tr.i <> tr.j THEN v * enter ELSE 0 END) AS away, max(CASE WHEN tr.i = tr.j THEN v END) AS stay FROM e{t} JOIN sz USING (example_idx) JOIN tr ON tr.n = sz.n AND tr.j = e{t}.idx GROUP BY ALL)")
        out.append(f"b{t - 1} AS (SELECT example_idx, idx, k, stay * x + away AS v FROM n{t} JOIN m{t} USING (example_idx, idx) UNION ALL {ends(t - 1)})")
    return ", ".join(out)


GAMMA = "g AS (" + " UNION ALL ".join(f"SELECT example_idx, {t} AS t, idx, k, f * v / z AS g FROM f{t} JOIN b{t} USING (example_idx, idx, k) JOIN lk USING (example_idx)" for t in range(5)) + ")"
XI = "xi AS (" + " UNION ALL ".join(
    f"SELECT o.example_idx, sz.n, tr.i, tr.j, CASE WHEN tr.i = tr.j THEN v * same ELSE v * own * enter END / z AS x FROM o{t} o JOIN (SELECT example_idx, idx, sum(f * x) AS same FROM f{t - 1} JOIN n{t} USING (example_idx, idx, k) GROUP BY ALL) s USING (example_idx, idx) JOIN sz USING (example_idx) JOIN lk USING (example_idx) JOIN tr ON tr.n = sz.n AND tr.i = o.idx JOIN e{t} e ON e.example_idx = o.example_idx AND e.idx = tr.j"
    for t in range(1, 5)
) + ")"
ESTEP = f"""WITH {HMM}, {forward_sql()}, {LIKES}, {backward_sql()}, {GAMMA}, {XI},
cn AS (SELECT 'obs' AS kind, 0 AS m, k AS i, w AS j, sum(g) AS value FROM g JOIN (SELECT DISTINCT example_idx, t, w FROM em) USING (example_idx, t) GROUP BY ALL
UNION ALL SELECT 'init', n, idx, 0, sum(g) FROM g JOIN sz USING (example_idx) GROUP BY ALL UNION ALL SELECT 'trans', n, i, j, coalesce(sum(x), 0) FROM tr LEFT JOIN xi USING (n, i, j) GROUP BY ALL
UNION ALL SELECT 'loglik', n, 0, 0, sum(ln(z)) FROM lk JOIN sz USING (example_idx) GROUP BY ALL UNION ALL SELECT 'examples', n, 0, 0, count(*) FROM sz GROUP BY ALL)
SELECT kind, CAST(m AS INTEGER) AS m, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 6) AS value FROM cn"""
CONCEPTS = f"""WITH {HMM}, held AS (SELECT post.example_idx, hi, hk, idx, k, CASE WHEN idx <> hi THEN p WHEN k = hk THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM post JOIN sz USING (example_idx), range(0, 5) a(hi), range(0, 10) b(hk) WHERE hi < n),
{forward_sql("held", "example_idx, hi, hk")}, {last_sql("example_idx, hi, hk")}, z AS (SELECT example_idx, hi AS idx, hk AS k, sum(f) AS z FROM fl GROUP BY ALL)
SELECT example_idx, CAST(idx AS INTEGER) AS idx, CAST(k AS INTEGER) AS k, round(z * p / sum(z * p) OVER (PARTITION BY example_idx, idx), 6) AS p FROM z JOIN post USING (example_idx, idx, k)"""


def viterbi_sql() -> str:
    out = ["es AS (SELECT example_idx, t, idx, ln(greatest(sum(p * b), 1e-300)) AS le FROM post JOIN em USING (example_idx, k) GROUP BY ALL)"]
    out.append("v0 AS (SELECT example_idx, 0 AS t, idx, ln(v) + le AS s, -1 AS prev FROM es JOIN sz USING (example_idx) JOIN ini ON ini.n = sz.n AND ini.i = idx WHERE t = 0)")
    for t in range(1, 5):
        out.append(f"w{t} AS (SELECT v{t - 1}.example_idx, tr.j AS idx, s + ln(v) AS s, v{t - 1}.idx AS prev FROM v{t - 1} JOIN sz USING (example_idx) JOIN tr ON tr.n = sz.n AND tr.i = v{t - 1}.idx)")
        out.append(f"v{t} AS (SELECT x.example_idx, {t} AS t, x.idx, x.s + le AS s, prev FROM (SELECT *, row_number() OVER (PARTITION BY example_idx, idx ORDER BY s DESC, prev) AS r FROM w{t}) x JOIN es ON es.example_idx = x.example_idx AND es.idx = x.idx AND es.t = {t} WHERE r = 1)")
    # Back from each example's own last token.
    ends = lambda t: f"SELECT example_idx, {t} AS t, idx AS region FROM (SELECT v{t}.*, row_number() OVER (PARTITION BY example_idx ORDER BY s DESC, idx) AS r FROM v{t} JOIN sz USING (example_idx) WHERE sz.n = {t + 1}) WHERE r = 1"
    out.append(f"p4 AS ({ends(4)})")
    out += [f"p{t} AS (SELECT v{t + 1}.example_idx, {t} AS t, prev AS region FROM v{t + 1} JOIN p{t + 1} ON v{t + 1}.example_idx = p{t + 1}.example_idx AND v{t + 1}.idx = p{t + 1}.region UNION ALL {ends(t)})" for t in range(3, -1, -1)]
    every = lambda x: " UNION ALL ".join(f"SELECT example_idx, t, {x[1]} FROM {x[0]}{t}" for t in range(5))
    out.append(f"sc AS (SELECT example_idx, t, idx, exp(s - max(s) OVER (PARTITION BY example_idx, t)) AS s FROM ({every(('v', 'idx, s'))}))")
    out.append("pr AS (SELECT example_idx, t, idx AS region, s / sum(s) OVER (PARTITION BY example_idx, t) AS score FROM sc)")
    out.append(f"pt AS ({every(('p', 'region'))})")
    return ", ".join(out)


@register("m14_estep", ESTEP)
def m14_estep(spark, d):
    return rounded(md.hmm_estep(*hmm_inputs(spark, d)), "value")


@register("m14_concept_counts", CONCEPTS)
def m14_concept_counts(spark, d):
    return rounded(md.concept_counts(*hmm_inputs(spark, d)), "p")


COUNTS = f"""{REGIONS}, ct AS (SELECT 'trans' AS kind, 5 AS m, idx AS i, (idx + label) % 5 AS j, CAST(count(*) AS DOUBLE) AS value FROM regions GROUP BY ALL UNION ALL SELECT 'init', 5, idx, 0, CAST(sum(label + 1) AS DOUBLE) FROM regions GROUP BY idx
UNION ALL SELECT 'obs', 0, label, idx, CAST(count(*) AS DOUBLE) FROM regions GROUP BY ALL)"""


@register("m15_mstep", f"WITH {COUNTS} SELECT kind, CAST(m AS INTEGER) AS m, i, CAST(j AS INTEGER) AS j, round(value / sum(value) OVER (PARTITION BY kind, CASE WHEN kind = 'obs' THEN i END, CASE WHEN kind <> 'obs' THEN m END, CASE WHEN kind = 'trans' THEN i END), 6) AS p FROM ct")
def m15_mstep(spark, d):
    r = fx.regions(spark, d)
    n = F.count("*").cast("double").alias("value")
    trans = r.groupBy(F.col("idx").alias("i"), ((F.col("idx") + F.col("label")) % 5).alias("j")).agg(n).select(F.lit("trans").alias("kind"), F.lit(5).alias("m"), "i", "j", "value")
    init = r.groupBy("idx").agg(F.sum(F.col("label") + 1).cast("double").alias("value")).select(F.lit("init"), F.lit(5), "idx", F.lit(0), "value")
    obs = r.groupBy("label", "idx").agg(n).select(F.lit("obs"), F.lit(0), "label", "idx", "value")
    return rounded(md.hmm_mstep(trans.union(init).union(obs)), "p")


@register("m16_gradient", f"""WITH {POST}, dl AS (SELECT post.example_idx, post.idx, k, CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0 END - p AS d FROM post JOIN regions USING (example_idx, idx)), s AS (SELECT k, dim, sum(d * x) AS dx, sum(d) AS d FROM dl JOIN rx USING (example_idx, idx) GROUP BY ALL)
SELECT k, CAST(dim AS INTEGER) AS dim, round(m + 5.0 / ((SELECT count(DISTINCT example_idx) FROM regions) * 64) * (dx - m * d), 6) AS value FROM s JOIN mu USING (k, dim)""")
def m16_gradient(spark, d):
    r = fx.regions(spark, d)
    counts = r.select("example_idx", "idx", F.explode(F.sequence(F.lit(0), F.lit(K - 1))).alias("k"), "label").select("example_idx", "idx", "k", (F.col("k") == F.col("label")).cast("double").alias("p"))
    new, _ = md.gradient_step(long_post(spark, d), counts, r, centers(spark, d), 5.0, WIDTH)
    # One row per centroid and dimension: a table of parameters.
    rows = [(k, i, float(new[k, i])) for k in range(K) for i in range(DIM)]
    return rounded(spark.createDataFrame(rows, "k int, dim int, value double"), "value")


@register("m17_train_hmm")
def m17_train_hmm(spark, d):
    r = fx.regions(spark, d)
    tokens = r.select("example_idx", F.col("idx").alias("t"), F.col("label").alias("w"))
    params, mu, _ = md.train_hmm(tokens, r, centers(spark, d), K, 2, 0.1, WIDTH, (np.ones((K, K)) + np.eye(K)) / (K + 1))
    return md.align_viterbi(md.pack_examples(tokens, md.posteriors(r, mu, WIDTH)), params).drop("score")


@register("m17_train_acoustic")
def m17_train_acoustic(spark, d):
    """The vectors of an image's regions as its frames, too."""
    r = fx.regions(spark, d)
    mu = centers(spark, d)
    params, _, _ = md.train_hmm(None, r, mu, K, 2, 0.1, WIDTH, (np.ones((K, K)) + np.eye(K)) / (K + 1), frames=r, frame_centroids=mu)
    rows = [(k, i, float(params["frames"][k, i])) for k in range(K) for i in range(DIM)]
    return rounded(spark.createDataFrame(rows, "k int, dim int, value double"), "value")


@register("m17_train_segments")
def m17_train_segments(spark, d):
    """Emissions of words by their predictive probabilities; labels are the words."""
    r = fx.regions(spark, d)
    counts = {x.label: x["count"] for x in r.groupBy("label").count().collect()}
    base = np.array([counts.get(k, 0) for k in range(K)], float)
    params, _, _ = md.train_hmm(r.select("example_idx", F.col("idx").alias("t"), F.col("label").alias("w")), r, centers(spark, d), K, 2, 0.1, WIDTH, base=base, alpha=2.0)
    rows = [(k, w, float(params["obs"][k, w])) for k in range(K) for w in range(K)]
    return rounded(spark.createDataFrame(rows, "k int, w int, p double"), "p")


@register("m18_viterbi", f"WITH {HMM}, {viterbi_sql()} SELECT example_idx, CAST(t AS INTEGER) AS t, CAST(region AS INTEGER) AS region, round(score, 6) AS score FROM pt JOIN pr USING (example_idx, t, region)")
def m18_viterbi(spark, d):
    return rounded(md.align_viterbi(*hmm_inputs(spark, d)), "score")


@register("m19_regions", f"WITH {TERMS}, s AS (SELECT post.example_idx, post.idx, post.k, ln(greatest(post.p, 1e-100)) + ln(tb.p) AS s FROM post JOIN regions r USING (example_idx, idx) JOIN tb ON tb.w = r.label AND tb.k = post.k) SELECT example_idx, idx, k FROM (SELECT *, row_number() OVER (PARTITION BY example_idx, idx ORDER BY s DESC, k) AS n FROM s) WHERE n = 1")
def m19_regions(spark, d):
    r = fx.regions(spark, d)
    alignment = r.select("example_idx", F.col("idx").alias("t"), F.col("idx").alias("region"))
    tokens = r.select("example_idx", F.col("idx").alias("t"), F.col("label").alias("w"))
    return md.decode_regions(alignment, tokens, long_post(spark, d), start_table(spark, d))


@register("m19_positions", f"WITH {POST} SELECT example_idx, idx AS t, k FROM (SELECT *, row_number() OVER (PARTITION BY example_idx, idx ORDER BY p DESC, k) AS n FROM post) WHERE n = 1")
def m19_positions(spark, d):
    return md.decode_positions(long_post(spark, d).select("example_idx", F.col("idx").alias("t"), "k", F.col("p").alias("value")))


@register("m20_loglik", f"WITH {HMM}, {forward_sql()}, {LIKE} SELECT round(avg(ln(z)), 6) AS loglik FROM lk")
def m20_loglik(spark, d):
    return rounded(md.avg_loglik(*hmm_inputs(spark, d)), "loglik")


LENGTHS = "ln AS (SELECT CAST(o_custkey % 4 + 1 AS INTEGER) AS m, CAST(o_orderkey % 6 + 1 AS INTEGER) AS n, CAST(count(*) AS DOUBLE) AS c FROM orders GROUP BY ALL)"


def lengths(spark, d):
    return fx.table(spark, d, "orders").select((F.col("o_custkey") % 4 + 1).cast("int").alias("m"), (F.col("o_orderkey") % 6 + 1).cast("int").alias("n"))


@register("m21_lengths", f"WITH {LENGTHS} SELECT m, n, round(c / sum(c) OVER (PARTITION BY m), 6) AS p FROM ln")
def m21_lengths(spark, d):
    return rounded(md.length_probs(lengths(spark, d)), "p")


@register("m21_lengths_laplace", f"WITH {LENGTHS}, g AS (SELECT m, CAST(n AS INTEGER) AS n FROM (SELECT DISTINCT m FROM ln), range(1, (SELECT max(n) + 1 FROM ln)) r(n)), f AS (SELECT g.m, g.n, coalesce(c, 0) + 1 AS c FROM g LEFT JOIN ln ON ln.m = g.m AND ln.n = g.n) SELECT m, n, round(c / sum(c) OVER (PARTITION BY m), 6) AS p FROM f")
def m21_lengths_laplace(spark, d):
    return rounded(md.length_probs(lengths(spark, d), 1.0), "p")


STATS = f"{MU}, st AS (SELECT label AS k, dim, count(*) AS n, sum(x) AS total, sum(x * x) AS squares FROM rx GROUP BY ALL), cp AS (SELECT *, (0.1 / 4.0 + total / 2.0) / (1 / 4.0 + n / 2.0) AS mean, (1 / 4.0 + n / 2.0) / 2.0 / ((1 / 4.0 + n / 2.0) + 1 / 2.0) AS prec FROM st)"
MU0, VAR, VAR0 = 0.1, 2.0, 4.0


def by_label(spark, d):
    return fx.regions(spark, d).withColumn("k", F.col("label"))


@register("m22_stats", f"WITH {STATS} SELECT k, CAST(dim AS INTEGER) AS dim, n, round(total, 5) AS total, round(squares, 5) AS squares, round(mean, 6) AS mean, round(prec, 6) AS prec FROM cp")
def m22_stats(spark, d):
    s = md.component_stats(by_label(spark, d).select("k", "vec"), MU0, VAR, VAR0)
    return rounded(s, "mean", "prec").withColumns({"total": F.round("total", 5), "squares": F.round("squares", 5)})


DENSITY = f"{STATS}, dn AS (SELECT r.example_idx, r.idx, k, sum(0.5 * ln(prec) - 0.5 * ln(2 * pi()) - 0.5 * prec * (x - mean) * (x - mean)) AS l FROM rx r JOIN cp USING (dim) GROUP BY ALL)"


def snapshot(spark, d):
    return md.stats_arrays(md.component_stats(by_label(spark, d).select("k", "vec"), MU0, VAR, VAR0), K, DIM)


@register("m23_predictive", f"WITH {DENSITY} SELECT example_idx, idx, k, round(l, 4) AS logp FROM dn")
def m23_predictive(spark, d):
    p = md.log_predictive(fx.regions(spark, d), *snapshot(spark, d), np.full(DIM, MU0), VAR, VAR0)
    return p.select("example_idx", "idx", F.posexplode("logp").alias("k", "logp")).withColumn("logp", F.round("logp", 4))


PRIORS = "pk AS (SELECT k, ln(2.0 / 10 + any_value(n)) - ln(sum(any_value(n)) OVER () + 2.0) AS lp FROM st GROUP BY k)"


@register("m23_marginal", f"WITH {DENSITY}, {PRIORS}, t AS (SELECT example_idx, idx, l + lp AS s, max(l + lp) OVER (PARTITION BY example_idx, idx) AS m FROM dn JOIN pk USING (k)) SELECT example_idx, idx, round(any_value(m) + ln(sum(exp(s - m))), 4) AS log_marginal FROM t GROUP BY ALL")
def m23_marginal(spark, d):
    p = md.log_predictive(fx.regions(spark, d), *snapshot(spark, d), np.full(DIM, MU0), VAR, VAR0, 2.0)
    return p.select("example_idx", "idx", F.round("log_marginal", 4).alias("log_marginal"))


@register("m24_log_marginal", f"""WITH {STATS}, z AS (SELECT lgamma(2) - lgamma(2 + sum(n)) + sum(lgamma(n + 2 / 10.0) - lgamma(2 / 10.0)) AS z FROM st WHERE dim = 0)
SELECT round((SELECT sum(-0.5 * n * ln(2 * pi() * 2.0) - 0.5 * ln(4.0 * (1 / 4.0 + n / 2.0)) - 0.5 * (squares / 2.0 + 0.1 * 0.1 / 4.0 - pow(0.1 / 4.0 + total / 2.0, 2) / (1 / 4.0 + n / 2.0))) FROM st), 2) AS log_x, round(z, 4) AS log_z FROM z""")
def m24_log_marginal(spark, d):
    s = md.component_stats(by_label(spark, d).select("k", "vec"), MU0, VAR, VAR0)
    return md.log_marginal(s, K, MU0, VAR, VAR0, 2.0).select(F.round("log_x", 2).alias("log_x"), F.round("log_z", 4).alias("log_z"))


@register("m25_assign", f"WITH {DENSITY}, {PRIORS} SELECT example_idx, idx, k FROM (SELECT *, row_number() OVER (PARTITION BY example_idx, idx ORDER BY l + lp DESC, k) AS r FROM dn JOIN pk USING (k)) WHERE r = 1")
def m25_assign(spark, d):
    return md.gmm_assign(fx.regions(spark, d), *snapshot(spark, d), np.full(DIM, MU0), VAR, VAR0, 2.0)


@register("m25_sample")
def m25_sample(spark, d):
    return md.gmm_assign(fx.regions(spark, d), *snapshot(spark, d), np.full(DIM, MU0), VAR, VAR0, 2.0, temp=1.0, seed=3)


@register("m26_shrink", f"WITH {REGIONS}, c AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS r FROM regions GROUP BY label) SELECT example_idx, idx, CAST(CASE WHEN r < 4 THEN r END AS INTEGER) AS k FROM regions JOIN c USING (label)")
def m26_shrink(spark, d):
    return md.shrink_components(by_label(spark, d).select("example_idx", "idx", "k"), 4)


def acoustic(spark, d):
    """Spans of regions with their mean vectors."""
    from ..functions.segments import embed_segments

    lm = fx.regions(spark, d).groupBy("example_idx").agg(F.max("idx").alias("m")).select("example_idx", F.explode(F.sequence(F.lit(0), F.col("m") + 1)).alias("lm_idx")).withColumn("frame", F.col("lm_idx"))
    c = tl.candidates(lm, 1, 3)
    v = embed_segments(c.select("example_idx", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")), fx.regions(spark, d), 1, "mean")
    return v.withColumn("dur", F.col("end") - F.col("start"))


@register("m26_reassign")
def m26_reassign(spark, d):
    """Labels as components: the four largest stay, and the vectors of all others go to the best of them."""
    r = fx.regions(spark, d)
    return md.shrink_and_assign(r, r.select("example_idx", "idx", F.col("label").alias("k")), 4, np.full(64, MU0), VAR, VAR0)


@register("m27_acoustic")
def m27_acoustic(spark, d):
    return ac.segment_acoustic(acoustic(spark, d), 4, np.zeros(DIM), VAR, VAR0, 1.0, 2, 3)


@register("m27_acoustic_poisson")
def m27_acoustic_poisson(spark, d):
    return ac.segment_acoustic(acoustic(spark, d), 4, np.zeros(DIM), VAR, VAR0, 1.0, 2, 3, length_term="poisson", temp=1.0)


@register("m27_acoustic_realigned")
def m27_acoustic_realigned(spark, d):
    """With concepts of the images, an insertion penalty, and densities normalised over the components."""
    return ac.segment_acoustic(acoustic(spark, d), 4, np.zeros(DIM), VAR, VAR0, 1.0, 2, 3, penalty=-0.5, images=md.posteriors(fx.regions(spark, d), centers(spark, d), WIDTH), scale_from=2)


@register("m27_words")
def m27_words(spark, d):
    """Regions as slices; a word spells the units of up to three of them."""
    return ac.segment_words(fx.regions(spark, d), 8, 200, np.full(DIM, MU0), VAR, VAR0, 1.0, 3, 3, most=3, temp=1.0)[0]


@register("m27_words_realigned")
def m27_words_realigned(spark, d):
    """Best segmentations, with the concepts of the images and few words."""
    images = md.posteriors(fx.regions(spark, d), centers(spark, d), WIDTH)
    slices = fx.regions(spark, d).withColumn("unit", F.col("label") % 8)
    return ac.segment_words(slices, 8, 40, np.full(DIM, MU0), VAR, VAR0, 1.0, 3, 3, most=3, penalty=-0.5, images=images)[0]


@register("m25_rounds")
def m25_rounds(spark, d):
    """Two rounds of draws from the labels, each vector's own count taken out."""
    r = fx.regions(spark, d)
    return md.gmm_rounds(r, r.select("example_idx", "idx", F.col("label").alias("k")), K, np.full(DIM, MU0), VAR, VAR0, 1.0, 2)[0]


@register("m28_words", f"""WITH {REGIONS}, wd(word, pos, len, k) AS (VALUES ('ab', 0, 2, 0), ('ab', 1, 2, 1), ('bc', 0, 2, 1), ('bc', 1, 2, 2)), u AS (SELECT example_idx, idx // 2 AS seg, idx % 2 AS pos, CAST(k AS INTEGER) AS k, vec[k + 1] AS logp FROM regions, range(0, 3) r(k))
SELECT example_idx, CAST(seg AS INTEGER) AS seg, word, round(avg(logp) + ln(0.3) + ln(0.7) - 2 * ln(3), 6) AS score FROM u JOIN wd USING (pos, k) GROUP BY ALL HAVING count(*) = 2""")
def m28_words(spark, d):
    r = fx.regions(spark, d)
    units = r.select("example_idx", F.floor(F.col("idx") / 2).cast("int").alias("seg"), (F.col("idx") % 2).alias("pos"), F.when(F.col("idx") < 4, 2).otherwise(1).alias("len"), F.posexplode(F.slice("vec", 1, 3)).alias("k", "logp"))
    words = r.select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(p).alias("pos"), F.lit(2).alias("len"), F.lit(k).alias("k")) for w, p, k in (("ab", 0, 0), ("ab", 1, 1), ("bc", 0, 1), ("bc", 1, 2))])).alias("x")).select("x.*").distinct()
    return rounded(md.score_words(units, words, 0.3, 3), "score")


@register("m29_empirical_prior", f"WITH {MU} SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(var_pop(x) * 0.5, 6) AS var FROM rx GROUP BY dim")
def m29_empirical_prior(spark, d):
    return rounded(md.empirical_prior(fx.regions(spark, d), 0.5), "mean", "var")


@register("m30_results", f"WITH {UNITS}, {fx.runs_sql('gr', 'gold')} SELECT g.example_idx, CAST(sum(e - s) AS BIGINT) AS slices, string_agg(CAST(e AS VARCHAR), ',' ORDER BY s) AS segmentation, string_agg(label, ',' ORDER BY s) AS transcript FROM gr g GROUP BY g.example_idx")
def m30_results(spark, d):
    seg = tl.runs(fx.units(spark, d), "gold").select("example_idx", "start", "end", F.lit(1).alias("region"), F.col("gold").alias("k"))
    r = md.results_table(seg)
    return r.select("example_idx", F.size("alignment").cast("long").alias("slices"), F.array_join(F.transform("segmentation", lambda x: x.cast("string")), ",").alias("segmentation"), F.array_join("transcript", ",").alias("transcript"))


@register("m31_word_prior", f"WITH {TERMS}, s AS (SELECT example_idx, CAST(w AS VARCHAR) AS word, sum(post.p * tb.p) / count(DISTINCT idx) AS p FROM post JOIN tb USING (k) GROUP BY ALL), n AS (SELECT * FROM s UNION ALL SELECT example_idx, 'NEW', greatest(1 - sum(p), 0) FROM s GROUP BY example_idx) SELECT example_idx, word, round(ln(greatest(p, 1e-6)), 4) AS log_p FROM n")
def m31_word_prior(spark, d):
    table = start_table(spark, d).select(F.col("w").cast("string").alias("word"), "k", "p")
    return md.word_prior(long_post(spark, d), table, "NEW", floor=1e-6).withColumn("log_p", F.round("log_p", 4))
