"""Queries of the example operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import examples as ex
from . import fixtures as fx
from .fixtures import BOXES, REGIONS, UNITS

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return put


def lines(spark, d):
    """Line items as phrases: the order is the image, a third of the line number the caption."""
    b = fx.boxes(spark, d)
    return b.select("image_id", (F.col("pos") % 3).alias("capt_id"), (F.col("pos") * 1000 + F.col("x") * 0 + F.col("w")).alias("pos"), F.concat("class", F.lit("-"), F.col("x").cast("string")).alias("phrase"), F.col("class").alias("concept"), F.struct("x", "y", "w", "h").alias("box"), "x", "h")


@register("p1_build_captions", f"""WITH {BOXES}, l AS (SELECT image_id, pos % 3 AS capt_id, pos * 1000 + w AS p, class || '-' || CAST(x AS VARCHAR) AS phrase, class, x, y, w, h FROM boxes), f AS (SELECT *, min(capt_id) OVER (PARTITION BY image_id) AS first FROM l)
SELECT image_id, capt_id, string_agg(phrase, ' ' ORDER BY p, phrase) AS phrases, string_agg(class, ' ' ORDER BY p, class) AS concepts, string_agg(CAST(x + y + w + h AS VARCHAR), ' ' ORDER BY p, x, y, w, h) AS boxes FROM f WHERE capt_id = first GROUP BY ALL""")
def p1_build_captions(spark, d):
    c = ex.build_captions(lines(spark, d))
    return c.select("image_id", "capt_id", F.array_join("phrases", " ").alias("phrases"), F.array_join("concepts", " ").alias("concepts"), F.array_join(F.transform("boxes", lambda b: (b["x"] + b["y"] + b["w"] + b["h"]).cast("string")), " ").alias("boxes"))


@register("p2_gold_from_phrases", f"WITH {UNITS}, s AS (SELECT example_idx, t, dur, sum(dur) OVER (PARTITION BY example_idx ORDER BY t) AS e FROM units) SELECT example_idx, CAST(e - dur AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", t AS a FROM s")
def p2_gold_from_phrases(spark, d):
    return ex.gold_from_phrases(fx.units(spark, d).select("example_idx", F.col("t").alias("pos"), F.col("dur").alias("n_phones")))


@register("p3_gold_from_concepts", f"""WITH {UNITS}, x AS (SELECT example_idx, t AS pos, gold, unnest(range(0, 3)) AS i, unnest(['a', '#', 'b']) AS phone FROM units WHERE gold <> 'error'), n AS (SELECT gold, row_number() OVER (ORDER BY gold) - 1 AS idx FROM (SELECT DISTINCT gold FROM units))
SELECT example_idx, CAST(row_number() OVER (PARTITION BY example_idx ORDER BY pos, i) - 1 AS INTEGER) AS t, CAST(idx AS INTEGER) AS concept_id FROM x JOIN n USING (gold) WHERE phone <> '#'""")
def p3_gold_from_concepts(spark, d):
    from ..operators.text import build_index

    u = fx.units(spark, d)
    ids = build_index(u.select(F.col("gold").alias("word")).distinct()).withColumnRenamed("word", "concept")
    data = u.where("gold <> 'error'").select("example_idx", F.col("t").alias("pos"), F.col("gold").alias("concept"), F.array(F.lit("a"), F.lit("#"), F.lit("b")).alias("phones"))
    return ex.gold_from_concepts(data, ids)


@register("p4_split_by_ids", "SELECT 'test' AS part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'train', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def p4_split_by_ids(spark, d):
    train, test = ex.split_by_ids(fx.table(spark, d, "documents").select("doc_id"), fx.table(spark, d, "labels"), "doc_id")
    one = lambda df, n: df.agg(F.lit(n).alias("part"), F.count("*").alias("n"), F.sum("doc_id").alias("total"))
    return one(test, "test").union(one(train, "train"))


@register("p4_split_by_flags", "SELECT quality AS flag, doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)")
def p4_split_by_flags(spark, d):
    flags = fx.table(spark, d, "labels").select("doc_id", F.col("quality").alias("flag"))
    train, test = ex.split_by_flags(fx.table(spark, d, "documents").select("doc_id", "source"), flags, "doc_id")
    return train.select(F.lit(0).alias("flag"), "*").union(test.select(F.lit(1).alias("flag"), "*"))


@register("p5_folds", "SELECT doc_id, true AS within FROM documents")
def p5_folds(spark, d):
    f = ex.assign_folds(fx.table(spark, d, "documents").select("doc_id"), 10, 3, "doc_id")
    return f.select("doc_id", F.col("fold").between(0, 9).alias("within"))


@register("p5_random_split")
def p5_random_split(spark, d):
    return ex.random_split(fx.table(spark, d, "documents").select("doc_id"), 0.2, 3, "doc_id")


@register("p6_scene_box", f"WITH {BOXES} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY pos, class, x, y, w, h) AS INTEGER) AS pos, class, x, y, w, h FROM boxes UNION ALL SELECT DISTINCT image_id, 0, 'scene', 0, 0, 100, CAST(100 + o_custkey % 7 AS INTEGER) FROM boxes JOIN orders ON image_id = o_orderkey")
def p6_scene_box(spark, d):
    dims = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(100).alias("width"), (100 + F.col("o_custkey") % 7).cast("int").alias("height"))
    return ex.add_scene_box(fx.boxes(spark, d), dims)


@register("p7_merge_boxes", f"WITH {BOXES} SELECT image_id, class, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY ALL")
def p7_merge_boxes(spark, d):
    return ex.merge_boxes(fx.boxes(spark, d))


@register("p8_concept_times", f"""WITH {UNITS}, n AS (SELECT example_idx, t AS pos, gold AS word, t * 10 AS b, t * 10 + dur AS e, lead(gold) OVER (PARTITION BY example_idx ORDER BY t) AS nx, lead(t * 10 + dur) OVER (PARTITION BY example_idx ORDER BY t) AS stop FROM units),
s AS (SELECT example_idx, word AS concept, pos, b, e FROM n UNION ALL SELECT example_idx, 'see', pos, b, e FROM n WHERE word = 'view' UNION ALL SELECT example_idx, 'clickview', pos, b, stop FROM n WHERE word = 'click' AND nx IN ('view', 'error')),
c AS (SELECT DISTINCT example_idx, unnest(['click', 'see', 'clickview', 'nothing']) AS concept FROM units)
SELECT c.example_idx, c.concept, min((pos, b, e))[1] AS pos, min((pos, b, e))[2] AS "begin", min((pos, b, e))[3] AS "end" FROM c LEFT JOIN s ON c.example_idx = s.example_idx AND c.concept = s.concept GROUP BY ALL""")
def p8_concept_times(spark, d):
    u = fx.units(spark, d)
    words = u.select("example_idx", F.col("t").alias("pos"), F.col("gold").alias("word"), (F.col("t") * 10).alias("begin"), (F.col("t") * 10 + F.col("dur")).alias("end"))
    concepts = u.select("example_idx").distinct().select("example_idx", F.explode(F.array(*map(F.lit, ("click", "see", "clickview", "nothing")))).alias("concept"))
    synonyms = u.select(F.col("gold").alias("word")).distinct().where("word = 'view'").select(F.lit("see").alias("concept"), "word")
    return ex.concept_times(concepts, words, synonyms, ("click", ("view", "error")))


SQL["p8_concept_times"] = SQL["p8_concept_times"].replace("min((pos, b, e))[1]", "arg_min(pos, pos)").replace("min((pos, b, e))[2]", "arg_min(b, pos)").replace("min((pos, b, e))[3]", "arg_min(e, pos)")


@register("p9_concept_subset", "SELECT p_brand AS concept, p_partkey AS example_idx FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) WHERE r <= 7")
def p9_concept_subset(spark, d):
    return ex.concept_subset(fx.table(spark, d, "part").select(F.col("p_brand").alias("concept"), F.col("p_partkey").alias("example_idx")), 7)


@register("p10_power_law", "WITH c AS (SELECT p_brand AS concept, count(*) AS k FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY k DESC, concept) AS r FROM c), q AS (SELECT concept, CAST(least(k, 60, floor(CAST(60 * 4 AS DOUBLE) * (1 / pow(CAST(r AS DOUBLE), 1.0)) / sum(1 / pow(CAST(r AS DOUBLE), 1.0)) OVER ())) AS BIGINT) AS n, least(k, 60) AS most, r FROM r), o AS (SELECT concept, n + least(most - n, greatest(0, 240 - sum(n) OVER () - coalesce(sum(most - n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS n FROM q) SELECT concept, CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS distinct_examples, CAST(n AS BIGINT) AS distinct_instances FROM o WHERE n > 0")
def p10_power_law(spark, d):
    s = ex.power_law_sample(fx.table(spark, d, "part").select(F.col("p_brand").alias("concept"), F.col("p_partkey").alias("instance")), 1.0, 60, 4, 5)
    return s.groupBy("concept").agg(F.count("*").alias("n"), F.countDistinct("example").alias("distinct_examples"), F.countDistinct("instance").alias("distinct_instances"))


@register("p11_phones_in_words", f"WITH {UNITS}, w AS (SELECT DISTINCT example_idx, t * 10 AS b FROM units WHERE gold = 'view'), p AS (SELECT example_idx, t * 10 AS b, unnest(string_split(gold, '')) AS phone FROM units) SELECT phone, count(*) AS n FROM p JOIN w USING (example_idx, b) GROUP BY phone")
def p11_phones_in_words(spark, d):
    u = fx.units(spark, d)
    data = u.where("gold = 'view'").select(F.col("example_idx").alias("capt_id"), (F.col("t") * 10 + 0.5).alias("begin"), (F.col("t") * 10 + 9.25).alias("end"))
    phones = u.select(F.col("example_idx").alias("capt_id"), (F.col("t") * 10.0).alias("word_begin"), (F.col("t") * 10 + 9.0).alias("word_end"), F.posexplode(F.filter(F.split("gold", ""), lambda x: x != "")).alias("i", "phone"))
    return ex.phones_in_words(data, phones).groupBy("phone").agg(F.count("*").alias("n"))


@register("p12_top_regions", "WITH r AS (SELECT o_custkey AS image_id, o_orderkey AS region, o_totalprice AS score, o_orderpriority AS class FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, region) AS n, first(class) OVER (PARTITION BY image_id ORDER BY score DESC, region) AS best_class FROM r) SELECT image_id, region, score, class, best_class FROM k WHERE n <= 3")
def p12_top_regions(spark, d):
    o = fx.table(spark, d, "orders")
    return ex.top_regions(o.select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("region"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("class")), 3)


@register("p13_concat_sequences", "SELECT conv_id AS id, string_agg(array_to_string(string_split(text, ' '), '|'), '|' ORDER BY turn) AS seq FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def p13_concat_sequences(spark, d):
    c = fx.table(spark, d, "conversations").where("text is not null")
    s = ex.concat_sequences(c.select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), F.split("text", " ").alias("seq")))
    return s.select("id", F.array_join("seq", "|").alias("seq"))


LABELS = {"view": 1, "click": 2, "signup": 3, "purchase": 4}


@register("p14_pad_sequences", f"""WITH {UNITS}, s AS (SELECT example_idx, list(gold ORDER BY t) AS g FROM units GROUP BY example_idx)
SELECT example_idx, array_to_string(list_transform(range(1, 61), lambda i: CASE WHEN i > len(g) THEN '-1' WHEN g[i] = 'view' THEN '1' WHEN g[i] = 'click' THEN '2' WHEN g[i] = 'signup' THEN '3' WHEN g[i] = 'purchase' THEN '4' ELSE '0' END), ' ') AS ids, CAST(least(len(g), 60) AS INTEGER) AS length FROM s""")
def p14_pad_sequences(spark, d):
    s = fx.units(spark, d).groupBy("example_idx").agg(ex.ordered("t", "gold").alias("tokens"))
    return ex.pad_sequences(s, 60, label2id=LABELS).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), " "))


@register("p15_image_labels", f"WITH {BOXES} SELECT DISTINCT image_id, class AS concept FROM boxes WHERE image_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def p15_image_labels(spark, d):
    b = fx.boxes(spark, d).groupBy("class").agg(F.collect_set("image_id").alias("images")).withColumnRenamed("class", "concept")
    return ex.image_labels(b, fx.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image_id")))


@register("p16_group_regions", f"WITH {REGIONS} SELECT example_idx AS image_id, min(example_idx * 5 + idx) AS row, string_agg(CAST(label AS VARCHAR), ' ' ORDER BY idx) AS labels, round(sum(vec[1]), 4) AS v FROM regions GROUP BY example_idx")
def p16_group_regions(spark, d):
    r = fx.regions(spark, d).withColumn("row", F.col("example_idx") * 5 + F.col("idx"))
    g = ex.group_regions(r.select("row", F.col("example_idx").alias("image_id"), "label"), r.select("row", "vec"))
    total = F.aggregate("vecs", F.lit(0.0), lambda a, v: a + v[0])
    return g.select("image_id", "row", F.array_join(F.transform("labels", lambda x: x.cast("string")), " ").alias("labels"), F.round(total, 4).alias("v"))


@register("p17_retrieval_subset")
def p17_retrieval_subset(spark, d):
    return ex.retrieval_subset(fx.table(spark, d, "conversations").select(F.col("conv_id").alias("example_idx"), "turn"), 100, 2)


@register("p17_one_caption", "SELECT conv_id AS image_id, min(turn) AS caption_idx, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id")
def p17_one_caption(spark, d):
    return ex.one_caption(fx.table(spark, d, "conversations").select(F.col("conv_id").alias("image_id"), F.col("turn").alias("caption_idx"), "role"))


@register("p18_majority", f"WITH {UNITS} SELECT example_idx, CAST(count(*) AS INTEGER) AS n, CAST(0 AS BIGINT) AS total FROM units GROUP BY example_idx")
def p18_majority(spark, d):
    a = ex.majority_alignment(fx.units(spark, d).groupBy("example_idx").agg(ex.ordered("t", "dur").alias("alignment")))
    return a.select("example_idx", F.size("alignment").alias("n"), F.aggregate("alignment", F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))


@register("p19_image_caption_pairs", f"""WITH {UNITS}, l AS (SELECT DISTINCT example_idx, gold AS region, 'a ' || CASE WHEN gold = 'error' THEN 'none' ELSE gold END AS text FROM units)
SELECT l.example_idx AS image_id, region, string_split(text, ' ')[2] AS word, coalesce(min(u.t * 10), -1) AS "begin", coalesce(arg_min(u.t * 10 + u.dur, u.t), -1) AS "end" FROM l LEFT JOIN units u ON u.example_idx = l.example_idx AND u.gold = string_split(text, ' ')[2] GROUP BY ALL""")
def p19_image_caption_pairs(spark, d):
    u = fx.units(spark, d)
    labels = u.select(F.col("example_idx").alias("image_id"), F.col("gold").alias("region")).distinct().withColumn("text", F.concat(F.lit("a "), F.when(F.col("region") == "error", "none").otherwise(F.col("region"))))
    words = u.select(F.col("example_idx").alias("image_id"), F.col("t").alias("pos"), F.col("gold").alias("word"), (F.col("t") * 10).alias("begin"), (F.col("t") * 10 + F.col("dur")).alias("end"))
    return ex.image_caption_pairs(labels, words)


@register("p20_pair_records", "WITH b AS (SELECT l_orderkey AS image_id, string_agg(replace(p_name, ' ', '_') || ':' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ' ' ORDER BY l_linenumber, replace(p_name, ' ', '_'), CAST(l_quantity AS INTEGER)) AS boxes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT coalesce(image_id, o_orderkey) AS image_id, boxes, o_orderpriority AS captions FROM b FULL JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON image_id = o_orderkey")
def p20_pair_records(spark, d):
    li = fx.table(spark, d, "lineitem")
    ann = li.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("ann_id"), F.col("l_partkey").alias("category_id"), F.col("l_quantity").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    cats = fx.table(spark, d, "part").select(F.col("p_partkey").alias("category_id"), F.col("p_name").alias("name"))
    caps = fx.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("image_id"), F.lit(0).alias("caption_idx"), F.col("o_orderpriority").alias("caption"))
    r = ex.pair_records(ann, cats, caps)
    return r.select("image_id", F.array_join(F.transform("boxes", lambda b: F.concat(b["class"], F.lit(":"), b["x"].cast("string"))), " ").alias("boxes"), F.array_join("captions", " ").alias("captions"))


@register("p21_sampled_boxes", f"WITH {BOXES} SELECT o_custkey AS example_idx, count(*) AS n, CAST(sum(x) AS BIGINT) AS x FROM orders JOIN boxes ON o_orderkey = image_id WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def p21_sampled_boxes(spark, d):
    e = fx.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("example_idx")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("images"))
    return ex.sampled_boxes(e, fx.boxes(spark, d)).groupBy("example_idx").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@register("p22_prepare_regions", f"WITH {REGIONS}, r AS (SELECT example_idx, idx, vec[1] AS v FROM regions WHERE example_idx % 4 <> 0), m AS (SELECT DISTINCT example_idx, -1 AS idx, 0.0 AS v FROM regions WHERE example_idx % 4 = 0), a AS (SELECT * FROM r UNION ALL SELECT * FROM m) SELECT example_idx, CAST(row_number() OVER (PARTITION BY example_idx ORDER BY idx) - 1 AS INTEGER) AS pos, CAST(idx AS INTEGER) AS idx, round(CAST(v AS DOUBLE), 6) AS v FROM a")
def p22_prepare_regions(spark, d):
    r = fx.regions(spark, d)
    out = ex.prepare_regions(r.where("example_idx % 4 <> 0"), r.select("example_idx").distinct(), 64)
    return out.select("example_idx", "pos", "idx", F.round(F.col("vec")[0], 6).alias("v"))


@register("p22_permuted_regions", f"WITH {REGIONS} SELECT example_idx, CAST(count(*) + 1 AS BIGINT) AS n, CAST(sum(idx) - 1 AS BIGINT) AS total, 0 AS null_at FROM regions GROUP BY example_idx")
def p22_permuted_regions(spark, d):
    r = fx.regions(spark, d)
    out = ex.prepare_regions(r, r.select("example_idx").distinct(), 64, null=True, permute=True, seed=4)
    return out.groupBy("example_idx").agg(F.count("*").alias("n"), F.sum("idx").alias("total"), F.min(F.when(F.col("idx") == -1, F.col("pos"))).alias("null_at"))


@register("p23_synthetic", f"WITH {REGIONS} SELECT label AS concept, count(*) AS n, true AS close FROM regions GROUP BY label")
def p23_synthetic(spark, d):
    """Vectors of a concept lie within a few noise widths of each other."""
    v = ex.synthetic_vectors(fx.regions(spark, d).select("example_idx", "idx", F.col("label").alias("concept")), 2, 9)
    return v.groupBy("concept").agg(F.count("*").alias("n"), (F.max(F.col("vec")[0]) - F.min(F.col("vec")[0]) < 1.0).alias("close"))


@register("p23_one_hot", f"WITH {REGIONS} SELECT example_idx, idx, label AS hot, 1.0::DOUBLE AS total FROM regions")
def p23_one_hot(spark, d):
    v = ex.one_hot(fx.regions(spark, d).select("example_idx", "idx", F.col("label").alias("concept")), 10)
    return v.select("example_idx", "idx", (F.array_position("vec", F.lit(1.0)) - 1).cast("int").alias("hot"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))
