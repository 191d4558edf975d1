"""Queries of the sources and sinks: each writes a table in the format and reads it back."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.scratch import scratch
from ..operators import timeline as tl
from ..sources import files as fl
from . import fixtures as fx
from .fixtures import BOXES, RUNS, UNITS

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return put


@register("s1_captions", """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS example_idx, list_filter(string_split(translate(coalesce(text, ''), chr(10) || chr(13), '  '), ' '), lambda x: x <> '') AS w FROM documents)
SELECT example_idx, 0 AS caption_idx, CASE WHEN len(w) = 0 THEN 'NULL' ELSE array_to_string(w, '|') END AS tokens FROM d""")
def s1_captions(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ").alias("value"))
    path = scratch(spark, "captions")
    fl.write_lines(docs, path, ["doc_id"])
    return fl.read_captions(spark, path).withColumn("tokens", F.array_join("tokens", "|"))


@register("s1_multi_captions", "WITH d AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS example_idx, string_split(o_orderpriority || ', ,' || o_orderstatus, ',') AS p FROM orders), x AS (SELECT example_idx, unnest(range(0, 3)) AS caption_idx, unnest(p) AS t FROM d) SELECT example_idx, CAST(caption_idx AS INTEGER) AS caption_idx, CASE WHEN trim(t) = '' THEN 'NULL' ELSE replace(trim(t), ' ', '|') END AS tokens FROM x")
def s1_multi_captions(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(", ,"), "o_orderstatus").alias("value"))
    path = scratch(spark, "captions")
    fl.write_lines(o, path, ["o_orderkey"])
    return fl.read_captions(spark, path, multiple=True).withColumn("tokens", F.array_join("tokens", "|"))


@register("s2_phrase_boxes", f"WITH {BOXES} SELECT CAST(image_id AS VARCHAR) AS capt_id, class || '|box' AS words, CAST(x AS DOUBLE) AS x, CAST(h AS DOUBLE) AS h, count(*) AS n FROM boxes GROUP BY ALL")
def s2_phrase_boxes(spark, d):
    path = scratch(spark, "phrases")
    b = fx.boxes(spark, d)
    fl.write_lines(b.select("image_id", "pos", F.concat_ws(" ", "image_id", "class", F.lit("box"), "x", "y", "w", "h").alias("value")), path, ["image_id", "pos"])
    r = fl.read_phrase_boxes(spark, path)
    return r.groupBy("capt_id", F.array_join("words", "|").alias("words"), F.col("box.x").alias("x"), F.col("box.h").alias("h")).agg(F.count("*").alias("n"))


@register("s3_alignments", f"WITH {UNITS}, a AS (SELECT example_idx AS index, '1,2' AS concepts, string_agg(CAST(dur AS VARCHAR), ',' ORDER BY t) AS alignment FROM units GROUP BY example_idx) SELECT NULL AS example_id, * FROM a UNION ALL SELECT 'arr_' || CAST(index AS VARCHAR), * FROM a")
def s3_alignments(spark, d):
    """Both forms: files of a list of records, and files of one object by example id."""
    record = F.struct(F.col("example_idx").alias("index"), F.array(F.lit(1), F.lit(2)).alias("image_concepts"), F.col("durs").alias("alignment"))
    a = fx.units(spark, d).groupBy("example_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "dur"))), lambda x: x["dur"]).alias("durs"))
    files = a.groupBy(F.floor(F.col("example_idx") / 64)).agg(F.collect_list(record).alias("list"), F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("arr_"), F.col("example_idx").cast("string")), record))).alias("keyed"))
    lists, keyed = scratch(spark, "alignments"), scratch(spark, "alignments")
    for form, path in (("list", lists), ("keyed", keyed)):
        files.select(F.to_json(form)).write.option("maxRecordsPerFile", 1).text(path)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    r = fl.read_alignments(spark, lists).withColumn("example_id", F.lit(None).cast("string")).unionByName(fl.read_alignments(spark, keyed, keyed=True))
    return r.select("example_id", "index", join("image_concepts").alias("concepts"), join("alignment").alias("alignment"))


@register("s4_s6_classes", f"""WITH {RUNS}, f AS (SELECT label, row_number() OVER (ORDER BY min((example_idx, s))) AS class_id FROM gr GROUP BY label)
SELECT CAST(class_id AS INTEGER) AS class_id, 'arr_' || CAST(example_idx AS VARCHAR) AS example_id, CAST(s AS DOUBLE) AS start, CAST(e AS DOUBLE) AS "end" FROM gr JOIN f USING (label)""")
def s4_s6_classes(spark, d):
    path = scratch(spark, "classes")
    fl.write_classes(tl.runs(fx.units(spark, d), "gold").withColumnRenamed("gold", "label"), path)
    return fl.read_classes(spark, path)


@register("s5_units", f"WITH {RUNS} SELECT CAST(example_idx AS VARCHAR) AS example_id, CAST(s AS DOUBLE) AS start, CAST(e AS DOUBLE) AS \"end\", label FROM gr")
def s5_units(spark, d):
    path = scratch(spark, "units")
    fl.write_units(tl.runs(fx.units(spark, d), "gold").select(F.col("example_idx").cast("string").alias("example_id"), "start", "end", F.col("gold").alias("label")), path)
    return fl.read_units(spark, path)


@register("s7_segmented", f"WITH {RUNS}, x AS (SELECT p.example_idx, p.s, string_agg(u.gold, ',' ORDER BY u.t) AS seg FROM pr p JOIN units u ON u.example_idx = p.example_idx AND u.t >= p.s AND u.t < p.e GROUP BY ALL), l AS (SELECT example_idx, string_agg(seg, ' ' ORDER BY s) AS value FROM x GROUP BY example_idx) SELECT row_number() OVER (ORDER BY example_idx) - 1 AS line, value FROM l")
def s7_segmented(spark, d):
    from .evaluation import intervals

    path = scratch(spark, "segmented")
    fl.write_segmented(intervals(spark, d)[0].select("example_idx", F.col("start").alias("pos"), F.split("ngram", ",").alias("segment")), path)
    return fl.numbered_lines(spark, path)


@register("s8_region_tsv", f"WITH {fx.REGIONS} SELECT example_idx AS image_id, CAST(count(*) AS INTEGER) AS num_boxes, round(sum(vec[1]), 4) AS v FROM regions WHERE example_idx IN (SELECT doc_id FROM labels) GROUP BY example_idx")
def s8_region_tsv(spark, d):
    path = scratch(spark, "tsv")

    def encode(batches):
        for b in batches:
            vecs = [np.array([list(v) for v in x], np.float32) for x in b["vecs"]]
            code = lambda a: base64.b64encode(a.tobytes()).decode()
            yield pd.DataFrame({"value": [f"{i}\t10\t10\t{len(v)}\t{code(v[:, :4].copy())}\t{code(v)}" for i, v in zip(b["example_idx"], vecs, strict=True)]})

    r = fx.regions(spark, d)
    packed = r.groupBy("example_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "vec"))), lambda x: x["vec"]).alias("vecs"))
    packed.mapInPandas(encode, "value string").write.text(path)
    ids = fx.table(spark, d, "labels").select(F.col("doc_id").alias("image_id"))
    out = fl.read_region_tsv(spark, path, ids)
    return out.select("image_id", "num_boxes", F.round(F.aggregate("features", F.lit(0.0).cast("double"), lambda a, v: a + v[0]), 4).alias("v"))


@register("s9_dictionary", "WITH p AS (SELECT DISTINCT left(p_name, 1) AS a, upper(left(p_type, 1)) AS b, p_brand AS x FROM part), c AS (SELECT a AS ch, x FROM p UNION SELECT b, x FROM p) SELECT ch AS char, x || '|two' AS defs, count(*) AS n FROM c GROUP BY ALL")
def s9_dictionary(spark, d):
    path = scratch(spark, "dictionary")
    p = fx.table(spark, d, "part").select(F.substring("p_name", 1, 1).alias("a"), F.upper(F.substring("p_type", 1, 1)).alias("b"), "p_brand").distinct()
    p.select(F.concat_ws(" ", "a", "b", F.lit("[x1]"), F.concat(F.lit("/"), "p_brand", F.lit("/two/"))).alias("value")).write.text(path)
    r = fl.read_dictionary(spark, path).select("char", F.array_join("defs", "|").alias("defs")).distinct()
    return r.groupBy("char", "defs").agg(F.count("*").alias("n"))


@register("s10_model", f"WITH {UNITS} SELECT gold AS word, CAST(dur % 5 AS INTEGER) AS k, CAST(count(*) AS DOUBLE) AS weight FROM units GROUP BY ALL")
def s10_model(spark, d):
    path = scratch(spark, "model")
    counts = fx.units(spark, d).groupBy(F.col("gold").alias("word"), (F.col("dur") % 5).cast("int").alias("k")).agg(F.count("*").cast("double").alias("weight"))
    fl.save_model({"counts": counts}, path)
    return fl.load_model(spark, path, ["counts"])["counts"]


@register("s11_parallel", "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, o_orderstatus AS concepts, o_orderpriority AS caption FROM orders) SELECT *, 'arr_' || CAST(i + 7 AS VARCHAR) AS example_id FROM o")
def s11_parallel(spark, d):
    path = scratch(spark, "parallel")
    fl.write_parallel(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("example_idx"), F.col("o_orderstatus").alias("concepts"), F.col("o_orderpriority").alias("caption")), path)
    return fl.read_parallel(spark, path, 7)


@register("s12_time_blocks", f"WITH {UNITS}, e AS (SELECT example_idx, dense_rank() OVER (ORDER BY example_idx) - 1 AS i, t, dur FROM units) SELECT i AS example_idx, t AS pos, round(dur / 100, 6) AS t FROM e")
def s12_time_blocks(spark, d):
    path = scratch(spark, "blocks")
    u = fx.units(spark, d).select("example_idx", "t", F.concat_ws(" ", F.lit("x"), (F.col("dur") / 100).cast("string"), F.lit("y")).alias("value"))
    ends = u.select("example_idx").distinct().select("example_idx", F.lit(2**30).alias("t"), F.lit("").alias("value"))
    u.union(ends).repartitionByRange(4, "example_idx").sortWithinPartitions("example_idx", "t").select("value").write.text(path)
    r = fl.read_time_blocks(spark, path)
    return r.select(F.col("example_idx").cast("long").alias("example_idx"), "pos", F.round("t", 6).alias("t"))
