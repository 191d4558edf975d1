"""Views of the given tables in the shapes that the operators take, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captions(spark, sf_dir) -> DataFrame:
    """(example_idx, speaker, class, tokens)"""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("example_idx"), F.col("source").alias("speaker"), F.col("lang").alias("class"), F.filter(F.split(F.lower("text"), " "), lambda x: x != "").alias("tokens"))


def tokens(spark, sf_dir) -> DataFrame:
    """(example_idx, pos, token)"""
    return captions(spark, sf_dir).select("example_idx", F.posexplode("tokens").alias("pos", "token"))


def units(spark, sf_dir) -> DataFrame:
    """(example_idx, t, gold, pred, dur): events as one label sequence for each user, with a noisy copy as prediction."""
    w = Window.partitionBy("example_idx").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("example_idx"), "ts", "event_id", F.col("event_type").alias("gold"), "value")
    pred = F.when(F.col("value") < 15, F.coalesce(F.lag("gold").over(w), F.col("gold"))).otherwise(F.col("gold"))
    rows = rows.withColumns({"t": (F.row_number().over(w) - 1).cast("int"), "pred": pred, "dur": (F.floor("value") + 1).cast("int")})
    return rows.select("example_idx", "t", "gold", "pred", "dur")


def regions(spark, sf_dir) -> DataFrame:
    """(example_idx, idx, vec, label): five vectors to an image."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.floor(F.col("vec_id") / 5).cast("long").alias("example_idx"), (F.col("vec_id") % 5).cast("int").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def boxes(spark, sf_dir) -> DataFrame:
    """(image_id, pos, class, x, y, w, h)"""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("class"), F.col("l_quantity").cast("int").alias("x"), (F.col("l_linenumber") * 10).alias("y"),
        (F.col("l_partkey") % 50 + 1).cast("int").alias("w"), (F.col("l_suppkey") % 50 + 1).cast("int").alias("h"),
    )


#: The same views in DuckDB's SQL; write ``WITH {UNITS}, {RUNS} SELECT ...``.
CAPTIONS = "captions AS (SELECT doc_id AS example_idx, source AS speaker, lang AS class, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS tokens FROM documents)"
TOKENS = f"{CAPTIONS}, tokens AS (SELECT example_idx, unnest(range(0, CAST(len(tokens) AS BIGINT))) AS pos, unnest(tokens) AS token FROM captions)"
UNITS = """u0 AS (SELECT user_id AS example_idx, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_type AS gold, value FROM events),
units AS (SELECT example_idx, CAST(t AS INTEGER) AS t, gold, CASE WHEN value < 15 THEN coalesce(lag(gold) OVER (PARTITION BY example_idx ORDER BY t), gold) ELSE gold END AS pred, CAST(floor(value) + 1 AS INTEGER) AS dur FROM u0)"""


def runs_sql(name: str, label: str, source: str = "units") -> str:
    return f"""{name} AS (SELECT example_idx, CAST(min(t) AS INTEGER) AS s, CAST(max(t) + 1 AS INTEGER) AS e, {label} AS label FROM
(SELECT *, sum(c) OVER (PARTITION BY example_idx ORDER BY t) AS g FROM (SELECT *, CASE WHEN {label} IS DISTINCT FROM lag({label}) OVER (PARTITION BY example_idx ORDER BY t) THEN 1 ELSE 0 END AS c FROM {source})) GROUP BY example_idx, g, {label})"""


RUNS = f"{UNITS}, {runs_sql('gr', 'gold')}, {runs_sql('pr', 'pred')}"
REGIONS = "regions AS (SELECT CAST(floor(vec_id / 5) AS BIGINT) AS example_idx, CAST(vec_id % 5 AS INTEGER) AS idx, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
BOXES = "boxes AS (SELECT l_orderkey AS image_id, l_linenumber AS pos, l_returnflag AS class, CAST(l_quantity AS INTEGER) AS x, l_linenumber * 10 AS y, CAST(l_partkey % 50 + 1 AS INTEGER) AS w, CAST(l_suppkey % 50 + 1 AS INTEGER) AS h FROM lineitem)"
