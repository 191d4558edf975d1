"""Tables behind the plots of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .timeline import EX, runs


def concept_distribution(gold: DataFrame, cutoff: int, null: object = "NULL", normalise: bool = True, concept: str = "concept") -> DataFrame:
    """(concept, n, share) of the ``cutoff`` most frequent concepts other than ``null``; share of all counted ones."""
    c = gold.where(F.col(concept) != null).groupBy(F.col(concept).alias("concept")).agg(F.count("*").alias("n"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()) if normalise else F.col("n").cast("double"))
    return c.orderBy(F.desc("n"), "concept").limit(cutoff)


def length_distribution(alignment: DataFrame, value: str = "value") -> DataFrame:
    """(length, n, share, mean): lengths of the runs, and their mean."""
    lens = runs(alignment, value).select((F.col("end") - F.col("start")).alias("length")).groupBy("length").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return lens.select("length", "n", (F.col("n") / F.sum("n").over(every)).alias("share"), (F.sum(F.col("length") * F.col("n")).over(every) / F.sum("n").over(every)).alias("mean"))


def concept_f1(labels: DataFrame) -> DataFrame:
    """D3: (concept, n, recall, precision, f1), in one pass: a row counts once for its gold and once for its predicted concept."""
    side = F.explode(F.array(F.struct(F.col("gold").alias("concept"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("concept"), F.lit(0).alias("g"), F.lit(1).alias("p"))))
    s = labels.select(side.alias("x"), (F.col("gold") == F.col("pred")).cast("int").alias("hit")).groupBy("x.concept").agg(F.sum("x.g").alias("n"), F.sum("x.p").alias("m"), F.sum(F.col("hit") * F.col("x.g")).alias("h"))
    r, p = F.col("h") / F.greatest("n", F.lit(1)), F.col("h") / F.greatest("m", F.lit(1))
    return s.select("concept", "n", r.alias("recall"), p.alias("precision"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def best_and_worst(f1: DataFrame, k: int = 10) -> DataFrame:
    """D3: the ``k`` best and ``k`` worst concepts by F1, ties by name."""
    best = f1.orderBy(F.desc("f1"), "concept").limit(k).withColumn("side", F.lit("best"))
    return best.union(f1.orderBy("f1", "concept").limit(k).withColumn("side", F.lit("worst")))


def f1_by_frequency(f1: DataFrame, nbins: int) -> DataFrame:
    """(bin, lowest, highest, f1): concepts in ``nbins`` bins of equal number by frequency ``n`` (ties by name), mean F1 each."""
    binned = f1.withColumn("bin", F.ntile(nbins).over(Window.orderBy("n", "concept")))
    return binned.groupBy("bin").agg(F.min("n").alias("lowest"), F.max("n").alias("highest"), F.avg("f1").alias("f1"))


def f1_histogram(f1: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n): equal bins over [0, 1], the last one closed."""
    return f1.groupBy(F.least(F.floor(F.col("f1") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def counts_by_iteration(tables: DataFrame, vocab: DataFrame, iterations: list[int]) -> DataFrame:
    """One row a word of ``vocab(word)``, one column an iteration, of ``tables(iteration, word, weight)``."""
    own = tables.join(vocab.select("word"), "word", "left_semi")
    return own.groupBy("word").pivot("iteration", iterations).agg(F.sum("weight")).fillna(0)


def curves(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(model, iteration, value): one CSV file a model, named after it, with a value a line."""
    rows = spark.read.schema(f"i int, {column} double").csv(path)
    return rows.select(F.regexp_extract(F.input_file_name(), r"model=([^/]+)/", 1).alias("model"), F.col("i").alias("iteration"), F.col(column).alias("value"))


def alignment_weights(scores: DataFrame, temp: float | None = None) -> DataFrame:
    """(example_idx, t, i, weight): weights ``scores(example_idx, t, i, value)`` normalised per position, or their softmax at ``temp``."""
    w = Window.partitionBy(EX, "t")
    if temp is None:
        return scores.select(EX, "t", "i", (F.col("value") / F.sum("value").over(w)).alias("weight"))
    e = scores.withColumn("e", F.exp((F.col("value") - F.max("value").over(w)) / temp))
    return e.select(EX, "t", "i", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def gold_matrix(alignment: DataFrame, sizes: DataFrame) -> DataFrame:
    """(example_idx, t, i, weight): 1 where position t is aligned to i, else 0, for i below ``sizes(example_idx, n)``."""
    return alignment.join(sizes, EX).select(EX, "t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "value").select(EX, "t", "i", (F.col("i") == F.col("value")).cast("int").alias("weight"))
