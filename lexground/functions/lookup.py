"""Lookups of words that don't deal a table of tokens out by word, where a few words are most of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: Rows of a table that are broadcast; of a larger one, those of the most frequent words.
MOST = 200_000


def looked_up(tokens: DataFrame, table: DataFrame, key: str = "token", word: str = "word", most: int = MOST) -> DataFrame:
    """``tokens`` with the columns of ``table`` besides ``word`` (of which no two rows are equal), null where ``key`` isn't there; ``table``'s
    columns must have names of their own.

    The table is written, so that its size is known. One of up to ``most`` rows is broadcast, and no token moves. Of a larger one the rows
    of the ``most`` most frequent tokens are broadcast, and with them the words that are frequent and not in the table; only the other tokens,
    the rare ones, are joined by word, and no word of them has more than one token in ``most``.
    """
    table = cut(table.where(F.col(word).isNotNull()), "lookup")
    named = table.withColumnRenamed(word, "_word")
    same = F.col(key) == F.col("_word")
    if table.count() <= most:
        return tokens.join(F.broadcast(named), same, "left").drop("_word")
    words = tokens.groupBy(F.col(key).alias("_word")).agg(F.count("*").alias("_n")).where("_word IS NOT NULL")
    frequent = words.orderBy(F.desc("_n"), "_word").limit(most).select("_word")
    hot = cut(frequent.join(named, "_word", "left").withColumn("_hot", F.lit(True)), "lookup-hot")
    seen = tokens.join(F.broadcast(hot), same, "left").drop("_word")
    added = [c for c in table.columns if c != word]
    known = F.coalesce("_hot", F.col(key).isNull())
    rare = seen.where(~known).drop("_hot", *added).join(named, same, "left").drop("_word")
    return seen.where(known).drop("_hot").unionByName(rare)
