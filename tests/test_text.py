"""Text queries that cut texts into words once, and lookups that move no words."""

import pytest

import __spark_entry__ as entry
from lexground.operators import text as tx


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_examples_are_not_moved(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["b"]), (3, [])]
    words = tx.distinct_words(spark.createDataFrame(rows, "example_idx long, tokens array<string>"))
    assert "Exchange" not in plan_of(words)
    assert sorted(map(tuple, words.collect())) == [(1, "a"), (1, "b"), (2, "b")]
    again = tx.distinct_words(spark.createDataFrame([*rows, (2, ["b", "c"]), (None, ["d"]), (None, ["d"])], "example_idx long, tokens array<string>"))
    assert sorted(map(tuple, again.where("example_idx IS NOT NULL").collect())) == [(1, "a"), (1, "b"), (2, "b"), (2, "c")]
    assert again.where("example_idx IS NULL").count() == 1


def test_tagged_words_are_not_moved(spark):
    tokens = spark.createDataFrame([(1, 0, "the"), (1, 1, "cat"), (2, 0, "rare"), (3, 0, "cat"), (3, 1, "rare")], "example_idx long, pos int, token string")
    index = spark.createDataFrame([("cat", 2), ("rare", 1), ("the", 1)], "word string, images long")
    tagged = tx.tag_concepts(tokens, index, spark.createDataFrame([("the",)], "word string"), 2)
    assert sorted(map(tuple, tagged.collect())) == [(1, 0, "the"), (1, 1, "cat"), (2, -1, "null"), (3, 0, "cat")]
    assert "hashpartitioning(token" not in plan_of(tagged)


@pytest.mark.parametrize("name", ["t1_normalize", "t6_phones"])
def test_texts_are_cut_into_words_once(spark, sf_dir, name):
    assert not [f for f in entry.queries()[name](spark, sf_dir).inputFiles() if "documents" in f]
