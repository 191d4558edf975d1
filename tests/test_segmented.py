"""F4 on texts that lie in their own rows."""

from pyspark.sql import functions as F

from lexground.operators import timeline as tl

TEXTS = {1: (["a,b", "c", "d,e,f"], 4), 2: (["a", "", "b"], 5), 3: ([], 3), 4: (["x,y"], 2), 5: (["x"], None), 6: (["a,b", "c", "d"], 2)}
WANT = [(1, 0, 2, "a,b"), (1, 2, 3, "c"), (1, 3, 4, "d,e,f"), (2, 0, 1, "a"), (2, 1, 2, ""), (2, 2, 3, "b"), (2, 3, 5, "NULL"), (4, 0, 2, "x,y"), (6, 0, 2, "a,b")]


def test_segments_are_not_moved(spark, monkeypatch):
    texts = spark.createDataFrame([(e, *t) for e, t in TEXTS.items()], "example_idx long, segments array<string>, n int")
    for most in (tl.MOST, 3):
        monkeypatch.setattr(tl, "MOST", most)
        out = tl.texts_to_classes(texts)
        assert sorted(map(tuple, out.collect())) == WANT
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        rows = texts.select("example_idx", F.posexplode("segments").alias("pos", "segment"))
        assert sorted(map(tuple, tl.segmented_to_classes(rows, texts.select("example_idx", "n")).collect())) == WANT


def test_the_query_of_texts_has_no_shuffle(spark, sf_dir):
    from lexground.plans.timeline import QUERIES

    assert "Exchange" not in QUERIES["f4_segmented_classes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
