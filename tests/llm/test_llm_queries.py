"""The registered queries on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lexground.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out, rel = entry.queries()[name](spark, SF), con.sql(SQL[name])
    names = sorted(rel.columns)
    assert sorted(out.columns) == names
    at = [rel.columns.index(n) for n in names]
    assert sorted(repr(tuple(r)) for r in out.select(*names).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_duplicates", "substring_dedup", "decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out.cache()
        assert 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == n


ODD = [
    (1, "good words " + " ".join(f"a{i}" for i in range(80)), "en", "s", None, "keep", "keep"),
    (1, "good words " + " ".join(f"a{i}" for i in range(80)), "en", "s", None, "keep", "keep"),
    (2, "more words " + " ".join(f"a{i}" for i in range(20, 60)) + " then others " + " ".join(f"b{i}" for i in range(90)), None, None, 3, "keep", "keep"),
    (3, None, None, None, None, "keep", "keep"),
    (4, "", "en", "s", 0, "keep", "keep"),
    (None, " ".join(f"c{i}" for i in range(30_000)), None, None, None, "keep", "keep"),
    (None, None, None, None, None, "keep", "keep"),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("n_chars", [True, False])
def test_stages_on_odd_tables(spark, name, n_chars):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names, an empty table."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long, score string, class_id string")
    docs = docs if n_chars else docs.drop("n_chars")
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    assert stage(spark, docs.limit(0), SF).count() == 0
    rows = out.collect()
    if name == "best_fit_packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, None} and sum(r.doc_id == 1 for r in rows) == 2
        return
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert {(r.score, r.class_id) for r in rows} == {("keep", "keep")}
    texts = {r.doc_id: r.text for r in rows if r.doc_id}
    if name == "near_duplicates":
        assert sorted(repr(r.doc_id) for r in rows) == sorted(map(repr, [1, 2, 3, 4, None, None]))
    if name == "substring_dedup":
        assert len(rows) == len(ODD) and texts[1] == ODD[0][1] and texts[2].startswith("more words then others b0") and texts[3] is None and texts[4] == ""
        assert not n_chars or all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    if name == "decontamination":
        assert len(rows) == len(ODD)


def test_held_out_languages(spark):
    """Most held-out texts get their language; the smallest table has 40 of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op2_language_id"](spark, SF).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.9 * len(out)


def test_held_out_quality(spark):
    """At a hundredth of the scale, no good text of the held-out fold is rejected, and most bad ones score below good ones."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op4_quality"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    pairs = [(g.score, b.score) for g in good for b in bad]
    assert sum(g > b for g, b in pairs) >= 0.9 * len(pairs)
