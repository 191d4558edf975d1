"""Names, ids, marks, recall by similarity and very long texts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexground.llm import langid, media, neardup, packing, phrases, shards, urlfilter
from lexground.llm.queries import RULES, op9_url_filter


def test_user_column_of_the_url_filter_stays(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "mine", 5)], "page_id long, url string, _best string, `a.b` int")
    row = urlfilter.filter_urls(pages, list(RULES)).first()
    assert row["_best"] == "mine" and row["a.b"] == 5 and row.verdict == "block" and row.rule == "com/en/"


@pytest.mark.parametrize(
    ("url", "rule", "verdict"),
    [
        ("http://example.com/en/1", "com/en/", "block"), ("http://a.example.com/en/7x", "example.com/en/7", "allow"), ("http://b.net/de/", "net/de/", "allow"), ("http://example.net/de/1", "net/de/", "allow"),
        ("http://x.Example.net/de/80?q", "example.net/de/8", "block"), ("http://c.net/de/8", "net/de/", "allow"), ("http://d.org/es/1", "org/es/", "block"), ("http://d.org/en/1", None, "allow"),
    ],
)
def test_words_of_the_contracts_rules(spark, tmp_path, url, rule, verdict):
    spark.createDataFrame([(1, url)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    row = op9_url_filter(spark, str(tmp_path)).first()
    assert (row.rule, row.verdict) == (rule, verdict)


def test_names_with_dots(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "`doc.id` long, `the.text` string")
    cut = packing.pieces(docs, *packing.public_paths(), id_col="doc.id", text_col="the.text").collect()
    assert sorted((r["doc.id"], r.length) for r in cut)[1] == (2, 1) and len(cut) == 2
    media.store(docs, f"file://{tmp_path}/m", id_col="doc.id", text_col="the.text")
    assert sorted(r.doc_id for r in media.load(spark, f"file://{tmp_path}/m").collect()) == [1, 2]


@pytest.mark.parametrize("use", [lambda d: phrases.remove_repeats(d), lambda d: shards.shard(d, 3)])
def test_ids_that_are_no_numbers_are_refused(spark, use):
    with pytest.raises(ValueError, match="whole number"):
        use(spark.createDataFrame([("x", "text")], "doc_id string, text string"))


def test_marks_belong_to_their_letters():
    texts = ["हिन्दी में किताब", "كِتَابٌ جَدِيد", "café Été", "́alone x́y 5́z", "don't २३ a1b"]
    words = langid.letters(pa.array(texts))
    got = [[words.word(i).decode() for i in range(words.first[t], words.first[t + 1])] for t in range(len(texts))]
    assert got == [["हिन्दी", "में", "किताब"], ["كِتَابٌ", "جَدِيد"], ["café", "été"], ["alone", "x́y", "z"], ["don", "t", "a", "b"]]


def edited(rng, n, least, most, how):
    """A text and an edit of it, of a similarity between the bounds."""
    base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
    sim = rng.uniform(least, most)
    if how == "replace":
        other = list(base)
        for i in rng.choice(n, int(n * (1 - sim)), replace=False):
            other[i] = f"z{rng.integers(0, 10**6)}"
    else:
        more = int(2 * n / sim - 2 * n)
        other = [f"z{x}" for x in rng.integers(0, 10**6, more)] + base if how == "front" else base + [f"z{x}" for x in rng.integers(0, 10**6, more)]
    return " ".join(base), " ".join(other)


@pytest.mark.parametrize("band", [(0.805, 0.85), (0.85, 0.9), (0.9, 0.99)])
def test_recall_in_each_band_of_similarity(spark, band):
    rng = np.random.default_rng(int(band[0] * 1000))
    pairs = [edited(rng, int(rng.integers(80, 500)), *band, how) for _ in range(60) for how in ("replace", "front", "end")]
    rows = [(2 * i + j, text) for i, pair in enumerate(pairs) for j, text in enumerate(pair)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    links = [i for i, (a, b) in enumerate(pairs) if neardup.similarity(*(neardup._words(pa.array([t])).hashes() for t in (a, b)), 0.8) >= 0.8]
    assert len(links) > 160 and sum(got[2 * i] == got[2 * i + 1] for i in links) >= 0.9 * len(links)
    assert len({got[2 * i] for i in range(len(pairs))}) == len(pairs)


def test_alignment_in_the_memory_of_its_band(monkeypatch):
    rng = np.random.default_rng(4)
    for n, band, kinds in [(1, 1, 3), (40, 5, 4), (200, 30, 20), (200, 300, 3), (500, 64, 400)]:
        a = rng.integers(0, kinds, n).tolist()
        b = [x for x in a if rng.random() < 0.8] + rng.integers(0, kinds, n // 10).tolist()
        assert neardup._long_lcs(a, b, band) == neardup.banded_lcs(a, b, band)


def test_near_copies_of_very_long_texts(spark):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.zipf(1.3, 60_000) % 30_000]
    other = [w if rng.random() < 0.97 else "changed" for w in base]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:20_000]))], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_equal_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None)], "doc_id long, text string")
    cut = packing.pieces(docs, *packing.public_paths())
    assert cut.count() == 3 and cut.where(F.col("doc_id") == 1).count() == 2
    assert packing.pieces(docs.limit(0), *packing.public_paths()).count() == 0


def test_profiles_never_part_similar_texts():
    """Pairs of a similarity of 0.8 or more, of many sizes and edits, differ in fewer bits than the bound; most others are told apart."""
    rng = np.random.default_rng(12)
    most, far = neardup.most_apart(0.8), []
    for n in (1, 2, 5, 9, 30, 150, 700):
        for _ in range(60):
            base = [f"w{x}" for x in rng.zipf(1.4, n) % 500]
            other = [f"z{rng.integers(0, 900)}" if rng.random() < 0.25 else w for w in base if rng.random() > 0.1]
            a, b = (neardup._words(pa.array([" ".join(t)])) for t in (base, other))
            if not len(b) or neardup.similarity(a.hashes(), b.hashes(), 0.8) < 0.8:
                continue
            far.append(int(np.bitwise_count(neardup.profiles(a) ^ neardup.profiles(b)).sum()))
    assert len(far) > 100 and max(far) <= most
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(80)]
    marks = neardup.profiles(neardup._words(pa.array(texts)))
    apart = [int(np.bitwise_count(marks[i] ^ marks[j]).sum()) for i in range(80) for j in range(i)]
    assert np.mean(np.array(apart) > most) > 0.95


def test_profile_of_a_text_does_not_depend_on_its_batch():
    texts = ["a b a", "", "x y z " * 40, "a b a"]
    whole = neardup.profiles(neardup._words(pa.array(texts)))
    assert (whole[0] == whole[3]).all() and not whole[1].any()
    assert all((neardup.profiles(neardup._words(pa.array([t])))[0] == w).all() for t, w in zip(texts, whole, strict=True))


def test_wide_profiles_tell_half_different_texts_apart(spark):
    """Texts that share half of their words share a bucket, too: they don't become pairs, and pairs of a similarity of 0.8 do, at any length."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        n, share = (60, 300, 650, 2000)[i % 4], (0.5, 0.8)[i // 4 % 2]
        a = rng.integers(0, 1 << 40, n)
        b = np.where(rng.permutation(n) < round(n * share), a, rng.integers(0, 1 << 40, n))
        for side, x in enumerate((a, b)):
            words = neardup._words(pa.array([" ".join(f"w{v}" for v in x)]))
            rows.append((i, f"{i}-{side}", n, *map(int, neardup.profiles(words, neardup.WIDE)[0].view(np.int64)), side, f"{i}-{side}"))
    marks = [f"p{i}" for i in range(neardup.WIDE)]
    nodes = spark.createDataFrame(rows, "key long, node string, size int, " + ", ".join(f"{m} long" for m in marks) + ", degree int, label string")
    found = {r.key for r in neardup._compare(nodes.where("degree = 0"), nodes.where("degree = 1"), 0.8, neardup.WIDE).select("key").collect()}
    assert {i for i in range(240) if i // 4 % 2} <= found
    assert not [i for i in found if not i // 4 % 2 and i % 4 > 1]
