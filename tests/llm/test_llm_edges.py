"""Edge cases of every operator: nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lexground.llm import arrays, decontam, langid, media, neardup, packing, phrases, quality, queries, shards, urlfilter, warc
from lexground.llm.common import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_hit string, class_id string, kept_text string"
LONG = " ".join(f"word{i % 997}" for i in range(40_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, f"alpha {PASSAGE} omega", "en", "s", 9, "x", "x", "x", "x"),
    (2, f"beta {PASSAGE} psi", "en", None, None, "x", "x", "x", "x"),
    (3, None, None, "s", None, None, None, None, None),
    (4, "", "en", "s", 0, "x", "x", "x", "x"),
    (5, " \t\n ", "en", "s", 4, "x", "x", "x", "x"),
    (6, LONG, "de", "s", None, "x", "x", "x", "x"),
    (7, "Même texte, même fin.", "fr", "s", 21, "x", "x", "x", "x"),
    (7, "Même texte, même fin.", "fr", "s", 21, "x", "x", "x", "x"),
    (None, f"gamma {PASSAGE}", "en", "s", 9, "x", "x", "x", "x"),
    (None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_hashes():
    texts = pa.array(["a  bc\td", None, "", "x", "bc"])
    w = arrays.Words(*arrays.string_parts(texts))
    assert [w.word(i) for i in range(len(w))] == [b"a", b"bc", b"d", b"x", b"bc"] and w.text.tolist() == [0, 0, 0, 3, 4]
    h = w.hashes()
    assert h[1] == h[4] and len(set(h.tolist())) == 4
    sliced = arrays.Words(*arrays.string_parts(texts.slice(3)))
    assert sliced.hashes().tolist() == h[3:].tolist()
    at, _ = w.windows(h, 2)
    assert at.tolist() == [0, 1]


def brute_repeats(rows, size=13):
    """(id, text) -> kept words, by the definition."""
    order = lambda k: (k is None, k or 0)
    first = {}
    split = lambda t: [w.decode() for w in (t or "").encode().split()]
    for k, t in rows:
        w = split(t)
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, order(k)), order(k))
    out = []
    for k, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < order(k):
                gone |= set(range(i, i + size))
        out.append((k, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup(docs, none, spark):
    got = phrases.remove_repeats(docs)
    assert [c for c in docs.columns if c != "kept_text"] + ["n_words", "n_removed", "removed_spans", "kept_text"] == got.columns
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()], key=repr) == brute_repeats([(r[0], r[1]) for r in ROWS])
    assert phrases.remove_repeats(none).count() == 0
    cut = {r.doc_id: r.text for r in phrases.deduplicate(docs).collect()}
    assert cut[2] == "beta psi" and cut[3] is None and cut[5] == " \t\n " and cut[1] == ROWS[0][1]
    own = phrases.deduplicate(docs)
    assert own.schema == docs.schema and sorted(repr((r.doc_id, r.kept_text, r.n_hit)) for r in own.collect()) == sorted(repr((r[0], r[8], r[6])) for r in ROWS)


def test_substring_dedup_random(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(rng.choice(["a", "b", "c"], 40)) for _ in range(6)]
    rows = [(int(i), " ".join([base[rng.integers(6)], *rng.choice(["a", "b", "x", "é"], rng.integers(0, 9)), base[rng.integers(6)]])) for i in rng.permutation(40)]
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()], key=repr) == brute_repeats(rows)


def test_windows_with_equal_low_bits_are_not_mixed_up(monkeypatch):
    """Document 1 has another window whose hash ends in the same 40 bits; document 3 still asks document 2."""
    texts = [" ".join(f"{c}{i}" for i in range(13)) for c in "abb"]
    made = phrases._windows
    other = {texts[0]: (1 << 50) + 5, texts[1]: (1 << 60) + 5}

    def windows(column, size):
        words, at, _ = made(column, size)
        return words, at, np.array([other[t] for t in column.to_pylist()], np.uint64)

    monkeypatch.setattr(phrases, "_windows", windows)
    entries = []
    for i, text in enumerate(texts):
        batch = pa.RecordBatch.from_arrays([pa.array([i + 1], pa.int64()), pa.array([i + 1], pa.int32()), pa.array([text])], names=["id", "bucket", "text"])
        entries += phrases._probe(1, 13)(iter([batch]))
    noted = phrases._match(pa.Table.from_batches(entries)).to_pylist()
    got = [(x["kind"], x["bucket"], r["src"], r["block"]) for x in noted for r in np.frombuffer(x["data"], phrases._PLACE)]
    assert sorted(got) == [(phrases.WANT, 3, 2, 0), (phrases.CUT, 2, 2, 0)]


def test_automaton_finds_every_window():
    words = PASSAGE.split()
    m = phrases.Automaton([(1, PASSAGE)], 13)
    for start in range(0, 48):
        starts, _ = m.spans(["q", *words[start : start + 13], "r"], 2)
        assert starts.tolist() == [1]
    assert not len(m.spans(words[:12], 2)[0]) and not len(m.spans(words, 1)[0])


def test_automaton_against_all_windows():
    """Words of a small vocabulary, so that phrases stand in many passages and at many places of one."""
    rng = np.random.default_rng(3)
    for size in (13, 5, 7):
        passages = [(int(rng.integers(5)), " ".join(rng.choice(["a", "b", "é"], rng.integers(size, 60)))) for _ in range(12)]
        m = phrases.Automaton(passages, size)
        for key in (0, 2, 9):
            for _ in range(10):
                src, passage = passages[int(rng.integers(12))]
                words = [*rng.choice(["a", "b", "z"], rng.integers(0, 9)), *passage.split(" ")[int(rng.integers(9)) :], *rng.choice(["a", "b"], 4)]
                have = {tuple(w[i : i + size]) for s, p in passages if s < key for w in [p.split(" ")] for i in range(len(w) - size + 1)}
                assert m.spans(words, key)[0].tolist() == [i for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in have]


def test_near_duplicates(docs, none, spark):
    got = neardup.near_duplicates(docs)
    by = sorted([(r.doc_id, r.class_id, r.class_size) for r in got.collect()], key=repr)
    assert by == sorted([(1, 1, 3), (2, 1, 3), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1), (7, 7, 2), (7, 7, 2), (None, 1, 3), (None, None, 1)], key=repr)
    assert got.columns == [c for c in docs.columns if c != "class_id"] + ["class_id", "class_size"]
    assert neardup.near_duplicates(none).count() == 0


def lcs(a, b):
    """By the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def all_pairs(texts, least=0.8):
    """Group of every text: links by the alignment of all pairs of texts."""
    words = [t.lower().replace(",", " ").replace("!", " ").split() for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(words):
        for j, y in enumerate(words[:i]):
            if label[i] != label[j] and (n := len(x) + len(y)) and 2 * min(len(x), len(y)) >= least * n and 2 * lcs(x, y) >= least * n:
                a, b = label[i], label[j]
                label = [min(a, b) if z in (a, b) else z for z in label]
    return label


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(15):
        base = list(rng.choice(vocab, int(rng.integers(40, 160))))
        for _ in range(int(rng.integers(1, 6))):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(own) // 16))):
                own[int(rng.integers(len(own)))] = str(rng.choice(vocab))
            if g % 3 == 0:
                del own[: int(rng.integers(0, 1 + len(own) // 20))]
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["one two three", "One, two three!", "one two four"])]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == dict(enumerate(all_pairs([t for _, t in rows])))


def test_edits_spread_over_a_text():
    """14 edits in 200 words leave a third of the five-word shingles or less of one another, and are an alignment of 0.93."""
    a = np.arange(200).astype(np.uint64)
    b = a.copy()
    b[7::14] += np.uint64(1000)
    assert neardup.similarity(a, b, 0.8) == 2 * (200 - len(b[7::14])) / 400


def test_similarity_is_that_of_the_whole_table():
    rng = np.random.default_rng(9)
    for _ in range(60):
        a = list(rng.integers(0, 6, rng.integers(1, 40)))
        b = [x for x in a if rng.random() > 0.15]
        b[len(b) // 2 : len(b) // 2] = list(rng.integers(0, 6, rng.integers(0, 8)))
        want = 2 * lcs(a, b) / (len(a) + len(b))
        got = neardup.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert np.isclose(got, want) if want >= 0.8 else got == 0


def test_one_document_of_each_group_stays(spark, docs):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(2, text, "keep"), (2, text, "keep"), (3, text, "keep"), (2, text + " more", "keep"), (None, "only nulls here", "keep"), (None, "only nulls here", "keep"), (9, None, "keep"), (9, None, "keep"), (8, "", None), (7, "other text", "keep")]
    table = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = neardup.keep_one(table)
    assert got.columns == table.columns and got.schema == table.schema
    kept = got.collect()
    assert sorted((repr(r.doc_id), r.text is None) for r in kept) == sorted([("2", False), ("None", False), ("9", True), ("9", True), ("8", False), ("7", False)])
    assert {r.class_id for r in kept} == {"keep", None}
    assert neardup.keep_one(docs).columns == docs.columns and neardup.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("last", [0, 100_000])
def test_near_duplicates_of_borderline_copies(spark, monkeypatch, last):
    """Copies that are close to their base but not to each other are one group, as by all pairs."""
    monkeypatch.setattr(neardup, "LAST_PAIRS", last, raising=False)
    monkeypatch.setattr(neardup, "LAST_EACH", 64 if last else 0)  # without either, rounds of representatives
    rng = np.random.default_rng(12)
    rows = []
    for copies in (100, 20, 40):
        base = [f"b{copies}w{i}" for i in range(150)]
        texts = [base]
        for c in range(copies):
            own = list(base)
            for place in rng.choice(150, 3, replace=False):
                own[place] = f"c{c}p{place}"
            texts.append(own)
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    words = [np.unique(t.split(" "), return_inverse=True) for _, t in rows]
    hashes = [np.array([hash(w) & (2**64 - 1) for w in names], np.uint64)[at] for names, at in words]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and neardup.similarity(hashes[i], hashes[j], neardup.SIMILAR) >= neardup.SIMILAR:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert got == dict(enumerate(label))


def test_the_last_round_forms_a_pair_once(spark):
    """Of two nodes that share several keys, and whichever are left of their buckets, the first key forms the pair."""
    keys = {"a": [5, 2, 3], "b": [2, 3, 4], "c": [9, 4, 5]}
    marks = [f"p{i}" for i in range(neardup.WIDE)]
    rows = spark.createDataFrame([(k, n, 10, 1, n, own) for n, own in keys.items() for k in own], "key long, node string, size int, degree long, label string, keys array<long>")
    rows = rows.select("*", *[F.lit(0).cast("long").alias(m) for m in marks])
    pairs = lambda once: sorted((r.node, r.rep) for r in neardup._compare(rows, rows, 0.8, neardup.WIDE, once).collect())
    assert pairs(True) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]
    assert len(pairs(False)) == 8


def test_banded_lcs():
    rng = np.random.default_rng(8)
    for _ in range(30):
        a, b = list(rng.integers(0, 4, rng.integers(1, 14))), list(rng.integers(0, 4, rng.integers(1, 14)))
        for band in (1, 3, 20):
            d = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    hit = d[i, j] + 1 if x == y and abs(i - j) <= band else 0
                    d[i + 1, j + 1] = max(d[i, j + 1], d[i + 1, j], hit)
            assert neardup.banded_lcs(a, b, band) == d[-1, -1]


def test_components(spark):
    edges = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(40) if i % 13] + [(b"100", b"100")]
    got = {bytes(r.node): bytes(r.label) for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got[b"012"] == b"001" and got[b"026"] == b"014" and len(set(got.values())) == 3 and b"100" not in got


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame([(10, PASSAGE[: PASSAGE.index(" p13")]), (9, "même fin"), (8, None), (7, "..."), (None, "gamma")], "item_id long, text string")
    got = decontam.find_contamination(docs, bench)
    by = {(r.doc_id, r.text): r for r in got.collect()}
    first = by[1, ROWS[0][1]]
    assert (first.n_words, first.n_hit, first.hit_items, first.contaminated) == (62, 13, ["10"], True)
    assert [(s.start, s.end) for s in first.hit_spans] == [(1, 14)]
    fin = by[7, ROWS[6][1]]
    assert (fin.n_words, fin.n_hit, fin.hit_items) == (4, 2, ["9"])
    assert by[None, ROWS[8][1]].hit_items == ["", "10"] and by[3, None].n_words == 0 and not by[4, ""].contaminated
    assert by[6, LONG].n_words == 40_000
    assert decontam.find_contamination(none, bench).count() == 0
    assert decontam.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    # A benchmark over the bound goes through in parts, with the same result.
    parts = decontam.find_contamination(docs, bench, most_bytes=40)
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, got.collect()))
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 5
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, "span").collect() if r.doc_id}
    assert cut[7] == "Même texte" and cut[3] is None


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (7, 0), (7, 1), (None, 1), (4, None)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    got = quality.score(docs, m)
    assert got.count() == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.collect())
    assert quality.score(none, quality.fit(none, labels)).count() == 0
    assert quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels.limit(0))).count() == len(ROWS)


def test_user_columns_keep_their_values(spark):
    rows = [(i, f"text {i} {PASSAGE}", "keep", 7, "keep", "keep", "keep", "keep") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int, n_hit string, n_words string, kept_text string, hit_items string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "text 3 p0")], "item_id long, text string")
    for out in (quality.accept(docs, quality.fit(docs, labels), threshold=0.0), decontam.decontaminate(docs, bench, size=3), decontam.decontaminate(docs, bench, "span", size=3), phrases.deduplicate(docs)):
        got = out.collect()
        assert out.schema == docs.schema and len(got) >= 3 and {tuple(r)[2:] for r in got} == {("keep", 7, "keep", "keep", "keep", "keep")}


def test_sample_of_the_classifier_is_bounded(spark):
    """Ids with several rows count once, and a text has at most one entry a column."""
    long = " ".join(f"w{i}" for i in range(100_000))
    starts, cols, _, _ = quality.featurise(pa.array([long, None, "a a b"]), np.full(3, np.nan))
    assert np.diff(starts).tolist()[1:] == [0, 2] and starts[1] <= quality.DIMS and len(set(cols[: starts[1]].tolist())) == starts[1]
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    seen = []
    real = quality.train
    try:
        quality.train = lambda examples, **k: seen.append(len(examples)) or real(examples, **k)
        quality.fit(docs, labels)
        quality.fit(docs, labels, max_rows=10)
    finally:
        quality.train = real
    assert seen[0] == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(50)) and seen[1] < 20


def test_benchmark_set_is_small():
    items = [(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(100)]
    g = decontam.Grams(items, 13)
    held = len(g.text) + sum(a.nbytes for w in g.windows.values() for a in w)
    assert held <= decontam.SET_BYTES * sum(len(t) for _, t in items)


def test_factorisation_identity():
    rng = np.random.default_rng(3)
    m = quality.Machine(np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)), 1)
    m.v = rng.normal(size=m.v.shape).astype(np.float32)
    col, val = np.array([5, 9, 70]), np.array([0.5, -1.0, 2.0], np.float32)
    pairs = sum(float(m.v[col[i]] @ m.v[col[j]]) * val[i] * val[j] for i in range(3) for j in range(i))
    assert np.isclose(m.margin(np.zeros(3, int), col, val, 1)[0][0], pairs, atol=1e-4)


def test_machine_learns_an_interaction():
    """Two words are good apart and bad together: no linear model tells."""
    stats = np.zeros(len(quality.STATS), np.float32)
    x = [(np.array([1], np.int32), np.ones(1, np.float32), stats, 1), (np.array([2], np.int32), np.ones(1, np.float32), stats, 1), (np.array([1, 2], np.int32), np.ones(2, np.float32), stats, 0), (np.array([3], np.int32), np.ones(1, np.float32), stats, 0)]
    m = quality.train(x * 40, epochs=60, batch=16)
    got = [float(m.score(np.array([0, len(c)]), c, v, s[None])[0]) for c, v, s, _ in x]
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] < 0.5 and got[3] < 0.5


def test_language_id(docs, none, spark):
    train = spark.createDataFrame([("the house is here", "en"), ("das haus ist hier", "de"), ("la maison est ici", "fr"), (None, "en"), ("nolang", None)] * 3, "text string, lang string")
    model = langid.fit(train)
    assert model["langs"] == ["de", "en", "fr"]
    ask = spark.createDataFrame([(1, "The house"), (2, "Das Haus"), (3, "maisonette"), (4, None), (5, "123 ... ²"), (6, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(ask, model).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "fr", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(docs, model).count() == len(ROWS)
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(ask, langid.fit(train.limit(0))).collect()} == {"und"}


def test_every_counted_word_is_known(spark):
    """The bounds of the broadcasts don't change the result, and a word's counts in all languages are used."""
    rows = [("the " * 50 + "rare xylem", "en"), ("das " * 50 + "xylem xylem xylem selten", "de")] * 2
    train = spark.createDataFrame(rows, "text string, lang string")
    ask = spark.createDataFrame([(1, "xylem"), (2, "rare"), (3, "selten the"), (4, "unknown rarest"), (5, None)], "doc_id long, text string")
    ways = [{}, {"max_words": 1}, {"max_words": 0}, {"cells": 0}, {"cells": 6}]
    models = [langid.fit(train, **way) for way in ways]
    assert [len(m["words"][0]) for m in models] == [5, 1, 0, 0, 3] and [bool(m["grams"]) for m in models] == [True, True, True, False, False]
    assert list(models[1]["words"][0]) == ["das"]  # as frequent as "the", and first by name
    whole, *others = ({r.doc_id: (r.lang_pred, r.score) for r in langid.predict(ask, m).collect()} for m in models)
    n, t = {"en": 2.5, "de": 6.5}, {"en": 105, "de": 109}
    odds = n["en"] / t["en"] / (n["de"] / t["de"])
    assert whole[1][0] == "de" and abs(whole[1][1] - 1 / (1 + odds)) < 1e-6
    for other in others:
        assert {k: v[0] for k, v in whole.items()} == {k: v[0] for k, v in other.items()}
        assert all(abs(whole[k][1] - other[k][1]) < 1e-5 for k in whole)


def brute_languages(train, texts):
    """Language and score of each text by the definition: counts, smoothed logs, back-off to n-grams."""
    words = lambda t: regex.findall(r"\p{L}+", t.lower()) if t else []
    langs = sorted({lang for t, lang in train if t is not None and lang is not None})
    count, grams = {lang: Counter() for lang in langs}, {}
    for t, lang in train:
        if t is not None and lang is not None:
            count[lang].update(words(t))
    for lang in langs:
        for w, n in count[lang].items():
            for k in (1, 2, 3, 4):
                for i in range(len(w) + 3 - k):
                    grams.setdefault((k, f"^{w}$"[i : i + k]), Counter())[lang] += n
    size = {(k, lang): sum(c[lang] for (j, _), c in grams.items() if j == k) for k in (1, 2, 3, 4) for lang in langs}
    out = []
    for t in texts:
        total = dict.fromkeys(langs, 0.0)
        for w in words(t):
            if any(count[x][w] for x in langs):
                own = {x: math.log((count[x][w] + 0.5) / (count[x].total() + 1)) for x in langs}
            else:
                m, own, found = f"^{w}$", dict.fromkeys(langs, 0.0), 0
                for i in range(len(m)):
                    k = next((k for k in (4, 3, 2, 1) if i + k <= len(m) and (k, m[i : i + k]) in grams), None)
                    if k:
                        found += 1
                        for x in langs:
                            own[x] += math.log((grams[k, m[i : i + k]][x] + 0.5) / (size[k, x] + 2))
                own = {x: v * 2 / max(1, found) for x, v in own.items()}
            for x in langs:
                total[x] += own[x]
        n = len(words(t))
        best = max(langs, key=lambda x: total[x]) if n else "und"
        out.append((best, 1 / sum(math.exp((v - total[best]) / (1 + math.log(n))) for v in total.values()) if n else 0.0))
    return out


def test_language_id_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 5]
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.001").collect()}
    for r, (lang, score) in zip(docs, brute_languages(train, [r.text for r in docs]), strict=True):
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-4


def test_packing(docs, none):
    paths = packing.public_paths()
    cut = packing.pieces(docs, *paths, size=64, keep_ids=True)
    out = packing.pack(cut, 64).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(paths[1])
    six = sorted(by_doc[6], key=lambda r: r.piece)
    assert [i for r in six for i in r.ids] == [*t.encode(LONG, add_special_tokens=False).ids, 0]
    assert {r.length for r in six[1:]} == {64} and [r.start for r in six] == list(np.cumsum([0, *(r.length for r in six[:-1])]))
    assert [(r.piece, r.start, r.length, r.ids) for r in by_doc[3]] == [(0, 0, 1, [0])]
    assert packing.pack(packing.pieces(none, *paths)).count() == 0


def test_special_strings_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    paths = packing.public_paths()
    e, t = packing.Encoder(*paths), Tokenizer.from_file(paths[1])
    for x in ["a <|endoftext|> b", "<|", "é  \n x", "it's 'LL 12", " ", "￿😀"]:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_bin_completion(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(21, np.int64)
    for s in rng.integers(1, 21, 12):
        counts[s] += 1
    plan, bound = packing.pack_counts(counts, 20)
    got = np.zeros(21, np.int64)
    for times, p in plan:
        assert sum(p) <= 20
        for v in p:
            got[v] += times
    assert (got == counts).all()
    n = sum(t for t, _ in plan)
    assert bound <= n <= sum(t for t, _ in packing.best_fit(counts, 20))
    items = sorted([s for s in range(21) for _ in range(counts[s])], reverse=True)

    def fits(k, i, left):
        if i == len(items):
            return True
        seen = set()
        for b in range(k):
            if left[b] >= items[i] and left[b] not in seen:
                seen.add(left[b])
                left[b] -= items[i]
                if fits(k, i + 1, left):
                    return True
                left[b] += items[i]
        return False

    assert n == next(k for k in range(1, 13) if fits(k, 0, [20] * k))


def test_exact_packing():
    rng = np.random.default_rng(5)
    for _ in range(40):
        size = int(rng.integers(8, 30))
        items = sorted(rng.integers(1, size + 1, rng.integers(1, 10)).tolist(), reverse=True)
        counts = np.bincount(items, minlength=size + 1)
        plan, _ = packing.pack_counts(counts, size, exact=True)
        assert all(sum(p) <= size for _, p in plan) and (sum(np.bincount(p, minlength=size + 1) * t for t, p in plan) == counts).all()
        reach = {(): 0}  # rooms of the sequences in use, sorted -> their number
        for x in items:
            new = {}
            for rooms, n in reach.items():
                for i in range(len(rooms)):
                    if rooms[i] >= x:
                        new[tuple(sorted((*rooms[:i], rooms[i] - x, *rooms[i + 1 :])))] = n
                key = tuple(sorted((*rooms, size - x)))
                new[key] = min(new.get(key, n + 1), n + 1)
            reach = new
        assert sum(t for t, _ in plan) == min(reach.values())


def test_ids_are_those_of_the_tokenizer():
    """Of every text of a hundredth of the scale."""
    from tokenizers import Tokenizer

    paths = packing.public_paths()
    e, t = packing.Encoder(*paths), Tokenizer.from_file(paths[1])
    texts = [x for x in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchnumpy()["text"]]
    for text, own in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == own.ids


def test_search_beats_best_fit():
    """Best fit decreasing takes three sequences here, two are enough."""
    counts = np.zeros(11, np.int64)
    for s in (4, 4, 3, 3, 3, 3):
        counts[s] += 1
    assert sum(t for t, _ in packing.best_fit(counts, 10)) == 3
    assert sum(t for t, _ in packing.pack_counts(counts, 10)[0]) == 2


def test_shards(docs, none, spark):
    out = shards.shard(docs, 3).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(r["size"] for r in out) == sorted(size(r[1]) for r in ROWS)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert shards.shard(none, 3).count() == 0
    same = spark.createDataFrame([(5, "x")] * 600, "doc_id long, text string").repartition(3)
    counts = [r["count"] for r in shards.shard(same, 6, ranges=24).groupBy("shard").count().collect()]
    assert counts == [100] * 6


def test_shard_sizes_with_a_hot_key_and_large_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(7 if i % 3 == 0 else int(rng.integers(1000)), "x" * int(rng.pareto(1) * 40 % 5000)) for i in range(1500)]
    out = shards.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8, ranges=64).groupBy("shard").sum("size").collect()
    total = sum(len(t) + 8 for _, t in rows)
    assert len(out) == 8 and all(abs(r[1] - total / 8) <= 5100 for r in out)


def test_range_search(spark):
    marks = [3, 7, 8, 20]
    got = {r.key: r.r for r in spark.range(-2, 25).withColumnRenamed("id", "key").withColumn("r", shards._range_of("key", marks)).collect()}
    assert got == {k: sum(m <= k for m in marks) for k in range(-2, 25)}


def test_url_filter(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", ""), ("block", "tie.io", "/a"), ("allow", "tie.io", "/a"), ("allow", "x.org", "/")]
    urls = ["http://A.Example.COM/en/77?q", "http://com/en/", "https://com/en", "x.com/en/", None, "://", "http://m.org?x", "http://x.org#f", "http://x.org/q", "http://notexample.com/en/7", "http://tie.io/abc", "a://b://com/en/1"]
    pages = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, rules).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("a.example.com", "/en/77", "example.com/en/7", "allow"),
        ("com", "/en/", "com/en/", "block"),
        ("com", "/en", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("m.org", "", "org", "block"),
        ("x.org", "", "org", "block"),
        ("x.org", "/q", "x.org/", "allow"),
        ("notexample.com", "/en/7", "com/en/", "block"),
        ("tie.io", "/abc", "tie.io/a", "block"),
        ("b:", "//com/en/1", None, "allow"),
    ]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    again = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, table).collect()}
    assert again == got and urlfilter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.filter_urls(pages, [], default="block").collect()} == {"block"}


def test_many_rules_below_one_segment():
    t = urlfilter.Trie([("block", "h.com", f"/en/{i}") for i in range(3000)])
    node = t.root["h", "com"]["h", "h"]["p", ""]["p", "en"]
    assert node["sizes"] == [4, 3, 2, 1] and t.judge("h.com", "/en/29999")[1] == "h.com/en/2999" and t.judge("h.com", "/en/x") is None


def test_url_rules_in_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.com/en/{i}") for i in range(50)], "page_id long, url string")
    rules = [("block", "com", "/en/"), *[("allow", f"h{i}.com", f"/en/{i}") for i in range(7)], ("block", "h1.com", "/en/15")]
    want = sorted(map(tuple, urlfilter.filter_urls(pages, rules).collect()))
    monkeypatch.setattr(urlfilter, "RULES_PER_TRIE", 2)
    assert sorted(map(tuple, urlfilter.filter_urls(pages, rules).collect())) == want


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 200
    rows = [(3, "http://a b/é", big), (1, "http://x", big), (2, None, "short"), (5, "http://y", "short"), (4, "dns:x", None), (None, "http://z", big), (1, "http://x", big), (6, "http://n", "a\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    for version in (1, 2, None):
        path = scratch_path(spark, "t-warc")
        warc.write_warc(warc.mark_revisits(warc.convert_arc(warc.write_arc(pages, version))), path)
        got = warc.read_warc(spark, path, payloads=True).where("record_type <> 'warcinfo'").collect()
        assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in got) == sorted((k or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for k, _, h in rows)
        kinds = sorted(((r.page_id or 0, r.record_type, r.refers_to) for r in got), key=repr)
        assert kinds == sorted([(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None)], key=repr)
        assert all((r.payload or b"").decode() in {h or "" for _, _, h in rows} for r in got)
    assert warc.convert_arc(warc.write_arc(pages.limit(0))).count() == 0


def test_record_ids_differ_with_the_payload(spark):
    """Batches with equal ids, urls and lengths but other html, and equal batches in other tasks."""
    rows = [(1, "http://x", html) for html in ("aaaa", "bbbb", "aaaa")]
    ids = [r.record_id for r in warc.convert_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3, "html")).collect()]
    again = [r.record_id for r in warc.convert_pages(spark.sparkContext.parallelize(rows, 3).toDF("page_id long, url string, html string")).collect()]
    assert len(set(ids)) == len(ids) and len(set(again)) == len(again) == 6


def test_warc_files_are_unpacked_piece_by_piece():
    import gzip

    block = b"z" * 3_000_000
    one = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    small = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    for content in (one + small + one, gzip.compress(one) + gzip.compress(small + one), gzip.compress(one + small + one)):
        got = list(warc.warc_records(content))
        assert [len(b) for *_, b in got] == [3_000_000, 0, 3_000_000] and [at for at, *_ in got] == [0, len(one), len(one) + len(small)]
    assert max(map(len, warc._inflated(gzip.compress(block + bytes(np.random.default_rng(1).bytes(1_000_000)))))) < 4_000_000
    assert len(list(warc._inflated(gzip.compress(bytes(np.random.default_rng(1).bytes(1_000_000)))))) > 50
    with pytest.raises(ValueError):
        list(warc.warc_records(one[:100]))


def test_arc_lines_of_both_versions():
    v1 = b"filedesc://x.arc 0.0.0.0 20010203 text/plain 76\n1 0 Origin\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = v1[v1.index(b"\n") + 1 :]
    v1 = v1.replace(b" 76\n", f" {len(body)}\n".encode())
    content = v1 + b"\nhttp://a/ 1.2.3.4 20010203040506 text/html 3\nabc\ndns:a 1.2.3.4 2001 text/dns 0\n\n"
    got = list(warc.arc_records(content))
    assert [h["URL"] for _, h, _ in got] == ["filedesc://x.arc", "http://a/", "dns:a"] and got[1][2] == b"abc" and got[2][2] == b""
    assert warc._date("20010203040506") == "2001-02-03T04:05:06Z" and warc._date("2001") == "2001-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.arc_records(v1 + b"\nhttp://a/ 1.2.3.4 20010203040506 text/html 30\nabc\n"))
    with pytest.raises(ValueError):
        list(warc.arc_records(b"nonsense\n"))


def test_media_round_trip(docs, none, spark):
    path = scratch_path(spark, "t-media")
    media.store(docs, path)
    got = media.features(media.load(spark, path)).collect()
    want = sorted((r[0] or -1, len((r[1] or "").encode()), hashlib.sha256(media.payload_of(r[1])).hexdigest(), zlib.crc32(media.payload_of(r[1])[-32:])) for r in ROWS)
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 for r in got)
    empty = scratch_path(spark, "t-media")
    media.store(none, empty)
    assert media.load(spark, empty).count() == 0


def test_media_figures(spark):
    """Stored form and feature, from the PNG format and plain counts."""
    texts = {1: "", 2: "aé" * 700, 3: "x" * 576, 4: None}
    path = scratch_path(spark, "t-media")
    media.store(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path)
    for r in media.features(media.load(spark, path)).collect():
        payload = (texts[r.doc_id] or "").encode()
        payload += b"\xff" * (-len(payload) % 576 if payload else 576)
        lines = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
        png = b"\x89PNG\r\n\x1a\n"
        for kind, body in ((b"IHDR", (576).to_bytes(4, "big") + (len(payload) // 576).to_bytes(4, "big") + b"\x08\0\0\0\0"), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b"")):
            png += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        n = len(payload)
        mean = sum(payload) / n
        dev = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
        bits = -sum(c / n * math.log2(c / n) for c in Counter(payload).values())
        bands = [sum(x // 32 == k for x in payload) / n for k in range(8)]
        want = [mean, dev, bits, *bands]
        got = [float(x) for x in r.feature.replace("mean=", "").replace("dev=", "").replace("bits=", "").replace("bands=", "").replace(";", ",").split(",")]
        assert np.allclose(got, want, atol=1e-4)


def test_number_of_media_ranges_is_bounded(tmp_path):
    path = f"file://{tmp_path}/m"
    w = media.ArchiveWriter({"path": path, "file_bytes": "20000"})
    members = {i: bytes([i]) * 1000 for i in range(100)}
    w.commit([w.write(iter([media._batch(list(members), list(members.values()))]))])
    reader = media.ArchiveReader({"path": path, "range_bytes": "10", "most_ranges": "8"})
    parts = reader.partitions()
    assert len(parts) <= 8
    assert {k: m for p in parts for b in reader.read(p) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} == members


def test_many_archives_share_few_ranges(tmp_path):
    """Five hundred archives in at most twenty ranges; without a bound small files still share one."""
    path = f"file://{tmp_path}/m"
    w = media.ArchiveWriter({"path": path, "file_bytes": "1"})  # a file for each member
    members = {i: bytes([i % 256]) * (1 + i % 90) for i in range(500)}
    message = w.write(iter([media._batch(list(members), list(members.values()))]))
    w.commit([message])
    assert len(message.files) == 500
    for options, most in (({"range_bytes": "10", "most_ranges": "20"}, 20), ({}, 1)):
        reader = media.ArchiveReader({"path": path} | options)
        parts = reader.partitions()
        assert len(parts) <= most
        rows = [(k, m) for p in parts for b in reader.read(p) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert len(rows) == 500 and dict(rows) == members
    assert [p.spans for p in media.ArchiveReader({"path": f"file://{tmp_path}/none"}).partitions()] == [[]]


def test_media_ranges_and_retries(tmp_path, monkeypatch):
    path = f"file://{tmp_path}/m"
    w = media.ArchiveWriter({"path": path, "file_bytes": "3000"})
    members = {i: bytes([i]) * (i * 50) for i in range(40)}
    message = w.write(iter([media._batch(list(members), list(members.values()))]))
    assert len(message.files) > 5
    # Files of a task that did not commit are not read.
    w.write(iter([media._batch([99], [b"lost"])]))
    w.commit([message])
    reader = media.ArchiveReader({"path": path, "range_bytes": "700"})
    parts = reader.partitions()
    assert len(parts) > len(message.files)
    real, failed = media.read_member, set()

    def flaky(f, offset):
        if offset % 3 == 0 and (id(f), offset) not in failed and len(failed) < 50:
            failed.add((id(f), offset))
            raise OSError("lost connection")
        return real(f, offset)

    monkeypatch.setattr(media, "read_member", flaky)
    got = {k: m for p in parts for b in reader.read(p) for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert got == members and failed
    monkeypatch.setattr(media, "read_member", real)
    with open(f"{tmp_path}/m/{message.files[0][0]}", "r+b") as f:
        f.seek(30)
        f.write(b"!!")
    with pytest.raises(OSError):
        [b for p in parts for b in reader.read(p)]


def test_png_is_lossless():
    for text in ("", "é" * 1000, None, "x" * 576):
        payload = media.payload_of(text)
        assert media.decode_png(media.encode_png(payload)).tobytes() == payload
