"""Collocations against plain Python counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexground.llm import collocations


def plain(rows, least, top, percent=100):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        long = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in long.items():
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in long.items())
            if not inside:
                score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "A", "c", "dé", "É", "é", "x y", "𝄞", "the", "of"]
    rows = []
    for _ in range(n):
        line = [rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.choice([0, 1, 3, 20, 60]))]
        rows.append((rng.choice([None, "en", "en", "en", "fr"]), "".join(line)))
    rows += [("en", None), ("en", ""), ("fr", " \t\n.,"), ("de", "one two three four five six " * 300), ("es", "same same same " * 4000)]
    return rows + rows[:50]


@pytest.mark.parametrize(("least", "top", "percent"), [(5, 2000, 100), (20, 7, 100), (3, 50, 60)])
def test_by_brute_force(spark, least, top, percent):
    rows = texts(least)
    docs = spark.createDataFrame([(*r, "keep") for r in rows], "lang string, text string, `a.phrase` string").repartition(5)
    out = sorted(map(tuple, collocations.mine(docs, least=least, top=top, percent=percent).collect()))
    assert out == plain(rows, least, top, percent) and out


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """With a small bitmap, or with all bits set, a pass counts more phrases and finds the same."""
    rows = texts(1)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = plain(rows, 4, 100)
    assert sorted(map(tuple, collocations.mine(docs, least=4, top=100, width=15).collect())) == want
    monkeypatch.setattr(collocations, "_bitmap", lambda frequent, width: np.full(1 << (width - 3), 255, np.uint8))
    assert sorted(map(tuple, collocations.mine(docs, least=4, top=100).collect())) == want


def test_chunks_hold_each_phrase_once(spark):
    """Counts in the dictionary are those of the texts, and repeated passages share chunks."""
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(5000)}" for _ in range(2000))
    rows = [("en", f"{rng.random()} {passage} {rng.random()}") for _ in range(20)]
    chunks = collocations.dictionary(spark.createDataFrame(rows, "lang string, text string")).collect()
    sizes = [len(r.chunk.split(" ")) for r in chunks]
    assert sum(r.n * (s - 4 * r.follows) for r, s in zip(chunks, sizes, strict=True)) == 20 * 2004  # a point cuts each number
    assert sum(s for r, s in zip(chunks, sizes, strict=True) if r.n == 20) > 1900 and sum(sizes) < 6000


def test_products_beyond_64_bits(spark):
    big = 10**12
    phrases = spark.createDataFrame([("en", "a b", 2, big - 1), ("en", "a", 1, 3 * big), ("en", "b", 1, big + 7)], "lang string, phrase string, size int, f long")
    totals = spark.createDataFrame([("en", 10**13 + 1)], "lang string, n long")
    row = collocations.scored(phrases, totals).first()
    assert row.score == 1000 * (big - 1) * (10**13 + 1) // (3 * big * (big + 7))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(docs).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", " .")], "lang string, text string")).count() == 0
