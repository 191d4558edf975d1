"""SimHash against plain Python: fingerprints, edited texts, neighbours within a radius."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexground.llm import simhash
from lexground.llm.arrays import _BASE, _STEP

MASK = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & MASK
    return x ^ (x >> 31)


def hashed(values, base):
    return mixed((sum((v + 1) * pow(base, i, 1 << 64) for i, v in enumerate(values)) + len(values)) & MASK)


def plain(text):
    """The fingerprint, term by term and bit by bit."""
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = [hashed(w, _BASE) for w in low.split()]
    terms = Counter(hashed(p, _STEP) for p in zip(words, words[1:], strict=False)) if len(words) > 1 else Counter(words)
    out = b""
    for lane in range(simhash.BITS // 64):
        votes = [0] * 64
        for term, count in terms.items():
            h, weight = mixed(term ^ mixed(lane + 1)).to_bytes(8, "little"), round(16 * (1 + math.log(count)))
            for k in range(64):
                votes[k] += weight if h[k // 8] >> (7 - k % 8) & 1 else -weight
        out += bytes(sum((votes[8 * j + k] > 0) << (7 - k) for k in range(8)) for j in range(8))
    return out.hex()


TEXTS = [None, "", " ", "one", "One", "two words", "a b a b a b", "é à ü " * 40, "x" * 5000, "copy of it all", "copy of it all", "copy OF it all ", "tab\tand\nline"]


def test_fingerprints_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(TEXTS)], "doc_id long, text string, `a.b` string")
    out = {r.doc_id: r for r in simhash.fingerprint(docs).collect()}
    assert [out[i].fingerprint for i in range(len(TEXTS))] == [plain(t) for t in TEXTS]
    assert all(r["a.b"] == "keep" for r in out.values()) and simhash.fingerprint(docs.limit(0)).count() == 0


def away(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edited_by_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = [(i, "".join(rng.choice("ab é𝄞 ") for _ in range(rng.choice([0, 1, 7, 300])))) for i in rng.sample(range(1000), 60)]
    rows += [(5000, "same id"), (5000, "same id"), (5000, "other text"), (None, "no id"), (None, None), (6000, "long " * 50_000)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    out = simhash.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    line = sorted(rows, key=lambda r: (-(-1 if r[0] is None else r[0]), hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = []
    for (i, text), (_, after) in zip(line, line[1:] + line[:1], strict=True):
        text, after = text or "", after or ""
        h = len(text) // 2
        new = text[: len(text) - h] + after[:h]
        a, b, c = plain(text), plain(new), plain(after)
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, 1 - away(a, b) / simhash.BITS, 1 - away(a, c) / simhash.BITS))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_edited_of_one_and_none(spark):
    one = spark.createDataFrame([(1, "ab cd")], "doc_id int, text string")
    row = simhash.edited(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest() and row.near_next == 1.0
    assert simhash.edited(one.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "kept"), [(0, 1), (3, 1), (8, 1), (8, 2), (40, 1)])
def test_search_by_brute_force(spark, radius, kept, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_QUERIES", 30)
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2, (6, simhash.BITS))
    rows = []
    for i in range(150):
        bits = base[i % 6].copy()
        bits[rng.choice(simhash.BITS, rng.integers(0, 2 * radius + 2), replace=False)] ^= 1
        rows.append(np.packbits(bits).tobytes().hex())
    rows += rows[:20]  # equal fingerprints
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(rows)] + [(999, None)], "id long, fingerprint string")
    out = {r.fingerprint: r.n_near for r in simhash.search(prints.where("id % 3 = 0"), prints, radius, kept).collect()}
    assert out == {rows[i]: sum(away(rows[i], f) <= radius for f in rows) for i in range(0, len(rows), 3)}
    both = simhash.with_neighbours(prints, F.col("id") % 3 == 0, radius).collect()
    assert {r.id: r.n_near for r in both} == {i: out[f] - 1 if i % 3 == 0 else None for i, f in enumerate(rows)} | {999: None}


def test_edits_are_nearer_than_neighbours(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = simhash.edited(docs).where("n_chars > 200").collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.99 * len(rows)
