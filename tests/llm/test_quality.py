"""The classifier by plain loops: features, scores over all pairs, and the fit by the gradient of the same sums."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lexground.llm import quality
from lexground.llm.arrays import _BASE

MASK = (1 << 64) - 1
TEXTS = ["Good plain words, in a line.\nAnd a second ONE here.", "spam spam spam !!! $$$ 99", None, "", "été é 12 a b a b a", "WORD", "x " * 700 + "END!"]


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & MASK
    return x ^ (x >> 31)


def column(word):
    h = mixed((sum((v + 1) * pow(_BASE, i, 1 << 64) for i, v in enumerate(word)) + len(word)) & MASK)
    return mixed(h) % quality.DIMS


def features(text, chars):
    """({column: value}, statistics) of one text."""
    raw = (text or "").encode()
    words = raw.split()
    n, size = len(words), len(raw)
    counts = Counter(words)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    share = lambda chosen: sum(chosen(b) for b in raw) / max(size, 1)
    of_words = lambda flags: sum(flags) / max(n, 1)
    marks = b"!?#$%&*+/<=>@[\\]^_`{|}~"
    upper = lambda w: sum(65 <= b <= 90 for b in w)
    stats = [
        math.log1p(n), math.log1p(size if chars is None else chars), (size - n) / max(n, 1), share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), share(lambda b: b in b".,;:'\"()-"),
        share(lambda b: b in marks), share(lambda b: b in b" \t\r"), share(lambda b: b == 10), share(lambda b: b >= 128), len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1),
        of_words([sum(map(letter, w)) > 1 and 2 * upper(w) > sum(map(letter, w)) for w in words]), of_words([w[-1] in marks for w in words]),
        of_words([a == b for a, b in zip(words, words[1:], strict=False)]), of_words([a == b for a, b in zip(words, words[2:], strict=False)]), float(n == 0),
    ]
    cells = Counter()
    for w, c in counts.items():
        cells[column(w)] += c
    values = {k: math.log1p(c) for k, c in cells.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {k: v / norm for k, v in values.items()}, stats


def chars_of(text, i):
    return None if i % 3 == 2 else len(text or "")


def test_features_by_plain_loops():
    chars = [chars_of(t, i) for i, t in enumerate(TEXTS)]
    starts, cols, values, stats = quality.featurise(pa.array(TEXTS, pa.string()), np.array([np.nan if c is None else c for c in chars], float))
    for i, text in enumerate(TEXTS):
        cells, own = features(text, chars[i])
        got = dict(zip(cols[starts[i] : starts[i + 1]].tolist(), values[starts[i] : starts[i + 1]].tolist(), strict=True))
        assert got.keys() == cells.keys() and all(abs(got[k] - v) < 1e-5 for k, v in cells.items())
        assert np.allclose(stats[i], own, atol=1e-5), text


def margin(m, cells, stats):
    """The sum over every pair, one by one."""
    x = dict(cells)
    dense = np.clip((np.array(stats, np.float32) - m.mean) / m.dev, -5, 5) / math.sqrt(len(stats))
    x |= {quality.DIMS + k: float(v) for k, v in enumerate(dense)}
    keys = list(x)
    out = m.bias + sum(float(m.w[k]) * x[k] for k in keys)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            out += float(m.v[a].astype(float) @ m.v[b].astype(float)) * x[a] * x[b]
    return out


def test_scores_of_every_row_by_all_pairs(spark):
    rng = np.random.default_rng(3)
    m = quality.Machine(rng.normal(1, 0.3, len(quality.STATS)).astype(np.float32), np.full(len(quality.STATS), 0.7, np.float32), 5)
    m.bias, m.w, m.v = 0.2, rng.normal(0, 0.5, m.w.shape).astype(np.float32), rng.normal(0, 0.4, m.v.shape).astype(np.float32)
    rows = [(i, t, chars_of(t, i)) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), m).collect()}
    for i, text, chars in rows:
        want = 1 / (1 + math.exp(-margin(m, *features(text, chars))))
        assert abs(got[i][0] - want) < 1e-4 and got[i][1] == int(got[i][0] >= 0.3)


def test_one_step_of_the_fit_is_the_gradient():
    """After one step from the start, each touched number has moved against the numerical gradient of the mean loss."""
    examples = []
    for text, label in (("good words here", 1), ("bad spam spam", 0), ("more good text", 1)):
        starts, cols, values, stats = quality.featurise(pa.array([text]), np.array([np.nan]))
        examples.append((cols, values, stats[0], label))
    stats = np.stack([e[2] for e in examples])
    start = quality.Machine(stats.mean(0), np.maximum(stats.std(0), 1e-6), 7)
    share = np.mean([e[3] for e in examples])
    start.bias = float(np.log(share / (1 - share)))
    after = quality.train(examples, epochs=1, decay=0.0)

    def loss():
        total = 0.0
        for cols, values, own, label in examples:
            p = 1 / (1 + math.exp(-margin(start, dict(zip(cols.tolist(), values.tolist(), strict=True)), own)))
            total -= math.log(p if label else 1 - p) / len(examples)
        return total

    eps = 1e-2
    for k in [int(examples[0][0][0]), int(examples[1][0][0]), quality.DIMS + 1]:
        old = float(start.w[k])
        start.w[k] = old + eps
        high = loss()
        start.w[k] = old - eps
        grad = (high - loss()) / (2 * eps)
        start.w[k] = old
        want = -0.1 * grad / math.sqrt(1e-3 + grad * grad)
        assert abs(float(after.w[k]) - want) < 2e-3


def test_fit_takes_only_labelled_rows_outside_the_fold(spark):
    texts = {i: f"word{i % 7} good text {i}" if i % 2 else f"junk{i % 5} !!! $$$ {i}" for i in range(60)}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    own = sorted(str(i) for i in range(50) if zlib.crc32(str(i).encode()) % 5)
    examples = []
    for i in own:
        starts, cols, values, stats = quality.featurise(pa.array([texts[int(i)]]), np.array([float(len(texts[int(i)]))]))
        examples.append((cols, values, stats[0], int(i) % 2))
    want = quality.train(examples)
    assert np.allclose(m.w, want.w, atol=1e-6) and np.allclose(m.v, want.v, atol=1e-6) and abs(m.bias - want.bias) < 1e-9
