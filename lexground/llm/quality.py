"""Quality classifier: a factorisation machine over hashed words, statistics of a text's structure and its metadata.

Pairwise interactions have rank ``RANK``; the sum over all pairs is taken in linear time as half the square of the sum less the
sum of squares. The model is fitted on the driver on a bounded sample of labelled rows (``max_rows``), drawn by a hash of the
id; what comes to the driver is about ``max_rows`` sparse vectors of at most ``DIMS`` entries. Every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, Words, mix, slices, string_parts
from .common import bound_batches, ddl, fresh, in_fold, without

DIMS, RANK, MAX_ROWS, THRESHOLD = 1 << 15, 8, 6000, 0.3
STATS = ["log_words", "log_chars", "word_length", "upper", "digit", "punct", "mark", "space", "newline", "high", "distinct", "repeat", "all_upper", "ends_marked", "echo", "echo_2", "empty"]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _table(bytes(range(0x41, 0x5B))), _table(bytes(range(0x30, 0x3A)))
_PUNCT, _MARK, _SPACE, _LINE = _table(b".,;:'\"()-"), _table(b"!?#$%&*+/<=>@[\\]^_`{|}~"), _table(b" \t\r"), _table(b"\n")
_HIGH = np.arange(256) >= 0x80
_LETTER = _UPPER | _table(bytes(range(0x61, 0x7B))) | _HIGH


def featurise(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, column, value) of the hashed words of every text, log-scaled and of length 1, and the dense statistics.

    ``n_chars`` is the metadata column, NaN where unknown."""
    data, offsets = string_parts(texts)
    words = Words(data, offsets, SPACED)
    n = len(offsets) - 1
    counts, size = np.diff(words.first), np.diff(offsets)
    hashes = words.hashes()

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(table[data])]
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)

    def share_of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(words.text, flags, n) / np.maximum(counts, 1)

    def echo(k: int) -> np.ndarray:
        """Words that repeat the word ``k`` places before them."""
        out = np.zeros(len(words), bool)
        out[k:] = (hashes[k:] == hashes[:-k]) & (words.text[k:] == words.text[:-k])
        return out

    # Equal words of a text meet after one sort.
    order = np.lexsort((hashes, words.text))
    text, h = words.text[order], hashes[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(h)])
    most = np.zeros(n)
    np.maximum.at(most, text[at], times)
    letters, upper = np.r_[0, np.cumsum(_LETTER[data])], np.r_[0, np.cumsum(_UPPER[data])]
    word_letters, word_upper = letters[words.ends] - letters[words.starts], upper[words.ends] - upper[words.starts]
    known = np.where(np.isnan(n_chars), size, n_chars)
    stats = np.column_stack(
        [
            np.log1p(counts), np.log1p(np.maximum(known, 0)), (size - counts) / np.maximum(counts, 1), share(_UPPER), share(_DIGIT), share(_PUNCT), share(_MARK), share(_SPACE), share(_LINE), share(_HIGH),
            np.bincount(text[at], minlength=n) / np.maximum(counts, 1), most / np.maximum(counts, 1), share_of_words((word_letters > 1) & (word_upper * 2 > word_letters)),
            share_of_words(_MARK[data[words.ends - 1]] if len(words) else np.zeros(0)), share_of_words(echo(1)), share_of_words(echo(2)), (counts == 0).astype(float),
        ]
    )
    # Words of one column are one entry: their counts add up.
    where, entry = np.unique(text[at] * DIMS + (mix(h[at]) % np.uint64(DIMS)).astype(np.int64), return_inverse=True)
    row, value = where // DIMS, np.log1p(np.bincount(entry, times, len(where))).astype(np.float32)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value /= np.maximum(norm, 1e-9)[row].astype(np.float32)
    return np.searchsorted(row, np.arange(n + 1)), (where % DIMS).astype(np.int32), value, stats.astype(np.float32)


class Machine:
    """score = sigmoid(bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j)."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, seed: int):
        self.mean, self.dev = mean, dev
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(DIMS + len(STATS), np.float32)
        self.v = rng.normal(0, 0.02, (DIMS + len(STATS), RANK)).astype(np.float32)

    def dense(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.dev, -5, 5) / np.sqrt(stats.shape[1])

    def rows(self, starts, cols, values, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and statistics in one sparse matrix: (row, column, value)."""
        n, k = stats.shape
        row = np.r_[np.repeat(np.arange(n), np.diff(starts)), np.repeat(np.arange(n), k)]
        return row, np.r_[cols, np.tile(np.arange(DIMS, DIMS + k, dtype=np.int32), n)], np.r_[values, self.dense(stats).ravel().astype(np.float32)]

    def margin(self, row, col, val, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        xv = self.v[col] * val[:, None]
        sums = np.column_stack([np.bincount(row, xv[:, f], n) for f in range(RANK)])
        squares = np.bincount(row, (xv * xv).sum(1), n)
        return self.bias + np.bincount(row, self.w[col] * val, n) + 0.5 * ((sums * sums).sum(1) - squares), sums, xv

    def score(self, starts, cols, values, stats) -> np.ndarray:
        row, col, val = self.rows(starts, cols, values, stats)
        return 1 / (1 + np.exp(-np.clip(self.margin(row, col, val, len(stats))[0], -30, 30)))


def train(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 20, rate: float = 0.1, decay: float = 1e-5, batch: int = 256, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss over (columns, values, statistics, label)."""
    if not examples:
        return Machine(np.zeros(len(STATS), np.float32), np.ones(len(STATS), np.float32), seed)
    stats = np.stack([e[2] for e in examples])
    m = Machine(stats.mean(0), np.maximum(stats.std(0), 1e-6), seed)
    label = np.array([e[3] for e in examples], float)
    share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    g_w, g_v, g_b = np.full_like(m.w, 1e-3), np.full_like(m.v, 1e-3), 1e-3
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            starts = np.r_[0, np.cumsum([len(examples[k][0]) for k in own])]
            row, col, val = m.rows(starts, np.concatenate([examples[k][0] for k in own]), np.concatenate([examples[k][1] for k in own]), stats[own])
            y, sums, xv = m.margin(row, col, val, len(own))
            miss = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[own]) / len(own)
            g = miss[row] * val
            at, where = np.unique(col, return_inverse=True)
            d_w = np.bincount(where, g, len(at)) + decay * m.w[at]
            d_v = np.column_stack([np.bincount(where, g * (sums[row, f] - xv[:, f]), len(at)) for f in range(RANK)]) + decay * m.v[at]
            d_b = float(miss.sum())
            g_w[at] += d_w**2
            g_v[at] += d_v**2
            g_b += d_b**2
            m.w[at] -= rate * d_w / np.sqrt(g_w[at])
            m.v[at] -= rate * 0.3 * d_v / np.sqrt(g_v[at])
            m.bias -= rate * d_b / np.sqrt(g_b)
    return m


def _chars(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False), float)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", max_rows: int = MAX_ROWS, seed: int = 7) -> Machine:
    """Fit on labelled rows outside the held-out fold. More than ``max_rows`` of them are sampled by a hash of the id, before any
    text moves. Null labels and ids are left out; an id with several labels has the largest, one with several texts the least."""
    bound_batches(docs.sparkSession)
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~in_fold(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    n = own.count()
    keep = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.95 * max_rows / max(n, 1)))
    keep = F.lit(True) if n <= max_rows else keep
    chars = F.col(f"`{chars_col}`").cast("double") if chars_col in docs.columns else F.lit(None).cast("double")
    text = docs.select(F.col(f"`{id_col}`").alias("_id"), F.struct(F.col(f"`{text_col}`").alias("_text"), chars.alias("_chars")).alias("_doc")).where(keep)
    sample = text.join(own.where(keep), "_id").groupBy("_id").agg(F.min("_doc").alias("_doc"), F.max("_label").alias("_label")).select("_id", "_doc._text", "_doc._chars", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            starts, cols, values, stats = featurise(batch.column("_text"), _chars(batch.column("_chars")))
            cut = range(batch.num_rows)
            blobs = [[cols[starts[i] : starts[i + 1]].tobytes() for i in cut], [values[starts[i] : starts[i + 1]].tobytes() for i in cut], [stats[i].tobytes() for i in cut]]
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), *(pa.array(b, pa.binary()) for b in blobs), batch.column("_label")], names=["id", "c", "v", "s", "label"])

    rows = sample.mapInArrow(run, "id string, c binary, v binary, s binary, label int").collect()
    rows.sort(key=lambda r: (r.id, r.c))
    return train([(np.frombuffer(r.c, np.int32), np.frombuffer(r.v, np.float32), np.frombuffer(r.s, np.float32), r.label) for r in rows], seed=seed)


def _scored(docs: DataFrame, machine: Machine, text_col: str, chars_col: str, name: str) -> DataFrame:
    """``docs`` with its own columns and the score by this name."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    chars = F.col(f"`{chars_col}`").cast("double") if chars_col in docs.columns else F.lit(None).cast("double")
    (extra,) = fresh(docs, "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            got = held.value.score(*featurise(batch.column(text_col), _chars(batch.column(extra))))
            keep = [i for i, n in enumerate(batch.schema.names) if n != extra]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(got, pa.float64())], names=[*(batch.schema.names[i] for i in keep), name])

    return docs.withColumn(extra, chars).mapInArrow(run, f"{ddl(docs)}, `{name}` double")


def score(docs: DataFrame, machine: Machine, text_col: str = "text", chars_col: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row.

    Null and empty texts are scored by their statistics. Columns other than the text and its character count are never
    read; result columns replace columns of the same name.
    """
    out = _scored(without(docs, "score", "predicted"), machine, text_col, chars_col, "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(docs: DataFrame, machine: Machine, text_col: str = "text", chars_col: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score ``threshold`` or more, with the columns and values of ``docs``."""
    (name,) = fresh(docs, "score")
    return _scored(docs, machine, text_col, chars_col, name).where(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
