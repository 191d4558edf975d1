"""Vectors of segments and merges of frames: grouped by example, NumPy inside.

An example has at most a few thousand frames, so a group is one example and never the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EX = "example_idx"


def block_mean(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` blocks. The length becomes the nearest multiple of ``n`` by cutting or by repeating the last frame; shorter inputs
    repeat each frame first."""
    t = len(x)
    if t < n:
        x = np.repeat(x, -(-n // t), axis=0)
        t = len(x)
    size = max(n, int(np.floor(t / n + 0.5)) * n)
    x = x[:size] if size <= t else np.concatenate([x, np.repeat(x[-1:], size - t, axis=0)])
    return x.reshape(n, size // n, -1).mean(1)


def interpolate(x: np.ndarray, n: int) -> np.ndarray:
    at = np.linspace(0, len(x) - 1, n)
    return np.stack([np.interp(at, np.arange(len(x)), x[:, k]) for k in range(x.shape[1])], 1)


def fourier(x: np.ndarray, n: int) -> np.ndarray:
    """Resample by the spectrum, as a periodic signal; the unpaired frequency of even lengths is split or joined."""
    t = len(x)
    spec = np.fft.rfft(x, axis=0)
    out = np.zeros((n // 2 + 1, x.shape[1]), complex)
    m = min(t, n)
    k = m // 2 + 1
    out[:k] = spec[:k]
    if m % 2 == 0 and t != n:
        out[m // 2] *= 2 if n < t else 0.5
    return np.fft.irfft(out, n, axis=0) * (n / t)


def embed(x: np.ndarray, n: int, how: str) -> np.ndarray:
    if how == "mean":
        return x.mean(0)
    return {"block": block_mean, "interpolate": interpolate, "fourier": fourier}[how](x, n).ravel()


def embed_segments(segments: DataFrame, frames: DataFrame, n: int = 10, how: str = "fourier") -> DataFrame:
    """(example_idx, start, end, vec): a vector of fixed size for each segment of ``frames(example_idx, idx, vec)``.

    ``how``: mean, block, interpolate or fourier; the last three give ``n`` frames, flattened. A segment without frames is zero."""

    def run(key, segs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({EX: segs[EX], "start": segs["start"], "end": segs["end"], "vec": [np.zeros(0)] * len(segs)})
        own = own.sort_values("idx")
        at, x = own["idx"].to_numpy(), np.stack(own["vec"].to_numpy())
        width = x.shape[1] * (1 if how == "mean" else n)
        out = []
        for s, e in zip(segs["start"], segs["end"], strict=True):
            a, b = np.searchsorted(at, [s, e])
            out.append(embed(x[a:b], n, how) if b > a else np.zeros(width))
        return pd.DataFrame({EX: segs[EX], "start": segs["start"], "end": segs["end"], "vec": out})

    pairs = segments.select(EX, "start", "end").groupBy(EX).cogroup(frames.select(EX, "idx", "vec").groupBy(EX))
    return pairs.applyInPandas(run, f"{EX} long, start int, end int, vec array<double>")


def pool_argmax(segments: DataFrame, frames: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """F20, arg-max: the frame of each segment on which the linear classifier's best class other than 0 scores highest:
    (example_idx, start, end, idx, class)."""

    def run(batches):
        for b in batches:
            scores = np.stack(b["vec"].to_numpy()) @ weights.T + bias
            scores[:, 0] = -np.inf
            yield pd.DataFrame({EX: b[EX], "idx": b["idx"], "class": scores.argmax(1), "score": scores.max(1)})

    scored = frames.select(EX, "idx", "vec").mapInPandas(run, f"{EX} long, idx int, class int, score double").withColumnRenamed(EX, "_ex")
    inside = segments.join(scored, (F.col(EX) == F.col("_ex")) & (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end")))
    best = inside.groupBy(EX, "start", "end").agg(F.max_by(F.struct("idx", "class"), F.struct("score", -F.col("idx"))).alias("b"))
    return best.select(EX, "start", "end", "b.idx", "b.class")


def merge_levels(x: np.ndarray, levels: int, metric: str = "euclidean") -> list[list[int]]:
    """Boundaries after each level: a boundary goes if its two sides are closer to each other than to their other neighbours;
    distances are means between blocks, Euclidean or cosine ones, and beyond the ends infinite."""
    t, size = len(x), (x * x).sum(1)
    if metric == "cosine":
        d = 1 - x @ x.T / np.maximum(np.sqrt(np.outer(size, size)), 1e-300)
    else:
        d = np.sqrt(np.maximum(size[:, None] + size[None] - 2 * (x @ x.T), 0))
    sums = np.zeros((t + 1, t + 1))
    sums[1:, 1:] = d.cumsum(0).cumsum(1)
    bounds, out = list(range(t + 1)), []
    for _ in range(levels):
        k = len(bounds) - 1
        gap = np.full(k + 1, np.inf)
        for i in range(1, k):
            a, b, c = bounds[i - 1], bounds[i], bounds[i + 1]
            gap[i] = (sums[b, c] - sums[a, c] - sums[b, b] + sums[a, b]) / ((b - a) * (c - b))
        bounds = [bounds[0], *(bounds[i] for i in range(1, k) if not (gap[i] < gap[i - 1] and gap[i] < gap[i + 1])), bounds[-1]]
        out.append(bounds)
    return out


def dendrogram(frames: DataFrame, levels: int = 2, metric: str = "euclidean") -> DataFrame:
    """(example_idx, level, lm_idx, frame): boundaries left after each level of merging adjacent frames."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        found = merge_levels(np.stack(own["vec"].to_numpy()), levels, metric)
        rows = [(own[EX].iloc[0], lv, i, f) for lv, b in enumerate(found) for i, f in enumerate(b)]
        return pd.DataFrame(rows, columns=[EX, "level", "lm_idx", "frame"])

    return frames.select(EX, "idx", "vec").groupBy(EX).applyInPandas(run, f"{EX} long, level int, lm_idx int, frame int")
