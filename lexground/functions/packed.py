"""Examples of different lengths, packed: the rows of a whole Arrow batch lie one after the other, and a kernel works on all at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kernels as kn


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets from 0, values) of a list column; a null is an empty list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.r_[0, np.cumsum(np.asarray(column.value_lengths().fill_null(0)))], column.flatten()


def matrix(values: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    offsets, inner = lists(values)
    return np.asarray(inner, float).reshape(len(values), -1 if len(values) and offsets[-1] else 0)


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of examples with about ``most`` units of ``sizes`` each; none is ever cut."""
    total, at = np.r_[0, np.cumsum(sizes)], 0
    while at < len(sizes):
        to = max(int(np.searchsorted(total, total[at] + most, "right")) - 1, at + 1)
        yield at, to
        at = to


def bands(first: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """``band[first[x] + e, l]``: the log probability of span [e - l, e) of example x; -inf where there is none."""
    size = end - start
    out = np.full((first[-1], int(size.max(initial=0)) + 1), -np.inf)
    out[first[of] + end, size] = log_p
    return out


def _rounds(first: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For e = 1, 2, ...: the rows of end e of all examples that are as long, and the lengths a span may have there, longest first."""
    n = np.diff(first) - 1
    order = np.argsort(-n, kind="stable")
    falling = n[order]
    for e in range(1, int(n.max(initial=0)) + 1):
        yield first[order[: np.searchsorted(-falling, -e, "right")]] + e, np.arange(min(width, e), 0, -1)


def _traced(band: np.ndarray, first: np.ndarray, reached: np.ndarray, step) -> np.ndarray:
    """The rows of the chosen ends, from the last of each example back to 0; ``step(rows, examples)`` gives the length of the span that
    ends there. Where nothing is reached, the shortest span there is goes, or one of a single position."""
    mark = np.zeros(len(band), bool)
    live = np.flatnonzero(np.diff(first) > 1)
    at = first[1:][live] - 1
    while len(live):
        mark[at] = True
        size = np.ones(len(at), int)
        good = np.isfinite(reached[at])
        if good.any():
            size[good] = step(at[good], live[good])
        if not good.all():
            there = np.isfinite(band[at[~good]])
            size[~good] = np.where(there.any(1), there.argmax(1), 1)
        at = at - size
        left = at > first[live]
        live, at = live[left], at[left]
    return np.flatnonzero(mark)


def viterbi(band: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of the ends of the best segmentation of every example; ties take the longer last span."""
    best, back = np.full(len(band), -np.inf), np.ones(len(band), int)
    best[first[:-1]] = 0
    for rows, sizes in _rounds(first, band.shape[1] - 1):
        total = best[rows[:, None] - sizes] + band[rows[:, None], sizes]
        j = total.argmax(1)
        best[rows], back[rows] = total[np.arange(len(rows)), j], sizes[j]
    return _traced(band, first, best, lambda rows, _: back[rows])


def forward(band: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log alpha of every row: alpha_0 = 1, alpha_t = sum over s of alpha_s p(s..t)."""
    a = np.full(len(band), -np.inf)
    a[first[:-1]] = 0
    for rows, sizes in _rounds(first, band.shape[1] - 1):
        a[rows] = kn.log_sum_exp(a[rows[:, None] - sizes] + band[rows[:, None], sizes])
    return a


def sample(band: np.ndarray, first: np.ndarray, temp: float, keys: list[int]) -> np.ndarray:
    """Rows of the ends of a segmentation of every example, drawn backward with weight (alpha_s p(s..t))^(1/temp) by uniforms of its key."""
    a = forward(band, first)
    u = np.concatenate([kn.uniforms(k, n) for k, n in zip(keys, np.diff(first), strict=True)]) if len(keys) else np.zeros(0)
    width = band.shape[1] - 1
    sizes = np.arange(width, 0, -1)

    def step(rows: np.ndarray, examples: np.ndarray) -> np.ndarray:
        at = rows[:, None] - sizes
        inside = at >= first[examples][:, None]
        w = np.where(inside, (a[np.maximum(at, 0)] + band[rows[:, None], sizes]) / temp, -np.inf)
        c = np.cumsum(np.exp(w - w.max(1, keepdims=True)), 1)
        return sizes[np.minimum((c <= (u[rows] * c[:, -1])[:, None]).sum(1), width - 1)]

    return _traced(band, first, a, step)


def ends_of(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(example, start, end) of the spans that end at ``rows``."""
    of = np.searchsorted(first, rows, "right") - 1
    end = rows - first[of]
    start = np.r_[0, end[:-1]] if len(end) else end
    start[np.r_[True, of[1:] != of[:-1]][: len(of)]] = 0
    return of, start, end
