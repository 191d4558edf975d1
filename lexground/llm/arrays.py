"""NumPy helpers over Arrow string columns: word spans and polynomial hashes of whole batches at once."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: White space of ASCII: everything else is part of a word.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Digits, lower-case letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        got = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        if size <= 1 << 21:  # longer tables serve one long text and are not kept
            _powers[base] = got
    return got


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of ``values[s:e]`` for every span, from one prefix sum of a polynomial modulo 2**64."""
    n = len(values)
    up, down = _power(base, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:n] + up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


class Words:
    """The words of a batch of texts: byte spans, text of each word, first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, fold: np.ndarray | None = None):
        self.data = fold[data] if fold is not None else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words within one text."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - size + 1)
        at = at[self.text[at] == self.text[at + size - 1]]
        return at, span_hash(hashes, at, at + size, _STEP)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def phrase(self, i: int, j: int) -> bytes:
        """Words ``i`` to ``j - 1``, joined by one space."""
        return b" ".join([self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j], strict=True)])


def gather(words: Words, at: np.ndarray) -> pa.Array:
    """The words at these places as strings."""
    size = words.ends[at] - words.starts[at]
    offsets = np.r_[0, np.cumsum(size)]
    spots = np.repeat(words.starts[at] - offsets[:-1], size) + np.arange(offsets[-1])
    data = pa.py_buffer(np.ascontiguousarray(words.data[spots]).tobytes())
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), data])


def release() -> None:
    """Give memory that is no longer in use back to the system: Spark keeps Python workers for later tasks, and several share an
    executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], *columns: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``columns`` hold about ``most`` bytes at a time; no row is ever cut. Memory is given back between
    batches and at the end."""
    for batch in batches:
        release()
        if not batch.num_rows:
            continue
        offsets = sum(string_parts(batch.column(c))[1] for c in columns)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    release()


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean mask of the positions inside any span ``[start, end)``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
