"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the token windows of every text.

The documents are never shuffled. The set is a table of sorted 64-bit window hashes that point into the items' text, built once
on the driver, and it is bounded: a benchmark whose set would exceed ``most_bytes`` is split by item into parts, and the
documents pass through one bounded set after another within the same task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, LOWER, Words, covered, slices, string_parts
from .common import bound_batches, ddl, fresh, without

#: Bytes of one broadcast set at most, and of a set for each byte of benchmark text: a window of 20 bytes a word of at least two.
MOST_BYTES, SET_BYTES = 64_000_000, 11
RESULTS = ["n_words", "n_hit", "hit_spans", "hit_items", "contaminated"]


def _texts(strings: list[str | None]) -> Words:
    return Words(*string_parts(pa.array(strings, pa.string())), ALNUM, LOWER)


class Grams:
    """Windows of benchmark items, by length: sorted hashes, and of each the place of its words in the items' text and its item."""

    def __init__(self, items: list[tuple[object, str]], size: int):
        words = _texts([t for _, t in items])
        hashes = words.hashes()
        count = np.diff(words.first)
        self.names = [str(i) for i, _ in items]
        # The words of all items, one blank between: a window is one run of bytes.
        self.text = words.phrase(0, len(words))
        ends = np.cumsum(words.ends - words.starts + 1) - 1
        starts = ends - (words.ends - words.starts)
        self.windows = {}
        for n in sorted({min(int(c), size) for c in count if c}):
            at, h = words.windows(hashes, n)
            if n < size:
                keep = count[words.text[at]] == n
                at, h = at[keep], h[keep]
            order = np.lexsort((words.text[at], h))
            at, h = at[order], h[order]
            self.windows[n] = h, starts[at].astype(np.uint32), ends[at + n - 1].astype(np.uint32), words.text[at].astype(np.uint32)

    def hits(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """(start, end, items) of every verified window of a batch."""
        found, ends, items = [], [], []
        for n, (known, lo, hi, item) in self.windows.items():
            at, h = words.windows(hashes, n)
            left = np.searchsorted(known, h)
            same = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == h) if len(known) else []
            for k in same:
                s, own = int(at[k]), set()
                phrase = words.phrase(s, s + n)
                for w in range(int(left[k]), int(np.searchsorted(known, h[k], "right"))):
                    if self.text[lo[w] : hi[w]] == phrase:
                        own.add(self.names[item[w]])
                if own:
                    found.append(s), ends.append(s + n), items.append(own)
        return np.array(found, np.int64), np.array(ends, np.int64), items


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int, share: tuple[int, int], most_bytes: int, results: list[str]) -> DataFrame:
    """``docs`` with its own columns and the five results by these names."""
    spark = docs.sparkSession
    bound_batches(spark)
    bench = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("t is not null")
    total = SET_BYTES * (bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    parts = 1 if total <= most_bytes else 2 * (-(-total // most_bytes))
    own, (hits,) = ddl(docs), fresh(docs, "hits")
    out = docs.withColumn(hits, F.lit(None).cast("string"))
    for part in range(parts):
        chosen = bench if parts == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        grams = Grams([(r.i, r.t) for r in chosen.collect()], size)
        if grams.windows:
            out = out.mapInArrow(_scan(spark.sparkContext.broadcast(grams), text_col, hits), f"{own}, `{hits}` string")
    words, hit, spans, items, bad = results
    out = out.mapInArrow(_close(text_col, hits, results), f"{own}, `{words}` long, `{hit}` long, `{spans}` array<struct<start:int,end:int>>, `{items}` array<string>")
    return out.withColumn(bad, (F.col(hit) > 0) & (F.col(hit) * share[1] >= F.col(words) * share[0]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, share: tuple[int, int] = (1, 20), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add to every document ``n_words``, ``n_hit`` (words inside any benchmark window), ``hit_spans`` (word ranges
    [start, end), merged), ``hit_items`` (sorted item ids as strings) and ``contaminated``.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A window is ``size`` words of an
    item; a shorter item is one window; an item without words has none. A hash hit counts only after its words have been
    compared. ``contaminated``: n_hit > 0 and n_hit / n_words >= share. Null and empty texts have no words and no hits;
    a null item id is called ''. Result columns replace columns of the same name; other columns stay. Repeated rows are
    judged alike. Empty tables: nothing is hit.
    """
    return _found(without(docs, *RESULTS), benchmark, text_col, item_col, item_text_col, size, share, most_bytes, RESULTS)


def _scan(held, text_col: str, hits: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = held.value
        for batch in slices(batches, text_col):
            words = Words(*string_parts(batch.column(text_col)), ALNUM, LOWER)
            starts, ends, items = grams.hits(words, words.hashes())
            if not len(starts):
                yield batch
                continue
            state = batch.column(hits).to_pylist()
            by: dict[int, list] = {}
            for s, e, names in zip(starts.tolist(), ends.tolist(), items, strict=True):
                by.setdefault(int(words.text[s]), []).append((s, e, names))
            for row, found in by.items():
                spans, names = json.loads(state[row]) if state[row] else ([], [])
                base = int(words.first[row])
                spans += [[s - base, e - base] for s, e, _ in found]
                state[row] = json.dumps([spans, sorted({*names, *(n for *_, own in found for n in own)})])
            yield batch.set_column(batch.schema.get_field_index(hits), hits, pa.array(state, pa.string()))

    return run


def _close(text_col: str, hits: str, results: list[str]):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            words = Words(*string_parts(batch.column(text_col)), ALNUM, LOWER)
            counts = np.diff(words.first)
            hit, spans, names = [], [], []
            for n, state in zip(counts.tolist(), batch.column(hits).to_pylist(), strict=True):
                if not state:
                    hit.append(0), spans.append([]), names.append([])
                    continue
                ranges, items = json.loads(state)
                ranges = np.array(ranges, np.int64)
                mask = np.r_[False, covered(n, ranges[:, 0], ranges[:, 1]), False]
                edges = np.flatnonzero(mask[1:] != mask[:-1])
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                hit.append(int(mask.sum()))
                names.append(items)
            keep = [i for i, n in enumerate(batch.schema.names) if n != hits]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))],
                names=[*(batch.schema.names[i] for i in keep), *results[:4]],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: str = "document", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, share: tuple[int, int] = (1, 20), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Drop contaminated documents (``how='document'``), or cut the hit words out of them (``how='span'``; the words
    that stay are joined by one space). Other documents stay as they are; the columns are those of ``docs``, and all but
    the text keep their values."""
    results = fresh(docs, *RESULTS)
    found = _found(docs, benchmark, text_col, item_col, item_text_col, size, share, most_bytes, results)
    _, _, spans, _, bad = results
    if how == "document":
        return found.where(~F.col(bad)).select(*[F.col(f"`{c}`") for c in docs.columns])

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is None or not len(own):
                out.append(text)
                continue
            words = Words(*string_parts(pa.array([text], pa.string())), ALNUM, LOWER)
            raw = text.encode()
            gone = [False] * len(words)
            for s in own:
                gone[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
            out.append(b" ".join(raw[a:b] for a, b, g in zip(words.starts, words.ends, gone, strict=True) if not g).decode())
        return pd.Series(out)

    text = F.col(f"`{text_col}`")
    found = found.withColumn(text_col, F.when(F.col(bad), cut(text, F.col(spans))).otherwise(text))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])
