"""Substring deduplication by repeated-phrase automata.

1. Probe: every window of ``size`` words is hashed; a task keeps one entry for each hash and its own smallest document.
   Entries go to parts of the hash space, and a part finds the hashes of several documents. The block of words around the
   window in the smaller document is noted twice: to be cut, once, and as wanted by the bucket of the other document.
2. Confirm: the noted blocks are cut out of the smaller documents' texts, each once, and a join hands them to the buckets that
   want them; Spark splits a block that very many buckets want.
3. Locate: every bucket of documents compiles an Aho-Corasick automaton of its blocks' phrases and streams all its texts
   through it; around each phrase the words themselves decide.

Hashes only choose what to compare: words are removed because an equal window was read from a smaller document. A window
that millions of documents share is one entry a task, one block to cut, and one row a bucket in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACED, Words, covered, release, slices, string_parts
from .common import bound_batches, ddl, fresh, materialise, reclaim, whole_ids, without

SIZE = 13
#: Windows that begin in one block of a document, which is cut and handed out as a whole.
BLOCK = 32
#: Text bytes behind one part of the hash space and one bucket of documents; windows that a task gathers before it sends.
PART_BYTES, BUCKET_BYTES, CHUNK = 8_000_000, 4_000_000, 600_000
#: Parts and buckets at least, so that a small corpus is spread too.
LEAST = 32
#: The bits of a hash above these choose its part.
_BITS = 40
_ENTRY, WANT, CUT = 0, 1, 2
_PLACE = np.dtype([("src", "<i8"), ("block", "<i4")])
RESULTS = ["n_words", "n_removed", "removed_spans", "kept_text"]


def _windows(texts: pa.Array, size: int) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(*string_parts(texts), SPACED)
    at, h = words.windows(words.hashes(), size)
    return words, at, h


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of the distinct rows of ``columns``, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return order[new]


def _places(kind: int, bucket: np.ndarray, src: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, distinct places of blocks) for each bucket."""
    order = _distinct(bucket, src, block)
    rows, bucket = np.empty(len(order), _PLACE), bucket[order]
    rows["src"], rows["block"] = src[order], block[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(rows) else []
    for a, b in zip(cuts, np.r_[cuts[1:], len(rows)] if len(rows) else [], strict=True):
        yield kind, int(bucket[a]), rows[a:b].tobytes()


def _meet(h: np.ndarray, ids: np.ndarray, buckets: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
    """Equal hashes meet: (each hash's first entry with the smallest id, places that the larger ids want and that are to be cut)."""
    order = np.argsort(h, kind="stable")
    hs, own = h[order], ids[order]
    starts = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(hs)]))
    least = np.minimum.reduceat(own, starts)
    at = np.flatnonzero(own == least[group])
    first = np.zeros(len(starts), np.int64)
    first[group[at][::-1]] = at[::-1]
    more = own > least[group]
    source = order[first][group[more]]
    src, block = ids[source], blocks[source]
    return order[first], [*_places(WANT, buckets[order[more]], src, block), *_places(CUT, buckets[source], src, block)]


def _steps(block: np.ndarray, doc: np.ndarray) -> bytes:
    """Blocks in the order of their documents and places, as steps from one to the next: a byte each where they are small."""
    step = np.diff(block, prepend=0)
    new = np.flatnonzero(np.diff(doc, prepend=-1))
    step[new] = block[new]
    return step.astype("<u1" if step.max() < 256 else "<u4").tobytes()


def _unstep(data: bytes, times: np.ndarray) -> np.ndarray:
    step = np.frombuffer(data, "<u1" if len(data) == times.sum() else "<u4").astype(np.int64)
    sums = np.cumsum(step)
    first = np.cumsum(times) - times
    return (sums - np.repeat(sums[first] - step[first], times)).astype(np.int32)


def _probe(parts: int, size: int):
    """Rows (part, kind, bucket, docs, data): entries for a part, and places that the task found itself."""
    names = ["part", "kind", "bucket", "docs", "data"]
    shift = np.uint64(_BITS)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids, buckets = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        base = np.r_[0, np.cumsum([len(x[0]) for x in held])]
        doc = np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)])
        h, block = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
        held.clear()
        if not len(h):
            return
        kept, noted = _meet(h, ids[doc], buckets[doc], block)
        rows = [(b % parts, kind, b, b"", data) for kind, b, data in noted]
        kept = np.sort(kept)
        part = ((h[kept] >> shift) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.r_[True, part[by][1:] != part[by][:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(by)], strict=True):
            own = kept[by[a:b]]
            d, times = np.unique(doc[own], return_counts=True)
            docs = ids[d].tobytes() + buckets[d].astype("<i4").tobytes() + times.astype("<i4").tobytes()
            rows.append((int(part[by[a]]), _ENTRY, -1, docs, h[own].astype("<u8").tobytes() + _steps(block[own], doc[own])))
        for i in range(0, len(rows), 64):
            cols = list(zip(*rows[i : i + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in slices(batches, "text"):
            words, at, h = _windows(batch.column("text"), size)
            # A window of a document counts once.
            own = np.sort(_distinct(h, words.text[at]))
            text = words.text[at[own]]
            held.append((batch.column("id").to_numpy(), batch.column("bucket").to_numpy(), text, h[own], ((at[own] - words.first[text]) // BLOCK).astype(np.int32)))
            n += len(own)
            if n >= CHUNK:
                yield from flush(held)
                n = 0
        yield from flush(held)

    return run


def _match(table: pa.Table) -> pa.Table:
    """One part of the hash space: the places for all documents that are not the smallest with a window."""
    release()
    hashes, ids, buckets, blocks, out = [], [], [], [], []
    for kind, bucket, docs, data in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "docs", "data")), strict=True):
        if kind != _ENTRY:
            out.append((kind, bucket, data))
            continue
        n = len(docs) // 16
        times = np.frombuffer(docs, "<i4", n, 12 * n)
        m = int(times.sum())
        ids.append(np.repeat(np.frombuffer(docs, "<i8", n), times))
        buckets.append(np.repeat(np.frombuffer(docs, "<i4", n, 8 * n), times))
        hashes.append(np.frombuffer(data, "<u8", m))
        blocks.append(_unstep(data[8 * m :], times))
    if hashes:
        out += _meet(np.concatenate(hashes), np.concatenate(ids), np.concatenate(buckets), np.concatenate(blocks))[1]
    return pa.table({"kind": pa.array([k for k, _, _ in out], pa.int32()), "bucket": pa.array([b for _, b, _ in out], pa.int32()), "data": pa.array([d for *_, d in out], pa.binary())})


def _noted(data: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places (src, block) of packed ones."""
    rows = np.concatenate([np.zeros(0, _PLACE), *[np.frombuffer(d, _PLACE) for d in data.to_pylist()]])
    order = _distinct(rows["src"], rows["block"])
    return rows["src"][order], rows["block"][order]


def _wanted(table: pa.Table) -> pa.Table:
    src, block = _noted(table.column("data"))
    return pa.table({"bucket": pa.array(np.full(len(src), table.column("bucket")[0].as_py(), np.int32)), "src": pa.array(src), "block": pa.array(block)})


def _cut(size: int):
    """The blocks of a bucket's documents that were noted: (src, block, passage)."""

    def run(texts: pa.Table, noted: pa.Table) -> pa.Table:
        out: dict[tuple[int, int, str], None] = {}  # rows may repeat
        src, block = _noted(noted.column("data"))
        if len(src):
            for batch in slices(iter(texts.select(["id", "text"]).to_batches()), "text"):
                ids = batch.column("id").to_numpy()
                words = Words(*string_parts(batch.column("text")), SPACED)
                lo, hi = np.searchsorted(src, ids), np.searchsorted(src, ids, "right")
                for row in np.flatnonzero(hi > lo):
                    a, b = int(words.first[row]), int(words.first[row + 1])
                    for x in block[lo[row] : hi[row]].tolist():
                        i, j = a + x * BLOCK, min(a + x * BLOCK + BLOCK + size - 1, b)
                        if j - i >= size:
                            out[int(ids[row]), x, words.phrase(i, j).decode()] = None
        return pa.table({"src": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([x[1] for x in out], pa.int32()), "passage": pa.array([x[2] for x in out], pa.string())})

    return run


class Automaton:
    """Phrases of five words (or ``size``, if less) at such a distance that every window of a passage holds one whole.

    Words are numbered, and a number is spelt as a few letters, each place with an alphabet of its own, so a phrase is found at
    words only and no node has many branches."""

    LETTERS = 128

    def __init__(self, passages: list[tuple[int, str]], size: int):
        self.size, self.phrase = size, min(5, size)
        self.lead = size - self.phrase
        self.numbers: dict[str, int] = {}
        blob, owner, phrases, stride = [-1] * size, [-1] * size, {}, self.lead + 1
        for src, passage in sorted(set(passages)):
            words = [self.numbers.setdefault(w, len(self.numbers)) for w in passage.split(" ")]
            for i in range(0, len(words) - self.phrase + 1, stride):
                phrases.setdefault(tuple(words[i : i + self.phrase]), []).append(len(blob) + i)
            blob += words
            blob.append(-1)
            owner += [src] * (len(words) + 1)
        self.blob, self.owner = np.array(blob + [-1] * size, np.int32), np.array(owner, np.int64)
        self.unknown, self.width = len(self.numbers), 1
        while self.LETTERS**self.width <= self.unknown:
            self.width += 1
        self.codes = ["".join(chr(i // self.LETTERS**d % self.LETTERS + 1 + d * self.LETTERS) for d in range(self.width)) for i in range(self.unknown + 1)]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, phrase in enumerate(phrases):
            self.machine.add_word("".join([self.codes[w] for w in phrase]), k)
        self.offsets = np.r_[0, np.cumsum([len(x) for x in phrases.values()], dtype=np.int64)].astype(np.int64)
        self.places = np.array([p for x in phrases.values() for p in x], np.int64)
        if len(self.machine):
            self.machine.make_automaton()

    def spans(self, words: list[str], key: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of a text, as (start, end) words, that a document with a smaller id than ``key`` has too."""
        n, none = len(words), np.zeros(0, np.int64)
        if n < self.size or not len(self.machine):
            return none, none
        get, unknown, codes = self.numbers.get, self.unknown, self.codes
        doc = [get(w, unknown) for w in words]
        found = np.array(list(self.machine.iter("".join([codes[i] for i in doc]))), np.int64).reshape(-1, 2)
        if not len(found):
            return none, none
        at, phrase = (found[:, 0] + 1) // self.width - self.phrase, found[:, 1]
        text = np.full(n + 2 * self.size, unknown, np.int32)
        text[self.size : self.size + n] = doc
        reach = np.arange(-self.lead, self.phrase + self.lead)
        times, starts = np.diff(self.offsets)[phrase], []
        upto = np.cumsum(times)
        lo = 0
        while lo < len(at):  # so many places of phrases at a time
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - times[lo] + 100_000, "right")))
            own = times[lo:hi]
            spot = np.repeat(at[lo:hi], own)
            place = self.places[np.repeat(self.offsets[phrase[lo:hi]] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            smaller = self.owner[place] < key
            spot, place = spot[smaller], place[smaller]
            equal = np.zeros((len(spot), len(reach) + 1), np.int32)
            np.cumsum(text[spot[:, None] + self.size + reach] == self.blob[place[:, None] + reach], axis=1, out=equal[:, 1:])
            row, shift = np.nonzero(equal[:, self.size :] - equal[:, : -self.size] == self.size)
            starts.append(np.unique(spot[row] - self.lead + shift))
            lo = hi
        starts = np.unique(np.concatenate(starts))
        return starts, starts + self.size


def _locate(columns: list[str], text_col: str, results: list[str], size: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(texts: pa.Table, passages: pa.Table) -> pa.Table:
        release()
        machine = Automaton(list(zip(passages.column("src").to_pylist(), passages.column("passage").to_pylist(), strict=True)), size)
        n_words, n_removed, spans, kept = [], [], [], []
        for key, text in zip(texts.column("id").to_pylist(), texts.column("text").to_pylist(), strict=True):
            raw = b" ".join((text or "").encode().split()).decode()
            words = raw.split(" ") if raw else []
            starts, ends = machine.spans(words, key)
            n_words.append(len(words))
            if not len(starts):
                n_removed.append(0), spans.append([]), kept.append(raw)
                continue
            gone = covered(len(words), starts, ends)
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            n_removed.append(int(gone.sum()))
            kept.append(" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        del machine
        release()
        own = [texts.column("text" if c == text_col else f"c{i}") for i, c in enumerate(columns)]
        return pa.table([*own, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=[*columns, *results])

    return run


def _repeats(docs: DataFrame, id_col: str, text_col: str, size: int, results: list[str]) -> DataFrame:
    """``docs`` with its own columns and the four results by these names."""
    bound_batches(docs.sparkSession)
    whole_ids(docs, id_col)
    names = docs.columns
    inner = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1)).alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col])
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    parts, buckets = int(max(LEAST, total // PART_BYTES)), int(max(LEAST, total // BUCKET_BYTES))
    inner = inner.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).cast("int"))

    entries = inner.select("id", "bucket", "text").where("text is not null").mapInArrow(_probe(parts, size), "part int, kind int, bucket int, docs binary, data binary")
    # As many tasks as parts, however few the session shuffles into.
    noted = materialise(entries.repartition(parts, "part").groupBy("part").applyInArrow(_match, "kind int, bucket int, data binary"), "phrases-noted")
    del entries
    reclaim(docs.sparkSession)
    blocks = inner.groupBy("bucket").cogroup(noted.where(F.col("kind") == CUT).groupBy("bucket")).applyInArrow(_cut(size), "src long, block int, passage string")
    wanted = noted.where(F.col("kind") == WANT).groupBy("bucket").applyInArrow(_wanted, "bucket int, src long, block int")
    passages = wanted.join(blocks, ["src", "block"]).select("bucket", "src", "passage")
    schema = f"{ddl(docs)}, `{results[0]}` long, `{results[1]}` long, `{results[2]}` array<struct<start:int,end:int>>, `{results[3]}` string"
    located = inner.groupBy("bucket").cogroup(passages.groupBy("bucket"))
    return located.applyInArrow(_locate(names, text_col, results, size), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Add ``n_words``, ``n_removed``, ``removed_spans`` (word ranges [start, end)) and ``kept_text`` (kept words, one blank
    between) to ``docs``.

    A word goes if a window of ``size`` consecutive words over it also starts in a document with a smaller id; windows are judged
    on the input. Words are separated by ASCII white space and compared unchanged. Null and empty texts have no words. A
    null id counts as larger than every other; ids that are no whole numbers raise ValueError; rows with equal ids take nothing
    from each other. Result columns replace columns
    of the same name; other columns stay. Empty tables give an empty result.
    """
    return _repeats(without(docs, *RESULTS), id_col, text_col, size, RESULTS)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with the repeated words cut out of the texts; texts without any stay as they are. Columns are those of ``docs``,
    and all but the text keep their values."""
    results = fresh(docs, *RESULTS)
    found = _repeats(docs, id_col, text_col, size, results)
    text = F.when(F.col(results[1]) > 0, F.col(results[3])).otherwise(F.col(f"`{text_col}`")).alias(text_col)
    return found.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])
