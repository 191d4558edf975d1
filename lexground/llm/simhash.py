"""SimHash: weighted term hashes vote on signed bits, and permuted block tables find fingerprints within a Hamming radius.

Terms are pairs of adjacent words (white space of ASCII between them, A-Z as a-z); the one word of a text that has no other is
its term. A term that occurs c times weighs ``round(16 * (1 + ln c))``. Each bit of a term's hash votes with this weight for a
one or a zero, and the sign of the sum is the bit of the fingerprint; a sum of 0 is a zero, so a text without words has only
zeros. Weights are whole numbers, so sums are exact and equal texts get equal fingerprints wherever they are computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, SPACED, Words, mix, slices, string_parts
from .common import bound_batches, fresh, materialise, without

BITS, RADIUS = 256, 8
#: Queries of one block of ``search``: what the driver and every worker hold of them.
MOST_QUERIES = 200_000
_LANES = BITS // 64
_SEEDS = mix(np.arange(1, _LANES + 1, dtype=np.uint64))
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of each distinct term, by text and hash."""
    words = Words(data, offsets, SPACED, LOWER)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    hashes = words.hashes()
    at, pairs = words.windows(hashes, 2)
    lone = words.first[:-1][np.diff(words.first) == 1]
    text, term = np.r_[words.text[at], words.text[lone]], np.r_[pairs, hashes[lone]]
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (term[1:] != term[:-1])])
    count = np.diff(np.r_[first, len(text)])
    return text[first], term[first], np.rint(16 * (1 + np.log(count)))


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the texts ``data[offsets[i]:offsets[i + 1]]``, a row of ``BITS / 8`` bytes each."""
    n = len(offsets) - 1
    text, term, weight = _terms(data, offsets)
    out = np.zeros((n, BITS // 8), np.uint8)
    for lane, seed in enumerate(_SEEDS):
        octets = mix(term ^ seed).astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            # Votes of equal bytes are added first; a table then has the eight signs of each of the 256 bytes.
            held = np.bincount(text * 256 + octets[:, k], weight, n * 256).reshape(n, 256)
            out[:, lane * 8 + k] = np.packbits(held @ _SIGNS > 0, axis=1)[:, 0]
    return out


def _of(texts: list[str]) -> np.ndarray:
    return fingerprints(*string_parts(pa.array(texts, pa.string())))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(1, dtype=np.int64) / BITS


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, ``BITS / 4`` hexadecimal digits of each whole text.

    A null text counts as empty, rows that repeat get the same fingerprint each, texts of any length are read whole, an empty table
    gives none. A column ``fingerprint`` is replaced, other columns stay.
    """
    bound_batches(docs.sparkSession)
    held = without(docs, "fingerprint")
    at = held.columns.index(text_col)
    plain = held.toDF(*[f"c{i}" for i in range(len(held.columns))])  # mapInArrow doesn't take names with dots

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, f"c{at}"):
            found = fingerprints(*string_parts(part.column(at)))
            yield part.append_column("fingerprint", pa.array([f.tobytes().hex() for f in found], pa.string()))

    return plain.mapInArrow(add, plain.select("*", F.lit("").alias("fingerprint")).schema).toDF(*held.columns, "fingerprint")


def _edited(ids: list, texts: list[str], prints: np.ndarray, after: list[str], after_prints: np.ndarray) -> dict:
    """The result columns of documents, given the document after each."""
    halves = [len(t) // 2 for t in texts]
    new = [t[: len(t) - h] + a[:h] for t, h, a in zip(texts, halves, after, strict=True)]
    found = _of(new)
    return {
        "id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
        "fingerprint": [p.tobytes().hex() for p in prints],
        "edited_fingerprint": [p.tobytes().hex() for p in found],
        "near_edited": likeness(prints, found).tolist(),
        "near_next": likeness(prints, after_prints).tolist(),
    }


_NONE, _FIRST, _LAST = 0, 1, 2


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document beside its edited text: the last ``n_chars // 2`` characters give way to the first as many (or all) of the next
    document, in descending order of the ids; after the last comes the first.

    Columns: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, and the likeness of the fingerprint
    to the edited text's (``near_edited``) and to the next document's (``near_next``). A null text is empty; null ids come last; equal
    ids follow by the MD5 of their texts; rows that repeat are documents of their own. An empty table gives no row, and the next of a
    single document is itself. Columns other than id and text are not read.

    Rows are range-partitioned and sorted by id, so a task meets neighbours in order and holds one batch and one row more. Only the
    first and the last row of each partition meet again, in a join by partition.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("id"), F.md5("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    result = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = f"id {kind.simpleString()}, {result}, part int, edge int, text string"
    # Spark's schema as Arrow's, from an empty table.
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, prints, part = [], [], np.zeros((0, BITS // 8), np.uint8), None

        def edge(which: int, i: int) -> pa.RecordBatch:
            row = {"id": ids[i], "fingerprint": prints[i].tobytes().hex(), "part": part, "edge": which, "text": texts[i]}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in slices(batches, "text"):
            begins, part = part is None, batch.column("part")[0].as_py()
            found = fingerprints(*string_parts(batch.column("text")))
            ids, texts, prints = ids + batch.column("id").to_pylist(), texts + batch.column("text").to_pylist(), np.concatenate([prints, found])
            if begins:
                yield edge(_FIRST, 0)
            out = _edited(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            n = len(ids) - 1
            yield pa.RecordBatch.from_pydict(out | {"part": [part] * n, "edge": [_NONE] * n, "text": [None] * n}, schema=arrow)
            ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if ids:
            yield edge(_LAST, 0)

    held = materialise(placed.mapInArrow(near, schema), "simhash-near")
    # One number for each partition that has rows: a window over these is bounded by the number of partitions.
    parts = held.where(F.col("edge") == _FIRST).select("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("to"))
    heads = held.where(F.col("edge") == _FIRST).select(F.col("part").alias("to"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    ends = held.where(F.col("edge") == _LAST).select("id", "text", "fingerprint", "part").join(follows, "part").join(heads, "to").drop("part", "to")
    last = arrow.remove(arrow.get_field_index("text")).remove(arrow.get_field_index("edge")).remove(arrow.get_field_index("part"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", "after"):
            prints, after = (np.array([list(bytes.fromhex(x)) for x in batch.column(c).to_pylist()], np.uint8) for c in ("fingerprint", "after_print"))
            out = _edited(batch.column("id").to_pylist(), batch.column("text").to_pylist(), prints, batch.column("after").to_pylist(), after)
            yield pa.RecordBatch.from_pydict(out, schema=last)

    inner = held.where(F.col("edge") == _NONE).drop("part", "edge", "text")
    return inner.unionByName(ends.mapInArrow(close, inner.schema)).withColumnRenamed("id", id_col)


def block_tables(radius: int, kept: int = 1) -> list[np.ndarray]:
    """The bits that make the key of each table: fingerprints are cut into ``radius + kept`` blocks, of which any two that differ in
    at most ``radius`` bits have ``kept`` whole blocks in common; a table permutes one choice of ``kept`` blocks to the front."""
    edges = np.linspace(0, BITS, radius + kept + 1).round().astype(int)
    blocks = [np.arange(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [np.concatenate(chosen) for chosen in combinations(blocks, kept)]


def _keys(bits: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The table's key of each row of bits, as one number (of up to 64 bits)."""
    return bits[:, table[:64]].astype(np.uint64) @ (np.uint64(1) << np.arange(min(len(table), 64), dtype=np.uint64))


def search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, kept: int = 1) -> DataFrame:
    """For each distinct ``queries.fingerprint`` the number of rows of ``prints`` whose fingerprint differs in at most ``radius`` bits,
    itself included if it is there: columns ``fingerprint``, ``n_near``. Null fingerprints are left out; an empty side gives no row.

    Queries go in blocks of ``MOST_QUERIES``; a block's permuted tables are sorted keys that every task of ``prints`` looks up. A
    pair that meets in several tables counts in the first alone. Equal fingerprints are counted once, with their number, before
    the search. Only counts leave a task, no pairs.
    """
    spark = prints.sparkSession
    tables = block_tables(radius, kept)
    held = materialise(prints.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("n")), "simhash-prints")
    asked = materialise(queries.where("fingerprint IS NOT NULL").select("fingerprint").distinct(), "simhash-queries")
    blocks = max(1, -(-asked.count() // MOST_QUERIES))
    out = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("fingerprint"), F.lit(blocks)) == b).toArrow().column("fingerprint")
        sought = np.frombuffer(bytes.fromhex("".join(mine.to_pylist())), np.uint8).reshape(-1, BITS // 8)
        shared = spark.sparkContext.broadcast(sought)

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sought = shared.value
            bits = np.unpackbits(sought, axis=1)
            sides = [(k := _keys(bits, t), np.argsort(k, kind="stable")) for t in tables]
            found = np.zeros(len(sought), np.int64)
            for batch in batches:
                have = np.frombuffer(bytes.fromhex("".join(batch.column("fingerprint").to_pylist())), np.uint8).reshape(-1, BITS // 8)
                n, have_bits = batch.column("n").to_numpy(), np.unpackbits(have, axis=1)
                for t, (keys, order) in enumerate(sides):
                    mine, ranked = _keys(have_bits, tables[t]), keys[order]
                    lo, hi = np.searchsorted(ranked, mine, "left"), np.searchsorted(ranked, mine, "right")
                    for row in np.flatnonzero(hi > lo):
                        at = order[lo[row] : hi[row]]
                        at = at[np.bitwise_count(sought[at] ^ have[row]).sum(1, dtype=np.int64) <= radius]
                        for u in tables[:t]:  # met before
                            at = at[(bits[at][:, u] != have_bits[row, u]).any(1)] if len(at) else at
                        found[at] += n[row]
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({"q": at, "n": found[at]}, schema=pa.schema([("q", pa.int64()), ("n", pa.int64())]))

        sums = held.mapInArrow(look, "q long, n long").groupBy("q").agg(F.sum("n").alias("n_near"))
        names = spark.createDataFrame(pa.table({"q": np.arange(len(mine)), "fingerprint": mine}))
        got = names.join(sums, "q", "left").select("fingerprint", F.coalesce("n_near", F.lit(0)).alias("n_near"))
        out = got if out is None else out.unionByName(got)
    return out


def with_neighbours(found: DataFrame, asks, radius: int = RADIUS) -> DataFrame:
    """``found`` (with a ``fingerprint``) and ``n_near`` for rows that meet the condition ``asks``: how many other rows have a fingerprint
    within ``radius`` bits. Other rows get null. A column ``n_near`` is replaced."""
    held = without(found, "n_near")
    key, near = fresh(held, "_key", "_near")
    counts = search(held.where(asks), held, radius).select(F.col("fingerprint").alias(key), F.col("n_near").alias(near))
    joined = held.withColumn(key, F.when(asks, F.col("fingerprint"))).join(counts, key, "left")
    return joined.withColumn("n_near", F.col(near) - 1).drop(key, near)
