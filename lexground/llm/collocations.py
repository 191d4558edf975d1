"""Collocations by prefix-free parsing: content-triggered overlapping chunks form a dictionary, and phrases are counted inside its
distinct chunks, weighted by how often each was parsed.

Texts (A-Z as a-z) are cut at ``.,;:!?`` and line ends into pieces and these into words at blanks and tabs. Within a piece, four words
whose hash is a multiple of ``TRIGGER`` begin a chunk, which ends with the four words that begin the next; so repeated passages
are parsed into the same chunks wherever they lie. A phrase of up to five words that starts in a chunk ends in it, and belongs to the
chunk in which it starts without the four words that the next one repeats: each occurrence counts once.

Phrases grow by a word from pass to pass over the dictionary. A phrase can be frequent only if the two phrases without its first and
its last word are, so a pass counts those whose two parts are in a bitmap of fixed size that holds the frequent ones' hashes; a
phrase that a shared bit lets through is counted and then left out, so the bitmap never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import LOWER, Words, gather, mix, slices, span_hash, string_parts
from .common import bound_batches, materialise

#: Words of the longest phrase; one word in so many begins a chunk; a bitmap has 2 ** BITS bits (16 MB).
LONGEST, TRIGGER, BITS = 5, 16, 27
OVERLAP = LONGEST - 1
_STEP = 0xC2B2AE3D27D4EB4F

_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, *b".,;:!?", *range(0x0A, 0x0E)]] = False
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_UNSPACED = np.ones(256, bool)
_UNSPACED[0x20] = False


def _joined(words: Words, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Words ``starts[i]`` to ``ends[i] - 1``, joined by one space."""
    at = np.repeat(starts - np.r_[0, np.cumsum(ends - starts)[:-1]], ends - starts) + np.arange((ends - starts).sum())
    size = words.ends[at] - words.starts[at] + 1
    byte = np.r_[0, np.cumsum(size)]
    spots = np.repeat(words.starts[at] - byte[:-1], size) + np.arange(byte[-1])
    data = words.data[np.minimum(spots, len(words.data) - 1)]
    data[byte[1:] - 1] = 0x20
    last = byte[np.cumsum(ends - starts)] - 1  # the space after a phrase's last word goes
    keep = np.ones(len(data), bool)
    keep[last] = False
    sizes = np.diff(np.r_[-1, last]) - 1
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes())])


def _chunks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, whether the next chunk repeats the last four words) of each chunk."""
    n = len(words)
    breaks = np.r_[0, np.cumsum(_BREAK[words.data])][words.starts]
    begins = np.r_[True, (words.text[1:] != words.text[:-1]) | (breaks[1:] != breaks[:-1])]
    piece = np.cumsum(begins)
    trigger = np.zeros(n, bool)
    if n > OVERLAP:
        at = np.flatnonzero(piece[: n - OVERLAP + 1] == piece[OVERLAP - 1 :])
        trigger[at] = span_hash(words.hashes(), at, at + OVERLAP, _STEP) % np.uint64(TRIGGER) == 0
    first = np.flatnonzero(begins | trigger)
    follows = np.r_[~begins[first[1:]], False]
    return first, np.r_[first[1:], n] + OVERLAP * follows, follows


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The distinct chunks of all texts: ``lang``, ``chunk`` (words joined by one space), ``follows`` (its last four words belong to
    the next chunk) and ``n``, how often it was parsed."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*string_parts(batch.column("text")), _WORD, LOWER)
            if len(words):
                first, end, follows = _chunks(words)
                lang = batch.column("lang").take(pa.array(words.text[first]))
                yield pa.RecordBatch.from_arrays([lang, _joined(words, first, end), pa.array(follows)], ["lang", "chunk", "follows"])

    return rows.mapInArrow(parse, "lang string, chunk string, follows boolean").groupBy("lang", "chunk", "follows").agg(F.count("*").alias("n"))


def _lang_hashes(column: pa.Array) -> np.ndarray:
    data, offsets = string_parts(column)
    return span_hash(data, offsets[:-1], offsets[1:])


def _bits(hashes: np.ndarray, langs: np.ndarray, width: int) -> np.ndarray:
    return (mix(hashes ^ langs) >> np.uint64(64 - width)).astype(np.int64)


def _bitmap(frequent: DataFrame, width: int) -> np.ndarray:
    """The hashes of frequent phrases as a bitmap of fixed size: Spark builds its pages, the driver puts them together."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "phrase"):
            words = Words(*string_parts(batch.column("phrase")), _UNSPACED)
            bits = _bits(span_hash(words.hashes(), words.first[:-1], words.first[1:], _STEP), _lang_hashes(batch.column("lang")), width)
            yield pa.RecordBatch.from_pydict({"bit": np.unique(bits)})

    held = frequent.select("lang", "phrase").mapInArrow(spots, "bit long")
    pages = held.groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("page")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("bits"))
    out = np.zeros(1 << (width - 3), np.uint8)
    for row in pages.collect():
        at = (row.page - 1) * 4096
        out[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def _counts(chunks: DataFrame, size: int, shorter: DataFrame | None, width: int = BITS) -> DataFrame:
    """``lang``, ``phrase``, ``f``: occurrences of phrases of ``size`` words, of which both parts may be frequent."""
    shared = chunks.sparkSession.sparkContext.broadcast(_bitmap(shorter, width)) if shorter is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "chunk", most=4_000_000):
            words = Words(*string_parts(batch.column("chunk")), _UNSPACED)
            last = words.first[1:] - OVERLAP * batch.column("follows").to_numpy(zero_copy_only=False)  # later phrases start in the next chunk
            at = np.arange(len(words))
            at = at[(at < last[words.text]) & (at + size <= words.first[1:][words.text])]
            if shared is not None:
                part = np.arange(len(words) - size + 2)
                held = _bits(span_hash(words.hashes(), part, part + size - 1, _STEP), _lang_hashes(batch.column("lang"))[words.text[part]], width)
                known = shared.value[held >> 3] >> (held & 7).astype(np.uint8) & 1 == 1
                at = at[known[at] & known[at + 1]]
            phrase = gather(words, at) if size == 1 else _joined(words, at, at + size)
            rows = pa.table({"lang": batch.column("lang").take(pa.array(words.text[at])), "phrase": phrase, "f": batch.column("n").take(pa.array(words.text[at]))})
            yield from rows.group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"]).to_batches()

    return chunks.mapInArrow(count, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(chunks: DataFrame, least: int = 100, width: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): ``lang``, ``phrase``, ``size``, ``f`` of all phrases of one to five words that occur ``least`` times or more, and
    ``lang``, ``n``, the number of all words."""
    words = materialise(_counts(chunks, 1, None), "phrases-1")
    found = [words.where(F.col("f") >= least).select("lang", "phrase", F.lit(1).alias("size"), "f")]
    for size in range(2, LONGEST + 1):
        counted = _counts(chunks, size, found[-1], width).where(F.col("f") >= least)
        found.append(materialise(counted.select("lang", "phrase", F.lit(size).alias("size"), "f"), f"phrases-{size}"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, words.groupBy("lang").agg(F.sum("f").alias("n"))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words or more with their lowest-scoring cut: ``a`` occurrences, ``l`` and ``r`` those of the two parts,
    ``score`` = floor(1000 * a * n / (l * r)). Products are decimals of 38 digits: beyond, Spark raises an error (ANSI) or the score is null."""
    long = phrases.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "size")
    cuts = long.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "w", "size")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    # 1000 * a * n may pass 64 bits; the quotient is at most 1000 * n / a.
    both = both.withColumn("score", F.expr("cast(1000 as decimal(38, 0)) * a * n div (cast(l as decimal(38, 0)) * r)"))
    return both.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def contained(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases (``lang``, ``phrase``) that lie inside a longer one which occurs at least ``percent`` % as often."""
    long = phrases.where("size > 2").select("lang", F.split("phrase", " ").alias("w"), "size", "f")
    spans = F.expr("flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), i -> array_join(slice(w, i, s), ' '))))")
    inner = long.select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return phrases.join(inner, ["lang", "phrase"]).where(100 * F.col("most") >= percent * F.col("f")).select("lang", "phrase")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, top: int = 2000, percent: int = 100, width: int = BITS) -> DataFrame:
    """The ``top`` collocations of each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``, by score and ``a``
    descending, then by the phrase's bytes.

    Null languages are ``und``; null and empty texts have no words; rows that repeat count each; texts are read whole; a table without
    words gives no row. Columns other than language and text are not read.
    """
    chunks = materialise(dictionary(docs, lang_col, text_col), "phrases-chunks")
    phrases, totals = frequent_phrases(chunks, least, width)
    kept = scored(phrases, totals).join(contained(phrases, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language may have nearly all phrases: each of its 64 parts ranks its own first.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
