"""Language identification, words first: known words score by their log frequency in each language, unseen ones by the longest
character n-grams that are known, shorter ones where those are not.

Counts cover all labelled training texts, and every counted word and n-gram is used. The most frequent words are broadcast, in a
table bounded by ``CELLS``; all other words of the texts meet the full table of words in a join. The n-grams are
broadcast behind a check of their number, and joined where there are more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Words, gather, slices, span_hash, string_parts
from .common import bound_batches, fresh, materialise, text_key, without

ORDERS = (4, 3, 2, 1)
#: Numbers (items x languages) in one broadcast table: 16 MB. Beyond it words and n-grams are joined.
CELLS = 4_000_000
#: Distinct words or n-grams that a task gathers before it sends their counts on.
FLUSH = 300_000
#: ASCII letters of lower case and every byte of a non-ASCII letter.
_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x80:] = True


def letters(texts: pa.Array) -> Words:
    """The words of texts: runs of letters in lower case, with the marks that follow a letter (vowel signs, accents of their own)."""
    low = pc.utf8_lower(texts.cast(pa.large_string()))
    low = pc.replace_substring_regex(low, r"[^\x00-\x7F\pL\pM]+", " ")  # signs and digits beyond ASCII are no letters
    low = pc.replace_substring_regex(low, r"(^|[^\pL\pM])\pM+", r"\1 ")  # nor are marks without one
    return Words(*string_parts(low), _LETTERS)


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of ``^word$`` for all words: (word, place, length, hash). A hash stands for a letter sequence of one length."""
    marked = [f"^{w}$" for w in words.to_pylist()]
    size = np.array([len(w) for w in marked], np.int64)
    letters = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(marked)), size)
    at = np.arange(len(letters))
    end = (first + size)[word]
    found = []
    for n in ORDERS:
        own = np.flatnonzero(at + n <= end)
        found.append((word[own], own - first[word[own]], np.full(len(own), n, np.int64), span_hash(letters, own, own + n).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _summed(tables: list[pa.Table], keys: list[str], counts: list[str]) -> pa.Table:
    table = pa.concat_tables(tables).group_by(keys).aggregate([(c, "sum") for c in counts])
    return table.rename_columns([c.removesuffix("_sum") for c in table.column_names])


def _count(rows: DataFrame, langs: int, keys: str, made) -> DataFrame:
    """(``keys``, ns) with one count a language, pre-counted in each task, then summed. ``made`` turns a batch into tables."""
    names, counts = [x.split(" ")[0] for x in keys.split(", ")], [f"n{i}" for i in range(langs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for table in made(batch):
                held.append(table)
                n += len(table)
                if n > FLUSH:
                    held = [_summed(held, names, counts)]
                    n = len(held[0])
                    if n > FLUSH // 2:
                        yield from held[0].combine_chunks().to_batches(10_000)
                        held, n = [], 0
        if held:
            yield from _summed(held, names, counts).combine_chunks().to_batches(10_000)

    found = rows.mapInArrow(run, f"{keys}, {', '.join(f'{c} long' for c in counts)}").groupBy(*names).agg(*[F.sum(c).alias(c) for c in counts])
    return found.select(*names, F.array(*counts).alias("ns"))


def count_words(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(item, ns) over all rows (lang, text)."""
    counts = [f"n{i}" for i in range(len(langs))]

    def made(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for own in slices(iter([batch]), "text"):
            words = letters(own.column("text"))
            lang = pc.index_in(own.column("lang"), pa.array(langs)).to_numpy(zero_copy_only=False)
            _, at, item = np.unique(words.hashes(), return_index=True, return_inverse=True)
            n = np.bincount(item * len(langs) + lang[words.text], minlength=len(at) * len(langs)).reshape(-1, len(langs))
            yield pa.table([gather(words, at), *[pa.array(n[:, i]) for i in range(len(langs))]], names=["item", *counts])

    return _count(docs, len(langs), "item string", made)


def count_grams(words: DataFrame, langs: int) -> DataFrame:
    """(k, item, ns) of the character n-grams of the counted words (item, ns)."""

    def made(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for some in range(0, batch.num_rows, 20_000):
            own = batch.slice(some, 20_000)
            word, _, k, item = grams_of(own.column("item"))
            times = np.array(own.column("ns").flatten()).reshape(-1, langs)[word]
            held = pa.table([pa.array(k), pa.array(item), *[pa.array(times[:, i]) for i in range(langs)]], names=["k", "item", *[f"n{i}" for i in range(langs)]])
            yield _summed([held], ["k", "item"], [f"n{i}" for i in range(langs)])

    return _count(words, langs, "k long, item long", made)


def _logs(total: Column) -> Column:
    """Log frequency in each language, smoothed by half a count."""
    return F.zip_with("ns", total, lambda n, t: F.log((n + 0.5) / (t + 1)))


def _array(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _held(table: pa.Table, langs: int) -> np.ndarray:
    """The logs of a collected table."""
    return np.array(table.column("logs").combine_chunks().flatten(), np.float32).reshape(len(table), langs)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 200_000, cells: int = CELLS) -> dict:
    """The model: languages, the ``max_words`` most frequent words for a broadcast (fewer if ``cells`` says so), and tables of all
    words (item, logs) and all n-grams (k, item, logs). Rows without a language or text are left out."""
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    langs = sorted(r["lang"] for r in own.select("lang").distinct().collect())
    if not langs:
        return {"langs": []}
    sums = [F.sum(F.col("ns")[i]).alias(f"t{i}") for i in range(len(langs))]
    counts = materialise(count_words(own, langs), "langid-words")
    total = [x or 0 for x in counts.agg(*sums).first()]
    words = counts.select("item", _logs(_array(total)).alias("logs"))
    most = min(max_words, cells // len(langs))
    often = F.aggregate("ns", F.lit(0).cast("long"), lambda a, b: a + b)
    hot = words.join(counts.select("item", often.alias("n")).orderBy(F.desc("n"), "item").limit(most).select("item"), "item").toArrow() if most else None

    grams = materialise(count_grams(counts, len(langs)), "langid-grams")
    rows = grams.groupBy("k").agg(F.count("*").alias("rows"), *sums).collect()
    of = {r["k"]: [r[f"t{i}"] + 1 for i in range(len(langs))] for r in rows}
    of_order = F.element_at(F.create_map(*[x for k in ORDERS for x in (F.lit(k), _array(of.get(k, [1] * len(langs))))]), F.col("k").cast("int"))
    table = grams.select("k", "item", _logs(of_order).alias("logs"))
    few = 0 < sum(r["rows"] for r in rows) * len(langs) <= cells
    found = table.toArrow().sort_by("item") if few else None
    by_order = {k: found.filter(pc.equal(found["k"], k)) for k in ORDERS} if few else {}
    return {
        "langs": langs,
        "words": ({w: i for i, w in enumerate(hot["item"].to_pylist())}, _held(hot, len(langs))) if most else ({}, np.zeros((0, len(langs)), np.float32)),
        "word_logs": words,
        "gram_logs": table,
        "grams": {k: (t["item"].to_numpy(), _held(t, len(langs))) for k, t in by_order.items()},
    }


EVIDENCE = "key binary, n long, total array<double>, rest array<struct<item:string,n:long>>"


def _evidence(docs: DataFrame, langs: int, words: tuple[dict[str, int], np.ndarray]) -> DataFrame:
    """Of each text the number of words, the evidence of the broadcast words, and the other words with their counts."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, logs = held.value
        logs = np.vstack([logs, np.zeros((1, langs), np.float32)])
        for batch in slices(batches, "text"):
            own = letters(batch.column("text"))
            _, at, item = np.unique(own.hashes(), return_index=True, return_inverse=True)
            names = gather(own, at)
            spot = np.array([index.get(w, -1) for w in names.to_pylist()], np.int64)
            here = spot[item]
            sums = np.zeros((len(own) + 1, langs))
            np.cumsum(logs[here], axis=0, dtype=np.float64, out=sums[1:])
            total = sums[own.first[1:]] - sums[own.first[:-1]]
            # The words that are not broadcast, once a text.
            cold = np.flatnonzero(here < 0)
            pair, times = np.unique(own.text[cold] * len(at) + item[cold], return_counts=True)
            text = pair // max(1, len(at))
            rest = pa.StructArray.from_arrays([names.take(pa.array(pair % max(1, len(at)))), pa.array(times, pa.int64())], names=["item", "n"])
            offsets = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            totals = pa.ListArray.from_arrays(np.arange(0, batch.num_rows * langs + 1, langs, np.int32), total.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(own.first)), totals, pa.ListArray.from_arrays(offsets, rest)], names=["key", "n", "total", "rest"])

    return docs.mapInArrow(run, EVIDENCE)


def _backed_off(words: list[str], grams: dict[int, tuple[np.ndarray, np.ndarray]], langs: int) -> np.ndarray:
    """Evidence of unseen words: at each place the longest known n-gram; the mean counts as one word of two n-grams."""
    word, place, k, item = grams_of(pa.array(words, pa.string()))
    sums, n, done = np.zeros((len(words), langs)), np.zeros(len(words)), np.zeros(0, np.int64)
    width = int(place.max(initial=0)) + 1
    for order in ORDERS:
        keys, logs = grams[order]
        own = np.flatnonzero(k == order)
        at = np.searchsorted(keys, item[own])
        known = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == item[own]) if len(keys) else np.zeros(len(own), bool)
        spot = word[own] * width + place[own]
        known &= ~np.isin(spot, done)
        own, at = own[known], at[known]
        done = np.concatenate([done, spot[known]])
        np.add.at(sums, word[own], logs[at])
        n += np.bincount(word[own], minlength=len(words))
    return sums * 2 / np.maximum(n, 1)[:, None]


def _by_broadcast(rest: DataFrame, grams: dict, langs: int) -> DataFrame:
    """(key, more0, ...) of rows (key, n, item, logs), logs null for unseen words."""
    held = rest.sparkSession.sparkContext.broadcast(grams)
    names = [f"more{i}" for i in range(langs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = batch.column("logs")
            unseen = np.flatnonzero(logs.is_null().to_numpy(zero_copy_only=False))
            found = np.zeros((batch.num_rows, langs))
            found[np.setdiff1d(np.arange(batch.num_rows), unseen)] = np.array(logs.flatten()).reshape(-1, langs)
            if len(unseen):
                own = batch.column("item").take(pa.array(unseen)).dictionary_encode()
                found[unseen] = _backed_off(own.dictionary.to_pylist(), held.value, langs)[own.indices.to_numpy()]
            found *= batch.column("n").to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(found[:, i]) for i in range(langs)]], names=["key", *names])

    return rest.select("key", "n", "item", "logs").mapInArrow(run, f"key binary, {', '.join(f'{c} double' for c in names)}")


def _by_join(rest: DataFrame, grams: DataFrame, langs: int) -> DataFrame:
    """The same by a join with all n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 1000):
                words = batch.column("word").slice(some, 1000)
                word, place, k, item = grams_of(words)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(word)), pa.array(place, pa.int32()), pa.array(k), pa.array(item)], names=["word", "i", "k", "item"])

    unseen = rest.where("logs is null").select(F.col("item").alias("word")).distinct()
    spots = unseen.mapInArrow(run, "word string, i int, k long, item long").join(grams, ["k", "item"])
    best = spots.groupBy("word", "i").agg(F.max_by("logs", "k").alias("logs"))
    backed = best.groupBy("word").agg(F.array(*[F.sum(F.col("logs")[j]) * 2 / F.count("*") for j in range(langs)]).alias("backed"))
    logs = F.coalesce("logs", "backed", F.array(*[F.lit(0.0)] * langs))
    found = rest.join(backed, rest["item"] == backed["word"], "left").withColumn("logs", logs)
    return found.select("key", *[(F.col("n") * F.col("logs")[j]).alias(f"more{j}") for j in range(langs)])


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs``; only the text is looked at.

    A null text, a text without a letter, or a model without languages gives 'und' and 0. Ties go to the first language by
    name. ``score`` is the winner's share of exp(evidence / (1 + log words)). Result columns replace columns of the same name.
    """
    bound_batches(docs.sparkSession)
    own, langs = without(docs, "lang_pred", "score"), model["langs"]
    names = [F.col(f"`{c}`") for c in own.columns]
    if not langs:
        return own.select(*names, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    text = F.col(f"`{text_col}`")
    slim = docs.where(text.isNotNull()).select(text_key(text).alias("key"), text.alias("text"))
    found = materialise(_evidence(slim, len(langs), model["words"]).dropDuplicates(["key"]).where("n > 0"), "langid-evidence")
    rest = found.select("key", F.explode("rest").alias("x")).select("key", "x.item", "x.n").join(model["word_logs"], "item", "left")
    rest = _by_broadcast(rest, model["grams"], len(langs)) if model["grams"] else _by_join(rest, model["gram_logs"], len(langs))
    more = rest.groupBy("key").agg(F.array(*[F.sum(f"more{j}") for j in range(len(langs))]).alias("more"))
    total = F.when(F.col("more").isNull(), F.col("total")).otherwise(F.zip_with("total", "more", lambda a, b: a + b))
    summed = found.select("key", "n", "total").join(more, "key", "left").select("key", "n", total.alias("total")).withColumn("top", F.array_max("total"))
    share = F.transform("total", lambda x: F.exp((x - F.col("top")) / (1 + F.log("n"))))
    best = F.element_at(F.array(*map(F.lit, langs)), F.array_position("total", F.col("top")).cast("int"))
    key, pred, score = fresh(own, "key", "lang_pred", "score")
    result = summed.select(F.col("key").alias(key), best.alias(pred), (1 / F.aggregate(share, F.lit(0.0), lambda a, b: a + b)).alias(score))
    joined = own.withColumn(key, text_key(text)).join(result, key, "left")
    return joined.select(*names, F.coalesce(F.col(pred), F.lit("und")).alias("lang_pred"), F.coalesce(F.col(score), F.lit(0.0)).alias("score"))
