"""Near duplicates by Order MinHash: smallest occurrence-labelled k-mers of words, kept in text order, make a key; texts that share
a key are candidates, and a banded alignment decides.

Texts of a pair are loaded and aligned only if their profiles, bits of the words they have, allow the similarity.

Every key takes the smallest k-mer of each of ``pick`` equal parts of the text, in text order, so that a passage that many
texts share can't fill a key alone unless it covers most of the text. Equal texts are one node throughout. Every node is
compared with one representative of its buckets, the one that shares most buckets with others; then, in rounds, with
representatives of every bucket that still holds nodes apart, twice as many each round. Pairs that a chain of links joins already are left out, and a bucket is done when all
its nodes are in one group or have met each other: the groups are those of all pairs of all buckets. Pairs beyond the number of
nodes are formed only where a bucket holds nodes that are not linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import ALNUM, Words, mix, slices, span_hash, string_parts
from .common import fresh, materialise, text_key, without

K, PICK, KEYS, SIMILAR = 5, 2, 40, 0.8
#: Bits of a text's profile, as 64-bit numbers, and of the wide one that texts of buckets with several groups have after the first links.
LANES, WIDE = 4, 32
#: Words of a text from which on an alignment holds a band of positions instead of a number for each word.
LONG = 20_000
#: So few pairs left, in all or (after two rounds of representatives, which join large groups) for each row of the buckets, are compared in
#: one round: most are told apart by length and profile.
LAST_PAIRS, LAST_EACH = 100_000, 64
_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, 256, np.uint64)


def _words(texts: pa.Array) -> Words:
    """Words in lower case without ASCII punctuation."""
    return Words(*string_parts(pc.utf8_lower(texts.cast(pa.large_string()))), ALNUM)


def order_minhash(words: Words, k: int = K, pick: int = PICK, keys: int = KEYS) -> tuple[np.ndarray, np.ndarray]:
    """(texts with a word, their ``keys`` sketches as rows). The k-mers of a text (a shorter text is one) are labelled with their
    occurrence and dealt to ``pick`` equal parts by place; a sketch hashes the smallest k-mer of each part, in text order."""
    n = np.diff(words.first)
    grams = np.where(n > 0, np.maximum(1, n - k + 1), 0)
    text = np.repeat(np.arange(len(n)), grams)
    if not len(text):
        return np.zeros(0, np.int64), np.zeros((0, keys), np.uint64)
    place = np.arange(len(text)) - np.repeat(np.cumsum(grams) - grams, grams)
    at = words.first[:-1][text] + place
    h = span_hash(words.hashes(), at, np.minimum(at + k, words.first[1:][text]))
    order = np.lexsort((h, text))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])]
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = (np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))).astype(np.uint64)
    labelled = mix(h + occurrence * np.uint64(0x9E3779B97F4A7C15))
    part = place * pick // grams[text]
    starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (text[1:] != text[:-1])])
    own, row = np.unique(text[starts], return_inverse=True)
    out = np.zeros((len(own), keys), np.uint64)
    for i in range(keys):
        least = np.minimum.reduceat(labelled * _MULTIPLY[i] + _ADD[i], starts)
        key = np.full(len(own), i + 1, np.uint64)
        for c in range(pick):
            here = part[starts] == c
            key[row[here]] = mix(key[row[here]] * np.uint64(0xD6E8FEB86659FD93) + least[here])
        out[:, i] = key
    return own, out


def profiles(words: Words, lanes: int = LANES) -> np.ndarray:
    """One row of ``lanes`` numbers a text: words labelled with their occurrence are dealt to 64 * ``lanes`` bins by a hash, and a bin has the
    last bit of its smallest hash (0 if it is empty)."""
    n, h = len(words.first) - 1, words.hashes()
    order = np.lexsort((h, words.text))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (words.text[order][1:] != words.text[order][:-1])] if len(h) else np.zeros(0, bool)
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = (np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))).astype(np.uint64)
    labelled = mix(h * np.uint64(0x9E3779B97F4A7C15) + occurrence)
    bins = 64 * lanes
    least = np.full(n * bins, (1 << 64) - 2, np.uint64)
    np.minimum.at(least, words.text * bins + (labelled >> np.uint64(32)).astype(np.int64) % bins, mix(labelled))
    bits = (least & np.uint64(1)).astype(np.uint8).reshape(n, lanes, 64)
    return np.packbits(bits, axis=2, bitorder="little").reshape(n, lanes * 8).view("<u8")


def most_apart(least: float, bins: int = 64 * LANES) -> int:
    """Bits in which the profiles of two texts of similarity ``least`` differ at most, but for a chance of about one in 10**8.

    Their words as labelled bags have a Jaccard similarity j of at least least / (2 - least); in a bin the smallest of both texts is one
    that they share with chance j or more, and else their bits differ with one half. Six deviations are left beyond the mean."""
    p = (1 - least / (2 - least)) / 2
    return min(bins, math.ceil(bins * p + 6 * math.sqrt(bins * p * (1 - p))))


def most_apart_of(least: float, words: Column, bins: int = 64 * WIDE) -> Column:
    """``most_apart`` for two texts of ``words`` words together: both have at most (1 - least / 2) * words different labelled words, so that short
    texts leave bins empty, and these don't differ."""
    filled = 1 - F.exp(words * ((1 - least / 2) * math.log1p(-1 / bins)))
    p = filled * ((1 - least / (2 - least)) / 2)
    return F.ceil(bins * p + 6 * F.sqrt(bins * p * (1 - p)))


def _window(spots: np.ndarray, low: int, width: int) -> int:
    """The positions from ``low`` on, ``width`` of them, as bits."""
    lo, hi = np.searchsorted(spots, (low, low + width))
    if hi - lo < 4:
        return sum(1 << int(i) - low for i in spots[lo:hi])
    held = np.zeros(width, bool)
    held[spots[lo:hi] - low] = True
    return int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")


def _long_lcs(a: list, b: list, band: int) -> int:
    """``banded_lcs`` in the memory of the band: only its bits are held, and what leaves it is counted."""
    spots, width = np.argsort(a, kind="stable"), 2 * band + 1
    names, first = np.unique(np.asarray(a)[spots], return_index=True)
    where = dict(zip(names.tolist(), np.split(spots, first[1:]), strict=True))
    full = (1 << width) - 1
    v, found = full, 0
    for j, y in enumerate(b):
        own = where.get(y)
        if own is not None and (m := _window(own, j - band, width)):
            u = v & m
            v = ((v + u) | (v - u)) & full
        found += 1 - (v & 1)
        v = v >> 1 | 1 << (width - 1)
    return found + width - v.bit_count()


def banded_lcs(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence of matches at most ``band`` places off the diagonal, a machine word of
    positions at a time (Hyyro's bit-parallel recurrence with the matches masked to the band)."""
    n = len(a)
    if n > LONG:
        return _long_lcs(a, b, band)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << n) - 1
    v, window = full, (1 << (2 * band + 1)) - 1
    for j, y in enumerate(b):
        m = where.get(y)
        if m:
            lo = j - band
            u = v & m & (window << lo if lo >= 0 else window >> -lo)
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Edit similarity of two texts given as word hashes: 2 * aligned words / words of both; 0 if it is below ``least``.

    The band holds every alignment that reaches ``least``: with so few words left over, none is further off the diagonal.
    Texts whose lengths, or whose words as bags, rule that out are not aligned."""
    n, m = len(a), len(b)
    if not n or not m or 2 * min(n, m) < least * (n + m):
        return 0.0
    if n == m and (a == b).all():
        return 1.0
    words, times = np.unique(np.concatenate([a, b]), return_inverse=True)[1], None
    times = np.minimum(np.bincount(words[:n], minlength=words.max() + 1), np.bincount(words[n:], minlength=words.max() + 1))
    if 2 * int(times.sum()) < least * (n + m):
        return 0.0
    band = math.ceil((1 - least) / 2 * (n + m) + abs(n - m) / 2) + 1
    found = 2 * banded_lcs(words[:n].tolist(), words[n:].tolist(), band)
    return found / (n + m) if found >= least * (n + m) else 0.0


def _sketch(docs: DataFrame, k: int, pick: int, keys: int) -> DataFrame:
    """(id, node, keys, size in words, profile, wide profile) of the texts that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            # Equal texts of a slice are sketched once.
            code = batch.column("node").dictionary_encode().indices.to_numpy()
            words = _words(batch.column("text").take(pa.array(np.unique(code, return_index=True)[1])))
            own, found = order_minhash(words, k, pick, keys)
            place = np.full(len(words.first) - 1, -1)
            place[own] = np.arange(len(own))
            rows = np.flatnonzero(place[code] >= 0)
            found = found[place[code[rows]]].view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(rows) * keys + 1, keys, np.int32), found.ravel())
            profile, wide = (pa.ListArray.from_arrays(np.arange(0, len(rows) * n + 1, n, np.int32), profiles(words, n)[code[rows]].view(np.int64).ravel()) for n in (LANES, WIDE))
            size, rows = pa.array(np.diff(words.first)[code[rows]], pa.int32()), pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("node").take(rows), lists, size, profile, wide], names=["id", "node", "keys", "size", "profile", "wide"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "node", "text").mapInArrow(run, f"id {kind}, node binary, keys array<long>, size int, profile array<long>, wide array<long>")


def _verify(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b): the groups of the pairs that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", "text_b"):
            a, b = _words(batch.column("text_a")), _words(batch.column("text_b"))
            ha, hb = a.hashes(), b.hashes()
            keep = [similarity(ha[a.first[i] : a.first[i + 1]], hb[b.first[i] : b.first[i + 1]], least) >= least for i in range(batch.num_rows)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("label_a").filter(mask), batch.column("label_b").filter(mask)], names=["a", "b"])

    return pairs.select("label_a", "label_b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``: the least node of its connected component. Edges
    from a node to itself are left out, and so are nodes without other ones.

    Every round takes the least label among the neighbours and then the label of that label; it ends when nothing changes.
    Each round is written to the shared folder; only the number of changes comes to the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct(), f"{name}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hop = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("up"))
        new = materialise(hop.join(up, "via", "left").select("node", "old", F.least("via", F.coalesce("up", "via")).alias("label")), name)
        changed = new.where("old != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _compare(rows: DataFrame, first: DataFrame, least: float, lanes: int = LANES, once: bool = False) -> DataFrame:
    """Rows joined with representatives of their buckets: pairs with different labels, of lengths and words that can be similar. With ``once``,
    ``rows`` and ``first`` have all ``keys`` of their nodes, and a pair comes from the first bucket that both are in."""
    rep = first.select("key", F.col("node").alias("rep"), F.col("size").alias("rep_size"), *[F.col(f"p{i}").alias(f"rep_p{i}") for i in range(lanes)], F.col("label").alias("rep_label"), F.col("degree").alias("rep_degree"), *[F.col("keys").alias("rep_keys")] * once)
    # ``similarity`` is below ``least`` for all others: by length, and by the profiles.
    apart = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"rep_p{i}"))) for i in range(1, lanes)), F.bit_count(F.col("p0").bitwiseXOR(F.col("rep_p0"))))
    both = F.col("size") + F.col("rep_size")
    alike = (2 * F.least("size", "rep_size") >= F.lit(least) * both) & (apart <= most_apart_of(least, both, 64 * lanes))
    if once:
        alike = alike & (F.col("key") == F.get(F.array_intersect("keys", "rep_keys"), F.lit(0)))
    return rows.join(rep, "key").where((F.col("label") != F.col("rep_label")) & alike)


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct (a, b, label_a, label_b) with a < b."""
    swap = F.col("rep") < F.col("node")
    pair = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("rep", "node", "a"), ("node", "rep", "b"), ("rep_label", "label", "label_a"), ("label", "rep_label", "label_b"))]
    return found.select(*pair).distinct()


def _moves(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame | None:
    """(label, to) of the labels that the links among ``pairs`` change."""
    loaded = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    edges = materialise(_verify(loaded, least), "neardup-edges")
    return components(edges, "neardup-labels").select(F.col("node").alias("label"), F.col("label").alias("to")) if edges.limit(1).count() else None


def _moved(rows: DataFrame, moves: DataFrame | None) -> DataFrame:
    return rows if moves is None else rows.join(moves, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def _link(members: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(node, label) of the nodes of ``members(key, node, size, p0, .., n)``, n nodes a bucket: equal labels for what links join. After the first
    links, what is left has the wide profiles of ``nodes(node, keys, wide)``."""
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    marks = [f"p{i}" for i in range(LANES)]
    rows = materialise(members.join(degree, "node").select("key", "node", "size", *marks, "degree", F.col("node").alias("label")), "neardup-rows")
    labels, reps = rows.select("node", "label").distinct(), 1
    top = lambda *by: rows.groupBy("key", *by).agg(F.max(F.struct("degree", "node", "size", *marks, "label")).alias("top")).select("key", "top.*")
    # At first every node meets one other only: of its buckets' representatives the one with most neighbours.
    best = _compare(rows, top(), least).groupBy("node", "label").agg(F.max(F.struct("rep_degree", "rep", "rep_label")).alias("best")).select("node", "label", "best.*")
    met = materialise(_pairs(best), "neardup-pairs")
    moves = _moves(met, texts, least)
    while True:
        labels = materialise(_moved(labels, moves), "neardup-labels")
        rows = _moved(rows, moves).select("key", "node", "size", *marks, "degree", "label")
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
        rows = rows.join(mixed, "key", "left_semi")
        if len(marks) < WIDE:
            marks = [f"p{i}" for i in range(WIDE)]
            rows = rows.select("key", "node", "size", "degree", "label").join(nodes.select("node", "wide"), "node").select("key", "node", "size", *[F.get("wide", F.lit(i)).alias(m) for i, m in enumerate(marks)], "degree", "label")
        rows = materialise(rows, "neardup-rows")
        # Of each bucket the nodes, the pairs of different labels, and the label that most nodes have.
        own = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
        buckets = own.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("alike"), F.max(F.struct("n", "label")).alias("most"))
        left = buckets.agg(F.sum("n").alias("rows"), F.sum(F.expr("(n * n - alike) div 2")).alias("pairs")).first()
        if not left["rows"]:
            return labels
        last = left["pairs"] <= max(LAST_PAIRS, max(reps, LAST_EACH if reps > 2 else 0) * left["rows"])
        if last:
            # All pairs of different labels: those without the commonest label meet every node.
            rows = rows.join(nodes.select("node", "keys"), "node")
            first = rows.join(buckets.select("key", F.col("most.label").alias("most")), "key").where("label != most")
        else:
            first = materialise(top(F.pmod(F.xxhash64("node", "key"), F.lit(reps)).alias("slot")), "neardup-reps")
        pairs = materialise(_pairs(_compare(rows, first, least, WIDE, last)).join(met, ["a", "b"], "left_anti"), "neardup-pairs")
        moves = _moves(pairs, texts, least)
        if last:
            return materialise(_moved(labels, moves), "neardup-labels")
        met = met.select("a", "b").union(pairs.select("a", "b"))
        rows = rows.join(first.select("key", "node"), ["key", "node"], "left_anti")
        reps *= 2


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, pick: int, keys: int, least: float) -> DataFrame:
    """(node, class_id, class_node, class_size) of every distinct text with a word; class_node is the least text key with the
    least id."""
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_key(F.col(f"`{text_col}`")).alias("node"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    sketches = _sketch(slim, k, pick, keys)
    nodes = materialise(sketches.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("profile").alias("profile"), F.first("wide").alias("wide")), "neardup-nodes")

    marks = [f"p{i}" for i in range(LANES)]
    members = nodes.select("node", "size", *[F.get("profile", F.lit(i)).alias(m) for i, m in enumerate(marks)], F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(members.join(shared, "key").select("key", "node", "size", *marks, "n"), "neardup-members")

    chosen = members.select("node").distinct().join(nodes.select("node", "id"), "node")
    texts = slim.alias("t").join(chosen.alias("c"), (F.col("t.node") == F.col("c.node")) & F.col("t.id").eqNullSafe(F.col("c.id")), "left_semi")
    texts = materialise(texts.select("node", "text").dropDuplicates(["node"]), "neardup-texts")
    labels = _link(members, nodes.select("node", "keys", "wide"), texts, least)

    grouped = nodes.select("node", "id", "copies").join(labels, "node", "left").select("node", "id", "copies", F.coalesce("label", "node").alias("label"))
    least_row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node"))
    classes = grouped.groupBy("label").agg(least_row.alias("least"), F.sum("copies").alias("class_size"))
    return grouped.join(classes, "label").select("node", F.col("least.id").alias("class_id"), F.col("least.node").alias("class_node"), "class_size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, pick: int = PICK, keys: int = KEYS, least: float = SIMILAR) -> DataFrame:
    """Add ``class_id``, the least id of the document's group of near copies, and ``class_size`` (documents of the group).

    Two texts that share a key are linked if the alignment of their words (lower case, without ASCII punctuation) has a
    similarity of ``least`` or more; groups are closed under links. Equal texts are always in one group. A null
    text, or one without a word, is a group of its own, and so is a null id with such a text (class_id null). Rows that
    repeat an id belong to their own texts' groups. Texts are read whole; an alignment of long ones takes the memory of its band. An
    empty table gives an empty result. Result columns replace columns of the same name; others stay.
    """
    classes = _classes(docs, id_col, text_col, k, pick, keys, least)
    out = without(docs, "class_id", "class_size")
    node, found_id, size = fresh(out, "node", "class_id", "class_size")
    found = out.withColumn(node, text_key(F.col(f"`{text_col}`"))).join(classes.select(F.col("node").alias(node), F.col("class_id").alias(found_id), F.col("class_size").alias(size)), node, "left")
    own = [F.col(f"`{c}`") for c in out.columns]
    return found.select(*own, F.when(F.col(size).isNull(), F.col(f"`{id_col}`")).otherwise(F.col(found_id)).alias("class_id"), F.coalesce(size, F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, pick: int = PICK, keys: int = KEYS, least: float = SIMILAR) -> DataFrame:
    """One row of each group of near copies, with the columns and values of ``docs``: that of the least id (null is the largest;
    of several texts with that id the one with the least key, and one of equal rows of both). Null texts and texts without
    a word are groups of their own and stay."""
    classes = _classes(docs, id_col, text_col, k, pick, keys, least).select("node", "class_id", "class_node")
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    again = docs.where(text.isNotNull()).groupBy(text_key(text).alias("node"), key.alias("class_id")).count().where("count > 1")
    again = materialise(classes.where("node = class_node").join(again.alias("r"), (F.col("class_node") == F.col("r.node")) & F.col("r.class_id").eqNullSafe(classes["class_id"]), "left_semi").select(F.col("node"), F.lit(True).alias("again")), "neardup-again")
    repeated = again.limit(1).count() > 0
    if repeated:
        classes = classes.join(again, "node", "left")
    names = {c: fresh(docs, c)[0] for c in classes.columns}
    found = docs.withColumn(names["node"], text_key(text)).join(classes.select(*[F.col(c).alias(n) for c, n in names.items()]), names["node"], "left")
    alone = F.col(names["class_node"]).isNull()
    found = found.where(alone | ((F.col(names["node"]) == F.col(names["class_node"])) & key.eqNullSafe(F.col(names["class_id"]))))
    own = [F.col(f"`{c}`") for c in docs.columns]
    if not repeated:
        return found.select(*own)
    more = F.coalesce(F.col(names["again"]), F.lit(False))
    return found.where(~more).select(*own).unionAll(found.where(more).dropDuplicates([names["node"]]).select(*own))
