"""Caption and image retrieval. Examples lie in blocks, near ones together, and a task scores one block of either side with one matrix
product. Where only the best pairs count, pairs of blocks that can't hold one are left out by exact bounds.

Scores are rounded to eleven decimals, so that equal vectors tie in whichever block they are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packed as pk
from ..functions.ranking import numbered
from ..functions.scratch import cut
from .timeline import EX

#: Groups of near examples: what every task holds of the other side is a centre and a radius of each.
MOST_GROUPS = 1024
#: Dot products that a task holds at once.
MOST = 4_000_000
#: Numbers of a row of packed vectors (16 MB); a batch has two of them a row.
HELD = 2_000_000
#: Examples of a block: every block meets most others, so what is shuffled falls with their number. Few examples make ``FEW`` blocks a side.
SMALL, LARGE, FEW = 256, 1536, 8
#: Dot products that a step of R2's kernels holds: they fit a core's cache.
STEP = 200_000
#: Rows of a batch that leaves a task.
ROWS = 100_000


def _mean(products: np.ndarray, first: np.ndarray, axis: int) -> np.ndarray:
    sizes = np.diff(first)
    if axis == 0 and (sizes == sizes[0]).all():
        return products.reshape(len(sizes), sizes[0], -1).sum(1) / sizes[0]
    return np.add.reduceat(products, first[:-1], axis) / (sizes[:, None] if axis == 0 else sizes)


def _mean_of_best(x, x_first, y, y_first):
    """The mean over the vectors of each example of ``y`` of the largest dot product with one of each example of ``x``: [y, x]. The largest are
    found vector by vector: a product with the k-th vectors of all examples that have as many."""
    sizes = np.diff(x_first)
    order = np.argsort(-sizes, kind="stable")
    first, falling = x_first[:-1][order], sizes[order]
    kth = [np.ascontiguousarray(x[first[: np.searchsorted(-falling, -k, "left")] + k].T) for k in range(falling[0])]
    out = np.empty((len(y_first) - 1, len(sizes)))
    for lo, hi in pk.groups(np.diff(y_first) * len(sizes), STEP):
        own = y[y_first[lo] : y_first[hi]]
        best = own @ kth[0]
        for each in kth[1:]:
            part = best[:, : each.shape[1]]
            np.maximum(part, own @ each, out=part)
        out[lo:hi] = _mean(best, y_first[lo : hi + 1] - y_first[lo], 0)
    return out if falling[0] == falling[-1] else out[:, np.argsort(order)]


def _sisa(im, im_first, cap, cap_first):
    return _mean(cap, cap_first, 0) @ _mean(im, im_first, 0).T


def _misa(im, im_first, cap, cap_first):
    return _mean_of_best(im, im_first, cap, cap_first)


def _sima(im, im_first, cap, cap_first):
    return _mean_of_best(cap, cap_first, im, im_first).T


def some_at_a_time(kernel: Callable) -> Callable:
    """A kernel that holds all products of its vectors, for some captions at a time."""

    def run(x, x_first, y, y_first):
        out = np.empty((len(y_first) - 1, len(x_first) - 1))
        for lo, hi in pk.groups(np.diff(y_first) * len(x), MOST):
            own = y_first[lo : hi + 1]
            out[lo:hi] = kernel(x, x_first, y[own[0] : own[-1]], own - own[0])
        return out

    return run


def similarity_of(kind: str) -> Callable:
    """R2's kernel: (region vectors, first region of each image, frame vectors, first frame of each caption) -> values[caption, image]."""
    return {"sisa": _sisa, "misa": _misa, "sima": _sima}[kind]


def _scored(kernel: Callable, im: tuple[np.ndarray, np.ndarray], cap: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The kernel's values of two packed blocks."""
    out = kernel(*im, *cap)
    np.round(out, 11, out)
    out += 0.0
    return out


def _half_up(scores: np.ndarray, digits: int) -> np.ndarray:
    """Spark's ``round`` of scores of at most eleven decimals: a half goes away from zero by the number's shortest decimal form. Below 10,000 a
    score's form has no more than fifteen digits and is a whole number of the last decimal; larger ones are rounded one by one."""
    whole = np.abs(scores)
    far = ~(whole < 1e4)
    whole *= 1e11
    np.rint(whole, whole)
    whole += 5 * 10.0 ** (10 - digits)
    whole /= 10.0 ** (11 - digits)
    np.floor(whole, whole)
    whole /= 10.0**digits
    np.copysign(whole, scores, whole)
    if far.any():
        exact, unit = Context(prec=400, rounding=ROUND_HALF_UP), Decimal(1).scaleb(-digits)
        whole[far] = [float(Decimal(repr(v)).quantize(unit, context=exact)) if np.isfinite(v) else v for v in scores[far].tolist()]
    whole += 0.0
    return whole


def _stacked(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(v) for v in column]
    return np.stack([np.asarray(v, float) for vs in column for v in vs]), np.r_[0, np.cumsum(sizes)]


def pack(rows: DataFrame) -> DataFrame:
    """(id, held): one row for each example of ``rows(example_idx, idx, vec)``, its vectors in order."""
    return rows.groupBy(EX).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "vec"))), lambda x: x["vec"]).alias("held")).select(F.col(EX).alias("id"), "held")


def block_of(n: int) -> int:
    """Examples of a block if there are ``n``: as many as make ``FEW`` blocks, within bounds that a task can hold."""
    return max(SMALL, min(LARGE, -(-n // FEW)))


def group(packed: DataFrame, block: int | None = None) -> DataFrame:
    """``packed`` with ``group`` and ``sub``: the nearest of some examples' mean vectors, drawn by a hash, at most ``MOST_GROUPS``; and a
    hash that cuts a group into blocks of about ``block`` examples. Written once."""
    n = packed.count()
    block = block or block_of(n)
    many = min(MOST_GROUPS, max(1, -(-n // block)))
    drawn = packed.orderBy(F.xxhash64("id"), "id").limit(many).select("held").collect()
    pivots = np.array([np.mean([list(v) for v in r.held], 0) for r in drawn]) if drawn else np.zeros((1, 0))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, first = _stacked(b["held"])
                far = (pivots**2).sum(1) - 2 * _mean(x, first, 0) @ pivots.T
                yield b.assign(group=far.argmin(1).astype(np.int32))

    placed = cut(packed.mapInPandas(near, "id long, held array<array<double>>, group int"), "groups")
    subs = placed.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("subs"))
    # Sizes of groups: MOST_GROUPS rows.
    return placed.join(F.broadcast(subs), "group").select("id", "held", "group", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int").alias("sub"))


def _balls(grouped: DataFrame, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, radius, examples) of each group, of all its vectors or with ``whole`` of its examples' mean vectors; a group without
    examples has a radius of -inf."""

    def vectors(held: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        x, first = _stacked(held)
        return (_mean(x, first, 0), np.ones(len(held), int)) if whole else (x, np.diff(first))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            if len(b):
                x, sizes = vectors(b["held"])
                of = np.repeat(b["group"].to_numpy(), sizes)
                for g in np.unique(of):
                    t = total.setdefault(int(g), [0, 0, 0.0])
                    t[0], t[1], t[2] = t[0] + int((b["group"] == g).sum()), t[1] + int((of == g).sum()), t[2] + x[of == g].sum(0)
        yield pd.DataFrame([(g, t[0], t[1], t[2].tolist()) for g, t in total.items()], columns=["group", "n", "m", "total"])

    parts = grouped.select("group", "held").mapInPandas(sums, "group int, n long, m long, total array<double>")
    flat = parts.select("group", "n", "m", F.posexplode("total").alias("dim", "x")).groupBy("group", "dim").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("x").alias("x")).collect()
    groups, dims = max((r.group for r in flat), default=-1) + 1, max((r.dim for r in flat), default=-1) + 1
    centres, n = np.zeros((groups, dims)), np.zeros(groups, int)
    for r in flat:
        centres[r.group, r.dim], n[r.group] = r.x / r.m, r.n

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        far = np.full(groups, -np.inf)
        for b in batches:
            if len(b):
                x, sizes = vectors(b["held"])
                of = np.repeat(b["group"].to_numpy(), sizes)
                np.maximum.at(far, of, np.sqrt(((x - centres[of]) ** 2).sum(1)))
        yield pd.DataFrame({"group": np.flatnonzero(far >= 0), "far": far[far >= 0]})

    radius = np.full(groups, -np.inf)
    for r in grouped.select("group", "held").mapInPandas(reach, "group int, far double").groupBy("group").agg(F.max("far").alias("far")).collect():
        radius[r.group] = r.far
    return centres, radius, n


def _bounds(x: np.ndarray, first: np.ndarray, centres: np.ndarray, radius: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of each example with an example of each group. ``how``: 'whole' for a mean of mean vectors; 'mean' if the
    example's own vectors are averaged over the best of the other's, 'max' if the best of its own is averaged over the other's."""
    if how == "whole":
        x, first = _mean(x, first, 0), np.arange(len(first))
    at, reach = x @ centres.T, np.sqrt((x**2).sum(1))[:, None] * np.maximum(radius, 0)
    slack = 1e-9 * (1 + np.abs(at) + reach)
    low, high = at - reach - slack, at + reach + slack
    if how == "max":
        return np.maximum.reduceat(low, first[:-1], 0), np.maximum.reduceat(high, first[:-1], 0)
    return _mean(low, first, 0), _mean(high, first, 0)


def surviving(a: DataFrame, b: DataFrame, kind: str, keep: int | None = None, own: DataFrame | None = None) -> DataFrame:
    """(_ag, _as, _bg, _bs): pairs of a block of images ``a`` and a block of captions ``b`` (both of ``group``) that may hold one of the
    ``keep`` best of an example of either, or a score that is not below an example's ``own(id, own)``.

    The k-th best score of an example is at least the least score with any group of k examples, and no score passes the group's
    largest: both follow from the group's ball, so no pair that counts is left out."""
    whole = kind == "sisa"
    ways = {"sisa": ("whole", "whole"), "misa": ("max", "mean"), "sima": ("mean", "max")}[kind]

    def kept(side: DataFrame, balls: tuple, how: str) -> DataFrame:
        centres, radius, n = balls
        if own is not None:
            side = side.join(own, "id", "left").where("own IS NOT NULL AND NOT isnan(own)")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in batches:
                if not len(t) or not len(centres):
                    continue
                x, first = _stacked(t["held"])
                for lo, hi in pk.groups(np.diff(first) * len(centres), MOST):
                    part = first[lo : hi + 1]
                    low, high = _bounds(x[part[0] : part[-1]], part - part[0], centres, radius, how)
                    if keep:
                        # Each of a group's n examples scores ``low`` or more; the k-th of all, best groups first, is no lower.
                        order = np.argsort(-low, 1, kind="stable")
                        enough = np.cumsum(n[order], 1) >= keep
                        floor = np.where(enough.any(1), np.take_along_axis(low, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0], -np.inf)
                    else:
                        floor = t["own"].to_numpy(float)[lo:hi] - 1e-9
                    i, g = np.nonzero((high >= floor[:, None]) & (n > 0))
                    found = np.unique(np.stack([t["group"].to_numpy()[lo:hi][i], t["sub"].to_numpy()[lo:hi][i], g], 1), axis=0)
                    yield pd.DataFrame(found, columns=["group", "sub", "other"])

        columns = ["held", "group", "sub"] + (["own"] if own is not None else [])
        return side.select(*columns).mapInPandas(run, "group int, sub int, other int").distinct()

    subs = lambda x, g, s: x.select(F.col("group").alias(g), F.col("sub").alias(s)).distinct()
    for_a = kept(a, _balls(b, whole), ways[0]).select(F.col("group").alias("_ag"), F.col("sub").alias("_as"), F.col("other").alias("_bg")).join(subs(b, "_bg", "_bs"), "_bg")
    for_b = kept(b, _balls(a, whole), ways[1]).select(F.col("group").alias("_bg"), F.col("sub").alias("_bs"), F.col("other").alias("_ag")).join(subs(a, "_ag", "_as"), "_ag")
    return for_a.unionByName(for_b).distinct()


def every_pair(images: DataFrame, captions: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, captions) for a result of all pairs: examples are dealt to blocks by a hash."""

    def dealt(rows: DataFrame) -> DataFrame:
        packed = pack(rows)
        examples = rows.select(EX).distinct().count()
        n = max(1, -(-examples // (block or block_of(examples))))
        return packed.select("id", "held", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("group"), F.lit(0).alias("sub"))

    return dealt(images), dealt(captions)


def blocks_of(side: DataFrame, own: DataFrame | None, name: str) -> DataFrame:
    """(group, sub, ids, sizes, vectors, own): the examples of ``side`` in rows that hold many of one block each, as bytes; at most ``HELD``
    numbers unless one example has more. Written once; the only time that a side is moved."""
    side = side.join(own, "id", "left") if own is not None else side.withColumn("own", F.lit(None).cast("double"))
    ddl = "group int, sub int, ids binary, sizes binary, vectors binary, own binary"
    schema = side.sparkSession.createDataFrame([], ddl).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, load = None, [], 0

        def out() -> pa.RecordBatch:
            cols = [np.concatenate(p).tobytes() for p in zip(*parts, strict=True)]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip([*key, *cols], schema, strict=True)], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            group, sub, ids = (b.column(i).to_numpy() for i in range(3))
            offsets, held = pk.lists(b.column("held"))
            x, sizes, known = pk.matrix(held), np.diff(offsets), np.asarray(b.column("own").to_numpy(zero_copy_only=False), float)
            ends = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (sub[1:] != sub[:-1]), True])
            for first, last in zip(ends, ends[1:]):
                for lo, hi in pk.groups(sizes[first:last] * x.shape[1], HELD):
                    lo, hi = lo + first, hi + first
                    new, more = (int(group[lo]), int(sub[lo])), int(sizes[lo:hi].sum()) * x.shape[1]
                    if parts and (new != key or load + more > HELD):
                        yield out()
                    load = more if not parts else load + more
                    key = new
                    parts.append((ids[lo:hi], sizes[lo:hi], x[offsets[lo] : offsets[hi]].ravel(), known[lo:hi]))
        if parts:
            yield out()

    dealt = side.select("group", "sub", "id", "held", "own").repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group", "sub").sortWithinPartitions("group", "sub", "id")
    return cut(dealt.mapInArrow(run, ddl), name)


def _unpacked(ids: pa.Scalar, sizes: pa.Scalar, vectors: pa.Scalar, own: pa.Scalar) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(ids, (vectors, first vector of each example), own values) of a row of ``blocks_of``."""
    read = lambda v, kind: np.frombuffer(v.as_buffer(), kind)
    first = np.r_[0, np.cumsum(read(sizes, np.int64))]
    return read(ids, np.int64), (read(vectors, float).reshape(first[-1], -1), first), read(own, float)


def in_blocks(a: DataFrame, b: DataFrame, pairs: DataFrame | None, kernel: Callable, found: Callable, schema: str, own: DataFrame | None = None) -> DataFrame:
    """What ``found(caption ids, image ids, values[caption, image], captions' own values, images' own values)`` yields of the ``pairs`` of blocks of
    images ``a`` and captions ``b`` (all without ``pairs``), rows of ``schema``. ``own(id, own)`` has a value for each example, NaN without it.

    Both sides are written in blocks, and every task reads some of either from there: a Cartesian product, which copies nothing through
    a shuffle. A row is scored alone, so a block may be in several."""
    columns = ["ids", "sizes", "vectors", "own"]
    named = lambda x, p, g, s: x.select(F.col("group").alias(g), F.col("sub").alias(s), *[F.col(c).alias(p + c) for c in columns])
    left, right = named(blocks_of(a, own, "image-blocks"), "x_", "_ag", "_as"), named(blocks_of(b, own, "caption-blocks"), "y_", "_bg", "_bs")
    met = F.lit(True)
    if pairs is not None:
        others = cut(pairs, "block-pairs").groupBy("_ag", "_as").agg(F.collect_list(F.struct("_bg", "_bs")).alias("_met"))
        left = cut(left.join(others, ["_ag", "_as"]), "image-blocks")
        met = F.array_contains("_met", F.struct("_bg", "_bs"))
    both = left.hint("shuffle_replicate_nl").join(right, met).select(*["x_" + c for c in columns], *["y_" + c for c in columns])
    result = a.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for row in zip(*t.columns, strict=True):
                (cols, im, col_own), (rows, cap, row_own) = _unpacked(*row[:4]), _unpacked(*row[4:])
                for got in found(rows, cols, _scored(kernel, im, cap), row_own, col_own):
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in result], schema=result)

    return both.mapInArrow(run, schema)


def own_scores(images: DataFrame, captions: DataFrame, kernel: Callable) -> DataFrame:
    """(id, own): the score of every example's caption with its own image."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            scores = [_scored(kernel, _stacked(pd.Series([im])), _stacked(pd.Series([cap])))[0, 0] for im, cap in zip(t["held"], t["cap"], strict=True)]
            yield pd.DataFrame({"id": t["id"], "own": np.array(scores, float)})

    return cut(pack(images).join(pack(captions).withColumnRenamed("held", "cap"), "id").mapInPandas(run, "id long, own double"), "own-scores")


def _sides(images: DataFrame, captions: DataFrame, block: int | None) -> tuple[DataFrame, DataFrame]:
    return group(pack(images), block), group(pack(captions), block)


def score_blocks(images: DataFrame, captions: DataFrame, kernel: Callable, block: int | None = None, digits: int | None = None) -> DataFrame:
    """(row, col, value): the kernel's value of every caption (row) and image (col), ``example_idx, idx, vec`` each; with ``digits`` (ten at
    most) rounded as by Spark's ``round``, which makes a decimal of every value and takes longer than the score."""

    def found(rows, cols, values, *_):
        for lo, hi in pk.groups(np.full(len(rows), len(cols)), ROWS):
            part = np.ascontiguousarray(values[lo:hi])
            part = part if digits is None else _half_up(part, digits)
            yield {"row": np.repeat(rows[lo:hi], len(cols)), "col": np.tile(cols, hi - lo), "value": part.ravel()}

    return in_blocks(*every_pair(images, captions, block), None, kernel, found, "row long, col long, value double")


def match_similarity(images: DataFrame, captions: DataFrame, kind: str = "sisa", block: int | None = None, digits: int | None = None) -> DataFrame:
    """R2: mean of the dot products (sisa), max over regions then mean over frames (misa), max over frames then mean over regions
    (sima), over the true numbers of regions and frames; with ``digits`` rounded."""
    return score_blocks(images, captions, similarity_of(kind), block, digits)


def score_pairs(tokens: DataFrame, q: DataFrame, table: DataFrame, floor: float = 1e-30, score: str = "max") -> DataFrame:
    """(row, col, value): log likelihood of caption ``row``'s tokens (example_idx, t, w) for image ``col``'s regions (example_idx, idx, k, q)
    under ``table(w, k, p)``: the sum over regions of log max (or mean) over positions of sum over k of P(w_t, k) q(j, k)."""
    rows = matrix_rows(table)
    images = q.groupBy(EX, "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("vec"))
    caps = tokens.select(EX, F.col("t").alias("idx"), F.array(F.col("w").cast("double")).alias("vec"))

    def likelihood(im, im_first, cap, cap_first):
        a = rows[cap[:, 0].astype(int)] @ im.T
        each = np.maximum.reduceat(a, cap_first[:-1], 0) if score == "max" else _mean(a, cap_first, 0)
        return np.add.reduceat(np.log(np.maximum(each, floor)), im_first[:-1], 1)

    return score_blocks(images, caps, some_at_a_time(likelihood))


def matrix_rows(table: DataFrame) -> np.ndarray:
    """The small table (w, k, p) as an array."""
    rows = table.select("w", "k", "p").collect()
    out = np.zeros((max(r.w for r in rows) + 1, max(r.k for r in rows) + 1))
    for r in rows:
        out[r.w, r.k] = r.p
    return out


def best_in_blocks(images: DataFrame, captions: DataFrame, kind: str, k: int, block: int | None = None) -> DataFrame:
    """R3 from the vectors: (side, query, hit, rank) of ``top_k``. Only pairs of blocks that may hold one of the ``k`` best are scored, and of
    each only the best ``k`` of a caption and of an image leave the task."""

    def found(rows, cols, values, *_):
        parts = []
        for side, ids, others, v in (("row", rows, cols, values), ("col", cols, rows, values.T)):
            best = np.argsort(-v, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go by id
            parts.append((np.full(best.size, side), np.repeat(ids, best.shape[1]), others[best].ravel(), np.take_along_axis(v, best, 1).ravel()))
        yield dict(zip(("side", "query", "hit", "value"), map(np.concatenate, zip(*parts, strict=True)), strict=True))

    a, b = _sides(images, captions, block)
    rows = in_blocks(a, b, surviving(a, b, kind, keep=k), similarity_of(kind), found, "side string, query long, hit long, value double")
    w = Window.partitionBy("side", "query").orderBy(F.desc("value"), "hit")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("side", "query", "hit", "rank")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(side, query, hit, rank): the ``k`` best columns of every row and rows of every column, ties by id."""
    a = scores.select(F.lit("row").alias("side"), F.col("row").alias("query"), F.col("col").alias("hit"), "value")
    b = scores.select(F.lit("col").alias("side"), F.col("col").alias("query"), F.col("row").alias("hit"), "value")
    w = Window.partitionBy("side", "query").orderBy(F.desc("value"), "hit")
    return a.union(b).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("side", "query", "hit", "rank")


def _above(values: np.ndarray, own: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of each row the values above its own, and equal ones that stand before it."""
    return ((values > own[:, None]) | ((values == own[:, None]) & before)).sum(1)


def recall_of_ranks(ranks: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(side, k, recall) of (side, id, above)."""
    rank = ranks.groupBy("side", "id").agg((F.sum("above") + 1).alias("rank"))
    return rank.select("side", F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank").groupBy("side", "k").agg(F.avg((F.col("rank") <= F.col("k")).cast("double")).alias("recall"))


def recall_at_k(scores: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(side, k, recall): share of queries whose own item is among the ``k`` best of a table of scores. Only the scores above the
    own one are counted; nothing is sorted. Ties before it in id order count as above."""
    own = scores.where("row = col").select(F.col("row").alias("_id"), F.col("value").alias("_v"))
    ranks = None
    for side, other in (("row", "col"), ("col", "row")):
        above = (F.col("value") > F.col("_v")) | ((F.col("value") == F.col("_v")) & (F.col(other) < F.col(side)))
        one = scores.join(own, F.col(side) == F.col("_id")).select(F.lit(side).alias("side"), F.col(side).alias("id"), above.cast("int").alias("above"))
        ranks = one if ranks is None else ranks.union(one)
    return recall_of_ranks(ranks, ks)


def recall_in_blocks(images: DataFrame, captions: DataFrame, kind: str = "sisa", ks: tuple[int, ...] = (1, 5, 10), block: int | None = None) -> DataFrame:
    """R4 from the vectors: pairs of blocks in which no score can reach an example's own are left out, the others are counted where
    they are scored, and only counts leave the task. Examples without the other side have no rank."""
    kernel = similarity_of(kind)

    def found(rows, cols, values, own_rows, own_cols):
        values = np.where(rows[:, None] == cols[None], -np.inf, values)  # the own one is not above itself
        sides = [("row", rows, _above(values, own_rows, cols[None, :] < rows[:, None]), own_rows), ("col", cols, _above(values.T, own_cols, rows[None, :] < cols[:, None]), own_cols)]
        known = [(side, ids[~np.isnan(own)], n[~np.isnan(own)]) for side, ids, n, own in sides]
        yield {"side": np.repeat([x[0] for x in known], [len(x[1]) for x in known]), "id": np.concatenate([x[1] for x in known]), "above": np.concatenate([x[2] for x in known])}

    own = own_scores(images, captions, kernel)
    a, b = _sides(images, captions, block)
    counted = in_blocks(a, b, surviving(a, b, kind, own=own), kernel, found, "side string, id long, above long", own)
    none = own.select(F.explode(F.array(F.lit("row"), F.lit("col"))).alias("side"), "id", F.lit(0).cast("long").alias("above"))  # an example may be in no pair
    return recall_of_ranks(counted.unionByName(none), ks)


def align_matchmap(images: DataFrame, captions: DataFrame, ratio: int, lengths: DataFrame) -> DataFrame:
    """(example_idx, t, region): the best region of each pooled frame of the example's own caption, repeated ``ratio`` times and cut
    to ``lengths(example_idx, n)``."""
    pack = lambda df, name: df.groupBy(EX).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "vec"))), lambda x: x["vec"]).alias(name))
    both = pack(images, "im").join(pack(captions, "cap"), EX)

    def run(batches):
        for b in batches:
            rows = []
            for ex, im, cap in zip(b[EX], b["im"], b["cap"], strict=True):
                m = np.stack([np.asarray(v) for v in im]) @ np.stack([np.asarray(v) for v in cap]).T
                rows += [(ex, f, int(r)) for f, r in enumerate(m.argmax(0))]
            yield pd.DataFrame(rows, columns=[EX, "f", "region"])

    best = both.mapInPandas(run, f"{EX} long, f int, region int")
    wide = best.select(EX, F.explode(F.sequence(F.col("f") * ratio, F.col("f") * ratio + ratio - 1)).alias("t"), "region")
    return wide.join(lengths, EX).where("t < n").select(EX, "t", "region")


def impostors(ids: DataFrame, seed: int) -> DataFrame:
    """(id, caption, image): for each id another one as caption and another one as image, by its neighbour in two hash orders of all ids. A
    single id has none."""
    out = ids
    for i, name in enumerate(("caption", "image")):
        line = cut(numbered(ids.select("id", F.xxhash64("id", F.lit(seed + i)).alias("h")), "h", "id"), "impostors")
        n = line.count()
        after = line.select(((F.col("idx") + n - 1) % max(n, 1)).alias("idx"), F.col("id").alias(name))
        out = out.join(line.select("id", "idx").join(after, "idx").drop("idx"), "id")
    return out.where("caption <> id AND image <> id")


def margin_loss(images: DataFrame, captions: DataFrame, kind: str, margin: float, seed: int) -> DataFrame:
    """Mean over items of max(0, m + s(imp, a) - s_ii) + max(0, m + s(i, imp) - s_ii), the impostors picked by hash, never the item. Only the
    item's own pair and the two with its impostors are scored, in one row of three."""
    kernel = similarity_of(kind)
    im, cap = pack(images), pack(captions)
    both = im.select("id", F.col("held").alias("im")).join(cap.select("id", F.col("held").alias("cap")), "id")
    both = cut(both, "margin-items")
    picked = impostors(both.select("id"), seed)
    other = both.join(picked, "id")
    other = other.join(both.select(F.col("id").alias("caption"), F.col("cap").alias("cap2")), "caption").join(both.select(F.col("id").alias("image"), F.col("im").alias("im2")), "image")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for a, b, b2, a2 in zip(t["im"], t["cap"], t["cap2"], t["im2"], strict=True):
                v = _scored(kernel, _stacked(pd.Series([a, a2])), _stacked(pd.Series([b, b2])))
                rows.append(max(0.0, margin + v[1, 0] - v[0, 0]) + max(0.0, margin + v[0, 1] - v[0, 0]))
            yield pd.DataFrame({"loss": np.array(rows, float)})

    return other.select("im", "cap", "cap2", "im2").mapInPandas(run, "loss double").agg(F.avg("loss").alias("loss"))


def softmax_loss(scores: DataFrame) -> DataFrame:
    """-(1/n) sum over i of log softmax over the row plus log softmax over the column, at the diagonal."""
    def lse(side: str) -> DataFrame:
        w = Window.partitionBy(side)
        top = scores.withColumn("_m", F.max("value").over(w))
        return top.groupBy(F.col(side).alias("_id"), "_m").agg((F.col("_m") + F.log(F.sum(F.exp(F.col("value") - F.col("_m"))))).alias(f"z_{side}")).drop("_m")

    own = scores.where("row = col").select(F.col("row").alias("_id"), "value").join(lse("row"), "_id").join(lse("col"), "_id")
    return own.agg((-F.avg(2 * F.col("value") - F.col("z_row") - F.col("z_col"))).alias("loss"))


def softmax_loss_in_blocks(images: DataFrame, captions: DataFrame, kind: str = "sisa", block: int | None = None) -> DataFrame:
    """R6 from the vectors: each block gives the largest value and the sum of exponentials below it of its rows and columns."""
    kernel = similarity_of(kind)

    def found(rows, cols, values, *_):
        top = [values.max(1), values.max(0)]
        sums = [np.exp(values - top[0][:, None]).sum(1), np.exp(values - top[1][None]).sum(0)]
        yield {"side": np.repeat(["row", "col"], [len(rows), len(cols)]), "id": np.concatenate([rows, cols]), "top": np.concatenate(top), "total": np.concatenate(sums)}

    own = own_scores(images, captions, kernel)
    parts = in_blocks(*every_pair(images, captions, block), None, kernel, found, "side string, id long, top double, total double")
    w = Window.partitionBy("side", "id")
    whole = parts.withColumn("_m", F.max("top").over(w)).groupBy("side", "id", "_m").agg(F.sum(F.col("total") * F.exp(F.col("top") - F.col("_m"))).alias("t"))
    each = whole.groupBy("id").agg(F.sum(F.col("_m") + F.log("t")).alias("z")).join(own, "id")
    return each.agg((-F.avg(2 * F.col("own") - F.col("z"))).alias("loss"))
