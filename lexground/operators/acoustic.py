"""Word segmentation of acoustic slices. An example is one row, packed, in a bucket that it never leaves; a round is one pass
over the rows, against parameters that go to the tasks as arrays, and what it shuffles are sums of components.

All examples draw in parallel against the last round's counts less their own: an approximate, distributed Gibbs sampler.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as kn
from ..functions import packed as pk
from ..functions.scratch import bucketed, cut
from ..functions.statistics import vector_sums
from .models import EX, component_prior_of, mixture_round, stats_arrays

#: Log densities that a task holds at once.
MOST = 2_000_000
#: Numbers of an array while an example's own vectors are taken out, which needs about ten such arrays.
OWN = 500_000


def _schema(spark, ddl: str) -> pa.Schema:
    return spark.createDataFrame([], ddl).toArrow().schema


def _less_own(d: np.ndarray, x: np.ndarray, of: np.ndarray, held: np.ndarray, k: np.ndarray, vec: np.ndarray, n: np.ndarray, total: np.ndarray, mu0: np.ndarray, var: float, var0: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Take the vectors ``vec`` that example ``held`` has in component ``k`` out of what all rows of that example see: ``d``, the log densities
    of rows ``x`` of example ``of`` (in order), is changed in place. Returns (example, component, number) of what was taken out."""
    pairs, at = np.unique(np.stack([held, k], 1), axis=0, return_inverse=True)
    count, sums = np.bincount(at.ravel(), minlength=len(pairs)), np.zeros((len(pairs), x.shape[1]))
    np.add.at(sums, at.ravel(), vec)
    lo, hi = np.searchsorted(of, pairs[:, 0], "left"), np.searchsorted(of, pairs[:, 0], "right")
    which = np.repeat(np.arange(len(pairs)), hi - lo)
    rows = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange((hi - lo).sum()) if len(pairs) else which
    step = max(1, OWN // x.shape[1]) if x.size else 1
    for a in range(0, len(rows), step):
        r, w = rows[a : a + step], which[a : a + step]
        d[r, pairs[w, 1]] = kn.own_removed(x, r, pairs[w, 1], count[w], sums[w], n, total, mu0, var, var0)
    return pairs[:, 0], pairs[:, 1], count


def _drawn(logits: np.ndarray, temp: float | None, keys: list[int]) -> np.ndarray:
    if temp is None or not len(logits):
        return logits.argmax(1) if len(logits) else np.zeros(0, int)
    w = np.exp((logits - logits.max(1, keepdims=True)) / temp).cumsum(1)
    u = np.array([kn.uniforms(k, 1)[0] for k in keys])
    return np.minimum((w < (u * w[:, -1])[:, None]).sum(1), logits.shape[1] - 1)


def _key(ex: int, place: int, seed: int) -> int:
    return (ex * 1_000_003 + place) ^ seed * 0x9E3779B97F4A7C15


def _cut_keys(ids: list[int], seed: int) -> list[int]:
    return [(ex + 1) * 0x9E3779B97F4A7C15 ^ seed for ex in ids]


def pack_candidates(candidates: DataFrame, seed: int, comps: int) -> DataFrame:
    """(example_idx, cand): an example's candidates by end and start, each with the component that round one deals it by a hash."""
    place = (F.col("end") * (F.col("end") - 1) / 2 + F.col("start")).cast("int")
    one = F.struct(F.col("end").cast("int").alias("end"), F.col("start").cast("int").alias("start"), F.col("dur").cast("double").alias("dur"), place.alias("place"), F.pmod(F.xxhash64(EX, place, F.lit(seed)), F.lit(comps)).cast("int").alias("deal"), F.col("vec").cast("array<double>").alias("vec"))
    return candidates.groupBy(EX).agg(F.sort_array(F.collect_list(one)).alias("cand"))


def acoustic_round(held: DataFrame, n: np.ndarray, total: np.ndarray, mu0: np.ndarray, var: float, var0: float, alpha: float, power: float, length_term: str, temp: float | None, penalty: float, scale: bool, seed: int, first: bool) -> DataFrame:
    """One round over ``held(example_idx, cand, at, k, prior)``: (example_idx, at ARRAY, k ARRAY), the chosen candidates and their components.
    ``at`` and ``k`` are those of the round before, which were counted in ``n`` and ``total``, and are taken out for the example itself."""
    shared = held.sparkSession.sparkContext.broadcast((n, total))
    comps, ddl = len(n), f"{EX} long, at array<int>, k array<int>"
    schema = _schema(held.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = shared.value
        mean, prec = kn.component_posterior(n, total, mu0, var, var0)
        for whole in batches:
            for lo, hi in pk.groups(np.diff(pk.lists(whole.column("cand"))[0]) * max(comps, len(mu0)), MOST):
                batch = whole.slice(lo, hi - lo)
                offsets, cand = pk.lists(batch.column("cand"))
                end, start, dur, place, deal = (np.asarray(cand.field(i)) for i in range(5))
                x, of, ids = pk.matrix(cand.field(5)), np.repeat(np.arange(hi - lo), np.diff(offsets)), batch.column(EX).to_pylist()
                d = kn.log_densities(x, mean, prec)
                was, at = pk.lists(batch.column("at"))
                mine = np.repeat(np.arange(hi - lo), np.diff(was))
                at, k = np.asarray(at, int) + offsets[mine], np.asarray(pk.lists(batch.column("k"))[1], int)
                e, c, own = _less_own(d, x, of, mine, k, x[at], n, total, mu0, var, var0)
                counts = np.tile(n, (hi - lo, 1))
                np.subtract.at(counts, (e, c), own)
                prior = np.log(alpha / comps + counts) - np.log(counts.sum(1, keepdims=True) + alpha)
                given, values = pk.lists(batch.column("prior"))
                prior[np.diff(given) > 0] = np.asarray(values, float).reshape(-1, comps)
                logits = d + prior[of]
                marginal = kn.log_sum_exp(logits - kn.log_sum_exp(d)[:, None]) if scale else kn.log_sum_exp(logits)
                size = end - start
                score = marginal * dur**power if length_term == "duration" else marginal - np.array([math.lgamma(s + 1) for s in range(int(size.max(initial=0)) + 1)])[size] - 1
                top = np.r_[0, np.cumsum(np.maximum.reduceat(end, offsets[:-1]) + 1)]
                band = pk.bands(top, of, start, end, score + penalty)
                rows = pk.viterbi(band, top) if temp is None else pk.sample(band, top, temp, _cut_keys(ids, seed))
                cut_of, cut_start, cut_end = pk.ends_of(rows, top)
                spot = {(a, b, c): i for i, (a, b, c) in enumerate(zip(of.tolist(), start.tolist(), end.tolist(), strict=True))}
                chosen = np.array([spot.get(s, -1) for s in zip(cut_of.tolist(), cut_start.tolist(), cut_end.tolist(), strict=True)], int)
                chosen = chosen[chosen >= 0]  # where no segmentation is possible, a span of one may be no candidate
                k = deal[chosen] if first else _drawn(logits[chosen], temp, [_key(ids[of[i]], int(place[i]), seed) for i in chosen])
                sizes = np.r_[0, np.cumsum(np.bincount(of[chosen], minlength=hi - lo))].astype(np.int32)
                lists = [pa.ListArray.from_arrays(sizes, pa.array(v, pa.int32())) for v in (chosen - offsets[of[chosen]], k)]
                yield pa.RecordBatch.from_arrays([batch.column(EX).cast(pa.int64()), *lists], schema=schema)

    return held.mapInArrow(run, ddl)


def _chosen(both: DataFrame) -> DataFrame:
    """(example_idx, start, end, k, vec) of the chosen candidates."""
    picked = both.select(EX, F.col("cand"), F.explode(F.arrays_zip("at", "k")).alias("x"))
    one = F.get("cand", F.col("x.at"))
    return picked.select(EX, one["start"].alias("start"), one["end"].alias("end"), F.col("x.k").alias("k"), one["vec"].alias("vec"))


def segment_acoustic(candidates: DataFrame, comps: int, mu0: np.ndarray, var: float, var0: float, alpha: float, rounds: int, seed: int, power: float = 1.0, length_term: str = "duration", temp: float | None = None, penalty: float = 0.0, images: DataFrame | None = None, scale_from: int = 200) -> DataFrame:
    """M27, flat words: (example_idx, start, end, k) of ``candidates(example_idx, start, end, dur, vec)`` after ``rounds`` of: log-marginals of
    all candidates, given the counts less the example's own, a segmentation of every example, new assignments, new counts.

    A candidate's score is its log-marginal times dur**power plus ``penalty``; ``length_term='poisson'`` adds -lgamma(L + 1) - 1 for its L
    landmarks instead of the power. Vectors of ``scale_from`` dimensions or more are normalised over the components. Segmentations are
    the best ones, or drawn with ``temp``. With ``images(example_idx, idx, post ARRAY)`` every round ends with a
    realignment, and the next takes each example's own component prior from it.

    Candidates, segmentations and priors lie in the same buckets of examples: after they are packed, no round moves them.
    """
    held = bucketed(pack_candidates(candidates, seed, comps), EX, "acoustic")
    none = F.array().cast("array<int>")
    state = bucketed(held.select(EX, none.alias("at"), none.alias("k")), EX, "acoustic-start")
    posts = None if images is None else bucketed(images.groupBy(EX).agg(F.sort_array(F.collect_list(F.struct("idx", "post"))).alias("posts")), EX, "acoustic-images")
    n, total, prior = np.zeros(comps), np.zeros((comps, len(mu0))), None
    for r in range(rounds):
        both = held.join(state, EX)
        both = both.withColumn("prior", F.lit(None).cast("array<double>")) if prior is None else both.join(prior, EX, "left")
        done = acoustic_round(both, n, total, mu0, var, var0, alpha, power, length_term, temp, penalty, len(mu0) >= scale_from, seed + r, r == 0)
        state = bucketed(done, EX, f"acoustic-state-{r}")
        found = _chosen(held.join(state, EX))
        n, total = stats_arrays(vector_sums(found.select("k", "vec")), comps, len(mu0))
        if posts is not None:
            prior = bucketed(component_prior(state, posts, comps, alpha), EX, f"acoustic-prior-{r}")
    return _chosen(held.join(state, EX)).drop("vec")


def component_prior(state: DataFrame, posts: DataFrame, comps: int, alpha: float = 1.0, inner: int = 3, floor: float = 1e-30) -> DataFrame:
    """M27, the realign step: (example_idx, prior ARRAY), log p(component given the example's image).

    The components of ``state(example_idx, k ARRAY)`` in order are target words for the concepts of ``posts(example_idx, posts)``: ``inner``
    rounds of M11 from a uniform table, then M31 with p(component given concept) by the components' counts."""
    im = F.flatten(F.transform("posts", lambda x: F.transform(x["post"], lambda p, k: F.struct(x["idx"].alias("j"), k.alias("k"), p.alias("q")))))
    cap = F.transform("k", lambda w, t: F.struct(t.alias("t"), w.alias("w")))
    packed = state.where(F.size("k") > 0).select(EX, cap.alias("cap")).join(posts.select(EX, im.alias("im")), EX)
    ks = posts.agg(F.max(F.size(F.get("posts", F.lit(0))["post"]))).first()[0] or 1
    spark = state.sparkSession
    table = spark.range(comps).select(F.col("id").cast("int").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(ks - 1))).alias("k"), F.lit(1 / ks).alias("p"))
    for i in range(inner):
        table = cut(mixture_round(None, None, table, alpha, ks, packed)[0], f"realign-{i}")
    p, counts = np.zeros((comps, ks)), np.zeros(comps)
    for row in table.collect():
        p[row.w, row.k] = row.p
    for row in state.select(F.explode("k").alias("k")).groupBy("k").count().collect():
        counts[row.k] = row["count"]
    return component_prior_of(posts, p, counts + alpha / comps, floor)


# Hierarchical words: a word is a sequence of units, one for each slice; a segment is spelled by the units of its slices.


def pack_slices(slices: DataFrame, units: int, seed: int) -> DataFrame:
    """(example_idx, vecs, units): an example's slices in order, each with the unit that it starts in: ``unit``, or one dealt by a hash."""
    start = F.col("unit") if "unit" in slices.columns else F.pmod(F.xxhash64(EX, "idx", F.lit(seed)), F.lit(units))
    one = F.struct("idx", F.col("vec").cast("array<double>").alias("vec"), start.cast("int").alias("unit"))
    rows = slices.groupBy(EX).agg(F.sort_array(F.collect_list(one)).alias("x"))
    return rows.select(EX, F.transform("x", lambda x: x["vec"]).alias("vecs"), F.transform("x", lambda x: x["unit"]).alias("units"))


def word_scores(ld: np.ndarray, words: np.ndarray, prior: np.ndarray, p: float, floor: float = 1e-30) -> tuple[np.ndarray, np.ndarray]:
    """(log-marginal[S], logits[S, W + 1]) of S segments of L slices: ``ld[S, L, M]`` log densities of their slices under the units,
    ``words[W, L]`` the words of that length, ``prior[S, W]`` their log priors.

    A word's likelihood is the mean of its units' densities; all other spellings share what the mean of the slices' marginals leaves, with
    the length prior p (1 - p)^(L - 1) / M^L. Likelihoods are normalised over the words and the rest."""
    length, m = ld.shape[1:]
    rest = kn.log_sum_exp(ld).mean(1)
    active = sum(ld[:, t][:, words[:, t]] for t in range(length)) / length if len(words) else np.zeros((len(ld), 0))
    if len(words):
        rest = rest + np.log(np.maximum(-np.expm1(np.minimum(kn.log_sum_exp(active) - rest, 0.0)), floor))
    lik = np.concatenate([active, rest[:, None]], 1)
    lik -= kn.log_sum_exp(lik)[:, None]
    new = math.log(p) + (length - 1) * math.log(1 - p) - length * math.log(m)
    logits = lik + np.concatenate([prior, np.full((len(ld), 1), new)], 1)
    return kn.log_sum_exp(logits), logits


def _by_length(words: dict[tuple, int]) -> dict[int, tuple[list[tuple], np.ndarray, np.ndarray]]:
    """For each length the words in order, their units and their counts."""
    out: dict[int, list] = {}
    for w in sorted(words):
        out.setdefault(len(w), []).append(w)
    return {size: (ws, np.array(ws, int), np.array([words[w] for w in ws], float)) for size, ws in out.items()}


def _spelled(units) -> str:
    return ",".join(map(str, units))


_STATE = f"{EX} long, units array<int>, ends array<int>, words array<string>, others array<string>"


def word_round(held: DataFrame, words: dict[tuple, int], n: np.ndarray, total: np.ndarray, mu0: np.ndarray, var: float, var0: float, alpha: float, limit: int, most: int, p: float, temp: float | None, penalty: float, seed: int) -> DataFrame:
    """One round over ``held(example_idx, vecs, units, words, prior)``: units and words are those that the last round counted, and are
    taken out for the example itself; ``prior`` (or null) maps words to their log prior given the image. The result has
    the segments' ``ends``, their ``words``, and in ``others`` the best word of the table for each (or null), in case a new word isn't admitted."""
    spark = held.sparkSession
    shared, full = spark.sparkContext.broadcast((words, n, total)), len(words) >= limit
    schema = _schema(spark, _STATE)

    def one(ld: np.ndarray, ends_to: int, tables: dict, size: float, own: Counter, prior: dict | None, ex: int) -> tuple[list[int], list[str], list[str | None]]:
        longest = min(most, ends_to)
        band, kept = np.full((ends_to + 1, longest + 1), -np.inf), {}
        for length in range(1, longest + 1):
            spans = np.lib.stride_tricks.sliding_window_view(ld, length, 0).transpose(0, 2, 1)
            names, spelled, counts = tables.get(length, ([], np.zeros((0, length), int), np.zeros(0)))
            if prior is None:
                mine = counts - np.array([own.get(w, 0) for w in names])
                lp = np.log(alpha / limit + mine) - math.log(size - own.total() + alpha)
                lp[mine <= 0] = -np.inf  # a word that only this example has is gone with it
            else:
                lp = np.array([prior.get(_spelled(w), -np.inf) for w in names])
            live = np.flatnonzero(np.isfinite(lp))
            names, spelled, lp = [names[i] for i in live], spelled[live], lp[live]
            marginal, logits = word_scores(spans, spelled, np.broadcast_to(lp, (len(spans), len(lp))), p)
            band[np.arange(length, ends_to + 1), length] = marginal + penalty
            kept[length] = names, logits
        first = np.array([0, ends_to + 1])
        rows = pk.viterbi(band, first) if temp is None else pk.sample(band, first, temp, _cut_keys([ex], seed))
        ends, chosen, others, at = rows.tolist(), [], [], 0
        for e in ends:
            names, logits = kept[e - at]
            row, spelling = logits[at], _spelled(ld[at:e].argmax(1))
            best = _spelled(names[int(row[:-1].argmax())]) if names else None
            if temp is not None:
                k = int(_drawn(row[None], temp, [_key(ex, e, seed)])[0])
                word = _spelled(names[k]) if k < len(names) else best if full and best else spelling
            else:  # the best existing word once the table is full, else the spelling
                word = best if full and best else spelling
            chosen.append(word)
            others.append(best)
            at = e
        return ends, chosen, others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, total = shared.value
        tables, size = _by_length(words), float(sum(words.values()))
        mean, prec = kn.component_posterior(n, total, mu0, var, var0)
        for whole in batches:
            for lo, hi in pk.groups(np.diff(pk.lists(whole.column("vecs"))[0]) * max(len(n), len(mu0)), MOST):
                batch = whole.slice(lo, hi - lo)
                offsets, vecs = pk.lists(batch.column("vecs"))
                x, of = pk.matrix(vecs), np.repeat(np.arange(hi - lo), np.diff(offsets))
                units = np.asarray(pk.lists(batch.column("units"))[1], int)
                d = kn.log_densities(x, mean, prec)
                _less_own(d, x, of, of, units, x, n, total, mu0, var, var0)
                out = []
                for i, (ex, mine, prior) in enumerate(zip(*[batch.column(c).to_pylist() for c in (EX, "words", "prior")], strict=True)):
                    ld = d[offsets[i] : offsets[i + 1]]
                    own = Counter(tuple(map(int, w.split(","))) for w in mine or [])
                    ends, chosen, others = one(ld, len(ld), tables, size, own, None if prior is None else dict(prior), ex)
                    out.append({EX: ex, "units": [int(u) for w in chosen for u in w.split(",")], "ends": ends, "words": chosen, "others": others})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return held.mapInArrow(run, _STATE)


def admit(drawn: DataFrame, words: dict[tuple, int], limit: int) -> dict[tuple, int]:
    """The words that may be in the table after a round: those before, then the most frequent new ones up to ``limit`` (ties by spelling).
    A length that has no word yet gets its most frequent one even so, as no segment of that length could be named otherwise."""
    counts = drawn.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = drawn.sparkSession.createDataFrame([(_spelled(w),) for w in words], "word string") if words else None
    new = counts if known is None else counts.join(F.broadcast(known), "word", "left_anti")
    order = [F.desc("n"), "word"]
    size = F.size(F.split("word", ","))
    # No more than the limit comes to the driver, and one word a length.
    taken = {tuple(map(int, r.word.split(","))) for r in new.orderBy(*order).limit(max(limit - len(words), 0)).collect()}
    lengths = {len(w) for w in words} | {len(w) for w in taken}
    firsts = new.groupBy(size.alias("size")).agg(F.min_by("word", F.struct(-F.col("n"), F.col("word"))).alias("word")).collect()
    return {w: 0 for w in [*words, *taken, *(tuple(map(int, r.word.split(","))) for r in firsts if r["size"] not in lengths)]}


def settle(held: DataFrame, admitted: dict[tuple, int], n: np.ndarray, total: np.ndarray, mu0: np.ndarray, var: float, var0: float) -> DataFrame:
    """``word_round``'s result over ``held(example_idx, vecs, ends, words, others)`` with only admitted words: another one gives way to the best
    word that the table had, or if it had none of that length, to the admitted one of the highest mean density."""
    shared = held.sparkSession.sparkContext.broadcast((_by_length(admitted), n, total))
    ddl = f"{EX} long, units array<int>, ends array<int>, words array<string>"
    schema = _schema(held.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n, total = shared.value
        names = {_spelled(w) for ws, _, _ in tables.values() for w in ws}
        mean, prec = kn.component_posterior(n, total, mu0, var, var0)
        for batch in batches:
            out = []
            for i, (ex, ends, words, others) in enumerate(zip(*[batch.column(c).to_pylist() for c in (EX, "ends", "words", "others")], strict=True)):
                for j, word in enumerate(words):
                    if word in names:
                        continue
                    words[j], at = others[j], ends[j - 1] if j else 0
                    if words[j] is None:
                        x = pk.matrix(batch.column("vecs").slice(i, 1).flatten())[at : ends[j]]
                        ld, (ws, spelled, _) = kn.log_densities(x, mean, prec), tables[ends[j] - at]
                        words[j] = _spelled(ws[int(ld[np.arange(len(x)), spelled].mean(1).argmax())])
                out.append({EX: ex, "units": [int(u) for w in words for u in w.split(",")], "ends": ends, "words": words})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return held.mapInArrow(run, ddl)


def segment_words(slices: DataFrame, units: int, limit: int, mu0: np.ndarray, var: float, var0: float, alpha: float, rounds: int, seed: int, most: int = 6, p: float = 0.5, temp: float | None = None, penalty: float = 0.0, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """M27, hierarchical words: (segments (example_idx, start, end, word), words (word, n), log p of the slices given their units after each
    round) of ``slices(example_idx, idx, vec[, unit])``.

    A word spells one unit for each of its slices; units are Gaussian components. In a round every example is segmented and its
    segments are named in parallel, against the last round's units and words less its own: all spans of up to ``most`` slices are scored
    by ``word_scores``, a segmentation is found (the best, or drawn with ``temp``), and each segment takes a word of the
    table or a new spelling, of its slices' best units. New words enter the table by frequency up to ``limit``; beyond, a segment
    takes the best word there is of its length (one word a length may pass the limit). Words that no segment has leave the table.
    With ``images(example_idx, idx, post ARRAY)`` the words are realigned with the images' concepts after each
    round, and their priors are those given the example's image (M31); a new word keeps its length prior.
    """
    spark = slices.sparkSession
    held = bucketed(pack_slices(slices, units, seed), EX, "words-slices")
    state = held.select(EX, "units", F.array().cast("array<string>").alias("words"))
    data = held.select(EX, "vecs")
    posts = None if images is None else bucketed(images.groupBy(EX).agg(F.sort_array(F.collect_list(F.struct("idx", "post"))).alias("posts")), EX, "words-images")
    words: dict[tuple, int] = {}
    prior, curve = None, []

    def sums(state: DataFrame) -> DataFrame:
        pairs = data.join(state.select(EX, "units"), EX).select(F.explode(F.arrays_zip(F.col("units").alias("k"), F.col("vecs").alias("vec"))).alias("x")).select("x.k", "x.vec")
        return cut(vector_sums(pairs), "words-units")

    stats = sums(state)
    for r in range(rounds):
        n, total = stats_arrays(stats, units, len(mu0))
        both = data.join(state.select(EX, "units", "words"), EX)
        both = both.withColumn("prior", F.lit(None).cast("map<string,double>")) if prior is None else both.join(prior, EX, "left")
        drawn = bucketed(word_round(both, words, n, total, mu0, var, var0, alpha, limit, most, p, temp, penalty, seed + r), EX, f"words-drawn-{r}")
        admitted = admit(drawn, words, limit)
        state = bucketed(settle(data.join(drawn.drop("units"), EX), admitted, n, total, mu0, var, var0), EX, f"words-state-{r}")
        counted = state.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        words = {tuple(map(int, row.word.split(","))): row.n for row in counted.collect()}  # at most ``limit`` and one a length
        stats = sums(state)
        n, total = stats_arrays(stats, units, len(mu0))
        squares = np.zeros((units, len(mu0)))
        for row in stats.collect():
            squares[row.k, row.dim] = row.squares
        curve.append(sum(kn.log_marginal(n[k], total[k], squares[k], mu0, var, var0) for k in range(units)))
        if posts is not None:
            names = sorted(words)
            index = F.create_map(*[x for i, w in enumerate(names) for x in (F.lit(_spelled(w)), F.lit(i))])
            numbered = state.select(EX, F.transform("words", lambda w: F.element_at(index, w)).alias("k"))  # noqa: B023
            by_word = component_prior(numbered, posts, len(names), alpha)
            keys = F.lit([_spelled(w) for w in names])
            prior = bucketed(by_word.select(EX, F.map_from_arrays(keys, "prior").alias("prior")), EX, f"words-prior-{r}")
    spans = state.select(EX, F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0)))).alias("start"), F.col("ends").alias("end"), F.col("words").alias("word"))).alias("x"))
    return spans.select(EX, "x.start", "x.end", "x.word"), spark.createDataFrame([(_spelled(w), c) for w, c in sorted(words.items())], "word string, n long"), curve
