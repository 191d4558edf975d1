"""Model statistics and inference. Parameters are tables of at most a few thousand rows and go to the workers as arrays; the data
stay distributed: each round is one pass that emits counts and one aggregation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as kn
from ..functions import packed as pk
from ..functions.scratch import bucketed, cut
from ..functions.statistics import vector_sums, weighted_sums

EX = "example_idx"
#: Numbers that a task's largest array holds at once.
MOST = 2_000_000
#: Structs that a task takes out of an Arrow batch at once, but for those of one example: each is some hundred bytes in Python.
STRUCTS = 50_000


def start_centroids(vectors: DataFrame, k: int, seed: int, partition: str, sample: int = 64) -> DataFrame:
    """(partition, k, vec): ``k`` starting centroids of each partition, far apart by k-means++ over at most ``sample * k`` of its distinct vectors,
    those of the least hashes. Only the start is sampled; the rounds of ``kmeans`` take all vectors."""
    h = F.xxhash64("vec", F.lit(seed))
    rows = vectors.where("vec IS NOT NULL").select(F.col(partition).alias("_p"), "vec", h.alias("_h")).distinct()
    part = F.pmod(F.xxhash64("_h"), F.lit(64))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_h", F.col("vec").cast("string")))
    few = rows.withColumn("_r", rank("_p", part)).where(F.col("_r") <= sample * k).withColumn("_r", rank("_p")).where(F.col("_r") <= sample * k)

    def spread(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_r")
        x, u = np.stack([np.asarray(v, float) for v in own["vec"]]), kn.uniforms(seed + 1, k)
        chosen = [0]
        far = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(k, len(x)):
            c = np.cumsum(far)
            chosen.append(int(np.searchsorted(c, u[len(chosen)] * c[-1], "right")) if c[-1] > 0 else len(chosen))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        return pd.DataFrame({"_p": own["_p"].iloc[0], "k": np.arange(len(chosen), dtype=np.int32), "vec": [x[i].tolist() for i in chosen]})

    kind = vectors.schema[partition].dataType.simpleString()
    return few.select("_p", "_r", "vec").groupBy("_p").applyInPandas(spread, f"_p {kind}, k int, vec array<double>").withColumnRenamed("_p", partition)


def lloyd_round(vectors: DataFrame, centroids: DataFrame, partition: str) -> DataFrame:
    """(partition, k, vec): one round for all partitions at once. A vector meets its partition's centroids in one join, the nearest one
    (the lower of two) takes it, each task adds up by partition and centroid, and one aggregation gives the means; a centroid that
    nothing is near stays."""
    packed = centroids.groupBy(F.col(partition).alias("_p")).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "vec"))), lambda c: c["vec"]).alias("_mu"))
    both = vectors.select(F.col(partition).alias("_own"), "vec").join(packed, F.col("_own") == F.col("_p")).select("_p", "_mu", "vec")
    kind = vectors.schema[partition].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out() -> pd.DataFrame:
            rows = [(p, k, n, total.tolist()) for (p, k), (n, total) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["_p", "k", "n", "total"])

        for b in batches:
            for p, own in b.groupby("_p", sort=False):
                x, mu = np.stack(own["vec"].to_numpy()), np.stack([np.asarray(v, float) for v in own["_mu"].iloc[0]])
                near = kn.squared_distances(x, mu).argmin(1)
                for k in np.unique(near):
                    n, total = held.get((p, k), (0, 0.0))
                    held[p, k] = n + int((near == k).sum()), total + x[near == k].sum(0)
            if len(held) > 10_000:
                yield out()
        yield out()

    sums = both.mapInPandas(run, f"_p {kind}, k int, n long, total array<double>")
    flat = sums.select("_p", "k", "n", F.posexplode("total").alias("dim", "x")).groupBy("_p", "k", "dim").agg((F.sum("x") / F.sum("n")).alias("m"))
    found = flat.groupBy(F.col("_p").alias(partition), "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("_new"))
    return centroids.join(found, [partition, "k"], "left").select(partition, "k", F.coalesce("_new", "vec").alias("vec"))


def kmeans(vectors: DataFrame, k: int, seed: int = 0, partition: str | None = None, rounds: int = 20, tol: float = 1e-4, start: DataFrame | None = None) -> DataFrame:
    """M1: (k, vec) centroids of ``vec``; with ``partition`` (a column) ``k`` centroids of each of its values: (partition, k, vec).

    Lloyd's rounds run over all partitions at once, so the number of jobs is that of the rounds, at most ``rounds``, and fewer when no
    centroid moves farther than ``tol``. ``start`` gives the first centroids. A partition of fewer distinct vectors has as many
    centroids; null partitions and null vectors are left out."""
    own = partition or "_all"
    rows = vectors if partition else vectors.withColumn(own, F.lit(0))
    centroids = start if start is not None else start_centroids(rows, k, seed, own)
    centroids = cut((centroids if own in centroids.columns else centroids.withColumn(own, F.lit(0))).select(own, "k", "vec"), "kmeans-start")
    for r in range(rounds):
        new = cut(lloyd_round(rows, centroids, own), f"kmeans-{r}")
        step = F.aggregate(F.zip_with(F.col("a.vec"), F.col("b.vec"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        moved = new.alias("a").join(centroids.alias("b"), [own, "k"]).agg(F.max(step)).first()[0] or 0.0
        centroids = new
        if moved <= tol * tol:
            break
    return centroids if partition else centroids.drop(own)


def matrix(table: DataFrame, row: str = "k", vec: str = "vec") -> np.ndarray:
    """A small (row, vec) parameter table as an array in row order."""
    return np.array([r[vec] for r in sorted(table.select(row, vec).collect(), key=lambda r: r[row])], float)


def posteriors(vectors: DataFrame, centroids: np.ndarray, width: float) -> DataFrame:
    """M2: (example_idx, idx, post ARRAY): exp(-|v - mu_k|^2 / width), normalised over k."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({EX: b[EX], "idx": b["idx"], "post": list(kn.rbf_posterior(np.stack(b["vec"].to_numpy()), centroids, width))})

    return vectors.select(EX, "idx", "vec").mapInPandas(run, f"{EX} long, idx int, post array<double>")


def assign_nearest(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """M3: (example_idx, idx, k): the centroid of least mean squared distance, the lower of two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({EX: b[EX], "idx": b["idx"], "k": kn.squared_distances(np.stack(b["vec"].to_numpy()), centroids).argmin(1)})

    return vectors.select(EX, "idx", "vec", *_own_prior(vectors)).mapInPandas(run, f"{EX} long, idx int, k int")


def image_prior(post: DataFrame) -> DataFrame:
    """M4: (example_idx, k, log_p): log of the mean posterior over the regions."""
    return post.select(EX, F.posexplode("post").alias("k", "p")).groupBy(EX, "k").agg(F.log(F.avg("p")).alias("log_p"))


def phone_prior(tokens: DataFrame) -> DataFrame:
    """M5: (token, p): relative frequencies."""
    c = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return c.join(c.agg(F.sum("n").alias("all")), F.lit(True)).select("token", (F.col("n") / F.col("all")).alias("p"))


def segment_prior(segments: DataFrame, prior: DataFrame) -> DataFrame:
    """M5: (segment, log_p) of distinct ``segments(segment)``, phones joined by ',': the sum of the phones' log priors."""
    rows = segments.select("segment").distinct().select("segment", F.explode(F.split("segment", ",")).alias("token"))
    return rows.join(prior, "token").groupBy("segment").agg(F.sum(F.log("p")).alias("log_p"))


def length_prior(segments: DataFrame, p: float, v: int) -> DataFrame:
    """M5: geometric form log(p / (1 - p)) + L log((1 - p) / v)."""
    n = F.size(F.split("segment", ","))
    return segments.select("segment", (F.log(F.lit(p / (1 - p))) + n * F.log(F.lit((1 - p) / v))).alias("log_p"))


def crp_counts(seats: DataFrame) -> DataFrame:
    """M6: (k, word, weight) of ``seats(k, word, w)``."""
    return seats.groupBy("k", "word").agg(F.sum("w").alias("weight"))


def crp_prob(counts: DataFrame, base: DataFrame, alpha: float) -> DataFrame:
    """M6: (k, word, p): (alpha p0 + n_w) / (alpha + N), N the sum of weights, ``base(word, log_p)``."""
    total = F.sum("weight").over(Window.partitionBy("k"))
    return counts.withColumn("_n", total).join(base, "word").select("k", "word", ((alpha * F.exp("log_p") + F.col("weight")) / (alpha + F.col("_n"))).alias("p"))


def crp_loglik(counts: DataFrame, base: DataFrame, alpha: float) -> DataFrame:
    """M6: (k, loglik) of the Dirichlet multinomial: lgamma(alpha) - lgamma(alpha + N) + sum of lgamma(n + alpha p0) - lgamma(alpha p0)."""
    import math

    @F.pandas_udf("double")
    def lgamma(x: pd.Series) -> pd.Series:
        return x.map(math.lgamma)

    a = counts.join(base, "word").select("k", "weight", (alpha * F.exp("log_p")).alias("a"))
    terms = a.select("k", "weight", (lgamma(F.col("weight") + F.col("a")) - lgamma("a")).alias("t")).groupBy("k").agg(F.sum("weight").alias("n"), F.sum("t").alias("t"))
    return terms.select("k", (lgamma(F.lit(float(alpha))) - lgamma(F.lit(float(alpha)) + F.col("n")) + F.col("t")).alias("loglik"))


def spans(tokens: DataFrame, max_len: int) -> DataFrame:
    """M7: (example_idx, start, end, segment) of all spans of at most ``max_len`` tokens; the length is bounded before exploding."""
    w = Window.partitionBy(EX).orderBy("pos").rowsBetween(0, max_len - 1)
    own = tokens.withColumn("_w", F.collect_list("token").over(w))
    cuts = own.select(EX, F.col("pos").alias("start"), "_w", F.explode(F.sequence(F.lit(1), F.size("_w"))).alias("_n"))
    return cuts.select(EX, "start", (F.col("start") + F.col("_n")).alias("end"), F.array_join(F.slice("_w", F.lit(1), F.col("_n")), ",").alias("segment"))


def span_scores(spans_: DataFrame, probs: DataFrame, prior: DataFrame, alpha: float, total: float) -> DataFrame:
    """M7: each span's log probability: from ``probs(word, p)`` where the segment is seated, else alpha p0 / (alpha + N). Distinct
    segments are looked up once."""
    known = segment_prior(spans_, prior).withColumnRenamed("segment", "word").join(probs, "word", "left")
    known = known.select(F.col("word").alias("segment"), F.coalesce(F.log("p"), F.log(F.lit(alpha / (alpha + total))) + F.col("log_p")).alias("log_p"))
    return spans_.join(known, "segment").select(EX, "start", "end", "segment", "log_p")


def _split(scored: DataFrame, temp: float | None = None, seed: int = 0) -> DataFrame:
    """(example_idx, start, end): each example's spans are packed into one row, and a kernel segments all examples of an Arrow batch at once."""
    packed = scored.groupBy(EX).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("log_p").cast("double").alias("log_p"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, _ = pk.lists(batch.column("spans"))
            for lo, hi in pk.groups(np.diff(sizes), 1_000_000):
                part = batch.slice(lo, hi - lo)
                offsets, values = pk.lists(part.column("spans"))
                start, end, log_p = (np.asarray(values.field(i)) for i in range(3))
                of = np.repeat(np.arange(hi - lo), np.diff(offsets))
                first = np.r_[0, np.cumsum(np.maximum.reduceat(end, offsets[:-1]) + 1)]
                band = pk.bands(first, of, start, end, log_p)
                ids = part.column(EX).to_pylist()
                rows = pk.viterbi(band, first) if temp is None else pk.sample(band, first, temp, [(ex + 1) * 0x9E3779B97F4A7C15 ^ seed for ex in ids])
                of, start, end = pk.ends_of(rows, first)
                yield pa.RecordBatch.from_arrays([part.column(EX).take(pa.array(of)), pa.array(start, pa.int32()), pa.array(end, pa.int32())], [EX, "start", "end"])

    return packed.mapInArrow(run, f"{EX} long, start int, end int")


def segment_viterbi(scored: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """M8: the best segmentation under the span log probabilities with ``least`` to ``most`` positions a span."""
    n = F.col("end") - F.col("start")
    return _split(scored.where((n >= least) & (n <= most if most else F.lit(True))))


def segment_sample(scored: DataFrame, temp: float = 1.0, seed: int = 0) -> DataFrame:
    """M9: a segmentation drawn by forward filtering and backward sampling; the seed of an example is a hash of it and ``seed``."""
    return _split(scored, temp, seed)


def _pack_tokens(tokens: DataFrame, prior: DataFrame, block: int) -> DataFrame:
    """(block, example_idx, tokens, logs): an example's tokens in order with the logs of their priors, dealt by a hash to blocks of about
    ``block`` tokens and written in buckets of blocks."""
    one = F.struct("pos", "token", F.log("p").alias("log_p"))
    packed = tokens.join(prior, "token").groupBy(EX).agg(F.sort_array(F.collect_list(one)).alias("x"))
    blocks = max(1, -(-tokens.count() // block))
    rows = packed.select(F.pmod(F.xxhash64(EX), F.lit(blocks)).cast("int").alias("block"), EX, F.transform("x", lambda x: x["token"]).alias("tokens"), F.transform("x", lambda x: x["log_p"]).alias("logs"))
    return bucketed(rows, "block", "crp-examples")


def _crp_draw(alpha: float, total: int | None, seed: int, max_len: int):
    """The draw of a block's examples, given rows of their last segments and of the counts of words that occur in them."""

    def run(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(told.loc[told["n"].notna(), "segment"], told.loc[told["n"].notna(), "n"].astype(int), strict=True))
        last = {int(ex): list(segments) for ex, segments in zip(told[EX], told["segments"], strict=True) if segments is not None}
        own = own.sort_values(EX)
        ids, parts, first = own[EX].tolist(), [], np.r_[0, np.cumsum([len(t) + 1 for t in own["tokens"]])]
        for i, (ex, words, logs) in enumerate(zip(ids, own["tokens"], own["logs"], strict=True)):
            run_sum = np.r_[0.0, np.cumsum(np.asarray(logs, float))]
            start, end = zip(*[(s, e) for e in range(1, len(words) + 1) for s in range(max(0, e - max_len), e)], strict=True)
            log_p = run_sum[list(end)] - run_sum[list(start)]
            if total is not None:
                mine = Counter(last.get(ex, []))
                names = [",".join(words[s:e]) for s, e in zip(start, end, strict=True)]
                seated = np.array([counts.get(x, 0) - mine.get(x, 0) for x in names], float)
                log_p = np.log((alpha * np.exp(log_p) + seated) / (alpha + total - mine.total()))
            parts.append((np.full(len(start), i), np.array(start), np.array(end), log_p))
        band = pk.bands(first, *[np.concatenate(x) for x in zip(*parts, strict=True)])
        rows = pk.sample(band, first, 1.0, [(ex + 1) * 0x9E3779B97F4A7C15 ^ seed for ex in ids])
        of, start, end = pk.ends_of(rows, first)
        words = own["tokens"].tolist()
        segments = pd.DataFrame({"of": of, "end": end, "segment": [",".join(words[i][s:e]) for i, s, e in zip(of, start, end, strict=True)]}).groupby("of")
        return pd.DataFrame({"block": own["block"].to_numpy(), EX: ids, "ends": [g["end"].tolist() for _, g in segments], "segments": [g["segment"].tolist() for _, g in segments]})

    return run


def crp_segment(tokens: DataFrame, alpha: float, rounds: int, seed: int, max_len: int = 6, block: int = 200_000) -> DataFrame:
    """(example_idx, start, end, segment) after ``rounds`` of: every example samples in parallel against the last round's
    counts less its own, then all are counted again. An approximate, distributed Gibbs sampler.

    Examples lie in buckets of blocks and never move. What moves in a round are the segments that are seated: they are counted, the
    counts meet the blocks whose examples could hold them (a table of spans by block, in buckets of segments, that is made once), and go
    to these blocks. Tokens of an example must be at positions without gaps."""
    prior = cut(phone_prior(tokens), "crp-prior")
    held = _pack_tokens(tokens, prior, block)
    spans_of = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda n: F.filter(F.transform("tokens", lambda _, i: F.when(i + n <= F.size("tokens"), F.array_join(F.slice("tokens", i + 1, n), ","))), lambda x: x.isNotNull())))
    wanted = bucketed(held.select("block", F.explode(spans_of).alias("segment")).distinct(), "segment", "crp-spans") if rounds > 1 else None
    schema = f"block int, {EX} long, ends array<int>, segments array<string>"
    told = f"block int, {EX} long, segments array<string>, segment string, n long"
    state, spark = None, tokens.sparkSession
    for r in range(rounds):
        if state is None:
            total, news = None, spark.createDataFrame([], told)
        else:
            counts = state.select(F.explode("segments").alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
            total = state.agg(F.sum(F.size("segments"))).first()[0] or 0
            seated = wanted.join(counts, "segment").select("block", F.lit(None).cast("long").alias(EX), F.lit(None).cast("array<string>").alias("segments"), "segment", "n")
            news = state.select("block", EX, "segments", F.lit(None).cast("string").alias("segment"), F.lit(None).cast("long").alias("n")).unionByName(seated)
        drawn = held.groupBy("block").cogroup(news.groupBy("block")).applyInPandas(_crp_draw(alpha, total, seed + r, max_len), schema)
        state = cut(drawn, f"crp-round-{r}")
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1))
    return state.select(EX, F.explode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"), F.col("segments").alias("segment"))).alias("x")).select(EX, "x.start", "x.end", "x.segment")


def mixture_terms(pairs: DataFrame, q: DataFrame, table: DataFrame) -> DataFrame:
    """A(t, j) = sum over k of P(w_t, k) q(j, k): (example_idx, t, w, j, a) of ``pairs(example_idx, t, w)`` and ``q(example_idx, j, k, q)``:
    one matrix product an example, with the rows of the table that its words have."""
    rows = table.groupBy("w").agg(F.collect_list(F.struct("k", "p")).alias("row"))
    caps = pairs.join(rows, "w").groupBy(EX).agg(F.collect_list(F.struct("t", "w", "row")).alias("cap"))
    images = q.groupBy(EX).agg(F.collect_list(F.struct("j", "k", "q")).alias("im"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ex, cap, im in zip(b[EX], b["cap"], b["im"], strict=True):
                js, at = np.unique([x["j"] for x in im], return_inverse=True)
                ks = max(max(x["k"] for x in im), max(x["k"] for c in cap for x in c["row"])) + 1
                right, left = np.zeros((ks, len(js))), np.zeros((len(cap), ks))
                right[[x["k"] for x in im], at] = [x["q"] for x in im]
                for i, c in enumerate(cap):
                    left[i, [x["k"] for x in c["row"]]] = [x["p"] for x in c["row"]]
                a = left @ right
                yield pd.DataFrame({EX: ex, "t": np.repeat([c["t"] for c in cap], len(js)), "w": np.repeat([c["w"] for c in cap], len(js)), "j": np.tile(js, len(cap)), "a": a.ravel()})

    kind = {f.name: f.dataType.simpleString() for f in [*pairs.schema, *q.schema]}
    return caps.join(images, EX).mapInPandas(run, f"{EX} long, t {kind['t']}, w {kind['w']}, j {kind['j']}, a double")


def pack_mixture(pairs: DataFrame, q: DataFrame) -> DataFrame:
    """One row an example, (example_idx, cap, im), for the rounds of M11: they read it where it lies."""
    caps = pairs.groupBy(EX).agg(F.collect_list(F.struct("t", "w")).alias("cap"))
    images = q.groupBy(EX).agg(F.collect_list(F.struct("j", "k", "q")).alias("im"))
    return caps.join(images, EX)


def _mixture_counts(left: np.ndarray, j: np.ndarray, k: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected counts [T, K] and log-likelihood of one example, of ``left[T, K]`` = P(w_t, k) and its regions' ``q`` of (j, k)."""
    js, at = np.unique(j, return_inverse=True)
    right = np.zeros((left.shape[1], len(js)))
    np.add.at(right, (k, at), q)
    a = left @ right
    c = a / a.sum(0)
    return c @ (right / right.sum(0)).T, float(np.log(np.maximum(a.mean(0), 1e-300)).sum())


def mixture_counts(packed: DataFrame, table: DataFrame, most: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """(expected counts (w, k, c), log-likelihood (example_idx, loglik)), both from one pass over ``pack_mixture``.

    A table of up to ``most`` numbers is broadcast; of a larger one each example gets the rows of its words in a join. Each task adds
    counts up before they leave it, word by word, and passes them on when it holds ``most`` numbers."""
    kind = {f.name: f.dataType.simpleString() for f in table.schema}["w"]
    ks = (table.agg(F.max("k")).first()[0] or 0) + 1
    words = table.select("w").distinct().count()
    if words * ks <= most:
        found: dict = {}
        for r in table.collect():
            found.setdefault(r.w, np.zeros(ks))[r.k] = r.p
        shared = table.sparkSession.sparkContext.broadcast(found)
        rows = packed
    else:
        shared = None
        by_word = table.groupBy("w").agg(F.collect_list(F.struct("k", "p")).alias("row"))
        caps = packed.select(EX, F.explode("cap").alias("x")).select(EX, "x.*").join(by_word, "w").groupBy(EX).agg(F.collect_list(F.struct("t", "w", "row")).alias("cap"))
        rows = packed.drop("cap").join(caps, EX).select(EX, "cap", "im")

    ddl = f"{EX} long, w {kind}, k int, value double"
    schema = packed.sparkSession.createDataFrame([], ddl).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def counts() -> pa.RecordBatch:
            value = np.concatenate([*held.values(), np.zeros(0)])
            at = np.flatnonzero(value)
            words = pa.array(list(held), schema.field("w").type).take(pa.array(at // ks))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), words, pa.array(at % ks, pa.int32()), pa.array(value[at])], schema=schema)

        for whole in batches:
            for lo, hi in pk.groups(sum(np.diff(pk.lists(whole.column(c))[0]) for c in ("cap", "im")), STRUCTS):
                b, lls = whole.slice(lo, hi - lo), []
                offsets, im = pk.lists(b.column("im"))
                j, k, q = (np.asarray(im.field(c)) for c in ("j", "k", "q"))
                for ex, cap, first, last in zip(b.column(EX).to_pylist(), b.column("cap").to_pylist(), offsets, offsets[1:]):
                    cap = [c for c in cap if shared is None or c["w"] in shared.value]
                    if not len(cap):
                        continue
                    left = np.zeros((len(cap), ks))
                    for i, c in enumerate(cap):
                        if shared is not None:
                            left[i] = shared.value[c["w"]]
                        else:
                            left[i, [x["k"] for x in c["row"]]] = [x["p"] for x in c["row"]]
                    c, ll = _mixture_counts(left, j[first:last], k[first:last], q[first:last])
                    for x, row in zip(cap, c, strict=True):
                        held[x["w"]] = held[x["w"]] + row if x["w"] in held else row
                    lls.append((ex, ll))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in lls], pa.int64()), pa.nulls(len(lls), schema.field("w").type), pa.nulls(len(lls), pa.int32()), pa.array([v for _, v in lls], pa.float64())], schema=schema)
                if len(held) * ks > most:
                    yield counts()
        yield counts()

    out = cut(rows.select(EX, "cap", "im").mapInArrow(run, ddl), "mixture-counts")
    return out.where("k IS NOT NULL").groupBy("w", "k").agg(F.sum("value").alias("c")), out.where("k IS NULL").select(EX, F.col("value").alias("loglik"))


def mixture_round(pairs: DataFrame | None, q: DataFrame | None, table: DataFrame, alpha: float, ks: int, packed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M11, one round: (new table (w, k, p), log-likelihood per example). Rows of the table are target words and sum to 1. Examples that
    are packed already come as ``packed``."""
    counts, ll = mixture_counts(pack_mixture(pairs, q) if packed is None else packed, table)
    full = table.select("w", "k").join(counts, ["w", "k"], "left").fillna(0.0)
    new = full.select("w", "k", ((alpha / ks + F.col("c")) / (alpha + F.sum("c").over(Window.partitionBy("w")))).alias("p"))
    return new, ll


def train_mixture(pairs: DataFrame, q: DataFrame, table: DataFrame, iters: int, alpha: float, ks: int) -> tuple[DataFrame, list[float]]:
    """(table, mean log-likelihood before each round). The examples are packed once and stay where they lie."""
    packed = cut(pack_mixture(pairs, q), "mixture-examples")
    curve = []
    for i in range(iters):
        new, ll = mixture_round(None, None, table, alpha, ks, packed)
        curve.append(ll.agg(F.avg("loglik")).first()[0])
        table = cut(new, f"mixture-{i}")
    return table, curve


def update_centroids(pairs: DataFrame, post: DataFrame, table: DataFrame, vectors: DataFrame) -> DataFrame:
    """(k, dim, value): means weighted by posterior(j, k) times the caption's mean P(w_t, k), normalised over k."""
    prior = pairs.join(table, "w").groupBy(EX, "k").agg(F.avg("p").alias("c"))
    w = post.join(prior, [EX, "k"]).withColumn("w", F.col("p") * F.col("c"))
    w = w.withColumn("w", F.col("w") / F.greatest(F.sum("w").over(Window.partitionBy(EX, "idx")), F.lit(1e-300)))
    return weighted_sums(w.select(EX, "idx", "k", "w"), vectors, [EX, "idx"]).where("weight <> 0").select("k", "dim", (F.col("total") / F.col("weight")).alias("value"))


def align_mixture(terms: DataFrame, score: str = "max", floor: float = 1e-30) -> tuple[DataFrame, DataFrame]:
    """((example_idx, j, t) best target position of each source, (example_idx, log_score) sum of log max or mean over sources)."""
    best = terms.groupBy(EX, "j").agg(F.max_by("t", F.struct("a", -F.col("t"))).alias("t"), F.greatest(F.max("a") if score == "max" else F.avg("a"), F.lit(floor)).alias("m"))
    return best.select(EX, "j", "t"), best.groupBy(EX).agg(F.sum(F.log("m")).alias("log_score"))


# Alignment by a hidden Markov model. Examples are rows (example_idx, tokens ARRAY<INT>, post ARRAY<ARRAY<DOUBLE>>); parameters
# are {"init": {n: [n]}, "trans": {n: [n, n]}, "obs": [K, V]}.


def start_params(lengths: list[int], k: int, v: int, obs: np.ndarray | None = None) -> dict:
    return {"init": {n: np.full(n, 1 / n) for n in lengths}, "trans": {n: np.full((n, n), 1 / n) for n in lengths}, "obs": np.full((k, v), 1 / v) if obs is None else obs}


def _emissions(tokens, obs: np.ndarray) -> np.ndarray:
    """b[T, K]: a token is a symbol, or a row of symbol posteriors (an acoustic frame)."""
    x = np.asarray(list(tokens))
    return obs[:, x.astype(int)].T if x.ndim == 1 else np.stack([np.asarray(r, float) for r in tokens]) @ obs.T


def _alike(b: pd.DataFrame, obs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, pi[B, n, K], tokens[B, T] or [B, T, V], emissions[B, T, K]): examples of a batch with as many regions and positions, some at
    once. Those without either are left out."""
    regions, steps = (np.array([len(v) for v in b[c]], int) for c in ("post", "tokens"))
    for n, t in np.unique(np.stack([regions, steps], 1)[(regions > 0) & (steps > 0)], axis=0):
        same = np.flatnonzero((regions == n) & (steps == t))
        for lo, hi in pk.groups(np.full(len(same), t * n * len(obs) ** 2), MOST):
            rows = same[lo:hi]
            pi = np.array([[*v] for v in b["post"].iloc[rows]], float)
            x = np.array([[*v] for v in b["tokens"].iloc[rows]])
            if x.ndim == 2:
                x = x.astype(int)
                yield rows, pi, x, obs.T[x]
            else:
                yield rows, pi, x, x @ obs.T


def hmm_estep(examples: DataFrame, params: dict, init_counts: str = "all") -> DataFrame:
    """Expected counts in long form, summed over all examples: (kind, m, i, j, value) of kind 'init' (m, i), 'trans' (m, i, j),
    'obs' (k as i, v as j) and 'loglik' (m examples). Each task adds up what it sees before anything is shuffled."""
    held = examples.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = held.value
        obs, sums = np.zeros_like(p["obs"]), {}
        for b in batches:
            for _, pi, x, emit in _alike(b, p["obs"]):
                n = pi.shape[1]
                e = kn.hmm_estep_many(pi, p["init"][n], p["trans"][n], emit, init_counts)
                gamma = e["gamma"].reshape(-1, len(obs))
                if x.ndim == 2:
                    np.add.at(obs.T, x.ravel(), gamma)
                else:
                    obs += gamma.T @ x.reshape(len(gamma), -1)
                own = sums.setdefault(n, [np.zeros(n), np.zeros((n, n)), 0.0, 0])
                own[0] += e["init"]
                own[1] += e["trans"]
                own[2] += e["loglik"]
                own[3] += len(pi)
        rows = [("obs", 0, i, j, obs[i, j]) for i, j in np.argwhere(obs > 0).tolist()]
        for n, (init, trans, ll, count) in sums.items():
            rows += [("init", n, i, 0, init[i]) for i in range(n)] + [("trans", n, i, j, trans[i, j]) for i in range(n) for j in range(n)]
            rows += [("loglik", n, 0, 0, ll), ("examples", n, 0, 0, float(count))]
        yield pd.DataFrame(rows, columns=["kind", "m", "i", "j", "value"])

    counted = examples.select("tokens", "post").mapInPandas(run, "kind string, m int, i int, j int, value double")
    return counted.groupBy("kind", "m", "i", "j").agg(F.sum("value").alias("value"))


def hmm_mstep(counts: DataFrame, floor: float = 1e-100, pool_from: int = 6) -> DataFrame:
    """(kind, m, i, j, p): init over i, trans over j, obs over v, floored. With ``pool_from`` or more lengths transitions are
    pooled by jump width j - i over all lengths."""
    value = F.greatest("value", F.lit(floor))
    init = counts.where("kind = 'init'").select("kind", "m", "i", "j", (value / F.sum(value).over(Window.partitionBy("m"))).alias("p"))
    obs = counts.where("kind = 'obs'").select("kind", "m", "i", "j", (value / F.sum(value).over(Window.partitionBy("i"))).alias("p"))
    trans = counts.where("kind = 'trans'")
    if trans.select("m").distinct().count() >= pool_from:
        trans = trans.withColumn("value", F.sum("value").over(Window.partitionBy(F.col("j") - F.col("i"))))
    trans = trans.select("kind", "m", "i", "j", (value / F.sum(value).over(Window.partitionBy("m", "i"))).alias("p"))
    return init.union(trans).union(obs)


def params_of(table: DataFrame, like: dict) -> dict:
    """The small table of ``hmm_mstep`` as arrays; what it lacks is as in ``like``, and rows are made to sum to 1."""
    out = {"init": {n: v.copy() for n, v in like["init"].items()}, "trans": {n: v.copy() for n, v in like["trans"].items()}, "obs": np.full_like(like["obs"], 1e-100)}
    for r in table.collect():
        if r.kind == "init":
            out["init"][r.m][r.i] = r.p
        elif r.kind == "trans":
            out["trans"][r.m][r.i, r.j] = r.p
        else:
            out["obs"][r.i, r.j] = r.p
    out["obs"] /= out["obs"].sum(1, keepdims=True)
    return out


def gradient_step(post: DataFrame, counts: DataFrame, vectors: DataFrame, centroids: np.ndarray, lr: float, width: float) -> tuple[np.ndarray, float]:
    """New centroids mu_k + lr / (N width) * (sum delta v - mu_k sum delta), delta = concept count less posterior, N examples; and
    the mean absolute gap. ``post`` and ``counts`` are (example_idx, idx, k, p)."""
    d = post.join(counts.withColumnRenamed("p", "c"), [EX, "idx", "k"]).select(EX, "idx", "k", (F.col("c") - F.col("p")).alias("d"))
    n = vectors.select(EX).distinct().count()
    gap = d.agg(F.avg(F.abs("d"))).first()[0]
    new = centroids.copy()
    for r in weighted_sums(d.withColumnRenamed("d", "w"), vectors, [EX, "idx"]).collect():
        new[r.k, r.dim] += lr / (n * width) * (r.total - centroids[r.k, r.dim] * r.weight)
    return new, gap


def concept_counts(examples: DataFrame, params: dict) -> DataFrame:
    """(example_idx, idx, k, p): posterior of each region's concept given the caption."""
    held = examples.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = held.value
        for b in batches:
            for rows, pi, _, emit in _alike(b, p["obs"]):
                n = pi.shape[1]
                c = kn.hmm_estep_many(pi, p["init"][n], p["trans"][n], emit)["concept"]
                _, i, k = np.indices(c.shape)
                yield pd.DataFrame({EX: np.repeat(b[EX].to_numpy()[rows], c[0].size), "idx": i.ravel(), "k": k.ravel(), "p": c.ravel()})

    return examples.select(EX, "tokens", "post").where((F.size("tokens") > 0) & (F.size("post") > 0)).mapInPandas(run, f"{EX} long, idx int, k int, p double")


def pack_examples(tokens: DataFrame, post: DataFrame) -> DataFrame:
    """One row per example: tokens (example_idx, t, w) and posteriors (example_idx, idx, post) in order."""
    a = tokens.groupBy(EX).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "w"))), lambda x: x["w"]).alias("tokens"))
    b = post.groupBy(EX).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "post"))), lambda x: x["post"]).alias("post"))
    return a.join(b, EX)


def symbol_counts(examples: DataFrame, params: dict) -> DataFrame:
    """M17, acoustic: (example_idx, idx, k, p): posterior of each frame's symbol k given the example, for tokens that are rows of
    symbol posteriors."""
    held = examples.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = held.value
        for b in batches:
            for rows, pi, x, emit in _alike(b, p["obs"]):
                n = pi.shape[1]
                gamma = kn.hmm_estep_many(pi, p["init"][n], p["trans"][n], emit)["gamma"]
                c = x * (gamma / np.maximum(emit, 1e-300) @ p["obs"])
                _, t, k = np.indices(c.shape)
                yield pd.DataFrame({EX: np.repeat(b[EX].to_numpy()[rows], c[0].size), "idx": t.ravel(), "k": k.ravel(), "p": c.ravel()})

    return examples.select(EX, "tokens", "post").where((F.size("tokens") > 0) & (F.size("post") > 0)).mapInPandas(run, f"{EX} long, idx int, k int, p double")


def train_hmm(tokens: DataFrame | None, vectors: DataFrame, centroids: np.ndarray, v: int, iters: int = 40, lr: float = 0.1, width: float = 1.0, obs: np.ndarray | None = None, frames: DataFrame | None = None, frame_centroids: np.ndarray | None = None, base: np.ndarray | None = None, alpha: float = 1.0) -> tuple[dict, np.ndarray, list[float]]:
    """(parameters, centroids, mean log-likelihood of each round). Each round: posteriors, E step, M step, gradient step on the
    centroids; the learning rate falls tenfold every ten rounds.

    Tokens are symbols (example_idx, t, w). Instead, ``frames(example_idx, idx, vec)`` are soft symbols by their posteriors under
    ``frame_centroids``, which take gradient steps too and come back in the parameters as ``frames``. With ``base``, the prior
    of the words, tokens are segments of M10 and emissions are M6's predictive probabilities with concentration ``alpha``."""
    lengths = [r[0] for r in vectors.groupBy(EX).count().select("count").distinct().collect()]
    params, curve = start_params(lengths, len(centroids), v, obs), []
    if base is not None and obs is None:
        params["obs"] = np.tile(base / base.sum(), (len(centroids), 1))
    for i in range(iters):
        step = lr * 0.1 ** (i // 10)
        post = posteriors(vectors, centroids, width)
        if frames is not None:
            soft = posteriors(frames, frame_centroids, width)
            tokens = soft.select(EX, F.col("idx").alias("t"), F.col("post").alias("w"))
        examples = cut(pack_examples(tokens, post), f"hmm-{i}")
        counts = cut(hmm_estep(examples, params), f"hmm-counts-{i}")
        totals = {r.kind: r.t for r in counts.where("kind in ('loglik', 'examples')").groupBy("kind").agg(F.sum("value").alias("t")).collect()}
        curve.append(totals["loglik"] / totals["examples"])
        new = params_of(hmm_mstep(counts), params)
        if base is not None:
            seats = np.zeros_like(params["obs"])
            for r in counts.where("kind = 'obs'").collect():
                seats[r.i, r.j] = r.value
            new["obs"] = (alpha * base / base.sum() + seats) / (alpha + seats.sum(1, keepdims=True))
        flat = lambda soft: soft.select(EX, "idx", F.posexplode("post").alias("k", "p"))
        if lr:
            centroids, _ = gradient_step(flat(post), concept_counts(examples, params), vectors, centroids, step, width)
            if frames is not None:
                frame_centroids, _ = gradient_step(flat(soft), symbol_counts(examples, params), frames, frame_centroids, step, width)
        params = new
    if frames is not None:
        params["frames"] = frame_centroids
    return params, centroids, curve


def align_viterbi(examples: DataFrame, params: dict) -> DataFrame:
    """(example_idx, t, region, score): the best region of every position and its normalised score."""
    held = examples.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = held.value
        for b in batches:
            rows = []
            for ex, tokens, post in zip(b[EX], b["tokens"], b["post"], strict=True):
                pi = np.stack([np.asarray(r, float) for r in post])
                path, probs = kn.hmm_viterbi(pi, p["init"][len(pi)], p["trans"][len(pi)], _emissions(tokens, p["obs"]))
                rows += [(ex, t, int(r), float(probs[t, r])) for t, r in enumerate(path)]
            yield pd.DataFrame(rows, columns=[EX, "t", "region", "score"])

    return examples.select(EX, "tokens", "post").where((F.size("tokens") > 0) & (F.size("post") > 0)).mapInPandas(run, f"{EX} long, t int, region int, score double")


def decode_regions(alignment: DataFrame, tokens: DataFrame, post: DataFrame, obs: DataFrame) -> DataFrame:
    """(example_idx, idx, k): best log posterior plus log emissions of the positions aligned to the region; ``post(.., k, p)``, ``obs(k, w, p)``."""
    e = alignment.join(tokens, [EX, "t"]).join(obs.withColumnRenamed("p", "o"), "w").groupBy(EX, F.col("region").alias("idx"), "k").agg(F.sum(F.log("o")).alias("e"))
    s = post.join(e, [EX, "idx", "k"], "left").withColumn("s", F.log(F.greatest("p", F.lit(1e-100))) + F.coalesce("e", F.lit(0.0)))
    return s.groupBy(EX, "idx").agg(F.max_by("k", F.struct("s", -F.col("k"))).alias("k"))


def decode_positions(counts: DataFrame) -> DataFrame:
    """(example_idx, t, k): the concept of the largest count of ``counts(example_idx, t, k, value)``."""
    return counts.groupBy(EX, "t").agg(F.max_by("k", F.struct("value", -F.col("k"))).alias("k"))


def avg_loglik(examples: DataFrame, params: dict) -> DataFrame:
    """Mean log-likelihood over the scored examples."""
    c = hmm_estep(examples, params)
    return c.agg((F.sum(F.when(F.col("kind") == "loglik", F.col("value"))) / F.sum(F.when(F.col("kind") == "examples", F.col("value")))).alias("loglik"))


def length_probs(lengths: DataFrame, laplace: float = 0.0) -> DataFrame:
    """(m, n, p): p(target length n given source length m) of ``lengths(m, n)``; ``laplace`` is added to every n up to the largest."""
    c = lengths.groupBy("m", "n").agg(F.count("*").cast("double").alias("c"))
    if laplace:
        top = c.agg(F.max("n")).first()[0] or 0
        grid = c.select("m").distinct().select("m", F.explode(F.sequence(F.lit(1), F.lit(int(top)))).alias("n"))
        c = grid.join(c, ["m", "n"], "left").select("m", "n", (F.coalesce("c", F.lit(0.0)) + laplace).alias("c"))
    return c.select("m", "n", (F.col("c") / F.sum("c").over(Window.partitionBy("m"))).alias("p"))


def component_stats(vectors: DataFrame, mu0: float, var: float, var0: float) -> DataFrame:
    """(k, dim, n, total, squares, mean, prec) of ``vectors(k, vec)``."""
    s = vector_sums(vectors)
    prec = F.lit(1 / var0) + F.col("n") / var
    return s.withColumns({"mean": (mu0 / var0 + F.col("total") / var) / prec, "prec": prec / var / (prec + 1 / var)})


def stats_arrays(stats: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """n[K] and total[K, D] of the small table."""
    n, total = np.zeros(k), np.zeros((k, dim))
    for r in stats.select("k", "dim", "n", "total").collect():
        n[r.k], total[r.k, r.dim] = r.n, r.total
    return n, total


def _priors(batch: pd.DataFrame, n: np.ndarray, alpha: float) -> np.ndarray:
    """Log prior of the components: by their counts, or of each row where it has its own in ``prior``."""
    prior = kn.component_log_prior(n, alpha)
    if "prior" not in batch:
        return prior
    return np.stack([prior if p is None else np.asarray(p, float) for p in batch["prior"]])


def log_predictive(vectors: DataFrame, n: np.ndarray, total: np.ndarray, mu0: np.ndarray, var: float, var0: float, alpha: float = 1.0, scale: bool = False) -> DataFrame:
    """(example_idx, idx, logp ARRAY, log_prior, log_marginal): densities under every component, under the prior, and of the mixture.

    A column ``prior ARRAY`` of the vectors holds log priors of their own. ``scale``: the mixture takes each vector's densities less
    their sum over the components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, prec = kn.component_posterior(n, total, mu0, var, var0)
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_numpy())
                d = kn.log_densities(x, mean, prec)
                own = _priors(b, n, alpha) - (kn.log_sum_exp(d)[:, None] if scale else 0)
                yield pd.DataFrame({EX: b[EX], "idx": b["idx"], "logp": list(d), "log_prior": kn.log_densities(x, mu0[None], np.array([1 / var0]))[:, 0], "log_marginal": kn.log_sum_exp(d + own)})

    return vectors.select(EX, "idx", "vec", *_own_prior(vectors)).mapInPandas(run, f"{EX} long, idx int, logp array<double>, log_prior double, log_marginal double")


def _own_prior(vectors: DataFrame) -> list[str]:
    return [c for c in vectors.columns if c == "prior"]


def log_marginal(stats: DataFrame, k: int, mu0: float, var: float, var0: float, alpha: float) -> DataFrame:
    """(log_x, log_z): data log-marginal given the assignment, and the assignment's log prior; the sums per dimension are plain
    expressions, and only K counts need lgamma."""
    import math

    prec = F.lit(1 / var0) + F.col("n") / var
    quad = F.col("squares") / var + mu0**2 / var0 - F.pow(mu0 / var0 + F.col("total") / var, F.lit(2.0)) / prec
    x = stats.agg(F.sum(-0.5 * F.col("n") * math.log(2 * math.pi * var) - 0.5 * F.log(var0 * prec) - 0.5 * quad)).first()[0]
    counts = [r.n for r in stats.where("dim = 0").select("n").collect()]
    z = math.lgamma(alpha) - math.lgamma(alpha + sum(counts)) + sum(math.lgamma(c + alpha / k) - math.lgamma(alpha / k) for c in counts)
    return stats.sparkSession.createDataFrame([(float(x or 0), float(z))], "log_x double, log_z double")


def gmm_assign(vectors: DataFrame, n: np.ndarray, total: np.ndarray, mu0: np.ndarray, var: float, var0: float, alpha: float = 1.0, temp: float | None = None, seed: int = 0, own: str | None = None) -> DataFrame:
    """(example_idx, idx, k): the best component, or with ``temp`` one drawn by a hash of the vector's place, against a snapshot of
    the counts. With ``own``, a column with each vector's component in that snapshot (null: none), the vector itself is taken out of its
    component first, so each draw is that of a Gibbs step from the snapshot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, prec = kn.component_posterior(n, total, mu0, var, var0)
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["vec"].to_numpy())
            s, prior = kn.log_densities(x, mean, prec), _priors(b, n, alpha)
            if own is not None:
                at = np.flatnonzero(b["own"].notna())
                k = b["own"].to_numpy()[at].astype(int)
                s[at, k] = kn.own_removed(x, at, k, np.ones(len(at)), x[at], n, total, mu0, var, var0)
                prior = np.broadcast_to(prior, s.shape).copy()
                mine = at if "prior" not in b else at[b["prior"].isna().to_numpy()[at]]  # priors that come with a row stay
                prior[mine] += np.log(n.sum() + alpha) - np.log(n.sum() - 1 + alpha)
                mk = b["own"].to_numpy()[mine].astype(int)
                prior[mine, mk] = np.log(alpha / len(n) + n[mk] - 1) - np.log(n.sum() - 1 + alpha)
            s = s + prior
            if temp is None:
                k = s.argmax(1)
            else:
                w = np.exp((s - s.max(1, keepdims=True)) / temp).cumsum(1)
                u = np.array([kn.uniforms((int(e) * 1_000_003 + int(i)) ^ seed * 0x9E3779B97F4A7C15, 1)[0] for e, i in zip(b[EX], b["idx"], strict=True)])
                k = np.minimum((w < (u * w[:, -1])[:, None]).sum(1), len(n) - 1)
            yield pd.DataFrame({EX: b[EX], "idx": b["idx"], "k": k})

    held = [F.col(own).cast("int").alias("own")] if own is not None else []
    return vectors.select(EX, "idx", "vec", *_own_prior(vectors), *held).mapInPandas(run, f"{EX} long, idx int, k int")


def gmm_rounds(vectors: DataFrame, assign: DataFrame, comps: int, mu0: np.ndarray, var: float, var0: float, alpha: float, rounds: int, temp: float | None = 1.0, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """(assignments (example_idx, idx, k), log p(X, z) before each round): all vectors are drawn in parallel against the last round's
    counts less their own. Vectors and assignments lie in the same buckets, and only sums of components are shuffled."""
    held = bucketed(vectors.select(EX, "idx", "vec"), [EX, "idx"], "gmm-vectors")
    state, curve = bucketed(assign.select(EX, "idx", F.col("k").cast("int").alias("k")), [EX, "idx"], "gmm-start"), []
    for r in range(rounds):
        both = held.join(state, [EX, "idx"])
        stats = cut(component_stats(both.select("k", "vec"), 0.0, var, var0), f"gmm-stats-{r}")
        n, total = stats_arrays(stats, comps, len(mu0))
        curve.append(sum(log_marginal(stats, comps, 0.0, var, var0, alpha).first()))
        state = bucketed(gmm_assign(both, n, total, mu0, var, var0, alpha, temp, seed + r, own="k"), [EX, "idx"], f"gmm-round-{r}")
    return state, curve


def shrink_components(assign: DataFrame, k: int) -> DataFrame:
    """(example_idx, idx, k): the ``k`` largest components (ties by number), renumbered from 0 without gaps; others become null, to be
    assigned again."""
    rank = assign.groupBy("k").agg(F.count("*").alias("n")).select("k", (F.row_number().over(Window.orderBy(F.desc("n"), "k")) - 1).alias("new")).where(F.col("new") < k)
    return assign.join(F.broadcast(rank), "k", "left").select(EX, "idx", F.col("new").alias("k"))


def shrink_and_assign(vectors: DataFrame, assign: DataFrame, k: int, mu0: np.ndarray, var: float, var0: float, alpha: float = 1.0) -> DataFrame:
    """(example_idx, idx, k): the ``k`` largest components, renumbered, and every vector of a dropped one in the best of those that
    are left, given their counts."""
    kept = shrink_components(assign, k)
    held = cut(vectors.select(EX, "idx", "vec").join(kept, [EX, "idx"]), "shrunk")
    n, total = stats_arrays(component_stats(held.where("k is not null").select("k", "vec"), 0.0, var, var0), k, len(mu0))
    again = gmm_assign(held.where("k is null").select(EX, "idx", "vec"), n, total, mu0, var, var0, alpha)
    return held.where("k is not null").select(EX, "idx", F.col("k").cast("int").alias("k")).unionByName(again)


def component_prior_of(posts: DataFrame, p: np.ndarray, mass: np.ndarray, floor: float) -> DataFrame:
    """M31 for a small table: (example_idx, prior ARRAY), log of the mean over an example's regions of sum over k of pi(k) p(w given k), where
    p(w given k) is in proportion to ``p[w, k]`` times ``mass[w]``; ``posts(example_idx, posts ARRAY)`` of structs (idx, post)."""
    given = p * mass[:, None]
    given = given / given.sum(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, regions = pk.lists(batch.column("posts"))
            if not len(regions):
                continue
            scores = pk.matrix(regions.field(1)) @ given.T
            live = np.flatnonzero(np.diff(offsets))
            mean = np.add.reduceat(scores, offsets[live], 0) / np.diff(offsets)[live][:, None]
            prior = pa.array(list(np.log(np.maximum(mean, floor))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(EX).take(pa.array(live)), prior], [EX, "prior"])

    return posts.select(EX, "posts").mapInArrow(run, f"{EX} long, prior array<double>")


def score_words(units: DataFrame, words: DataFrame, p: float, m: int) -> DataFrame:
    """(example_idx, seg, word, score): mean over positions of the log predictive of the word's unit, for words as long as the segment,
    plus the length prior log p (1 - p)^(L - 1) / m^L; ``units(example_idx, seg, pos, len, k, logp)``, ``words(word, pos, len, k)``."""
    hit = units.join(words, ["pos", "len", "k"]).groupBy(EX, "seg", "word", "len").agg(F.avg("logp").alias("a"), F.count("*").alias("c")).where(F.col("c") == F.col("len"))
    return hit.select(EX, "seg", "word", (F.col("a") + F.log(F.lit(p)) + (F.col("len") - 1) * F.log(F.lit(1 - p)) - F.col("len") * F.log(F.lit(float(m)))).alias("score"))


def empirical_prior(vectors: DataFrame, scale: float = 1.0) -> DataFrame:
    """(dim, mean, var): mean and scaled variance of the initial segments' vectors."""
    s = vector_sums(vectors.select(F.lit(0).alias("k"), "vec"))
    mean = F.col("total") / F.col("n")
    return s.select("dim", mean.alias("mean"), (F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)) * scale).alias("var"))


def results_table(segments: DataFrame) -> DataFrame:
    """(example_idx, alignment, segmentation, transcript) of ``segments(example_idx, start, end, region, k)``: the region of every slice, the
    ends, and the components in order."""
    s = F.sort_array(F.collect_list(F.struct("start", "end", "region", "k")))
    packed = segments.groupBy(EX).agg(s.alias("s"))
    slices = F.flatten(F.transform("s", lambda x: F.array_repeat(x["region"], x["end"] - x["start"])))
    return packed.select(EX, slices.alias("alignment"), F.transform("s", lambda x: x["end"]).alias("segmentation"), F.transform("s", lambda x: x["k"]).alias("transcript"))


def word_prior(post: DataFrame, table: DataFrame, new_word: str | None = None, floor: float = 1e-300) -> DataFrame:
    """(example_idx, word, log_p): mean over regions of sum over k of pi(k) p(word given k); ``new_word`` gets the mass that is left."""
    size = post.groupBy(EX).agg(F.countDistinct("idx").alias("n"))
    w = post.join(table.withColumnRenamed("p", "q"), "k").groupBy(EX, "word").agg(F.sum(F.col("p") * F.col("q")).alias("s")).join(size, EX)
    w = w.select(EX, "word", (F.col("s") / F.col("n")).alias("p"))
    if new_word is not None:
        w = w.union(w.groupBy(EX).agg(F.sum("p").alias("t")).select(EX, F.lit(new_word), F.greatest(1 - F.col("t"), F.lit(0.0))))
    return w.select(EX, "word", F.log(F.greatest("p", F.lit(floor))).alias("log_p"))
