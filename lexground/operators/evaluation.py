"""Scores of alignments, segments, discovered classes and symbol sequences, each as a table of one or a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..functions.sequences import distance_sums, edit_counts_of
from .timeline import EX, interval_join, interval_overlap, iou


def harmonic(p, r):
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def confusion(labels: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """(pred, gold, n, share), share within the gold column."""
    c = labels.groupBy(F.col(pred).alias("pred"), F.col(gold).alias("gold")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gold")))


def purity(counts: DataFrame) -> DataFrame:
    """Mean over gold classes of the largest share."""
    return counts.groupBy("gold").agg(F.max("share").alias("m")).agg(F.avg("m").alias("purity"))


def cluster_f1(counts: DataFrame) -> DataFrame:
    """recall = mean over gold of max / sum, precision = mean over pred of max / sum, over the classes that occur."""
    r = counts.groupBy("gold").agg((F.max("n") / F.sum("n")).alias("x")).agg(F.avg("x").alias("recall"))
    p = counts.groupBy("pred").agg((F.max("n") / F.sum("n")).alias("x")).agg(F.avg("x").alias("precision"))
    return r.join(p, F.lit(True)).withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def word_confusion(labels: DataFrame) -> DataFrame:
    """The majority predicted label of every gold run (ties: the least label), counted against the gold label."""
    w = Window.partitionBy(EX).orderBy("t")
    change = (~F.col("gold").eqNullSafe(F.lag("gold").over(w)) | F.lag("t").over(w).isNull()).cast("int")
    inside = labels.select(EX, "t", "gold", "pred", change.alias("_c")).withColumn("start", F.sum("_c").over(w))
    votes = inside.groupBy(EX, "start", "gold", "pred").agg(F.count("*").alias("n"))
    major = votes.groupBy(EX, "start", "gold").agg(F.min(F.struct((-F.col("n")).alias("n"), "pred")).alias("best")).select("gold", F.col("best.pred").alias("pred"))
    return confusion(major)


def alignment_f1(labels: DataFrame, max_len: int | None = None, eps: float = 1e-17) -> DataFrame:
    """Harmonic mean over gold classes of the per-class recall."""
    inside = labels if max_len is None else labels.where(F.col("t") < max_len)
    per = inside.groupBy("gold").agg(F.greatest(F.sum((F.col("gold") == F.col("pred")).cast("int")) / F.greatest(F.count("*"), F.lit(1)), F.lit(eps)).alias("recall"))
    return per.agg((F.count("*") / F.sum(1 / F.col("recall"))).alias("f1"))


def alignment_accuracy(pred: DataFrame, gold: DataFrame, pos: str = "t") -> DataFrame:
    """E5: share of the common positions (or frames, after ``expand_to_frames``) on which both agree."""
    both = pred.select(EX, pos, F.col("value").alias("p")).join(gold.select(EX, pos, F.col("value").alias("g")), [EX, pos])
    return both.agg(F.avg((F.col("p") == F.col("g")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def frame_accuracy(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """E5 on frames, of ``(example_idx, start, end, value)``: share of the common frames on which both agree, and their number. The spans of
    a side don't overlap within an example. No frame becomes a row: a sweep over the starts of both sides weighs what lies up to the next one."""
    side = lambda x, name: x.select(EX, F.col("start").alias("at"), F.struct("end", "value").alias(name))
    w = Window.partitionBy(EX).orderBy("at")
    last = lambda name: F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name)
    rows = side(pred, "p").unionByName(side(gold, "g"), allowMissingColumns=True).select("at", F.lead("at").over(w).alias("next"), last("p"), last("g"))
    both = rows.where("p IS NOT NULL AND g IS NOT NULL").select((F.least("next", "p.end", "g.end") - F.col("at")).alias("n"), (F.col("p.value") == F.col("g.value")).alias("same")).where("n > 0")
    known = F.sum(F.when(F.col("same").isNotNull(), F.col("n")))
    return both.agg(F.try_divide(F.sum(F.when(F.col("same"), F.col("n")).when(~F.col("same"), 0)), known).cast("double").alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def word_iou(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean over predicted intervals of the best IoU with a gold interval of the example; without gold intervals 0."""
    p = pred.select(EX, "start", "end").distinct()
    # Intervals apart have an IoU of 0, so only those that meet are joined.
    pairs = interval_join(p, gold.select(EX, F.col("start").alias("rs"), F.col("end").alias("re")))
    best = pairs.groupBy(EX, "start", "end").agg(F.max(iou(F.col("start"), F.col("end"), F.col("rs"), F.col("re"))).alias("best"))
    return best.agg(F.sum("best").alias("s")).join(p.agg(F.count("*").alias("n")), F.lit(True)).select((F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("iou"))


def boundary_f1(pred: DataFrame, gold: DataFrame, tol: int = 2) -> DataFrame:
    """A gold unit is hit if some predicted unit of the example ends within ``tol``; recall over gold, precision over predicted."""
    near = pred.select(EX, F.explode(F.sequence(F.col("end") - tol, F.col("end") + tol)).alias("end"))
    hit = gold.join(near, [EX, "end"], "left_semi").agg(F.count("*").alias("hits"))
    sizes = gold.agg(F.count("*").alias("n_gold")).join(pred.agg(F.count("*").alias("n_pred")), F.lit(True))
    r, p = F.col("hits") / F.col("n_gold"), F.col("hits") / F.col("n_pred")
    return hit.join(sizes, F.lit(True)).select("hits", "n_gold", "n_pred", r.alias("recall"), p.alias("precision"), harmonic(p, r).alias("f1"))


def token_confusion(pred: DataFrame, gold: DataFrame, tol: int = 1, least: float = 0.5, label: str = "label") -> DataFrame:
    """For each gold unit the first predicted unit that matches it at both ends within ``tol`` or has an IoU above ``least``:
    (gold, pred, n).

    Candidates meet by equal keys: starts within ``tol``; and for the IoU, which bounds the ratio of two lengths, the cells that
    both cover on a grid as wide as the predicted unit, to a power of two."""
    p = pred.select(F.col(EX).alias("_ex"), F.col("start").alias("ps"), F.col("end").alias("pe"), F.col(label).alias("pl"))
    g = gold.select(EX, "start", "end", label)
    level = lambda a, b: F.floor(F.log2(F.greatest(F.col(b) - F.col(a), F.lit(1)).cast("double"))).cast("int")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.pow(F.lit(2.0), F.col("_level"))), F.floor(F.col(b) / F.pow(F.lit(2.0), F.col("_level"))))).alias("_cell")
    around = math.ceil(math.log2(1 / least)) if least > 0 else 32
    wide = g.withColumn("_level", F.explode(F.sequence(level("start", "end") - around, level("start", "end") + around))).select("*", cells("start", "end"))
    held = p.withColumn("_level", level("ps", "pe")).select("*", cells("ps", "pe"))
    meet = wide.join(held.withColumnsRenamed({"_level": "_l", "_cell": "_c"}), (F.col(EX) == F.col("_ex")) & (F.col("_level") == F.col("_l")) & (F.col("_cell") == F.col("_c")))
    meet = meet.where(iou(F.col("start"), F.col("end"), F.col("ps"), F.col("pe")) > least)
    at = g.withColumn("_at", F.explode(F.sequence(F.col("start") - tol, F.col("start") + tol)))
    near = at.join(p, (F.col(EX) == F.col("_ex")) & (F.col("_at") == F.col("ps"))).where(F.abs(F.col("end") - F.col("pe")) <= tol)
    names = [EX, "start", "end", label, "ps", "pe", "pl"]
    both = meet.select(*names).union(near.select(*names))
    first = both.groupBy(EX, "start", "end", F.col(label).alias("gold")).agg(F.min_by("pl", F.struct("ps", "pe", "pl")).alias("pred"))
    return first.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def macro_scores(counts: DataFrame, rows: str = "gold", cols: str = "pred") -> DataFrame:
    """recall = mean over columns of max / sum, precision = mean over rows of max / sum."""
    return cluster_f1(counts.select(F.col(cols).alias("gold"), F.col(rows).alias("pred"), "n"))


def boundary_sets(disc: DataFrame, gold: DataFrame) -> DataFrame:
    """Exact boundary scores: onsets (down) and offsets (up) of discovered intervals against gold words."""

    def sides(units: DataFrame) -> tuple[DataFrame, DataFrame]:
        return units.select(EX, F.col("start").alias("b")).distinct(), units.select(EX, F.col("end").alias("b")).distinct()

    down, up = sides(disc)
    g_down, g_up = sides(gold)
    found = down.intersect(g_down).union(up.intersect(g_up)).distinct().agg(F.count("*").alias("found"))
    # Up less down, and down: together the distinct boundaries.
    n = down.union(up).distinct().agg(F.count("*").alias("n_disc"))
    m = g_down.union(g_up).distinct().agg(F.count("*").alias("n_gold"))
    p, r = F.col("found") / F.col("n_disc"), F.col("found") / F.col("n_gold")
    return found.join(n, F.lit(True)).join(m, F.lit(True)).select("found", "n_disc", "n_gold", p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"))


def transcribe(intervals: DataFrame, phones: DataFrame, least: float = 3, share: float = 0.5) -> DataFrame:
    """Phone string and phone-exact onset and offset of each interval: phones (example_idx, start, end, phone) overlapped by at
    least ``least`` frames or ``share`` of their length."""
    over = interval_overlap(F.col("start"), F.col("end"), F.col("ps"), F.col("pe"))
    pairs = interval_join(intervals, phones.select(EX, F.col("start").alias("ps"), F.col("end").alias("pe"), "phone"), "ps", "pe")
    inside = pairs.where((F.col("ps") < F.col("end")) & (F.col("pe") > F.col("start")) & ((over >= least) | (over >= share * (F.col("pe") - F.col("ps")))))
    keys = intervals.columns
    return inside.groupBy(*keys).agg(F.min("ps").alias("onset"), F.max("pe").alias("offset"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ps", "phone"))), lambda x: x["phone"]), ",").alias("ngram"))


def grouping(disc: DataFrame) -> DataFrame:
    """Grouping precision and recall of ``disc(class_id, example_idx, onset, offset, ngram)``.

    Pairs are never formed: a token belongs to a pair set if it has one qualifying partner, which counts per type, per class
    and per example tell. Two tokens overlap if they share time in one example.
    """
    t = cut(disc.select("class_id", EX, "onset", "offset", "ngram").distinct(), "grouping")  # read by four branches
    token = F.struct(EX, "onset", "offset")

    def partnered(keys: list[str]) -> DataFrame:
        """Tokens with another one under ``keys``, in another example or apart in time."""
        own = t.select(*keys, EX, "onset", "offset", *(["ngram"] if "ngram" not in keys else [])).distinct()
        files = own.groupBy(*keys).agg(F.countDistinct(EX).alias("_files"))
        local = own.groupBy(*keys, EX).agg(F.min("offset").alias("_first_end"), F.max("onset").alias("_last_start"))
        both = own.join(files, keys).join(local, [*keys, EX])
        return both.where((F.col("_files") > 1) | (F.col("_first_end") <= F.col("onset")) | (F.col("_last_start") >= F.col("offset"))).drop("_files", "_first_end", "_last_start")

    sizes = t.groupBy("class_id").agg(F.count("*").alias("_k")).where("_k > 1")
    found = t.join(sizes, "class_id", "left_semi").groupBy("ngram").agg(F.countDistinct(token).alias("n_found"))
    gold = partnered(["ngram"]).groupBy("ngram").agg(F.countDistinct(token).alias("n_gold"))
    both = partnered(["class_id", "ngram"]).groupBy("ngram").agg(F.countDistinct(token).alias("n_both"))
    all_types = found.join(gold, "ngram", "full").join(both, "ngram", "left").fillna(0)
    sums = all_types.agg(F.sum("n_found").alias("f"), F.sum("n_gold").alias("g"), F.sum(F.when(F.col("n_found") > 0, F.col("n_both"))).alias("bf"), F.sum(F.when(F.col("n_gold") > 0, F.col("n_both"))).alias("bg"))
    # The weight n(t) / sum n cancels the denominator n(t).
    p, r = F.coalesce(F.col("bf") / F.col("f"), F.lit(0.0)), F.coalesce(F.col("bg") / F.col("g"), F.lit(0.0))
    return sums.select(p.alias("precision"), r.alias("recall"), harmonic(p, r).alias("f1"))


def token_type(intervals: DataFrame, words: DataFrame) -> DataFrame:
    """Token and type scores of ``intervals(example_idx, start, end, ngram)`` against ``words(example_idx, start, end, ngram)``:
    the word of largest overlap counts, once, if its phones are the interval's."""
    over = interval_overlap(F.col("start"), F.col("end"), F.col("ws"), F.col("we"))
    pairs = interval_join(intervals, words.select(EX, F.col("start").alias("ws"), F.col("end").alias("we"), F.col("ngram").alias("wn")), "ws", "we")
    best = pairs.where((F.col("ws") < F.col("end")) & (F.col("we") > F.col("start")))
    best = best.groupBy(EX, "start", "end", "ngram").agg(F.min_by(F.struct("ws", "we", "wn"), F.struct(-over, "ws")).alias("b")).where("b.wn = ngram")
    hits = best.agg(F.countDistinct(EX, "b.ws", "b.we").alias("hits"), F.countDistinct("ngram").alias("type_hits"))
    n = intervals.agg(F.count("*").alias("n_intervals"), F.countDistinct("ngram").alias("n_types"))
    m = words.agg(F.count("*").alias("n_words"), F.countDistinct("ngram").alias("n_word_types"))
    tp, tr = F.col("hits") / F.col("n_intervals"), F.col("hits") / F.col("n_words")
    yp, yr = F.col("type_hits") / F.col("n_types"), F.col("type_hits") / F.col("n_word_types")
    one = hits.join(n, F.lit(True)).join(m, F.lit(True))
    return one.select(tp.alias("token_precision"), tr.alias("token_recall"), harmonic(tp, tr).alias("token_f1"), yp.alias("type_precision"), yr.alias("type_recall"), harmonic(yp, yr).alias("type_f1"))


def coverage(disc: DataFrame, phones: DataFrame) -> DataFrame:
    """Share of gold phones covered by some interval."""
    d = disc.select(EX, "start", "end", F.lit(0).alias("_side"))
    both = d.unionByName(phones.select(EX, "start", "end", F.lit(1).alias("_side")))
    # A sweep: the farthest end of the intervals that have begun, those that begin with the phone included.
    begun = Window.partitionBy(EX).orderBy("start", "_side").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_to", F.max(F.when(F.col("_side") == 0, F.col("end"))).over(begun)).where("_side = 1")
    return swept.agg(F.count(F.when(F.col("_to") >= F.col("end"), 1)).alias("covered"), F.count("*").alias("n")).select("covered", "n", (F.col("covered") / F.col("n")).alias("coverage"))


def ned(disc: DataFrame, tokens: str = "phones", block: int = 1000) -> DataFrame:
    """Mean over the pairs of each class of edit distance over longer length, ``disc(class_id, phones ARRAY)``.

    Members with equal strings are counted, not paired: only distinct strings of a class meet, weighted by their counts. The
    strings of a large class are dealt to blocks of about ``block``, and each pair of blocks is one task's work: the strings of one block
    are measured against the prefix trie of the other's, one row of the table for each node. Without a pair the mean is null.
    """
    s = cut(disc.groupBy("class_id", F.col(tokens).alias("a")).agg(F.count("*").alias("n")), "ned")
    same = s.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"), F.lit(0.0).alias("total"))
    blocks = s.groupBy("class_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = s.join(blocks, "class_id").withColumn("here", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    # Each pair of blocks once, the smaller number on the left.
    left = own.select("class_id", "a", "n", F.col("here").alias("i"), F.explode(F.sequence(F.col("here"), F.col("blocks") - 1)).alias("j"))
    right = own.select(F.col("class_id").alias("_c"), F.col("a").alias("b"), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), F.col("here"))).alias("_i"), F.col("here").alias("_j"))

    def measure(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"pairs": [], "total": []})
        some, many = ([tuple(v) if v is not None else () for v in side] for side in (x["a"], y["b"]))
        equal = x["i"].iloc[0] == x["j"].iloc[0]
        pairs, total = distance_sums(some, x["n"].to_numpy(), some if equal else many, (x["n"] if equal else y["m"]).to_numpy(), equal)
        return pd.DataFrame({"pairs": [pairs], "total": [total]})

    diff = left.groupBy("class_id", "i", "j").cogroup(right.groupBy("_c", "_i", "_j")).applyInPandas(measure, "pairs double, total double")
    return same.union(diff).agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total")).select(F.col("pairs").cast("long").alias("pairs"), F.try_divide("total", "pairs").alias("ned"))


def error_rate(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Total distance, its parts, and the rate over the total reference length."""
    e = pairs.select(F.size(ref).alias("n"), edit_counts_of(ref, hyp).alias("e"))
    sums = e.agg(F.sum("n").alias("ref_length"), *[F.sum(f"e.{c}").alias(c) for c in ("correct", "substitutions", "deletions", "insertions")])
    d = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return sums.withColumns({"distance": d, "rate": d / F.greatest("ref_length", F.lit(1))})


def ctc_collapse(scores: DataFrame, blank: int = 0) -> DataFrame:
    """Best symbol per frame (ties: the least), repeats and blanks dropped: (example_idx, pos, symbol) of
    ``scores(example_idx, t, class, value)``."""
    best = scores.groupBy(EX, "t").agg(F.max_by("class", F.struct("value", -F.col("class"))).alias("symbol"))
    w = Window.partitionBy(EX).orderBy("t")
    kept = best.withColumn("_b", F.lag("symbol").over(w)).where((F.col("_b").isNull() | (F.col("_b") != F.col("symbol"))) & (F.col("symbol") != blank))
    return kept.select(EX, (F.row_number().over(w) - 1).alias("pos"), "symbol")


def prf(counts: DataFrame, hits: str, found: str, gold: str, floor: float = 1e-17, halve: bool = False) -> DataFrame:
    """Precision, recall and F1 from counts, with a floor under the denominators; ``halve`` halves the recall."""
    p = F.col(hits) / F.greatest(F.col(found).cast("double"), F.lit(floor))
    r = F.col(hits) / F.greatest(F.col(gold).cast("double"), F.lit(floor)) * (0.5 if halve else 1.0)
    rest = [c for c in counts.columns if c not in (hits, found, gold)]
    return counts.select(*rest, p.alias("precision"), r.alias("recall"), (2 * p * r / F.greatest(p + r, F.lit(floor))).alias("f1"))


def fold_summary(scores: DataFrame, by: str = "model", value: str = "value") -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count("*").alias("folds"))


def roc(scores: DataFrame, concept: str = "concept") -> DataFrame:
    """One point per distinct score of ``scores(concept, truth, score)``: (concept, score, tpr, fpr)."""
    at = scores.groupBy(concept, "score").agg(F.sum(F.col("truth").cast("int")).alias("pos"), F.sum(1 - F.col("truth").cast("int")).alias("neg"))
    w, every = Window.partitionBy(concept).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(concept)
    return at.select(concept, "score", (F.sum("pos").over(w) / F.greatest(F.sum("pos").over(every), F.lit(1))).alias("tpr"), (F.sum("neg").over(w) / F.greatest(F.sum("neg").over(every), F.lit(1))).alias("fpr"))


def class_accuracy(labels: DataFrame, k: int = 10) -> DataFrame:
    """Accuracy per gold class, the ``k`` best (ties by name)."""
    per = labels.groupBy("gold").agg(F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return per.orderBy(F.desc("accuracy"), "gold").limit(k)


def posterior_gap(pairs: DataFrame, a: str = "a", b: str = "b", by: str = "iteration") -> DataFrame:
    """Mean absolute difference of two posteriors."""
    return pairs.groupBy(by).agg((F.sum(F.abs(F.col(a) - F.col(b))) / F.count("*")).alias("gap"))
