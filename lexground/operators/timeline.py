"""Alignments, segments, landmarks and frames: tables over a time axis within each example.

Intervals are half open. Every window is partitioned by the example, so one shuffle by ``example_idx`` serves them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packed as pk
from ..functions.ranking import numbered

EX = "example_idx"
#: Segments that a task works on at once, but for those of one text.
MOST = 250_000


def runs(alignment: DataFrame, value: str = "value", pos: str = "t") -> DataFrame:
    """maximal runs of equal values: (example_idx, start, end, <value>). No run is lost, a last one of length one included."""
    w = Window.partitionBy(EX).orderBy(pos)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(pos).over(w).isNull()).cast("int")
    marked = alignment.select(EX, pos, value, change.alias("_c"))
    return marked.withColumn("_g", F.sum("_c").over(w)).groupBy(EX, "_g", value).agg(F.min(pos).cast("int").alias("start"), (F.max(pos) + 1).cast("int").alias("end")).select(EX, "start", "end", value)


def to_units(alignment: DataFrame, durations: DataFrame | None = None, value: str = "value", drop: object = None) -> DataFrame:
    """runs as units; with ``durations(example_idx, t, dur)`` start and end are frames. Label ``drop`` is left out."""
    units = runs(alignment, value)
    if durations is not None:
        w = Window.partitionBy(EX).orderBy("t")
        ends = durations.select(EX, "t", F.sum("dur").over(w).cast("long").alias("stop"), F.col("dur"))
        begin = ends.select(EX, F.col("t").alias("start"), (F.col("stop") - F.col("dur")).alias("f0"))
        stop = ends.select(EX, (F.col("t") + 1).alias("end"), F.col("stop").alias("f1"))
        units = units.join(begin, [EX, "start"]).join(stop, [EX, "end"]).select(EX, F.col("f0").alias("start"), F.col("f1").alias("end"), value)
    return units if drop is None else units.where(F.col(value) != drop)


def to_classes(alignment: DataFrame, length: DataFrame | None = None, value: str = "value") -> DataFrame:
    """(class_id, example_idx, start, end, label). Alignments shorter than ``length(example_idx, n)`` are extended by their last
    value, longer ones cut. Classes are numbered in order of their label's first place."""
    found = runs(alignment, value)
    if length is not None:
        last = F.row_number().over(Window.partitionBy(EX).orderBy(F.desc("start"))) == 1
        found = found.join(length, EX).where(F.col("start") < F.col("n")).withColumn("end", F.when(last, F.col("n")).otherwise(F.least("end", "n")).cast("int")).drop("n")
    return number_classes(found.withColumnRenamed(value, "label"))


def number_classes(found: DataFrame, label: str = "label") -> DataFrame:
    """Class numbers by first appearance (example, then start); only the distinct labels are ranked."""
    first = found.groupBy(label).agg(F.min(F.struct(EX, "start")).alias("_first"))
    ids = numbered(first, "_first", label, name="class_id").select(label, (F.col("class_id") + 1).cast("int").alias("class_id"))
    return found.join(ids, label).select("class_id", EX, "start", "end", label)


def segmented_to_classes(segments: DataFrame, lengths: DataFrame) -> DataFrame:
    """``segments(example_idx, pos, segment)``, units joined by ',', to intervals; clipped at ``lengths(example_idx, n)``, and
    what a text leaves uncovered is labelled NULL."""
    texts = segments.groupBy(EX).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "segment"))), lambda x: x["segment"]).alias("segments"))
    return texts_to_classes(texts.join(lengths, EX))


def texts_to_classes(texts: DataFrame) -> DataFrame:
    """F4 of ``texts(example_idx, segments ARRAY, n)``: a text's places are found in its own row, so no segment is moved."""
    ddl = f"{EX} {texts.schema[EX].dataType.simpleString()}, start int, end int, label string"
    schema = texts.sparkSession.createDataFrame([], ddl).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column("n").is_valid())
            for lo, hi in pk.groups(np.diff(pk.lists(whole.column("segments"))[0]), MOST):
                b = whole.slice(lo, hi - lo)
                offsets, label = pk.lists(b.column("segments"))
                of, n = np.repeat(np.arange(b.num_rows), np.diff(offsets)), b.column("n").to_numpy()
                size = pc.add(pc.count_substring(label, ","), 1).fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.r_[0, np.cumsum(size)]
                end = ends[1:] - ends[offsets[:-1]][of]
                inside = (size > 0) & (end - size < n[of])
                covered = ends[offsets[1:]] - ends[offsets[:-1]]
                rest = (covered > 0) & (covered < n)
                for own, start, to, name in ((of[inside], (end - size)[inside], np.minimum(end, n[of])[inside], label.filter(pa.array(inside))), (np.flatnonzero(rest), covered[rest], n[rest], pa.array(["NULL"] * int(rest.sum()), pa.string()))):
                    columns = [b.column(EX).take(pa.array(own)), pa.array(start, pa.int32()), pa.array(to, pa.int32()), name]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.select(EX, "segments", "n").mapInArrow(run, ddl)


def segments_to_classes(boundaries: DataFrame, label: str | None = None) -> DataFrame:
    """ascending ``boundaries(example_idx, pos, frame[, label])`` to intervals between neighbours; without labels one class."""
    w = Window.partitionBy(EX).orderBy("pos")
    out = boundaries.select(EX, F.col("frame").alias("start"), F.lead("frame").over(w).alias("end"), (F.col(label) if label else F.lit("0")).alias("label"))
    return out.where("end is not null and end > start")


def to_phone_classes(segments: DataFrame, label: str = "label") -> DataFrame:
    """a hierarchical label (units joined by ',') to one row for each unit from ``start`` on."""
    return segments.select(EX, "start", F.posexplode(F.split(label, ",")).alias("_i", "label")).select(EX, (F.col("start") + F.col("_i")).alias("start"), (F.col("start") + F.col("_i") + 1).alias("end"), "label")


def alignment_clusters(alignment: DataFrame, concept: str = "concept", phone: str = "phone") -> DataFrame:
    """(concept, phrase, n): distinct phrases, phones joined by ',', of the runs of every concept; a null concept is 0."""
    known = alignment.withColumn(concept, F.coalesce(F.col(concept), F.lit("0")))
    w = Window.partitionBy(EX).orderBy("t")
    group = F.sum((~F.col(concept).eqNullSafe(F.lag(concept).over(w)) | F.lag("t").over(w).isNull()).cast("int")).over
    marked = known.withColumn("_g", group(w))
    phrases = marked.groupBy(EX, "_g", concept).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", phone))), lambda x: x[phone]), ",").alias("phrase"))
    return phrases.groupBy(concept, "phrase").agg(F.count("*").alias("n"))


def boundaries_to_segments(bits: DataFrame) -> DataFrame:
    """F8: a 0/1 vector ``(example_idx, t, bit)`` to segments that end after each set position; empty ones are dropped."""
    w = Window.partitionBy(EX).orderBy("t")
    ends = bits.where("bit <> 0 and t > 0").select(EX, "t")
    return ends.select(EX, F.coalesce(F.lag("t").over(w), F.lit(0)).alias("start"), F.col("t").alias("end"))


def segments_to_frames(segments: DataFrame, landmarks: DataFrame) -> DataFrame:
    """segments in landmark numbers to frames, by ``landmarks(example_idx, lm_idx, frame)``."""
    a = landmarks.select(EX, F.col("lm_idx").alias("start"), F.col("frame").alias("f0"))
    b = landmarks.select(EX, F.col("lm_idx").alias("end"), F.col("frame").alias("f1"))
    rest = [c for c in segments.columns if c not in (EX, "start", "end")]
    return segments.join(a, [EX, "start"]).join(b, [EX, "end"]).select(EX, F.col("f0").alias("start"), F.col("f1").alias("end"), *rest)


def segments_to_landmarks(segments: DataFrame) -> DataFrame:
    """(example_idx, lm_idx, frame): 0 and the ends of all segments that are not empty."""
    frames = segments.where(F.col("end") > F.col("start")).select(EX, F.col("end").alias("frame")).union(segments.select(EX, F.lit(0).alias("frame"))).distinct()
    return frames.select(EX, (F.row_number().over(Window.partitionBy(EX).orderBy("frame")) - 1).alias("lm_idx"), "frame")


def times_to_frames(times: DataFrame, frames: DataFrame, fs: float, max_frames: int = 2000) -> DataFrame:
    """boundaries in seconds (example_idx, pos, t) to landmarks: the frame over the sample ``min(int(t*fs), len-1)``, plus one,
    kept only if the frame exceeds the last landmark kept; the last landmark is min(frames, max_frames). A leading 0 is set."""
    size = frames.groupBy(EX).agg(F.max("s1").alias("len"), F.count("*").alias("n"))
    at = times.join(size, EX).withColumn("sample", F.least((F.col("t") * fs).cast("long"), F.col("len") - 1))
    inside = at.join(frames, (at[EX] == frames[EX]) & (F.col("sample") >= F.col("s0")) & (F.col("sample") < F.col("s1"))).select(at[EX], "pos", "frame", "n")
    packed = inside.groupBy(EX, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "frame"))), lambda x: x["frame"].cast("int")).alias("raw"))
    kept = F.aggregate("raw", F.array(F.lit(0)), lambda acc, f: F.when(f > F.element_at(acc, -1), F.concat(acc, F.array(f + 1))).otherwise(acc))
    top = F.least("n", F.lit(max_frames)).cast("int")
    capped = F.array_distinct(F.transform(kept, lambda x: F.least(x, top)))
    return packed.select(EX, F.posexplode(capped).alias("lm_idx", "frame"))


def resample(alignment: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """an alignment (example_idx, frame, a) over ``source`` frames to ``target`` frames: the last source frame that overlaps
    wins; none: 0. Samples past the target belong to its last frame."""
    s = source.join(alignment, [EX, "frame"])
    end = target.groupBy(EX).agg(F.max("frame").alias("_last"))
    t = target.join(end, EX).withColumn("_stop", F.when(F.col("frame") == F.col("_last"), F.lit(2**62)).otherwise(F.col("s1")))
    s = s.select(F.col(EX).alias("_ex"), F.col("frame").alias("_src"), F.col("s0").alias("_a"), F.col("s1").alias("_b"), "a")
    over = t.join(s, (F.col(EX) == F.col("_ex")) & (F.col("_a") < F.col("_stop")) & (F.col("_b") > F.col("s0")), "left")
    return over.groupBy(EX, "frame").agg(F.coalesce(F.max_by("a", "_src"), F.lit(0)).alias("a"))


def unit_spans(alignment: DataFrame, value: str = "value", dur: str = "dur") -> DataFrame:
    """(example_idx, start, end, value): the frames of each unit that has any."""
    w = Window.partitionBy(EX).orderBy("t")
    ends = alignment.withColumn("_e", F.sum(dur).over(w)).where(F.col(dur) > 0)
    return ends.select(EX, (F.col("_e") - F.col(dur)).alias("start"), F.col("_e").alias("end"), value)


def expand_to_frames(alignment: DataFrame, value: str = "value", dur: str = "dur") -> DataFrame:
    """each unit repeated over its duration: (example_idx, frame, value)."""
    return unit_spans(alignment, value, dur).select(EX, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("frame"), value)


def gold_landmarks(phones: DataFrame, hop_ms: int = 10, level: str = "phone", skip: str = "#") -> DataFrame:
    """landmarks from phones in ms (example_idx, t, word, value, begin, end): running sum of max(end - begin, hop) by hop;
    ``level='word'`` keeps the last of each word. Units named ``skip`` take no time."""
    w = Window.partitionBy(EX).orderBy("t")
    real = phones.where(F.col("value") != skip).select(EX, "t", "word", F.greatest(F.col("end") - F.col("begin"), F.lit(hop_ms)).alias("d"))
    ends = real.select(EX, "t", "word", F.floor(F.sum("d").over(w) / hop_ms).cast("int").alias("frame"))
    if level == "word":
        ends = ends.groupBy(EX, "word").agg(F.max("frame").alias("frame"))
    out = ends.select(EX, "frame").union(ends.select(EX, F.lit(0))).distinct()
    return out.select(EX, (F.row_number().over(Window.partitionBy(EX).orderBy("frame")) - 1).alias("lm_idx"), "frame")


def frame_map(lengths: DataFrame, frames: str = "n", samples: str = "len") -> DataFrame:
    """(example_idx, frame, s0, s1): ``n`` equal parts of ``len`` samples, the last takes the remainder."""
    step = F.floor(F.col(samples) / F.col(frames))
    cut = lengths.where(F.col(frames) > 0).select(EX, frames, samples, step.alias("_s"), F.explode(F.sequence(F.lit(0), F.col(frames) - 1)).alias("frame"))
    return cut.select(EX, "frame", (F.col("frame") * F.col("_s")).cast("long").alias("s0"), F.when(F.col("frame") == F.col(frames) - 1, F.col(samples)).otherwise((F.col("frame") + 1) * F.col("_s")).cast("long").alias("s1"))


def candidates(landmarks: DataFrame, least: int = 2, most: int = 11) -> DataFrame:
    """F16: segments of ``least`` to ``most`` landmarks: (example_idx, start, end, seg_id, dur); id of [s, e) is e(e-1)/2 + s. The
    length is bounded before anything is exploded."""
    n = Window.partitionBy(EX)
    begin = landmarks.select(EX, F.col("lm_idx").alias("start"), F.col("frame").alias("f0"), F.max("lm_idx").over(n).alias("n"))
    begin = begin.where(F.col("start") + max(least, 1) <= F.col("n"))
    spans = begin.select(EX, "start", "f0", F.explode(F.sequence(F.col("start") + max(least, 1), F.least("n", F.col("start") + most))).alias("end"))
    stop = landmarks.select(EX, F.col("lm_idx").alias("end"), F.col("frame").alias("f1"))
    return spans.join(stop, [EX, "end"]).select(EX, "start", "end", F.expr("cast(end as long) * (end - 1) div 2 + start").alias("seg_id"), (F.col("f1") - F.col("f0")).alias("dur"))


def preemphasis(signal: DataFrame, c: float = 0.97) -> DataFrame:
    """y[t] - c * y[t-1]; the first sample stays."""
    before = F.lag("y").over(Window.partitionBy(EX).orderBy("t"))
    return signal.select(EX, "t", (F.col("y") - F.coalesce(before * c, F.lit(0.0))).alias("y"))


def cmvn(frames: DataFrame, by: str, floor: float = 1e-20) -> DataFrame:
    """mean and variance normalisation of ``vec`` within ``by``: (keys, dim, value); the deviation is floored."""
    keys = [c for c in frames.columns if c != "vec"]
    dims = frames.select(*keys, F.posexplode("vec").alias("dim", "x"))
    stats = dims.groupBy(by, "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    return dims.join(stats, [by, "dim"]).select(*keys, "dim", ((F.col("x") - F.col("m")) / F.greatest("d", F.lit(floor))).alias("value"))


def pool_mean(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """F20, mean: average of the vectors of a segment's frames: (example_idx, start, end, dim, value)."""
    inside = segments.join(frames.withColumnRenamed(EX, "_ex"), (F.col(EX) == F.col("_ex")) & (F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end")))
    return inside.select(EX, "start", "end", F.posexplode("vec").alias("dim", "x")).groupBy(EX, "start", "end", "dim").agg(F.avg("x").alias("value"))


def pool_last(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """F20, last: the vector of a segment's last frame."""
    return segments.join(frames.select(EX, (F.col("idx") + 1).alias("end"), "vec"), [EX, "end"]).select(EX, "start", "end", "vec")


def concept_segments(segments: DataFrame, alignment: DataFrame, null: object = 0, share: float = 0.5) -> DataFrame:
    """segments of whose positions more than ``share`` are aligned to a real concept."""
    a = alignment.select(F.col(EX).alias("_ex"), F.col("t"), (F.col("value") != null).cast("double").alias("real"))
    inside = segments.join(a, (F.col(EX) == F.col("_ex")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    return inside.groupBy(EX, "start", "end").agg(F.avg("real").alias("share")).where(F.col("share") > share)


def snap_boundaries(bounds: DataFrame, landmarks: DataFrame) -> DataFrame:
    """each boundary (example_idx, b) to its nearest landmark, the lower of two: the last landmark up to it and the first from
    it on, by one running value in either direction."""
    both = landmarks.select(EX, F.col("frame").alias("p"), F.col("frame").alias("lm"), F.lit(None).cast("long").alias("b")).union(bounds.select(EX, F.col("b"), F.lit(None).cast("long"), F.col("b")))
    run = lambda order: F.last("lm", ignorenulls=True).over(Window.partitionBy(EX).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    near = both.withColumns({"lo": run(F.col("p").asc()), "hi": run(F.col("p").desc())}).where("b is not null")
    lower = F.col("hi").isNull() | (F.col("b") - F.col("lo") <= F.col("hi") - F.col("b"))
    return near.select(EX, "b", F.when(lower & F.col("lo").isNotNull(), F.col("lo")).otherwise(F.col("hi")).alias("frame"))


def top_concept_spans(spans: DataFrame, n: int, least: int = 1600) -> DataFrame:
    """spans (concept, example_idx, s0, s1) of the ``n`` most frequent concepts after the first, longer than ``least``."""
    counts = spans.groupBy("concept").agg(F.count("*").alias("k"))
    rank = counts.select("concept", F.row_number().over(Window.orderBy(F.desc("k"), "concept")).alias("r")).where((F.col("r") >= 2) & (F.col("r") <= n + 1))
    return spans.join(F.broadcast(rank), "concept").where(F.col("s1") - F.col("s0") > least).select("concept", EX, "s0", "s1")


def interval_join(left: DataFrame, right: DataFrame, start: str = "rs", end: str = "re") -> DataFrame:
    """Pairs of intervals of ``left(example_idx, start, end, ...)`` and ``right(example_idx, <start>, <end>, ...)`` of one example that meet, or touch:
    all columns of both sides, the example's once. Other columns must not share a name. Rows that repeat pair each.

    Pairs come together by equal keys, cells of a grid. A right interval lies on a grid as wide as itself, to a power of two, or as wide as
    the mean right interval if it is shorter, so it is in three cells at most; a left interval looks into the cells that it covers on the
    grids that have right intervals. So a long example is spread over many keys, and a pair is kept in the cell of the later start
    alone. Only the grids' widths come to the driver, at most 64 numbers."""
    width = F.greatest(F.col(end) - F.col(start), F.lit(1)).cast("double")
    own = F.floor(F.log2(width)).cast("int")
    found = [r for r in right.groupBy(own.alias("l")).agg(F.count("*").alias("n"), F.sum(width).alias("s")).collect() if r.l is not None]
    least = math.floor(math.log2(sum(r.s for r in found) / sum(r.n for r in found))) if found else 0
    levels = sorted({max(r.l, least) for r in found})
    placed = right.withColumn("_level", F.greatest(own, F.lit(least)))
    cell = lambda at: F.floor(at / F.pow(F.lit(2.0), F.col("_level").cast("double")))
    cells = lambda a, b: F.explode(F.sequence(cell(F.col(a)), cell(F.col(b)))).alias("_cell")
    held = placed.select("*", cells(start, end))
    asks = left.withColumn("_level", F.explode(F.lit(levels).cast("array<int>"))).select("*", cells("start", "end"))
    both = asks.join(held, [EX, "_level", "_cell"])
    once = cell(F.greatest(F.col("start"), F.col(start))) == F.col("_cell")
    return both.where(once & (F.col(start) <= F.col("end")) & (F.col(end) >= F.col("start"))).drop("_level", "_cell")


def interval_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over hull; 1 if both are the same empty interval, 0 if they are apart."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull == 0, F.lit(1.0)).otherwise(interval_overlap(s1, e1, s2, e2) / hull)
