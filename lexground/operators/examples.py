"""Example, region and split tables. Random choices come from hashes of the key and a seed, so they don't depend on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EX = "example_idx"


def ordered(by: str, *columns: str) -> Column:
    """Values of a group in the order of ``by``, as an array (of one column) or an array of structs."""
    held = F.sort_array(F.collect_list(F.struct(by, *columns)))
    return F.transform(held, lambda x: x[columns[0]]) if len(columns) == 1 else F.transform(held, lambda x: F.struct(*[x[c].alias(c) for c in columns]))


def build_captions(phrases: DataFrame) -> DataFrame:
    """One record per image from ``phrases(image_id, capt_id, pos, phrase, concept, box)``, its first caption only: phrases, concepts
    and boxes in order."""
    first = phrases.groupBy("image_id").agg(F.min("capt_id").alias("capt_id"))
    return phrases.join(first, ["image_id", "capt_id"]).groupBy("image_id", "capt_id").agg(ordered("pos", "phrase").alias("phrases"), ordered("pos", "concept").alias("concepts"), ordered("pos", "box").alias("boxes"))


def gold_from_phrases(phrases: DataFrame) -> DataFrame:
    """(example_idx, start, end, a) from ``phrases(example_idx, pos, n_phones)``: phrase a covers its phones."""
    w = Window.partitionBy(EX).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_phones").over(w), F.lit(0)).cast("int")
    return phrases.select(EX, start.alias("start"), (start + F.col("n_phones")).cast("int").alias("end"), F.col("pos").alias("a"))


def gold_from_concepts(data: DataFrame, concept2idx: DataFrame) -> DataFrame:
    """(example_idx, t, concept_id) of ``data(example_idx, pos, concept, phones ARRAY)``: each phone's concept, '#' skipped."""
    rows = data.select(EX, "pos", "concept", F.posexplode("phones").alias("i", "phone")).where("phone <> '#'").join(concept2idx, "concept")
    return rows.select(EX, (F.row_number().over(Window.partitionBy(EX).orderBy("pos", "i")) - 1).alias("t"), F.col("idx").alias("concept_id"))


def split_by_ids(df: DataFrame, test_ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a table of test ids; null ids train."""
    return df.join(test_ids.select(key), key, "left_anti"), df.join(test_ids.select(key), key, "left_semi")


def split_by_flags(df: DataFrame, flags: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) by ``flags(key, flag)``; rows without a flag are in neither."""
    marked = df.join(flags, key)
    return marked.where("flag = 0").drop("flag"), marked.where("flag = 1").drop("flag")


def assign_folds(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """P5: ``fold`` 0 to k - 1: disjoint and covering, by a hash of the key; fold sizes are equal up to chance."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("int"))


def random_split(df: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """P5: ``is_test`` for ``share`` of the rows."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def add_scene_box(boxes: DataFrame, dims: DataFrame) -> DataFrame:
    """A box of class ``scene`` over the whole image, ``dims(image_id, width, height)``, in front (position 0) of each image's
    boxes, which move up to 1, 2, ... in their order."""
    moved = boxes.withColumn("pos", F.row_number().over(Window.partitionBy("image_id").orderBy("pos", "class", "x", "y", "w", "h")))
    scene = boxes.select("image_id").distinct().join(dims, "image_id").select("image_id", F.lit(0).alias("pos"), F.lit("scene").alias("class"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    return scene.unionByName(moved.select("image_id", "pos", "class", "x", "y", "w", "h"))


def merge_boxes(boxes: DataFrame) -> DataFrame:
    """The hull of an image's boxes of each class."""
    hull = boxes.groupBy("image_id", "class").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    return hull.select("image_id", "class", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))


def concept_times(concepts: DataFrame, words: DataFrame, synonyms: DataFrame, pair: tuple[str, tuple[str, ...]] = ("air", ("plane", "planes"))) -> DataFrame:
    """(example_idx, concept, pos, begin, end) of the first word that is the concept, one of its ``synonyms(concept, word)``, or,
    for the concept ``airplane``, the pair air + plane(s); no such word: nulls."""
    nxt = Window.partitionBy(EX).orderBy("pos")
    w = words.withColumns({"_next": F.lead("word").over(nxt), "_stop": F.lead("end").over(nxt)})
    is_pair = (F.col("word") == pair[0]) & F.col("_next").isin(*pair[1])
    names = synonyms.select("concept", F.col("word").alias("said")).union(concepts.select("concept", F.col("concept").alias("said"))).distinct()
    spoken = w.select(EX, "pos", F.col("word").alias("said"), "begin", "end").join(names, "said").select(EX, "concept", "pos", "begin", "end")
    spoken = spoken.union(w.where(is_pair).select(EX, F.lit("".join((pair[0], pair[1][0]))).alias("concept"), "pos", "begin", F.col("_stop")))
    first = spoken.groupBy(EX, "concept").agg(F.min(F.struct("pos", "begin", "end")).alias("f"))
    return concepts.join(first, [EX, "concept"], "left").select(EX, "concept", "f.pos", "f.begin", "f.end")


def concept_subset(rows: DataFrame, cap: int, by: str = "concept", order: tuple[str, ...] = (EX,)) -> DataFrame:
    """At most ``cap`` rows of each concept, the first in ``order``; the cap is the feature."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= cap).drop("_r")


def power_law_sample(instances: DataFrame, alpha: float, size: int, n: int, seed: int) -> DataFrame:
    """P10: ``size`` examples of ``n`` distinct concepts: (example, concept, instance). Quotas follow 1 / rank**alpha over concepts by
    frequency; a concept's instances are in hash order and none is used twice. Instance r of a concept with an offset of
    earlier quotas goes to example (offset + r) mod size, so an example never gets a concept twice while quotas stay below size. What
    rounding and concepts with few instances leave over goes to the next ranks that have instances left.
    """
    counts = instances.groupBy("concept").agg(F.count("*").alias("k"))
    rank = counts.select("concept", "k", F.row_number().over(Window.orderBy(F.desc("k"), "concept")).alias("r"))
    weighted = rank.withColumn("w", 1 / F.pow(F.col("r").cast("double"), F.lit(alpha)))
    quota = weighted.withColumn("q", F.least(F.col("k"), F.lit(size), F.floor(F.lit(float(size * n)) * F.col("w") / F.sum("w").over(Window.partitionBy()))).cast("long"))
    # Only the table of concepts meets in one task.
    ahead = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    room = quota.withColumn("room", F.least(F.col("k"), F.lit(size)) - F.col("q")).withColumn("over", F.lit(size * n) - F.sum("q").over(Window.partitionBy()))
    quota = room.withColumn("q", F.col("q") + F.least("room", F.greatest(F.lit(0), F.col("over") - F.coalesce(F.sum("room").over(ahead), F.lit(0)))))
    offset = quota.select("concept", "q", F.coalesce(F.sum("q").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    drawn = instances.withColumn("_i", F.row_number().over(Window.partitionBy("concept").orderBy(F.xxhash64("instance", F.lit(seed)), "instance")) - 1)
    return drawn.join(F.broadcast(offset), "concept").where(F.col("_i") < F.col("q")).select(((F.col("o") + F.col("_i")) % size).cast("long").alias("example"), "concept", "instance")


def phones_in_words(data: DataFrame, phones: DataFrame) -> DataFrame:
    """Phones inside chosen word intervals ``data(capt_id, begin, end)``, matched on whole numbers with the word each of
    ``phones(capt_id, word_begin, word_end, i, phone)`` belongs to."""
    w = data.select("capt_id", F.floor("begin").cast("long").alias("b"), F.floor("end").cast("long").alias("e")).distinct()
    p = phones.select("capt_id", F.floor("word_begin").cast("long").alias("b"), F.floor("word_end").cast("long").alias("e"), "i", "phone")
    return p.join(w, ["capt_id", "b", "e"])


def top_regions(regions: DataFrame, n: int) -> DataFrame:
    """At most ``n`` regions per image by ``score``, with the image's class of the best score."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "region")
    best = F.first("class").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return regions.withColumns({"_r": F.row_number().over(w), "best_class": best}).where(F.col("_r") <= n).drop("_r")


def concat_sequences(rows: DataFrame, key: str = "id") -> DataFrame:
    """(id, seq): sequences of one id joined in the order of ``pos``."""
    return rows.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "seq"))), lambda x: x["seq"])).alias("seq"))


def pad_sequences(rows: DataFrame, n: int, seq: str = "tokens", label2id: dict | None = None) -> DataFrame:
    """``n`` label ids (unknown 0, padding -1) and the true length, cut to ``n``."""
    ids = F.create_map(*[F.lit(x) for kv in (label2id or {}).items() for x in kv]) if label2id else None
    found = F.transform(F.slice(seq, 1, n), lambda x: F.coalesce(F.element_at(ids, x), F.lit(0)) if ids is not None else F.lit(0))
    rest = [c for c in rows.columns if c != seq]
    return rows.select(*rest, F.concat(found, F.array_repeat(F.lit(-1), n - F.size(found))).alias("ids"), F.least(F.size(seq), F.lit(n)).alias("length"))


def image_labels(concept2image: DataFrame, ids: DataFrame) -> DataFrame:
    """(image_id, concept) of the chosen images, from ``concept2image(concept, images ARRAY)``."""
    return concept2image.select("concept", F.explode("images").alias("image_id")).join(ids.select("image_id"), "image_id", "left_semi").select("image_id", "concept")


def group_regions(boxes: DataFrame, vectors: DataFrame) -> DataFrame:
    """One sequence per run of equal image id in row order: ``boxes(row, image_id, label)`` and ``vectors(row, vec)`` share ``row``.
    The window is over row numbers in blocks of images: rows of an image are assumed to be within its first and last row."""
    rows = boxes.join(vectors, "row")
    w = Window.partitionBy("image_id").orderBy("row")
    change = (F.col("row") - F.lag("row").over(w) != 1).cast("int")
    marked = rows.withColumn("_c", F.coalesce(change, F.lit(1))).withColumn("_g", F.sum("_c").over(w))
    return marked.groupBy("image_id", "_g").agg(F.min("row").alias("row"), ordered("row", "label").alias("labels"), ordered("row", "vec").alias("vecs")).drop("_g")


def retrieval_subset(df: DataFrame, n: int, seed: int, key: str = EX) -> DataFrame:
    """At most ``n`` rows in hash order; the limit is the feature."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def one_caption(df: DataFrame, seed: int | None = None, image: str = "image_id", order: str = "caption_idx") -> DataFrame:
    """One caption per image: the first, or with ``seed`` a random one."""
    by = F.struct(order) if seed is None else F.struct(F.xxhash64(image, order, F.lit(seed)), F.col(order))
    rest = [c for c in df.columns if c != image]
    return df.groupBy(image).agg(F.min_by(F.struct(*rest), by).alias("_c")).select(image, "_c.*")


def majority_alignment(gold: DataFrame, alignment: str = "alignment") -> DataFrame:
    """Every position aligned to concept 0."""
    return gold.withColumn(alignment, F.transform(alignment, lambda x: x * 0))


def image_caption_pairs(labels: DataFrame, words: DataFrame) -> DataFrame:
    """For each ``labels(image_id, region, text)`` the first of ``words(image_id, pos, word, begin, end)`` equal to the label's last
    word; none: -1."""
    last = labels.withColumn("word", F.lower(F.element_at(F.split("text", " "), -1)))
    first = words.groupBy("image_id", "word").agg(F.min(F.struct("pos", "begin", "end")).alias("f"))
    found = last.join(first, ["image_id", "word"], "left")
    return found.select("image_id", "region", "word", *[F.coalesce(F.col(f"f.{c}"), F.lit(-1)).alias(c) for c in ("begin", "end")])


def pair_records(annotations: DataFrame, categories: DataFrame, captions: DataFrame) -> DataFrame:
    """P20: (image_id, boxes, captions): annotations (image_id, ann_id, category_id, x, y, w, h) with category names, blanks as '_'."""
    named = annotations.join(categories, "category_id").withColumn("class", F.translate("name", " ", "_"))
    boxes = named.groupBy("image_id").agg(ordered("ann_id", "class", "x", "y", "w", "h").alias("boxes"))
    texts = captions.groupBy("image_id").agg(ordered("caption_idx", "caption").alias("captions"))
    return boxes.join(texts, "image_id", "full")


def sampled_boxes(examples: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes of the images of ``examples(example_idx, images ARRAY)``, in example and image order: (example_idx, i, image_id, ...)."""
    return examples.select(EX, F.posexplode("images").alias("i", "image_id")).join(boxes, "image_id")


def prepare_regions(vectors: DataFrame, ids: DataFrame, dim: int, null: bool = False, permute: bool = False, seed: int = 0) -> DataFrame:
    """(example_idx, pos, idx, vec): with ``null`` a zero region in front (idx -1), with ``permute`` in a seeded order; ``idx`` keeps
    the old place; an example without regions gets one zero vector."""
    zero = F.array_repeat(F.lit(0.0), dim)
    front = ids.select(EX, F.lit(-1).alias("idx"), zero.alias("vec"))
    rows = vectors.select(EX, "idx", "vec")
    missing = ids.select(EX).join(rows.select(EX).distinct(), EX, "left_anti").select(EX, F.lit(-1).alias("idx"), zero.alias("vec"))
    rows = rows.union(front if null else missing)
    key = F.when(F.col("idx") < 0, F.lit(-(2**63))).otherwise(F.xxhash64(EX, "idx", F.lit(seed))) if permute else F.col("idx").cast("long")
    return rows.select(EX, (F.row_number().over(Window.partitionBy(EX).orderBy(key, "idx")) - 1).alias("pos"), "idx", "vec")


def _uniform(*key: object) -> Column:
    return (F.pmod(F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in key]), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def normal(*key: object) -> Column:
    """A standard normal number from a hash of ``key`` (Box and Muller)."""
    return F.sqrt(-2 * F.log(_uniform(*key, 1))) * F.cos(2 * math.pi * _uniform(*key, 2))


def synthetic_vectors(rows: DataFrame, dim: int, seed: int, scale: float = 10.0, noise: float = 0.1) -> DataFrame:
    """A vector for each ``rows(example_idx, idx, concept)``: the concept's centroid, ``scale`` * N(0, 1), plus ``noise`` * N(0, 1)."""
    center = lambda d: scale * normal(F.col("concept"), d, F.lit(seed))
    own = lambda d: noise * normal(F.col(EX), F.col("idx"), d, F.lit(seed + 1))
    return rows.withColumn("vec", F.array(*[center(F.lit(d)) + own(F.lit(d)) for d in range(dim)]))


def one_hot(rows: DataFrame, dim: int) -> DataFrame:
    """One-hot vectors of integer concepts."""
    return rows.withColumn("vec", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (i == F.col("concept")).cast("double")))
