"""Text formats. Line numbers come from the place of a line in its file and of the file among the paths, per block of the
file, so that no window ever holds more than one block."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EX = "example_idx"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): all lines below ``path``, numbered from 0 through the files in the order of their names."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")) - 1)
    blocks = rows.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    # One row per block of a file: the running sum is over the table of blocks.
    offset = blocks.select("_f", "_b", F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return rows.join(offset, ["_f", "_b"]).select((F.col("_o") + F.col("_k")).alias("line"), "value")


def write_lines(df: DataFrame, path: str, order: list[str], value: str = "value") -> None:
    """Text files whose names and lines follow ``order``; ranges of it are written in parallel, as many as the session shuffles into."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(value).write.text(path)


def read_captions(spark: SparkSession, path: str, multiple: bool = False) -> DataFrame:
    """(example_idx, caption_idx, tokens): a caption a line, blank-separated; with ``multiple`` commas separate several. An empty
    caption is [NULL]."""
    lines = numbered_lines(spark, path)
    parts = F.split("value", ",") if multiple else F.array("value")
    rows = lines.select(F.col("line").alias(EX), F.posexplode(parts).alias("caption_idx", "text"))
    words = F.filter(F.split(F.trim("text"), " +"), lambda x: x != "")
    return rows.select(EX, "caption_idx", F.when(F.size(words) == 0, F.array(F.lit("NULL"))).otherwise(words).alias("tokens"))


def read_phrase_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(line, capt_id, words, box) of lines ``id words... x y w h``."""
    p = F.split("value", " ")
    rows = numbered_lines(spark, path).select("line", p.alias("p")).where(F.size("p") >= 5)
    box = F.struct(*[F.element_at("p", i).cast("double").alias(n) for i, n in ((-4, "x"), (-3, "y"), (-2, "w"), (-1, "h"))])
    return rows.select("line", F.col("p")[0].alias("capt_id"), F.slice("p", F.lit(2), F.size("p") - 5).alias("words"), box.alias("box"))


ALIGNMENT = "index bigint, image_concepts array<int>, alignment array<int>"


def read_alignments(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """S3: records (index, image_concepts, alignment) of a JSON list; ``keyed`` reads one object that maps example ids to records
    and adds ``example_id``."""
    if not keyed:
        return spark.read.schema(ALIGNMENT).json(path, multiLine=True)
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, struct<{ALIGNMENT.replace(' ', ': ').replace(',:', ',')}>>")).alias("example_id", "r")).select("example_id", "r.*")


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, example_id, start, end): ``Class n:`` lines stand above the rows of their class."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    head = F.regexp_extract("value", r"^Class (\d+):", 1)
    rows = rows.withColumn("_h", F.when(head != "", head.cast("int")))
    w = Window.partitionBy("_f", "_b").orderBy("_i")
    # The last header of the blocks before; one row per block of a file.
    blocks = rows.groupBy("_f", "_b").agg(F.max_by("_h", F.when(F.col("_h").isNotNull(), F.col("_i"))).alias("_h"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("_f", "_b", F.last("_h", ignorenulls=True).over(before).alias("_c"))
    marked = rows.join(carried, ["_f", "_b"]).withColumn("class_id", F.coalesce(F.last("_h", ignorenulls=True).over(w), "_c"))
    p = F.split("value", " ")
    return marked.where(~F.col("value").startswith("Class ") & (F.trim("value") != "")).select("class_id", p[0].alias("example_id"), p[1].cast("double").alias("start"), p[2].cast("double").alias("end"))


def write_classes(found: DataFrame, path: str) -> None:
    """The listing that ``read_classes`` reads: classes in the order of their labels' first appearance. Files are ranges of rows, so a
    large class is cut into several; each of its files begins with its head."""
    from ..operators.timeline import number_classes

    rows = number_classes(found)
    text = rows.select("class_id", F.lit(1).alias("k"), EX, "start", F.concat_ws(" ", F.concat(F.lit("arr_"), F.col(EX).cast("string")), "start", "end").alias("value"))
    heads = rows.select("class_id").distinct().select("class_id", F.lit(0).alias("k"), F.lit(None).cast("long").alias(EX), F.lit(None).cast("int").alias("start"), F.concat(F.lit("Class "), F.col("class_id").cast("string"), F.lit(":")).alias("value"))

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for b in batches:
            if len(b) and not begun and b["k"].iloc[0]:
                yield pd.DataFrame({"value": [f"Class {b['class_id'].iloc[0]}:"]})
            begun = begun or len(b) > 0
            yield b[["value"]]

    order = ["class_id", "k", EX, "start"]
    both = heads.unionByName(text).repartitionByRange(*order).sortWithinPartitions(*order)
    both.select("class_id", "k", "value").mapInPandas(headed, "value string").write.text(path)


UNIT = "example_id string, start double, end double, label string"


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``id start end label``."""
    return spark.read.schema(UNIT).csv(path, sep=" ")


def write_units(df: DataFrame, path: str) -> None:
    """S5."""
    df.select(F.concat_ws(" ", "example_id", "start", "end", "label").alias("value")).write.text(path)


def write_segmented(df: DataFrame, path: str) -> None:
    """One line an example of ``df(example_idx, pos, segment ARRAY)``: phones joined by ',', segments by a blank."""
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "segment"))), lambda x: F.array_join(x["segment"], ",")), " ")
    write_lines(df.groupBy(EX).agg(line.alias("value")), path, [EX])


REGION = "image_id bigint, num_boxes int, boxes array<array<float>>, features array<array<float>>"


def read_region_tsv(spark: SparkSession, path: str, image_ids: DataFrame) -> DataFrame:
    """Rows ``image_id w h num_boxes boxes features`` by tabs, the last two base64 of float32, of the images in ``image_ids``."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            floats = lambda s, n: np.frombuffer(base64.b64decode(s), np.float32).reshape(n, -1)
            yield pd.DataFrame({"image_id": b["image_id"], "num_boxes": b["num_boxes"], "boxes": [list(floats(s, n)) for s, n in zip(b["boxes"], b["num_boxes"], strict=True)], "features": [list(floats(s, n)) for s, n in zip(b["features"], b["num_boxes"], strict=True)]})

    rows = spark.read.schema("image_id bigint, w int, h int, num_boxes int, boxes string, features string").csv(path, sep="\t", maxCharsPerColumn=-1)
    return rows.join(image_ids.select("image_id").distinct(), "image_id", "left_semi").select("image_id", "num_boxes", "boxes", "features").where("num_boxes > 0").mapInPandas(decode, REGION)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(char, defs) of lines ``trad simp ... /def/def/``: both forms of one-character heads."""
    line = spark.read.text(path).where("value not like '#%'")
    defs = F.filter(F.split(F.regexp_extract("value", r"/(.*)/", 1), "/"), lambda x: x != "")
    p = F.split("value", " ")
    rows = line.select(p[0].alias("a"), p[1].alias("b"), defs.alias("defs")).where(F.size("defs") > 0)
    return rows.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("char"), "defs").where(F.char_length("char") == 1)


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """A model's tables as Parquet; ``counts`` sorted by weight, largest first."""
    for name, df in tables.items():
        (df.orderBy(F.desc("weight")) if name == "counts" else df).write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """S10."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_parallel(df: DataFrame, path: str) -> None:
    """``df(example_idx, concepts, caption)`` as three lines an example: concepts, caption, blank."""
    rows = df.select(EX, F.posexplode(F.array("concepts", "caption", F.lit(""))).alias("k", "value"))
    write_lines(rows, path, [EX, "k"])


def read_parallel(spark: SparkSession, path: str, start: int | None = None) -> DataFrame:
    """(i, concepts, caption[, example_id]) by line number modulo 3, ids ``arr_<start + i>`` if ``start`` is given."""
    lines = numbered_lines(spark, path).withColumn("i", F.expr("line div 3"))
    out = lines.groupBy("i").agg(F.max(F.when(F.col("line") % 3 == 0, F.col("value"))).alias("concepts"), F.max(F.when(F.col("line") % 3 == 1, F.col("value"))).alias("caption"))
    return out if start is None else out.withColumn("example_id", F.concat(F.lit("arr_"), (F.col("i") + start).cast("string")))


def read_time_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(example_idx, pos, t): blocks of lines, each ended by a blank one; the second column is in seconds. A file
    holds whole blocks, and examples are numbered through the files."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    blank = (F.trim("value") == "").cast("int")
    marked = rows.withColumn("_g", F.sum(blank).over(Window.partitionBy("_f", "_b").orderBy("_i")))
    # Blank lines before each block, through the files; one row per block of a file.
    per = marked.groupBy("_f", "_b").agg(F.sum(blank).alias("_m"))
    offset = per.select("_f", "_b", F.coalesce(F.sum("_m").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    real = marked.where(blank == 0).join(offset, ["_f", "_b"]).withColumn(EX, F.col("_o") + F.col("_g"))
    return real.select(EX, (F.row_number().over(Window.partitionBy(EX).orderBy("_f", "_b", "_i")) - 1).alias("pos"), F.split("value", " ")[1].cast("double").alias("t"))
