"""Corpora, vocabularies and concept tables. Small lookup tables (lexicon, stop words, dictionaries) join by equality; Spark
broadcasts them where its statistics say that they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import looked_up
from ..functions.ranking import numbered

EX = "example_idx"


def normalize_tokens(tokens: DataFrame, lemmas: DataFrame, stop: DataFrame) -> DataFrame:
    """Lower case, lemma where ``lemmas(word, lemma)`` has one, without stop words, tokens that begin with '_' and tokens
    without a letter or digit; positions stay."""
    low = tokens.withColumn("token", F.lower("token")).where(~F.col("token").startswith("_") & F.col("token").rlike(r"[\p{L}\p{N}]"))
    out = looked_up(low, lemmas.select("word", "lemma")).withColumn("token", F.coalesce("lemma", "token")).drop("lemma")
    return looked_up(out, stop.select("word", F.lit(True).alias("_stop"))).where("_stop IS NULL").select(*tokens.columns)


def word_freq(tokens: DataFrame) -> DataFrame:
    """(word, n)."""
    return tokens.groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n"))


def top_words(freq: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words, ties by word."""
    return freq.orderBy(F.desc("n"), "word").limit(k)


def build_index(words: DataFrame, order: str = "name") -> DataFrame:
    """T4: (word, idx) of a table of distinct words ``(word[, n][, first])``, by ``name``, ``rank`` (n descending, then word) or
    ``first`` appearance. Words are numbered in ranges, so that a large vocabulary is no single task."""
    by = {"name": ["word"], "rank": [F.desc("n"), "word"], "first": ["first", "word"]}[order]
    return numbered(words, *by).select("word", F.col("idx").cast("int").alias("idx"))


def filter_captions(captions: DataFrame, vocab: DataFrame) -> DataFrame:
    """T5: captions (example_idx, tokens) cut to words of ``vocab(word)``, in order; a caption may become empty."""
    exploded = captions.select(EX, F.posexplode("tokens").alias("pos", "word"))
    kept = exploded.join(vocab.select("word"), "word", "left_semi").groupBy(EX).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("tokens"))
    return captions.select(EX).join(kept, EX, "left").select(EX, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def to_phones(tokens: DataFrame, lexicon: DataFrame, unknown: str = "UNK") -> DataFrame:
    """(example_idx, pos, phone_pos, phone): each word's pronunciation in ``lexicon(word, phones)``, the stress mark U+02C8 in
    front of a phone removed; a word that is not there is one phone ``unknown``. All columns of ``tokens`` but ``token`` stay, so that a table of
    words with their counts may stand for the tokens."""
    found = looked_up(tokens, lexicon.select("word", "phones"))
    return found.select(*[c for c in tokens.columns if c != "token"], F.posexplode(F.coalesce("phones", F.array(F.lit(unknown)))).alias("phone_pos", "phone")).withColumn("phone", F.regexp_replace("phone", "^ˈ", ""))


def map_words_to_concepts(freq: DataFrame, sims: DataFrame, min_freq: int, threshold: float, own: str = "person") -> DataFrame:
    """(word, concept) of words with at least ``min_freq``: the most similar concept of ``sims(word, concept, score)``, or the
    word itself if the score is below ``threshold`` or the concept is ``own``. One pass against the given inventory: words
    that become concepts here are no candidates for others."""
    best = sims.groupBy("word").agg(F.max_by(F.struct("concept", "score"), F.struct("score", "concept")).alias("b"))
    known = freq.where(F.col("n") >= min_freq).join(best, "word", "left")
    lone = F.col("b").isNull() | (F.col("b.score") < threshold) | (F.col("b.concept") == own)
    return known.select("word", F.when(lone, F.col("word")).otherwise(F.col("b.concept")).alias("concept"))


def word_to_images(phrases: DataFrame) -> DataFrame:
    """(word, image_id, box ids, n): where each word of ``phrases(image_id, box_id, words)`` is seen; one row a word and image,
    so that a frequent word is no single row."""
    rows = phrases.select("image_id", "box_id", F.explode("words").alias("word"))
    return rows.groupBy("word", "image_id").agg(F.sort_array(F.collect_set("box_id")).alias("boxes"), F.count("*").alias("n"))


def translate(captions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(example_idx, text): characters by their first definition in ``dictionary(char, defs)``, others dropped."""
    chars = captions.select(EX, F.posexplode(F.split("text", "")).alias("pos", "char")).where("char <> ''")
    found = chars.join(dictionary.select("char", F.element_at("defs", 1).alias("def")), "char")
    return found.groupBy(EX).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "def"))), lambda x: x["def"]), " ").alias("text"))


def tag_concepts(tokens: DataFrame, index: DataFrame, numbers: DataFrame, min_freq: int) -> DataFrame:
    """(example_idx, pos, concept) of words that ``index(word, images)`` knows with at least ``min_freq`` images or that are in
    ``numbers(word)``; an example without any has one row 'null' at position -1."""
    known = index.where(F.col("images") >= min_freq).select("word").union(numbers.select("word")).distinct()
    seen = looked_up(tokens.select(EX, "pos", "token"), known.select("word", F.lit(True).alias("_known")))
    hits = seen.where("_known").select(EX, "pos", F.col("token").alias("concept"))
    none = seen.groupBy(EX).agg(F.count("_known").alias("_n")).where("_n = 0").select(EX, F.lit(-1).alias("pos"), F.lit("null").alias("concept"))
    return hits.union(none)


def explode_captions(rows: DataFrame, captions: str = "captions") -> DataFrame:
    """One row per caption of a comma-separated list, the other columns repeated: (..., caption_idx, caption)."""
    rest = [c for c in rows.columns if c != captions]
    return rows.select(*rest, F.posexplode(F.split(captions, ",")).alias("caption_idx", "caption")).withColumn("caption", F.trim("caption"))


def expand_person(examples: DataFrame, rules: dict[str, str], keep: bool = True, name: str = "person") -> DataFrame:
    """In ``examples(example_idx, concepts ARRAY, phones STRING)`` the class ``name`` becomes the sub-classes whose phone
    pattern occurs; without a match it stays, or goes with ``keep=False``."""
    found = F.filter(F.array(*[F.when(F.col("phones").contains(p), F.lit(c)) for c, p in rules.items()]), lambda x: x.isNotNull())
    rest = F.array_remove("concepts", name)
    expanded = F.when(F.size(found) > 0, F.concat(rest, found)).otherwise(F.col("concepts") if keep else rest)
    return examples.withColumn("concepts", F.when(F.array_contains("concepts", name), expanded).otherwise(F.col("concepts")))


def merge_labels(counts: DataFrame, topk: int) -> DataFrame:
    """(label, merged): 0 for the ``topk`` most frequent labels (ties by label), 1 for the rest."""
    return counts.select("label", F.when(F.row_number().over(Window.orderBy(F.desc("n"), "label")) <= topk, 0).otherwise(1).alias("merged"))


def partial_labels(examples: DataFrame, label2idx: DataFrame, name: str = "person") -> DataFrame:
    """(example_idx, pos, label) over ``concepts``: the id of the caption's single new sub-class in ``expanded`` for ``name``, -1
    if there is none or several, 0 for other concepts."""
    new = F.array_except("expanded", "concepts")
    one = F.when(F.size(new) == 1, F.element_at(new, 1))
    rows = examples.select(EX, one.alias("_one"), F.posexplode("concepts").alias("pos", "concept")).join(label2idx, F.col("_one") == F.col("label_name"), "left")
    return rows.select(EX, "pos", F.when(F.col("concept") == name, F.coalesce("label_id", F.lit(-1))).otherwise(0).alias("label"))


def distinct_words(captions: DataFrame) -> DataFrame:
    """(example_idx, token): the distinct words of each example of ``captions(example_idx, tokens)``. Only ids are shuffled, unless one has
    several rows, whose words must meet."""
    words = captions.select(EX, F.explode(F.array_distinct("tokens")).alias("token"))
    again = captions.groupBy(EX).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count()
    return words.distinct() if again else words


def doc_index_pairs(words: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (doc, term) of distinct ``words(example_idx, token)``, both numbered from 1, by ``index(word, idx)`` and by example."""
    found = looked_up(words.select(EX, "token"), index.select("word", "idx")).where("idx IS NOT NULL")
    return found.select((F.col(EX) + 1).alias("doc"), (F.col("idx") + 1).alias("term"))


def phones_of_kept(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(example_idx, phones) of the words in ``vocab(word)``, from ``rows(example_idx, words ARRAY, phones ARRAY<ARRAY>)``; units
    '#' and those that begin with '_' are dropped."""
    pairs = rows.select(EX, F.posexplode(F.arrays_zip("words", "phones")).alias("pos", "z")).select(EX, "pos", F.col("z.words").alias("word"), F.col("z.phones").alias("p"))
    kept = looked_up(pairs, vocab.select("word", F.lit(True).alias("_kept")), "word").where("_kept").where("word <> '#' and not startswith(word, '_')")
    return kept.groupBy(EX).agg(F.filter(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "p"))), lambda x: x["p"])), lambda x: (x != "#") & ~x.startswith("_")).alias("phones"))


def concept_captions(phrases: DataFrame, word2concept: DataFrame, none: str = "notvisual") -> DataFrame:
    """(example_idx, text): the concepts of a caption's phrases (example_idx, pos, word) in order, those of ``none`` left out."""
    c = phrases.join(word2concept, "word").where(F.col("concept") != none)
    return c.groupBy(EX).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "concept"))), lambda x: x["concept"]), " ").alias("text"))
