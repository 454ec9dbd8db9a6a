"""Building and asking the lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import letters as L
from ..functions import text as X


def inventory(words: DataFrame, word: str = "word_normalized") -> DataFrame:
    """``(syllable)``: every distinct syllable of the headwords, in NFC. Headwords are split at tshegs only, so one that ends in a shad keeps it."""
    return words.select(F.explode(X.split_headword(X.nfc(F.col(word)))).alias("syllable")).distinct()


def statistics(words: DataFrame, word: str = "word_normalized") -> DataFrame:
    """One row: whether there are words at all, how many, and how many distinct syllables. Null words do not count."""
    n = words.agg(F.count(word).alias("word_count"))
    m = inventory(words, word).agg(F.count(F.lit(1)).alias("syllable_count"))
    return n.crossJoin(F.broadcast(m)).select((F.col("word_count") > 0).alias("available"), "word_count", "syllable_count")


def cross_reference(words: DataFrame, order: DataFrame, threshold: int = 2) -> DataFrame:
    """``(word, source_count, sources, first_seen_in)`` for Tibetan words that stand in at least ``threshold`` sources.

    ``words`` has ``word`` and ``source_key``; ``order`` has ``source_key`` and ``id``, which says which source comes first. Words are stripped and in NFC; words of no or
    of an unknown source are left out. A word has as many sources as there are, not as there are rows.
    """
    clean = words.select(X.nfc(X.strip(F.col("word"))).alias("word"), "source_key").where((F.col("word") != "") & X.has_tibetan(F.col("word"))).distinct()
    listed = clean.join(order.select("source_key", F.col("id").alias("at")), "source_key")
    found = listed.groupBy("word").agg(F.count(F.lit(1)).alias("source_count"), F.array_sort(F.collect_list(F.struct("at", "source_key"))).alias("s"))
    keys = F.transform("s", lambda x: x["source_key"])
    return found.where(F.col("source_count") >= threshold).select("word", "source_count", F.array_join(keys, ",").alias("sources"), F.get(keys, F.lit(0)).alias("first_seen_in"))


def new_headwords(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``(word, word_normalized)``: words of ``incoming`` that ``existing`` has in neither form. Each word comes out once."""
    clean = incoming.select(X.nfc(X.strip(F.col("word"))).alias("word")).where((F.col("word") != "") & X.has_tibetan(F.col("word"))).distinct()
    taken = existing.select(F.explode(F.array("word", "word_normalized")).alias("word")).where(F.col("word").isNotNull()).distinct()
    return clean.join(taken, "word", "left_anti").select("word", F.col("word").alias("word_normalized"))


def upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` with the words of ``incoming`` that it lacks; their other columns are null."""
    return existing.unionByName(new_headwords(incoming, existing), allowMissingColumns=True)


def load(incoming: DataFrame, words: DataFrame, sources: DataFrame, links: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of the lexicon after ``incoming`` was written to them; what is there already stays as it is.

    ``incoming`` has ``word``, ``sources`` (keys joined by commas) and ``first_seen_in``, as ``cross_reference`` gives them; ``words`` has ``word``, ``word_normalized``,
    ``first_seen_in``; ``sources`` has ``source_key``, ``display_name``; ``links`` has ``word``, ``source_key``. New words are their own normal form and new sources their
    own display name. With ``replace``, words and links are emptied first; sources stay. A word that comes several times is written once, with its least ``first_seen_in``.
    Rows with a null word or key are left out of what is written.
    """
    named = incoming.where(F.col("word").isNotNull())
    each = named.select("word", F.explode(F.split("sources", ",")).alias("source_key")).where("source_key <> ''").distinct()
    fresh = named.groupBy("word").agg(F.min("first_seen_in").alias("first_seen_in")).select("word", F.col("word").alias("word_normalized"), "first_seen_in")
    words, sources, links = words.select("word", "word_normalized", "first_seen_in"), sources.select("source_key", "display_name"), links.select("word", "source_key")
    if replace:
        words, links = words.limit(0), links.limit(0)
    keys = each.select("source_key").distinct().withColumn("display_name", F.col("source_key"))
    return (
        words.unionByName(fresh.join(words.select("word"), "word", "left_anti").select("word", "word_normalized", "first_seen_in")),
        sources.unionByName(keys.join(sources.select("source_key"), "source_key", "left_anti").select("source_key", "display_name")),
        links.unionByName(each.join(links, ["word", "source_key"], "left_anti")),
    )


def seed(spark: SparkSession) -> DataFrame:
    """The seed list as ``load`` takes it."""
    listed = spark.createDataFrame([(w,) for w in L.SEED_WORDS], "word string")
    return listed.select(X.nfc(X.strip(F.col("word"))).alias("word"), F.lit("seed_corpus").alias("sources"), F.lit("seed_corpus").alias("first_seen_in")).distinct()


_KEYS = T.ArrayType(T.StringType())


def legacy_sources(legacy: DataFrame) -> DataFrame:
    """``(source_key, display_name)``: the distinct sources that the JSON lists of a legacy table name."""
    keys = legacy.select(F.explode(F.from_json("sources", _KEYS)).alias("source_key")).where(F.col("source_key").isNotNull()).distinct()
    return keys.withColumn("display_name", F.col("source_key"))


def legacy_word_sources(legacy: DataFrame, words: DataFrame, sources: DataFrame) -> DataFrame:
    """``(word_id, source_id)``: the distinct pairs that the JSON lists of a legacy table stand for."""
    each = legacy.select("word", F.explode(F.from_json("sources", _KEYS)).alias("source_key"))
    named = each.join(words.select("word", F.col("id").alias("word_id")), "word").join(sources.select("source_key", F.col("id").alias("source_id")), "source_key")
    return named.select("word_id", "source_id").distinct()
