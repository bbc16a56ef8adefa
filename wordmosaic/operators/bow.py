"""Bags of words: clean bags, sets, word weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a word of the vocabulary that never occurs.
UNUSED_WEIGHT = 1e-12


def valid(words: Column, vocab_size: int = 1_000_000) -> Column:
    return F.filter(words, lambda w: w.isNotNull() & (w >= 0) & (w < vocab_size))


def bow_multiset(bow: DataFrame, vocab_size: int = 1_000_000) -> DataFrame:
    """``(image_name, words)``: the valid words of each image in ascending order, repeats kept.

    An image delivered more than once counts once, by its fullest bag; images without a
    name, and lost, empty and all-invalid bags are left out.
    """
    rows = bow.select("image_name", F.array_sort(valid(F.col("words"), vocab_size)).alias("words")).filter(F.col("image_name").isNotNull() & (F.size("words") > 0))
    best = F.min(F.struct((-F.size("words")).alias("n"), "words")).alias("b")
    return rows.groupBy("image_name").agg(best).select("image_name", F.col("b.words").alias("words"))


def bow_set(bow: DataFrame, vocab_size: int = 1_000_000) -> DataFrame:
    """``(image_name, words)``: as :func:`bow_multiset`, each word once."""
    return bow_multiset(bow, vocab_size).select("image_name", F.array_distinct("words").alias("words"))


def distinct_sets(bow: DataFrame, vocab_size: int = 1_000_000) -> DataFrame:
    """``(image_name, words, n_images)``: one row per distinct word set, named by its smallest image.

    Copies of one image meet in no later join; :func:`set_membership` says which image is which copy.
    """
    return bow_set(bow, vocab_size).groupBy("words").agg(F.min("image_name").alias("image_name"), F.count(F.lit(1)).alias("n_images")).select("image_name", "words", "n_images")


def set_membership(bow: DataFrame, vocab_size: int = 1_000_000) -> DataFrame:
    """``(image_name, set_name)``: every image with the image that names its word set.

    Only sets that several images share are joined back; a set shared by a third of all
    images is one row on the broadcast or shuffled side, never a collected group.
    """
    from wordmosaic.session import hot_join

    key = F.md5(F.array_join(F.col("words").cast("array<string>"), ","))
    sets = bow_set(bow, vocab_size).withColumn("key", key)
    names = sets.groupBy("key").agg(F.min("image_name").alias("set_name"))
    return hot_join(sets.select("image_name", "key"), names, "key").select("image_name", "set_name")


def bow_words(bags: DataFrame) -> DataFrame:
    """``(image_name, word)``, one row per entry."""
    return bags.select("image_name", F.explode("words").alias("word"))


def word_weights(bags: DataFrame, distinct: bool = False) -> DataFrame:
    """``(word, cnt, weight)`` with weight ``1 / cnt``: by occurrences, or by images if ``distinct``."""
    words = F.array_distinct("words") if distinct else F.col("words")
    return bags.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).withColumn("weight", F.lit(1.0) / F.col("cnt"))


def all_word_weights(bags: DataFrame, vocab_size: int, distinct: bool = False) -> DataFrame:
    """:func:`word_weights` for the whole vocabulary; an unused word gets a tiny weight and count 0."""
    every = bags.sparkSession.range(vocab_size).select(F.col("id").cast("int").alias("word"))
    return every.join(word_weights(bags, distinct), "word", "left").select("word", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("weight", F.lit(UNUSED_WEIGHT)).alias("weight"))


def unused_words(bags: DataFrame, vocab_size: int) -> DataFrame:
    """``(word)`` of the vocabulary in no bag."""
    every = bags.sparkSession.range(vocab_size).select(F.col("id").cast("int").alias("word"))
    return every.join(bow_words(bags).select("word").distinct(), "word", "left_anti")


def descriptor_counts(descriptors: DataFrame) -> DataFrame:
    """``(image_name, n_descriptors)``: distinct delivered (image_name, desc_id) per image."""
    keys = descriptors.filter(F.col("image_name").isNotNull() & F.col("desc_id").isNotNull()).select("image_name", "desc_id").distinct()
    return keys.groupBy("image_name").agg(F.count(F.lit(1)).alias("n_descriptors"))


def descriptor_totals(descriptors: DataFrame) -> DataFrame:
    """``(n_images, n_descriptors, mean_descriptors)`` over :func:`descriptor_counts`."""
    return descriptor_counts(descriptors).agg(F.count(F.lit(1)).alias("n_images"), F.sum("n_descriptors").alias("n_descriptors"), F.avg("n_descriptors").alias("mean_descriptors"))
