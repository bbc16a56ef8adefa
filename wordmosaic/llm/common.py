"""What several problems share: clean bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word ids run from 0 to this, exclusive.
VOCABULARY = 1_000_000


def valid_words(words: Column, vocabulary: int = VOCABULARY) -> Column:
    """Entries that are neither null nor outside the vocabulary; a null bag stays null."""
    return F.filter(words, lambda w: w.isNotNull() & (w >= 0) & (w < vocabulary))


def delivered_once(bow: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(image_name, words)``: one bag of valid words per image, repeats kept.

    Of an image delivered more than once, the fullest delivery counts (a lost bag never
    hides a delivered one; among equals the smallest bag in sorted order). Images without
    a name are left out; a lost (null) bag stays a row with null ``words``.
    """
    clean = bow.select("image_name", F.array_sort(valid_words(F.col("words"), vocabulary)).alias("words")).filter(F.col("image_name").isNotNull())
    order = F.struct(-F.coalesce(F.size("words"), F.lit(-1)), F.col("words"))
    return clean.groupBy("image_name").agg(F.min(order).alias("_o")).select("image_name", F.col("_o.words").alias("words"))
