"""Columns over descriptor vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what keeps the divisor of the root transform from being zero.
EPS = 1e-10
#: Steps of one unit in the integer form of a root vector.
STEPS = 512


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def root_vector(v: Column) -> Column:
    """Root form of a vector of counts: ``sqrt(d / (|d|_1 + eps))`` entry by entry."""
    size = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) + F.lit(EPS)
    # Bound as the one entry of an array: inside the inner function it would be summed up again for each entry.
    return F.transform(F.array(size), lambda s: F.transform(v, lambda x: F.sqrt(x.cast("double") / s)))[0]


def is_usable(v: Column, dim: int = 128) -> Column:
    """Not null, ``dim`` entries, no null or NaN among them, not only zeros."""
    return (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def squared_distance(u: Column, v: Column) -> Column:
    """Squared Euclidean distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)


def l2_distance(u: Column, v: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(u, v, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def root_matrix(descriptors: DataFrame) -> DataFrame:
    """``(image_name, desc_id, divisor, descriptor)``: the root transform with one divisor per image.

    The divisor is the largest column sum of the image's matrix, as a matrix norm gives it
    where a vector norm was meant; kept for compatibility.
    """
    usable = descriptors.filter(is_usable(F.col("descriptor")))
    cells = usable.select("image_name", F.posexplode("descriptor").alias("k", "x"))
    per_dim = cells.groupBy("image_name", "k").agg(F.sum(F.abs(F.col("x").cast("double"))).alias("s"))
    divisor = per_dim.groupBy("image_name").agg((F.max("s") + F.lit(EPS)).alias("divisor"))
    rows = usable.join(divisor, "image_name")
    return rows.select("image_name", "desc_id", "divisor", F.transform("descriptor", lambda x: F.sqrt(F.abs(x.cast("double")) / F.col("divisor"))).alias("descriptor"))


def rooted() -> Column:
    """``descriptor`` in root form as doubles: rows of ``kind`` sift are transformed, others are so already."""
    return F.when(F.col("kind") == "sift", root_vector(F.col("descriptor"))).otherwise(F.transform("descriptor", lambda x: x.cast("double")))


def root_form(descriptors: DataFrame, dim: int = 128) -> DataFrame:
    """``(vec_id, v)``: one usable vector per id in root form, as stored numbers (of differing rows the smallest)."""
    stored = descriptors.filter(is_usable(F.col("descriptor"), dim) & F.col("vec_id").isNotNull()).select("vec_id", "kind", "descriptor")
    rows = stored.repartition("vec_id").select("vec_id", rooted().alias("v"))  # travels as stored, half as wide as its roots
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def quantised(descriptors: DataFrame, dim: int = 128) -> DataFrame:
    """``(vec_id, image_name, desc_id, x, y, q)``: one usable vector per id in root form, as integers.

    Integer entries make distances exact and equal in every engine. Rows delivered twice
    count once (of differing ones the smallest vector), null ids are left out.
    """
    rows = descriptors.filter(is_usable(F.col("descriptor"), dim) & F.col("vec_id").isNotNull()).select("vec_id", "image_name", "desc_id", "x", "y", F.transform(rooted(), lambda z: F.floor(z * STEPS).cast("int")).alias("q"))
    return rows.groupBy("vec_id").agg(*(F.min(c).alias(c) for c in ("image_name", "desc_id", "x", "y", "q")))
