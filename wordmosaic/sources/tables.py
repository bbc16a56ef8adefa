"""Tables with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmosaic.functions.vectors import STEPS, is_usable

SCHEMAS = {
    "descriptors": "image_name string, desc_id int, x float, y float, a float, b float, c float, descriptor array<float>",
    "bow": "image_name string, words array<int>",
    "word_weights": "word int, cnt bigint, weight double",
    "signatures": "image_name string, signature array<bigint>",
    "pairs": "a string, b string, sim double",
    "verified": "a string, b string, sim double, n_inliers int",
    "pq_codebook": "m int, code int, subvector array<double>",
    "pq_codes": "image_name string, desc_id int, pq array<int>",
    "vocab": "word int, pq array<int>",
    "centers": "cid int, center array<double>",
}


def checked(df: DataFrame, name: str) -> DataFrame:
    """``df`` if it has the columns of table ``name`` in these types; further columns are allowed."""
    from pyspark.sql.types import _parse_datatype_string

    have = dict(df.dtypes)
    wrong = [f"{f.name}: {have.get(f.name)} for {f.dataType.simpleString()}" for f in _parse_datatype_string(SCHEMAS[name]).fields if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"not a {name} table: " + "; ".join(wrong))
    return df


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quantised_centers(centers: DataFrame, dim: int = 128) -> DataFrame:
    """``(cid, center)``: usable centres in the integer form of the descriptors, one per cid."""
    rows = centers.filter(is_usable(F.col("center"), dim) & F.col("cid").isNotNull()).select("cid", F.transform("center", lambda z: F.floor(z * STEPS).cast("int")).alias("center"))
    return rows.groupBy("cid").agg(F.min("center").alias("center"))
