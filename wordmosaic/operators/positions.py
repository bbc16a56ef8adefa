"""Assignment of rows to owners by position: running offsets and a range join without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmosaic.session import written

#: Rows per bucket of the range join.
WIDTH = 65_536


def running_offsets(counts: DataFrame, order: str, count: str) -> DataFrame:
    """``counts`` with ``start``: the sum of ``count`` over all rows before, in ``order``.

    Rows are range-partitioned; only one sum per partition passes the driver, and the
    window runs inside each partition.
    """
    parts = written(counts.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = {r["_part"]: r["s"] for r in parts.groupBy("_part").agg(F.sum(count).alias("s")).collect()}
    base, so_far = {}, 0
    for p in sorted(sums):
        base[p] = so_far
        so_far += sums[p] or 0
    table = counts.sparkSession.createDataFrame(sorted(base.items()) or [(0, 0)], "_part int, _base long")
    inside = F.sum(count).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(table), "_part").withColumn("start", F.col("_base") + F.col("_in")).drop("_part", "_base", "_in")


def positional_assign(rows: DataFrame, owners: DataFrame, row: str = "row", width: int = WIDTH) -> DataFrame:
    """``rows`` joined to the owner with ``start <= row < start + count``.

    ``owners`` has ``start`` and ``count``. Ranges are cut at multiples of ``width``, so the
    join is by equality and a range of any length is spread.
    """
    last = F.floor((F.col("start") + F.col("count") - 1) / width)
    ranges = owners.filter(F.col("count") > 0).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), last)))
    placed = rows.withColumn("_b", F.floor(F.col(row) / width)).join(ranges, "_b")
    return placed.filter((F.col(row) >= F.col("start")) & (F.col(row) < F.col("start") + F.col("count"))).drop("_b")


def order_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(pos, left_name, right_name)`` where two orders ``(pos, name)`` disagree or one ends."""
    both = left.select("pos", F.col("name").alias("left_name")).join(right.select("pos", F.col("name").alias("right_name")), "pos", "full_outer")
    return both.filter(~F.col("left_name").eqNullSafe(F.col("right_name")))
