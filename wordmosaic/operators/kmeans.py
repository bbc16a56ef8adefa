"""Lloyd's k-means over vectors ``(id, v)`` with centres ``(cid, center)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmosaic.operators.centers import MAX_BROADCAST_ENTRIES, as_lists, matrix, nearest, nearest_center
from wordmosaic.operators.runs import whole_runs
from wordmosaic.session import written


def first_centers(points: DataFrame, k: int) -> DataFrame:
    """The vectors of the ``k`` smallest ids as centres 0 to k-1; they are numbered where they are sorted, not on the driver."""
    first = points.orderBy("id").limit(k).withColumn("cid", F.row_number().over(Window.orderBy("id")) - 1)
    return written(first.select(F.col("cid").cast("int").alias("cid"), F.col("v").cast("array<double>").alias("center")), "centers")


def random_centers(points: DataFrame, k: int, dim: int, seed: int = 0) -> DataFrame:
    """Random integer centres in 0..254 (the upper bound is exclusive)."""
    rng = np.random.RandomState(seed)
    return points.sparkSession.createDataFrame([(c, [float(x) for x in row]) for c, row in enumerate(rng.randint(0, 255, (k, dim)))], "cid int, center array<double>")


def assign(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``(id, cid, d2)`` of :func:`nearest_center`."""
    return nearest_center(points, centers)


def _sum_pass(c: np.ndarray, cids: np.ndarray, before: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, same = np.zeros_like(c), np.zeros(len(c), np.int64), 0
        where = np.arange(len(c))
        for batch in batches:
            x = matrix(batch.column(0))
            at, _ = nearest(x, c, where)
            order = np.argsort(at, kind="stable")
            start = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0]) if len(at) else np.zeros(0, int)
            if len(start):
                total[at[order][start]] += np.add.reduceat(x[order], start, axis=0)
            count += np.bincount(at, minlength=len(c))
            if before is not None:
                same += int((nearest(x, before, where)[0] == at).sum())
        used = count > 0
        n = int(used.sum())
        yield pa.RecordBatch.from_arrays([pa.array(cids[used].astype(np.int32)), pa.array(count[used]), as_lists(total[used], pa.float64()), pa.array([same if k == 0 else 0 for k in range(n)], pa.int64())], names=["cid", "n", "total", "same"])

    return run


def step(points: DataFrame, centers: DataFrame, truncate: bool = False, before: DataFrame | None = None) -> tuple[DataFrame, int | None]:
    """New centres after one assignment, and the number of vectors assigned as by ``before``.

    The mean of each centre's vectors; a centre without any keeps its place; with ``truncate``
    means are cut to whole numbers. The size of the centres is looked at before they are fetched:
    a set small enough is broadcast and sums are made in each task; a larger one goes through
    block joins. Either way the sums are added up by centre and stay in the cluster.
    """
    size = centers.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("center")).alias("d")).first()
    if (size["n"] or 0) * (size["d"] or 0) > MAX_BROADCAST_ENTRIES:
        who = nearest_center(points, centers)
        parts = points.join(who, "id").select("cid", F.lit(1).cast("long").alias("n"), F.col("v").cast("array<double>").alias("total"), F.lit(0).cast("long").alias("same"))
        same = None if before is None else who.join(nearest_center(points, before).select("id", F.col("cid").alias("old")), "id").filter("cid = old").count()
    else:
        table = centers.orderBy("cid").toArrow()
        c, cids = matrix(table.column("center")), table.column("cid").to_numpy()
        old = None if before is None else matrix(before.orderBy("cid").toArrow().column("center"))
        parts = points.select("v").mapInArrow(_sum_pass(c, cids, old), SUMS)
        same = None
    # Sums of a batch of rows first, so that a centre with very many vectors is no task of its own.
    summed = parts.select("cid", "n", "total", "same").mapInArrow(_added, SUMS).repartition("cid").sortWithinPartitions("cid").mapInArrow(_added, SUMS)
    summed = written(summed, "sums")
    mean = F.transform("total", lambda x: F.floor(x / F.col("n")).cast("double") if truncate else x / F.col("n"))
    new = written(centers.join(summed.select("cid", mean.alias("mean")), "cid", "left").select("cid", F.coalesce("mean", "center").alias("center")), "centers")
    if before is not None and same is None:
        same = summed.agg(F.coalesce(F.sum("same"), F.lit(0))).first()[0]
    return new, same


SUMS = "cid int, n long, total array<double>, same long"


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by centre: of the rows of a batch, or of all rows of a centre where they are sorted."""
    ordered = (b.sort_by("cid") for b in batches)
    for table in whole_runs(ordered, ["cid"]):
        cid = table.column("cid").to_numpy()
        start = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
        add = lambda name: np.add.reduceat(table.column(name).to_numpy(), start)  # noqa: B023, E731
        total = np.add.reduceat(matrix(table.column("total")), start, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(cid[start]), pa.array(add("n")), as_lists(total, pa.float64()), pa.array(add("same"))], names=["cid", "n", "total", "same"])


def kmeans(points: DataFrame, centers: DataFrame, max_iter: int | None = None, truncate: bool = False) -> tuple[DataFrame, int]:
    """``(centres, rounds)``: Lloyd's loop until no vector changes its centre, or ``max_iter`` updates.

    Convergence is tested before the update, as assignments are compared between rounds.
    """
    n = points.count()
    before: DataFrame | None = None
    rounds = 0
    while max_iter is None or rounds < max_iter:
        after, same = step(points, centers, truncate, before)
        if same == n:
            break
        before, centers = centers, after
        rounds += 1
    return centers, rounds


def unchanged(points: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``(n_unchanged, n_points)``: vectors with the same nearest centre in both sets."""
    a = nearest_center(points, before).select("id", F.col("cid").alias("old"))
    b = nearest_center(points, after).select("id", F.col("cid").alias("new"))
    return a.join(b, "id").agg(F.count_if(F.col("old") == F.col("new")).alias("n_unchanged"), F.count(F.lit(1)).alias("n_points"))


def synthetic_points(spark, n: int, dim: int, seed: int = 0) -> DataFrame:
    """``(id, v)``: ``n`` random byte vectors."""
    cells = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(256)).cast("int"))
    return spark.range(n).select("id", cells.alias("v"))
