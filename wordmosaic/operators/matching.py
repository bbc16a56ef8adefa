"""Descriptor matching of image pairs, block against block.

The descriptors of an image are cut into blocks of bounded size. A pair of images is
the set of its block pairs, each one row of work, so an image that holds a tenth of
all descriptors, or occurs in very many pairs, is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmosaic.operators.centers import matrix
from wordmosaic.session import heavy_keys, hot_join, written

#: Descriptors of a block.
BLOCK = 1_024
#: Pairs of one block above which they are spread over several tasks: each carries a block of vectors.
HOT_PAIRS = 256
METHODS = ("brute_force", "ratio")


def image_blocks(descriptors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(image_name, blk, idx, vs)``: blocks of ``(image_name, idx, v)`` with at most ``block`` rows each.

    ``idx`` must be unique within an image; it decides the block, so no image is collected whole.
    """
    rows = descriptors.withColumn("blk", F.floor(F.col("idx") / block).cast("long"))
    return rows.groupBy("image_name", "blk").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("m")).select("image_name", "blk", "m.idx", F.col("m.v").alias("vs"))


def _two_nearest_pass(hamming: bool):
    out = pa.schema([("a", pa.string()), ("b", pa.string()), ("side", pa.int32()), ("idx", pa.int64()), ("near", pa.int64()), ("d2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                ia, ib = (batch.column(k)[r].values.to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 4))
                x, y = (matrix(batch.column(k)[r].values) for k in (3, 5))
                if hamming:
                    p, q = (np.unpackbits(v.astype(np.uint8), axis=1).astype(np.float64) for v in (x, y))
                    d = p @ (1 - q).T + (1 - p) @ q.T
                else:
                    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
                cols: list[list] = [[], [], [], []]
                for side, own, other, m in ((0, ia, ib, d), (1, ib, ia, d.T)):
                    k = min(2, m.shape[1])
                    order = np.argsort(m, axis=1, kind="stable")[:, :k] if m.shape[1] <= 64 else _two_least(m)
                    for t in range(k):
                        cols[0].append(np.full(len(own), side, np.int32))
                        cols[1].append(own)
                        cols[2].append(other[order[:, t]])
                        cols[3].append(m[np.arange(len(own)), order[:, t]])
                s, i, j, dd = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(s), pa.string()), pa.array([b] * len(s), pa.string()), pa.array(s), pa.array(i), pa.array(j), pa.array(np.maximum(dd, 0))], schema=out)

    return run


def _two_least(m: np.ndarray) -> np.ndarray:
    """Columns of the two least entries of each row, ties by column."""
    first = m.argmin(axis=1)
    rest = m.copy()
    rest[np.arange(len(m)), first] = np.inf
    return np.stack([first, rest.argmin(axis=1)], axis=1)


def two_nearest(pairs: DataFrame, descriptors: DataFrame, hamming: bool = False, block: int = BLOCK) -> DataFrame:
    """``(a, b, side, idx, near, d2, rank)``: the two nearest of the other image, from both sides (0: a's, 1: b's)."""
    blocks = written(image_blocks(descriptors, block), "blocks")
    left = hot_join(pairs.select("a", "b").distinct().withColumnRenamed("a", "image_name"), _counted(blocks), "image_name").select(F.col("image_name").alias("a"), F.col("b").alias("image_name"), F.explode("blks").alias("ba"))
    both = hot_join(left, _counted(blocks), "image_name").select("a", F.col("image_name").alias("b"), "ba", F.explode("blks").alias("bb"))
    key = lambda n, k: F.concat_ws("#", F.col(n), F.col(k).cast("string"))
    whole = blocks.select(key("image_name", "blk").alias("key"), "idx", "vs")
    with_a = hot_join(both.withColumn("key", key("a", "ba")), whole, "key", hot_rows=HOT_PAIRS).select("a", "b", "bb", F.col("idx").alias("ia"), F.col("vs").alias("va"))
    hot_b = heavy_keys(both.select(key("b", "bb").alias("key")), "key", HOT_PAIRS) or False  # told from the pairs, before any vector is sent
    with_b = hot_join(with_a.withColumn("key", key("b", "bb")), whole, "key", hot=hot_b).select("a", "b", "ia", "va", F.col("idx").alias("ib"), F.col("vs").alias("vb"))
    near = with_b.mapInArrow(_two_nearest_pass(hamming), "a string, b string, side int, idx long, near long, d2 double")
    best = near.groupBy("a", "b", "side", "idx").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "near"))), 1, 2).alias("two"))
    return best.select("a", "b", "side", "idx", F.posexplode("two").alias("rank", "t")).select("a", "b", "side", "idx", (F.col("rank") + 1).alias("rank"), F.col("t.near").alias("near"), F.col("t.d2").alias("d2"))


def _counted(blocks: DataFrame) -> DataFrame:
    """``(image_name, blks)``: the block numbers of each image."""
    return blocks.groupBy("image_name").agg(F.collect_list("blk").alias("blks"))


def by_distance(found: DataFrame) -> DataFrame:
    """Matches with ``rank``, their place in the order of distance within the pair, from 1 (ties: smaller numbers)."""
    order = Window.partitionBy("a", "b").orderBy("d2", "query_idx", "train_idx")
    return found.withColumn("rank", F.row_number().over(order))


def mutual_matches(near: DataFrame) -> DataFrame:
    """``(a, b, query_idx, train_idx, d2)``: pairs of descriptors that are each other's nearest."""
    q = near.filter("side = 0 and rank = 1").select("a", "b", F.col("idx").alias("query_idx"), F.col("near").alias("train_idx"), "d2")
    t = near.filter("side = 1 and rank = 1").select("a", "b", F.col("near").alias("query_idx"), F.col("idx").alias("train_idx"))
    return q.join(t, ["a", "b", "query_idx", "train_idx"])


def ratio_matches(near: DataFrame, ratio: float = 0.7) -> DataFrame:
    """``(a, b, query_idx, train_idx, d2)``: nearest ones clearly nearer than the second, ``d1 < ratio * d2``.

    Compared by squares in hundredths, so that whole-number distances are exact. A descriptor
    of an image with a single counterpart has no second and gives no match.
    """
    square = round(ratio * ratio * 10_000)
    two = near.filter("side = 0").groupBy("a", "b", F.col("idx").alias("query_idx")).agg(F.min(F.struct("rank", "near", "d2")).alias("one"), F.max(F.struct("rank", "d2")).alias("two"))
    good = two.filter((F.col("two.rank") == 2) & (F.col("one.d2") * 10_000 < F.col("two.d2") * square))
    return good.select("a", "b", "query_idx", F.col("one.near").alias("train_idx"), F.col("one.d2").alias("d2"))


def matches(pairs: DataFrame, descriptors: DataFrame, method: str = "brute_force", binary: bool = False) -> DataFrame:
    """Matches of each pair by ``method``: ``brute_force`` (mutual nearest) or ``ratio`` (two nearest, L2 only)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    if method == "ratio" and binary:
        raise ValueError("the ratio test is defined for real descriptors only")
    near = two_nearest(pairs, descriptors, binary)
    return mutual_matches(near) if method == "brute_force" else ratio_matches(near)
