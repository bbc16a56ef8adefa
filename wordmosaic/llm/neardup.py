"""Problem 6: near-duplicate records with small edits.

Method: blocked sparse matrix product of the record-by-term incidence with itself.
Rows are the distinct sets, columns the terms in order of rarity. Only the columns a
pair above the threshold must share are multiplied (a bound from the set sizes); the
product is made block by block, overlap counts are accumulated within a block of
columns before anything is shuffled, and pairs whose count stays below the bound
are discarded. The rest is counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmosaic.functions.names import image_name
from wordmosaic.llm.common import VOCABULARY
from wordmosaic.llm.groups import connected_groups
from wordmosaic.llm.setjoin import BOTH, HOT_POSTINGS, MEETINGS, as_sets, block_pairs, class_members, prefix_index, set_classes, verified_pairs
from wordmosaic.operators.runs import whole_runs

#: Products held before equal pairs are added up.
HELD = 2_000_000


def _products(theta: float, meetings: int):
    """Overlap counts of all pairs of rows within each column of a block, added up over the block's columns."""
    out = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("c", pa.int64()), ("need", pa.int32())])
    share = theta / (1 + theta)

    def added(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        x, y, c, need = (np.concatenate(a) for a in zip(*held, strict=True))
        order = np.lexsort((y, x))
        x, y, c, need = x[order], y[order], c[order], need[order]
        start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, int)
        return x[start], y[start], np.add.reduceat(c, start) if len(start) else c, need[start]

    def pairs(left, right, n, pos, cid, side):
        nl, nr = n[left], n[right]
        need = np.ceil(share * (nl + nr) - 1e-9).astype(np.int32)
        ok = (nl >= theta * nr - 1e-9) & (nr >= theta * nl - 1e-9)
        ok &= (pos[left] <= nl - need + meetings) & (pos[right] <= nr - need + meetings)
        ok &= (side[left] == BOTH) | (side[left] != side[right])
        a, b = cid[left[ok]], cid[right[ok]]
        return np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64), need[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for table in whole_runs(batches, ["token", "task"]):
            token, task, cid, n, pos, side = (table.column(c).to_numpy() for c in ("token", "task", "cid", "n", "pos", "side"))
            cut = np.flatnonzero((token[1:] != token[:-1]) | (task[1:] != task[:-1])) + 1
            end = np.repeat(np.r_[cut, len(token)], np.diff(np.r_[0, cut, len(token)]))
            after = end - np.arange(len(token)) - 1  # rows of the same column that follow
            at, total = 0, np.cumsum(after)
            while at < len(token):  # a slice of rows with a bounded number of products
                base = total[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(total, base + HELD, "right")))
                m = after[at:to]
                left = np.repeat(np.arange(at, to), m)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
                part = pairs(left, right, n, pos, cid, side)
                at = to
                if len(part[0]):
                    held.append(part)
                    size += len(part[0])
                if size > HELD:
                    held = [added(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], schema=out)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in added(held)], schema=out)

    return run


def product_candidates(index: DataFrame, theta: float, meetings: int = MEETINGS, hot_postings: int = HOT_POSTINGS) -> DataFrame:
    """``(x, y)``: pairs of rows whose accumulated overlap in the bounded columns reaches the bound."""
    blocks = block_pairs(index, hot_postings).repartition("token", "task").sortWithinPartitions("token", "task")
    partial = blocks.mapInArrow(_products(theta, meetings), "x long, y long, c long, need int")
    total = partial.groupBy("x", "y").agg(F.sum("c").alias("c"), F.min("need").alias("need"))
    return total.filter(F.col("c") >= F.least(F.col("need"), F.lit(meetings))).select("x", "y")


def near_duplicate_links(bow: DataFrame, theta: float = 0.8, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(a, b)``: links that join exactly the images whose sets are similar by ``theta`` or more.

    Copies of one set are linked to the smallest name among them, and two similar sets by these
    smallest names: as many links as there are images and similar sets, not all pairs of copies.
    """
    sets = as_sets(bow, None, vocabulary)
    classes = set_classes(sets)
    pairs = verified_pairs(product_candidates(prefix_index(classes, theta), theta), classes, theta)
    rep = classes.select("cid", "rep")
    between = pairs.select("x", "y").join(rep.select(F.col("cid").alias("x"), F.col("rep").alias("a")), "x").join(rep.select(F.col("cid").alias("y"), F.col("rep").alias("b")), "y").select("a", "b")
    several = classes.filter("copies > 1")
    members = class_members(sets, classes)
    copies = members.join(several.select("cid", "rep"), "cid").select(F.col("rep").alias("a"), F.col("image_name").alias("b"))
    return between.unionAll(copies.filter(F.col("a") != F.col("b")))


def near_duplicate_groups(bow: DataFrame, pairs: DataFrame | None = None, theta: float = 0.8, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(image_name, group_name)`` of every image with a near-duplicate, by bags or by a score in ``[theta, 1]``.

    Null, empty and all-invalid bags are similar to nothing (a score may still link their image).
    Null names, loops, null, NaN and out-of-range scores link nothing; repeats count once.
    """
    links = near_duplicate_links(bow, theta, vocabulary)
    if pairs is not None:
        good = pairs.filter((F.col("sim") >= theta) & (F.col("sim") <= 1.0))
        links = links.unionAll(good.select(image_name(F.col("a")).alias("a"), image_name(F.col("b")).alias("b")))
    return connected_groups(links, "a", "b").select(F.col("node").alias("image_name"), F.col("label").alias("group_name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6 over whole ``bow`` and ``pairs``."""
    return near_duplicate_groups(spark.read.parquet(f"{d}/bow.parquet"), spark.read.parquet(f"{d}/pairs.parquet"))
