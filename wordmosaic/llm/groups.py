"""Problem 1: pairwise matches consolidated into groups.

Method: minimum labels are propagated along the edges, pointer jumping shortens
the label chains to their roots, the graph is contracted onto the roots, and each
round is written to the shared folder, until no label changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmosaic.functions.names import image_name
from wordmosaic.session import HOT_ROWS, dropped, heavy_keys, hot_join, written_with


def clean_edges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected edges ``u < v``, once each: null ends and loops removed, other columns ignored."""
    u, v = F.col(a), F.col(b)
    return pairs.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), (u.isNull() | v.isNull() | (u == v)).alias("_bad")).filter(~F.col("_bad")).select("u", "v").distinct()


def _rows() -> Column:
    return F.count(F.lit(1))


def _jumped(labels: DataFrame, rows: int, **limit: int) -> DataFrame:
    """``labels(node, label)`` with every label replaced by the root of its chain.

    Each jump doubles the length of the chains looked through; it is written, and the last is the one that moves nothing.
    """
    while True:
        hot = False if rows <= limit.get("hot_rows", HOT_ROWS) else heavy_keys(labels, "label", **limit) or False
        step = labels.filter(F.col("label") != F.col("node")).select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = hot_join(labels.select("node", "label"), step, "label", "left", hot=hot)
        after, seen = written_with(after.select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")), "labels", moved=F.count_if("moved"))
        dropped(labels)
        labels = after.select("node", "label")
        if not seen["moved"]:
            return labels


def connected_groups(pairs: DataFrame, a: str, b: str, hot_rows: int | None = None) -> DataFrame:
    """``(node, label)``: every linked node with the smallest node linked with it directly or indirectly.

    Columns ``a`` and ``b`` may be of any ordered type; strings compare by code points.
    Rows with a null end or ``a = b`` link nothing. Repeated and reversed pairs count
    once, further columns are ignored, and an empty table gives an empty result.

    A node with very many links is no bottleneck: minima are combined before the
    shuffle, and relabelling spreads hot keys over several tasks.
    """
    limit = {} if hot_rows is None else {"hot_rows": hot_rows}
    edges, seen = written_with(clean_edges(pairs, a, b), "edges", rows=_rows())
    rounds: list[DataFrame] = []
    while seen["rows"]:
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionAll(edges.select(F.col("v").alias("node"), F.col("u").alias("near")))
        lowest = both.groupBy("node").agg(F.min("near").alias("near"))
        first, nodes_seen = written_with(lowest.select("node", F.least("node", "near").alias("label")), "labels", rows=_rows())
        labels = _jumped(first, nodes_seen["rows"], **limit)
        rounds.append(labels)
        hot = {"hot": False} if seen["rows"] <= limit.get("hot_rows", HOT_ROWS) else limit  # no key of so few rows can be hot
        # Contract: ends become roots; edges inside one tree vanish.
        left = hot_join(edges.withColumnRenamed("u", "node"), labels, "node", **hot).select(F.col("label").alias("u"), F.col("v").alias("node"))
        nodes = hot_join(left, labels, "node", **hot).select("u", F.col("label").alias("v"))
        after, seen = written_with(clean_edges(nodes, "u", "v"), "edges", rows=_rows())
        dropped(edges)
        edges = after
    if not rounds:
        kind = edges.schema["u"].dataType
        return edges.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("label"))
    # Later rounds know the roots of earlier roots.
    total = rounds[-1]
    for labels in reversed(rounds[:-1]):
        roots = total.select(F.col("node").alias("label"), F.col("label").alias("root"))
        total = hot_join(labels, roots, "label", "left", **limit).select("node", F.coalesce("root", "label").alias("label"))
    return total


def match_links(pairs: DataFrame, verified: DataFrame, min_sim: float = 0.35, min_inliers: int = 50) -> DataFrame:
    """``(a, b)``: image names linked by a score in ``[min_sim, 1]`` or by enough inliers.

    Null, NaN and out-of-range scores and null or negative counts link nothing
    (Spark orders NaN above 1). One good row is enough when a pair is repeated.
    """
    scored = pairs.filter((F.col("sim") >= min_sim) & (F.col("sim") <= 1.0)).select(image_name(F.col("a")).alias("a"), image_name(F.col("b")).alias("b"))
    checked = verified.filter(F.col("n_inliers") >= min_inliers).select(image_name(F.col("a")).alias("a"), image_name(F.col("b")).alias("b"))
    return scored.unionAll(checked)


def image_groups(links: DataFrame) -> DataFrame:
    """``(image_name, group_name)`` over links ``(a, b)``."""
    return connected_groups(links, "a", "b").select(F.col("node").alias("image_name"), F.col("label").alias("group_name"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """``(group_name, n_images)`` of a result of :func:`image_groups`."""
    return groups.groupBy("group_name").agg(F.count(F.lit(1)).alias("n_images"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1 over whole ``pairs`` and ``verified``."""
    pairs = spark.read.parquet(f"{d}/pairs.parquet")
    verified = spark.read.parquet(f"{d}/verified.parquet")
    return image_groups(match_links(pairs, verified))


def p1_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all groups of problem 1."""
    return group_sizes(p1_found(spark, d))
