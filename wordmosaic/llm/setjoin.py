"""Problem 5: all similar pairs between set-valued records.

Method: prefix-filtered join. Tokens are ordered by rarity; of each set only the
rarest tokens that the threshold demands are indexed; length and positional
filters cut the candidates inside the join; the overlap is then counted exactly.

The prefixes are one token longer than needed, so that a pair must meet in two of
them: most pairs that share a single token by chance never become candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmosaic.llm.common import VOCABULARY, delivered_once
from wordmosaic.session import hot_join, written

#: Common tokens of the (longer) prefixes that a pair must have.
MEETINGS = 2
#: Rows of one token in the index above which its pairs are made in several tasks, by blocks of so many rows.
HOT_POSTINGS = 5_000
#: Copies of one set above which its members are taken in blocks of so many.
HOT_COPIES = 2_000
#: Hot tokens or sets up to which their list is broadcast (16 bytes each); beyond it, it is joined.
MAX_BROADCAST_HOT = 1_000_000
#: Largest token universe whose ranks are broadcast as one array (4 bytes a token).
MAX_DENSE_TOKENS = 4_000_000


def needed(theta: float, size_a: Column, size_b: Column) -> Column:
    """Overlap that two sets of these sizes need for a Jaccard similarity of ``theta``."""
    return F.ceil(F.lit(theta / (1 + theta)) * (size_a + size_b) - F.lit(1e-9)).cast("int")


def set_classes(sets: DataFrame) -> DataFrame:
    """``(cid, words, rep, copies, n, in_main)``: one row per distinct set, so that copies meet in no join.

    ``sets`` is ``(image_name, words sorted and distinct, in_main)``. Written once, so ``cid`` is stable.
    """
    grouped = sets.groupBy("words").agg(F.min("image_name").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("in_main").alias("in_main"), F.min("in_main").alias("all_main"))
    return written(grouped.select(F.monotonically_increasing_id().alias("cid"), "words", "rep", "copies", F.size("words").alias("n"), "in_main", "all_main"), "classes")


def class_members(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cid, image_name, in_main)`` of classes with copies; a class of one is its ``rep``.

    A set delivered by a third of all images would be one hot key: it is spread.
    """
    key = F.xxhash64("words")  # equal keys of different sets are told apart below
    several = classes.filter("copies > 1").select(key.alias("_k"), F.col("words").alias("_w"), "cid")
    if several.isEmpty():
        return classes.select("cid", F.col("rep").alias("image_name"), "in_main")
    rows = hot_join(sets.withColumn("_k", key), several, "_k").filter(F.col("words") == F.col("_w")).select("cid", "image_name", "in_main")
    return rows.unionAll(classes.filter("copies = 1").select("cid", F.col("rep").alias("image_name"), "in_main"))


def token_counts(classes: DataFrame) -> DataFrame:
    """``(token, df)``: number of distinct sets with each token."""
    return classes.select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _prefix_pass(ranks, alone: int, theta: float, extra: int):
    """Index rows of a batch of sets: the tokens by rank, without those that occur in one set only."""
    out = pa.schema([("token", pa.int32()), ("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            cid = batch.column(0).to_numpy()
            lists = batch.column(1)
            ends = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(cid), dtype=np.int64), ends)
            token = rank[lists.flatten().to_numpy()].astype(np.int64)
            ordered = np.sort(row << 32 | token)
            row, token = ordered >> 32, ordered & 0xFFFFFFFF
            pos = np.arange(len(row)) - np.repeat(np.cumsum(ends) - ends, ends) + 1
            n = ends[row]
            keep = (pos <= n - np.ceil(theta * n - 1e-9) + extra) & (token >= alone)
            row, token, pos, n = row[keep], token[keep], pos[keep], n[keep]
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int32)), pa.array(cid[row]), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32))], schema=out)

    return run


def prefix_index(classes: DataFrame, theta: float, extra: int = MEETINGS, max_dense: int = MAX_DENSE_TOKENS) -> DataFrame:
    """``(token, cid, n, pos)``: the prefix of each set in order of rarity, ``pos`` from 1.

    Ranks of a bounded universe (checked: at most ``max_dense`` tokens, 16 MB) are broadcast
    as an array, and the prefixes are cut in one narrow pass. Beyond it, ranks are joined.
    """
    spark = classes.sparkSession
    counts = written(token_counts(classes), "counts")
    low, high, many = counts.agg(F.min("token"), F.max("token"), F.count(F.lit(1))).first()
    if low is not None and low >= 0 and high < max_dense:
        table = counts.toArrow()
        token, df = table.column("token").to_numpy(), table.column("df").to_numpy()
        order = np.lexsort((token, df))
        rank = np.zeros(int(high) + 1, np.int32)
        rank[token[order]] = np.arange(len(order), dtype=np.int32)
        alone = int((df == 1).sum())
        schema = "token int, cid long, n int, pos int"
        return written(classes.select("cid", "words").mapInArrow(_prefix_pass(spark.sparkContext.broadcast(rank), alone, theta, extra), schema), "index")
    rows = classes.select("cid", "n", F.explode("words").alias("token"))
    rows = hot_join(rows, counts, "token")
    listed = rows.groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t")).select("cid", "n", F.posexplode("t").alias("pos", "t"))
    short = F.col("n") - F.ceil(F.lit(theta) * F.col("n") - 1e-9) + extra
    return written(listed.filter((F.col("pos") + 1 <= short) & (F.col("t.df") > 1)).select(F.col("t.token").alias("token"), "cid", "n", (F.col("pos") + 1).cast("int").alias("pos")), "index")


def _short(df: DataFrame) -> DataFrame:
    """A written list, to be broadcast if its counted size allows."""
    df = written(df, "hot")
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_HOT else df


#: Side of the rows in a task of one block alone; in a task of two blocks they have side 0 or 1.
BOTH = 2


def in_tasks(rows: DataFrame, item: str) -> DataFrame:
    """Rows with ``blocks`` as rows of ``task`` and ``side``: once for every pair of blocks that holds the row's own."""
    blk, n = F.pmod(F.xxhash64(item), F.col("blocks")).cast("int"), F.col("blocks")
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((F.least(F.col("_blk"), k) * n + F.greatest(F.col("_blk"), k)).alias("task"), F.when(F.col("_blk") == k, BOTH).otherwise((F.col("_blk") > k).cast("int")).alias("side")))
    placed = rows.withColumn("_blk", blk).withColumn("_p", F.explode(places))
    return placed.withColumn("task", F.col("_p.task")).withColumn("side", F.col("_p.side").cast("byte")).drop("_p", "_blk", "blocks")


def meet(first: Column, second: Column) -> Column:
    """Whether two rows of a task are made a pair in it (each two rows of a token in exactly one task)."""
    return (first == BOTH) | (first != second)


def block_pairs(index: DataFrame, hot_postings: int = HOT_POSTINGS) -> DataFrame:
    """``index`` with ``task`` and ``side``: rows of a token go to one task per pair of blocks.

    A block has about ``hot_postings`` rows whatever the number of rows of the token.
    """
    hot = index.groupBy("token").count().filter(F.col("count") > hot_postings).select("token", F.ceil(F.col("count") / hot_postings).cast("int").alias("blocks"))
    hot = _short(hot)
    usual = index.join(hot.select("token"), "token", "left_anti").withColumn("task", F.lit(0)).withColumn("side", F.lit(BOTH).cast("byte"))
    return usual.unionByName(in_tasks(index.join(hot, "token"), "cid"))


def candidate_pairs(index: DataFrame, theta: float, meetings: int = MEETINGS, hot_postings: int = HOT_POSTINGS) -> DataFrame:
    """``(x, y)``, x < y: pairs of classes whose prefixes meet often enough to be similar."""
    rows = block_pairs(index, hot_postings)
    a = rows.select("token", "task", F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("side").alias("sx"))
    b = rows.select("token", "task", F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("side").alias("sy"))
    need = needed(theta, F.col("nx"), F.col("ny"))
    lengths = (F.col("nx") >= F.lit(theta) * F.col("ny") - 1e-9) & (F.col("ny") >= F.lit(theta) * F.col("nx") - 1e-9)
    places = (F.col("px") <= F.col("nx") - need + meetings) & (F.col("py") <= F.col("ny") - need + meetings)
    met = a.join(b, ["token", "task"]).filter((F.col("x") < F.col("y")) & lengths & places & meet(F.col("sx"), F.col("sy")))
    counted = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.first(need).alias("need"))
    return counted.filter(F.col("c") >= F.least(F.col("need"), F.lit(meetings))).select("x", "y")


def verified_pairs(candidates: DataFrame, classes: DataFrame, theta: float) -> DataFrame:
    """``(x, y, overlap, jaccard)`` of the candidates whose exact similarity reaches ``theta``."""
    a = classes.select(F.col("cid").alias("x"), F.col("words").alias("wx"))
    b = classes.select(F.col("cid").alias("y"), F.col("words").alias("wy"))
    both = candidates.join(a, "x").join(b, "y").withColumn("overlap", F.size(F.array_intersect("wx", "wy")))
    union = F.size("wx") + F.size("wy") - F.col("overlap")
    return both.filter(F.col("overlap") >= F.lit(theta) * union).select("x", "y", "overlap", (F.col("overlap") / union).alias("jaccard"))


def as_sets(main: DataFrame, other: DataFrame | None = None, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(image_name, words, in_main)``: sets of valid words, written once; images without one are left out."""
    def one(bow: DataFrame, flag: bool) -> DataFrame:
        return delivered_once(bow, vocabulary).select("image_name", F.array_distinct("words").alias("words"), F.lit(flag).alias("in_main")).filter(F.size("words") > 0)

    return written(one(main, True) if other is None else one(main, True).unionAll(one(other, False)), "sets")


def class_pairs(main: DataFrame, other: DataFrame | None, theta: float, vocabulary: int = VOCABULARY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pairs of classes, members, classes)`` of a set similarity join of ``main`` with itself and ``other``."""
    sets = as_sets(main, other, vocabulary)
    classes = set_classes(sets)
    index = prefix_index(classes, theta)
    pairs = verified_pairs(candidate_pairs(index, theta), classes, theta)
    if other is not None:  # two sets that only ``other`` has are no pair
        only = classes.filter(~F.col("in_main")).select("cid")
        flagged = only.withColumn("o", F.lit(True))
        pairs = pairs.join(flagged.withColumnRenamed("cid", "x").withColumnRenamed("o", "ox"), "x", "left").join(flagged.withColumnRenamed("cid", "y").withColumnRenamed("o", "oy"), "y", "left")
        pairs = pairs.filter(F.col("ox").isNull() | F.col("oy").isNull()).select("x", "y", "overlap", "jaccard")
    return pairs, class_members(sets, classes), classes


def similar_set_pairs(main: DataFrame, other: DataFrame | None = None, theta: float = 0.5, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(name_a, name_b)``, name_a < name_b: images whose sets of valid words are similar by ``theta`` or more.

    Pairs lie within ``main`` or between ``main`` and ``other``, never within ``other``.
    Null, empty and all-invalid bags are in no pair, repeats within a bag and repeated
    deliveries count once, further columns are ignored, empty tables give an empty result.
    Equal sets are joined once as a class and only the result is written out by name.
    """
    pairs, members, classes = class_pairs(main, other, theta, vocabulary)
    # Members of a set with very many copies are taken in blocks, so that neither their pairs nor those with another set meet in one task.
    hot = _short(classes.filter(F.col("copies") > HOT_COPIES).select("cid", F.ceil(F.col("copies") / HOT_COPIES).cast("int").alias("blocks")))
    members = members.join(hot, "cid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = written(members.withColumn("blk", F.pmod(F.xxhash64("image_name"), F.col("blocks")).cast("int")), "members")
    a = members.select(F.col("cid").alias("x"), F.col("blk").alias("bx"), F.col("image_name").alias("ia"), F.col("in_main").alias("ma"))
    b = members.select(F.col("cid").alias("y"), F.col("blk").alias("by"), F.col("image_name").alias("ib"), F.col("in_main").alias("mb"))

    def spread(ends: DataFrame, end: str, blk: str) -> DataFrame:  # one row per block of the set at this end
        own = ends.join(hot.select(F.col("cid").alias(end), "blocks"), end, "left")
        return own.withColumn(blk, F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")

    across = spread(spread(pairs.select("x", "y"), "x", "bx").join(a, ["x", "bx"]), "y", "by").join(b, ["y", "by"])
    several = members.join(classes.filter("copies > 1").select("cid"), "cid", "left_semi")
    rows = in_tasks(several.drop("blk"), "image_name")
    one = rows.select("cid", "task", F.col("side").alias("sx"), F.col("image_name").alias("ia"), F.col("in_main").alias("ma"))
    two = rows.select("cid", "task", F.col("side").alias("sy"), F.col("image_name").alias("ib"), F.col("in_main").alias("mb"))
    alike = one.join(two, ["cid", "task"]).filter((F.col("ia") < F.col("ib")) & meet(F.col("sx"), F.col("sy")))
    named = across.select("ia", "ib", "ma", "mb").unionAll(alike.select("ia", "ib", "ma", "mb")).filter(F.col("ma") | F.col("mb"))
    named = named.filter(F.col("ia") != F.col("ib")).select(F.least("ia", "ib").alias("name_a"), F.greatest("ia", "ib").alias("name_b"))
    # Pairs of sets are unique, so pairs of names are, unless a name lies in both tables.
    if other is None or main.select("image_name").join(other.select("image_name"), "image_name", "left_semi").isEmpty():
        return named
    return named.distinct()


def set_classes_with_links(main: DataFrame, other: DataFrame | None = None, theta: float = 0.5) -> DataFrame:
    """``(image_name, class_name, copies, links)``: one row per image that has a valid word, with its class of equal sets.

    The bounded form of the result: ``links`` counts the other classes similar to the image's own.
    """
    pairs, members, classes = class_pairs(main, other, theta)
    ends = pairs.select(F.col("x").alias("cid")).unionAll(pairs.select(F.col("y").alias("cid"))).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    told = classes.select("cid", F.col("rep").alias("class_name"), "copies").join(ends, "cid", "left")
    return hot_join(members.select("cid", "image_name"), told, "cid").select("image_name", "class_name", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5 over whole ``bow`` and ``ref_bow``."""
    return similar_set_pairs(spark.read.parquet(f"{d}/bow.parquet"), spark.read.parquet(f"{d}/ref_bow.parquet"), 0.5)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every image of ``bow`` and ``ref_bow`` that has a valid word, with its class of equal sets and its number of similar classes."""
    return set_classes_with_links(spark.read.parquet(f"{d}/bow.parquet"), spark.read.parquet(f"{d}/ref_bow.parquet"), 0.5)
