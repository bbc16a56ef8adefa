"""Similarity of pairs: exact Jaccard, bands, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmosaic.functions.names import image_name
from wordmosaic.operators.runs import whole_runs
from wordmosaic.session import hot_join, written

#: Bands by default: below the first irrelevant, from the second on duplicate, similar between.
MIN_SIM, MAX_SIM = 0.045, 0.35
#: Images of a block of :func:`all_pairs`, and the side of those of a block that meets itself.
BLOCK, BOTH = 16_384, 2
#: Pairs, and meetings of two images in a rare word, that are held at a time.
PAIRS_HELD, MEETINGS_HELD = 8_000_000, 4_000_000
#: Share of pairs from which a common word is counted by the matrix product, and most such words.
DENSE_SHARE, MOST_DENSE = 0.003, 1_024


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; two empty sets have none (null)."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, shared / union)


def weighted_jaccard(pairs: DataFrame, bags: DataFrame, weights: DataFrame) -> DataFrame:
    """``(a, b, sim)``: weight of the shared words over weight of all words of both images."""
    words = bags.select("image_name", F.explode(F.array_distinct("words")).alias("word")).join(weights.select("word", "weight"), "word")
    own = words.groupBy("image_name").agg(F.sum("weight").alias("w"))
    left = hot_join(pairs.select("a", "b").withColumnRenamed("a", "image_name"), own, "image_name").select(F.col("image_name").alias("a"), F.col("b").alias("image_name"), F.col("w").alias("wa"))
    both = hot_join(left, own, "image_name").select("a", F.col("image_name").alias("b"), "wa", F.col("w").alias("wb"))
    shared = pairs.select("a", "b").join(words.select(F.col("image_name").alias("a"), "word", "weight"), "a").join(words.select(F.col("image_name").alias("b"), "word"), ["b", "word"]).groupBy("a", "b").agg(F.sum("weight").alias("s"))
    return both.join(shared, ["a", "b"], "left").select("a", "b", (F.coalesce("s", F.lit(0.0)) / (F.col("wa") + F.col("wb") - F.coalesce("s", F.lit(0.0)))).alias("sim"))


def clean_pairs(pairs: DataFrame, value: str = "sim") -> DataFrame:
    """``(a, b, sim)``, a < b: one row per pair of bare names, the best score in [0, 1].

    Null names, loops, and null, NaN and out-of-range scores are left out.
    """
    a, b = image_name(F.col("a")), image_name(F.col("b"))
    rows = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a != b).alias("_ok"), F.col(value).alias("sim"))
    return rows.filter(F.col("_ok") & (F.col("sim") >= 0) & (F.col("sim") <= 1)).groupBy("a", "b").agg(F.max("sim").alias("sim"))


def clean_verified(verified: DataFrame) -> DataFrame:
    """``(a, b, sim, n_inliers)``, a < b: one row per pair, most inliers; null and negative counts left out."""
    a, b = image_name(F.col("a")), image_name(F.col("b"))
    rows = verified.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a != b).alias("_ok"), F.when((F.col("sim") >= 0) & (F.col("sim") <= 1), F.col("sim")).alias("sim"), "n_inliers")
    return rows.filter(F.col("_ok") & (F.col("n_inliers") >= 0)).groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("n_inliers").alias("n_inliers"))


def band(sim: Column, low: float = MIN_SIM, high: float = MAX_SIM) -> Column:
    """``irr`` below ``low``, ``dup`` from ``high`` on, ``sim`` between."""
    return F.when(sim < low, "irr").when(sim < high, "sim").otherwise("dup")


def in_band(pairs: DataFrame, low: float = MIN_SIM, high: float = MAX_SIM) -> DataFrame:
    """Pairs worth verifying: ``low <= sim < high``."""
    return pairs.filter((F.col("sim") >= low) & (F.col("sim") < high))


def band_counts(pairs: DataFrame, low: float = MIN_SIM, high: float = MAX_SIM) -> DataFrame:
    """``(n_irr, n_sim, n_dup, n_pairs)`` in one pass."""
    b = band(F.col("sim"), low, high)
    return pairs.agg(*(F.count_if(b == x).alias(f"n_{x}") for x in ("irr", "sim", "dup")), F.count(F.lit(1)).alias("n_pairs"))


def jaccard_of_pairs(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """``(a, b, sim, jaccard)``: given pairs with the exact similarity of their word sets.

    An image in very many pairs is a hot key of both joins: it is spread.
    """
    sets = bags.select("image_name", F.array_distinct("words").alias("words"))
    left = hot_join(pairs.withColumnRenamed("a", "image_name"), sets, "image_name").select(F.col("image_name").alias("a"), F.col("b").alias("image_name"), "sim", F.col("words").alias("wa"))
    both = hot_join(left, sets, "image_name")
    return both.select("a", F.col("image_name").alias("b"), "sim", jaccard(F.col("wa"), F.col("words")).alias("jaccard"))


def _expanded(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs ``start`` to ``start + count``: which run, and which place, of every element."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) + np.repeat(start - (np.cumsum(count) - count), count)


def _overlaps(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, sim)`` of the sets of ``x`` and ``y`` with a similarity of ``least`` or more, a chunk of ``x`` at a time.

    Both are ``(row, word, n)``: entries, rows ascending, and the size of each set. Shared words are counted
    for all pairs: common words as one matrix product, the others word by word from lists.
    """
    (row_x, word_x, n_x), (row_y, word_y, n_y) = x, y
    m_x, m_y = len(n_x), len(n_y)
    words, number = np.unique(np.concatenate([word_x, word_y]), return_inverse=True)
    word_x, word_y = number[: len(word_x)], number[len(word_x) :]
    meetings = np.bincount(word_x, minlength=len(words)).astype(np.float64) * np.bincount(word_y, minlength=len(words))
    top = np.argsort(-meetings, kind="stable")[:MOST_DENSE]
    top = top[meetings[top] > DENSE_SHARE * m_x * m_y]
    column = np.full(len(words), -1)
    column[top] = np.arange(len(top))
    # Besides the common words two columns: sizes, so that the product is what the overlap exceeds the needed one by.
    kind = np.float32 if max(n_x.max(initial=0), n_y.max(initial=0)) < 50_000 else np.float64
    need = least / (1 + least)
    right = np.zeros((len(top) + 2, m_y), kind)
    common = column[word_y] >= 0
    right[column[word_y[common]], row_y[common]] = 1
    right[-2], right[-1] = -need * n_y, 1
    order = np.argsort(word_y[~common], kind="stable")
    listed = row_y[~common][order]
    start = np.searchsorted(word_y[~common][order], np.arange(len(words) + 1))
    common = column[word_x] >= 0
    held = max(1, PAIRS_HELD // max(1, m_y))
    for s in range(0, m_x, held):
        n = n_x[s : s + held]
        lo, hi = np.searchsorted(row_x, [s, s + len(n)])
        row, word, dense = row_x[lo:hi] - s, word_x[lo:hi], common[lo:hi]
        left = np.zeros((len(n), len(top) + 2), kind)
        left[row[dense], column[word[dense]]] = 1
        left[:, -2], left[:, -1] = 1, -need * n
        over = (left @ right).ravel()
        row, word = row[~dense], word[~dense]
        count = start[word + 1] - start[word]
        ends = np.cumsum(count)
        k = 0
        while k < len(row):  # so many entries at a time that their meetings stay bounded
            to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + MEETINGS_HELD, "right")))
            which, at = _expanded(start[word[k:to]], count[k:to])
            np.add.at(over, row[k:to][which] * m_y + listed[at], kind(1))
            k = to
        found = np.flatnonzero(over > -1e-2)
        i, j = found // m_y, found % m_y
        both = n[i] + n_y[j]
        shared = np.rint(over[found] + need * both).astype(np.int64)
        near = (shared > 0) & (shared / np.maximum(both - shared, 1) >= least) & ((not same) | (i + s < j))
        i, j, shared, both = i[near], j[near], shared[near], both[near]
        yield i + s, j, shared / (both - shared)


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = table.column("words").combine_chunks()
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), table.column("n").to_numpy().astype(np.int64)


def _all_pairs_pass(least: float, named: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for several in whole_runs(batches, ["task"]):
            for task in np.unique(several.column("task").to_numpy()):
                table = several.filter(pc.equal(several.column("task"), task))
                side = table.column("side")
                same = pc.max(side).as_py() == BOTH
                x, y = (table, table) if same else (table.filter(pc.equal(side, 0)), table.filter(pc.equal(side, 1)))
                if not x.num_rows or not y.num_rows:
                    continue
                names = pa.concat_arrays([x.column("image_name").combine_chunks(), y.column("image_name").combine_chunks()])
                place = np.empty(len(names), np.int64)
                place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                for i, j, sim in _overlaps(_entries(x), _entries(y), least, same):
                    j = j + x.num_rows
                    low, high = np.where(place[i] < place[j], i, j), np.where(place[i] < place[j], j, i)
                    ends = [names.take(pa.array(low)), names.take(pa.array(high))] if named else []
                    yield pa.RecordBatch.from_arrays([*ends, pa.array(sim)], names=[*(["a", "b"] if named else []), "sim"])

    return run


def all_pairs(bags: DataFrame, least: float = MIN_SIM, named: bool = True, block: int = BLOCK) -> DataFrame:
    """``(a, b, sim)``, a < b: every two images of ``bags`` with an exact similarity of ``least`` or more, without any index.

    What a search may be measured against: images are cut into blocks, every two blocks meet in one
    task, and the shared words of all their pairs are counted there. So only images travel, once for each
    block, and pairs leave a task as they are, by name, or as ``(sim)`` alone where not ``named``.
    """
    words = F.array_distinct("words")
    images = written(bags.select(F.monotonically_increasing_id().alias("no"), "image_name", F.size(words).alias("n"), F.array_compact(words).alias("words")), "images")
    blocks = max(1, -(-images.count() // block))
    own = F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int")
    places = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct((F.least(F.col("_b"), k) * blocks + F.greatest(F.col("_b"), k)).alias("task"), F.when(F.col("_b") == k, BOTH).otherwise((F.col("_b") > k).cast("int")).alias("side")))
    tasks = images.withColumn("_b", own).select("image_name", "n", "words", F.explode(places).alias("p")).select("p.task", "p.side", "image_name", "n", "words")
    kind = images.schema["image_name"].dataType.simpleString()
    return tasks.repartition(blocks * (blocks + 1), "task").sortWithinPartitions("task").mapInArrow(_all_pairs_pass(least, named), f"a {kind}, b {kind}, sim double" if named else "sim double")


def bands_found(bags: DataFrame, found: DataFrame, least: float = MIN_SIM) -> DataFrame:
    """``(band, n_pairs, n_found)`` of all pairs of ``least`` or more; ``found (a, b, sim)`` are some, with their exact similarity.

    As both have it, they are counted by band, and no pairs are joined.
    """
    by = lambda pairs, n: pairs.groupBy(band(F.col("sim")).alias("band")).agg(F.count(F.lit(1)).alias(n))
    return by(all_pairs(bags, least, named=False), "n_pairs").join(by(found.filter(F.col("sim") >= least), "n_found"), "band", "left").select("band", "n_pairs", F.coalesce("n_found", F.lit(0).cast("long")).alias("n_found"))


def lowest(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` pairs of least score (ties by name)."""
    return pairs.orderBy("sim", "a", "b").limit(n)


def most_inliers(verified: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` verified pairs of most inliers (ties by name)."""
    return verified.orderBy(F.desc("n_inliers"), "a", "b").limit(n)


def page(verified: DataFrame, first: int = 10, n: int = 10) -> DataFrame:
    """Rows ``first`` to ``first + n`` of the verified pairs by ascending inliers."""
    return verified.orderBy("n_inliers", "a", "b").offset(first).limit(n)


def sampled(pairs: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` pairs chosen by a hash of their names: the same for every partitioning, in any engine."""
    key = F.md5(F.concat_ws("|", "a", "b", F.lit(str(seed))))
    return pairs.withColumn("_k", key).orderBy("_k", "a", "b").limit(n).drop("_k")
