"""Problem 3: frequency of every distinct term and term sequence.

Method: suffix-sorted n-gram counting. Each record gives its suffixes, cut to the
longest sequence wanted; equal ones of a batch are combined before the shuffle; they
are routed by their first term, sorted in reverse lexicographic order, and one pass
with a stack closes every prefix as soon as a suffix no longer starts with it.

The stack needs the set of records below each prefix. A set is not carried:
within a record, a suffix opens only those prefixes its predecessor in the
record's own suffix order does not have, so "prefixes first opened here" is a
number per length that simply adds up to the number of distinct records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmosaic.llm.common import VOCABULARY, delivered_once
from wordmosaic.operators.runs import whole_runs
from wordmosaic.session import SALTS, hot_keys, written

#: A term with at most so many occurrences is too rare to be useful.
RARE = 3
#: A term in more than this share of the records is too common to be useful.
COMMON = 0.05
#: Length at which suffixes of the bags are cut: words and sequences of two come from one pass.
LONGEST = 2
#: Distinct suffixes of one first term above which they are spread over several tasks.
HOT_SUFFIXES = 200_000


def _grid(lists: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of arrays of terms: codes of the first ``longest`` terms (-1 beyond the end), lengths, starts in the flat values, and these."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(length) - length
    plain = pa.types.is_integer(flat.type) and (pc.min(flat).as_py() or 0) >= 0
    codes = (flat if plain else pc.dictionary_encode(flat).indices).to_numpy(zero_copy_only=False).astype(np.int64)
    at = start[:, None] + np.arange(longest)
    grid = np.where(np.arange(longest) < length[:, None], np.r_[codes, -1][np.minimum(at, len(codes))], -1)
    return grid, length, start, flat


def _lists(flat: pa.Array, at: np.ndarray, length: np.ndarray) -> pa.ListArray:
    """Arrays of ``length`` values from ``at`` on."""
    ends = np.r_[0, np.cumsum(length)]
    take = np.repeat(at - ends[:-1], length) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.take(pa.array(take)))


def _same(grid: np.ndarray) -> np.ndarray:
    """Per row the number of leading terms it shares with the row above."""
    alike = np.zeros(grid.shape, bool)
    alike[1:] = (grid[1:] == grid[:-1]) & (grid[1:] >= 0)
    return np.logical_and.accumulate(alike, axis=1).sum(axis=1)


def _suffix_pass(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, length, _, flat = _grid(batch.column(0), 1)
            if not len(flat):
                continue
            # A suffix starts at every term and ends with its record: cut it to the longest sequence wanted.
            record = np.repeat(np.arange(len(length)), length)
            left = np.repeat(np.cumsum(length), length) - np.arange(len(flat))
            cut = np.minimum(left, longest)
            grid = _grid(_lists(flat, np.arange(len(flat)), cut), longest)[0]
            order = np.lexsort((*grid.T[::-1], record))
            known = _same(grid[order])
            known[np.r_[True, record[order][1:] != record[order][:-1]]] = 0
            # Equal suffixes of the batch are combined before anything is shuffled.
            again = np.lexsort(grid[order].T[::-1])
            rows, known = order[again], known[again]
            runs = np.flatnonzero((_same(grid[rows]) < np.maximum(cut[rows], np.r_[0, cut[rows][:-1]])))
            n = np.diff(np.r_[runs, len(rows)])
            opened = np.stack([np.add.reduceat((known < k).astype(np.int64), runs) for k in range(1, longest + 1)], axis=1)
            heads = rows[runs]
            yield pa.RecordBatch.from_arrays(
                [flat.take(pa.array(heads)), _lists(flat, heads, cut[heads]), pa.array(n), pa.FixedSizeListArray.from_arrays(pa.array(opened.ravel()), longest).cast(pa.list_(pa.int64()))],
                names=["first", "suffix", "n", "opened"],
            )

    return run


def suffixes(records: DataFrame, terms: str, longest: int) -> DataFrame:
    """``(first, suffix, n, opened)``: cut suffixes with occurrences and, per length, records first opened, combined by batch."""
    kind = records.schema[terms].dataType.elementType.simpleString()
    rows = records.select(F.filter(F.col(terms), lambda w: w.isNotNull()).alias("t")).filter(F.size("t") > 0)
    return rows.mapInArrow(_suffix_pass(longest), f"first {kind}, suffix array<{kind}>, n long, opened array<long>")


def _stack_pass(longest: int, lengths: frozenset[int]):
    """Closes prefixes over suffixes in reverse order.

    A row leaves open the prefixes it shares with the row above, closes the deeper ones and opens its
    own; rows up to where a prefix closes add to its counts. The stack has ``longest`` levels at most,
    and each is kept as the rows at which its prefixes open, so a whole run of rows is closed at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["first", "salt"]):
            grid, length, start, flat = _grid(table.column("suffix"), longest)
            n = table.column("n").to_numpy()
            opened = _grid(table.column("opened"), longest)[0]
            kept = _same(grid)
            for level in sorted(lengths):
                deep = length >= level  # rows on whose stack this level lies
                opens = np.flatnonzero((kept < level)[deep])
                if not len(opens):
                    continue
                at = start[deep][opens]
                yield pa.RecordBatch.from_arrays(
                    [_lists(flat, at, np.full(len(at), level)), pa.array(np.add.reduceat(n[deep], opens)), pa.array(np.add.reduceat(opened[deep, level - 1], opens))],
                    names=["gram", "occurrences", "records"],
                )

    return run


def sequence_counts(records: DataFrame, terms: str, longest: int = 1, hot_suffixes: int = HOT_SUFFIXES, lengths: set[int] | None = None) -> DataFrame:
    """``(gram, occurrences, records)`` of every sequence of 1 to ``longest`` neighbouring terms, or only of some ``lengths``.

    ``records`` has one row per record and an array column ``terms``; a record repeated as
    a row counts again (remove redeliveries first). Null and empty arrays hold nothing, null
    terms are skipped and the terms beside them count as neighbours. Other columns are ignored.
    """
    if longest < 1:
        raise ValueError("longest must be at least 1")
    found = written(suffixes(records, terms, longest), "suffixes")
    hot = hot_keys(found, "first", hot_suffixes)
    salt = F.when(F.col("first").isin(hot), F.pmod(F.xxhash64("suffix"), F.lit(SALTS))).otherwise(F.lit(0)) if hot else F.lit(0)
    routed = found.withColumn("salt", salt.cast("int")).repartition("first", "salt").sortWithinPartitions(F.desc("first"), F.desc("salt"), F.desc("suffix"))
    kind = records.schema[terms].dataType.simpleString()
    closed = routed.mapInArrow(_stack_pass(longest, frozenset(lengths or range(1, longest + 1))), f"gram {kind}, occurrences long, records long")
    if not hot:
        return closed
    # A hot first term was spread over several tasks, each of which closed its own part of a prefix.
    return closed.groupBy("gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_marks(counts: DataFrame, n_records: int, rare: int = RARE, common: float = COMMON) -> DataFrame:
    """``counts`` with ``mark``: an array of ``rare`` and ``common`` as they apply (of few records, both may)."""
    is_rare = F.when(F.col("occurrences") <= rare, F.lit("rare"))
    is_common = F.when(F.col("records") > F.lit(common) * F.lit(n_records), F.lit("common"))
    return counts.withColumn("marks", F.array_compact(F.array(is_rare, is_common)))


def word_statistics(bow: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(word, occurrences, images, marks)`` of every valid word; images delivered twice count once.

    The words are the prefixes of length 1 that the stack closes over the same cut suffixes
    from which :func:`p3_sequences` takes those of length 2.
    """
    n_images = bow.agg(F.count_distinct("image_name")).first()[0]
    counts = sequence_counts(delivered_once(bow, vocabulary), "words", LONGEST, lengths={1})
    return term_marks(counts, n_images).select(F.col("gram")[0].alias("word"), "occurrences", F.col("records").alias("images"), "marks")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 3: the words that are too rare or too common, one row per mark."""
    return word_statistics(spark.read.parquet(f"{d}/bow.parquet")).select("word", F.explode("marks").alias("mark"))


def p3_words(spark: SparkSession, d: str) -> DataFrame:
    """Every valid word with its number of occurrences and of images, and its mark if it has one."""
    return word_statistics(spark.read.parquet(f"{d}/bow.parquet")).select("word", "occurrences", "images", F.array_join("marks", "+").alias("mark"))


def p3_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of two neighbouring words in the sorted bags of valid words, with both counts."""
    bags = delivered_once(spark.read.parquet(f"{d}/bow.parquet"))
    counts = sequence_counts(bags, "words", LONGEST, lengths={2})
    return counts.select(F.col("gram")[0].alias("word_1"), F.col("gram")[1].alias("word_2"), "occurrences", F.col("records").alias("images"))
