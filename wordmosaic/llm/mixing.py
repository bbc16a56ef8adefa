"""Problem 8: sources mixed to target weights.

Method: pivotal dependent rounding. Within a source every document has the same
expected number of copies; the whole part is given, the fraction is rounded by
pivotal steps: two documents with a fraction meet, mass moves from one to the other
in a random direction until one of them is settled. Mass is weighed by tokens, so a
source's tokens are kept exactly at each step. Each task settles all but one
document of a source; the ones left over meet in a reduction tree of small groups
until one is left per source, which is rounded by itself: a source ends within one
document of its target.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmosaic.llm.tokenize import TOKENIZERS, token_counts
from wordmosaic.session import written

#: Leftovers that meet in one group of the reduction tree.
FAN_IN = 64
#: Documents of one first-level group, about.
GROUP_DOCS = 50_000
SEED = 20240229


def source_name(column: Column) -> Column:
    """A source as compared: trimmed, in lower case."""
    return F.lower(F.trim(column))


def sized_documents(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """``(doc_id, source, n_tokens)``, one row per doc_id: a repeated id is one document, a null id none.

    Of rows with the same id the one with most tokens counts, then the smaller source.
    """
    named = documents.select(F.struct("doc_id", source_name(F.col("source")).alias("source")).alias("doc_id"), "text")
    sizes = token_counts(named, tokenizer).select("doc_id.doc_id", "doc_id.source", "n_tokens").filter(F.col("doc_id").isNotNull())
    best = F.min(F.struct((-F.col("n_tokens")).alias("m"), "source")).alias("b")
    return sizes.groupBy("doc_id").agg(best).select("doc_id", F.col("b.source").alias("source"), (-F.col("b.m")).alias("n_tokens"))


def source_plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``(source, target_weight, max_repeat, docs, tokens, target_tokens, rate)`` for every target source.

    A source's target is its weight times ``total_tokens``, by default all tokens of the
    collection (of documents without a usable source too). ``rate`` is the expected number
    of copies of each of its documents: target over own tokens, at most ``max_repeat``. A
    source too small for its share gives all it may; one that is absent gives nothing; the
    others are not enlarged in their place. Targets with a null source, weight or repeat, or
    with a negative one, count as weight 0; of repeated targets the largest weight counts.
    """
    have = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    if total_tokens is None:
        total_tokens = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    weight = F.greatest(F.coalesce(F.col("target_weight"), F.lit(0.0)), F.lit(0.0))
    weight = F.when(F.isnan(weight) | F.col("max_repeat").isNull(), F.lit(0.0)).otherwise(weight)
    wanted = targets.filter(F.col("source").isNotNull()).select(source_name(F.col("source")).alias("source"), F.struct(weight.alias("w"), F.greatest(F.coalesce(F.col("max_repeat"), F.lit(0)), F.lit(0)).alias("r")).alias("t"))
    wanted = wanted.groupBy("source").agg(F.max("t").alias("t")).select("source", F.col("t.w").alias("target_weight"), F.col("t.r").alias("max_repeat"))
    plan = wanted.join(have, "source", "left").fillna(0, ["docs", "tokens"]).withColumn("target_tokens", F.col("target_weight") * F.lit(float(total_tokens)))
    rate = F.least(F.col("target_tokens") / F.when(F.col("tokens") > 0, F.col("tokens")), F.col("max_repeat").cast("double"))
    return plan.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def pivotal(ids: list, sizes: np.ndarray, fractions: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Settle the fractions: 0 or 1 each, but for one that may be left over; ``(settled, index left or -1)``.

    ``sum(size * fraction)`` is the same before and after, and each expectation is kept.
    """
    done = np.array(fractions, dtype=float)
    draws = rng.random(len(done))
    held = -1
    for k in range(len(done)):
        if not 1e-12 < done[k] < 1 - 1e-12:
            done[k] = round(done[k])
            continue
        if sizes[k] <= 0:  # weighs nothing: rounded alone
            done[k] = float(draws[k] < done[k])
            continue
        if held < 0:
            held = k
            continue
        p, q, a, b = done[held], done[k], sizes[held], sizes[k]
        up = min((1 - p) * a, q * b)  # tokens that can move to the held document
        down = min(p * a, (1 - q) * b)  # or from it
        move = up if draws[k] * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        settled_p, settled_q = not 1e-9 < p < 1 - 1e-9, not 1e-9 < q < 1 - 1e-9
        done[held], done[k] = (round(p) if settled_p else p), (round(q) if settled_q else q)
        held = -1 if settled_p and settled_q else k if settled_p else held
    return done, held


def _level(seed: int, level: int):
    """One level of the tree over groups ``(source, grp)``: settled documents, and the one left over."""
    out = pa.schema([("source", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("whole", pa.int64()), ("fraction", pa.float64()), ("left_over", pa.bool_())])

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("doc_id", "ascending")])
        source, grp = table.column("source")[0].as_py(), table.column("grp")[0].as_py()
        key = hashlib.blake2b(f"{seed}/{level}/{source}/{grp}".encode(), digest_size=8).digest()
        done, held = pivotal(table.column("doc_id"), table.column("n_tokens").to_numpy(), table.column("fraction").to_numpy(), np.random.default_rng(int.from_bytes(key)))
        left = np.zeros(len(done), bool)
        if held >= 0:
            left[held] = True
        whole = table.column("whole").to_numpy() + np.where(left, 0, np.round(done)).astype(np.int64)
        cols = [table.column("source"), table.column("doc_id"), table.column("n_tokens"), pa.array(whole), pa.array(np.where(left, done, 0.0)), pa.array(left)]
        return pa.table(cols, schema=out)

    return settle


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, fan_in: int = FAN_IN, group_docs: int = GROUP_DOCS) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of all documents used at least once.

    Depends only on the rows and the seed, not on how they are partitioned. A source that
    holds most rows is cut into groups by a hash of the document, so no task gets it whole.
    """
    sizes = written(sizes, "sizes")
    plan = source_plan(sizes, targets, total_tokens)
    # One row per target source: their number is that of the targets, not of the documents.
    drawn = sizes.join(plan.filter("rate > 0").select("source", "rate", "docs"), "source")
    order = F.xxhash64("doc_id", F.lit(seed))
    groups = F.greatest(F.ceil(F.col("docs") / F.lit(group_docs)), F.lit(1))
    fresh = drawn.select("source", "doc_id", "n_tokens", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction"), order.alias("order"), F.pmod(order, groups).alias("grp"))
    most = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    n_groups = max(1, -(-most // group_docs))
    schema = "source string, doc_id long, n_tokens long, whole long, fraction double, left_over boolean"
    settled: list[DataFrame] = []
    level = 0
    while True:
        at = written(fresh.groupBy("source", "grp").applyInArrow(_level(seed, level), schema), "mixed")
        settled.append(at.filter("not left_over"))
        if n_groups == 1:
            # One left per source: rounded by a draw of its own.
            draw = F.pmod(F.xxhash64("source", "doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            settled.append(at.filter("left_over").withColumn("whole", F.col("whole") + (draw < F.col("fraction")).cast("long")))
            break
        n_groups = -(-n_groups // fan_in)
        level += 1
        order = F.xxhash64("doc_id", F.lit(seed + level))
        fresh = at.filter("left_over").select("source", "doc_id", "n_tokens", "whole", "fraction", order.alias("order"), F.pmod(order, F.lit(n_groups)).alias("grp"))
    result = settled[0]
    for s in settled[1:]:
        result = result.unionAll(s)
    return result.filter("whole > 0").select("doc_id", "source", "n_tokens", F.col("whole").alias("copies"))


def share_report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: wanted and reached tokens and shares.

    ``share_of_total`` is of ``total_tokens``, which the targets refer to; ``share_of_mix`` is of the mixture's own tokens.
    """
    if total_tokens is None:
        total_tokens = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    plan = source_plan(sizes, targets, total_tokens)
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("used_docs"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"))
    both = written(plan.join(used, "source", "left").fillna(0, ["used_docs", "copies", "most_copies", "reached_tokens"]), "report")
    all_reached = both.agg(F.coalesce(F.sum("reached_tokens"), F.lit(0))).first()[0]
    share = lambda n: F.col("reached_tokens") / F.lit(float(n)) if n else F.lit(0.0)
    return both.select("source", "target_weight", "max_repeat", "docs", "tokens", "target_tokens", "used_docs", "copies", "most_copies", "reached_tokens", share(total_tokens).alias("share_of_total"), share(all_reached).alias("share_of_mix"), (F.col("target_tokens") > F.col("tokens") * F.col("max_repeat")).alias("too_small"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: the documents of the mixture with their copies."""
    sizes = sized_documents(spark.read.parquet(f"{d}/documents.parquet"))
    return mixture(sizes, spark.read.parquet(f"{d}/mix_targets.parquet"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: the shares the mixture reaches."""
    sizes = written(sized_documents(spark.read.parquet(f"{d}/documents.parquet")), "sizes")
    targets = spark.read.parquet(f"{d}/mix_targets.parquet")
    return share_report(mixture(sizes, targets), sizes, targets)
