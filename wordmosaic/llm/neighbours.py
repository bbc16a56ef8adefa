"""Problem 4: the most similar vectors for every vector.

Method: cross-polytope hashing with multiprobe cells (see :mod:`.cells`) collects
candidates; the candidates are reranked by exact distances of the stored vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordmosaic.llm.cells import (
    DIM,
    MANY_COPIES,
    axes_plan,
    copy_groups,
    in_blocks,
    over_cells,
    packed_vectors,
    placed_rows,
    set_aside,
    task_count,
    usable,
    without_copies,
)
from wordmosaic.operators.runs import whole_runs
from wordmosaic.session import written

SEED = 41
#: Cells a vector enters, the likeliest over all rotations together.
PROBES = 3
#: Rows for which a cell is laid out.
CELL_ROWS = 2_048
#: Rows of a cell up to which all its pairs are compared, in blocks of ``BLOCK_ROWS``; bigger ones are cut around their mean.
PAIRED_ROWS = 262_144
BLOCK_ROWS = 16_384
#: Bound of the rounding of a squared distance in single precision, as a share of the squared lengths.
ROUNDING = 1.6e-5
#: Ids up to which the list of wanted vectors is broadcast (8 bytes each); beyond it, it is joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Rows of which distances to all others of a block are held at a time.
ROWS_HELD = 512


def vector_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    """The two vector tables as ``(id, vec, kind)``."""
    descriptors = spark.read.parquet(f"{d}/descriptors.parquet").select(F.col("vec_id").alias("id"), F.col("descriptor").alias("vec"), "kind")
    centers = spark.read.parquet(f"{d}/centers.parquet").select(F.col("cid").cast("long").alias("id"), F.col("center").alias("vec"), F.lit(None).cast("string").alias("kind"))
    return [descriptors, centers]


def _slices(own: np.ndarray, blk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and the rows they are compared with in a task: all with all in one block, else one block with the other."""
    first = blk == blk.min()
    sides = [(own, own)] if first.all() else [(own[first], own[~first]), (own[~first], own[first])]
    for rows, others in sides:
        for k in range(0, len(rows), ROWS_HELD):
            yield rows[k : k + ROWS_HELD], others


def _active(limit: float):
    """Ids with another vector that the packing error leaves possible within ``limit``, with their cell and task."""

    def work(data: dict[str, np.ndarray], x: np.ndarray, seed: int) -> list[np.ndarray]:
        # Packing moves an entry by half a scale at most, and the scale is a 127th of the largest entry.
        moved = (np.abs(x).max(axis=1, initial=0) * (np.sqrt(x.shape[1]) / 254 * 1.001)).astype(np.float32)
        sq = np.einsum("ij,ij->i", x, x)
        near = np.zeros(len(x), bool)
        for rows, others in _slices(np.arange(len(x)), data["blk"]):
            most = (limit + moved[rows][:, None] + moved[others][None]) ** 2 + ROUNDING * (sq[rows][:, None] + sq[others][None])
            close = sq[rows][:, None] + sq[others][None] - 2 * x[rows] @ x[others].T <= most
            close &= rows[:, None] != others[None]
            near[rows] |= close.any(axis=1)
        return [data[c][near] for c in ("id", "cell", "task", "blk")]

    return work


def _exact_pass(d: int):
    """Usable vectors as bytes: single precision where that is exact, else double; root values in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(2), batch.column(3), d)
            short = (x.astype(np.float32) == x).all(axis=1)
            v = [r.astype(np.float32).tobytes() if s else r.astype(np.float64).tobytes() for r, s in zip(x, short, strict=True)]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(v, pa.binary())], names=["tbl", "id", "v"])

    return run


def as_doubles(v: list[bytes], d: int) -> np.ndarray:
    x = np.empty((len(v), d))
    for k, b in enumerate(v):
        x[k] = np.frombuffer(b, np.float32 if len(b) == 4 * d else np.float64)
    return x


def exact_vectors(tables: list[DataFrame], wanted: DataFrame, d: int = DIM) -> DataFrame:
    """``(tbl, id, v)``: the exact usable vectors of the ``wanted (tbl, id)`` as bytes, one per id.

    A null entry makes a vector unusable (it reads as NaN).
    """
    wanted = written(wanted, "wanted")
    small = wanted.count() <= MAX_BROADCAST_IDS
    parts = []
    for k, t in enumerate(tables):
        own = wanted.filter(F.col("tbl") == k).select("id")
        own = F.broadcast(own) if small else own
        rows = t.select(F.lit(k).cast("byte").alias("tbl"), F.col("id").cast("long").alias("id"), "vec", "kind")
        parts.append(rows.join(own, "id", "left_semi").select("tbl", "id", "vec", "kind").mapInArrow(_exact_pass(d), "tbl byte, id long, v binary"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows.groupBy("tbl", "id").agg(F.min("v").alias("v"))


def _best(k: int, limit: float, d: int):
    """Per task of a cell and row: its ``k`` nearest within ``limit`` by exact distances (ties: smaller id)."""

    def work(ids: np.ndarray, x: np.ndarray, blk: np.ndarray) -> list[np.ndarray]:
        centred = (x - x.mean(axis=0)).astype(np.float32)  # small numbers, so that single precision tells near from nearest
        sq = np.einsum("ij,ij->i", centred, centred)
        out = []
        for rows, others in _slices(np.argsort(ids, kind="stable"), blk):
            dist = sq[rows][:, None] + sq[others][None] - 2 * centred[rows] @ centred[others].T
            dist[rows[:, None] == others[None]] = np.inf
            blur = 4e-6 * (sq[rows][:, None] + sq[others].max()) + 1e-12
            near = dist <= limit * limit + blur
            if len(others) > k:
                near &= dist <= np.partition(dist, k - 1, axis=1)[:, k - 1 : k] + 2 * blur
            r, c = np.nonzero(near)
            if not len(r):
                continue
            true = np.concatenate([np.sqrt(((x[rows[r[s : s + 65_536]]] - x[others[c[s : s + 65_536]]]) ** 2).sum(axis=1)) for s in range(0, len(r), 65_536)])
            other = ids[others[c]]
            order = np.lexsort((other, true, r))
            r, true, other = r[order], true[order], other[order]
            start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
            keep = (rank < k) & (true <= limit)
            out.append((ids[rows[r[keep]]], other[keep], true[keep]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["tbl", "cell", "task"]):
            keys = [table.column(c).to_numpy() for c in ("tbl", "cell", "task")]
            change = np.zeros(table.num_rows, bool)
            for c in keys:
                change[1:] |= c[1:] != c[:-1]
            start = np.r_[0, np.flatnonzero(change), table.num_rows]
            ids, blk, v = table.column("id").to_numpy(), table.column("blk").to_numpy(), table.column("v")
            for lo, hi in zip(start, start[1:], strict=False):
                if hi - lo > 1:
                    item, other, dist = work(ids[lo:hi], as_doubles(v.slice(lo, hi - lo).to_pylist(), d), blk[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), keys[0][lo], np.int8)), pa.array(item), pa.array(other), pa.array(dist)], names=["tbl", "item", "other", "dist"])

    return run


def nearest_pairs(tables: list[DataFrame], k: int = 5, limit: float = 0.10, cell_rows: int = CELL_ROWS, paired_rows: int = PAIRED_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(tbl, id_a, id_b, dist)``, id_a < id_b: pairs at most ``limit`` apart, one being among the ``k`` nearest of the other.

    ``tables`` are ``(id, vec, kind)``; ``tbl`` is a table's place in the list. Vectors that are
    null, of another length, with NaN or of zeros only, and null ids are left out; an id delivered
    twice is one item (of differing usable vectors the distance uses the smallest). Equal
    distances rank by the smaller id, so that of many exact copies each is paired with the ``k``
    smallest others, not with all. Empty tables give no rows.

    Two vectors of one cell are always compared, by their packed distance first, and what the
    packing error leaves possible by the exact one; no number of candidates is set. A cell of more
    than ``block_rows`` rows is compared in pairs of blocks, up to ``paired_rows`` rows, beyond which
    it is cut around its mean first. What may be missed is a pair that shares none of its cells.
    """
    plan = axes_plan(sum(t.count() for t in tables) * PROBES, cell_rows)
    probes = PROBES if plan else 1
    keys = written(packed_vectors(tables, plan, probes, SEED, whole=False), "keys")
    groups = copy_groups(keys, max(MANY_COPIES, k + 1), k + 1)
    counts = written(keys.select("tbl", F.explode("cells").alias("cell")).groupBy("tbl", "cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
    stay = without_copies(packed_vectors(tables, plan, probes, SEED), groups)
    placed, counts = placed_rows(stay, counts, probes, SEED, paired_rows)
    tasks = task_count(counts.agg(F.sum("n")).first()[0] or 0)
    placed = in_blocks(placed.drop("home", "weight"), counts, block_rows)
    active = over_cells(placed, _active(limit), "id long, cell long, task int, blk int", ["tbl", "cell", "task"], tasks)
    active = written(active.distinct(), "active")
    exact = exact_vectors(tables, active.select("tbl", "id").distinct())
    bytes_each = 4 * DIM + 60
    joined = active.join(exact, ["tbl", "id"]).repartition(task_count(active.count(), bytes_each), "tbl", "cell", "task").sortWithinPartitions("tbl", "cell", "task")
    found = joined.select("tbl", "cell", "task", "id", "blk", "v").mapInArrow(_best(k, limit, DIM), "tbl byte, item long, other long, dist double")
    found = written(found, "nearest").repartition("tbl", "item").groupBy("tbl", "item", "other").agg(F.min("dist").alias("dist"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("tbl", "item").orderBy("dist", "other"))).filter(F.col("rank") <= k)
    if groups is not None:
        # A copy set aside has the smallest ids of its group at distance 0; more than k of them are kept.
        copies = set_aside(keys, groups).select("tbl", F.col("id").alias("item"), F.explode(F.slice("near", 1, k)).alias("other"), F.lit(0.0).alias("dist"))
        best = best.select("tbl", "item", "other", "dist").unionAll(copies)
    return best.select("tbl", F.least("item", "other").alias("id_a"), F.greatest("item", "other").alias("id_b"), "dist").dropDuplicates(["tbl", "id_a", "id_b"])


def table_name(column: str = "tbl"):
    return F.when(F.col(column) == 0, F.lit("descriptors")).otherwise(F.lit("centers"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 4 over whole ``descriptors`` and ``centers``."""
    return nearest_pairs(vector_tables(spark, d)).select(table_name().alias("tbl"), "id_a", "id_b")
