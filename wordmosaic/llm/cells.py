"""Cells of similar vectors, shared by the problems on vectors (2 and 4).

Cross-polytope hashing: a vector is turned by a fast Hadamard pseudo-rotation
(three rounds of random signs and a Walsh-Hadamard transform) and falls to the
nearest signed axis. As many rotations are put together as the counted number of
vectors asks for, the last over fewer axes, so that cells keep their size when a
table grows. Multiprobe: a vector also enters the cells of its next nearest axes, by
the joint distance over all rotations, so that similar vectors meet almost surely.

A vector travels as one byte a dimension with a scale of its own (128 + 4 bytes);
what such distances select is checked against the exact vectors afterwards.
A cell with too many rows is cut by rotations of its own around its mean, as often as
that makes it smaller; what stays big is worked on in pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmosaic.operators.runs import whole_runs
from wordmosaic.session import written

DIM = 128
#: Cells that are cut in one round: their list and means pass the driver (600 bytes each); more take more rounds.
MAX_CUT_CELLS = 20_000
#: Exact copies of one vector beyond this many stand aside.
MANY_COPIES = 16
#: Rows of a bucket above which it is cut again inside its task, and how often at most.
BUCKET_ROWS = 768
DEPTH = 6
#: Big copy groups up to which their list is broadcast (24 bytes each); beyond it, it is joined.
MAX_BROADCAST_GROUPS = 200_000
#: Bytes of rows that one task reads, and about what a packed row takes in a shuffle.
TASK_BYTES = 5_000_000
ROW_BYTES = 180
#: Smallest number of signed axes of the last rotation.
LEAST_AXES = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=512)
def rotation(seed: int, d: int = DIM) -> np.ndarray:
    """A pseudo-rotation as a matrix: three rounds of signs and transform, composed once.

    For 128 dimensions one product with the composed matrix is cheaper than 21 passes of butterflies.
    """
    rng = np.random.default_rng(seed)
    x = np.eye(d, dtype=np.float64)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], d))
    return x.astype(np.float32)


def nearest_axes(x: np.ndarray, seed: int, probes: int, axes: int = 2 * DIM) -> np.ndarray:
    """Per row the ``probes`` nearest of so many signed axes after the rotation, nearest first (``2 * axis + negative``)."""
    y = x @ rotation(seed, x.shape[1])[:, : axes // 2]
    size = np.abs(y)
    if probes == 1:
        top = size.argmax(axis=1)[:, None]
    else:
        top = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1), 1)
    return 2 * top + (np.take_along_axis(y, top, 1) < 0)


def uncommon(x: np.ndarray) -> np.ndarray:
    """``x`` without the part along (1, ..., 1), which vectors of counts share; distances change little."""
    return x - x.mean(axis=1, keepdims=True)


def usable(lists: pa.Array, kinds: pa.Array | None, d: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Indices of usable vectors (``d`` entries, no NaN, not only zeros) and their values, ``sift`` turned to root values."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), d), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    flat = lists.filter(pa.array(fits)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(len(at), d)  # null entries come as NaN
    total = x.sum(axis=1, dtype=np.float64)
    good = ~np.isnan(total) & (x != 0).any(axis=1)
    at, x = at[good], x[good]
    if kinds is not None:
        sift = pc.fill_null(pc.equal(kinds, "sift"), False).to_numpy(zero_copy_only=False)[at]
        if sift.any():
            raw = x[sift].astype(np.float64)
            rooted = np.sqrt(raw / (raw.sum(axis=1, keepdims=True) + 1e-10))
            x = x.astype(np.float64) if x.dtype != np.float32 else x.copy()
            x[sift] = rooted
            keep = ~np.isnan(x).any(axis=1)  # negative counts have no root
            at, x = at[keep], x[keep]
    return at, x


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One signed byte a dimension and a scale for each row."""
    scale = np.abs(x).max(axis=1, keepdims=True).astype(np.float32) / 127
    return np.rint(x / scale).astype(np.int8), scale[:, 0]


def unpacked(q: pa.Array | pa.ChunkedArray, scale: np.ndarray, d: int = DIM) -> np.ndarray:
    if isinstance(q, pa.ChunkedArray):
        q = q.combine_chunks()
    offsets = np.frombuffer(q.buffers()[1], np.int32)[q.offset : q.offset + len(q) + 1]
    return np.frombuffer(q.buffers()[2], np.int8)[offsets[0] : offsets[-1]].reshape(len(q), d).astype(np.float32) * scale[:, None]


def _binary(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(0, a.size * a.itemsize + 1, a.shape[1] * a.itemsize, dtype=np.int32) if len(a) else np.zeros(1, np.int32)), pa.py_buffer(a)])


def copy_keys(x: np.ndarray) -> np.ndarray:
    """Two 64-bit universal hashes of each row of single-precision values, bit by bit (-0.0 equals 0.0)."""
    words = np.ascontiguousarray(x.astype(np.float32) + np.float32(0)).view(np.uint64)
    odd = np.random.default_rng(97).integers(1, 2**63, (2, words.shape[1], 2), dtype=np.uint64) | np.uint64(1)
    low, high = words & np.uint64(0xFFFFFFFF), words >> np.uint64(32)
    return np.stack([((low * m[:, 0] + (high ^ np.uint64(0x9E3779B9)) * m[:, 1]).sum(axis=1, dtype=np.uint64)) for m in odd], axis=1).view(np.int64)


def axes_plan(rows: int, cell_rows: int) -> tuple[int, ...]:
    """Signed axes per rotation for cells of about ``cell_rows`` of ``rows`` rows; none where one cell does."""
    wanted, plan = rows / cell_rows, []
    while wanted > 1:
        plan.append(int(min(2 * DIM, max(LEAST_AXES, 2 ** np.ceil(np.log2(wanted))))))
        wanted /= plan[-1]
    return tuple(plan)


def joint_cells(x: np.ndarray, seed: int, plan: tuple[int, ...], probes: int) -> np.ndarray:
    """Per row the ``probes`` likeliest cells, its own first: those whose axes fall least short of the nearest ones."""
    n = len(x)
    code, short = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
    for k, axes in enumerate(plan):
        y = x @ np.ascontiguousarray(rotation(seed + k, x.shape[1])[:, : axes // 2])
        size = np.abs(y)
        top = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
        length = np.take_along_axis(size, top, 1)
        axis = 2 * top + (np.take_along_axis(y, top, 1) < 0)
        wide = code.shape[1] * probes
        code = (code[:, :, None] * axes + axis[:, None, :]).reshape(n, wide)
        short = (short[:, :, None] + ((length[:, :1] - length) ** 2)[:, None, :]).reshape(n, wide)
        best = np.argsort(short, axis=1, kind="stable")[:, :probes]
        code, short = np.take_along_axis(code, best, 1), np.take_along_axis(short, best, 1)
    return code


def _pack_pass(table: int, plan: tuple[int, ...], probes: int, seed: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1), batch.column(2))
            ids = batch.column(0).take(pa.array(at))
            x = x.astype(np.float32)
            key = copy_keys(x)
            cells = joint_cells(uncommon(x), seed, plan, probes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)), pa.array(cells.ravel()))
            columns = [pa.array(np.full(len(at), table, np.int8)), ids, pa.array(key[:, 0]), pa.array(key[:, 1]), lists]
            if whole:
                q, scale = packed(x)
                columns += [_binary(q), pa.array(scale)]
            yield pa.RecordBatch.from_arrays(columns, names=["tbl", "id", "key_1", "key_2", "cells", "q", "scale"][: len(columns)])

    return run


KEYS = "tbl byte, id long, key_1 long, key_2 long, cells array<long>"
COPY = ["tbl", "key_1", "key_2"]


def packed_vectors(tables: list[DataFrame], plan: tuple[int, ...], probes: int, seed: int, whole: bool = True) -> DataFrame:
    """``(tbl, id, key_1, key_2, cells, q, scale)`` of the usable vectors of ``(id, vec, kind)`` tables, lazily.

    The keys are two hashes of the exact vector. ``tbl`` is the table's place in the list.
    Not ``whole``: without the vectors themselves.
    """
    schema = KEYS + (", q binary, scale float" if whole else "")
    parts = [t.select(F.col("id").cast("long"), "vec", "kind").filter(F.col("id").isNotNull()).mapInArrow(_pack_pass(k, plan, probes, seed, whole), schema) for k, t in enumerate(tables)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows


def copy_groups(keys: DataFrame, many: int = MANY_COPIES, kept: int = 1) -> DataFrame | None:
    """``(tbl, key_1, key_2, near, copies)``: groups of more than ``many`` ids with one vector, with their ``kept`` smallest ids.

    None if there are none. A group may hold a third of all rows: its smallest ids are found by combining on the map side.
    """
    once = keys.select(*COPY, "id").distinct()
    big = written(once.groupBy(*COPY).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > many), "copies")
    if not (n := big.count()):
        return None
    listed = F.broadcast(big) if n <= MAX_BROADCAST_GROUPS else big
    own = once.join(listed, COPY).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = own.groupBy(*COPY, "part").agg(F.slice(F.array_sort(F.collect_set("id")), 1, kept).alias("ids"), F.max("copies").alias("copies"))
    first = some.groupBy(*COPY).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, kept).alias("near"), F.max("copies").alias("copies"))
    first = written(first, "kept")
    return F.broadcast(first) if n <= MAX_BROADCAST_GROUPS else first


def without_copies(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``rows`` without the copies set aside, and ``weight``: how many ids each row stands for."""
    if groups is None:
        return rows.withColumn("weight", F.lit(1.0).cast("float"))
    marked = rows.join(groups, COPY, "left").filter(F.col("near").isNull() | F.array_contains("near", F.col("id")))
    return marked.withColumn("weight", F.coalesce(F.col("copies") / F.size("near"), F.lit(1.0)).cast("float")).drop("near", "copies")


def set_aside(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """``(tbl, id, near)`` of the copies set aside, with the smallest ids of their group."""
    return keys.select(*COPY, "id").distinct().join(groups, COPY).filter(~F.array_contains("near", F.col("id"))).select("tbl", "id", "near")


def cell_means(inside: DataFrame) -> dict[tuple, np.ndarray]:
    """The mean vector of each cell: sums of the tasks are added up by cell, one row a cell is collected."""
    parts = inside.select("tbl", "cell", "q", "scale").mapInArrow(_mean_pass, "tbl byte, cell long, n long, total binary")
    sums = parts.groupBy("tbl", "cell").applyInArrow(_mean_sum, "tbl byte, cell long, mean binary")
    return {(r["tbl"], r["cell"]): np.frombuffer(r["mean"], np.float32) for r in sums.collect()}


def _mean_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple, np.ndarray] = {}
    count: dict[tuple, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = unpacked(batch.column(2), batch.column(3).to_numpy())
        tbl, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        order = np.lexsort((cell, tbl))
        tbl, cell = tbl[order], cell[order]
        start = np.flatnonzero(np.r_[True, (tbl[1:] != tbl[:-1]) | (cell[1:] != cell[:-1])])
        sums = np.add.reduceat(x[order].astype(np.float64), start, axis=0)
        for s, k, n in zip(sums, start, np.diff(np.r_[start, len(tbl)]), strict=True):
            key = (int(tbl[k]), int(cell[k]))
            total[key] = total.get(key, 0) + s
            count[key] = count.get(key, 0) + int(n)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int8()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(count.values()), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["tbl", "cell", "n", "total"])


def _mean_sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(t, np.float64) for t in table.column("total").to_pylist())
    mean = (total / sum(table.column("n").to_pylist())).astype(np.float32)
    return pa.table({"tbl": table.column("tbl")[:1], "cell": table.column("cell")[:1], "mean": pa.array([mean.tobytes()], pa.binary())})


PLACED = "tbl byte, cell long, home boolean, id long, weight float, q binary, scale float"


def _cut_pass(means: dict, axes: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(5), batch.column(6).to_numpy())
            tbl, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            home = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            centred = x - np.array([means[(int(t), int(c))] for t, c in zip(tbl, cell, strict=True)], np.float32).reshape(len(x), x.shape[1])
            near = nearest_axes(centred, seed, probes, axes).astype(np.int64)
            # Cells of cells: a hash, as a number by place would soon outgrow 64 bits.
            new = (cell[:, None] * np.int64(2 * DIM + 1) + near + 1) * np.int64(0x9E3779B97F4A7C1 | 1)
            first = np.zeros(new.shape, bool)
            first[:, 0] = home
            take = pa.array(np.repeat(np.arange(len(x)), probes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(new.ravel()), pa.array(first.ravel()), *(batch.column(k).take(take) for k in (3, 4, 5, 6))], names=[c.split()[0] for c in PLACED.split(", ")])

    return run


def placed_rows(rows: DataFrame, counts: DataFrame, probes: int, seed: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(tbl, cell, home, id, weight, q, scale)`` and ``(tbl, cell, n)``: each vector in its cells, ``home`` in one of them.

    ``counts`` is ``(tbl, cell, n)`` of the cells as packed. Cells of more than ``cell_rows`` rows are cut around
    their own mean, so that a dense cluster spreads over all axes, round by round until none is left
    that a cut makes smaller by a half; what is left (masses with one direction) stays whole here.
    """
    names = [c.split()[0] for c in PLACED.split(", ")]
    placed = rows.select("tbl", F.posexplode("cells").alias("k", "cell"), "id", "weight", "q", "scale").withColumn("home", F.col("k") == 0).select(*names)
    whole, whole_counts = [], []
    depth = 0
    while (counts.agg(F.max("n")).first()[0] or 0) > cell_rows:
        depth += 1
        hot = written(counts.filter(F.col("n") > cell_rows).orderBy(F.desc("n"), "tbl", "cell").limit(MAX_CUT_CELLS), "hot")
        most = hot.agg(F.max("n")).first()[0]
        listed = F.broadcast(hot.select("tbl", "cell"))
        inside = placed.join(listed, ["tbl", "cell"], "left_semi").select(*names)
        axes = (axes_plan(2 * probes * most, cell_rows) or (LEAST_AXES,))[0]
        cut = written(inside.mapInArrow(_cut_pass(cell_means(inside), axes, probes, seed + 1_000 * depth), PLACED), "cut")
        sizes = written(cut.groupBy("tbl", "cell").agg(F.count(F.lit(1)).alias("n")), "sizes")
        stuck = sizes.filter((F.col("n") > cell_rows) & (F.col("n") > most / 2))  # big cells, so few
        key = F.broadcast(stuck.select("tbl", "cell"))
        whole.append(cut.join(key, ["tbl", "cell"], "left_semi").select(*names))
        whole_counts.append(stuck)
        placed = placed.join(listed, ["tbl", "cell"], "left_anti").select(*names).unionAll(cut.join(key, ["tbl", "cell"], "left_anti").select(*names))
        counts = written(counts.join(listed, ["tbl", "cell"], "left_anti").select("tbl", "cell", "n").unionAll(sizes.join(key, ["tbl", "cell"], "left_anti").select("tbl", "cell", "n")), "sizes")
    for d, n in zip(whole, whole_counts, strict=True):
        placed, counts = placed.unionAll(d), counts.unionAll(n.select("tbl", "cell", "n"))
    return placed, counts


def in_blocks(rows: DataFrame, counts: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` with ``task`` and ``blk``: cells of more than ``block_rows`` rows become one task per pair of blocks.

    Every two rows of a cell meet in exactly one of its tasks (in all tasks of their block, if it is
    the same): the exact way for cells that no rotation cuts. ``counts`` is ``(tbl, cell, n)``; only
    big cells are listed, and each has more than ``block_rows`` rows.
    """
    if (counts.agg(F.max("n")).first()[0] or 0) <= block_rows:
        return rows.withColumn("task", F.lit(0)).withColumn("blk", F.lit(0))
    big = written(counts.filter(F.col("n") > block_rows).select("tbl", "cell", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "blocks")
    n = big.count()
    marked = rows.join(F.broadcast(big) if n <= MAX_BROADCAST_GROUPS else big, ["tbl", "cell"], "left")
    b, own = F.coalesce("blocks", F.lit(1)), F.col("blk")
    marked = marked.withColumn("blk", F.pmod(F.xxhash64("id"), b).cast("int"))
    return marked.withColumn("task", F.explode(F.transform(F.sequence(F.lit(0), b - 1), lambda k: F.least(own, k) * b + F.greatest(own, k)))).drop("blocks")


def task_count(rows: int, row_bytes: int = ROW_BYTES) -> int:
    """Tasks for so many rows, each reading about ``TASK_BYTES``: the tasks grow in number with the table, not in size."""
    return int(max(1, -(-rows * row_bytes // TASK_BYTES)))


def bucket_rows(x: np.ndarray, seed: int, probes: int, bucket: int = BUCKET_ROWS) -> Iterator[np.ndarray]:
    """Buckets of similar rows of one cell, as sorted row numbers; big ones are cut again around their mean."""
    pending = [(np.arange(len(x)), 0)]
    while pending:
        rows, depth = pending.pop()
        if len(rows) <= 64 or (depth and len(rows) <= bucket) or depth >= DEPTH:
            yield rows
            continue
        own = x[rows]
        # Deeper cuts lie around a dense centre, where all directions are alike: one probe more.
        near = nearest_axes(own - own.mean(axis=0), seed + 7_919 * depth, probes + (depth > 0))
        axis = near.ravel()
        row = np.repeat(rows, near.shape[1])
        order = np.lexsort((row, axis))
        axis, row = axis[order], row[order]
        for part in np.split(row, np.flatnonzero(np.diff(axis)) + 1):
            if len(part) > 1:
                pending.append((part, depth + 1 if len(part) < len(rows) else DEPTH))


def bucket_distances(x: np.ndarray, buckets: Iterator[np.ndarray], held: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, columns, squared distances)`` of all pairs in each bucket, many small buckets at a time.

    ``rows`` is (b, r), ``columns`` (b, c), -1 where padded; distances to oneself and to padding are infinite.
    """
    sq = np.einsum("ij,ij->i", x, x)
    d = x.shape[1]
    waiting: dict[int, list[np.ndarray]] = {}

    def together(size: int, group: list[np.ndarray]):
        rows = np.full((len(group), size), -1)
        for k, g in enumerate(group):
            rows[k, : len(g)] = g
        y = x[rows]
        s = np.where(rows < 0, np.inf, sq[rows])
        dist = s[:, :, None] + s[:, None, :]
        dist -= 2 * np.matmul(y, y.transpose(0, 2, 1))
        dist[:, np.arange(size), np.arange(size)] = np.inf
        return rows, rows, dist

    for b in buckets:
        if len(b) < 2:
            continue
        if len(b) > 512:
            for k in range(0, len(b), 512):
                own = b[k : k + 512]
                dist = sq[own][:, None] + sq[b][None] - 2 * x[own] @ x[b].T
                dist[np.arange(len(own)), np.arange(k, k + len(own))] = np.inf
                yield own[None], b[None], dist[None]
            continue
        size = 8
        while size < len(b):
            size = size * 2 if size < 32 else size + 16
        group = waiting.setdefault(size, [])
        group.append(b)
        if len(group) * size * max(d, size) >= held:
            yield together(size, group)
            waiting[size] = []
    for size, group in waiting.items():
        if group:
            yield together(size, group)


def over_cells(placed: DataFrame, work: Callable[[dict[str, np.ndarray], np.ndarray, int], list[np.ndarray]], columns: str, by: list[str], tasks: int) -> DataFrame:
    """``work(columns, vectors, seed)`` of every group of rows equal in ``by``, its arrays as ``columns`` after ``tbl``.

    Groups are read one after the other from sorted partitions, which is cheaper than a call per group.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    types = {"long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32()}
    out = pa.schema([("tbl", pa.int8()), *((c.split()[0], types[c.split()[1]]) for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list] = []
        held = 0
        for table in whole_runs(batches, by):
            keys = [table.column(c).to_numpy() for c in by]
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            start = np.r_[np.flatnonzero(change), table.num_rows]
            for lo, hi in zip(start, start[1:], strict=False):
                part = table.slice(lo, hi - lo)
                ids = part.column("id").to_numpy()
                _, first = np.unique(ids, return_index=True)  # deliveries of one id meet here
                if len(first) < 2:
                    continue
                data = {c: part.column(c).to_numpy(zero_copy_only=False)[first] for c in part.column_names if c not in ("q", "scale")}
                x = unpacked(part.column("q"), part.column("scale").to_numpy())[first]
                seed = int.from_bytes(hashlib.blake2b("/".join(str(k[lo]) for k in keys).encode(), digest_size=4).digest())
                found = work(data, x, seed)
                if len(found[0]):
                    waiting.append([np.full(len(found[0]), data["tbl"][0], np.int8), *found])
                    held += len(found[0])
                if held > 20_000:
                    yield _joined(waiting, out)
                    waiting, held = [], 0
        if waiting:
            yield _joined(waiting, out)

    return placed.repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(run, f"tbl byte, {', '.join(f'{n} {c.split()[1]}' for n, c in zip(names, columns.split(', '), strict=True))}")


def _joined(parts: list[list], schema: pa.Schema) -> pa.RecordBatch:
    """Arrays of several groups as one batch; masked arrays give nulls."""
    columns = []
    for k, field in enumerate(schema):
        own = [p[k] for p in parts]
        if any(isinstance(a, (list, pa.Array)) for a in own):
            columns.append(pa.chunked_array([pa.array(a, field.type) for a in own]).combine_chunks())
        else:
            whole = np.ma.concatenate(own) if any(np.ma.isMaskedArray(a) for a in own) else np.concatenate(own)
            columns.append(pa.array(np.ma.getdata(whole), field.type, mask=np.ma.getmaskarray(whole) if np.ma.isMaskedArray(whole) else None))
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=schema)
