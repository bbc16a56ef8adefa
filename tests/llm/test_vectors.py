import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import rows
from wordmosaic.llm import cells, clusters, neighbours


def table(spark, data):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, 1, "c") for i, v, k in data], "id long, vec array<float>, kind string, cell int, tbl string")


def planted(seed, n_clusters=25, loose=60):
    """Clusters of mutually near unit vectors, far from each other, and vectors near none."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n_clusters):
        centre = np.abs(rng.normal(size=128))
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(2, 14)):
            v = np.abs(centre + rng.normal(size=128) * rng.choice([0.002, 0.012]))
            out.append(v / np.linalg.norm(v))
    for _ in range(loose):
        v = np.abs(rng.normal(size=128)) ** 3
        out.append(v / np.linalg.norm(v))
    return np.array(out).astype(np.float32)


def brute(x, ids, k, limit):
    d = np.linalg.norm(x[:, None].astype(float) - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    found = set()
    for i in range(len(x)):
        for j in np.lexsort((ids, d[i]))[:k]:
            if d[i, j] <= limit:
                found.add((0, int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return found


def brute_clusters(x, ids, limit, least):
    """Average linkage as defined: the nearest two clusters merge while their root mean square distance is below the limit."""
    d2 = ((x[:, None].astype(float) - x[None]) ** 2).sum(axis=2)
    total, size = d2.copy(), np.ones(len(x))
    np.fill_diagonal(total, np.inf)
    member = [[i] for i in range(len(x))]
    while True:
        mean = total / (size[:, None] * size[None])
        i, j = np.unravel_index(np.argmin(mean), mean.shape)
        if not mean[i, j] < limit * limit:
            break
        i, j = min(i, j), max(i, j)
        total[i] += total[j]
        total[:, i] += total[:, j]
        total[i, i] = np.inf
        total[j] = total[:, j] = np.inf
        size[i] += size[j]
        member[i] += member[j]
        member[j] = []
    return sorted((0, int(ids[i]), int(ids[m].min())) for m in member if len(m) >= least for i in m)


def test_transform_is_a_rotation():
    r = cells.rotation(7)
    assert np.allclose(r @ r.T, np.eye(128), atol=1e-5)
    x = np.random.default_rng(0).normal(size=(3, 8))
    h = np.array([[1]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(cells.hadamard(x), x @ h / np.sqrt(8))


def test_nearest_axes():
    y = np.zeros((1, 128), np.float32)
    y[0, 5], y[0, 9] = -3, 2
    assert cells.nearest_axes(y @ cells.rotation(3).T, 3, 2).tolist() == [[11, 18]]


def test_packing_keeps_distances():
    x = planted(1)
    q, s = cells.packed(x)
    back = q * s[:, None]
    assert np.abs(np.linalg.norm(x[0] - x[1:], axis=1) - np.linalg.norm(back[0] - back[1:], axis=1)).max() < 0.01


def test_usable_vectors(spark):
    good = [1.0] * 128
    data = [(1, good, None), (2, None, None), (3, [], None), (4, good[:-1], None), (5, [float("nan")] + good[1:], None), (6, [0.0] * 128, None), (7, [None] + good[1:], None), (None, good, None), (8, good, "sift"), (1, good, None)]
    found = cells.packed_vectors([table(spark, data)], (16,), 2, 0).select("id").distinct()
    assert rows(found) == [(1,), (8,)]


def test_neighbours_against_brute_force(spark):
    x = planted(2)
    ids = np.random.default_rng(3).permutation(len(x)) * 3
    data = [(int(i), v, "rootsift") for i, v in zip(ids, x)]
    want = brute(x, ids, 5, 0.10)
    for cell_rows in (2_048, 20):
        got = {(r[0], r[1], r[2]) for r in neighbours.nearest_pairs([table(spark, data + data[:20])], cell_rows=cell_rows).collect()}
        assert len(want) > 30 and len(got & want) >= 0.98 * len(want) and got <= want


def test_neighbours_in_a_mass_of_near_copies(spark):
    """Hundreds of non-identical copies: the packed distances cannot tell which five are nearest."""
    rng = np.random.default_rng(12)
    x = planted(13, 8, 20)
    x = np.concatenate([x, x[0] + rng.normal(size=(300, 128)) * 0.001]).astype(np.float32)
    ids = rng.permutation(len(x))
    got = {(r[0], r[1], r[2]) for r in neighbours.nearest_pairs([table(spark, [(int(i), v, None) for i, v in zip(ids, x)])]).collect()}
    assert got == brute(x, ids, 5, 0.10)


def test_neighbours_where_ids_are_joined(spark, monkeypatch):
    x = planted(4, 10, 10)
    data = [(k, v, None) for k, v in enumerate(x)]
    plain = rows(neighbours.nearest_pairs([table(spark, data)]).select("id_a", "id_b"))
    monkeypatch.setattr(neighbours, "MAX_BROADCAST_IDS", 0)
    assert rows(neighbours.nearest_pairs([table(spark, data)]).select("id_a", "id_b")) == plain


@pytest.mark.parametrize("broadcast", [True, False])
def test_masses_of_copies(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(cells, "MAX_BROADCAST_GROUPS", 0)
    x = planted(5, 6, 10)
    data = [(k, v, None) for k, v in enumerate(x)] + [(1000 + k, x[0], None) for k in range(60)]
    every = np.concatenate([x, np.repeat(x[:1], 60, axis=0)])
    ids = np.array([d[0] for d in data])
    got = {(r[0], r[1], r[2]) for r in neighbours.nearest_pairs([table(spark, data)]).collect()}
    assert got == brute(every, ids, 5, 0.10)
    assert rows(clusters.vector_clusters([table(spark, data)])) == brute_clusters(every, ids, 0.40, 5)


def test_clusters_against_brute_force(spark):
    x = planted(6)
    ids = np.random.default_rng(7).permutation(len(x)) + 5
    data = [(int(i), v, None) for i, v in zip(ids, x)]
    want = brute_clusters(x, ids, 0.40, 5)
    got = rows(clusters.vector_clusters([table(spark, data), table(spark, data[:50])]))
    assert [r for r in got if r[0] == 0] == want
    told = {(r["tbl"], r["cluster_id"]): r for r in clusters.typical_members(clusters.vector_clusters([table(spark, data)]), [table(spark, data)]).collect()}
    assert {c for _, _, c in want} == {c for _, c in told}
    place = {int(i): v for i, v in zip(ids, x)}
    for (_, c), r in told.items():
        own = [i for _, i, k in want if k == c]
        mean = np.mean([place[i] for i in own], axis=0)
        assert r["items"] == len(own) and r["typical"][0] == min(own, key=lambda i: np.linalg.norm(place[i] - mean))


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def crowd(seed, size, others, noise=0.006):
    """One cluster of ``size`` members, not copies, among unrelated vectors."""
    rng = np.random.default_rng(seed)
    centre = unit(np.abs(rng.normal(size=(1, 128))))
    return np.concatenate([unit(np.abs(centre + rng.normal(size=(size, 128)) * noise)), unit(np.abs(rng.normal(size=(others, 128))) ** 3)])


@pytest.mark.parametrize("size, k", [(50, 5), (100, 20), (400, 100), (400, 5), (5_000, 5), (5_000, 100)])
def test_neighbours_at_every_cluster_size(spark, size, k):
    """The number of neighbours asked for is given, in small and in big clusters, and recall is measured."""
    x = crowd(size + k, size, 1_000)
    ids = np.arange(len(x))
    frame = spark.createDataFrame(pa.table({"id": ids, "vec": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())), "kind": pa.nulls(len(x), pa.string())}))
    got = neighbours.nearest_pairs([frame], k=k, limit=0.10, cell_rows=64).toPandas()
    sq = (x.astype(float) ** 2).sum(axis=1)
    want = set()
    for lo in range(0, len(x), 1_000):
        d = np.sqrt(np.maximum(sq[lo : lo + 1_000, None] + sq[None] - 2 * x[lo : lo + 1_000].astype(float) @ x.T.astype(float), 0))
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        top = np.argpartition(d, k, axis=1)[:, :k]
        r, c = np.nonzero(np.take_along_axis(d, top, 1) <= 0.10)
        i, j = r + lo, top[r, c]
        want |= set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
    found = set(zip(got["id_a"], got["id_b"], strict=True))
    assert len(want) >= size * min(k, 20) / 4
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.05 * len(want)


def test_big_cells_are_compared_in_blocks(spark):
    """Blocks give what one task gives, and a cell beyond the bound is cut around its mean with measured loss."""
    x = crowd(31, 600, 200)
    frame = table(spark, [(k, v, None) for k, v in enumerate(x)])
    want = brute(x, np.arange(len(x)), 5, 0.10)
    blocked = {tuple(r)[:3] for r in neighbours.nearest_pairs([frame], block_rows=100).collect()}
    assert blocked == want and len(want) > 500
    rng = np.random.default_rng(32)
    flat = unit(np.abs(x[0] + 0.05 * (rng.normal(size=(900, 3)) @ rng.normal(size=(3, 128)) / 11)))  # a cluster of few true directions
    frame = table(spark, [(k, v, None) for k, v in enumerate(flat)])
    want = brute(flat, np.arange(len(flat)), 5, 0.10)
    cut = {tuple(r)[:3] for r in neighbours.nearest_pairs([frame], paired_rows=300).collect()}
    assert len(cut & want) >= 0.9 * len(want)


def test_masses_that_no_cut_divides(spark):
    """Rows with one direction stay whole, are worked on in blocks, and the rounds end."""
    x = np.repeat(unit(np.abs(np.random.default_rng(33).normal(size=(1, 128)))), 80, axis=0)
    x[:, 0] += np.arange(80) * 1e-6
    frame = table(spark, [(k, v, None) for k, v in enumerate(x)])
    keys = cells.packed_vectors([frame], (), 1, 3).withColumn("weight", cells.F.lit(1.0).cast("float"))
    counts = keys.select("tbl", cells.F.explode("cells").alias("cell")).groupBy("tbl", "cell").agg(cells.F.count("cell").alias("n"))
    placed, sizes = cells.placed_rows(keys, counts, 3, 5, 20)
    assert placed.select("id").distinct().count() == 80 and placed.filter("home").count() == 80
    assert sorted(r["n"] for r in sizes.collect()) == sorted(r["count"] for r in placed.groupBy("tbl", "cell").count().collect())
    got = {tuple(r)[:3] for r in neighbours.nearest_pairs([frame], paired_rows=20, block_rows=30).collect()}
    assert {i for p in got for i in p[1:]} == set(range(80))


def test_hot_cells_are_cut(spark):
    """One dense cluster with half of all rows, in cells cut between tasks, and its parts merged in rounds."""
    rng = np.random.default_rng(8)
    centre = np.abs(rng.normal(size=128))
    dense = np.abs(centre / np.linalg.norm(centre) + rng.normal(size=(300, 128)) * 0.012)
    x = np.concatenate([planted(9, 15, 40), unit(dense)]).astype(np.float32)
    frame = table(spark, [(k, v, None) for k, v in enumerate(x)])
    want = brute_clusters(x, np.arange(len(x)), 0.40, 5)
    assert rows(clusters.vector_clusters([frame], cell_rows=50)) == want
    assert rows(clusters.vector_clusters([frame], cell_rows=50, cut_rows=100)) == want
    assert rows(clusters.vector_clusters([frame], cell_rows=20, component_parts=4)) == want


def test_chains_are_not_one_cluster(spark):
    """Neighbours 0.02 apart on an arc: no cluster's average distance reaches the limit, alone and among other vectors."""
    angle = np.arange(150) * 0.02
    arc = np.zeros((150, 128), np.float32)
    arc[:, 3], arc[:, 70] = np.cos(angle), np.sin(angle)
    others = unit(np.abs(np.random.default_rng(14).normal(size=(300, 128))) ** 3)
    for x, options in ((arc, {}), (np.concatenate([arc, others]), {"cell_rows": 40}), (np.concatenate([arc, others]), {"cell_rows": 40, "component_parts": 3})):
        found = clusters.vector_clusters([table(spark, [(k, v, None) for k, v in enumerate(x)])], least=1, **options).collect()
        members = {}
        for r in found:
            members.setdefault(r["cluster_id"], []).append(r["item_id"])
        assert set(range(150)) <= {i for m in members.values() for i in m}
        assert 5 <= len([m for c, m in members.items() if c < 150]) <= 30
        for m in members.values():
            d2 = ((x[m][:, None] - x[m][None]) ** 2).sum(axis=2)
            assert np.sqrt(d2.sum() / max(1, len(m) * (len(m) - 1))) < 0.40


def sheet(seed, size, directions=4):
    """Vectors spread over a patch much wider than the limit, as one component of clusters holds them, and as packed."""
    rng = np.random.default_rng(seed)
    x = unit(np.ones(128) / 11.3 + 0.4 * rng.normal(size=(size, directions)) @ np.linalg.qr(rng.normal(size=(128, directions)))[0].T)
    q, scale = cells.packed(x)
    return q, scale, q * scale[:, None]


def parts_of(spark, q, scale, x, root, number):
    n = len(x)
    return spark.createDataFrame(pa.table({"root": pa.array(root), "part": pa.array(number), "n": pa.array(np.ones(n, np.float32)), "square": pa.array((x * x).sum(axis=1).astype(np.float32)), "q": [r.tobytes() for r in q], "scale": pa.array(scale)}))


@pytest.mark.parametrize("most", [10_000, 150, 2])
def test_a_component_comes_out_alike_at_any_size(spark, most):
    """Two components and some small ones, in one task and by rounds of all tasks: average linkage over all pairs."""
    q, scale, x = sheet(17, 420)
    number = np.random.default_rng(18).permutation(420) * 7 + 3
    root = np.r_[np.zeros(200, int), np.ones(180, int), 2 + np.arange(40) // 2]
    want = [r for k in np.unique(root) for r in brute_clusters(x[root == k], number[root == k], 0.40, 1)]
    got = rows(clusters.merged_parts(parts_of(spark, q, scale, x, root, number), 0.40, most))
    assert got == sorted((i, c) for _, i, c in want) and 30 < len({c for _, c in got}) < 250


def test_a_wide_component_is_merged_over_all_pairs(spark):
    """More clusters than were once paired: none that are left could merge, and slices and tasks change nothing."""
    q, scale, x = sheet(19, 1_500, 5)
    parts = parts_of(spark, q, scale, x, np.zeros(1_500, int), np.arange(1_500))
    got = rows(clusters.merged_parts(parts, 0.40))
    label = np.array([c for _, c in got])
    heads, own = np.unique(label, return_inverse=True)
    member = np.eye(len(heads))[own]
    n = member.sum(axis=0)
    mean, square = member.T @ x / n[:, None], member.T @ (x * x).sum(axis=1) / n
    d2 = square[:, None] + square[None] - 2 * mean @ mean.T
    np.fill_diagonal(d2, np.inf)
    assert len(heads) > 100 and d2.min() > 0.40**2 - 1e-6


def test_slices_and_tasks_change_no_component(spark, monkeypatch):
    q, scale, x = sheet(20, 1_200, 5)
    parts = parts_of(spark, q, scale, x, np.zeros(1_200, int), np.arange(1_200))
    want = rows(clusters.merged_parts(parts, 0.40))
    monkeypatch.setattr(clusters, "TASK_PAIRS", 200_000)
    assert rows(clusters.merged_parts(parts, 0.40, most=600)) == want
    monkeypatch.setattr(clusters, "MAX_BROADCAST_IDS", 0)
    assert rows(clusters.merged_parts(parts, 0.40, most=600, slice_parts=500)) == want


def test_equal_distances_merge_in_few_rounds():
    """A long row of clusters equally far from the next: pairs at once, not one a round from its end."""
    n = 3_000
    total = np.zeros((n, 128), np.float32)
    total[:, 0] = np.arange(n) * 0.25
    parts = clusters.Parts(np.arange(n), np.ones(n), total[:, 0].astype(float) ** 2, total)
    label = clusters.linked_parts(parts, np.array([0, n]), 0.40)
    assert (np.diff(np.searchsorted(np.unique(label), label)) >= 0).all() and n / 4 < len(np.unique(label)) < n * 0.7


def test_a_bridge_joins_no_clusters(spark):
    """Two clusters 0.56 apart with one vector between them: average linkage keeps them apart, single linkage does not."""
    rng = np.random.default_rng(15)
    a, b = np.zeros(128), np.zeros(128)
    a[0], b[0], b[1] = 1, np.cos(0.57), np.sin(0.57)
    x = np.concatenate([unit(a + rng.normal(size=(12, 128)) * 0.003), unit(b + rng.normal(size=(9, 128)) * 0.003), unit((0.51 * a + 0.49 * b)[None])])
    for options in ({}, {"cell_rows": 4}, {"cell_rows": 4, "component_parts": 2}):
        assert rows(clusters.vector_clusters([table(spark, [(k, v, None) for k, v in enumerate(x)])], **options)) == brute_clusters(x, np.arange(len(x)), 0.40, 5)


def test_copies_weigh_what_they_are(spark):
    """A mass of copies pulls the average as its single rows would, whether set aside or not."""
    rng = np.random.default_rng(16)
    at = lambda angle: np.eye(128)[0] * np.cos(angle) + np.eye(128)[1] * np.sin(angle)
    for n, apart in ((10, 1), (60, 2)):  # 60 copies pull the average of their cluster beyond the limit
        x = np.concatenate([np.repeat(unit(at(0.0)[None]), n, axis=0), *(unit(at(angle) + rng.normal(size=(6, 128)) * 0.001) for angle in (0.2, 0.44))])
        found = rows(clusters.vector_clusters([table(spark, [(k, v, None) for k, v in enumerate(x)])]))
        assert found == brute_clusters(x, np.arange(len(x)), 0.40, 5)
        assert len({r[2] for r in found}) == apart


def test_big_buckets_are_cut():
    rng = np.random.default_rng(10)
    x = (np.ones(128) / 11.3 + rng.normal(size=(900, 128)) * 0.01).astype(np.float32)
    buckets = list(cells.bucket_rows(x, 5, 2, bucket=100))
    assert max(map(len, buckets)) <= 100 and set(np.concatenate(buckets)) == set(range(900))
    same = np.repeat(x[:1], 900, axis=0)  # nothing to cut by: one bucket, compared in blocks
    pieces = list(cells.bucket_distances(same, cells.bucket_rows(same, 5, 2, bucket=100)))
    assert sum(np.isfinite(p[2]).sum() for p in pieces) >= 900 * 899


def test_average_linkage_is_exact():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 6)).astype(np.float32)
    i, j = np.triu_indices(40, 1)
    label = clusters.average_linkage(x, i, j, 2.6)
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    groups = [np.flatnonzero(label == c) for c in np.unique(label)]
    assert 1 < len(groups) < 40
    for a in range(len(groups)):  # no two clusters left could merge
        for b in range(a):
            assert d2[np.ix_(groups[a], groups[b])].mean() >= 2.6**2 - 1e-3


def test_vectors_of_nothing(spark):
    empty = table(spark, [])
    assert rows(neighbours.nearest_pairs([empty, empty])) == []
    assert rows(clusters.vector_clusters([empty, empty])) == []
    assert rows(clusters.typical_members(clusters.vector_clusters([empty]), [empty])) == []
