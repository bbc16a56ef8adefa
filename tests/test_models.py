import numpy as np
import pytest

from tests.conftest import rows
from wordmosaic.functions import vectors
from wordmosaic.operators import centers, geometry, kmeans, matching, positions, pq
from pyspark.sql import functions as F


def points(spark, values):
    return spark.createDataFrame([(k, [float(x) for x in (v if isinstance(v, (list, tuple)) else [v])]) for k, v in enumerate(values)], "id long, v array<double>")


def center_rows(spark, values):
    return spark.createDataFrame([(k, [float(x) for x in (v if isinstance(v, (list, tuple)) else [v])]) for k, v in enumerate(values)], "cid int, center array<double>")


def flat(df):
    return [r["center"][0] for r in df.orderBy("cid").collect()]


def test_root_forms(spark):
    df = spark.createDataFrame([("i", 0, [1.0, 3.0, 0.0, 0.0]), ("i", 1, [4.0] * 4)], "image_name string, desc_id int, descriptor array<double>")
    got = [[round(x, 6) for x in r["r"]] for r in df.select(vectors.root_vector(F.col("descriptor")).alias("r")).collect()]
    assert got == [[0.5, 0.866025, 0.0, 0.0], [0.5] * 4]
    long = df.select("image_name", "desc_id", F.flatten(F.array_repeat(F.col("descriptor"), 32)).alias("descriptor"))
    m = {r["desc_id"]: r for r in vectors.root_matrix(long).collect()}
    assert round(m[0]["divisor"], 6) == 7.0 and [round(x, 6) for x in m[0]["descriptor"][:4]] == [0.377964, 0.654654, 0.0, 0.0]


def test_usable_and_quantised(spark):
    good = [1.0] * 128
    data = [(1, "a", 0, "rootsift", [0.5] * 128), (1, "a", 0, "rootsift", [0.5] * 128), (2, "a", 1, "sift", good), (3, "a", 2, "sift", [0.0] * 128), (4, "a", 3, "sift", [1.0] * 127), (5, "a", 4, "sift", None), (6, "a", 5, "sift", [float("nan")] + good[1:]), (7, "a", 6, "sift", [None] + good[1:]), (None, "a", 7, "sift", good)]
    df = spark.createDataFrame([(*r, 0.0, 0.0) for r in data], "vec_id long, image_name string, desc_id int, kind string, descriptor array<float>, x float, y float")
    found = {r["vec_id"]: r["q"] for r in vectors.quantised(df).collect()}
    assert set(found) == {1, 2} and found[1] == [256] * 128 and found[2] == [int(np.sqrt(1 / 128) * 512)] * 128


def test_kmeans_golden(spark):
    p, start = points(spark, [0, 1, 10, 11]), center_rows(spark, [0, 1])
    one, _ = kmeans.step(p, start)
    assert flat(one) == [0.0, 22 / 3]
    assert flat(kmeans.step(p, start, truncate=True)[0]) == [0.0, 7.0]
    final, n = kmeans.kmeans(p, start)
    assert flat(final) == [0.5, 10.5] and n == 2
    assert flat(kmeans.kmeans(p, start, truncate=True)[0]) == [0.0, 10.0]
    assert flat(kmeans.step(p, center_rows(spark, [0, 1, 1000]))[0])[2] == 1000.0
    assert tuple(kmeans.unchanged(p, start, one).first()) == (3, 4)


def test_nearest_center_ties_and_blocks(spark):
    p = points(spark, [5, 6, 4])
    c = center_rows(spark, [0, 10])
    assert [r[1] for r in rows(centers.nearest_center(p, c).select("id", "cid"))] == [0, 1, 0]
    rng = np.random.RandomState(0)
    p, c = points(spark, rng.randint(0, 50, (300, 4)).tolist()), center_rows(spark, rng.randint(0, 50, (40, 4)).tolist())
    assert rows(centers.nearest_center(p, c, max_entries=1, block=7)) == rows(centers.nearest_center(p, c))
    assert centers.nearest_center(p, c.limit(0)).count() == 0


def test_many_centers_repeat_no_vector(spark):
    """Centres in several slices: vectors meet them without being shuffled; whole numbers, single and double precision alike."""
    rng = np.random.RandomState(5)
    p = points(spark, rng.randint(0, 50, (300, 4)).tolist())
    for base in (rng.randint(0, 50, (40, 4)), rng.randint(0, 400, (40, 4)) / 8, rng.rand(40, 4) * 50):
        c = center_rows(spark, base.tolist())
        sliced = centers.nearest_center(p, c, max_entries=1, block=7)
        exact = ((np.array([list(r["v"]) for r in p.orderBy("id").collect()])[:, None] - base[None]) ** 2).sum(axis=2)
        found = sliced.orderBy("id").collect()
        assert [r["cid"] for r in found] == exact.argmin(axis=1).tolist()
        assert np.allclose([r["d2"] for r in found], exact.min(axis=1))
        plan = sliced._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") > 3 and "Join" not in plan and "Generate" not in plan
        near = centers.approximate_nearest_center(p, c, probes=6, max_entries=1, block=7)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in near.select("id", "cid").orderBy("id").collect()] == [tuple(r) for r in sliced.select("id", "cid").orderBy("id").collect()]
        assert "Generate" not in plan and "CoGroup" not in plan
    assert centers.ann_recall(p, c, max_entries=1, block=7).first()["n_points"] == 300


def test_kmeans_beyond_broadcast(spark, monkeypatch):
    rng = np.random.RandomState(1)
    p = points(spark, rng.randint(0, 99, (200, 3)).tolist())
    start = kmeans.first_centers(p, 5)
    small = flat(kmeans.step(p, start, truncate=True)[0])
    monkeypatch.setattr(kmeans, "MAX_BROADCAST_ENTRIES", 1)
    assert flat(kmeans.step(p, start, truncate=True)[0]) == small


def test_inertia_never_rises(spark):
    rng = np.random.RandomState(2)
    p = points(spark, rng.randint(0, 99, (300, 3)).tolist())
    c, last = kmeans.first_centers(p, 6), float("inf")
    for _ in range(4):
        cost = centers.nearest_center(p, c).agg(F.sum("d2")).first()[0]
        assert cost <= last + 1e-6
        last, c = cost, kmeans.step(p, c)[0]


def test_approximate_center_recall(spark):
    rng = np.random.RandomState(3)
    base = rng.randint(0, 255, (400, 16))
    p = points(spark, (base[rng.randint(0, 400, 1000)] + rng.randint(-9, 10, (1000, 16))).tolist())
    c = center_rows(spark, base.tolist())
    exact, near = dict(rows(centers.nearest_center(p, c).select("id", "cid"))), dict(rows(centers.approximate_nearest_center(p, c).select("id", "cid")))
    assert np.mean([exact[k] == near[k] for k in exact]) >= 0.9


def test_index_beyond_the_broadcast(spark):
    """Too many centres to broadcast: joined by coarse cell, in pieces and blocks."""
    rng = np.random.RandomState(14)
    c, p = center_rows(spark, rng.randint(0, 50, (120, 8)).tolist()), points(spark, rng.randint(0, 50, (90, 8)).tolist())
    exact = rows(centers.nearest_center(p, c).select("id", "cid", "d2"))
    every = centers.approximate_nearest_center(p, c, probes=10, max_entries=0, rows=20, block=7)
    assert rows(every.select("id", "cid", "d2")) == exact
    some = dict(rows(centers.approximate_nearest_center(p, c, probes=5, max_entries=0).select("id", "cid")))
    assert len(some) == 90 and np.mean([some[k] == cid for k, cid, _ in exact]) >= 0.8
    assert rows(centers.approximate_nearest_center(p, c.limit(0))) == []


def test_synthetic_and_random(spark):
    assert kmeans.synthetic_points(spark, 5, 8).collect() == kmeans.synthetic_points(spark, 5, 8).collect()
    assert all(0 <= x < 255 for r in kmeans.random_centers(points(spark, [1]), 4, 8).collect() for x in r["center"])


def test_product_quantisation(spark):
    rng = np.random.RandomState(4)
    x = rng.randint(0, 255, (400, 8))
    p = points(spark, x.tolist())
    sample = pq.training_sample(p, 100)
    assert sample.count() == 100 and pq.training_sample(p, 1000).count() == 400
    book = pq.train_codebook(sample, 2, 8, 5).cache()
    b = pq.codebook_array(book)
    codes = pq.encode(p, book).cache()
    for r in codes.limit(50).collect():
        for m in range(2):
            d = ((b[m] - x[r["id"], m * 4 : m * 4 + 4]) ** 2).sum(axis=1)
            assert d[r["pq"][m]] == d.min()
    start = pq.first_code_centers(codes, 6)
    cost = lambda v: pq.predict(codes, v, book).agg(F.sum("d2")).first()[0]
    one = pq.code_kmeans_step(codes, start, book)
    assert cost(one) <= cost(start)
    assert pq.decoded(one, book).count() == 6 and len(pq.decoded(one, book).first()["center"]) == 8
    owners = codes.select("id", F.concat(F.lit("i"), (F.col("id") % 3).cast("string")).alias("image_name"))
    bags = pq.bags_from_codes(codes, owners, one, book)
    assert bags.count() == 3 and all(r["words"] == sorted(set(r["words"])) for r in bags.collect())


def descriptors(spark, data):
    return spark.createDataFrame([(i, k, [float(x) for x in v]) for i, k, v in data], "image_name string, idx long, v array<double>")


def test_matching_goldens(spark):
    d = descriptors(spark, [("q", 0, (0, 0)), ("q", 1, (10, 0)), ("t", 0, (1, 0)), ("t", 1, (2, 0))])
    pairs = spark.createDataFrame([("q", "t", 0.1)], "a string, b string, sim double")
    assert rows(matching.matches(pairs, d)) == [("q", "t", 0, 0, 1.0)]
    r = descriptors(spark, [("q", 0, (0,)), ("q", 1, (100,)), ("t", 0, (7,)), ("t", 1, (10,)), ("t", 2, (106.9,)), ("t", 3, (110,))])
    assert [x[2] for x in rows(matching.matches(pairs, r, "ratio"))] == [1]
    with pytest.raises(ValueError):
        matching.matches(pairs, d, "BRTUE_FORCE")
    with pytest.raises(ValueError):
        matching.matches(pairs, d, "ratio", binary=True)


def test_matching_in_blocks_is_the_same(spark):
    rng = np.random.RandomState(5)
    d = descriptors(spark, [(n, k, rng.randint(0, 99, 4)) for n in "abc" for k in range(30)])
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    assert rows(matching.two_nearest(pairs, d, block=7)) == rows(matching.two_nearest(pairs, d))


def test_binary_matching(spark):
    d = descriptors(spark, [("q", 0, (0b1111,)), ("q", 1, (0,)), ("t", 0, (0b0111,)), ("t", 1, (0b10000000,))])
    pairs = spark.createDataFrame([("q", "t")], "a string, b string")
    assert rows(matching.matches(pairs, d, binary=True)) == [("q", "t", 0, 0, 1.0), ("q", "t", 1, 1, 1.0)]


def planted(model, n=40, outliers=20, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 800, (n + outliers, 2))
    q = np.c_[p, np.ones(len(p))] @ np.array(model).T
    q = q[:, :2] / q[:, 2:]
    q[n:] += rng.uniform(100, 300, (outliers, 2)) * rng.choice([-1, 1], (outliers, 2))
    return p, q


@pytest.mark.parametrize("model", ["homography", "affine"])
def test_ransac_finds_planted_model(model):
    p, q = planted([[1, 0, 13], [0, 1, -7], [0, 0, 1]])
    ok = geometry.ransac(p, q, model)
    assert ok[:40].all() and ok.sum() < 46
    if model == "homography":
        p, q = planted([[1.1, 0.05, 13], [-0.04, 0.97, -7], [1e-4, -5e-5, 1]])
        assert geometry.ransac(p, q, model)[:40].all()


def test_ransac_without_a_model():
    assert not geometry.ransac(np.zeros((4, 2)), np.zeros((4, 2))).any()
    assert geometry.ransac(np.zeros((9, 2)), np.zeros((9, 2)) + 5).sum() in (0, 9)


def test_verify_planted_pair(spark):
    p, q = planted([[1, 0, 13], [0, 1, -7], [0, 0, 1]])
    d = descriptors(spark, [(n, k, np.eye(60)[k]) for n in "ab" for k in range(60)] + [("c", 0, np.eye(60)[0])])
    places = {("a", k): p[k] for k in range(60)} | {("b", k): q[k] for k in range(60)} | {("c", 0): np.array([np.nan, 1.0])}
    kp = spark.createDataFrame([(n, k, float(x), float(y)) for (n, k), (x, y) in places.items()], "image_name string, idx long, x double, y double")
    pairs = spark.createDataFrame([("a", "b", 0.2), ("a", "c", 0.1)], "a string, b string, sim double")
    matched = matching.matches(pairs, d)
    found = {r["b"]: r["n_inliers"] for r in geometry.verify(pairs, matched, kp).collect()}
    assert 40 <= found["b"] < 46 and found["c"] == 0
    assert [r["b"] for r in geometry.verify(pairs, matched, kp, min_inliers=10).collect()] == ["b"]
    known = geometry.model_inliers(matched, kp, [[1, 0, 13], [0, 1, -7], [0, 0, 1]]).collect()
    assert [(r["b"], r["n_inliers"]) for r in known] == [("b", 40)]
    with pytest.raises(ValueError):
        geometry.verify(pairs, matched, kp, model="rigid")


def test_resize(spark):
    given_ = [(1600, 1200), (600, 300), (1000, 1000), (300, 900)]
    df = geometry.resize_dims(spark.createDataFrame(given_, "w int, h int"))
    assert [(r["new_w"], r["new_h"]) for r in df.collect()] == [(1200, 900), (1200, 600), (1200, 1200), (400, 1200)]


def test_positions(spark):
    owners = spark.createDataFrame([("a", 2), ("b", 3), ("c", 0), ("d", 1)], "name string, count long")
    owners = positions.running_offsets(owners, "name", "count")
    assert rows(owners.select("name", "start")) == [("a", 0), ("b", 2), ("c", 5), ("d", 5)]
    placed = positions.positional_assign(spark.range(7).withColumnRenamed("id", "row"), owners, width=2)
    assert rows(placed.select("row", "name")) == [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "b"), (5, "d")]
    left = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, name string")
    right = spark.createDataFrame([(0, "a"), (1, "c"), (2, "d")], "pos long, name string")
    assert sorted(positions.order_mismatches(left, right).collect(), key=lambda r: r[0]) == [(1, "b", "c"), (2, None, "d")]


def test_root_form_travels_as_stored(spark):
    """Vectors are shuffled once, as stored and not as doubles; of differing rows the smallest root form is taken."""
    from wordmosaic.functions import vectors

    data = [(1, "sift", [4.0] * 128), (1, "sift", [4.0] * 128), (1, "rootsift", [0.5] * 128), (2, "rootsift", [0.25] * 128), (None, "sift", [1.0] * 128)]
    found = vectors.root_form(spark.createDataFrame(data, "vec_id long, kind string, descriptor array<float>"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan
    assert [(k, round(v[0], 6)) for k, v in sorted(tuple(r) for r in found.collect())] == [(1, round((4 / 512) ** 0.5, 6)), (2, 0.25)]
