import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from wordmosaic.functions import names
from wordmosaic.operators import bow, collisions, minhash, similarity
from wordmosaic.operators.skew import pairs_within
from pyspark.sql import functions as F

BAGS = [("a", [0, 1, 2, 3]), ("b", [1, 2, 3, 4]), ("c", [0, 1, 2, 3]), ("d", [7, 7, 8])]
SCHEMA = "image_name string, words array<int>"
FAMILY = minhash.HashFamily(32, 16, 3, seed=1)


def bags(spark, data=BAGS):
    return spark.createDataFrame(data, SCHEMA)


def test_names(spark):
    given_ = ["oxc1_x_1.jpg", "x_1.jpg.hesaff.sift", "oxc1_x_1.txt", "x_1", "x.jpg_1", None]
    df = spark.createDataFrame([(g,) for g in given_], "n string").select(names.image_name(F.col("n")).alias("n"), names.as_jpg(F.col("n")).alias("j"))
    assert [r["n"] for r in df.collect()] == ["x_1", "x_1", "x_1", "x_1", "x.jpg_1", None]
    assert df.collect()[3]["j"] == "x_1.jpg"


def test_bags_are_cleaned(spark):
    data = [("a", [3, None, -1, 10, 2, 3]), ("a", [2, 3, 3]), ("n", None), ("e", []), ("i", [-5, 99]), (None, [1])]
    assert rows(bow.bow_multiset(bags(spark, data), 10)) == [("a", [2, 3, 3])]
    assert rows(bow.bow_set(bags(spark, data), 10)) == [("a", [2, 3])]
    assert rows(bow.bow_multiset(bags(spark, []), 10)) == []


def test_fullest_delivery_counts(spark):
    assert rows(bow.bow_multiset(bags(spark, [("a", [1]), ("a", [2, 3]), ("a", None)]), 10)) == [("a", [2, 3])]


def test_weights(spark):
    found = {r["word"]: (r["cnt"], r["weight"]) for r in bow.all_word_weights(bags(spark), 10).collect()}
    assert found[0] == (2, 0.5) and found[4] == (1, 1.0) and found[7] == (2, 0.5) and found[5] == (0, 1e-12)
    assert all(math.isclose(found[w][1], 1 / 3) for w in (1, 2, 3))
    distinct = {r["word"]: r["cnt"] for r in bow.word_weights(bags(spark), distinct=True).collect()}
    assert distinct[7] == 1
    assert rows(bow.unused_words(bags(spark), 10)) == [(5,), (6,), (9,)]


def test_distinct_sets_and_membership(spark):
    assert [r[0] for r in rows(bow.distinct_sets(bags(spark)))] == ["a", "b", "d"]
    assert rows(bow.set_membership(bags(spark))) == [("a", "a"), ("b", "b"), ("c", "a"), ("d", "d")]


def test_descriptor_counts(spark):
    d = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 0), (None, 1), ("b", None)], "image_name string, desc_id int")
    assert rows(bow.descriptor_counts(d)) == [("a", 2), ("b", 1)]
    assert rows(bow.descriptor_totals(d)) == [(2, 3, 1.5)]


def test_signature_forms_agree(spark):
    by_arrow = {(r[0], i): h for r in minhash.signatures(bags(spark), FAMILY).collect() for i, h in enumerate(r[1])}
    by_rows = {(r[0], r[1]): r[2] for r in minhash.signature_rows(bags(spark), FAMILY).collect()}
    assert by_arrow == by_rows
    assert by_arrow["a", 5] == by_arrow["c", 5]


@settings(max_examples=50, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 999_999), min_size=1, max_size=50), st.lists(st.integers(0, 999_999), min_size=1, max_size=50))
def test_minima_of_a_union(x, y):
    a, b, _ = FAMILY.drawn
    m = lambda w: minhash._bag_minima(np.array(w, np.int64), a, b)
    assert (m(x + y) == np.minimum(m(x), m(y))).all()
    assert (m(x) == m(sorted(set(x)))).all()


def test_long_bag_is_hashed_in_blocks():
    a, b, _ = FAMILY.drawn
    words = np.arange(3 * minhash.WORDS_HELD + 5, dtype=np.int64)
    assert (minhash._bag_minima(words, a, b) == ((a[:, None] * words + b[:, None]) % minhash.PRIME).min(axis=1)).all()
    counts = np.ones(len(words))
    u = ((a[:, None] * words + b[:, None]) % minhash.PRIME + 1) / (minhash.PRIME + 1)
    assert (minhash._weighted_minima(words, counts, a, b) == words[(-np.log(u)).argmin(axis=1)]).all()


def test_weighted_collisions_follow_weighted_jaccard():
    family = minhash.HashFamily(4096, 1, 1, seed=3)
    a, b, _ = family.drawn
    cnt = {1: 1.0, 2: 1.0, 3: 10.0, 4: 10.0, 5: 2.0}
    sig = lambda w: minhash._weighted_minima(np.array(w), np.array([cnt[x] for x in w]), a, b)
    x, y = [1, 3, 5], [1, 4, 5]
    expected = (1 + 0.5) / (1 + 0.5 + 0.1 + 0.1)
    assert abs((sig(x) == sig(y)).mean() - expected) < 0.04


def test_collisions(spark):
    sk = minhash.sketches(minhash.signatures(bags(spark), FAMILY), FAMILY)
    found = rows(collisions.collision_pairs(sk))
    assert ("a", "c") in found and not any("d" in p for p in found)
    assert rows(collisions.collision_pairs(sk, hot_rows=1)) == found
    seen = dict(rows(collisions.seen_before(sk)))
    assert seen["a"] is False and seen["c"] is True
    bins = collisions.sketch_bins(sk).count()
    assert bins >= FAMILY.k and collisions.collision_clusters(sk).groupBy("k", "s0", "s1", "s2").count().count() == bins


def test_similar_pairs(spark):
    found = {(r["a"], r["b"]): r["sim"] for r in collisions.similar_pairs(bags(spark), minhash.HashFamily(64, 64, 1)).collect()}
    assert found == {("a", "b"): 0.6, ("a", "c"): 1.0, ("b", "c"): 0.6}
    assert collisions.similar_pairs(bags(spark, []), FAMILY).count() == 0
    weighted = collisions.similar_pairs(bags(spark), minhash.HashFamily(64, 64, 1), bow.word_weights(bags(spark)))
    assert {(r["a"], r["b"]) for r in weighted.collect()} >= {("a", "c")}


def test_recall_rises_with_similarity(spark):
    """With independent functions a pair of similarity s is found with probability 1 - (1 - s^3)^k."""
    rng = np.random.RandomState(0)
    data, sim = [], {}
    for k in range(60):
        shared = [int(x) for x in rng.randint(0, 10**6, 40)]
        other = lambda: [int(x) for x in rng.randint(0, 10**6, 60)]  # noqa: E731, B023
        data += [(f"x{k}", shared + other()), (f"y{k}", shared + other())]
        sim[k] = 40 / 160
    found = {r["a"][1:] for r in collisions.similar_pairs(bags(spark, data), minhash.HashFamily(1536, 512, 3)).collect() if r["a"][1:] == r["b"][1:]}
    assert len(found) >= 55  # expected 60 * 0.9997


def test_pairs_within_blocks(spark):
    data = spark.createDataFrame([(1, f"i{k:03}") for k in range(60)] + [(2, "i000"), (2, "i001")], "k int, item string")
    plain = rows(pairs_within(data, ["k"], "item"))
    assert len(plain) == 60 * 59 // 2 + 1
    assert rows(pairs_within(data, ["k"], "item", hot_rows=10)) == plain


def test_jaccard_and_bands(spark):
    s = spark.range(1)
    one = lambda e: s.select(e.alias("x")).first()["x"]
    arr = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<int>")
    assert one(similarity.jaccard(arr(0, 1, 2, 3), arr(1, 2, 3, 4))) == 0.6
    assert one(similarity.jaccard(arr(), arr())) is None
    assert [one(similarity.band(F.lit(v))) for v in (0.0449, 0.045, 0.3499, 0.35)] == ["irr", "sim", "sim", "dup"]


def test_clean_pairs(spark):
    nan = float("nan")
    data = [("b.jpg", "a", 0.5), ("a", "b", 0.7), ("a", "a.txt", 0.9), (None, "a", 0.4), ("a", "c", nan), ("a", "d", 1.5), ("a", "e", None), ("oxc1_f", "a", 0.0)]
    df = spark.createDataFrame(data, "a string, b string, sim double")
    assert rows(similarity.clean_pairs(df)) == [("a", "b", 0.7), ("a", "f", 0.0)]
    counts = similarity.band_counts(similarity.clean_pairs(df)).first()
    assert tuple(counts) == (1, 0, 1, 2)
    v = spark.createDataFrame([("b", "a", 0.5, 3), ("a", "b", nan, 9), ("a", "c", 0.1, -1), ("a", "d", 0.1, None)], "a string, b string, sim double, n_inliers int")
    assert rows(similarity.clean_verified(v)) == [("a", "b", 0.5, 9)]


def test_weighted_jaccard(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "d")], "a string, b string")
    found = {(r[0], r[1]): r[2] for r in similarity.weighted_jaccard(pairs, bags(spark), bow.word_weights(bags(spark))).collect()}
    assert math.isclose(found["a", "b"], 1.0 / (1.0 + 0.5 + 1.0)) and found["a", "d"] == 0.0


def test_lookup_table_is_the_seeded_stream():
    table, choices = minhash.lookup_table(4, 6, 3, 2, seed=0)
    rng = np.random.RandomState(0)
    assert (table == rng.uniform(size=(4, 6))).all() and (choices == rng.randint(0, 4, size=(3, 2))).all()
    weighted, _ = minhash.lookup_table(4, 6, 3, 2, weights=np.full(6, 0.5), seed=0)
    assert np.allclose(weighted, -np.log(table) / 0.5)


def test_all_pairs_move_no_pairs(spark):
    """In blocks or in one, with common and rare words, null words and large bags: as by sets; and no shuffle of pairs."""
    rng = np.random.RandomState(8)
    data = {f"i{k:03}": [*rng.choice(6, 1 + k % 5, replace=False).tolist(), *rng.randint(6, 400, k % 40).tolist(), *([None] * (k % 7 == 0))] for k in range(150)}
    made = spark.createDataFrame([*data.items(), ("none", [])], "image_name string, words array<int>")
    sets = {k: set(v) for k, v in data.items()}
    same = {(a, b): len(sets[a] & sets[b] - {None}) for a in sets for b in sets if a < b}
    sims = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in same.items() if n}
    for least in (0.045, 0.5):
        for block in (20, 1_000):
            found = similarity.all_pairs(made, least, block=block)
            assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
            assert {(r["a"], r["b"]): r["sim"] for r in found.collect()} == {p: x for p, x in sims.items() if x >= least}
    some = spark.createDataFrame([(*p, x) for p, x in sims.items() if x > 0.2 or x < 0.03], "a string, b string, sim double")
    told = {r["band"]: (r["n_pairs"], r["n_found"]) for r in similarity.bands_found(made, some).collect()}
    near = [x for x in sims.values() if x >= 0.045]
    assert told == {"sim": (sum(x < 0.35 for x in near), sum(0.2 < x < 0.35 for x in near)), "dup": (n := sum(x >= 0.35 for x in near), n)}


def test_similar_pairs_in_passes(spark):
    """Some sketches at a time, hot bins apart: the pairs of the sketches joined at once, and no join carries sketches."""
    rng = np.random.RandomState(9)
    data = [(f"i{k:03}", sorted({*rng.randint(0, 9, 1 + k % 3).tolist(), *rng.randint(9, 10**6, k % 4).tolist()})) for k in range(120)] + [("long", list(range(0, 900, 2))), ("alike", list(range(0, 904, 2)))]
    made = spark.createDataFrame(data, "image_name string, words array<int>")
    family, sets = minhash.HashFamily(32, 24, 3), dict(data)
    weights = bow.word_weights(made)
    for w, hows in ((None, ({}, {"most_rows": 1_000, "hot_rows": 5})), (weights, ({},))):
        sigs = minhash.signatures(made, family) if w is None else minhash.weighted_signatures(made, w, family)
        pairs = {tuple(r) for r in collisions.collision_pairs(minhash.sketches(sigs, family)).collect()}
        assert ("alike", "long") in pairs
        for how in hows:
            found = [tuple(r) for r in collisions.similar_pairs(made, family, w, **how).collect()]
            assert len(found) == len(pairs) and {r[:2] for r in found} == pairs
            assert all(sim == len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b, sim in found)
