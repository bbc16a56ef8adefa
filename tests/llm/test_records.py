import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from wordmosaic.llm import common, groups, neardup, setjoin, termcount
from wordmosaic.operators import runs
from wordmosaic.session import hot_join


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in parent)


def edge_table(spark, edges):
    data = [(a, b, "u", 1, 2) for a, b in edges]
    return spark.createDataFrame(data, "a string, b string, node string, label int, u int")


# Problem 1


@pytest.mark.parametrize("hot", [None, 3])
def test_groups_against_union_find(spark, hot):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(400):03}", f"n{rng.randrange(400):03}") for _ in range(260)]
    edges += [("hub", f"h{k:03}") for k in range(120)] + [(f"c{k:02}", f"c{k + 1:02}") for k in range(40)]
    edges += [(b, a) for a, b in edges[:30]] + edges[:20] + [(None, "n001"), ("n002", None), ("n003", "n003")]
    assert rows(groups.connected_groups(edge_table(spark, edges), "a", "b", hot)) == union_find(edges)


def test_groups_of_nothing(spark):
    assert rows(groups.connected_groups(edge_table(spark, []), "a", "b")) == []
    assert rows(groups.connected_groups(edge_table(spark, [(None, None), ("x", "x")]), "a", "b")) == []
    numbers = spark.createDataFrame([(5, 3), (3, -1)], "a long, b long")
    assert rows(groups.connected_groups(numbers, "a", "b")) == [(-1, -1), (3, -1), (5, -1)]


def test_match_links(spark):
    nan = float("nan")
    pairs = spark.createDataFrame([("oxc1_x.jpg", "y", 0.35), ("x", "z", 0.349), ("x", "z", nan), ("x", "z", 1.01), ("x", "z", None), ("p", "q", 1.0), (None, "q", 0.5)], "a string, b string, sim double")
    verified = spark.createDataFrame([("y.txt", "w", 50), ("y", "v", 49), ("y", "v", None), ("y", "v", -60)], "a string, b string, n_inliers int")
    found = groups.image_groups(groups.match_links(pairs, verified))
    assert rows(found) == [("p", "p"), ("q", "p"), ("w", "w"), ("x", "w"), ("y", "w")]
    assert rows(groups.group_sizes(found)) == [("p", 2), ("w", 3)]


def test_hot_join_keeps_every_row(spark):
    many = spark.createDataFrame([("h", k) for k in range(50)] + [("x", 1), (None, 2), ("y", 3)], "key string, v int")
    one = spark.createDataFrame([("h", 10), ("x", 20), ("z", 30)], "key string, w int")
    for how in ("inner", "left"):
        assert sorted(map(repr, hot_join(many, one, "key", how, hot_rows=5).collect())) == sorted(map(repr, many.join(one, "key", how).collect()))


# Problem 3


def brute_counts(records, longest):
    occ, recs = {}, {}
    for k, words in enumerate(records):
        words = [w for w in words or [] if w is not None]
        for n in range(1, longest + 1):
            for i in range(len(words) - n + 1):
                g = tuple(words[i : i + n])
                occ[g] = occ.get(g, 0) + 1
                recs.setdefault(g, set()).add(k)
    return sorted((list(g), n, len(recs[g])) for g, n in occ.items())


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.integers(0, 3)), max_size=8)), max_size=8), st.integers(1, 4))
def test_sequences_against_brute_force(spark, records, longest):
    df = spark.createDataFrame([(r, 1, "f") for r in records], "terms array<int>, n int, first string")
    assert rows(termcount.sequence_counts(df, "terms", longest)) == brute_counts(records, longest)


def test_hot_first_terms_are_spread(spark):
    rng = random.Random(2)
    records = [[1] + [rng.randrange(30) for _ in range(6)] for _ in range(60)]
    df = spark.createDataFrame([(r,) for r in records], "terms array<int>")
    assert rows(termcount.sequence_counts(df, "terms", 3, hot_suffixes=5)) == brute_counts(records, 3)
    words = spark.createDataFrame([(["a", "b", "a"],)], "terms array<string>")
    assert rows(termcount.sequence_counts(words, "terms", 2)) == [(["a"], 2, 1), (["a", "b"], 1, 1), (["b"], 1, 1), (["b", "a"], 1, 1)]
    with pytest.raises(ValueError):
        termcount.sequence_counts(words, "terms", 0)


def test_word_statistics(spark):
    bags = [("a", [1, 1, 1, 1, 2, None, -1, 10**6]), ("a", [1, 1, 1, 1, 2]), ("b", [1]), ("c", None), ("d", []), (None, [7])]
    df = spark.createDataFrame([(n, w, "o") for n, w in bags], "image_name string, words array<int>, word string")
    assert rows(termcount.word_statistics(df)) == [(1, 5, 2, ["common"]), (2, 1, 1, ["rare", "common"])]
    assert rows(termcount.word_statistics(df.limit(0))) == []


# Problems 5 and 6


def random_bags(seed, n, prefix="i", words=60):
    rng = random.Random(seed)
    base = [[rng.randrange(words) for _ in range(rng.randrange(1, 14))] for _ in range(n // 3)]
    out = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.randrange(words)
        out.append((f"{prefix}{k:03}", w))
    out += [(f"{prefix}copy{k:02}", [3, 1, 2]) for k in range(12)] + [(f"{prefix}null", None), (f"{prefix}none", []), (f"{prefix}bad", [None, -1, 10**7]), (f"{prefix}one", [5]), (None, [3, 1, 2])]
    return out + [(out[0][0], out[0][1][::-1]), out[1]]


def bag_table(spark, data):
    return spark.createDataFrame([(n, w, n, 0, "t") for n, w in data], "image_name string, words array<int>, rep string, cid int, token string")


def brute_pairs(main, other, theta):
    sets = {}
    for flag, data in ((True, main), (False, other)):
        for n, w in data:
            s = {x for x in w or [] if x is not None and 0 <= x < 10**6}
            if n is not None and s:
                sets[n, flag] = s
    keys = sorted(sets)
    found = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a[1] or b[1]) and a[0] != b[0] and len(sets[a] & sets[b]) >= theta * len(sets[a] | sets[b]):
                found.add((min(a[0], b[0]), max(a[0], b[0])))
    return sorted(found)


@pytest.mark.parametrize("theta", [0.5, 0.8])
def test_set_join_against_brute_force(spark, theta):
    main, other = random_bags(3, 90), random_bags(4, 30, "r")
    found = setjoin.similar_set_pairs(bag_table(spark, main), bag_table(spark, other), theta)
    assert rows(found) == brute_pairs(main, other, theta)


def test_hot_tokens_and_large_universes(spark):
    main = random_bags(5, 90, words=15)
    sets = setjoin.as_sets(bag_table(spark, main))
    classes = setjoin.set_classes(sets)
    want = rows(setjoin.verified_pairs(setjoin.candidate_pairs(setjoin.prefix_index(classes, 0.5), 0.5), classes, 0.5).select("x", "y"))
    assert len(want) > 20
    for index in (setjoin.prefix_index(classes, 0.5), setjoin.prefix_index(classes, 0.5, max_dense=1)):
        for found in (setjoin.candidate_pairs(index, 0.5, hot_postings=3), neardup.product_candidates(index, 0.5, hot_postings=3), neardup.product_candidates(index, 0.5)):
            assert rows(setjoin.verified_pairs(found, classes, 0.5).select("x", "y")) == want


def test_one_set_of_a_third_and_a_token_of_half(spark, monkeypatch):
    """A set held by a third of the images, similar to others, and a token in half of them: all pairs, in blocks."""
    monkeypatch.setattr(setjoin, "HOT_COPIES", 7)
    monkeypatch.setattr(setjoin, "HOT_POSTINGS", 5)
    main = random_bags(8, 60) + [(f"third{k:02}", [7, 8, 9, 10]) for k in range(40)] + [(f"half{k:02}", [7, 8, 9, 10 + k]) for k in range(25)]
    other = random_bags(9, 12, "r") + [(f"rthird{k}", [10, 9, 8, 7]) for k in range(9)] + [("third01", [7, 8, 9])]
    sets = setjoin.similar_set_pairs(bag_table(spark, main), bag_table(spark, other), 0.5)
    assert rows(sets) == brute_pairs(main, other, 0.5)
    rows_of = setjoin.block_pairs(setjoin.prefix_index(setjoin.set_classes(setjoin.as_sets(bag_table(spark, main))), 0.5), 5)
    assert rows_of.groupBy("token", "task").count().agg({"count": "max"}).first()[0] <= 30


def test_product_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HELD", 7)
    classes = setjoin.set_classes(setjoin.as_sets(bag_table(spark, random_bags(6, 60, words=15))))
    index = setjoin.prefix_index(classes, 0.5)
    assert rows(neardup.product_candidates(index, 0.5)) == rows(setjoin.candidate_pairs(index, 0.5))


def test_set_join_of_nothing(spark):
    empty = bag_table(spark, [])
    assert rows(setjoin.similar_set_pairs(empty, empty)) == []
    assert rows(setjoin.similar_set_pairs(bag_table(spark, [("a", [1])]), None)) == []


def test_classes_with_links(spark):
    data = [("a", [1, 2, 3]), ("b", [3, 2, 1]), ("c", [1, 2, 3, 4]), ("d", [9])]
    assert rows(setjoin.set_classes_with_links(bag_table(spark, data))) == [("a", "a", 2, 1), ("b", "a", 2, 1), ("c", "c", 1, 1), ("d", "d", 1, 0)]


def test_near_duplicate_groups(spark):
    main = random_bags(7, 120)
    scored = [("i003.jpg", "lost", 0.9), ("lost", "i000", float("nan")), ("oxc1_x", "y", 0.8), ("x", "z", 0.79), ("x", "x", 1.0), (None, "x", 1.0)]
    pairs = spark.createDataFrame(scored, "a string, b string, sim double")
    edges = brute_pairs(main, [], 0.8) + [("i003", "lost"), ("x", "y")]
    assert rows(neardup.near_duplicate_groups(bag_table(spark, main), pairs)) == union_find(edges)
    assert rows(neardup.near_duplicate_groups(bag_table(spark, []), pairs.limit(0))) == []


def test_delivered_once(spark):
    data = [("a", None), ("a", [2, 1, 1]), ("b", [1]), ("b", [3, 2]), ("c", None)]
    assert rows(common.delivered_once(bag_table(spark, data)).filter("words is not null")) == [("a", [1, 1, 2]), ("b", [2, 3])]
    assert common.delivered_once(bag_table(spark, data)).count() == 3


def test_whole_runs():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"k": k}) for k in ([1, 1, 2], [2], [], [2, 3], [3, 3])]
    cut = [t.column("k").to_pylist() for t in runs.whole_runs(iter(batches), ["k"])]
    assert sum(cut, []) == [1, 1, 2, 2, 2, 3, 3, 3]
    assert [len({*a} & {*b}) for a, b in zip(cut, cut[1:])] == [0] * (len(cut) - 1)


def test_found_columns(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    from wordmosaic.llm.queries import QUERIES

    columns = {"p1_found": ["image_name", "group_name"], "p3_found": ["word", "mark"], "p5_found": ["name_a", "name_b"], "p6_found": ["image_name", "group_name"], "p4_found": ["tbl", "id_a", "id_b"], "p2_found": ["tbl", "item_id", "cluster_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "subject"]}
    for name, want in columns.items():
        df = QUERIES[name](spark, d)
        assert df.columns == want and df.count() == df.distinct().count() > 0
