"""SQL twins of the catalogue's queries, for an independent engine."""

from __future__ import annotations

from wordmosaic.functions.vectors import STEPS
from wordmosaic.operators.bow import UNUSED_WEIGHT
from wordmosaic.operators.minhash import PRIME, HashFamily
from wordmosaic.plans.catalogue import FULL, KMEANS_K, MODEL, PQ_CODES, PQ_ITERS, PQ_WORDS, SAMPLE, STEP, VOCABULARY

_VALID = f"list_filter(words, lambda w: w IS NOT NULL AND w >= 0 AND w < {VOCABULARY})"
BAGS = f"""
bags AS (
  SELECT image_name, words FROM (
    SELECT image_name, list_sort({_VALID}) AS words,
           row_number() OVER (PARTITION BY image_name ORDER BY len({_VALID}) DESC, list_sort({_VALID})) AS k
    FROM bow WHERE image_name IS NOT NULL AND len({_VALID}) > 0) WHERE k = 1),
sets AS (SELECT image_name, list_sort(list_distinct(words)) AS words FROM bags),
distinct_sets AS (SELECT min(image_name) AS image_name, words, count(*) AS n_images FROM sets GROUP BY words)
"""
_JOINED = "array_to_string(words, ',') AS words"


def _name(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '(\\.jpg\\.hesaff\\.sift|\\.txt|\\.jpg)$', ''), '^oxc1_', '')"


PAIRS = f"""
pairs_clean AS (
  SELECT least(x, y) AS a, greatest(x, y) AS b, max(sim) AS sim
  FROM (SELECT {_name("a")} AS x, {_name("b")} AS y, sim FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)
  WHERE x <> y AND NOT isnan(sim) AND sim >= 0 AND sim <= 1 GROUP BY 1, 2)
"""
VERIFIED = f"""
verified_clean AS (
  SELECT least(x, y) AS a, greatest(x, y) AS b, max(CASE WHEN NOT isnan(sim) AND sim >= 0 AND sim <= 1 THEN sim END) AS sim, max(n_inliers) AS n_inliers
  FROM (SELECT {_name("a")} AS x, {_name("b")} AS y, sim, n_inliers FROM verified WHERE a IS NOT NULL AND b IS NOT NULL)
  WHERE x <> y AND n_inliers >= 0 GROUP BY 1, 2)
"""
_BAND = "CASE WHEN sim < 0.045 THEN 'irr' WHEN sim < 0.35 THEN 'sim' ELSE 'dup' END"


def _usable(v: str) -> str:
    return f"len({v}) = 128 AND len(list_filter({v}, lambda z: z IS NULL OR isnan(z))) = 0 AND len(list_filter({v}, lambda z: z <> 0)) > 0"


_ROOT = "list_transform(descriptor, lambda z: sqrt(z::DOUBLE / (list_sum(list_transform(descriptor, lambda y: abs(y::DOUBLE))) + 1e-10)))"
VECTORS = f"""
v AS (
  SELECT vec_id, min(image_name) AS image_name, min(desc_id) AS desc_id, min(x) AS x, min(y) AS y, min(q) AS q
  FROM (SELECT vec_id, image_name, desc_id, x, y, list_transform(r, lambda z: floor(z * {STEPS})::INTEGER) AS q
        FROM (SELECT *, CASE WHEN kind = 'sift' THEN {_ROOT} ELSE list_transform(descriptor, lambda z: z::DOUBLE) END AS r
              FROM descriptors WHERE vec_id IS NOT NULL AND {_usable("descriptor")}))
  GROUP BY vec_id),
p AS (SELECT vec_id, q::DOUBLE[128] AS q FROM v)
"""


def _functions(f: HashFamily) -> str:
    return "fn(i, a, b) AS (VALUES " + ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(zip(f.a, f.b, strict=True))) + ")"


def _choices(f: HashFamily) -> str:
    return "ch(k, i0, i1, i2) AS (VALUES " + ", ".join(f"({k}, {r[0]}, {r[1]}, {r[2]})" for k, r in enumerate(f.choices)) + ")"


def _signature(f: HashFamily, source: str) -> str:
    return f"""{_functions(f)}, {_choices(f)},
sig AS (SELECT image_name, i, min((a * word + b) % {PRIME}) AS h FROM (SELECT image_name, unnest(words) AS word FROM {source}), fn GROUP BY image_name, i)"""


def _weighted_signature(f: HashFamily, source: str) -> str:
    return f"""{_functions(f)}, {_choices(f)},
counts AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM bags) GROUP BY word),
sig AS (SELECT image_name, i, arg_min(word, {{'v': -ln(((a * word + b) % {PRIME} + 1) / {PRIME + 1}::DOUBLE) * cnt, 'w': word}})::BIGINT AS h
        FROM (SELECT image_name, word, cnt FROM (SELECT image_name, unnest(words) AS word FROM {source}) JOIN counts USING (word)), fn GROUP BY image_name, i)"""


_SKETCHES = """listed AS (SELECT image_name, list(h ORDER BY i) AS l FROM sig GROUP BY image_name),
sk AS (SELECT image_name, k, l[i0 + 1] AS s0, l[i1 + 1] AS s1, l[i2 + 1] AS s2 FROM listed, ch)"""
_FOUND = """found AS (SELECT DISTINCT x.image_name AS a, y.image_name AS b FROM sk x JOIN sk y ON x.k = y.k AND x.s0 = y.s0 AND x.s1 = y.s1 AND x.s2 = y.s2 AND x.image_name < y.image_name)"""
_ALL = """posting AS (SELECT image_name, len(words) AS n, unnest(words) AS word FROM distinct_sets),
alike AS (SELECT x.image_name AS a, y.image_name AS b, count(*) / (any_value(x.n + y.n) - count(*))::DOUBLE AS sim
  FROM posting x JOIN posting y ON x.word = y.word AND x.image_name < y.image_name GROUP BY x.image_name, y.image_name)"""
_SCORED = """SELECT a, b, o / (len(x.words) + len(y.words) - o)::DOUBLE AS sim
  FROM (SELECT a, b, count(*) AS o FROM (SELECT a, b, unnest(list_intersect(x.words, y.words)) FROM found JOIN distinct_sets x ON x.image_name = a JOIN distinct_sets y ON y.image_name = b) GROUP BY a, b)
  JOIN distinct_sets x ON x.image_name = a JOIN distinct_sets y ON y.image_name = b"""


def _kmeans(n: int) -> str:
    parts = [f"c0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS cid, q::DOUBLE[] AS c FROM (SELECT * FROM p ORDER BY vec_id LIMIT {KMEANS_K}))"]
    for t in range(n + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT vec_id, arg_min(cid, {{'d': array_distance(q, c::DOUBLE[128]), 'c': cid}}) AS cid FROM p, c{t} GROUP BY vec_id)")
        parts.append(f"m{t} AS MATERIALIZED (SELECT cid, k, floor(sum(x) / count(*)) AS x FROM (SELECT cid, unnest(q::DOUBLE[]) AS x, unnest(range(128)) AS k FROM p JOIN a{t} USING (vec_id)) GROUP BY cid, k)")
        parts.append(f"c{t + 1} AS MATERIALIZED (SELECT o.cid, coalesce(n.c, o.c) AS c FROM c{t} o LEFT JOIN (SELECT cid, list(x ORDER BY k) AS c FROM m{t} GROUP BY cid) n USING (cid))")
    return ", ".join(parts)


def _center_rows(c: str) -> str:
    return f"SELECT cid, unnest(range(128))::INTEGER AS k, unnest(c) AS x FROM {c}"


SAMPLED = f"sampled AS (SELECT vec_id, q FROM v ORDER BY md5(vec_id::VARCHAR || '|0'), vec_id LIMIT {SAMPLE})"


def _codebook() -> str:
    parts = [
        "sub AS (SELECT vec_id, m, q[m * 16 + 1 : m * 16 + 16]::DOUBLE[16] AS u FROM sampled, range(8) t(m))",
        f"b0 AS (SELECT m, (row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1)::INTEGER AS code, u::DOUBLE[] AS c FROM sub QUALIFY row_number() OVER (PARTITION BY m ORDER BY vec_id) <= {PQ_CODES})",
    ]
    for t in range(PQ_ITERS):
        parts.append(f"ba{t} AS (SELECT m, vec_id, arg_min(code, {{'d': array_distance(u, c::DOUBLE[16]), 'c': code}}) AS code FROM sub JOIN b{t} USING (m) GROUP BY m, vec_id)")
        parts.append(f"bm{t} AS MATERIALIZED (SELECT m, code, k, floor(sum(x) / count(*)) AS x FROM (SELECT m, code, unnest(u::DOUBLE[]) AS x, unnest(range(16)) AS k FROM sub JOIN ba{t} USING (m, vec_id)) GROUP BY m, code, k)")
        parts.append(f"b{t + 1} AS MATERIALIZED (SELECT o.m, o.code, coalesce(n.c, o.c) AS c FROM b{t} o LEFT JOIN (SELECT m, code, list(x ORDER BY k) AS c FROM bm{t} GROUP BY m, code) n USING (m, code))")
    parts.append(f"book AS (SELECT m::INTEGER AS m, code, c::DOUBLE[16] AS c FROM b{PQ_ITERS})")
    return ", ".join(parts)


ENCODED = """
parts AS (SELECT vec_id, m::INTEGER AS m, q[m * 16 + 1 : m * 16 + 16]::DOUBLE[16] AS u FROM v, range(8) t(m)),
enc AS (SELECT vec_id, m, arg_min(code, {'d': array_distance(u, c), 'c': code}) AS code FROM parts JOIN book USING (m) GROUP BY vec_id, m),
dt AS (SELECT x.m, x.code AS code_a, y.code AS code_b, round(array_distance(x.c, y.c) ** 2) AS d2 FROM book x JOIN book y USING (m))
"""
WORDS = f"""
w0 AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS word, vec_id FROM v QUALIFY row_number() OVER (ORDER BY vec_id) <= {PQ_WORDS}),
wc0 AS (SELECT word, m, code FROM w0 JOIN enc USING (vec_id)),
wa0 AS (SELECT vec_id, arg_min(word, {{'d': d, 'w': word}}) AS word FROM (SELECT e.vec_id, w.word, sum(d2) AS d FROM enc e JOIN wc0 w USING (m) JOIN dt ON dt.m = e.m AND code_a = e.code AND code_b = w.code GROUP BY 1, 2) GROUP BY vec_id),
hist AS (SELECT word, m, code AS code_b, count(*) AS n FROM enc JOIN wa0 USING (vec_id) GROUP BY ALL),
wb AS (SELECT word, m, arg_min(code_a, {{'c': c, 'a': code_a}}) AS code FROM (SELECT word, m, code_a, sum(n * d2) AS c FROM hist JOIN dt USING (m, code_b) GROUP BY ALL) GROUP BY word, m),
wc1 AS (SELECT o.word, o.m, coalesce(n.code, o.code) AS code FROM wc0 o LEFT JOIN wb n USING (word, m))
"""
MATCHED = f"""
wanted AS (SELECT a, b FROM pairs_clean WHERE sim >= 0.045 AND sim < 0.35),
near AS (SELECT a, b, x.desc_id::BIGINT AS query_idx, y.desc_id::BIGINT AS train_idx, round(array_distance(x.q::DOUBLE[128], y.q::DOUBLE[128]) ** 2) AS d2
         FROM wanted JOIN v x ON x.image_name = a JOIN v y ON y.image_name = b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b, query_idx ORDER BY d2, train_idx) AS rq,
                  row_number() OVER (PARTITION BY a, b, train_idx ORDER BY d2, query_idx) AS rt FROM near),
mutual AS (SELECT a, b, query_idx, train_idx, d2 FROM ranked WHERE rq = 1 AND rt = 1)
"""
_DISTINCT_COUNTS = "own AS (SELECT image_name, count(*) AS n FROM (SELECT DISTINCT image_name, desc_id FROM descriptors WHERE image_name IS NOT NULL AND desc_id IS NOT NULL) GROUP BY image_name)"
_MAPPED = ", ".join(f"{r[0]!r}::DOUBLE * x.x::DOUBLE + {r[1]!r}::DOUBLE * x.y::DOUBLE + {r[2]!r}::DOUBLE AS {n}" for r, n in zip(MODEL, "uvw", strict=True))

ORACLE = {
    "bow_multiset": f"WITH {BAGS} SELECT image_name, len(words) AS n_words, {_JOINED} FROM bags",
    "bow_set": f"WITH {BAGS} SELECT image_name, len(words) AS n_words, {_JOINED} FROM sets",
    "distinct_sets": f"WITH {BAGS} SELECT image_name, n_images, {_JOINED} FROM distinct_sets",
    "set_membership": f"WITH {BAGS} SELECT s.image_name, d.image_name AS set_name FROM sets s JOIN distinct_sets d USING (words)",
    "name_normalise": f"SELECT DISTINCT a AS written, {_name('a')} AS image_name, replace(a, 'oxc1_', '') || '.jpg' AS jpg FROM pairs WHERE a IS NOT NULL",
    "descriptor_counts": f"WITH {_DISTINCT_COUNTS} SELECT image_name, n AS n_descriptors FROM own",
    "descriptor_totals": f"WITH {_DISTINCT_COUNTS} SELECT count(*) AS n_images, sum(n)::BIGINT AS n_descriptors, avg(n) AS mean_descriptors FROM own",
    "positional_assign": f"WITH {_DISTINCT_COUNTS}, ends AS (SELECT image_name, n, (sum(n) OVER (ORDER BY image_name))::BIGINT AS e FROM own) SELECT image_name, e - n AS first_row, e - 1 AS last_row, n AS n_rows FROM ends",
    "name_order_check": """WITH l AS (SELECT row_number() OVER (ORDER BY image_name) - 1 AS pos, image_name FROM (SELECT DISTINCT image_name FROM bow WHERE image_name IS NOT NULL)),
        r AS (SELECT row_number() OVER (ORDER BY image_name) - 1 AS pos, image_name FROM (SELECT DISTINCT image_name FROM descriptors WHERE image_name IS NOT NULL))
        SELECT coalesce(l.pos, r.pos) AS pos, l.image_name AS left_name, r.image_name AS right_name FROM l FULL OUTER JOIN r ON l.pos = r.pos WHERE l.image_name IS DISTINCT FROM r.image_name""",
    "rootsift_vector": f"""SELECT vec_id, round(list_sum(r), 6) AS total, round(r[1], 6) AS first, round(list_max(r), 6) AS largest
        FROM (SELECT vec_id, {_ROOT} AS r FROM (SELECT DISTINCT vec_id, descriptor FROM descriptors WHERE kind = 'sift' AND {_usable("descriptor")}))""",
    "rootsift_matrix": f"""WITH u AS (SELECT DISTINCT image_name, desc_id, descriptor FROM descriptors WHERE kind = 'sift' AND {_usable("descriptor")}),
        c AS (SELECT image_name, k, sum(abs(x::DOUBLE)) AS s FROM (SELECT image_name, unnest(descriptor) AS x, unnest(range(128)) AS k FROM u) GROUP BY 1, 2),
        t AS (SELECT image_name, max(s) + 1e-10 AS divisor FROM c GROUP BY 1)
        SELECT image_name, round(max(divisor), 6) AS divisor, count(*) AS n, round(max(sqrt(list_max(descriptor)::DOUBLE / divisor)), 6) AS largest FROM u JOIN t USING (image_name) GROUP BY image_name""",
    "idf_weights": f"WITH {BAGS} SELECT word, count(*) AS cnt, 1.0::DOUBLE / count(*) AS weight FROM (SELECT unnest(words) AS word FROM bags) GROUP BY word",
    "idf_weights_distinct": f"WITH {BAGS} SELECT word, count(*) AS cnt, 1.0::DOUBLE / count(*) AS weight FROM (SELECT unnest(words) AS word FROM sets) GROUP BY word",
    "unused_words": f"WITH {BAGS} SELECT w // 10000 AS block, count(*) AS n_unused FROM range({VOCABULARY}) t(w) WHERE w NOT IN (SELECT unnest(words) FROM bags) GROUP BY 1",
    "minhash_signature": f"WITH {BAGS}, {_signature(STEP, 'sets')} SELECT image_name, i, h FROM sig",
    "minhash_weighted": f"WITH {BAGS}, {_weighted_signature(FULL, 'sets')} SELECT image_name, i, h AS word FROM sig",
    "sketches": f"WITH {BAGS}, {_signature(FULL, 'sets')}, {_SKETCHES} SELECT image_name, k, s0, s1, s2 FROM sk",
    "sketch_bins": f"WITH {BAGS}, {_signature(FULL, 'sets')}, {_SKETCHES} SELECT k, s0, s1, s2, count(*) AS n_images, min(image_name) AS first_image FROM sk GROUP BY k, s0, s1, s2 HAVING count(*) > 1",
    "collision_clusters": f"WITH {BAGS}, {_signature(FULL, 'sets')}, {_SKETCHES} SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY k, s0, s1, s2) AS n_images FROM sk) WHERE n_images > 1",
    "seen_before": f"WITH {BAGS}, {_signature(FULL, 'sets')}, {_SKETCHES} SELECT image_name, bool_or(k > 1) AS seen FROM (SELECT image_name, row_number() OVER (PARTITION BY k, s0, s1, s2 ORDER BY image_name) AS k FROM sk) GROUP BY image_name",
    "collision_pairs": f"WITH {BAGS}, {_signature(FULL, 'distinct_sets')}, {_SKETCHES}, {_FOUND} SELECT a, b FROM found",
    "similar_pairs": f"WITH {BAGS}, {_signature(FULL, 'distinct_sets')}, {_SKETCHES}, {_FOUND} {_SCORED}",
    "weighted_similar_pairs": f"WITH {BAGS}, {_weighted_signature(FULL, 'distinct_sets')}, {_SKETCHES}, {_FOUND} {_SCORED}",
    "jaccard_allpairs": f"WITH {BAGS}, {_ALL} SELECT a, b, sim FROM alike WHERE sim >= 0.045",
    "pair_recall": f"""WITH {BAGS}, {_signature(FULL, 'distinct_sets')}, {_SKETCHES}, {_FOUND}, {_ALL}
        SELECT {_BAND} AS band, count(*) AS n_pairs, count(f.a) AS n_found FROM alike x LEFT JOIN found f ON f.a = x.a AND f.b = x.b WHERE sim >= 0.045 GROUP BY 1""",
    "cluster_first_images": f"""WITH {BAGS}, {_signature(FULL, 'sets')}, {_SKETCHES}
        SELECT k, s0, s1, s2, count(*) AS n_images, array_to_string(list(image_name ORDER BY image_name)[1:5], ',') AS images FROM sk GROUP BY k, s0, s1, s2 HAVING count(*) > 1""",
    "weighted_jaccard": f"""WITH {BAGS}, {PAIRS}, weight AS (SELECT word, 1 / count(*)::DOUBLE AS w FROM (SELECT unnest(words) AS word FROM bags) GROUP BY word),
        entry AS (SELECT image_name, word, w FROM (SELECT image_name, unnest(words) AS word FROM sets) JOIN weight USING (word)),
        own AS (SELECT image_name, sum(w) AS w FROM entry GROUP BY image_name),
        both_have AS (SELECT a, b, sum(x.w) AS s FROM pairs_clean JOIN entry x ON x.image_name = a JOIN entry y ON y.image_name = b AND y.word = x.word GROUP BY a, b)
        SELECT a, b, round(coalesce(s, 0) / (x.w + y.w - coalesce(s, 0)), 6) AS sim FROM pairs_clean JOIN own x ON x.image_name = a JOIN own y ON y.image_name = b LEFT JOIN both_have USING (a, b)""",
    "all_word_weights": f"""WITH {BAGS}, used AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM bags) GROUP BY word)
        SELECT w // 1000 AS block, sum(coalesce(cnt, 0))::BIGINT AS cnt, count(*) FILTER (cnt IS NULL) AS n_unused, min(coalesce(1 / cnt::DOUBLE, {UNUSED_WEIGHT}::DOUBLE)) AS least, max(coalesce(1 / cnt::DOUBLE, {UNUSED_WEIGHT}::DOUBLE)) AS most
        FROM range({VOCABULARY}) t(w) LEFT JOIN used ON word = w GROUP BY 1""",
    "jaccard_of_pairs": f"""WITH {BAGS}, {PAIRS} SELECT a, b, sim, len(list_intersect(x.words, y.words)) / len(list_distinct(list_concat(x.words, y.words)))::DOUBLE AS jaccard
        FROM pairs_clean JOIN sets x ON x.image_name = a JOIN sets y ON y.image_name = b""",
    "pair_bands": f"WITH {PAIRS} SELECT a, b, sim, {_BAND} AS band FROM pairs_clean",
    "pair_band_counts": f"WITH {PAIRS} SELECT count(*) FILTER (sim < 0.045) AS n_irr, count(*) FILTER (sim >= 0.045 AND sim < 0.35) AS n_sim, count(*) FILTER (sim >= 0.35) AS n_dup, count(*) AS n_pairs FROM pairs_clean",
    "pairs_in_band": f"WITH {PAIRS} SELECT a, b, sim FROM pairs_clean WHERE sim >= 0.045 AND sim < 0.35 ORDER BY sim DESC, a, b",
    "top_pairs_asc": f"WITH {PAIRS} SELECT a, b, sim FROM pairs_clean ORDER BY sim, a, b LIMIT 5",
    "band_sample": f"WITH {PAIRS} SELECT a, b, sim FROM pairs_clean WHERE sim >= 0.35 ORDER BY md5(a || '|' || b || '|0'), a, b LIMIT 100",
    "top_verified": f"WITH {VERIFIED} SELECT a, b, sim, n_inliers FROM verified_clean ORDER BY n_inliers DESC, a, b LIMIT 5",
    "verified_sorted": f"WITH {VERIFIED} SELECT a, b, sim, n_inliers FROM verified_clean ORDER BY n_inliers DESC, a, b",
    "verified_page": f"WITH {VERIFIED} SELECT a, b, sim, n_inliers FROM verified_clean ORDER BY n_inliers, a, b LIMIT 10 OFFSET 10",
    "verified_min_inliers": f"WITH {VERIFIED} SELECT a, b, sim, n_inliers FROM verified_clean WHERE n_inliers >= 50",
    "nearest_center": f"""WITH {VECTORS}, c AS (SELECT cid, min(list_transform(center, lambda z: floor(z * {STEPS})::INTEGER))::DOUBLE[128] AS c FROM centers WHERE cid IS NOT NULL AND {_usable("center")} GROUP BY cid),
        n AS (SELECT vec_id, min({{'d': array_distance(q, c), 'c': cid}}) AS m FROM p, c GROUP BY vec_id) SELECT vec_id, m.c AS cid, round(m.d ** 2) AS d2 FROM n""",
    "nearest_center_float": f"""WITH r AS (SELECT vec_id, min(r)::DOUBLE[128] AS q FROM (SELECT vec_id, CASE WHEN kind = 'sift' THEN {_ROOT} ELSE list_transform(descriptor, lambda z: z::DOUBLE) END AS r
          FROM descriptors WHERE vec_id IS NOT NULL AND {_usable("descriptor")}) GROUP BY vec_id),
        c AS (SELECT cid, min(center)::DOUBLE[128] AS c FROM centers WHERE cid IS NOT NULL AND {_usable("center")} GROUP BY cid),
        n AS (SELECT vec_id, min({{'d': array_distance(q, c), 'c': cid}}) AS m FROM r, c GROUP BY vec_id) SELECT vec_id, m.c AS cid, round(m.d, 4) AS dist FROM n""",
    "kmeans_step": f"WITH {VECTORS}, {_kmeans(0)} {_center_rows('c1')}",
    "kmeans_3iter": f"WITH {VECTORS}, {_kmeans(2)} {_center_rows('c3')}",
    "kmeans_unchanged": f"WITH {VECTORS}, {_kmeans(2)} SELECT count(*) FILTER (x.cid = y.cid) AS n_unchanged, count(*) AS n_points FROM a1 x JOIN a2 y USING (vec_id)",
    "codebook_sample": f"WITH {VECTORS}, {SAMPLED} SELECT vec_id FROM sampled",
    "pq_train": f"WITH {VECTORS}, {SAMPLED}, {_codebook()} SELECT m, code, unnest(range(16))::INTEGER AS k, unnest(c::DOUBLE[]) AS x FROM book",
    "pq_encode": f"WITH {VECTORS}, {SAMPLED}, {_codebook()}, {ENCODED} SELECT vec_id, array_to_string(list(code ORDER BY m), ',') AS pq FROM enc GROUP BY vec_id",
    "pq_distance_table": f"WITH {VECTORS}, {SAMPLED}, {_codebook()}, {ENCODED} SELECT m, code_a, code_b, d2 FROM dt",
    "pqkmeans_iter": f"WITH {VECTORS}, {SAMPLED}, {_codebook()}, {ENCODED}, {WORDS} SELECT word, array_to_string(list(code ORDER BY m), ',') AS pq FROM wc1 GROUP BY word",
    "pq_assign_bow": f"""WITH {VECTORS}, {SAMPLED}, {_codebook()}, {ENCODED}, {WORDS},
        wa1 AS (SELECT vec_id, arg_min(word, {{'d': d, 'w': word}}) AS word FROM (SELECT e.vec_id, w.word, sum(d2) AS d FROM enc e JOIN wc1 w USING (m) JOIN dt ON dt.m = e.m AND code_a = e.code AND code_b = w.code GROUP BY 1, 2) GROUP BY vec_id)
        SELECT image_name, count(*) AS n_words, array_to_string(list(word ORDER BY word), ',') AS words FROM (SELECT DISTINCT image_name, word FROM wa1 JOIN v USING (vec_id)) GROUP BY image_name""",
    "mutual_nn_matches": f"WITH {VECTORS}, {PAIRS}, {MATCHED} SELECT a, b, query_idx, train_idx, d2 FROM mutual",
    "matches_by_distance": f"WITH {VECTORS}, {PAIRS}, {MATCHED} SELECT a, b, query_idx, train_idx, d2, row_number() OVER (PARTITION BY a, b ORDER BY d2, query_idx, train_idx)::INTEGER AS rank FROM mutual",
    "ratio_test_matches": f"""WITH {VECTORS}, {PAIRS}, {MATCHED} SELECT x.a, x.b, x.query_idx, x.train_idx, x.d2
        FROM ranked x JOIN ranked y ON x.a = y.a AND x.b = y.b AND x.query_idx = y.query_idx AND x.rq = 1 AND y.rq = 2 WHERE 100 * x.d2 < 49 * y.d2""",
    "known_model_inliers": f"""WITH {VECTORS}, {PAIRS}, {MATCHED}, mapped AS (SELECT a, b, {_MAPPED}, y.x::DOUBLE AS tx, y.y::DOUBLE AS ty FROM mutual
          JOIN v x ON x.image_name = a AND x.desc_id = query_idx JOIN v y ON y.image_name = b AND y.desc_id = train_idx WHERE isfinite(x.x) AND isfinite(x.y) AND isfinite(y.x) AND isfinite(y.y))
        SELECT a, b, count(*) AS n_matches, count(*) FILTER ((u / w - tx) * (u / w - tx) + (v / w - ty) * (v / w - ty) <= 40000) AS n_inliers FROM mapped GROUP BY a, b""",
    "resize_dims": """SELECT w, h, CASE WHEN w > h THEN 1200 ELSE round_even(w * 1200 / h::DOUBLE, 0)::INTEGER END AS new_w, CASE WHEN w > h THEN round_even(h * 1200 / w::DOUBLE, 0)::INTEGER ELSE 1200 END AS new_h
        FROM (SELECT DISTINCT greatest(floor(x)::INTEGER + 1, 1) AS w, greatest(floor(y)::INTEGER + 1, 1) AS h FROM descriptors WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y))""",
}
