"""Queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from wordmosaic.llm import clusters, groups, mixing, neardup, neighbours, setjoin, subjects, termcount, tokenize

QUERIES = {
    "p1_found": groups.p1_found,
    "p1_group_sizes": groups.p1_group_sizes,
    "p2_found": clusters.p2_found,
    "p2_typical_members": clusters.p2_typical_members,
    "p3_found": termcount.p3_found,
    "p3_words": termcount.p3_words,
    "p3_sequences": termcount.p3_sequences,
    "p4_found": neighbours.p4_found,
    "p5_found": setjoin.p5_found,
    "p5_classes": setjoin.p5_classes,
    "p6_found": neardup.p6_found,
    "p7_ids": tokenize.p7_ids,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": subjects.p9_found,
    "p9_composition": subjects.p9_composition,
}

_NAME = "regexp_replace(regexp_replace({c}, '(\\.jpg\\.hesaff\\.sift|\\.txt|\\.jpg)$', ''), '^oxc1_', '')"

_LINKS = f"""
links AS (
  SELECT {_NAME.format(c="a")} AS a, {_NAME.format(c="b")} AS b FROM pairs
  WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(sim) AND sim >= 0.35 AND sim <= 1
  UNION ALL
  SELECT {_NAME.format(c="a")}, {_NAME.format(c="b")} FROM verified
  WHERE a IS NOT NULL AND b IS NOT NULL AND n_inliers >= 50
),
edges AS (SELECT DISTINCT a, b FROM links WHERE a <> b UNION SELECT DISTINCT b, a FROM links WHERE a <> b),
reach AS (
  SELECT a AS node, least(a, min(b)) AS label FROM edges GROUP BY a
  UNION
  SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.node WHERE r.label < e.b
),
groups AS (SELECT node AS image_name, min(label) AS group_name FROM reach GROUP BY node)
"""

_BAGS = """
names AS (SELECT count(DISTINCT image_name) AS n FROM bow),
bags AS (
  SELECT image_name, list_sort(list_filter(words, lambda w: w IS NOT NULL AND w >= 0 AND w < 1000000)) AS words
  FROM (SELECT image_name, words, row_number() OVER (
          PARTITION BY image_name
          ORDER BY len(list_filter(words, lambda w: w IS NOT NULL AND w >= 0 AND w < 1000000)) DESC NULLS LAST,
                   list_sort(words)) AS k
        FROM bow WHERE image_name IS NOT NULL) WHERE k = 1
)
"""

_COUNTS = """
counts AS (SELECT word, count(*) AS occurrences, count(DISTINCT image_name) AS images
           FROM (SELECT image_name, unnest(words) AS word FROM bags) GROUP BY word)
"""

_SETS = """
sets AS (SELECT image_name, list_distinct(words) AS w, true AS main FROM bags WHERE len(words) > 0
         UNION ALL
         SELECT image_name, list_distinct(list_filter(words, lambda w: w IS NOT NULL AND w >= 0 AND w < 1000000)), false
         FROM ref_bow WHERE len(words) > 0)
"""

_VECTORS = """
usable AS (
  SELECT 0 AS t, vec_id AS id, CASE WHEN kind = 'sift' THEN list_transform(v, lambda x: sqrt(x / (list_sum(v) + 1e-10))) ELSE v END AS v
  FROM (SELECT vec_id, kind, list_transform(descriptor, lambda x: x::DOUBLE) AS v FROM descriptors WHERE vec_id IS NOT NULL)
  UNION ALL SELECT 1, cid, center FROM centers WHERE cid IS NOT NULL
),
items AS (
  SELECT CASE t WHEN 0 THEN 'descriptors' ELSE 'centers' END AS tbl, id::BIGINT AS id, min(v)::DOUBLE[128] AS v
  FROM (SELECT * FROM usable WHERE len(v) = 128)
  WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
  GROUP BY t, id
),
near AS (
  SELECT a.tbl, a.id AS a, b.id AS b, array_distance(a.v, b.v) AS dist
  FROM items a JOIN items b ON a.tbl = b.tbl AND a.id < b.id WHERE array_distance(a.v, b.v) < 0.4
),
ends AS (SELECT tbl, a AS item, b AS other, dist FROM near UNION ALL SELECT tbl, b, a, dist FROM near)
"""

ORACLE = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT image_name, group_name FROM groups",
    "p1_group_sizes": f"WITH RECURSIVE {_LINKS} SELECT group_name, count(*) AS n_images FROM groups GROUP BY group_name",
    "p3_found": f"""WITH {_BAGS}, {_COUNTS}
        SELECT word, 'rare' AS mark FROM counts WHERE occurrences <= 3
        UNION ALL SELECT word, 'common' FROM counts, names WHERE images > 0.05 * n""",
    "p3_words": f"""WITH {_BAGS}, {_COUNTS}
        SELECT word, occurrences, images,
               concat_ws('+', CASE WHEN occurrences <= 3 THEN 'rare' END, CASE WHEN images > 0.05 * n THEN 'common' END) AS mark
        FROM counts, names""",
    "p3_sequences": f"""WITH {_BAGS},
        steps AS (SELECT image_name, words, unnest(range(1, len(words))) AS i FROM bags WHERE len(words) > 1)
        SELECT words[i] AS word_1, words[i + 1] AS word_2, count(*) AS occurrences, count(DISTINCT image_name) AS images
        FROM steps GROUP BY ALL""",
    "p2_found": f"""WITH {_VECTORS},
        sets AS (SELECT tbl, item, list_sort(list_append(list(other), item)) AS members FROM ends GROUP BY tbl, item),
        cliques AS (SELECT tbl, members FROM sets GROUP BY tbl, members HAVING count(*) = len(members) AND len(members) >= 5)
        SELECT tbl, item AS item_id, members[1] AS cluster_id FROM sets JOIN cliques USING (tbl, members)""",
    "p4_found": f"""WITH {_VECTORS},
        best AS (SELECT *, row_number() OVER (PARTITION BY tbl, item ORDER BY dist, other) AS k FROM ends)
        SELECT DISTINCT tbl, least(item, other) AS id_a, greatest(item, other) AS id_b FROM best WHERE k <= 5 AND dist <= 0.10""",
    "p5_found": f"""WITH {_BAGS}, {_SETS},
        posting AS (SELECT image_name, main, len(w) AS n, unnest(w) AS word FROM sets),
        met AS (SELECT x.image_name AS name_a, y.image_name AS name_b, count(*) AS c, any_value(x.n + y.n) AS n
                FROM posting x JOIN posting y ON x.word = y.word AND x.image_name < y.image_name AND (x.main OR y.main)
                GROUP BY x.image_name, y.image_name)
        SELECT name_a, name_b FROM met WHERE c >= 0.5 * (n - c)""",
    "p5_classes": f"""WITH {_BAGS}, {_SETS},
        classes AS (SELECT list_sort(w) AS w, min(image_name) AS class_name, count(*) AS copies, bool_or(main) AS main FROM sets GROUP BY list_sort(w)),
        posting AS (SELECT class_name, main, len(w) AS n, unnest(w) AS word FROM classes),
        met AS (SELECT x.class_name AS a, y.class_name AS b, count(*) AS c, any_value(x.n + y.n) AS n
                FROM posting x JOIN posting y ON x.word = y.word AND x.class_name <> y.class_name AND (x.main OR y.main)
                GROUP BY x.class_name, y.class_name),
        ends AS (SELECT a AS class_name, count(*) AS links FROM met WHERE c >= 0.5 * (n - c) GROUP BY a)
        SELECT image_name, c.class_name, copies, coalesce(links, 0) AS links
        FROM sets s JOIN classes c ON list_sort(s.w) = c.w LEFT JOIN ends e ON e.class_name = c.class_name""",
    "p6_found": f"""WITH RECURSIVE {_BAGS},
        sets AS (SELECT image_name, list_distinct(words) AS w FROM bags WHERE len(words) > 0),
        posting AS (SELECT image_name, len(w) AS n, unnest(w) AS word FROM sets),
        met AS (SELECT x.image_name AS a, y.image_name AS b, count(*) AS c, any_value(x.n + y.n) AS n
                FROM posting x JOIN posting y ON x.word = y.word AND x.image_name < y.image_name GROUP BY x.image_name, y.image_name),
        links AS (
          SELECT a, b FROM met WHERE c >= 0.8 * (n - c)
          UNION ALL SELECT {_NAME.format(c="a")}, {_NAME.format(c="b")} FROM pairs
          WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(sim) AND sim >= 0.8 AND sim <= 1),
        edges AS (SELECT DISTINCT a, b FROM links WHERE a <> b UNION SELECT DISTINCT b, a FROM links WHERE a <> b),
        reach AS (
          SELECT a AS node, least(a, min(b)) AS label FROM edges GROUP BY a
          UNION
          SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.node WHERE r.label < e.b)
        SELECT node AS image_name, min(label) AS group_name FROM reach GROUP BY node""",
}
