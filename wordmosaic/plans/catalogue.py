"""Queries of the core operators over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmosaic.functions import names, vectors
from wordmosaic.operators import bow, centers, collisions, geometry, kmeans, matching, minhash, positions, pq, similarity
from wordmosaic.plans import pipeline
from wordmosaic.plans.config import VocabularyConfig
from wordmosaic.session import shared_dir, written
from wordmosaic.sources.tables import quantised_centers, read
from wordmosaic.streaming.sketch_index import SketchIndex

#: The full sketch sizes, and a smaller family for the one query whose rows are all hash values.
FULL = minhash.HashFamily(512, 512, 3, seed=0)
STEP = minhash.HashFamily(64, 32, 3, seed=0)
VOCABULARY = 1_000_000
KMEANS_K, PQ_CODES, PQ_ITERS, PQ_WORDS, SAMPLE = 16, 16, 2, 32, 1_000
#: The vocabulary that is learned at full size: codes, training sample and rounds as by default, words for tables of this size.
LEARNED = VocabularyConfig(vocab_size=4_096)
MODEL = [[1.0, 0.0, 13.0], [0.0, 1.0, -7.0], [0.0, 0.0, 1.0]]


def _joined(c: str | Column) -> Column:
    return F.array_join((F.col(c) if isinstance(c, str) else c).cast("array<string>"), ",")


def _multiset(s: SparkSession, d: str) -> DataFrame:
    return bow.bow_multiset(read(s, d, "bow"), VOCABULARY)


def _sets(s: SparkSession, d: str) -> DataFrame:
    return bow.bow_set(read(s, d, "bow"), VOCABULARY)


def _distinct(s: SparkSession, d: str) -> DataFrame:
    return bow.distinct_sets(read(s, d, "bow"), VOCABULARY)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return similarity.clean_pairs(read(s, d, "pairs"))


def _verified(s: SparkSession, d: str) -> DataFrame:
    return similarity.clean_verified(read(s, d, "verified"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return vectors.quantised(read(s, d, "descriptors"))


def _points(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select(F.col("vec_id").alias("id"), F.col("q").alias("v"))


def _center_rows(c: DataFrame) -> DataFrame:
    return c.select("cid", F.posexplode("center").alias("k", "x")).select("cid", "k", F.col("x").cast("double").alias("x"))


def _keypoints(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("image_name", F.col("desc_id").cast("long").alias("idx"), F.col("q").alias("v"), "x", "y")


def bow_multiset(s, d):
    return _multiset(s, d).select("image_name", F.size("words").cast("long").alias("n_words"), _joined("words").alias("words"))


def bow_set(s, d):
    return _sets(s, d).select("image_name", F.size("words").cast("long").alias("n_words"), _joined("words").alias("words"))


def distinct_sets(s, d):
    return _distinct(s, d).select("image_name", "n_images", _joined("words").alias("words"))


def set_membership(s, d):
    return bow.set_membership(read(s, d, "bow"), VOCABULARY)


def name_normalise(s, d):
    a = read(s, d, "pairs").select(F.col("a").alias("written")).filter("written is not null").distinct()
    return a.select("written", names.image_name(F.col("written")).alias("image_name"), names.as_jpg(F.col("written")).alias("jpg"))


def descriptor_counts(s, d):
    return bow.descriptor_counts(read(s, d, "descriptors"))


def descriptor_totals(s, d):
    return bow.descriptor_totals(read(s, d, "descriptors"))


def positional_assign(s, d):
    owners = bow.descriptor_counts(read(s, d, "descriptors")).withColumnRenamed("n_descriptors", "count")
    owners = written(positions.running_offsets(owners, "image_name", "count"), "owners")
    n = owners.agg(F.sum("count")).first()[0] or 0
    placed = positions.positional_assign(s.range(n).withColumnRenamed("id", "row"), owners)
    return placed.groupBy("image_name").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count(F.lit(1)).alias("n_rows"))


def name_order_check(s, d):
    def order(name: str) -> DataFrame:
        images = read(s, d, name).select("image_name").filter("image_name is not null").distinct().withColumn("one", F.lit(1).cast("long"))
        return positions.running_offsets(images, "image_name", "one").select(F.col("start").alias("pos"), F.col("image_name").alias("name"))

    return positions.order_mismatches(order("bow"), order("descriptors"))


def rootsift_vector(s, d):
    v = read(s, d, "descriptors").filter(vectors.is_usable(F.col("descriptor")) & (F.col("kind") == "sift")).select("vec_id", "descriptor").distinct()
    root = vectors.root_vector(F.col("descriptor"))
    return v.select("vec_id", F.round(vectors.total(root), 6).alias("total"), F.round(root[0], 6).alias("first"), F.round(F.array_max(root), 6).alias("largest"))


def rootsift_matrix(s, d):
    rows = vectors.root_matrix(read(s, d, "descriptors").filter("kind = 'sift'").select("image_name", "desc_id", "descriptor").distinct())
    return rows.groupBy("image_name").agg(F.round(F.max("divisor"), 6).alias("divisor"), F.count(F.lit(1)).alias("n"), F.round(F.max(F.array_max("descriptor")), 6).alias("largest"))


def idf_weights(s, d):
    return bow.word_weights(_multiset(s, d))


def idf_weights_distinct(s, d):
    return bow.word_weights(_multiset(s, d), distinct=True)


def all_word_weights(s, d):
    found = bow.all_word_weights(_multiset(s, d), VOCABULARY)
    return found.groupBy(F.floor(F.col("word") / 1_000).alias("block")).agg(F.sum("cnt").alias("cnt"), F.count_if(F.col("cnt") == 0).alias("n_unused"), F.min("weight").alias("least"), F.max("weight").alias("most"))


def unused_words(s, d):
    return bow.unused_words(_multiset(s, d), VOCABULARY).groupBy(F.floor(F.col("word") / 10_000).alias("block")).agg(F.count(F.lit(1)).alias("n_unused"))


def minhash_signature(s, d):
    return minhash.signatures(_sets(s, d), STEP).select("image_name", F.posexplode("signature").alias("i", "h"))


def minhash_weighted(s, d):
    bags = _multiset(s, d)
    return minhash.weighted_signatures(bags, bow.word_weights(bags), FULL).select("image_name", F.posexplode("signature").alias("i", "word"))


def sketches(s, d):
    return minhash.sketches(minhash.signatures(_sets(s, d), FULL), FULL)


def sketch_bins(s, d):
    return collisions.sketch_bins(sketches(s, d))


def collision_clusters(s, d):
    return collisions.collision_clusters(written(sketches(s, d), "sketches"))


def seen_before(s, d):
    return collisions.images_seen_before(_sets(s, d), FULL)


def collision_pairs(s, d):
    return collisions.similar_pairs(_distinct(s, d), FULL).select("a", "b")


def similar_pairs(s, d):
    return collisions.similar_pairs(_distinct(s, d), FULL)


def weighted_similar_pairs(s, d):
    return collisions.similar_pairs(_distinct(s, d), FULL, bow.word_weights(_multiset(s, d)))


def jaccard_allpairs(s, d):
    return similarity.all_pairs(_distinct(s, d))


def pair_recall(s, d):
    bags = written(_distinct(s, d), "sets")
    return similarity.bands_found(bags, collisions.similar_pairs(bags, FULL))


def cluster_first_images(s, d):
    return collisions.first_images(written(sketches(s, d), "sketches"))


def weighted_jaccard(s, d):
    found = similarity.weighted_jaccard(_pairs(s, d).join(_sets(s, d).select(F.col("image_name").alias("a")), "a", "left_semi").join(_sets(s, d).select(F.col("image_name").alias("b")), "b", "left_semi"), _sets(s, d), bow.word_weights(_multiset(s, d)))
    return found.select("a", "b", F.round("sim", 6).alias("sim"))


def jaccard_of_pairs(s, d):
    return similarity.jaccard_of_pairs(_pairs(s, d), _sets(s, d))


def pair_bands(s, d):
    return _pairs(s, d).withColumn("band", similarity.band(F.col("sim")))


def pair_band_counts(s, d):
    return similarity.band_counts(_pairs(s, d))


def pairs_in_band(s, d):
    return similarity.in_band(_pairs(s, d)).orderBy(F.desc("sim"), "a", "b")


def top_pairs_asc(s, d):
    return similarity.lowest(_pairs(s, d))


def band_sample(s, d):
    return similarity.sampled(_pairs(s, d).filter(similarity.band(F.col("sim")) == "dup"), 100)


def top_verified(s, d):
    return similarity.most_inliers(_verified(s, d))


def verified_sorted(s, d):
    return _verified(s, d).orderBy(F.desc("n_inliers"), "a", "b")


def verified_page(s, d):
    return similarity.page(_verified(s, d))


def verified_min_inliers(s, d):
    return _verified(s, d).filter("n_inliers >= 50")


def nearest_center(s, d):
    found = centers.nearest_center(_points(s, d), quantised_centers(read(s, d, "centers")))
    return found.select(F.col("id").alias("vec_id"), "cid", "d2")


def nearest_center_float(s, d):
    points = vectors.root_form(read(s, d, "descriptors")).select(F.col("vec_id").alias("id"), "v")
    whole = read(s, d, "centers").filter(vectors.is_usable(F.col("center")) & F.col("cid").isNotNull()).groupBy("cid").agg(F.min("center").alias("center"))
    found = centers.nearest_center(points, whole)
    return found.select(F.col("id").alias("vec_id"), "cid", F.round(F.sqrt("d2"), 4).alias("dist"))


def ann_recall(s, d):
    return centers.ann_recall(_points(s, d), quantised_centers(read(s, d, "centers")))


def ann_center(s, d):
    found = centers.approximate_nearest_center(_points(s, d), quantised_centers(read(s, d, "centers")))
    return found.select(F.col("id").alias("vec_id"), "cid", "d2")


def _first_steps(s, d, n: int) -> list[DataFrame]:
    points = written(_points(s, d), "points")
    steps = [kmeans.first_centers(points, KMEANS_K)]
    for _ in range(n):
        steps.append(kmeans.step(points, steps[-1], truncate=True)[0])
    return [points, *steps]


def kmeans_step(s, d):
    return _center_rows(_first_steps(s, d, 1)[-1])


def kmeans_3iter(s, d):
    points = written(_points(s, d), "points")
    return _center_rows(kmeans.kmeans(points, kmeans.first_centers(points, KMEANS_K), 3, truncate=True)[0])


def kmeans_unchanged(s, d):
    points, _, one, two = _first_steps(s, d, 2)
    return kmeans.unchanged(points, one, two)


def codebook_sample(s, d):
    return pq.training_sample(_points(s, d), SAMPLE).select(F.col("id").alias("vec_id"))


def _book(s, d) -> DataFrame:
    return written(pq.train_codebook(pq.training_sample(_points(s, d), SAMPLE), 8, PQ_CODES, PQ_ITERS), "codebook")


def pq_train(s, d):
    return _book(s, d).select("m", "code", F.posexplode("subvector").alias("k", "x"))


def pq_encode(s, d):
    return pq.encode(_points(s, d), _book(s, d)).select(F.col("id").alias("vec_id"), _joined("pq").alias("pq"))


def pq_distance_table(s, d):
    return pq.distance_table_rows(_book(s, d))


def _code_model(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    book = _book(s, d)
    codes = written(pq.encode(_points(s, d), book), "codes")
    return book, codes, pq.code_kmeans(codes, PQ_WORDS, book, 1)


def pqkmeans_iter(s, d):
    return _code_model(s, d)[2].select("word", _joined("pq").alias("pq"))


def pq_assign_bow(s, d):
    book, codes, vocab = _code_model(s, d)
    owners = _vectors(s, d).select(F.col("vec_id").alias("id"), "image_name")
    bags = pq.bags_from_codes(codes, owners, vocab, book)
    return bags.select("image_name", F.size("words").cast("long").alias("n_words"), _joined("words").alias("words"))


def _matched(s, d, method: str) -> DataFrame:
    return matching.matches(similarity.in_band(_pairs(s, d)), _keypoints(s, d), method)


def mutual_nn_matches(s, d):
    return _matched(s, d, "brute_force")


def matches_by_distance(s, d):
    return matching.by_distance(_matched(s, d, "brute_force"))


def ratio_test_matches(s, d):
    return _matched(s, d, "ratio")


def known_model_inliers(s, d):
    return geometry.model_inliers(_matched(s, d, "brute_force"), _keypoints(s, d), MODEL, 200.0)


def ransac_verify(s, d):
    return geometry.verify(similarity.in_band(_pairs(s, d)), _matched(s, d, "brute_force"), _keypoints(s, d))


def ransac_affine_top(s, d):
    found = geometry.verify(similarity.in_band(_pairs(s, d)), _matched(s, d, "brute_force"), _keypoints(s, d), "affine", 20.0)
    return similarity.most_inliers(found, 10)


def resize_dims(s, d):
    side = lambda c: F.greatest(F.floor(F.col(c)).cast("int") + 1, F.lit(1))
    sizes = read(s, d, "descriptors").filter("x is not null and y is not null and not isnan(x) and not isnan(y)").select(side("x").alias("w"), side("y").alias("h")).distinct()
    return geometry.resize_dims(sizes)


def vocabulary_bags(s, d):
    points = _vectors(s, d).select(F.col("vec_id").alias("id"), "image_name", F.col("q").alias("v"))
    made = pipeline.vocabulary(points, f"{shared_dir(s)}/vocabulary-{uuid.uuid4().hex}", LEARNED)
    return pipeline.bags_from_vocabulary(points, made["vocab"], made["codebook"])


def seen_before_stream(s, d):
    folder = f"{shared_dir(s)}/index-{uuid.uuid4().hex}"
    source = read(s, d, "bow")
    stream = s.readStream.schema(source.schema).parquet(f"{d}/bow.parquet*")
    bags = stream.select("image_name", F.array_distinct(bow.valid(F.col("words"), VOCABULARY)).alias("words")).filter("image_name is not null and size(words) > 0")
    index = SketchIndex(folder, FULL)
    index.start(bags, f"{folder}/checkpoint").awaitTermination()
    return index.seen(s).select("image_name", "seen", F.col("batch").cast("long").alias("batch"))


_STEPS = (
    bow_multiset, bow_set, distinct_sets, set_membership, name_normalise, descriptor_counts, descriptor_totals, positional_assign, name_order_check,
    rootsift_vector, rootsift_matrix, idf_weights, idf_weights_distinct, all_word_weights, unused_words, minhash_signature, minhash_weighted, sketches, sketch_bins,
    collision_clusters, seen_before, collision_pairs, similar_pairs, weighted_similar_pairs, jaccard_allpairs, pair_recall, jaccard_of_pairs, weighted_jaccard, cluster_first_images, pair_bands, pair_band_counts,
    pairs_in_band, top_pairs_asc, band_sample, top_verified, verified_sorted, verified_page, verified_min_inliers, nearest_center, nearest_center_float, ann_center, ann_recall,
    kmeans_step, kmeans_3iter, kmeans_unchanged, codebook_sample, pq_train, pq_encode, pq_distance_table, pqkmeans_iter, pq_assign_bow,
    mutual_nn_matches, matches_by_distance, ratio_test_matches, known_model_inliers, ransac_verify, ransac_affine_top, resize_dims, vocabulary_bags, seen_before_stream,
)
QUERIES = {f.__name__: f for f in _STEPS}
