"""The three pipelines: similar pairs, vocabulary, bags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmosaic.operators import bow as bags
from wordmosaic.operators import geometry, matching, pq
from wordmosaic.operators.centers import nearest_center
from wordmosaic.operators.collisions import similar_pairs
from wordmosaic.operators.kmeans import first_centers, kmeans
from wordmosaic.operators.minhash import HashFamily
from wordmosaic.operators.similarity import band_counts, in_band, lowest, most_inliers
from wordmosaic.plans.config import PairConfig, VocabularyConfig, arguments, config_hash, read_config
from wordmosaic.plans.stages import stage
from wordmosaic.session import shipped
from wordmosaic.sources.files import word_bags


def similarity_estimation(words: DataFrame, config: PairConfig = PairConfig()) -> DataFrame:  # noqa: B008
    """``(a, b, sim)``: weights, weighted sketches, collisions, exact similarity."""
    clean = bags.bow_multiset(words, config.vocab_size)
    family = HashFamily(config.hash_num, config.sketch_num, config.sketch_size, config.seed)
    return similar_pairs(clean, family, bags.word_weights(clean) if config.weighted else None)


def seed_pairs(spark: SparkSession, folder: str, out: str, config: PairConfig = PairConfig()) -> dict[str, DataFrame]:  # noqa: B008
    """Similar pairs and their verification, each stage written under ``out`` and reused for the same settings.

    ``folder`` has ``bow`` and ``descriptors`` (``vec_id`` as the unique number of a descriptor).
    """
    key = config_hash(config)
    pairs = stage(spark, out, "pairs", key, lambda: similarity_estimation(spark.read.parquet(f"{folder}/bow.parquet"), config))

    def verified() -> DataFrame:
        from wordmosaic.functions.vectors import quantised

        d = quantised(spark.read.parquet(f"{folder}/descriptors.parquet"))
        d = d.select("image_name", F.col("desc_id").cast("long").alias("idx"), F.col("q").alias("v"), "x", "y").dropDuplicates(["image_name", "idx"])
        wanted = in_band(pairs, config.min_similarity, config.max_similarity)
        found = matching.matches(wanted, d, config.matcher)
        return geometry.verify(wanted, found, d, config.ransac_model, config.ransac_threshold, config.ransac_max_trials, config.seed, config.threshold_min_inlier)

    result = stage(spark, out, "verified", key, verified)
    return {"pairs": pairs, "verified": result, "bands": band_counts(pairs, config.min_similarity, config.max_similarity), "lowest": lowest(pairs), "most_inliers": most_inliers(result)}


def vocabulary(points: DataFrame, out: str, config: VocabularyConfig = VocabularyConfig()) -> dict[str, DataFrame]:  # noqa: B008
    """Codebook, codes and vocabulary of ``points (id, v)``; with ``kmeans`` centres in the vectors' own space."""
    spark, key = points.sparkSession, config_hash(config)
    if config.clustering_lib == "kmeans":
        return {"centers": stage(spark, out, "centers", key, lambda: kmeans(points, first_centers(points, config.vocab_size), config.iterations)[0])}
    book = stage(spark, out, "codebook", key, lambda: pq.train_codebook(pq.training_sample(points, config.pq_train_size, config.seed), config.pq_subspaces, config.pq_codes, config.pq_train_iters))
    codes = stage(spark, out, "codes", key, lambda: pq.encode(points, book))
    vocab = stage(spark, out, "vocab", key, lambda: pq.code_kmeans(codes, config.vocab_size, book, config.iterations))
    return {"codebook": book, "codes": codes, "vocab": vocab}


def bags_from_vocabulary(points: DataFrame, vocab: DataFrame, codebook: DataFrame) -> DataFrame:
    """``(image_name, words)`` of ``points (id, image_name, v)`` by a learned vocabulary."""
    return pq.bags_from_codes(pq.encode(points, codebook), points, vocab, codebook)


def learned_bags(spark: SparkSession, folder: str, out: str, config: VocabularyConfig = VocabularyConfig()) -> dict[str, DataFrame]:  # noqa: B008
    """A vocabulary learned from ``descriptors`` in ``folder``, and the bags of its images by it, each stage written under ``out``."""
    from wordmosaic.functions.vectors import quantised

    d = quantised(spark.read.parquet(f"{folder}/descriptors.parquet"))
    points = d.select(F.col("vec_id").alias("id"), "image_name", F.col("q").alias("v"))
    made = vocabulary(points, out, config)
    key = config_hash(config)
    if "centers" in made:
        words = nearest_center(points, made["centers"]).join(points.select("id", "image_name"), "id").select("image_name", F.col("cid").alias("word")).distinct()
        bag = stage(spark, out, "bow", key, lambda: words.groupBy("image_name").agg(F.array_sort(F.collect_list("word")).alias("words")))
    else:
        bag = stage(spark, out, "bow", key, lambda: bags_from_vocabulary(points, made["vocab"], made["codebook"]))
    return {**made, "bow": bag}


def filed_bags(spark: SparkSession, folder: str, out: str, config: PairConfig = PairConfig()) -> dict[str, DataFrame]:  # noqa: B008
    """Bags of the word files in ``folder`` and the weights of their words, written under ``out``."""
    key = config_hash(config)
    bag = stage(spark, out, "bow", key, lambda: word_bags(spark, folder))
    weights = stage(spark, out, "word_weights", key, lambda: bags.word_weights(bags.bow_multiset(bag, config.vocab_size)))
    return {"bow": bag, "word_weights": weights}


STEPS = {"pairs": (seed_pairs, PairConfig), "vocabulary": (learned_bags, VocabularyConfig), "bags": (filed_bags, PairConfig)}


def main() -> None:
    """``python -m wordmosaic.plans.pipeline --step pairs|vocabulary|bags --config FILE --data FOLDER --out FOLDER``."""
    args = arguments("Similar pairs, a learned vocabulary with its bags, or bags of word files", tuple(STEPS))
    spark = SparkSession.builder.appName("wordmosaic").getOrCreate()
    shipped(spark)
    run, config = STEPS[args.step]
    for name, table in run(spark, args.data, args.out, read_config(args.config, config)).items():
        if name in ("bands", "lowest", "most_inliers"):
            table.show(truncate=False)


if __name__ == "__main__":
    main()
