import numpy as np
import pytest

from tests.conftest import rows
from wordmosaic.plans import config, pipeline, stages
from wordmosaic.sources import files, tables
from wordmosaic.streaming.sketch_index import SketchIndex
from wordmosaic.operators.minhash import HashFamily

WORDS = "128\n3\n5 10.0 20.0 1 0 1\n2 11.5 21.0 1 0 1\n5 12.0 22.0 1 0 1\n"
SIFT = "4\n2\n10.0 20.0 0.1 0.0 0.1 1 3 0 0\n30.0 40.0 0.2 0.0 0.2 4 4 4 4\n1 1 1 1 1 9 9 9 9\n"


def test_word_files(spark, tmp_path):
    (tmp_path / "img_a.txt").write_text(WORDS)
    (tmp_path / "img_b.txt").write_text("128\n0\n")
    path = str(tmp_path / "*.txt")
    assert rows(files.word_bags(spark, path)) == [("img_a", [1, 4, 4])]
    assert rows(files.word_file_counts(spark, path)) == [("img_a", 3), ("img_b", 0)]
    assert rows(files.word_keypoints(spark, path).select("pos", "x", "y", "size"))[1] == (1, 11.5, 21.0, 1.0)
    (tmp_path / "bad.txt").write_text("128\n1\n5 1 1 1 0 1\n\n6 1 1 1 0 1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.visual_words(spark, str(tmp_path / "bad.txt")).collect()


def test_sift_files(spark, tmp_path):
    (tmp_path / "img_a.jpg.hesaff.sift").write_text(SIFT)
    got = files.sift_files(spark, str(tmp_path)).orderBy("desc_id").collect()
    assert [(r["image_name"], r["desc_id"], r["x"]) for r in got] == [("img_a", 0, 10.0), ("img_a", 1, 30.0)]
    assert [round(x, 6) for x in got[0]["descriptor"]] == [0.5, 0.866025, 0.0, 0.0] and got[1]["kind"] == "rootsift"
    assert files.sift_files(spark, str(tmp_path), root=False).orderBy("desc_id").first()["descriptor"] == [1.0, 3.0, 0.0, 0.0]
    (tmp_path / "short.jpg.hesaff.sift").write_text("4\n5\n1 1 1 1 1 9 9 9 9\n")
    with pytest.raises(Exception, match="fewer rows"):
        files.sift_files(spark, str(tmp_path)).collect()


def test_records(spark, tmp_path):
    data = np.arange(5 * 128 + 7).astype(np.uint8)
    (tmp_path / "feat.bin").write_bytes(data.tobytes())
    got = files.descriptor_records(spark, str(tmp_path / "feat.bin"), split_records=2).orderBy("row").collect()
    assert len(got) == 5 and got[3]["descriptor"] == data[3 * 128 : 4 * 128].tolist()
    (tmp_path / "empty.bin").write_bytes(b"")
    assert files.descriptor_records(spark, str(tmp_path / "empty.bin")).count() == 0


def test_order_and_listing(spark, tmp_path):
    (tmp_path / "order.txt").write_text("b\na\n\nc\n")
    assert [r[1] for r in rows(files.image_order(spark, str(tmp_path / "order.txt")))] == ["b", "a", "c"]
    assert files.files(spark, str(tmp_path), "*.txt").count() == 1
    assert files.images(spark, str(tmp_path)).columns == ["image"]


def test_schema_check(spark):
    good = spark.createDataFrame([("a", [1], 3)], "image_name string, words array<int>, more int")
    assert tables.checked(good, "bow") is good
    with pytest.raises(ValueError, match="words"):
        tables.checked(spark.createDataFrame([("a", [1])], "image_name string, words array<long>"), "bow")


def test_config(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text("general:\n  vocab_size: 1000\n  unread: 1\nmhic_config:\n  max_similarity: 1\n")
    c = config.read_config(str(path), config.PairConfig)
    assert c.vocab_size == 1000 and c.max_similarity == 1.0 and c.hash_num == 512 and c.ransac_threshold == 5.0
    path.write_text("general:\n  vocab_size: 2**17\n")
    with pytest.raises(ValueError, match="whole number"):
        config.read_config(str(path), config.PairConfig)
    with pytest.raises(ValueError):
        config.PairConfig(matcher="BRTUE_FORCE")
    with pytest.raises(ValueError, match="not supported"):
        config.VocabularyConfig(clustering_lib="flann")
    assert config.config_hash(config.PairConfig()) != config.config_hash(config.PairConfig(seed=1))


def test_stage_is_reused_only_for_its_settings(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for key in ("k1", "k1", "k2"):
        assert stages.stage(spark, str(tmp_path), "s", key, make).count() == 3
    assert len(made) == 2


def planted_images(spark, folder):
    rng = np.random.RandomState(0)
    shared = rng.randint(0, 5000, 40).tolist()
    bow = [(f"i{k}", shared[:35] + rng.randint(0, 5000, 45).tolist()) for k in range(3)] + [(f"j{k}", rng.randint(0, 5000, 80).tolist()) for k in range(5)]
    spark.createDataFrame(bow, "image_name string, words array<int>").write.parquet(f"{folder}/bow.parquet")
    rows_ = []
    base = rng.randint(1, 255, (30, 128))
    for k in range(3):
        for n in range(30):
            rows_.append((f"i{k}", n, float(10 * (n % 6) + 13 * k + n * 7 % 5), float(20 * (n // 6) - 7 * k), 0.0, 0.0, 0.0, [float(x) for x in base[n]], k * 100 + n, "sift"))
    spark.createDataFrame(rows_, "image_name string, desc_id int, x float, y float, a float, b float, c float, descriptor array<float>, vec_id long, kind string").write.parquet(f"{folder}/descriptors.parquet")


def test_pipeline_of_pairs(spark, tmp_path):
    planted_images(spark, tmp_path)
    settings = config.PairConfig(vocab_size=5000, weighted=False, matcher="brute_force")
    out = pipeline.seed_pairs(spark, str(tmp_path), str(tmp_path / "out"), settings)
    verified = {(r["a"], r["b"]): r["n_inliers"] for r in out["verified"].collect()}
    assert {("i0", "i1"), ("i0", "i2"), ("i1", "i2")} <= set(verified)
    assert all(verified[p] >= 25 for p in (("i0", "i1"), ("i0", "i2"), ("i1", "i2")))
    assert out["bands"].first()["n_pairs"] == out["pairs"].count()
    again = pipeline.seed_pairs(spark, str(tmp_path), str(tmp_path / "out"), settings)
    assert rows(again["verified"]) == rows(out["verified"])


def test_pipeline_of_vocabulary(spark, tmp_path):
    rng = np.random.RandomState(1)
    points = spark.createDataFrame([(k, f"i{k % 4}", rng.randint(0, 255, 16).tolist()) for k in range(200)], "id long, image_name string, v array<int>")
    settings = config.VocabularyConfig(vocab_size=10, pq_subspaces=4, pq_codes=8, pq_train_size=100, iterations=2)
    made = pipeline.vocabulary(points, str(tmp_path), settings)
    assert made["vocab"].count() == 10 and made["codes"].count() == 200
    assert pipeline.bags_from_vocabulary(points, made["vocab"], made["codebook"]).count() == 4
    plain = pipeline.vocabulary(points, str(tmp_path), config.VocabularyConfig(vocab_size=5, clustering_lib="kmeans", iterations=2))
    assert plain["centers"].count() == 5


def test_sketch_index_over_batches(spark, tmp_path):
    index = SketchIndex(str(tmp_path / "index"), HashFamily(32, 16, 2))
    make = lambda data: spark.createDataFrame(data, "image_name string, words array<int>")
    index.process(make([("a", [1, 2, 3]), ("b", [50, 60])]), 0)
    index.process(make([("c", [1, 2, 3]), ("d", [900, 901])]), 1)
    index.process(make([("c", [1, 2, 3]), ("d", [900, 901])]), 1)  # replayed
    assert rows(index.seen(spark).select("image_name", "seen")) == [("a", False), ("b", False), ("c", True), ("d", False)]


def test_sketch_index_as_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", [1, 2, 3]), ("b", [1, 2, 3])], "image_name string, words array<int>").write.parquet(str(source))
    index = SketchIndex(str(tmp_path / "index"), HashFamily(32, 16, 2))
    stream = spark.readStream.schema("image_name string, words array<int>").parquet(str(source))
    index.start(stream, str(tmp_path / "ck")).awaitTermination()
    assert rows(index.seen(spark).select("image_name", "seen")) == [("a", False), ("b", True)]
