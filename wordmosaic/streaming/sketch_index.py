"""Incremental collision test: have the sketches of an arriving image been seen before?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordmosaic.operators.collisions import sketch_keys
from wordmosaic.operators.minhash import HashFamily, signatures, sketches
from wordmosaic.plans.stages import exists


class SketchIndex:
    """Sketches seen so far, a Parquet table partitioned by batch, and the pairs they gave.

    Each micro-batch is joined to the index and appended under its batch number; a batch
    that is replayed overwrites its own part, so results hold each batch once. ``keep``
    bounds the index: batches older than that many are not looked at (None: all).
    """

    def __init__(self, folder: str, family: HashFamily = HashFamily(), keep: int | None = None) -> None:  # noqa: B008
        self.folder, self.family, self.keep = folder.rstrip("/"), family, keep

    def _read(self, spark: SparkSession, name: str, before: int) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        parts = [b for b in range(max(0, before - self.keep) if self.keep else 0, before) if exists(spark, f"{path}/batch={b}")]
        return spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in parts)) if parts else None

    def process(self, batch: DataFrame, number: int) -> None:
        """Write the batch's sketches, and its images with ``seen``: whether a sketch collides with an earlier one."""
        spark = batch.sparkSession
        own = f"{self.folder}/sketches/batch={number}"
        sketches(signatures(batch.select("image_name", "words"), self.family), self.family).write.mode("overwrite").parquet(own)
        fresh = spark.read.parquet(own)
        keys = sketch_keys(fresh)
        first = fresh.groupBy(*keys).agg(F.min("image_name").alias("first"))
        inside = fresh.join(first, keys).select("image_name", (F.col("image_name") > F.col("first")).alias("seen"))
        old = self._read(spark, "sketches", number)
        hits = inside if old is None else inside.unionAll(fresh.join(old.select(*keys), keys, "left_semi").select("image_name", F.lit(True).alias("seen")))
        hits.groupBy("image_name").agg(F.max("seen").alias("seen")).write.mode("overwrite").parquet(f"{self.folder}/seen/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of ``(image_name, words)``."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def seen(self, spark: SparkSession) -> DataFrame:
        """``(image_name, seen, batch)`` of everything processed so far."""
        return spark.read.parquet(f"{self.folder}/seen")
