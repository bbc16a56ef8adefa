"""Session helpers: the shared folder for written stages, joins with hot keys.

Nothing here keeps data on the driver or in executor-local storage, so a lost
executor only costs the recomputation of its own tasks.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one key above which a join spreads that key over several tasks.
HOT_ROWS = 50_000
#: Hot keys up to which their list comes to the driver and into the plan; more stay a table.
MAX_HOT_KEYS = 1_000
#: Tasks one hot key is spread over where a caller asks for a fixed number, and at most in a join.
SALTS = 16
MOST_SALTS = 4_096


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="wordmosaic-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shipped(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session, so that they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_wordmosaic", None):
        return
    own = Path(__file__).parent
    sc._wordmosaic = f"{tempfile.mkdtemp(prefix='wordmosaic-')}/wordmosaic.zip"
    with zipfile.ZipFile(sc._wordmosaic, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(own.rglob("*.py")):
            z.write(file, file.relative_to(own.parent))
    sc.addPyFile(sc._wordmosaic)


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_with(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`written`, and aggregates of ``df`` that are taken while it is written, without a job of their own."""
    seen = Observation()
    return written(df.observe(seen, *(m.alias(k) for k, m in metrics.items())), name), seen.get


def shuffles_freed(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs, which otherwise stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Delete the files behind a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list:
    """The keys of ``df`` with more than ``hot_rows`` rows, the ``MAX_HOT_KEYS`` largest at most.

    The count is combined on the map side, so a hot key never meets in one task. The list
    steers only where rows go: a key beyond it is joined as any other, no row is lost.
    """
    counts = df.groupBy(key).count().filter(F.col("count") > hot_rows).orderBy(F.desc("count")).limit(MAX_HOT_KEYS)
    return [r[0] for r in counts.collect() if r[0] is not None]


def heavy_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """``(key, _salts)`` of the keys with more than ``hot_rows`` rows, to be broadcast; None if there are none.

    Each listed key has more than ``hot_rows`` rows, so the list is that much shorter than ``df``.
    """
    counts = df.groupBy(key).count().filter((F.col("count") > hot_rows) & F.col(key).isNotNull())
    salts = F.least(F.ceil(F.col("count") / hot_rows), F.lit(MOST_SALTS)).cast("int").alias("_salts")
    some = counts.orderBy(F.desc("count")).limit(MAX_HOT_KEYS + 1).select(key, salts).collect()  # one job, not a search part by part
    if not some:
        return None
    if len(some) > MAX_HOT_KEYS:
        return F.broadcast(written(counts.select(key, salts), "hot"))
    schema = T.StructType([df.schema[key], T.StructField("_salts", T.IntegerType())])
    return F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in some], schema))


def hot_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, hot: DataFrame | bool | None = None) -> DataFrame:
    """Join ``many`` to ``one`` (unique on ``key``) where ``many`` may hold a third of its rows under one key.

    Rows of hot keys get a salt, as many as their number asks for, and ``one`` repeats only those few
    rows once per salt. ``hot`` is a result of :func:`heavy_keys`, or False where none can be hot.
    """
    hot = heavy_keys(many, key, hot_rows) if hot is None else hot
    if hot is False or hot is None:
        return many.join(one, key, how)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    salted = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), salts).cast("int")).drop("_salts")
    spread = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(spread, [key, "_salt"], how).drop("_salt")
