import os

import pytest
from pyspark.sql import SparkSession

from wordmosaic.session import shipped

os.environ.setdefault("OMP_NUM_THREADS", "1")
TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    shipped(session)
    yield session
    session.stop()


def rows(df):
    return sorted(tuple(r) for r in df.collect())
