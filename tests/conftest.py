import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("coogrid-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def pattern(spark):
    """Build a small pattern matrix from a list of pairs."""
    from coogrid import Matrix

    def make(pairs, nrows, ncols=None):
        df = spark.createDataFrame(list(pairs), "r bigint, c bigint")
        return Matrix.from_edges(df, "r", "c", nrows, nrows if ncols is None else ncols)

    return make


@pytest.fixture
def valued(spark):
    """Build a small valued matrix from a list of triples."""
    from coogrid import Matrix

    def make(triples, nrows, ncols=None, kind="double"):
        df = spark.createDataFrame(list(triples), f"r bigint, c bigint, v {kind}")
        return Matrix.from_edges(df, "r", "c", nrows, nrows if ncols is None else ncols, "v", "sum")

    return make


@pytest.fixture
def vector(spark):
    def make(values):
        return spark.createDataFrame(list(enumerate(map(float, values))), "idx bigint, val double")

    return make
