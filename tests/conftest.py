import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from timberline.session import configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    yield configure(session)
    session.stop()


@pytest.fixture
def lines(spark):
    """Lines of one file, as the parsers take them."""

    def make(*texts, file="f", block=0):
        rows = [(file, block, n, text) for n, text in enumerate(texts, start=1)]
        return spark.createDataFrame(rows, "file string, block long, line_no long, raw string")

    return make


@pytest.fixture(scope="session")
def at():
    """A fixed moment in UTC."""
    return lambda text: F.to_timestamp(F.lit(text + "Z"))


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few kilobytes."""
    names = {"spark.sql.files.maxPartitionBytes": "8KB", "spark.sql.files.openCostInBytes": "1KB"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)
