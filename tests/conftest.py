import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def session() -> SparkSession:
    return (SparkSession.builder.master("local[8]").appName("vigilog-tests")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="vigilog-test-"))
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


@pytest.fixture(scope="session")
def spark():
    found = session()
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
