"""One local session for all tests, with its checkpoint folder in a temporary place."""

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    place = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(place / "shared")).config("spark.sql.warehouse.dir", str(place / "warehouse")).config("spark.local.dir", str(place / "local"))
        .config("spark.driver.memory", "4g").config("spark.sql.execution.arrow.maxRecordsPerBatch", "64").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
