from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    spark = (
        SparkSession.builder.master("local[8]").appName("seatwise-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "America/Bogota")
        .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def seed(spark, tmp_path_factory):
    """The seed rows, written as parquet and read back through the typed scan."""
    from seatwise.sources.tables import load_model
    from tests.seed import seed_model

    folder = str(tmp_path_factory.mktemp("seed"))
    for name, df in seed_model(spark).items():
        df.coalesce(1).write.parquet(f"{folder}/{name}")
    return load_model(spark, folder)
