from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def people(spark):
    """Five people, every column but the id with one absent value."""
    # The rows behind expected results.
    rows = [
        (1, "John", 30, 50000.0, "IT"),
        (2, "Alice", None, 60000.0, "HR"),
        (3, "Bob", 35, None, "IT"),
        (4, None, 40, 55000.0, None),
        (5, "Eve", 32, 65000.0, "HR"),
    ]
    return spark.createDataFrame(
        rows, "id int, name string, age int, salary float, department string"
    )


@pytest.fixture(scope="session")
def staff(spark):
    """Five people without absent values."""
    # The rows behind expected results.
    rows = [
        (1, "John Doe", 30, 50000, "IT"),
        (2, "Jane Smith", 35, 60000, "HR"),
        (3, "Bob Johnson", 28, 45000, "IT"),
        (4, "Alice Brown", 42, 70000, "Finance"),
        (5, "Charlie Wilson", 38, 55000, "Marketing"),
    ]
    return spark.createDataFrame(
        rows, "id int, name string, age int, salary int, department string"
    )


def by_column(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}
