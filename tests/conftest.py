from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from workload.inputs import ship_package

    ship_package(session)
    yield session


@pytest.fixture
def docs(spark):
    """(id, text) pairs -> corpus."""

    def make(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, text string")

    return make


def table(df, *columns, digits=6):
    """Rows as a sorted list of tuples with rounded floats."""
    rows = df.select(*columns).collect()
    return sorted(
        tuple(round(v, digits) if isinstance(v, float) else v for v in row) for row in rows
    )
