import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from barlake import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        session.builder("tests")
        .master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over a one-row frame."""

    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    return value


@pytest.fixture
def folder(tmp_path):
    return f"file:{tmp_path}" if os.name == "nt" else str(tmp_path)
