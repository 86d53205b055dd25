import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    found = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wayfold-test-"))
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    return found


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS FROM '{small}/{name}'")
    return con


@pytest.fixture(scope="session")
def rows_of():
    """Rows of a pandas frame as sorted lists of strings, columns by name."""

    def rows(table):
        show = lambda v: "-" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
        return sorted([show(v) for v in r] for r in table[sorted(table.columns)].itertuples(index=False))

    return rows
