import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from sylvan.session import ship

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def nodes_df(spark):
    """Makes a nodes table from short rows; missing columns are null."""
    from sylvan.tables import NODES

    names = [c.strip().split()[0] for c in NODES.split(", ")]

    def make(rows):
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], NODES)

    return make


@pytest.fixture(scope="session")
def edges_df(spark):
    from sylvan.tables import EDGES

    names = [c.strip().split()[0] for c in EDGES.split(", ")]

    def make(rows):
        return spark.createDataFrame([tuple({"edge_seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], EDGES)

    return make
