import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("ordercast-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def lines(spark):
    """Builds typed order lines from (product, warehouse, category, day, demand) tuples."""

    def build(rows):
        rows = [(p, w, c, dt.date.fromisoformat(d) if d else None, q) for p, w, c, d, q in rows]
        return spark.createDataFrame(
            rows,
            "Product_Code string, Warehouse string, Product_Category string, Date date, Order_Demand double",
        )

    return build


@pytest.fixture
def daily(spark):
    """Builds daily demand from (warehouse, day, demand) tuples."""

    def build(rows):
        rows = [(w, d if isinstance(d, dt.date) else dt.date.fromisoformat(d), float(q)) for w, d, q in rows]
        return spark.createDataFrame(rows, "Warehouse string, Date date, demand double")

    return build


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
