"""Order lines derived from the TPC-H-like test tables, and the parameters that fit their dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordercast.operators.calendar import CycleCalendar

CLIP = (date(1995, 1, 8), date(2001, 10, 28))
# The last target ends after the last order, so the later cycles are short of data or have none.
CALENDAR = CycleCalendar(start_date=date(1996, 4, 1), n_cycles=156)
WAREHOUSES = ["Whse_A", "Whse_C", "Whse_J", "Whse_S"]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with its ``part`` as raw, all-text order lines.

    Spark broadcasts ``part`` while its files are under the broadcast threshold and shuffles both
    sides on the part key beyond that.
    """
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
    lines = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))

    no_date = (F.col("l_suppkey") % 4 == 0) & (F.col("l_orderkey") % 50 == 0)
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    amount = F.floor(F.col("l_extendedprice") + 0.5).cast("string")
    day = F.translate(F.col("l_shipdate").cast("date").cast("string"), "-", "/")
    return lines.select(
        F.col("p_brand").alias("Product_Code"),
        F.element_at(
            F.array(*map(F.lit, WAREHOUSES)), (F.col("l_suppkey") % 4).cast("int") + 1
        ).alias("Warehouse"),
        F.col("p_type").alias("Product_Category"),
        F.when(no_date, "NA").otherwise(day).alias("Date"),
        F.when(returned, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount).alias("Order_Demand"),
    )
