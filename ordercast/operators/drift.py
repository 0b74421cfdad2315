"""Which input assumption of the forecast did not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordercast.functions.joins import match_join
from ordercast.functions.numeric import safe_ratio, total_or_zero
from ordercast.operators.calendar import CycleCalendar, in_windows


def warehouse_share_drift(base: DataFrame, expected_share: DataFrame) -> DataFrame:
    """Actual and expected share of each warehouse, and actual less expected."""
    in_cycle = Window.partitionBy("cycle_id")
    actual = (
        base.groupBy("cycle_id", "Warehouse")
        .agg(total_or_zero(F.col("act_orders")).alias("_v"))
        .withColumn("Actual", safe_ratio(F.col("_v"), F.sum("_v").over(in_cycle)))
        .drop("_v")
    )
    expected = expected_share.select("cycle_id", "Warehouse", F.col("pct_orders").alias("Expected"))
    return match_join(actual, expected, ["cycle_id", "Warehouse"], "left").withColumn(
        "Actual_Less_Expected", F.col("Actual") - F.col("Expected")
    )


def dow_share_drift(base: DataFrame, expected_curve: DataFrame) -> DataFrame:
    """Expected and actual day-of-week share within each warehouse, and actual less expected."""
    in_warehouse = Window.partitionBy("cycle_id", "Warehouse")
    actual = (
        base.groupBy("cycle_id", "Warehouse", F.dayofweek("Date").alias("DOW"))
        .agg(total_or_zero(F.col("act_orders")).alias("_v"))
        .withColumn("actual_pct", safe_ratio(F.col("_v"), F.sum("_v").over(in_warehouse)))
        .drop("_v")
    )
    expected = expected_curve.withColumnRenamed("pct_orders", "expected_pct")
    return match_join(expected, actual, ["cycle_id", "Warehouse", "DOW"], "left").withColumn(
        "dow_variance", F.col("actual_pct") - F.col("expected_pct")
    )


def product_mix_drift(lines: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Category shares in the target and in the recent window.

    Lines are added up per category and day before they are repeated for their windows, and both
    windows come out of one grouping. A category seen in only one of them is null in the other.
    """
    by_day = lines.groupBy("Product_Category", "Date").agg(F.sum("Order_Demand").alias("demand"))
    per_category = (
        in_windows(by_day, cal, "target", "pre")
        .groupBy("cycle_id", "Product_Category")
        .agg(
            F.sum(F.when(F.col("role") == "target", F.col("demand"))).alias("_actual"),
            F.sum(F.when(F.col("role") == "pre", F.col("demand"))).alias("_expected"),
        )
    )
    in_cycle = Window.partitionBy("cycle_id")
    return per_category.select(
        "cycle_id",
        "Product_Category",
        safe_ratio(F.col("_actual"), F.sum("_actual").over(in_cycle)).alias("actual_pct"),
        safe_ratio(F.col("_expected"), F.sum("_expected").over(in_cycle)).alias("expected_pct"),
    )


def mix_band(mix: DataFrame, width: float = 0.02) -> DataFrame:
    """Where a category lies relative to the band round equal shares; null if a share is missing."""
    gap = F.col("expected_pct") - F.col("actual_pct")
    band = F.when(gap > width, "above").when(gap < -width, "below").when(gap.isNotNull(), "inside")
    return mix.withColumn("band", band)
