"""Outlier trimming per warehouse and product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercast.functions.joins import match_join
from ordercast.functions.numeric import safe_ratio, total_or_zero
from ordercast.operators.quantiles import group_quantiles
from ordercast.plans.staging import StagingArea

GROUP = ["Warehouse", "Product_Code"]


def warehouse_totals(lines: DataFrame) -> DataFrame:
    """Lines and demand per warehouse."""
    return lines.groupBy("Warehouse").agg(
        F.count(F.lit(1)).alias("total_orders"),
        total_or_zero(F.col("Order_Demand")).alias("sum_orders"),
    )


def outlier_bounds(
    lines: DataFrame, lower: float = 0.01, upper: float = 0.99, area: StagingArea | None = None
) -> DataFrame:
    """The interpolated bounds of every (warehouse, product)."""
    return group_quantiles(lines, GROUP, "Order_Demand", {"upper": upper, "lower": lower}, area=area)


def flag_outliers(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """``take_out`` is 1 strictly outside the bounds, 0 inside, null without a demand.

    A group of two different values loses both, and every group loses an untied minimum and
    maximum: the bounds are interpolated and the comparison is strict.
    """
    flagged = match_join(lines, bounds, GROUP, "left")
    outside = ~F.col("Order_Demand").between(F.col("lower"), F.col("upper"))
    columns = [*lines.columns, "upper", "lower"]
    return flagged.select(*columns, outside.cast("int").alias("take_out"))


def trim_outliers(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """Lines inside their bounds."""
    return flag_outliers(lines, bounds).where(F.col("take_out") == 0)


def outlier_impact(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """What trimming takes from each warehouse that loses a line.

    Totals and flagged totals come from the same grouping, so the lines are read once.
    """
    out = F.col("take_out") == 1
    demand = F.col("Order_Demand")
    per_warehouse = (
        flag_outliers(lines, bounds)
        .groupBy("Warehouse")
        .agg(
            F.count_if(out).alias("count_removed"),
            F.sum(F.when(out, demand)).alias("sum_removed"),
            F.avg(F.when(out, demand)).alias("avg_remove"),
            F.count(F.lit(1)).alias("total_orders"),
            total_or_zero(demand).alias("sum_orders"),
        )
    )
    return per_warehouse.where(F.col("count_removed") > 0).select(
        "*",
        safe_ratio(F.col("count_removed"), F.col("total_orders")).alias("pct_count_removed"),
        safe_ratio(F.col("sum_removed"), F.col("sum_orders")).alias("pct_sum_removed"),
    )
