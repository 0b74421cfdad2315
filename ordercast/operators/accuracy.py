"""How good the forecast was: total error and mean absolute percentage error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercast.functions.numeric import abs_pct_error, safe_ratio, strict_sum, total_or_zero
from ordercast.operators.calendar import CycleCalendar, window_totals_wide
from ordercast.operators.clean import iso_week
from ordercast.operators.series import actual_vs_forecast


def accuracy_base(
    daily: DataFrame, forecast: DataFrame, cal: CycleCalendar, denominator: str = "actual"
) -> DataFrame:
    """Actual against forecast on the target days, with the ISO week."""
    compared = actual_vs_forecast(daily, forecast, cal, "target", denominator)
    names = {"Act_Orders": "act_orders", "Variance": "variance", "Var_Pct": "var_pct", "Abs_Var_Pct": "abs_var_pct"}
    return compared.withColumnsRenamed(names).withColumn("The_Week", iso_week(F.col("Date")))


def actual_yoy(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Growth that really happened in the target over the same weeks a year earlier."""
    growth = safe_ratio(F.col("target") - F.col("comp_target"), F.col("comp_target"))
    return window_totals_wide(daily, cal).select("cycle_id", "target", "comp_target", growth.alias("actual_chg"))


def forecast_error(
    base: DataFrame, daily: DataFrame, cal: CycleCalendar, by: Sequence[str] = (), denominator: str = "comp_target"
) -> DataFrame:
    """sum F - sum A, and the same over a window total of the whole cycle.

    The denominator is last year's volume by default (``comp_target``); ``target`` gives the error
    relative to what was ordered. ``by`` splits the error, not the denominator.
    """
    gap = total_or_zero(F.col("Fcast_Volume")) - total_or_zero(F.col("act_orders"))
    totals = window_totals_wide(daily, cal).select("cycle_id", F.col(denominator).alias("_base"))
    return (
        base.groupBy("cycle_id", *by)
        .agg(gap.alias("sum_variance"))
        .join(totals, "cycle_id")
        .select(
            "cycle_id", *by, "sum_variance", safe_ratio(F.col("sum_variance"), F.col("_base")).alias("pct_variance")
        )
    )


def mape(base: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute percentage error of warehouse-days.

    A row without a forecast counts as an error of 0; ``n_no_forecast`` says how many there are.
    """
    return base.groupBy("cycle_id", *by).agg(
        F.avg("abs_var_pct").alias("MAPE"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("Fcast_Volume").isNull()).alias("n_no_forecast"),
    )


def error_levels(
    base: DataFrame, daily: DataFrame, cal: CycleCalendar, denominator: str = "comp_target"
) -> DataFrame:
    """Total error and mean absolute percentage error of each cycle, of its warehouses and of its weeks in one pass.

    ``level`` is ``total``, ``Warehouse`` or ``The_Week`` and tells a row of a whole cycle from one of a missing
    warehouse or week. Its slices equal :func:`forecast_error` and :func:`mape` with these keys.
    """
    levels = [["cycle_id"], ["cycle_id", "Warehouse"], ["cycle_id", "The_Week"]]
    gap = total_or_zero(F.col("Fcast_Volume")) - total_or_zero(F.col("act_orders"))
    level = F.when(F.grouping("Warehouse") == 0, "Warehouse").when(F.grouping("The_Week") == 0, "The_Week").otherwise("total")
    totals = window_totals_wide(daily, cal).select("cycle_id", F.col(denominator).alias("_base"))
    return (
        base.groupingSets(levels, "cycle_id", "Warehouse", "The_Week")
        .agg(
            level.alias("level"),
            gap.alias("sum_variance"),
            F.avg("abs_var_pct").alias("MAPE"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("Fcast_Volume").isNull()).alias("n_no_forecast"),
        )
        .join(totals, "cycle_id")
        .withColumn("pct_variance", safe_ratio(F.col("sum_variance"), F.col("_base")))
        .select("cycle_id", "level", "Warehouse", "The_Week", "sum_variance", "pct_variance", "MAPE", "n_rows", "n_no_forecast")
    )


def weekly_grain(base: DataFrame) -> DataFrame:
    """Actual and forecast added up per ISO week over all warehouses, with the week's error."""
    weeks = base.groupBy("cycle_id", "The_Week").agg(
        strict_sum(F.col("act_orders")).alias("act_orders"),
        strict_sum(F.col("Fcast_Volume")).alias("Fcast_Volume"),
    )
    return (
        weeks.withColumn("variance", F.col("Fcast_Volume") - F.col("act_orders"))
        .withColumn("var_pct", safe_ratio(F.col("variance"), F.col("act_orders")))
        .withColumn("abs_var_pct", abs_pct_error(F.col("Fcast_Volume"), F.col("act_orders")))
    )


def weekly_grain_mape(base: DataFrame) -> DataFrame:
    """Mean of the weekly errors."""
    return weekly_grain(base).groupBy("cycle_id").agg(F.avg("abs_var_pct").alias("weekly_mape"))
