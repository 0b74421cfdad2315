"""The naive forecast: what was ordered exactly four weeks earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordercast.functions.numeric import abs_pct_error, safe_ratio, total_or_zero
from ordercast.operators.calendar import CycleCalendar, in_windows


def benchmark_4wk(daily: DataFrame, lag_days: int = 28) -> DataFrame:
    """Actual and naive forecast per warehouse-day (``daily`` has one row for each).

    The forecast is the actual of exactly ``lag_days`` calendar days before: a frame over day numbers that
    holds that day only. It is null where that day has no orders (a row offset would pick another day there). A
    warehouse's window holds its days, which the calendar bounds.
    """
    day = F.unix_date("Date")
    earlier = Window.partitionBy("Warehouse").orderBy(day).rangeBetween(-lag_days, -lag_days)
    naive = F.when(F.col("Date").isNotNull(), F.max("demand").over(earlier))
    return daily.select("Warehouse", "Date", F.col("demand").alias("Total_Orders"), naive.alias("Forecast_Orders"))


def _in_target(benchmark: DataFrame, cal: CycleCalendar) -> DataFrame:
    return in_windows(benchmark.where(F.col("Forecast_Orders").isNotNull()), cal, "target")


def _every_cycle(measured: DataFrame, cal: CycleCalendar) -> DataFrame:
    """One row per cycle; null where no day of the target has a forecast."""
    cycles = cal.cycles(measured.sparkSession).select("cycle_id")
    return cycles.join(measured, "cycle_id", "left")


def benchmark_variance(benchmark: DataFrame, cal: CycleCalendar, by_warehouse: bool = False) -> DataFrame:
    """(sum F - sum A) / sum A over the target window, days with a forecast only.

    One row for every cycle or, by warehouse, for every cycle and warehouse that have such days.
    """
    keys = ["cycle_id", "Warehouse"] if by_warehouse else ["cycle_id"]
    actual, forecast = total_or_zero(F.col("Total_Orders")), total_or_zero(F.col("Forecast_Orders"))
    measured = (
        _in_target(benchmark, cal)
        .groupBy(*keys)
        .agg(safe_ratio(forecast - actual, actual).alias("variance"))
    )
    return measured if by_warehouse else _every_cycle(measured, cal)


def benchmark_mape(benchmark: DataFrame, cal: CycleCalendar, denominator: str = "forecast") -> DataFrame:
    """Mean absolute percentage error of the naive forecast for every cycle; by default relative to the forecast."""
    error = abs_pct_error(F.col("Forecast_Orders"), F.col("Total_Orders"), denominator)
    return _every_cycle(_in_target(benchmark, cal).groupBy("cycle_id").agg(F.avg(error).alias("mape")), cal)
