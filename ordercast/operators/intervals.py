"""Forecast intervals from the errors of an earlier, already completed cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercast.functions.joins import match_join
from ordercast.functions.numeric import normal_quantile, strict_sd
from ordercast.operators.calendar import CycleCalendar, in_windows
from ordercast.operators.forecast import (
    on_target_days,
    part_row,
    warehouse_dow_volume,
    weekday_forecast,
    weekday_profile,
)


def calibration_forecast(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """The forecast of each cycle as calibration uses it: joined to days by weekday alone, unfilled.

    A weekday a warehouse never ships on has no row here (the published forecast has a 0), and a
    weekday nobody ships on leaves rows without a warehouse.
    """
    target_days = (
        cal.days(daily.sparkSession, "target")
        .select("cycle_id", F.col("Date").alias("Fcast_Date"))
        .withColumn("DOW", F.dayofweek("Fcast_Date"))
    )
    volumes = warehouse_dow_volume(weekday_profile(daily, cal))
    return match_join(volumes, target_days, ["cycle_id", "DOW"], "full").select(
        "cycle_id", "Warehouse", "Fcast_Date", "DOW", "Fcast_Volume"
    )


def calibration_error(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Forecast less actual on each warehouse-day that has orders.

    Weekday and error are null where there was no forecast row.
    """
    actual = in_windows(daily, cal, "target").select(
        "cycle_id", "Warehouse", "Date", F.col("demand").alias("Act_Orders")
    )
    forecast = calibration_forecast(daily, cal).withColumnRenamed("Fcast_Date", "Date")
    return match_join(actual, forecast, ["cycle_id", "Warehouse", "Date"], "left").withColumn(
        "Variance", F.col("Fcast_Volume") - F.col("Act_Orders")
    )


def error_sd(errors: DataFrame) -> DataFrame:
    """Spread of the error by warehouse and weekday; null if any error is, or with a single one."""
    return errors.groupBy("cycle_id", "Warehouse", "DOW").agg(strict_sd(F.col("Variance")).alias("vsd"))


def _spread(cal: CycleCalendar) -> Column:
    """``error_sd`` read off a weekday profile, as a row for the cycle that it calibrates.

    The forecast is the same on all days of a weekday, so its error spreads exactly as the actuals
    do and no day-by-day error is needed. Days with orders but no forecast have no weekday, except
    those of an unnamed warehouse on a weekday nobody ships on: ``calibration_forecast`` has rows
    without a warehouse for them.
    """
    has_forecast = F.col("n_pre") > 0
    has_row = has_forecast | (F.col("Warehouse").isNull() & (F.col("n_pre_weekday") == 0))
    known = has_forecast & F.col("Fcast_Volume").isNotNull()
    calibrated = cal.calibrated_by(F.col("cycle_id"))
    row = part_row(
        calibrated,
        F.when(has_row, F.col("DOW")),
        F.lit(None).cast("double"),
        F.lit(None).cast("boolean"),
        F.when(known, F.col("sd_target")),
    )
    return F.when((F.col("n_target") > 0) & calibrated.isNotNull(), row)


def forecast_with_interval(
    daily: DataFrame, cal: CycleCalendar, warehouses: DataFrame | None = None, level: float = 0.95
) -> DataFrame:
    """The daily forecast with normal bounds; the lower one is floored at 0.

    ``level`` is one-sided: 0.95 takes the 5th and 95th percentile. The spread comes from the cycle
    delivered one recent window earlier, whose target must have ended by now
    (``p_horizon_weeks >= f_horizon_weeks``). A spread without a forecast row (orders on a weekday
    that had no forecast) stays as a row without a date.
    """
    z = normal_quantile(level)
    weekdays = weekday_forecast(daily, cal, warehouses, spread=_spread)
    lower = F.col("Fcast_Volume") - F.col("vsd") * z
    upper = F.col("Fcast_Volume") + F.col("vsd") * z
    bounded = weekdays.withColumns(
        {"Lower": F.when(lower < 0, 0.0).otherwise(lower), "Upper": upper}
    ).drop("vsd")
    return on_target_days(bounded, cal)
