"""Actual and forecast side by side, and the series shown to stakeholders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercast.functions.numeric import abs_pct_error, if_else, safe_ratio, strict_sum, total_or_zero
from ordercast.operators.calendar import CycleCalendar, in_windows

MEASURES = ["Act_Orders", "Fcast_Volume", "Lower", "Upper"]


def actual_vs_forecast(
    daily: DataFrame, forecast: DataFrame, cal: CycleCalendar, role: str = "span", denominator: str = "actual"
) -> DataFrame:
    """Daily actuals of a window against the forecast with its bounds.

    Missing actuals and bounds become 0, a missing forecast stays null. The default window runs from
    the start of the recent window to the end of the target. Either side has a row per day at most (rows
    without a date, one per weekday), so stacking and grouping them does what a full join would, in one
    shuffle.
    """
    actual = in_windows(daily, cal, role).select(
        "cycle_id", "Warehouse", "Date", F.dayofweek("Date").alias("_dow"), F.col("demand").alias("Act_Orders")
    )
    dated = forecast.withColumnRenamed("Fcast_Date", "Date")
    dated = dated.withColumn("_dow", F.coalesce(F.dayofweek("Date"), F.col("DOW")))
    stacked = actual.unionByName(dated, allowMissingColumns=True)
    measured = ["Act_Orders", *[c for c in forecast.columns if c not in ("cycle_id", "Warehouse", "Fcast_Date")]]
    days = stacked.groupBy("cycle_id", "Warehouse", "Date", "_dow").agg(*[F.max(c).alias(c) for c in measured])
    both = days.drop("_dow")
    error = abs_pct_error(F.col("Fcast_Volume"), F.col("Act_Orders"), denominator)
    return (
        both.na.fill(0.0, ["Act_Orders", "Lower", "Upper"])
        .withColumn("Variance", F.col("Fcast_Volume") - F.col("Act_Orders"))
        .withColumn("Var_Pct", safe_ratio(F.col("Variance"), F.col("Act_Orders")))
        .withColumn("Abs_Var_Pct", error)
    )


def measures_long(compared: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per measure; nulls are kept."""
    return compared.unpivot(["cycle_id", "Warehouse", "Date"], list(measures), "variable", "value")


def delivery_day_total(compared: DataFrame, cal: CycleCalendar, by_warehouse: bool = False) -> DataFrame:
    """Forecast on the delivery date; null if one of its members is."""
    keys = ["cycle_id", "Warehouse"] if by_warehouse else ["cycle_id"]
    on_delivery = compared.where(F.col("Date") == cal.delivery(F.col("cycle_id")))
    return on_delivery.groupBy(*keys).agg(strict_sum(F.col("Fcast_Volume")).alias("total"))


def _daily_measures(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measures added up per day, still side by side: the series turn long after the grouping."""
    sums = [total_or_zero(F.col(m)).alias(m) for m in MEASURES]
    return compared.groupBy(*keys).agg(*sums, strict_sum(F.col("Fcast_Volume")).alias("_published"))


def _from_delivery_on(cal: CycleCalendar) -> dict:
    """Forecast and bounds are shown from the delivery date on."""
    before = F.col("Date") < cal.delivery(F.col("cycle_id"))
    return {m: if_else(before, F.lit(None).cast("double"), F.col(m)) for m in MEASURES[1:]}


def _long(wide: DataFrame, keys: list[str]) -> DataFrame:
    return wide.unpivot(keys, MEASURES, "variable", "orders")


def stakeholder_series(compared: DataFrame, cal: CycleCalendar, by_warehouse: bool = False) -> DataFrame:
    """What was known at delivery: actuals up to it, the forecast from it on.

    On the delivery date the actual is set to the forecast, so the two lines meet.
    """
    keys = ["cycle_id", "Warehouse", "Date"] if by_warehouse else ["cycle_id", "Date"]
    delivery = cal.delivery(F.col("cycle_id"))
    shown = (
        F.when(F.col("Date") == delivery, F.col("_published"))
        .when(F.col("Date") < delivery, F.col("Act_Orders"))
    )
    wide = _daily_measures(compared, keys)
    return _long(wide.withColumns({"Act_Orders": shown, **_from_delivery_on(cal)}), keys)


def stakeholder_series_asof(compared: DataFrame, cal: CycleCalendar, asof_days: int = 47) -> DataFrame:
    """The same some days into the target: actuals up to ``asof_days`` after delivery, not spliced."""
    keys = ["cycle_id", "Date"]
    later = F.col("Date") > F.date_add(cal.delivery(F.col("cycle_id")), asof_days)
    shown = if_else(later, F.lit(None).cast("double"), F.col("Act_Orders"))
    wide = _daily_measures(compared, keys)
    return _long(wide.withColumns({"Act_Orders": shown, **_from_delivery_on(cal)}), keys)


def weekdays_only(series: DataFrame, date_column: str = "Date") -> DataFrame:
    """Drop Saturdays and Sundays; rows without a date are no weekend."""
    weekend = F.dayofweek(date_column).isin(1, 7)
    return series.where(~F.coalesce(weekend, F.lit(False)))
