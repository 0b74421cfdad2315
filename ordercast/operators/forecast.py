"""Top-down daily forecast per cycle and warehouse.

Last year's volume of the same weeks, times recent growth, split by the recent warehouse share and
day-of-week curve. ``cycle_id`` is a key everywhere, so one job computes every cycle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercast.functions.numeric import safe_ratio
from ordercast.operators.calendar import (
    WINDOW_ROLES,
    CycleCalendar,
    in_windows,
    known_warehouses,
    window_totals_wide,
)


def _growth(pre: Column, pre_prev: Column) -> Column:
    return safe_ratio(pre - pre_prev, pre_prev)


def yoy_growth(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Growth of the recent window over the same window a year earlier; null without a base."""
    totals = window_totals_wide(daily, cal)
    growth = _growth(F.col("pre"), F.col("pre_prev"))
    return totals.select("cycle_id", "pre", "pre_prev", growth.alias("growth"))


def expected_volume(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Last year's target volume, the same grown, and the growth that implies."""
    totals = window_totals_wide(daily, cal)
    growth = _growth(F.col("pre"), F.col("pre_prev"))
    return (
        totals.select("cycle_id", F.col("comp_target").alias("comp_volume"), growth.alias("growth"))
        .withColumn("expected_volume", F.col("comp_volume") * (F.col("growth") + 1))
        .withColumn(
            "expected_growth",
            safe_ratio(F.col("expected_volume") - F.col("comp_volume"), F.col("comp_volume")),
        )
    )


def _recent_orders(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Demand of the recent window by cycle, warehouse and day of week."""
    return (
        in_windows(daily, cal, "pre")
        .groupBy("cycle_id", "Warehouse", F.dayofweek("Date").alias("DOW"))
        .agg(F.sum("demand").alias("orders"))
    )


def dow_curve(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Share of each day of week within its warehouse."""
    in_warehouse = Window.partitionBy("cycle_id", "Warehouse")
    share = safe_ratio(F.col("orders"), F.sum("orders").over(in_warehouse))
    return _recent_orders(daily, cal).select("cycle_id", "Warehouse", "DOW", share.alias("pct_orders"))


def warehouse_share(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Share of each warehouse in all demand."""
    in_cycle = Window.partitionBy("cycle_id")
    per_warehouse = (
        in_windows(daily, cal, "pre").groupBy("cycle_id", "Warehouse").agg(F.sum("demand").alias("orders"))
    )
    return per_warehouse.withColumn(
        "pct_orders", safe_ratio(F.col("orders"), F.sum("orders").over(in_cycle))
    )


def weekday_profile(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Everything a cycle's forecast rests on, by warehouse and weekday.

    One grouping adds up all windows; the totals that the shares and the growth need are sums over
    its few rows, so nothing is joined. Carries the volume of one day (``Fcast_Volume``), how many
    warehouse-days the recent window (also over all warehouses) and the target window have, and the
    spread of the target's actuals.
    """
    demand = F.col("demand")
    in_role = {r: F.when(F.col("role") == r, demand) for r in WINDOW_ROLES}
    weekdays = (
        in_windows(daily, cal, *WINDOW_ROLES)
        .groupBy("cycle_id", "Warehouse", F.dayofweek("Date").alias("DOW"))
        .agg(
            *[F.sum(value).alias(r) for r, value in in_role.items()],
            F.count_if(F.col("role") == "pre").alias("n_pre"),
            F.count_if(F.col("role") == "target").alias("n_target"),
            F.stddev_samp(in_role["target"]).alias("sd_target"),
        )
    )
    in_cycle = Window.partitionBy("cycle_id")
    in_warehouse = Window.partitionBy("cycle_id", "Warehouse")
    totals = {f"all_{r}": F.coalesce(F.sum(r).over(in_cycle), F.lit(0.0)) for r in WINDOW_ROLES}
    sums = {
        **totals,
        "wh_pre": F.sum("pre").over(in_warehouse),
        "n_pre_weekday": F.sum("n_pre").over(Window.partitionBy("cycle_id", "DOW")),
    }
    summed = weekdays.withColumns(sums)

    expected = F.col("all_comp_target") * (_growth(F.col("all_pre"), F.col("all_pre_prev")) + 1)
    weekly = safe_ratio(F.col("wh_pre"), F.col("all_pre")) * expected / cal.f_horizon_weeks
    return summed.select(
        "cycle_id",
        "Warehouse",
        "DOW",
        (weekly * safe_ratio(F.col("pre"), F.col("wh_pre"))).alias("Fcast_Volume"),
        "n_pre",
        "n_pre_weekday",
        "n_target",
        "sd_target",
    )


def warehouse_dow_volume(profile: DataFrame) -> DataFrame:
    """Expected volume of one day, by warehouse and weekday seen in the recent window."""
    return profile.where(F.col("n_pre") > 0).select("cycle_id", "Warehouse", "DOW", "Fcast_Volume")


def weekday_forecast(
    daily: DataFrame,
    cal: CycleCalendar,
    warehouses: DataFrame | None = None,
    spread: Callable[[CycleCalendar], Column] | None = None,
) -> DataFrame:
    """Forecast per weekday of every warehouse; 0 where there is no volume.

    Volumes and the weekdays to be published are stacked and grouped by their key. That is a full
    join in one shuffle in which a missing key meets a missing key. ``published`` tells which rows
    belong to the target days of a listed warehouse.

    ``spread`` names further rows each profile row gives rise to (``vsd`` for some other cycle, see
    ``intervals``); they go into the same stack, so the profile is computed once.
    """
    listed = known_warehouses(daily) if warehouses is None else warehouses.select("Warehouse")
    grid = listed.select("Warehouse", F.explode(cal.cycle_ids()).alias("cycle_id")).select(
        "cycle_id",
        "Warehouse",
        F.explode(F.sequence(F.lit(1), F.lit(7))).alias("DOW"),
        F.lit(True).alias("published"),
    )
    nothing = F.lit(None).cast("double")
    volume = part_row(F.col("cycle_id"), F.col("DOW"), F.col("Fcast_Volume"), F.lit(True), nothing)
    rows = [F.when(F.col("n_pre") > 0, volume)] + ([spread(cal)] if spread else [])
    parts = weekday_profile(daily, cal).select("Warehouse", F.inline(F.array_compact(F.array(*rows))))
    merged = (
        parts.unionByName(grid, allowMissingColumns=True)
        .groupBy("cycle_id", "Warehouse", "DOW")
        .agg(*[F.max(c).alias(c) for c in ("Fcast_Volume", "has_volume", "vsd", "published")])
    )
    filled = F.coalesce("Fcast_Volume", F.lit(0.0))
    forecast = F.when(F.col("has_volume") | F.col("published"), filled)
    merged = merged.withColumn("Fcast_Volume", forecast).drop("has_volume")
    return merged if spread else merged.drop("vsd")


def part_row(cycle_id: Column, dow: Column, volume: Column, has_volume: Column, vsd: Column) -> Column:
    """One row of the stack that ``weekday_forecast`` groups."""
    return F.struct(
        cycle_id.alias("cycle_id"),
        dow.alias("DOW"),
        volume.alias("Fcast_Volume"),
        has_volume.alias("has_volume"),
        vsd.alias("vsd"),
    )


def on_target_days(weekdays: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Repeat each weekday row for its dates in the target; rows that are not published get no date."""
    delivery = cal.delivery(F.col("cycle_id"))
    first = F.date_add(delivery, F.pmod(F.col("DOW") - F.dayofweek(delivery), F.lit(7)))
    dates = F.sequence(first, cal.window_end(delivery, "target"), F.make_dt_interval(F.lit(7)))
    measures = [c for c in weekdays.columns if c not in ("cycle_id", "Warehouse", "DOW", "published")]
    return weekdays.select(
        "cycle_id",
        "Warehouse",
        F.explode_outer(F.when(F.col("published"), dates)).alias("Fcast_Date"),
        "DOW",
        *measures,
    )


def daily_forecast(
    daily: DataFrame, cal: CycleCalendar, warehouses: DataFrame | None = None
) -> DataFrame:
    """The volume spread over every target day; 0 where a warehouse never ships on that weekday.

    ``warehouses`` defaults to those with demand. A warehouse with volume that is left out of it
    keeps its volume on a row without a date.
    """
    return on_target_days(weekday_forecast(daily, cal, warehouses), cal)
