"""Forecast cycles, their comparison windows, and demand totals over those windows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW_ROLES = ("target", "comp_target", "pre", "pre_prev")


@dataclass(frozen=True)
class CycleCalendar:
    """One publication cycle every ``cadence_days``, ``n_cycles`` steps after the first.

    ``cycle_id`` counts from 1. ``n_cycles`` steps give ``n_cycles + 1`` cycles. The ``pre`` window
    ends ``pre_end_offset_days`` before delivery, both ends included, so the default of 7 holds one
    delivery weekday more than of the others; 8 makes whole weeks.
    """

    start_date: date
    n_cycles: int = 104
    cadence_days: int = 14
    f_horizon_weeks: int = 10
    p_horizon_weeks: int = 12
    yoy_days: int = 364
    pre_end_offset_days: int = 7

    def __post_init__(self):
        if self.p_horizon_weeks < self.f_horizon_weeks:
            # The calibrating cycle's target would not be over at delivery.
            raise ValueError("p_horizon_weeks has to be at least f_horizon_weeks")

    @property
    def last_cycle(self) -> int:
        return self.n_cycles + 1

    def offsets(self, role: str) -> tuple[int, int]:
        """First and last day of a window, in days from delivery. ``span`` is pre start to target end."""
        target = (0, 7 * self.f_horizon_weeks - 1)
        pre = (-7 * self.p_horizon_weeks, -self.pre_end_offset_days)
        return {
            "target": target,
            "comp_target": (target[0] - self.yoy_days, target[1] - self.yoy_days),
            "pre": pre,
            "pre_prev": (pre[0] - self.yoy_days, pre[1] - self.yoy_days),
            "span": (pre[0], target[1]),
        }[role]

    def delivery(self, cycle_id: Column) -> Column:
        return F.date_add(F.lit(self.start_date), (cycle_id - 1) * self.cadence_days)

    def calibrated_by(self, cycle_id: Column) -> Column:
        """The cycle delivered ``p_horizon_weeks`` after this one; null where there is none."""
        steps, off_grid = divmod(7 * self.p_horizon_weeks, self.cadence_days)
        later = cycle_id + steps
        return F.when((later <= self.last_cycle) & F.lit(off_grid == 0), later)

    def window_start(self, delivery: Column, role: str) -> Column:
        return F.date_add(delivery, self.offsets(role)[0])

    def window_end(self, delivery: Column, role: str) -> Column:
        return F.date_add(delivery, self.offsets(role)[1])

    def window_dates(self, delivery: Column, role: str) -> Column:
        """All days of a window as an array."""
        return F.sequence(self.window_start(delivery, role), self.window_end(delivery, role))

    def cycle_ids(self) -> Column:
        """All cycle ids as an array: explode it to repeat a row for every cycle."""
        return F.sequence(F.lit(1), F.lit(self.last_cycle))

    def cycles(self, spark: SparkSession) -> DataFrame:
        """(cycle_id, delivery)."""
        ids = spark.range(1, self.last_cycle + 1)
        ids = ids.select(F.col("id").cast("int").alias("cycle_id"))
        return ids.withColumn("delivery", self.delivery(F.col("cycle_id")))

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per cycle with the bounds of its windows."""
        delivery = F.col("delivery")
        bounds = []
        for role, name in (
            ("target", "target"),
            ("comp_target", "comp_target"),
            ("pre", "comp_pre_delivery"),
            ("pre_prev", "comp_pre_delivery"),
        ):
            tail = "_prev" if role == "pre_prev" else ""
            bounds += [
                self.window_start(delivery, role).alias(f"{name}_start{tail}"),
                self.window_end(delivery, role).alias(f"{name}_end{tail}"),
            ]
        return self.cycles(spark).select("cycle_id", "delivery", *bounds)

    def days(self, spark: SparkSession, *roles: str) -> DataFrame:
        """(cycle_id, role, Date): every day of every window.

        Written out day by day so that finding the windows of a date is an equi-join. The size
        follows from the calendar's parameters, not from the data; how it is joined is left to the
        planner.
        """
        windows = F.array(
            *[
                F.struct(F.lit(role).alias("role"), self.window_dates(F.col("delivery"), role).alias("dates"))
                for role in roles
            ]
        )
        return (
            self.cycles(spark)
            .select("cycle_id", F.inline(windows))
            .select("cycle_id", "role", F.explode("dates").alias("Date"))
        )


def date_framework(
    spark: SparkSession,
    start_date: date | str,
    n_cycles: int,
    cadence_days: int,
    f_horizon_weeks: int,
    p_horizon_weeks: int,
    yoy_days: int = 364,
    pre_end_offset_days: int = 7,
) -> DataFrame:
    """The cycle table for these parameters."""
    if isinstance(start_date, str):
        start_date = date.fromisoformat(start_date)
    return CycleCalendar(
        start_date, n_cycles, cadence_days, f_horizon_weeks, p_horizon_weeks, yoy_days, pre_end_offset_days
    ).frame(spark)


def daily_demand(lines: DataFrame) -> DataFrame:
    """Demand per warehouse and day: the grain that every cycle query works on."""
    return lines.groupBy("Warehouse", "Date").agg(F.sum("Order_Demand").alias("demand"))


def in_windows(by_date: DataFrame, cal: CycleCalendar, *roles: str) -> DataFrame:
    """Repeat each dated row for every (cycle, window) that its date falls into."""
    return by_date.join(cal.days(by_date.sparkSession, *roles), "Date")


def window_bounds(cal: CycleCalendar, spark: SparkSession, *roles: str) -> DataFrame:
    """(cycle_id, role, Date, sign): for every window the day before it, with -1, and its last day, with 1."""
    delivery = F.col("delivery")
    rows = []
    for role in roles:
        for sign, day in ((-1, F.date_sub(cal.window_start(delivery, role), 1)), (1, cal.window_end(delivery, role))):
            rows.append(F.struct(F.lit(role).alias("role"), day.alias("Date"), F.lit(sign).alias("sign")))
    return cal.cycles(spark).select("cycle_id", F.inline(F.array(*rows)))


def window_totals_wide(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """One row per cycle with a total per window; 0 for a window without demand.

    A window's total is the running sum at its last day less that on the day before its first. Days and window
    bounds are stacked and summed up in order of date, so a window brings two rows, however long it is. The stack
    has a row per calendar day and two per window: its size follows from the calendar. Sums of whole
    numbers are exact below 2**53; others have the rounding of the running sum.
    """
    per_day = daily.where(F.col("Date").isNotNull()).groupBy("Date").agg(F.sum("demand").alias("demand"))
    bounds = window_bounds(cal, daily.sparkSession, *WINDOW_ROLES)
    stack = per_day.unionByName(bounds, allowMissingColumns=True)
    # A day's demand comes before the bounds on that day.
    upto = Window.orderBy("Date", F.col("cycle_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = stack.withColumn("running", F.coalesce(F.sum("demand").over(upto), F.lit(0.0))).where(F.col("cycle_id").isNotNull())
    of = lambda role: F.sum(F.when(F.col("role") == role, F.col("sign") * F.col("running")))
    return summed.groupBy("cycle_id").agg(*[of(role).alias(role) for role in WINDOW_ROLES])


def cycle_window_totals(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """(cycle_id, role, total) for every cycle and window."""
    return window_totals_wide(daily, cal).unpivot("cycle_id", list(WINDOW_ROLES), "role", "total")


def calibration_cycles(fw: DataFrame, p_horizon_weeks: int) -> DataFrame:
    """For each cycle the one delivered ``p_horizon_weeks`` earlier; null where there is none."""
    earlier = fw.select(F.col("cycle_id").alias("calibration_id"), F.col("delivery").alias("earlier"))
    return fw.join(
        earlier, F.date_sub(F.col("delivery"), 7 * p_horizon_weeks) == F.col("earlier"), "left"
    ).select("cycle_id", "delivery", "calibration_id")


def window_coverage(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """The cycle table with what there is in each window: days with orders, the first and the last."""
    found = in_windows(daily.select("Date").distinct(), cal, *WINDOW_ROLES)
    here = lambda role: F.when(F.col("role") == role, F.col("Date"))
    columns = []
    for role in WINDOW_ROLES:
        columns += [
            F.count(here(role)).alias(f"{role}_days"),
            F.min(here(role)).alias(f"{role}_first"),
            F.max(here(role)).alias(f"{role}_last"),
        ]
    covered = found.groupBy("cycle_id").agg(*columns)
    counts = [f"{role}_days" for role in WINDOW_ROLES]
    return cal.frame(daily.sparkSession).join(covered, "cycle_id", "left").na.fill(0, counts)


def calibration_coverage(daily: DataFrame, cal: CycleCalendar) -> DataFrame:
    """The calibration cycle of each cycle, the days with orders in its target, and whether these are all."""
    covered = window_coverage(daily, cal)
    first, last = cal.offsets("target")
    earlier = covered.select(F.col("cycle_id").alias("calibration_id"), F.col("target_days").alias("calibration_days"))
    calibrated = calibration_cycles(covered.select("cycle_id", "delivery"), cal.p_horizon_weeks)
    return calibrated.join(earlier, "calibration_id", "left").select(
        "cycle_id",
        "delivery",
        "calibration_id",
        "calibration_days",
        (F.col("calibration_days") == last - first + 1).alias("calibration_complete"),
    )


def horizon_grid(warehouses: DataFrame, cal: CycleCalendar) -> DataFrame:
    """Every target day of every cycle for every warehouse.

    The calendar is a function of its parameters, so each warehouse row generates its own days;
    nothing is joined.
    """
    per_cycle = warehouses.select("Warehouse", F.explode(cal.cycle_ids()).alias("cycle_id"))
    dates = cal.window_dates(cal.delivery(F.col("cycle_id")), "target")
    return per_cycle.select(
        "cycle_id", "Warehouse", F.explode(dates).alias("Fcast_Date")
    ).withColumn("DOW", F.dayofweek("Fcast_Date"))


def known_warehouses(daily: DataFrame) -> DataFrame:
    return daily.select("Warehouse").distinct()
