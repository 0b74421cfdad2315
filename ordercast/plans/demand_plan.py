"""One run from raw order lines to forecast, accuracy and drift.

Three intermediate results are written to the shared folder:

- the parsed order lines, so that text is parsed once and the later passes are columnar scans with
  pruned columns and a date filter that reaches the files;
- the outlier bounds, one row per warehouse and product;
- daily demand, one row per warehouse and day. Everything keyed by cycle starts from it, so the
  order lines are read a fixed number of times however many cycles there are.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame

from ordercast.operators import accuracy, benchmark, calendar, clean, forecast, intervals, outliers, series
from ordercast.operators.calendar import CycleCalendar
from ordercast.plans.staging import StagingArea


class DemandPlan:
    """Lazily wired steps; each attribute is the table after one step."""

    def __init__(
        self,
        raw: DataFrame,
        cal: CycleCalendar,
        clip: tuple[date, date],
        lower: float = 0.01,
        upper: float = 0.99,
        level: float = 0.95,
        warehouses: DataFrame | None = None,
        stage_lines: bool = True,
    ):
        """``stage_lines=False`` skips the first table: for a source of typed columns, cheap to read again."""
        self.spark = raw.sparkSession
        self.area = StagingArea(self.spark)
        self.raw = raw
        self.cal = cal
        self.clip = clip
        self.lower = lower
        self.upper = upper
        self.level = level
        self.warehouses = warehouses
        self.stage_lines = stage_lines

    @cached_property
    def typed(self) -> DataFrame:
        """Parsed lines, still with those that have no date."""
        return clean.parse_demand(clean.parse_dates(self.raw))

    @cached_property
    def lines(self) -> DataFrame:
        return self.area.stage(self.typed, "order_lines") if self.stage_lines else self.typed

    @property
    def clipped_in_passing(self) -> DataFrame:
        """The same lines as ``clipped`` without staging: for a step that reads them once."""
        return clean.clip_date_range(clean.drop_missing_dates(self.typed), *self.clip)

    @cached_property
    def clipped(self) -> DataFrame:
        return clean.clip_date_range(clean.drop_missing_dates(self.lines), *self.clip)

    @cached_property
    def bounds(self) -> DataFrame:
        bounds = outliers.outlier_bounds(self.clipped, self.lower, self.upper, self.area)
        return self.area.stage(bounds, "outlier_bounds")

    @cached_property
    def clean(self) -> DataFrame:
        """Lines inside the outlier bounds: the input of every later step."""
        return outliers.trim_outliers(self.clipped, self.bounds).select(*self.raw.columns)

    @cached_property
    def daily(self) -> DataFrame:
        return self.area.stage(calendar.daily_demand(self.clean), "daily_demand")

    @cached_property
    def benchmark(self) -> DataFrame:
        return benchmark.benchmark_4wk(self.daily)

    @cached_property
    def point_forecast(self) -> DataFrame:
        return forecast.daily_forecast(self.daily, self.cal, self.warehouses)

    @cached_property
    def forecast(self) -> DataFrame:
        """The published forecast with its bounds."""
        return intervals.forecast_with_interval(self.daily, self.cal, self.warehouses, self.level)

    @cached_property
    def compared(self) -> DataFrame:
        """Actuals from the recent window to the end of the target, against the forecast."""
        return series.actual_vs_forecast(self.daily, self.forecast, self.cal)

    @cached_property
    def accuracy(self) -> DataFrame:
        return accuracy.accuracy_base(self.daily, self.forecast, self.cal)

    def release(self) -> None:
        """Delete what this run wrote to the shared folder; results have to be saved before."""
        self.area.release()
