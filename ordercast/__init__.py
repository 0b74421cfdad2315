"""Demand planning on Spark: clean order lines, forecast every publication cycle, measure accuracy."""

from ordercast.operators.calendar import CycleCalendar, date_framework
from ordercast.plans.demand_plan import DemandPlan
from ordercast.sources.orders import read_forecast, read_orders, write_forecast

__all__ = ["CycleCalendar", "DemandPlan", "date_framework", "read_forecast", "read_orders", "write_forecast"]
