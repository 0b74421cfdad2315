"""Typing, calendar columns and row selection on order lines. All row-wise: no shuffle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordercast.functions.seeded import hash_choice, hash_normal
from ordercast.functions.text import finite, parse_accounting_number, parse_date


def parse_dates(lines: DataFrame) -> DataFrame:
    """Text dates to dates; a source that has dates or timestamps keeps their day."""
    day = F.col("Date")
    is_text = isinstance(lines.schema["Date"].dataType, T.StringType)
    return lines.withColumn("Date", parse_date(day) if is_text else day.cast("date"))


def parse_demand(lines: DataFrame) -> DataFrame:
    """Text quantities to numbers; a source that has numbers keeps them, if they are finite."""
    quantity = F.col("Order_Demand")
    is_text = isinstance(lines.schema["Order_Demand"].dataType, T.StringType)
    return lines.withColumn("Order_Demand", parse_accounting_number(quantity) if is_text else finite(quantity.cast("double")))


def calendar_features(lines: DataFrame) -> DataFrame:
    """Month, year, first of month, day of week (1 = Sunday) and ISO week label."""
    day = F.col("Date")
    return lines.withColumns(
        {
            "Month": F.month(day),
            "Year": F.year(day),
            "Month_Year": F.trunc(day, "MM"),
            "DOW": F.dayofweek(day),
            "The_Week": iso_week(day),
        }
    )


def iso_week(day):
    """Two-character ISO week label; it carries no year, so group it within a cycle."""
    return F.lpad(F.weekofyear(day).cast("string"), 2, "0")


def attach_category_volume(lines: DataFrame, seed: int = 1234, mean: float = 2.0, sd: float = 0.5) -> DataFrame:
    """One made-up cubic volume per category, about Normal(2, 0.5).

    The draw depends on the category and the seed alone, so it needs neither a distinct pass nor
    a join to be the same on every line of a category.
    """
    return lines.withColumn("Cubic_Volume", hash_normal(mean, sd, seed, F.col("Product_Category")))


def category_volumes(lines: DataFrame, seed: int = 1234, mean: float = 2.0, sd: float = 0.5) -> DataFrame:
    """The dimension behind ``attach_category_volume``: one row per category."""
    return attach_category_volume(lines.select("Product_Category").distinct(), seed, mean, sd)


def assign_destination(lines: DataFrame, n: int = 8, seed: int = 1234) -> DataFrame:
    """One of ``Dest_1..Dest_n`` per line, uniform. Identical lines share their label."""
    keys = [F.col(c) for c in ("Product_Code", "Warehouse", "Product_Category", "Date", "Order_Demand")]
    return lines.withColumn("Dest", F.concat(F.lit("Dest_"), hash_choice(n, f"{seed}:dest", *keys)))


def lookup_lines(lines: DataFrame, product: str, warehouse: str, category: str, day: date) -> DataFrame:
    return lines.where(
        (F.col("Product_Code") == product)
        & (F.col("Warehouse") == warehouse)
        & (F.col("Product_Category") == category)
        & (F.col("Date") == F.lit(day))
    )


def drop_missing_dates(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("Date").isNotNull())


def missing_dates(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("Date").isNull())


def clip_date_range(lines: DataFrame, after: date, before: date) -> DataFrame:
    """Dates strictly between the two bounds."""
    return lines.where((F.col("Date") > F.lit(after)) & (F.col("Date") < F.lit(before)))
