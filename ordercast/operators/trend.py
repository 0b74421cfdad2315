"""Demand over time: totals, variation, weekday profile and a smooth trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercast.functions.numeric import safe_ratio, total_or_zero


def daily_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("Date").agg(F.sum("Order_Demand").alias("orders"))


def monthly_totals(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Demand per first of month, overall or per ``by``."""
    return lines.groupBy(*by, F.trunc("Date", "MM").alias("Month_Year")).agg(
        total_or_zero(F.col("Order_Demand")).alias("orders")
    )


def warehouse_cv(warehouse_months: DataFrame) -> DataFrame:
    """Mean, sample sd and coefficient of variation of each warehouse's months."""
    return (
        warehouse_months.groupBy("Warehouse")
        .agg(F.avg("orders").alias("m"), F.stddev_samp("orders").alias("s"))
        .withColumn("cv", safe_ratio(F.col("s"), F.col("m")))
    )


def monthly_dow_share(lines: DataFrame, weekends: bool = True) -> DataFrame:
    """Demand per month and weekday with its share of the month.

    Without weekends the share is still of the whole month, so weekdays do not add up to 1.
    """
    in_month = Window.partitionBy("Month_Year")
    shares = (
        lines.groupBy(F.trunc("Date", "MM").alias("Month_Year"), F.dayofweek("Date").alias("DOW"))
        .agg(F.sum("Order_Demand").alias("orders"))
        .withColumn("pct", safe_ratio(F.col("orders"), F.sum("orders").over(in_month)))
    )
    return shares if weekends else shares.where(~F.col("DOW").isin(1, 7))


def _boxes(shares: DataFrame) -> DataFrame:
    """Hinges and the inner-fence bounds of each weekday, with its months as an array.

    A weekday has one member per calendar month, so the array is as long as the table has months.
    """
    months = F.collect_list(F.struct("Month_Year", "pct"))
    hinges = F.percentile("pct", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return (
        shares.where(F.col("pct").isNotNull())
        .groupBy("DOW")
        .agg(hinges.alias("_h"), months.alias("_months"))
        .select(
            "DOW",
            F.get("_h", F.lit(0)).alias("q1"),
            F.get("_h", F.lit(1)).alias("median"),
            F.get("_h", F.lit(2)).alias("q3"),
            "_months",
        )
        .withColumn("_low", F.col("q1") - reach)
        .withColumn("_high", F.col("q3") + reach)
    )


def _outside(month: Column) -> Column:
    return (month["pct"] < F.col("_low")) | (month["pct"] > F.col("_high"))


def dow_box_stats(shares: DataFrame) -> DataFrame:
    """Box-plot numbers per weekday: hinges, whiskers (most extreme value within 1.5 IQR), outliers."""
    inside = F.transform(F.filter("_months", lambda m: ~_outside(m)), lambda m: m["pct"])
    return _boxes(shares).select(
        "DOW",
        F.array_min(inside).alias("whisker_low"),
        "q1",
        "median",
        "q3",
        F.array_max(inside).alias("whisker_high"),
        F.size(F.filter("_months", _outside)).cast("bigint").alias("n_outliers"),
    )


def dow_box_outliers(shares: DataFrame) -> DataFrame:
    """The months beyond the whiskers, one row each."""
    return _boxes(shares).select("DOW", F.inline(F.filter("_months", _outside)))


def monthly_trend(months: DataFrame, by: Sequence[str] = (), span: float = 0.75) -> DataFrame:
    """Smooth trend of monthly totals: a local quadratic fit, evaluated at each month.

    Each month is fitted to its nearest ``floor(span * n)`` months of the same series with tricube
    weights. A series has one point per calendar month, so it travels with each of its points as a
    short array; the 3x3 normal equations are solved by column expressions. Null where fewer than
    three months carry weight.
    """
    day = F.unix_date("Month_Year").cast("double")
    series = Window.partitionBy(*(by or [F.lit(1)]))
    points = months.withColumn("_x", day).withColumn(
        "_points", F.collect_list(F.struct(F.col("_x").alias("x"), F.col("orders").alias("y"))).over(series)
    )
    near = F.greatest(F.floor(F.size("_points") * span + 1e-5).cast("int"), F.lit(1))
    distances = F.array_sort(F.transform("_points", lambda p: F.abs(p["x"] - F.col("_x"))))
    points = points.withColumn("_reach", F.get(distances, near - 1))

    def weigh(p: Column) -> Column:
        u = (p["x"] - F.col("_x")) / F.col("_reach")
        cube = F.abs(u) * F.abs(u) * F.abs(u)
        left = 1 - cube
        return F.struct(u.alias("u"), p["y"].alias("y"), (left * left * left).alias("w"))

    inner = F.filter("_points", lambda p: F.abs(p["x"] - F.col("_x")) < F.col("_reach"))
    points = points.withColumn("_local", F.transform(inner, weigh))

    def moment(term) -> Column:
        return F.aggregate("_local", F.lit(0.0), lambda acc, p: acc + term(p))

    sums = {
        "_s0": moment(lambda p: p["w"]),
        "_s1": moment(lambda p: p["w"] * p["u"]),
        "_s2": moment(lambda p: p["w"] * p["u"] * p["u"]),
        "_s3": moment(lambda p: p["w"] * p["u"] * p["u"] * p["u"]),
        "_s4": moment(lambda p: p["w"] * p["u"] * p["u"] * p["u"] * p["u"]),
        "_t0": moment(lambda p: p["w"] * p["y"]),
        "_t1": moment(lambda p: p["w"] * p["u"] * p["y"]),
        "_t2": moment(lambda p: p["w"] * p["u"] * p["u"] * p["y"]),
    }
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in sums)
    minor0, minor1, minor2 = s2 * s4 - s3 * s3, s1 * s4 - s2 * s3, s1 * s3 - s2 * s2
    top = t0 * minor0 - t1 * minor1 + t2 * minor2
    bottom = s0 * minor0 - s1 * minor1 + s2 * minor2
    fitted = F.when(F.size("_local") >= 3, safe_ratio(top, bottom))
    return points.withColumns(sums).select(*by, "Month_Year", "orders", fitted.alias("trend"))
