"""Profiles of the order lines: what is there, what is missing, how it is spread."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercast.functions.numeric import safe_ratio
from ordercast.functions.seeded import hash_order
from ordercast.operators.quantiles import quantiles_of, value_histogram


def distinct_counts(lines: DataFrame) -> DataFrame:
    """Distinct non-null values per column.

    Lines become (column, value) pairs, deduplicated map-side before they are shuffled, so every
    column is counted in one pass and no task holds a column's value set.
    """
    texts = lines.select(*[F.col(c).cast("string").alias(c) for c in lines.columns])
    pairs = texts.unpivot([], texts.columns, "column_name", "value").distinct()
    return pairs.groupBy("column_name").agg(F.count("value").alias("n_distinct"))


def distinct_sketches(lines: DataFrame, lg_k: int = 14) -> DataFrame:
    """(column_name, sketch): a mergeable sketch of each column's distinct values.

    One pass in which tasks send a few kilobytes per column, where :func:`distinct_counts` sends the
    values themselves. Sketches of different days or runs can be kept (:func:`write_sketches`) and united
    (:func:`sketched_counts`). The standard error is 1.04 / sqrt(2 ** ``lg_k``), 0.8% by default.
    """
    texts = [F.col(c).cast("string") for c in lines.columns]
    sketches = lines.agg(*[F.hll_sketch_agg(t, lg_k).alias(c) for t, c in zip(texts, lines.columns)])
    return sketches.unpivot([], lines.columns, "column_name", "sketch")


def write_sketches(sketches: DataFrame, path: str, run_date: date) -> None:
    """Keep a run's sketches under its date; a run that is repeated replaces its own."""
    dated = sketches.withColumn("run_date", F.lit(run_date))
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_date").parquet(path)


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """Estimated distinct non-null values per column over all given sketches together."""
    united = sketches.groupBy("column_name").agg(F.hll_union_agg("sketch").alias("sketch"))
    return united.select("column_name", F.hll_sketch_estimate("sketch").alias("n_distinct"))


def null_counts(lines: DataFrame) -> DataFrame:
    """Nulls per column, in one pass. For parsed columns this includes what could not be parsed."""
    counts = lines.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in lines.columns])
    return counts.unpivot([], lines.columns, "column_name", "n_null")


def frequency_table(lines: DataFrame, column: str) -> DataFrame:
    """Lines per non-null value."""
    return (
        lines.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )


def missing_volume_share(lines: DataFrame) -> DataFrame:
    """Demand on lines without a date over all demand."""
    dateless = F.when(F.col("Date").isNull(), F.col("Order_Demand"))
    return lines.agg(
        safe_ratio(F.coalesce(F.sum(dateless), F.lit(0.0)), F.sum("Order_Demand")).alias("missing_share")
    )


def demand_summary(lines: DataFrame, column: str = "Order_Demand") -> DataFrame:
    """Min, quartiles, mean, max and null count as one row.

    The histogram behind the quartiles, a row per bucket, gives the other measures too. At most six of its buckets are
    looked into; nothing is written.
    """
    histogram = value_histogram(lines, [], column)
    known = F.when(F.col("_b").isNotNull(), F.col("_n"))
    moments = histogram.agg(
        F.min("_low").alias("min"),
        safe_ratio(F.sum("_sum"), F.sum(known)).alias("mean"),
        F.max("_high").alias("max"),
        F.coalesce(F.sum(F.when(F.col("_b").isNull(), F.col("_n"))), F.lit(0)).alias("n_null"),
    )
    quartiles = quantiles_of(histogram, lines, [], column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, None)
    names = ["min", "q1", "median", "mean", "q3", "max", "n_null"]
    both = moments.unionByName(quartiles, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in names])


def shape(lines: DataFrame) -> DataFrame:
    """Column names, types and the row count."""
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"), F.lit(kind).alias("type"))
            for i, (name, kind) in enumerate(lines.dtypes, start=1)
        ]
    )
    counted = lines.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.inline(columns), "n_rows")


def preview(lines: DataFrame, n: int = 6, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` lines; ordered, because a distributed table has no first rows of its own."""
    return lines.orderBy(*(order_by or lines.columns)).limit(n)


def sample_rows(lines: DataFrame, n: int = 5, seed: int = 1234) -> DataFrame:
    """``n`` random lines without replacement, the same ones for the same seed."""
    return lines.orderBy(hash_order(seed, *[F.col(c) for c in lines.columns]), *lines.columns).limit(n)
