"""Exact interpolated quantiles per group, without holding a group in one place.

Sorting a group, or keeping its value-to-count map, puts the whole group on one task. Here the
group is narrowed down first:

1. count lines per (group, value bucket) - a histogram of bounded width, combined map-side;
2. running counts over the histogram tell which buckets hold the wanted ranks, at most two per
   quantile; count the distinct values of those buckets;
3. cut each of these buckets into slices, find the slices that hold the ranks in the same way, and
   read the order statistics off the running counts of their values.

The source is scanned twice, whatever the values are. Lines whose (group, bucket) is not wanted are
dropped before anything is shuffled, by a bitmap of the wanted pairs (see ``functions/pair_filter``); the
others are counted per value before they move. So what is shuffled are partial counts, and a group that
holds a third of all lines costs no more than its histogram and its distinct values near the wanted
ranks. The result is exact: the bitmap may let a line pass, the join with the pairs decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercast.functions.joins import match_join
from ordercast.functions.pair_filter import perhaps_in
from ordercast.plans.staging import StagingArea

# Buckets per unit of ln(1 + |value|): 16 makes a bucket about 6% wide. Coarse, so that groups of a
# few thousand lines have few buckets too; at most 2 * 710 * 16 cover every double.
_RESOLUTION = 16
_LN_MAX = 710.0

# How many finer buckets a crowded bucket is cut into.
_SLICES = 4096


def _bucket(value: Column) -> Column:
    """A whole number that never decreases as ``value`` grows."""
    size = F.least(F.log1p(F.abs(value)), F.lit(_LN_MAX)) * _RESOLUTION
    return (F.signum(value) * F.floor(size)).cast("int")


def _slice(value: Column, low: Column, high: Column) -> Column:
    """Which of the equal slices of [low, high] a value is in; never decreases as it grows."""
    place = F.floor(F.try_divide(value - low, high - low) * _SLICES).cast("int")
    return F.when(value == high, _SLICES).otherwise(place)


def _position(total: Column, prob: float) -> Column:
    """1-based fractional rank of the quantile among ``total`` sorted values."""
    return F.lit(1.0) + (total - 1) * F.lit(prob)


def _holds_a_rank(probs: Mapping[str, float]) -> Column:
    wanted = F.lit(False)
    for prob in probs.values():
        at = _position(F.col("_total"), prob)
        for rank in (F.floor(at), F.ceil(at)):
            wanted = wanted | ((rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_n")))
    return wanted


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    area: StagingArea | None = None,
) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name -> probability).

    Linear interpolation between the two neighbouring order statistics; nulls are left out. With no
    keys the whole table is the group. The chosen buckets, a few rows per group, are written to ``area``.
    """
    area = area or StagingArea(df.sparkSession)
    return quantiles_of(value_histogram(df, keys, value), df, keys, value, probs, area)


def value_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group and value bucket: number, sum, smallest and largest of the values. Nulls have a null bucket."""
    group = list(keys) or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(1))
    values = source.select(*group, F.col(value).alias("_v")).withColumn("_b", _bucket(F.col("_v")))
    return values.groupBy(*group, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_sum"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )


def quantiles_of(
    histogram: DataFrame,
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    area: StagingArea | None,
) -> DataFrame:
    """:func:`group_quantiles` from a histogram that is already there; without ``area`` nothing is written."""
    keys = list(keys)
    group = keys or ["_all"]
    in_group = Window.partitionBy(*group)
    upwards = in_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = (
        histogram.where(F.col("_b").isNotNull())
        .withColumn("_before", F.sum("_n").over(upwards) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(in_group))
    )
    # At most two rows per group and quantile; written so that its size is known to the planner.
    buckets = running.where(_holds_a_rank(probs)).select(*group, "_b", "_low", "_high", "_before", "_total")
    if area:
        buckets = area.stage(buckets, "quantile_buckets")

    source = df if keys else df.withColumn("_all", F.lit(1))
    values = source.select(*group, F.col(value).alias("_v")).withColumn("_b", _bucket(F.col("_v")))
    if keys:
        wanted = perhaps_in(buckets, [*group, "_b"])
    else:  # a few numbers
        wanted = F.array_contains(buckets.agg(F.collect_set("_b")).scalar(), F.col("_b"))
    counted = values.where(wanted).groupBy(*group, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    candidates = match_join(counted, buckets, [*group, "_b"])
    # Used twice below: Spark shuffles the counts once and reuses the exchange.
    candidates = candidates.withColumn("_s", _slice(F.col("_v"), F.col("_low"), F.col("_high")))

    in_bucket = Window.partitionBy(*group, "_b").orderBy("_s")
    in_bucket = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = (
        candidates.groupBy(*group, "_b", "_s", F.col("_before").alias("_outer"), "_total")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_before", F.col("_outer") + F.sum("_n").over(in_bucket) - F.col("_n"))
        .where(_holds_a_rank(probs))
        .select(*group, "_b", "_s", F.col("_before").alias("_base"))
    )
    in_slice = Window.partitionBy(*group, "_b", "_s").orderBy("_v")
    in_slice = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        match_join(candidates, slices, [*group, "_b", "_s"])
        .withColumn("_upto", F.col("_base") + F.sum("_n").over(in_slice))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
    )

    def value_at(rank: Column) -> Column:
        here = (rank > F.col("_from")) & (rank <= F.col("_upto"))
        return F.max(F.when(here, F.col("_v")))

    picks = [F.max("_total").alias("_total")]
    for name, prob in probs.items():
        at = _position(F.col("_total"), prob)
        picks += [
            value_at(F.floor(at)).alias(f"_lo_{name}"),
            value_at(F.ceil(at)).alias(f"_hi_{name}"),
        ]
    picked = ranked.groupBy(*group).agg(*picks)

    def interpolated(name: str, prob: float) -> Column:
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        at = _position(F.col("_total"), prob)
        part = at - F.floor(at)
        # Equal neighbours are returned as they are: blending them could move the bound by one
        # bit and flag tied values.
        return F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi).alias(name)

    return picked.select(*keys, *[interpolated(n, p) for n, p in probs.items()])
