import math

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ordercast.functions.joins import match_join
from ordercast.functions.numeric import (
    abs_pct_error,
    if_else,
    normal_quantile,
    safe_ratio,
    strict_sd,
    strict_sum,
    total_or_zero,
)
from ordercast.functions.seeded import hash_choice, hash_normal, hash_uniform
from ordercast.functions.text import parse_accounting_number, parse_date


@pytest.mark.parametrize(
    "forecast, actual, expected",
    [(5.0, 0.0, 1.0), (0.0, 0.0, 0.0), (None, 3.0, 0.0), (3.0, None, 0.0), (3.0, -4.0, 1.75), (8.0, 10.0, 0.2)],
)
def test_error_relative_to_actual(spark, forecast, actual, expected):
    df = spark.createDataFrame([(forecast, actual)], "f double, a double")
    assert df.select(abs_pct_error(F.col("f"), F.col("a"))).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize(
    "forecast, actual, expected",
    [(0.0, 5.0, 1.0), (0.0, 0.0, 0.0), (None, 3.0, 0.0), (-4.0, 4.0, -2.0), (8.0, 10.0, 0.25)],
)
def test_error_relative_to_forecast(spark, forecast, actual, expected):
    df = spark.createDataFrame([(forecast, actual)], "f double, a double")
    error = abs_pct_error(F.col("f"), F.col("a"), "forecast")
    assert df.select(error).first()[0] == pytest.approx(expected)


def test_unknown_denominator_is_refused():
    with pytest.raises(ValueError):
        abs_pct_error(F.lit(1), F.lit(1), "sales")


def test_ratio_is_null_where_undefined(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, 4.0)], "n double, d double")
    assert [r[0] for r in df.select(safe_ratio(F.col("n"), F.col("d"))).collect()] == [None, None, None, 0.25]


def test_sums_and_sd_with_nulls(spark):
    df = spark.createDataFrame(
        [("all", 1.0), ("all", 3.0), ("gap", 1.0), ("gap", None), ("none", None), ("one", 7.0)],
        "k string, v double",
    )
    got = df.groupBy("k").agg(
        total_or_zero(F.col("v")).alias("total"),
        strict_sum(F.col("v")).alias("strict"),
        strict_sd(F.col("v")).alias("sd"),
    )
    assert rows_of(got) == [
        ("all", 4.0, 4.0, pytest.approx(math.sqrt(2))),
        ("gap", 1.0, None, None),
        ("none", 0.0, None, None),
        ("one", 7.0, 7.0, None),
    ]


def test_unknown_condition_gives_null(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    got = [r[0] for r in df.select(if_else(F.col("c"), F.lit("y"), F.lit("n"))).collect()]
    assert got == ["y", "n", None]


def test_normal_quantile():
    assert normal_quantile(0.95) == pytest.approx(1.6448536269514715, abs=1e-15)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("100", 100.0), (" 100 ", 100.0), ("(1000)", -1000.0), (" (5) ", -5.0), ("1e3", 1000.0), ("2.", 2.0),
        ("abc", None), ("", None), (None, None), ("100d", None), ("7f", None), ("NaN", None), ("Infinity", None),
        ("1(0)", None), ("0x1A", None),
    ],
)
def test_accounting_numbers(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_accounting_number(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2012/10/12", "2012-10-12"), ("2012/7/27", "2012-07-27"), (" 2012/7/27 ", "2012-07-27"), ("NA", None),
        ("", None), (None, None), ("2012/13/01", None), ("2012/02/30", None), ("2012/7", None), ("2012", None),
        ("2012-07-27", None), ("2012/7/27x", None), ("2012/2/29", "2012-02-29"),
    ],
)
def test_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(parse_date(F.col("t"))).first()[0]
    assert (got.isoformat() if got else None) == expected


def test_null_keys_match(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20), ("c", 30)], "k string, y int")
    assert rows_of(match_join(left, right, ["k"])) == [("a", 1, 10), (None, 2, 20)]
    assert rows_of(match_join(left, right, ["k"], "left")) == [("a", 1, 10), ("b", 3, None), (None, 2, 20)]
    assert rows_of(match_join(left, right, ["k"], "full")) == [
        ("a", 1, 10), ("b", 3, None), ("c", None, 30), (None, 2, 20),
    ]


def test_seeded_draws_are_repeatable_and_well_spread(spark):
    df = spark.range(20000).withColumns(
        {
            "u": hash_uniform(1, F.col("id")),
            "n": hash_normal(2.0, 0.5, 1, F.col("id")),
            "c": hash_choice(8, 1, F.col("id")),
        }
    )
    stats = df.agg(F.avg("u"), F.avg("n"), F.stddev("n"), F.min("u"), F.max("u")).first()
    assert stats[0] == pytest.approx(0.5, abs=0.01)
    assert stats[1] == pytest.approx(2.0, abs=0.02)
    assert stats[2] == pytest.approx(0.5, abs=0.02)
    assert 0 < stats[3] and stats[4] < 1
    sizes = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    assert set(sizes) == set(range(1, 9)) and min(sizes.values()) > 2200
    assert rows_of(df.where("id < 50")) == rows_of(df.repartition(17).where("id < 50"))
