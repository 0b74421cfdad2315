import datetime as dt

import numpy as np
import pytest

from conftest import rows_of
from ordercast.operators import trend

D = dt.date


def test_totals(lines):
    df = lines(
        [("p", "a", "c", "2016-01-04", 1.0), ("q", "a", "c", "2016-01-04", 2.0), ("p", "b", "c", "2016-01-20", 4.0),
         ("p", "b", "c", "2016-02-01", 8.0)]
    )
    assert rows_of(trend.daily_totals(df)) == [(D(2016, 1, 20), 4.0), (D(2016, 1, 4), 3.0), (D(2016, 2, 1), 8.0)]
    assert rows_of(trend.monthly_totals(df)) == [(D(2016, 1, 1), 7.0), (D(2016, 2, 1), 8.0)]
    by_wh = trend.monthly_totals(df, ["Warehouse"])
    assert rows_of(trend.warehouse_cv(by_wh)) == [
        ("a", 3.0, None, None),
        ("b", 6.0, pytest.approx(8**0.5), pytest.approx(8**0.5 / 6)),
    ]


def test_weekday_share_is_of_the_whole_month(lines):
    df = lines([("p", "a", "c", "2016-01-03", 1.0), ("p", "a", "c", "2016-01-04", 3.0)])
    assert rows_of(trend.monthly_dow_share(df), "DOW", "pct") == [(1, 0.25), (2, 0.75)]
    assert rows_of(trend.monthly_dow_share(df, weekends=False), "DOW", "pct") == [(2, 0.75)]


def test_box_stats(spark):
    values = [0.10, 0.11, 0.12, 0.13, 0.14, 0.15, 0.50, 0.0]
    rows = [(D(2016, i + 1, 1), 2, v) for i, v in enumerate(values)] + [(D(2016, 1, 1), 3, 0.2), (D(2016, 2, 1), 3, None)]
    shares = spark.createDataFrame(rows, "Month_Year date, DOW int, pct double")
    stats = {r["DOW"]: r for r in trend.dow_box_stats(shares).collect()}
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert tuple(stats[2])[1:] == (
        min(inside), pytest.approx(q1), pytest.approx(q2), pytest.approx(q3), max(inside), len(values) - len(inside),
    )
    assert tuple(stats[3])[1:] == (0.2, 0.2, 0.2, 0.2, 0.2, 0)
    assert rows_of(trend.dow_box_outliers(shares)) == [(2, D(2016, 7, 1), 0.5), (2, D(2016, 8, 1), 0.0)]


def _local_fit(x, y, span=0.75):
    out = []
    n = len(x)
    for x0 in x:
        d = np.abs(x - x0)
        reach = np.sort(d)[max(int(np.floor(n * span + 1e-5)), 1) - 1]
        near = d < reach
        if near.sum() < 3:
            out.append(None)
            continue
        w = (1 - (d[near] / reach) ** 3) ** 3
        # polyfit squares its weights.
        out.append(np.polyfit((x[near] - x0) / reach, y[near], 2, w=np.sqrt(w))[2])
    return out


def test_trend_equals_weighted_polynomial_fit(spark):
    rng = np.random.default_rng(5)
    months = [D(2012 + i // 12, i % 12 + 1, 1) for i in range(40)]
    series = {"long": (months, rng.normal(100, 20, 40)), "short": (months[:6], rng.normal(5, 1, 6)),
              "two": (months[:2], np.array([1.0, 2.0])), "one": (months[:1], np.array([1.0]))}
    rows = [(k, m, float(v)) for k, (ms, vs) in series.items() for m, v in zip(ms, vs)]
    df = spark.createDataFrame(rows, "Warehouse string, Month_Year date, orders double")
    got = {(r["Warehouse"], r["Month_Year"]): r["trend"] for r in trend.monthly_trend(df, ["Warehouse"]).collect()}
    assert len(got) == len(rows)
    for k, (ms, vs) in series.items():
        x = np.array([(m - D(2012, 1, 1)).days for m in ms], dtype=float)
        for m, fit in zip(ms, _local_fit(x, vs)):
            assert got[k, m] == (None if fit is None else pytest.approx(fit, rel=1e-7))
    overall = trend.monthly_trend(df.where("Warehouse = 'long'").drop("Warehouse"))
    assert {r["Month_Year"]: r["trend"] for r in overall.collect()} == {
        m: pytest.approx(got["long", m]) for m in months
    }
