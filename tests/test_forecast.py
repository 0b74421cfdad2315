import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from by_hand import Cycle, days, dow
from conftest import rows_of
from ordercast import CycleCalendar
from ordercast.functions.numeric import strict_sd
from ordercast.operators import accuracy, benchmark, calendar, drift, forecast, intervals, series

D = dt.date
CAL = CycleCalendar(D(2016, 1, 4), n_cycles=9)
WAREHOUSES = ["a", "b", "c", None]


@pytest.fixture(scope="module")
def demand():
    """Three years with gaps: b never ships on Sundays before 2016, c only opens in 2016, None is unnamed."""
    rng = random.Random(3)
    out = {}
    for day in days(D(2014, 6, 1), D(2016, 9, 30)):
        if day.month != 8 and rng.random() < 0.9:
            out["a", day] = float(rng.randint(50, 150))
        if dow(day) != 1 or day >= D(2016, 2, 1):
            out["b", day] = float(rng.randint(-5, 60))
        if day >= D(2016, 1, 20) and dow(day) in (2, 5):
            out["c", day] = float(rng.randint(1, 20))
        if rng.random() < 0.3:
            out[None, day] = float(rng.randint(1, 9))
    return out


@pytest.fixture(scope="module")
def table(spark, demand):
    rows = [(w, d, v) for (w, d), v in demand.items()]
    return spark.createDataFrame(rows, "Warehouse string, Date date, demand double").repartition(5).cache()


@pytest.fixture(scope="module")
def cycles(demand):
    return [Cycle(demand, CAL, i, WAREHOUSES) for i in range(1, CAL.last_cycle + 1)]


@pytest.fixture(scope="module")
def published(table):
    return intervals.forecast_with_interval(table, CAL).cache()


def _approx(value):
    return None if value is None else pytest.approx(value, rel=1e-9, abs=1e-6)


def _same(got, expected):
    assert set(got) == set(expected)
    for key, value in expected.items():
        value = value if isinstance(value, tuple) else (value,)
        assert got[key] == tuple(_approx(v) for v in value), key


def test_forecast_equals_by_hand(table, cycles):
    got = {tuple(r)[:4]: (r[4],) for r in forecast.daily_forecast(table, CAL).collect()}
    _same(got, {(c.id, w, d, k): v for c in cycles for (w, d, k), v in c.forecast().items()})


def test_interval_equals_by_hand(published, cycles):
    rows = published.collect()
    got = {tuple(r)[:4]: tuple(r)[4:] for r in rows}
    assert len(got) == len(rows)
    _same(got, {(c.id, w, d, k): v for c in cycles for (w, d, k), v in c.with_interval().items()})
    # The cases that matter are all there.
    assert any(r["Fcast_Date"] is None for r in rows)
    assert any(r["Lower"] == 0.0 and r["Upper"] > 0 for r in rows)
    assert any(r["Fcast_Volume"] == 0.0 and r["Lower"] is None for r in rows)
    for r in rows:
        if r["Upper"] is not None and r["Fcast_Volume"] >= 0:
            assert r["Lower"] <= r["Fcast_Volume"] <= r["Upper"]


def test_first_cycles_have_no_bounds(published):
    assert published.where("cycle_id <= 6 and (Lower is not null or Upper is not null)").count() == 0
    assert published.where("cycle_id > 6 and Lower is not null").count() > 0


def test_listed_warehouses(spark, table, demand):
    listed = spark.createDataFrame([("a",), ("new",)], "Warehouse string")
    got = {
        tuple(r)[:4]: tuple(r)[4:] for r in intervals.forecast_with_interval(table, CAL, listed).collect()
    }
    expected = {}
    for i in range(1, CAL.last_cycle + 1):
        cycle = Cycle(demand, CAL, i, ["a", "new"])
        expected |= {(i, w, d, k): v for (w, d, k), v in cycle.with_interval().items()}
    _same(got, expected)


def test_spread_is_that_of_the_errors(table, cycles):
    errors = intervals.calibration_error(table, CAL)
    got = {tuple(r)[:3]: (r[3],) for r in intervals.error_sd(errors).collect()}
    _same(got, {(c.id, w, k): v for c in cycles for (w, k), v in c.spreads().items()})
    assert any(v == (None,) for v in got.values())
    unmatched = errors.where("Fcast_Volume is null")
    assert unmatched.count() > 0 and unmatched.where("Variance is not null").count() == 0


def test_volume_is_preserved(table):
    """With no returns, the forecast adds up to last year's volume grown."""
    total = forecast.daily_forecast(table, CAL).groupBy("cycle_id").agg(F.sum("Fcast_Volume").alias("f"))
    both = total.join(forecast.expected_volume(table, CAL), "cycle_id").collect()
    assert len(both) == CAL.last_cycle
    for r in both:
        assert r["f"] == pytest.approx(r["expected_volume"])
        assert r["expected_growth"] == pytest.approx(r["growth"])


def test_shares_add_up(table):
    per_wh = forecast.dow_curve(table, CAL).groupBy("cycle_id", "Warehouse").agg(F.sum("pct_orders").alias("s"))
    per_cycle = forecast.warehouse_share(table, CAL).groupBy("cycle_id").agg(F.sum("pct_orders").alias("s"))
    for r in per_wh.collect() + per_cycle.collect():
        assert r["s"] == pytest.approx(1.0)


@pytest.mark.parametrize("partitions", [1, 17])
def test_partitioning_does_not_matter(table, published, partitions):
    again = intervals.forecast_with_interval(table.repartition(partitions), CAL)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in again.collect()}
    _same(got, {tuple(r)[:4]: tuple(r)[4:] for r in published.collect()})


def test_no_history_gives_null_growth_and_zero_forecast(daily):
    df = daily([("a", D(2016, 1, 4), 5), ("a", D(2015, 12, 21), 7)])
    cal = CycleCalendar(D(2016, 1, 4), n_cycles=0)
    growth = forecast.yoy_growth(df, cal).collect()
    assert [tuple(r) for r in growth] == [(1, 7.0, 0.0, None)]
    assert forecast.expected_volume(df, cal).first()["expected_volume"] is None
    assert rows_of(forecast.daily_forecast(df, cal).select("Fcast_Volume").distinct()) == [(0.0,)]
    assert forecast.daily_forecast(df, cal).count() == 70


def test_calibration_forecast_is_not_filled(daily):
    """Only Mondays have volume: other weekdays stay as rows without a warehouse."""
    year = [D(2014, 10, 6) + dt.timedelta(7 * i) for i in range(80)]
    df = daily([("a", d, 10) for d in year])
    cal = CycleCalendar(D(2016, 1, 4), n_cycles=0)
    got = intervals.calibration_forecast(df, cal)
    assert got.where("Warehouse = 'a'").select("DOW").distinct().collect()[0]["DOW"] == 2
    assert got.where("Warehouse is null").count() == 60 and got.count() == 70
    assert got.where("Warehouse is null and Fcast_Volume is not null").count() == 0


def test_unnamed_warehouse_on_a_weekday_nobody_ships_on(daily):
    demand = {("a", D(2014, 6, 2) + dt.timedelta(7 * i)): 10.0 + i for i in range(110)}
    demand |= {(None, D(2016, 1, 5)): 3.0, ("a", D(2016, 1, 6)): 4.0}
    df = daily([(w, d, v) for (w, d), v in demand.items()])
    cycle = Cycle(demand, CAL, 7, ["a", None])
    assert set(cycle.calibration().spreads()) == {("a", 2), ("a", None), (None, 3)}
    got = {tuple(r)[1:4]: tuple(r)[4:] for r in intervals.forecast_with_interval(df, CAL).where("cycle_id = 7").collect()}
    _same(got, cycle.with_interval())
    errors = intervals.error_sd(intervals.calibration_error(df, CAL)).where("cycle_id = 1")
    assert set(rows_of(errors, "Warehouse", "DOW")) == set(cycle.calibration().spreads())


def test_naive_forecast_is_exactly_four_weeks_old(daily):
    df = daily([("a", "2016-01-04", 5), ("a", "2016-02-01", 8), ("a", "2016-02-02", 9), ("b", "2016-02-01", 1)])
    got = {tuple(r)[:2]: tuple(r)[2:] for r in benchmark.benchmark_4wk(df).collect()}
    assert got == {
        ("a", D(2016, 1, 4)): (5.0, None),
        ("a", D(2016, 2, 1)): (8.0, 5.0),
        ("a", D(2016, 2, 2)): (9.0, None),
        ("b", D(2016, 2, 1)): (1.0, None),
    }


def test_naive_accuracy(table, demand, cycles):
    lagged = benchmark.benchmark_4wk(table)
    variance = {r[0]: r[1] for r in benchmark.benchmark_variance(lagged, CAL).collect()}
    mape = {r[0]: r[1] for r in benchmark.benchmark_mape(lagged, CAL).collect()}
    by_wh = {(r[0], r[1]): r[2] for r in benchmark.benchmark_variance(lagged, CAL, by_warehouse=True).collect()}
    for c in cycles:
        pairs = [
            (w, demand[w, d - dt.timedelta(28)], a)
            for (w, d), a in c.rows("target").items()
            if (w, d - dt.timedelta(28)) in demand
        ]
        actual = sum(a for _, _, a in pairs)
        assert variance[c.id] == pytest.approx((sum(f for _, f, _ in pairs) - actual) / actual)
        errors = [abs(f - a) / f if f else float(a != 0) for _, f, a in pairs]
        assert mape[c.id] == pytest.approx(sum(errors) / len(errors))
        a_only = [(f, a) for w, f, a in pairs if w == "a"]
        total = sum(a for _, a in a_only)
        if total:
            assert by_wh[c.id, "a"] == pytest.approx((sum(f for f, _ in a_only) - total) / total)


def _compared_by_hand(cycle, role):
    """Full join of actuals and forecast: {(warehouse, day): (actual, forecast, lower, upper)}."""
    forecast_rows = {(w, d): v for (w, d, _), v in cycle.with_interval().items()}
    actual = cycle.rows(role)
    out = {}
    for key in set(actual) | set(forecast_rows):
        f, lo, up = forecast_rows.get(key, (None, None, None))
        out[key] = (actual.get(key, 0.0), f, lo or 0.0, up or 0.0)
    return out


def _ape(f, a):
    if f is None or (a == 0 and f == a):
        return 0.0
    return abs((f - a) / a) if a else 1.0


def test_actual_vs_forecast(table, published, cycles):
    compared = series.actual_vs_forecast(table, published, CAL).collect()
    got = {
        (r["cycle_id"], r["Warehouse"], r["Date"]): (
            r["Act_Orders"], r["Fcast_Volume"], r["Lower"], r["Upper"], r["Abs_Var_Pct"],
        )
        for r in compared
    }
    expected = {}
    for c in cycles:
        for (w, d), (a, f, lo, up) in _compared_by_hand(c, "span").items():
            expected[c.id, w, d] = (a, f, lo, up, _ape(f, a))
    assert len(got) == len(compared)
    _same(got, expected)


def test_stakeholder_series(table, published, cycles):
    compared = series.actual_vs_forecast(table, published, CAL)
    got = {tuple(r)[:3]: r[3] for r in series.stakeholder_series(compared, CAL).collect()}
    by_wh = {tuple(r)[:4]: r[4] for r in series.stakeholder_series(compared, CAL, by_warehouse=True).collect()}
    asof = {tuple(r)[:3]: r[3] for r in series.stakeholder_series_asof(compared, CAL, 20).collect()}
    for c in cycles:
        hand = _compared_by_hand(c, "span")
        on_delivery = sum(f for (w, d), (_, f, _, _) in hand.items() if d == c.delivery)
        for day in {d for _, d in hand}:
            rows = [v for (_, d), v in hand.items() if d == day]
            totals = [sum(v[i] or 0.0 for v in rows) for i in range(4)]
            if day is None:
                shown = late = [None] * 4
            else:
                actual = on_delivery if day == c.delivery else totals[0] if day < c.delivery else None
                ahead = totals[1:] if day >= c.delivery else [None] * 3
                shown = [actual, *ahead]
                late = [totals[0] if day <= c.delivery + dt.timedelta(20) else None, *ahead]
            for name, value, value_asof in zip(series.MEASURES, shown, late):
                assert got[c.id, day, name] == _approx(value)
                assert asof[c.id, day, name] == _approx(value_asof)
        for (w, d), (a, f, _, _) in hand.items():
            if d is not None:
                actual = f if d == c.delivery else a if d < c.delivery else None
                assert by_wh[c.id, w, d, "Act_Orders"] == _approx(actual)
    weekdays = series.weekdays_only(series.stakeholder_series(compared, CAL))
    kept = {tuple(r)[:3] for r in weekdays.collect()}
    assert kept == {k for k in got if k[1] is None or dow(k[1]) not in (1, 7)}


def test_delivery_total_is_null_if_a_member_is(spark):
    compared = spark.createDataFrame(
        [(1, "a", D(2016, 1, 4), 1.0), (1, "b", D(2016, 1, 4), None), (1, "a", D(2016, 1, 5), 4.0)],
        "cycle_id int, Warehouse string, Date date, Fcast_Volume double",
    )
    assert rows_of(series.delivery_day_total(compared, CAL)) == [(1, None)]
    assert rows_of(series.delivery_day_total(compared, CAL, by_warehouse=True)) == [(1, "a", 1.0), (1, "b", None)]


def test_measures_keep_nulls(table, published):
    compared = series.actual_vs_forecast(table, published, CAL)
    long = series.measures_long(compared)
    assert long.count() == 4 * compared.count()
    assert long.where("value is null").count() == compared.where("Fcast_Volume is null").count() > 0


def test_accuracy(table, published, cycles):
    base = accuracy.accuracy_base(table, published, CAL).cache()
    mape = {r["cycle_id"]: tuple(r)[1:] for r in accuracy.mape(base).collect()}
    error = {r["cycle_id"]: tuple(r)[1:] for r in accuracy.forecast_error(base, table, CAL).collect()}
    by_wh = {tuple(r)[:2]: r[2] for r in accuracy.forecast_error(base, table, CAL, ["Warehouse"]).collect()}
    weekly = {tuple(r)[:2]: tuple(r)[2:] for r in accuracy.weekly_grain(base).collect()}
    weekly_mape = dict(rows_of(accuracy.weekly_grain_mape(base)))
    yoy = {r["cycle_id"]: r["actual_chg"] for r in accuracy.actual_yoy(table, CAL).collect()}
    for c in cycles:
        hand = _compared_by_hand(c, "target")
        errors = [_ape(f, a) for a, f, _, _ in hand.values()]
        missing = sum(f is None for _, f, _, _ in hand.values())
        assert mape[c.id] == (pytest.approx(sum(errors) / len(errors)), len(hand), missing)
        gap = sum((f or 0.0) - a for a, f, _, _ in hand.values())
        comp = c.total("comp_target")
        assert error[c.id] == (pytest.approx(gap), pytest.approx(gap / comp))
        assert yoy[c.id] == pytest.approx((c.total("target") - comp) / comp)
        gap_a = sum((f or 0.0) - a for (w, _), (a, f, _, _) in hand.items() if w == "a")
        assert by_wh[c.id, "a"] == pytest.approx(gap_a)
        weeks = {}
        for (_, d), (a, f, _, _) in hand.items():
            weeks.setdefault(None if d is None else f"{d.isocalendar()[1]:02d}", []).append((a, f))
        week_errors = []
        for label, pairs in weeks.items():
            actual = sum(a for a, _ in pairs)
            total = None if any(f is None for _, f in pairs) else sum(f for _, f in pairs)
            week_errors.append(_ape(total, actual))
            assert weekly[c.id, label][:2] == (_approx(actual), _approx(total))
            assert weekly[c.id, label][4] == _approx(week_errors[-1])
        assert weekly_mape[c.id] == pytest.approx(sum(week_errors) / len(week_errors))


def test_share_drift(table, published, cycles):
    base = accuracy.accuracy_base(table, published, CAL)
    share = drift.warehouse_share_drift(base, forecast.warehouse_share(table, CAL)).collect()
    for r in share:
        c = cycles[r["cycle_id"] - 1]
        target, pre = c.rows("target"), c.rows("pre")
        actual = sum(v for (w, _), v in target.items() if w == r["Warehouse"]) / sum(target.values())
        in_pre = [v for (w, _), v in pre.items() if w == r["Warehouse"]]
        expected = sum(in_pre) / sum(pre.values()) if in_pre else None
        assert r["Actual"] == pytest.approx(actual) and r["Expected"] == _approx(expected)
        assert r["Actual_Less_Expected"] == (None if expected is None else pytest.approx(actual - expected))
    curve = drift.dow_share_drift(base, forecast.dow_curve(table, CAL)).collect()
    for r in curve:
        target = {k: v for k, v in cycles[r["cycle_id"] - 1].rows("target").items() if k[0] == r["Warehouse"]}
        total = sum(target.values())
        mine = sum(v for (_, d), v in target.items() if dow(d) == r["DOW"])
        assert r["actual_pct"] == (pytest.approx(mine / total) if total else None)


def test_mix_of_new_and_vanished_categories(lines):
    cal = CycleCalendar(D(2016, 1, 4), n_cycles=0)
    df = lines(
        [("p", "w", "new", "2016-01-04", 1.0), ("p", "w", "both", "2016-01-05", 3.0),
         ("p", "w", "old", "2015-12-01", 2.0), ("p", "w", "both", "2015-12-02", 2.0)]
    )
    mix = drift.product_mix_drift(df, cal)
    assert rows_of(drift.mix_band(mix)) == [
        (1, "both", 0.75, 0.5, "below"),
        (1, "new", 0.25, None, None),
        (1, "old", None, 0.5, None),
    ]


@pytest.mark.parametrize(
    "actual, expected, band",
    [(0.5, 0.53125, "above"), (0.5, 0.46875, "below"), (0.5, 0.515625, "inside"), (0.0, 0.02, "inside"),
     (0.02, 0.0, "inside"), (None, 0.1, None)],
)
def test_mix_band(spark, actual, expected, band):
    df = spark.createDataFrame([(actual, expected)], "actual_pct double, expected_pct double")
    assert drift.mix_band(df).first()["band"] == band


def test_strict_sd_of_one_is_null(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert df.groupBy("k").agg(strict_sd(F.col("v"))).first()[1] is None


def test_plans_stay_on_the_engine(table):
    """No cross join, no nested loop, no Python in the cycle queries."""
    for df in (
        calendar.cycle_window_totals(table, CAL),
        intervals.forecast_with_interval(table, CAL),
        accuracy.accuracy_base(table, intervals.forecast_with_interval(table, CAL), CAL),
    ):
        text = df._jdf.queryExecution().executedPlan().toString()
        for bad in ("NestedLoop", "Cartesian", "Python", "Arrow"):
            assert bad not in text


def test_error_levels_equal_the_single_queries(spark, table, published):
    base = accuracy.accuracy_base(table, published, CAL).cache()
    levels = accuracy.error_levels(base, table, CAL)
    assert levels._jdf.queryExecution().executedPlan().toString().count("Expand") == 1
    levels = levels.cache()
    for level, by in (("total", []), ("Warehouse", ["Warehouse"]), ("The_Week", ["The_Week"])):
        mine = levels.where(F.col("level") == level)
        error, mape = accuracy.forecast_error(base, table, CAL, by), accuracy.mape(base, by)
        assert rows_of(mine, *error.columns) == rows_of(error)
        assert rows_of(mine, *mape.columns) == rows_of(mape)
        others = [c for c in ("Warehouse", "The_Week") if c not in by]
        assert all(v is None for r in mine.select(*others).collect() for v in r)


def test_missing_keys_are_not_totals(spark, daily):
    base = spark.createDataFrame(
        [(1, None, "01", 1.0, 3.0, 0.5), (1, "a", None, 2.0, 2.0, 0.0)],
        "cycle_id int, Warehouse string, The_Week string, act_orders double, Fcast_Volume double, abs_var_pct double",
    )
    found = rows_of(accuracy.error_levels(base, daily([("a", "2015-01-06", 1.0)]), CAL), "level", "Warehouse", "The_Week", "sum_variance")
    assert found == sorted([("total", None, None, 2.0), ("Warehouse", None, None, 2.0), ("Warehouse", "a", None, 0.0), ("The_Week", None, "01", 2.0), ("The_Week", None, None, 0.0)], key=repr)


def test_window_totals_are_two_rows_a_window(spark, daily):
    """Each window's total is the sum of its days, exactly; no row is repeated for the days of a window."""
    rows = [(w, CAL.start_date + dt.timedelta(k * 3 - 500), float((k * 37) % 1009)) for k in range(400) for w in "ab"]
    table = daily([*rows, ("a", "2031-01-01", 5.0)])
    bounds = calendar.window_bounds(CAL, spark, *calendar.WINDOW_ROLES)
    assert bounds.count() == CAL.last_cycle * len(calendar.WINDOW_ROLES) * 2
    for r in calendar.window_totals_wide(table, CAL).collect():
        delivery = CAL.start_date + dt.timedelta((r["cycle_id"] - 1) * CAL.cadence_days)
        for role in calendar.WINDOW_ROLES:
            first, last = (delivery + dt.timedelta(k) for k in CAL.offsets(role))
            assert r[role] == sum(q for _, d, q in rows if first <= d <= last), (r["cycle_id"], role)
    plan = calendar.window_totals_wide(table, CAL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    none = calendar.window_totals_wide(daily([]), CAL).collect()
    assert len(none) == CAL.last_cycle and {r["pre"] for r in none} == {0.0}


def test_benchmark_has_one_scan_and_one_exchange(spark, daily, tmp_path):
    rows = [("a", "2016-01-01", 1.0), ("a", "2016-01-29", 2.0), ("a", "2016-01-30", 3.0), ("b", "2016-01-29", 4.0), (None, "2016-01-01", 5.0), (None, "2016-01-29", 6.0)]
    daily(rows).write.parquet(str(tmp_path / "d"))
    df = benchmark.benchmark_4wk(spark.read.parquet(str(tmp_path / "d")))
    assert {(r[0], r[1].day, r[1].month): r[3] for r in df.collect()} == {
        ("a", 1, 1): None, ("a", 29, 1): 1.0, ("a", 30, 1): None, ("b", 29, 1): None, (None, 1, 1): None, (None, 29, 1): 5.0,
    }
    plan = df._jdf.queryExecution().sparkPlan().toString()
    executed = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in executed
    assert executed[: executed.find("Initial Plan")].count("Exchange") <= 1 and "Exchange" in executed
