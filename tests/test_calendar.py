import datetime as dt

import pytest

from conftest import rows_of
from ordercast import CycleCalendar, date_framework
from ordercast.operators import calendar

D = dt.date
CAL = CycleCalendar(D(2015, 1, 5))


def test_cycles(spark):
    fw = date_framework(spark, D(2015, 1, 5), 104, 14, 10, 12)
    by_id = {r["cycle_id"]: r for r in fw.collect()}
    assert sorted(by_id) == list(range(1, 106))
    assert by_id[105]["delivery"] == D(2018, 12, 31)
    assert tuple(by_id[27])[1:] == (
        D(2016, 1, 4), D(2016, 1, 4), D(2016, 3, 13), D(2015, 1, 5), D(2015, 3, 15),
        D(2015, 10, 12), D(2015, 12, 28), D(2014, 10, 13), D(2014, 12, 29),
    )
    assert tuple(by_id[21])[1:] == (
        D(2015, 10, 12), D(2015, 10, 12), D(2015, 12, 20), D(2014, 10, 13), D(2014, 12, 21),
        D(2015, 7, 20), D(2015, 10, 5), D(2014, 7, 21), D(2014, 10, 6),
    )


def test_days_cover_the_windows(spark):
    days = CAL.days(spark, *calendar.WINDOW_ROLES)
    assert days.count() == 105 * (70 + 70 + 78 + 78)
    pre = [r["Date"] for r in days.where("cycle_id = 27 and role = 'pre'").collect()]
    assert (min(pre), max(pre), len(set(pre))) == (D(2015, 10, 12), D(2015, 12, 28), 78)


def test_recent_window_leans_to_the_delivery_weekday(spark):
    def weekdays(offset):
        cal = CycleCalendar(D(2015, 1, 5), pre_end_offset_days=offset)
        counts = cal.days(spark, "pre").where("cycle_id = 1").selectExpr("dayofweek(Date) d").groupBy("d").count()
        return sorted(r["count"] for r in counts.collect())

    assert weekdays(7) == [11] * 6 + [12]
    assert weekdays(8) == [11] * 7


def test_calibration_cycle(spark):
    got = dict(rows_of(calendar.calibration_cycles(CAL.frame(spark), 12), "cycle_id", "calibration_id"))
    assert got[27] == 21 and got[7] == 1 and got[6] is None and len(got) == 105
    off_grid = calendar.calibration_cycles(CycleCalendar(D(2015, 1, 5), cadence_days=15).frame(spark), 12)
    assert off_grid.where("calibration_id is not null").count() == 0


@pytest.mark.parametrize("cadence", [14, 15])
def test_both_ways_to_calibrate_agree(spark, cadence):
    cal = CycleCalendar(D(2015, 1, 5), n_cycles=20, cadence_days=cadence)
    joined = calendar.calibration_cycles(cal.frame(spark), 12).where("calibration_id is not null")
    cycles = cal.cycles(spark)
    reckoned = cycles.select(cal.calibrated_by(cycles["cycle_id"]).alias("c"), "cycle_id").where("c is not null")
    assert rows_of(joined, "cycle_id", "calibration_id") == rows_of(reckoned, "c", "cycle_id")


def test_window_totals_are_zero_where_nothing_was_ordered(daily):
    cal = CycleCalendar(D(2016, 1, 4), n_cycles=1)
    df = daily([("a", "2016-01-04", 5), ("a", "2016-01-17", 1), ("b", "2016-01-18", 2), ("b", "2016-03-28", 9)])
    got = {(c, r): t for c, r, t in rows_of(calendar.cycle_window_totals(df, cal))}
    assert len(got) == 8
    # The second cycle is delivered on 2016-01-18; both ends of its window count.
    assert got[1, "target"] == 8.0 and got[2, "target"] == 2.0
    assert got[1, "comp_target"] == got[1, "pre"] == got[2, "pre_prev"] == 0.0


def test_grid(daily):
    df = daily([("a", "2016-01-04", 5), ("b", "2016-01-04", 5), ("a", "2016-01-05", 5)])
    grid = calendar.horizon_grid(calendar.known_warehouses(df), CycleCalendar(D(2016, 1, 4), n_cycles=2))
    assert grid.count() == 2 * 3 * 70 == grid.distinct().count()
    first = grid.where("cycle_id = 2").orderBy("Fcast_Date").first()
    assert (first["Fcast_Date"], first["DOW"]) == (D(2016, 1, 18), 2)
