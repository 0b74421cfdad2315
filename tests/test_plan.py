"""A whole run, from raw text to the forecast, against the same run in plain Python."""

import datetime as dt
import random

import numpy as np
import pytest

from by_hand import Cycle, days
from ordercast import CycleCalendar, DemandPlan, read_orders
from ordercast.operators.trend import daily_totals

D = dt.date
CLIP = (D(2012, 1, 1), D(2016, 12, 31))
CAL = CycleCalendar(D(2015, 1, 5))
WAREHOUSES = ["Whse_A", "Whse_C", "Whse_J", "Whse_S"]


@pytest.fixture(scope="module")
def raw_rows():
    rng = random.Random(11)
    rows = []
    for day in days(D(2011, 12, 25), D(2017, 1, 8)):
        for _ in range(rng.randint(0, 6)):
            quantity = rng.choice([rng.randint(1, 20), rng.randint(1, 2000)])
            text = f"({quantity})" if rng.random() < 0.03 else f"{quantity} "
            written = rng.choice([f"{day:%Y/%m/%d}", f"{day.year}/{day.month}/{day.day}"])
            rows.append(
                (
                    f"Product_{rng.randint(1, 12):04d}",
                    rng.choice(WAREHOUSES),
                    f"Category_{rng.randint(1, 5):03d}",
                    "NA" if rng.random() < 0.02 else written,
                    text,
                )
            )
    return rows


@pytest.fixture(scope="module")
def path(raw_rows, tmp_path_factory):
    file = tmp_path_factory.mktemp("orders") / "orders.csv"
    text = ["Product_Code,Warehouse,Product_Category,Date,Order_Demand"] + [",".join(r) for r in raw_rows]
    file.write_text("\n".join(text) + "\n")
    return str(file)


@pytest.fixture(scope="module")
def demand(raw_rows):
    groups = {}
    for product, warehouse, _, day, text in raw_rows:
        if day == "NA":
            continue
        day = D(*map(int, day.split("/")))
        if CLIP[0] < day < CLIP[1]:
            value = float(text.replace("(", "-").replace(")", ""))
            groups.setdefault((warehouse, product), []).append((day, value))
    out = {}
    for (warehouse, _), members in groups.items():
        lower, upper = np.quantile([v for _, v in members], [0.01, 0.99])
        for day, value in members:
            if lower <= value <= upper:
                out[warehouse, day] = out.get((warehouse, day), 0.0) + value
    return out


@pytest.mark.parametrize("stage_lines", [True, False])
def test_run_equals_by_hand(spark, path, demand, stage_lines):
    plan = DemandPlan(read_orders(spark, path), CAL, CLIP, stage_lines=stage_lines)
    got_daily = {(r["Warehouse"], r["Date"]): r["demand"] for r in plan.daily.collect()}
    assert got_daily == demand
    totals = {r["Date"]: r["orders"] for r in daily_totals(plan.clean).collect()}
    assert sum(totals.values()) == sum(demand.values())

    cycle = Cycle(demand, CAL, 27, WAREHOUSES)
    assert cycle.delivery == D(2016, 1, 4)
    expected = cycle.with_interval()
    got = {tuple(r)[1:4]: tuple(r)[4:] for r in plan.forecast.where("cycle_id = 27").collect()}
    assert set(got) == set(expected)
    for key, values in expected.items():
        assert got[key] == tuple(None if v is None else pytest.approx(v, rel=1e-9, abs=1e-6) for v in values)
    plan.release()


def test_typed_columns_need_no_parsing(spark, path, demand, tmp_path):
    text = DemandPlan(read_orders(spark, path), CAL, CLIP)
    text.typed.write.parquet(str(tmp_path / "typed"))
    typed = DemandPlan(read_orders(spark, str(tmp_path / "typed"), "parquet"), CAL, CLIP, stage_lines=False)
    scan = typed.clipped._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Date,2012-01-01)" in scan and "RLIKE" not in scan
    assert {(r["Warehouse"], r["Date"]): r["demand"] for r in typed.daily.collect()} == demand
    typed.release()
