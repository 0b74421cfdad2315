"""Every registered query against its SQL, on the smallest test tables."""

import datetime as dt
import glob
import os
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


@cache
def _sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def plan(spark):
    return entry.plan(spark, SF_DIR)


def test_every_query_has_its_sql():
    queries, sql = entry._BY_PLAN, entry.oracle.build()
    assert set(queries) == set(sql)


@pytest.mark.parametrize("name", list(entry._BY_PLAN))
def test_query(plan, name):
    # One plan for all queries, so that the order lines are staged once.
    df = entry._BY_PLAN[name](plan)
    names = sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    relation = _sql().sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == names
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    at = [relation.columns.index(c) for c in names]
    assert got == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", list(entry._BY_PLAN))
def test_plan_stays_on_the_engine(plan, name):
    """No cross join, no nested loop, no Python; every query reads a table."""
    text = entry._BY_PLAN[name](plan)._jdf.queryExecution().executedPlan().toString()
    for bad in ("NestedLoop", "Cartesian", "Python", "Arrow"):
        assert bad not in text
    assert "Scan" in text


def test_cycles_cover_the_lines(plan):
    """From the first cycle's earliest window on, every clean line is in the window of some cycle."""
    cal = plan.cal
    first = cal.start_date + dt.timedelta(days=cal.offsets("pre_prev")[0])
    late = plan.clean.select("Date").distinct().where(F.col("Date") >= F.lit(first))
    roles = ("target", "comp_target", "pre", "pre_prev")
    assert late.count() > 1000 and late.join(cal.days(plan.spark, *roles), "Date", "left_anti").count() == 0
    last = cal.start_date + dt.timedelta(days=cal.n_cycles * cal.cadence_days + cal.offsets("target")[1])
    assert last > plan.clean.agg(F.max("Date")).first()[0]


def test_every_cycle_has_its_row(plan):
    for name in ("benchmark_variance", "benchmark_mape", "date_framework", "calibration_cycle"):
        rows = entry._BY_PLAN[name](plan).collect()
        assert len(rows) == 157 == len({r["cycle_id"] for r in rows})
    assert any(r["mape"] is None for r in entry._BY_PLAN["benchmark_mape"](plan).collect())


def test_queries_share_one_copy(spark):
    built = entry.queries()
    for name in ("trim_outliers", "flag_outliers", "mape", "demand_summary"):
        built[name](spark, SF_DIR)
    area = entry._shared_plan(spark, SF_DIR).area
    folder = area.root.removeprefix("file://")
    assert sum("order_lines" in f for f in os.listdir(folder)) == 1
    entry.release(spark)
    assert not os.path.exists(folder)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["cycle_id", "Warehouse", "Fcast_Date", "DOW", "Fcast_Volume", "Lower", "Upper"]
    assert df.count() > 0


def test_known_totals(spark):
    """Totals that were worked out independently of this code."""
    folder = "/root/testdata/sf0.01"
    p = entry.plan(spark, folder)
    assert p.clipped.count() == 59_347 and p.clean.count() == 59_347 - 1_280
    totals = {r["cycle_id"]: r for r in entry._BY_PLAN["expected_volume"](p).collect()}
    assert totals[21]["comp_volume"] == 81_351_019 and totals[27]["comp_volume"] == 77_863_362
    sums = dict(p.point_forecast.groupBy("cycle_id").sum("Fcast_Volume").collect())
    assert sums[21] == pytest.approx(83_253_743.1899, abs=1e-4)
    assert sums[27] == pytest.approx(74_548_612.5059, abs=1e-4)
