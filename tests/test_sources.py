import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ordercast.operators import clean
from ordercast.plans import staging
from ordercast.sources.orders import read_forecast, read_orders, write_forecast, write_lookup, write_orders

D = dt.date
COLUMNS = "Product_Code string, Warehouse string, Product_Category string, Date string, Order_Demand string"


def test_csv(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        "Product_Code,Warehouse,Product_Category,Date,Order_Demand\n"
        "Product_0031,Whse_A,Category_005,2012/10/12,(1000)\n"
        "Product_0032,Whse_A,Category_005,NA,100 \n"
        "Product_0033,,\"\",,\n"
    )
    df = read_orders(spark, str(tmp_path / "orders.csv"))
    assert {t for _, t in df.dtypes} == {"string"}
    assert rows_of(df) == [
        ("Product_0031", "Whse_A", "Category_005", "2012/10/12", "(1000)"),
        ("Product_0032", "Whse_A", "Category_005", None, "100 "),
        ("Product_0033", "", "", "", ""),
    ]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    folder = tmp_path / "with blank"
    folder.mkdir()
    (folder / "a.csv").write_text("Warehouse,Product_Code,Product_Category,Date,Order_Demand\nw,p,c,d,1\n")
    (folder / "b.csv").write_text('Id,Order_Demand,Date,"Product_Category",No.te,Warehouse,Product_Code\n7,(2),e,k,x,v,q\n')
    (folder / "c.csv").write_text("Warehouse,Product_Code,Product_Category,Date,Order_Demand\nu,r,c,NA,\n")
    (folder / "d.csv").write_text("")
    want = [("p", "w", "c", "d", "1"), ("q", "v", "k", "e", "(2)"), ("r", "u", "c", None, "")]
    assert rows_of(read_orders(spark, str(folder))) == want
    assert rows_of(read_orders(spark, str(folder), multi_line=True)) == want
    with pytest.raises(Exception, match="(?i)header"):
        read_orders(spark, str(folder), same_header=True).collect()
    one = read_orders(spark, str(folder / "b.csv"), same_header=True)
    assert rows_of(one) == want[1:2] and one.count() == 1


@pytest.mark.parametrize("header", ["Warehouse,Product_Code,Date,Order_Demand", "Date,Date,Product_Code,Warehouse,Product_Category,Order_Demand"])
def test_csv_without_a_column_is_refused(spark, tmp_path, header):
    (tmp_path / "orders.csv").write_text(header + "\n" + ",".join("x" for _ in header.split(",")) + "\n")
    with pytest.raises(ValueError, match="header"):
        read_orders(spark, str(tmp_path / "orders.csv"))


def test_round_trips(spark, tmp_path):
    raw = spark.createDataFrame(
        [("p", "w", "c, with comma", "2012/10/12", "(5)"), ("q", "w", None, None, '7"')], COLUMNS
    )
    write_orders(raw, str(tmp_path / "csv"))
    assert rows_of(read_orders(spark, str(tmp_path / "csv"))) == rows_of(raw)
    raw.na.fill("NA", ["Date"]).write.parquet(str(tmp_path / "pq"))
    assert rows_of(read_orders(spark, str(tmp_path / "pq"), "parquet")) == rows_of(raw)
    with pytest.raises(ValueError):
        read_orders(spark, "x", "xml")


SHARES = [("a", 0.25, None), ("b, c", None, D(2016, 1, 1)), ("", 1.5, None), (None, 0.1, None)]
SHARE = "Warehouse string, pct double, Fcast_Date date"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_forecast_log_replaces_only_its_own_run(spark, tmp_path, fmt):
    def log(value, day, fmt=fmt):
        f = spark.createDataFrame([("a", value)], "Warehouse string, Fcast_Volume double")
        return write_forecast(f, f, spark.createDataFrame(SHARES, SHARE), str(tmp_path), day, fmt)

    log(1.0, D(2016, 1, 4))
    log(2.0, D(2016, 1, 18), "parquet")
    paths = log(3.0, D(2016, 1, 4))
    assert set(paths) == {"forecast", "dow_curve", "warehouse_share"}
    for name in ("forecast", "dow_curve"):
        back = read_forecast(spark, str(tmp_path), name)
        assert rows_of(back, "Fcast_Volume", "run_date") == [(2.0, D(2016, 1, 18)), (3.0, D(2016, 1, 4))]
        assert os.path.isdir(f"{paths[name]}/run_date=2016-01-04")
    one = read_forecast(spark, str(tmp_path), "warehouse_share", D(2016, 1, 4))
    assert rows_of(one, "Warehouse", "pct", "Fcast_Date") == sorted(SHARES, key=repr)
    assert dict(one.dtypes) == {"Warehouse": "string", "pct": "double", "Fcast_Date": "date", "run_date": "date"}
    with pytest.raises(ValueError, match="2017"):
        read_forecast(spark, str(tmp_path), run_date=D(2017, 1, 1))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_run_that_fails_in_between_leaves_nothing_to_be_seen(spark, tmp_path, fmt):
    table = lambda v: spark.createDataFrame([("a", v)], "Warehouse string, v double")
    broken = table(9.0).withColumn("v", F.raise_error(F.lit("killed")).cast("double"))
    base = str(tmp_path)
    with pytest.raises(Exception, match="killed"):
        write_forecast(table(9.0), broken, table(9.0), base, D(2016, 1, 4), fmt)
    with pytest.raises(ValueError, match="no forecast"):
        read_forecast(spark, base)
    write_forecast(table(1.0), table(2.0), table(3.0), base, D(2016, 1, 4), fmt)
    with pytest.raises(Exception, match="killed"):
        write_forecast(table(9.0), broken, table(9.0), base, D(2016, 1, 4), fmt)
    assert [rows_of(read_forecast(spark, base, n), "v") for n in ("forecast", "dow_curve", "warehouse_share")] == [[(1.0,)], [(2.0,)], [(3.0,)]]


def test_staging(spark):
    area, other = staging.StagingArea(spark), staging.StagingArea(spark)
    df = spark.range(10).selectExpr("id", "cast(null as string) as t")
    staged = area.stage(df, "t")
    assert rows_of(staged) == rows_of(df) and staged.dtypes == df.dtypes
    assert "FileScan parquet" in staged._jdf.queryExecution().executedPlan().toString()
    assert rows_of(area.stage(df.where("id < 0"), "t")) == []
    kept = other.stage(df, "t")
    area.release()
    assert not os.path.exists(area.root) and rows_of(kept) == rows_of(df)
    other.release()


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf({k.replace("_", "."): v for k, v in values.items()})


def test_shared_folder_comes_from_the_session(spark):
    assert staging.shared_dir(_Session(spark_checkpoint_dir="hdfs://c/x/", spark_master="yarn")) == "hdfs://c/x"
    assert staging.shared_dir(_Session(spark_master="yarn")) is None
    df = spark.range(3)
    area = staging.StagingArea(_Session(spark_master="yarn"))
    assert area.stage(df, "t") is df
    with pytest.raises(RuntimeError):
        area.path("t")
    area.release()


HEAD = "Product_Code,Warehouse,Product_Category,Date,Order_Demand\n"


def test_csv_quoting(spark, tmp_path):
    (tmp_path / "q.csv").write_text(HEAD + '"P ""A"", x",W,C,2012/10/12,5\nP\\,W,"C:\\",2012/10/12," 7 "\n')
    assert rows_of(read_orders(spark, str(tmp_path / "q.csv"))) == [
        ('P "A", x', "W", "C", "2012/10/12", "5"),
        ("P\\", "W", "C:\\", "2012/10/12", " 7 "),
    ]
    (tmp_path / "m.csv").write_text(HEAD + '"P\n1",W,C,2012/10/12,5\n')
    assert rows_of(read_orders(spark, str(tmp_path / "m.csv"), multi_line=True)) == [("P\n1", "W", "C", "2012/10/12", "5")]


@pytest.mark.parametrize("line", ["P,W,C,2012/10/12,8,extra", "P,W,C,2012/10/12"])
def test_lines_with_other_numbers_of_fields_are_refused(spark, tmp_path, line):
    (tmp_path / "x.csv").write_text(HEAD + line + "\n")
    df = read_orders(spark, str(tmp_path / "x.csv"))
    for read in (df, df.select("Warehouse")):
        with pytest.raises(Exception, match="(?i)malformed"):
            read.collect()


def test_csv_round_trip_of_odd_values(spark, tmp_path):
    values = ['"', '""', "\\", '\\"', "a,b", " a ", "", None, "'", "x\\,", "é\t"]
    raw = spark.createDataFrame([(v, w, "c", "d", "1") for v in values for w in values], COLUMNS)
    write_orders(raw, str(tmp_path / "csv"))
    assert rows_of(read_orders(spark, str(tmp_path / "csv"))) == rows_of(raw)


def _rows_read(df):
    """What the scan of a collected plan without a shuffle let through."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("dictionary", ["true", "false"])
def test_lookups_skip_files_and_row_groups(spark, tmp_path, dictionary):
    """Sixteen files with interleaved products: ranges alone would rule none out."""
    columns = [
        "concat('P', lpad(cast(id % 4000 as string), 6, '0')) Product_Code",
        "'W' Warehouse",
        "cast(id % 7 as string) Product_Category",
        "date_add(date'2016-01-01', cast(id div 4000 as int)) Date",
        "cast(id as double) Order_Demand",
    ]
    lines = spark.range(64_000).selectExpr(*columns, "cast(id % 16 as int) part").repartitionById(16, F.col("part")).drop("part")
    layout = {"parquet.enable.dictionary": dictionary, "parquet.block.size": "65536", "parquet.page.size": "4096"}
    write_lookup(lines, str(tmp_path / "sorted"), **layout)
    lines.write.options(**layout).parquet(str(tmp_path / "plain"))
    found = {}
    for kind in ("sorted", "plain"):
        df = clean.lookup_lines(spark.read.parquet(str(tmp_path / kind)), "P001234", "W", "2", D(2016, 1, 1))
        found[kind] = rows_of(df)
        df = df.select("*")
        df.collect()
        assert 0 <= _rows_read(df) <= 64_000
        if kind == "sorted":
            # Fifteen files of 4,000 lines have no such product, and most row groups or pages of the other neither.
            assert _rows_read(df) <= 1_000
    assert found["sorted"] == found["plain"] == [("P001234", "W", "2", D(2016, 1, 1), 1234.0)]
    scan = spark.read.parquet(str(tmp_path / "sorted"))
    absent = clean.lookup_lines(scan, "P001234x", "W", "2", D(2016, 1, 1))
    absent.collect()
    assert _rows_read(absent) == 0
