"""Order-line source and forecast sinks."""

from __future__ import annotations

import json
import uuid
from datetime import date
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_COLUMNS = ["Product_Code", "Warehouse", "Product_Category", "Date", "Order_Demand"]

RAW_ORDER_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ORDER_COLUMNS])


# Quotes inside quotes are doubled; a backslash is an ordinary character.
_QUOTING = {"quote": '"', "escape": '"'}


def _by_header(spark: SparkSession, path: str, multi_line: bool, same_header: bool) -> DataFrame:
    """The order-line columns of a CSV or a folder of them, found by name in each file's header.

    Files are read in groups of equal headers, each with a fixed schema, so there is no inference pass.
    """
    options = {"header": True, **_QUOTING, "multiLine": multi_line}
    files = [path] if same_header else sorted(map(unquote, spark.read.text(path).inputFiles()))
    headers: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        # Spark reads a file's first line for this.
        if header := tuple(spark.read.options(**options).csv(file).columns):
            headers.setdefault(header, []).append(file)
    tables = []
    for header, members in headers.items():
        if lost := [c for c in ORDER_COLUMNS if c not in header]:
            raise ValueError(f"{members[0]} has no column {', '.join(lost)} in its header, or has it twice")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        # Whole lines are parsed whichever columns are wanted, so that a surplus field is always noticed.
        reader = spark.read.schema(schema).options(enforceSchema=False, mode="FAILFAST", columnPruning=False, **options)
        tables.append(reader.csv(members).select(*ORDER_COLUMNS))
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], RAW_ORDER_SCHEMA)


def read_orders(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False, same_header: bool = False
) -> DataFrame:
    """Raw order lines; in text columns the token ``NA`` is null and an empty field stays empty text.

    A CSV's columns are found by name in the header of each file: their order is free, and other columns are
    left out. A file without one of them is refused, and so is a line with another number of fields than its
    header. Headers are looked up file by file; ``same_header`` spares that for large folders: the first header
    found holds for all files, and one that differs is refused. Fields with line breaks inside quotes need ``multi_line``, which
    keeps a file from being split. ``fmt="parquet"`` only scans the order-line columns, as text or with
    whatever types they have.
    """
    if fmt == "csv":
        # The reader turns empty fields into nulls.
        table = _by_header(spark, path, multi_line, same_header).na.fill("")
    elif fmt == "parquet":
        table = spark.read.parquet(path).select(*ORDER_COLUMNS)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return table.withColumns(
        {c: F.when(F.col(c) != "NA", F.col(c)) for c, kind in table.dtypes if kind == "string"}
    )


def write_orders(lines: DataFrame, path: str) -> None:
    """Raw order lines as headed CSV, nulls as ``NA`` (what ``read_orders`` reads)."""
    writer = lines.select(*ORDER_COLUMNS).write.options(header=True, nullValue="NA", **_QUOTING)
    writer.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


#: The columns that single lines are looked up by.
LOOKUP_KEYS = ["Product_Code", "Warehouse", "Product_Category", "Date"]


def write_lookup(lines: DataFrame, path: str, **options: str) -> None:
    """Order lines laid out for look-ups (``clean.lookup_lines``), as parquet.

    Each file is sorted by the look-up columns, so its row groups and pages have narrow ranges, and has Bloom filters
    of products and categories, so files and row groups that lack the wanted one are skipped although it lies between
    their smallest and largest. Nothing is shuffled: a partition is sorted where it is. ``options`` go to the writer.
    """
    writer = lines.sortWithinPartitions(*LOOKUP_KEYS).write.options(**options)
    for column in ("Product_Code", "Product_Category"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


#: What a run of the forecast logs.
OUTPUTS = ("forecast", "dow_curve", "warehouse_share")
_MANIFEST = "run_date date, sequence long, commit string, format string, schemas map<string,string>"


def _manifests(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{base}/manifests")


def _logged(spark: SparkSession, base: str) -> list:
    """The valid commit of every run date: that with the highest sequence number. One small row per run date."""
    try:
        found = _manifests(spark, base)
    except AnalysisException:  # nothing has been logged yet
        return []
    newest = F.max_by(F.struct("commit", "format", "schemas", "sequence"), F.struct("sequence", "commit"))
    return found.groupBy("run_date").agg(newest.alias("r")).select("run_date", "r.*").collect()


def write_forecast(
    forecast: DataFrame,
    dow_curve: DataFrame,
    warehouse_share: DataFrame,
    base_path: str,
    run_date: date,
    fmt: str = "parquet",
) -> dict[str, str]:
    """Log a forecast with the two assumptions behind it under its ``run_date``: all three, or none.

    Each output goes to a folder of its own, and last of all a manifest row that names the three; readers go by
    manifests (:func:`read_forecast`), so a run that fails in between leaves nothing to be seen. A run that is
    repeated for its date takes the place of the earlier one. Files are ordered by cycle, warehouse and day, and have the
    date in their path. Returns the folder of each output.
    """
    spark, base = forecast.sparkSession, base_path.rstrip("/")
    sequence = 1 + max((r["sequence"] for r in _logged(spark, base)), default=0)
    commit = f"{sequence:06d}-{uuid.uuid4().hex[:12]}"
    paths, schemas = {}, {}
    for name, table in zip(OUTPUTS, (forecast, dow_curve, warehouse_share)):
        paths[name], schemas[name] = f"{base}/{name}/{commit}", table.schema.json()
        keys = [c for c in ("cycle_id", "Warehouse", "Fcast_Date", "DOW") if c in table.columns]
        writer = table.withColumn("run_date", F.lit(run_date)).orderBy(*keys).write.partitionBy("run_date")
        if fmt == "csv":
            writer = writer.options(header=True, nullValue="NA", **_QUOTING)
        writer.format(fmt).save(paths[name])
    row = spark.createDataFrame([(run_date, sequence, commit, fmt, schemas)], _MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{base}/manifests")
    return paths


def read_forecast(spark: SparkSession, base_path: str, output: str = "forecast", run_date: date | None = None) -> DataFrame:
    """A logged output with its ``run_date``: of one run, or of all. Only complete runs are there."""
    base, tables = base_path.rstrip("/"), []
    for run in _logged(spark, base):
        if run_date in (None, run["run_date"]):
            schema = T.StructType.fromJson(json.loads(run["schemas"][output])).add("run_date", T.DateType())
            reader = spark.read.schema(schema)
            if run["format"] == "csv":
                reader = reader.options(header=True, enforceSchema=False, nullValue="NA", mode="FAILFAST", **_QUOTING)
            tables.append(reader.format(run["format"]).load(f"{base}/{output}/{run['commit']}"))
    if not tables:
        raise ValueError(f"no forecast is logged in {base}" + (f" for {run_date}" if run_date else ""))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
