import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordercast.functions.pair_filter import perhaps_in
from ordercast.operators.quantiles import _bucket, group_quantiles
from ordercast.plans.staging import StagingArea

PROBS = {"lo": 0.01, "mid": 0.5, "hi": 0.99}


def _expected(values):
    return [float(np.quantile(values, p)) for p in PROBS.values()]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of all rows, ties, negatives, tiny and huge values, and small groups."""
    rng = random.Random(7)
    data = {
        "hot": [round(rng.lognormvariate(4, 2), 2) for _ in range(3000)],
        "tied": [5.0] * 400 + [6.0] * 400 + [1e6, -1e6],
        "signs": [float(rng.randint(-50, 50)) for _ in range(1500)],
        "tiny": [rng.random() * 1e-4 for _ in range(1200)],
        "huge": [rng.random() * 1e300 for _ in range(700)],
        "narrow": [1e6 + i / 64 for i in range(900)],
        "one": [3.0],
        "two": [1.0, 2.0],
        "same": [4.0, 4.0],
        "zero": [0.0, -0.0, 0.0],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), (None, 8.0), (None, 9.0), ("empty", None)]
    rng.shuffle(rows)
    data[None] = [8.0, 9.0]
    return data, spark.createDataFrame(rows, "k string, v double")


@pytest.mark.parametrize("partitions", [1, 17])
def test_equals_sorting_each_group(skewed, partitions):
    data, df = skewed
    got = {r["k"]: list(r)[1:] for r in group_quantiles(df.repartition(partitions), ["k"], "v", PROBS).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        assert got[k] == pytest.approx(_expected(values), rel=1e-12, abs=1e-12), k


def test_many_values_in_one_bucket(spark):
    rng = random.Random(3)
    values = [1e6 + rng.random() * 1e4 for _ in range(20_000)] + [1e6] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert list(group_quantiles(df, [], "v", PROBS).first()) == pytest.approx(_expected(values), rel=1e-14)


def test_unwanted_lines_drop_out_below_the_exchange(spark, tmp_path):
    """8,000 groups, broadcasts off: the bitmap stands below the first exchange, and few lines get past it."""
    source = spark.range(400_000).selectExpr("cast(id % 8000 as string) k", "exp(((id * 7919) % 10007) / 1000) v")
    source.write.parquet(str(tmp_path / "l"))
    lines = spark.read.parquet(str(tmp_path / "l"))
    written = {}

    class Area(StagingArea):
        def stage(self, df, name):
            written[name] = super().stage(df, name)
            return written[name]

    area = Area(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = group_quantiles(lines, ["k"], "v", {"lo": 0.01, "hi": 0.99}, area=area)
        assert found.count() == 8000
        found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan")[0]
    assert set(written) == {"quantile_buckets"} and "Python" not in plan and "NestedLoop" not in plan
    # The lines are scanned here once more, and counts that two later steps read are shuffled once.
    (scan,) = re.finditer(r"FileScan parquet \[k#\d+,v#\d+\].*getbit", plan)
    (exchange,) = re.finditer(r"Exchange hashpartitioning\(k#\d+, _b#\d+, _v#\d+", plan)
    between = plan[exchange.start() : scan.start()]
    assert "partial_count" in between and "Subquery" in between and "Join" not in between and "ReusedExchange" in plan
    # At most two buckets per quantile and group, and lines in them; the rest is at most the bitmap's share of errors.
    pairs = written["quantile_buckets"].select("k", "_b")
    values = lines.withColumn("_b", _bucket(F.col("v")))
    passed = values.where(perhaps_in(pairs, ["k", "_b"])).count()
    wanted = values.join(pairs, ["k", "_b"]).count()
    assert wanted <= passed <= wanted + 0.05 * 400_000 and wanted < 0.2 * 400_000
    area.release()


def test_the_filter_loses_nothing(spark):
    wanted = spark.createDataFrame([(None, 1), ("a", None), ("b", 3), ("b", 3)], "k string, n int")
    rows = spark.createDataFrame([(k, n) for k in (None, "a", "b", "c") for n in (None, 1, 3, 4)], "k string, n int")
    for bits in (64, 1 << 10, 1 << 20):
        passed = {tuple(r) for r in rows.where(perhaps_in(wanted, ["k", "n"], bits)).collect()}
        assert passed >= {(None, 1), ("a", None), ("b", 3)}
    assert passed == {(None, 1), ("a", None), ("b", 3)}
    assert rows.where(perhaps_in(wanted.limit(0), ["k", "n"])).count() == 0


def test_whole_table(skewed):
    data, df = skewed
    everything = [v for vs in data.values() for v in vs]
    got = group_quantiles(df, [], "v", PROBS).collect()
    assert len(got) == 1
    assert list(got[0]) == pytest.approx(_expected(everything), rel=1e-12)


def test_tied_bounds_are_exact(spark):
    """Equal neighbours come back bit for bit, so a strict comparison does not flag them."""
    df = spark.range(1000).select(F.lit("a").alias("k"), F.lit(0.1).alias("v"))
    assert tuple(group_quantiles(df, ["k"], "v", PROBS).first()) == ("a", 0.1, 0.1, 0.1)


def test_without_broadcasts(spark, skewed):
    data, df = skewed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["k"]: list(r)[1:] for r in group_quantiles(df, ["k"], "v", PROBS).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k, values in data.items():
        assert got[k] == pytest.approx(_expected(values), rel=1e-12, abs=1e-12), k
