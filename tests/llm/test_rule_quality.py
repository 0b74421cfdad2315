import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordercast.llm import rule_quality
from ordercast.llm.rule_quality import DEPTH, STATISTICS, Ensemble, statistics

from .conftest import prose

LABELS = "doc_id long, quality int"


@pytest.fixture(scope="module")
def rows():
    """(text, quality): prose, and prose with marks, in capitals, or over and over."""
    rng = random.Random(8)
    out = []
    for k in range(300):
        text = ". ".join(prose(rng, rng.randint(4, 12)).capitalize() for _ in range(rng.randint(2, 8))) + "."
        junk = rng.choice(["marks", "capitals", "again"]) if k % 3 == 0 else None
        if junk == "marks":
            text = " ".join(w + "***" for w in text.split())
        elif junk == "capitals":
            text = text.upper()
        elif junk == "again":
            text = " ".join([text] * 4)
        out.append((text, int(junk is None)))
    return out


def apply(ensemble, x):
    total = ensemble.intercept
    for rule, weight in zip(ensemble.rules, ensemble.weights):
        total += weight * all(low < x[k] <= high for k, low, high in rule)
    return 1 / (1 + math.exp(-total))


def test_learned_rules_tell_held_out_rows(spark, documents, rows):
    docs = documents([t for t, _ in rows], extra=("x", "label", "features"))
    labels = spark.createDataFrame([(k, q) for k, (_, q) in enumerate(rows) if k % 4], LABELS)
    measured = rule_quality.measured(docs)
    ensemble = rule_quality.learn(measured, labels)
    assert 0 < len(ensemble.rules) <= 60 and all(1 <= len(r) <= DEPTH for r in ensemble.rules)
    found = dict(measured.select("doc_id", ensemble.score(F.col("x"))).collect())
    # The compiled expression is the ensemble, and the ensemble is right.
    for k, (text, _) in enumerate(rows):
        assert found[k] == pytest.approx(apply(ensemble, statistics(text)), abs=1e-12)
    held = [(found[k] >= 0.7) == bool(q) for k, (_, q) in enumerate(rows) if k % 4 == 0]
    assert np.mean(held) >= 0.95
    assert len(ensemble.described()) == len(ensemble.rules)


def test_the_score_is_an_expression(spark, documents, rows):
    ensemble = Ensemble([((0, 1.0, math.inf),), ((1, -math.inf, 4.0), (7, 0.5, 2.0))], [1.5, -2.0], 0.25)
    x = spark.createDataFrame([([float(k)] * len(STATISTICS),) for k in range(6)], "x array<double>").select("x", ensemble.score(F.col("x")).alias("s"))
    assert "Python" not in x._jdf.queryExecution().executedPlan().toString()
    assert all(r.s == pytest.approx(apply(ensemble, r.x)) for r in x.collect())


def test_keep(spark, documents, rows):
    docs = documents([t for t, _ in rows], extra=("x", "score"))
    labels = spark.createDataFrame([(k, q) for k, (_, q) in enumerate(rows)], LABELS)
    kept = rule_quality.keep(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(k in ids) == bool(q) for k, (_, q) in enumerate(rows)]) >= 0.95


def test_statistics_by_hand():
    x = dict(zip(STATISTICS, statistics("Ab ab** ab**\nx | y!\n\nAb ab** ab**\n1 2.")))
    n = 11
    assert x["words"] == math.log1p(n) and x["distinct"] == 7 / n and x["commonest"] == 4 / n and x["beside"] == 2 / n
    assert x["marked"] == 9 / n and x["bars"] == 1 / n and x["shouts"] == 1 / n and x["same_lines"] == 1 / 4 and x["line_words"] == n / 4
    assert x["upper"] == 2 / 14 and x["ended"] == 2 / 4 and x["points"] == 2 / n and x["windows"] == 0
    assert statistics("a b c d e " * 2)[STATISTICS.index("windows")] == 1.0
    assert statistics("") == statistics(" \n ") == [0.0] * len(STATISTICS)


def test_one_label_or_none(spark, documents, rows):
    docs = documents([t for t, _ in rows[:20]])
    every = {r.score for r in rule_quality.scores(docs, spark.createDataFrame([(k, 1) for k in range(9)], LABELS)).collect()}
    assert list(every) == [pytest.approx(9.5 / 10)]
    none = spark.createDataFrame([(1, None), (None, 1), (2, 7)], LABELS)
    assert {r.score for r in rule_quality.scores(docs, none).collect()} == {0.5}


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (4, 1), (5, 1), (5, 0), (7, 1), (8, 1), (None, 1)], LABELS)
    found = rule_quality.scores(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert rule_quality.scores(empty, labels).collect() == []
    assert rule_quality.keep(empty, labels).collect() == []
