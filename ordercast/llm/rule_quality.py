"""Quality by a sparse ensemble of rules over text statistics.

Statistics of whole texts (``STATISTICS``) are measured once per document and written, a few numbers a row. A forest of
shallow trees is grown on the labelled rows; every path from a root to a node is a rule, a conjunction of bounds on
statistics. Bounds of a rule on one statistic are merged, equal rules are one. A logistic regression with an L1 penalty
on the rules' truth values gives most of them the weight 0; the others are compiled into one Spark column expression, so
a score is worked out where the statistics are read, without a Python worker.

Trees and weights are fitted by Spark on all labelled rows, which are joined with statistics, never with texts; what comes to
the driver is at most ``TREES`` trees of depth ``DEPTH`` and a weight per rule.

Null and empty texts have statistics too (0 words) and get a score. Texts of any length are measured to the end. Null
ids are scored but not learned from; labels other than 0 and 1 are not learned from; an id that is labelled more than once
has its lowest label; rows that repeat an id are measured and learned from each. Where labelled rows have one label, or there
are none, every text gets the smoothed share of label 1. Empty tables give no rows. Ties in the forest go as its seed has it. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercast.llm.common import fresh, prepare, runs, stage
from ordercast.llm.words import hashes, windows, words

#: Trees of the forest, their depth, and the penalty on the rules' weights.
TREES, DEPTH, PENALTY, SEED = 20, 3, 0.001, 7
#: Passes over the rules' truth values, at most.
PASSES = 40

STATISTICS = (
    "words",  # log of one more than the number of words
    "word_bytes",  # mean
    "longest",  # log of the longest word's bytes
    "distinct",  # distinct words by words
    "commonest",  # the most frequent word's share
    "beside",  # words equal to the one before, by words
    "windows",  # words in 5-word windows that occur again, by words
    "marked",  # characters of #*$%&|<> by words
    "bars",  # words that are a bar, by words
    "shouts",  # exclamation marks by words
    "upper",  # A-Z by A-Z and a-z
    "digits",  # by bytes
    "points",  # sentence marks by words
    "accents",  # bytes above ASCII, by bytes
    "lines",  # log of one more than the number of lines with words
    "same_lines",  # lines that occurred before, by lines
    "line_words",  # words by line
    "ended",  # lines that end in a sentence mark, by lines
)

_UPPER, _LOWER, _ASCII = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128))


def _number(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    found = words(text, fold=False)
    n = len(found)
    if not n:
        return [0.0] * len(STATISTICS)
    h = hashes(found)
    _, times = np.unique(h, return_counts=True)
    again = 0
    if len(w := windows(h, 5)):
        _, back, often = np.unique(w, return_inverse=True, return_counts=True)
        edges = np.zeros(n + 1, dtype=np.int64)
        twice = often[back] > 1
        edges[: len(w)] += twice
        edges[5 : 5 + len(w)] -= twice
        again = int((np.cumsum(edges)[:n] > 0).sum())
    lines = [line.strip() for line in data.split(b"\n")]
    lines = [line for line in lines if line]
    upper, lower = _number(data, _UPPER), _number(data, _LOWER)
    sizes = [len(f) for f in found]
    return [
        math.log1p(n),
        sum(sizes) / n,
        math.log(max(sizes)),
        len(times) / n,
        float(times.max()) / n,
        float((h[1:] == h[:-1]).sum()) / n,
        again / n,
        _number(data, b"#*$%&|<>") / n,
        found.count(b"|") / n,
        data.count(b"!") / n,
        upper / max(upper + lower, 1),
        _number(data, b"0123456789") / len(data),
        _number(data, b".?!") / n,
        len(data.translate(None, _ASCII)) / len(data),
        math.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(line[-1:] in b".?!" for line in lines) / len(lines),
    ]


def measure(text: Column) -> Column:
    """The statistics as an array."""

    @F.pandas_udf("array<double>")
    def measured_here(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([statistics(t) for part in runs(batch) for t in part], dtype=object)

    return measured_here(text)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics ``x`` for each row; written, so texts are read once."""
    prepare(docs.sparkSession)
    return stage(docs.select("doc_id", measure(F.col("text")).alias("x")), "statistics")


#: A statistic's place to its bounds: it is above the first and at most the second.
Rule = tuple[tuple[int, float, float], ...]


def rules_of(node, bounds: Mapping[int, tuple[float, float]] | None = None) -> set[Rule]:
    """The rules of a tree: one for every node but the root. ``node`` is a fitted tree's Java node."""
    bounds = bounds or {}
    found = {tuple((k, *b) for k, b in sorted(bounds.items()))} if bounds else set()
    if "Internal" in node.getClass().getSimpleName():
        k, cut = node.split().featureIndex(), node.split().threshold()
        low, high = bounds.get(k, (-math.inf, math.inf))
        found |= rules_of(node.leftChild(), {**bounds, k: (low, min(high, cut))})
        found |= rules_of(node.rightChild(), {**bounds, k: (max(low, cut), high)})
    return found


def holds(rule: Rule, x: Column) -> Column:
    """Whether a rule is true of an array of statistics."""
    out = F.lit(True)
    for k, low, high in rule:
        value = x[k]
        if low > -math.inf:
            out = out & (value > low)
        if high < math.inf:
            out = out & (value <= high)
    return out


@dataclass
class Ensemble:
    """Rules with weights other than 0, and the intercept."""

    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, x: Column) -> Column:
        """0 to 1, as an expression over an array of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(holds(rule, x), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def described(self) -> list[str]:
        """The rules in words, heaviest first."""
        order = sorted(range(len(self.rules)), key=lambda k: -abs(self.weights[k]))
        bound = lambda k, low, high: f"{low:.4g} < {STATISTICS[k]} <= {high:.4g}"
        return [f"{self.weights[k]:+.3f} if " + " and ".join(bound(*b) for b in self.rules[k]) for k in order]


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality") -> Ensemble:
    """``rows``: doc_id and x, as by :func:`measured`; ``labels``: doc_id and ``label`` of what may be learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    sample = stage(rows.join(known, "doc_id").select("label", "x"), "labelled")
    ones, n = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count(F.lit(1))).first()
    if not 0 < ones < n:
        return Ensemble([], [], math.log((ones + 0.5) / (n - ones + 0.5)))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=3, featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=SEED
    ).fit(sample.select("label", array_to_vector("x").alias("features")))
    rules = sorted(set().union(*(rules_of(tree._call_java("rootNode")) for tree in forest.trees)))
    if not rules:
        return Ensemble([], [], math.log(ones / (n - ones)))
    truths = F.array(*(holds(r, F.col("x")).cast("double") for r in rules))
    told = stage(sample.select("label", truths.alias("truths")), "truths")
    fitted = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, maxIter=PASSES, tol=1e-4).fit(
        told.select("label", array_to_vector("truths").alias("features"))
    )
    kept = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if w]
    return Ensemble([r for r, _ in kept], [w for _, w in kept], float(fitted.intercept))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and score for every row of ``docs``."""
    rows = measured(docs)
    return rows.select("doc_id", learn(rows, labels, label).score(F.col("x")).alias("score"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, label: str = "quality") -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns as they were, texts measured again in place."""
    ensemble = learn(measured(docs), labels, label)
    x = fresh(docs, "x")
    return docs.withColumn(x, measure(F.col("text"))).where(ensemble.score(F.col(x)) >= threshold).drop(x)
