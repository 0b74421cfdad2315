"""The pipeline's stages and the registered queries, on the smallest test tables."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ordercast.llm import perplexity, queries, toxicity
from ordercast.llm.common import fold, stage
from ordercast.llm.words import hashes, words

from .test_decontamination import plain_tiling
from .test_jaccard_join import brute
from .test_packing import verify

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before each stage, and the last stage's result."""
    out = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for name, apply in corpus_pipeline.STAGES:
        out.append(stage(apply(spark, out[-1], SF_DIR), name.replace(" ", "_")))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_and_drop_documents_only(stages):
    whole = {r.doc_id: r for r in stages[0].collect()}
    for before, after in zip(stages, stages[1:-1]):
        assert after.columns == stages[0].columns
        rows = after.collect()
        assert all(whole[r.doc_id] == r for r in rows) and len(rows) == len({r.doc_id for r in rows})
        assert {r.doc_id for r in rows} <= set(ids(before))


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where(fold(F.col("doc_id"), 4) != 2)
    scores = toxicity.scores(stages[0], labels).collect()
    assert ids(stages[1]) == sorted(r.doc_id for r in scores if r.score < 0.3)


def test_low_quality_goes(stages):
    assert ids(stages[2]) == sorted(r.doc_id for r in perplexity.verdicts(stages[1]).collect() if r.kept)


def test_one_of_each_group_stays(stages):
    groups = brute(stages[2].select("doc_id", "text").collect(), 5, 80, 100)
    assert ids(stages[3]) == sorted(d for d, (_, c) in groups.items() if d == c)


def test_leaks_go(spark, stages):
    items = [hashes(words(r.text or "")).tolist() for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    left = []
    for r in stages[3].collect():
        text = hashes(words(r.text or "")).tolist()
        seeds = {tuple(text[i : i + 5]) for i in range(len(text) - 4)}
        near = [i for i in items if any(tuple(i[k : k + 5]) in seeds for k in range(len(i) - 4))]
        if not any(sum(n for _, _, n in plain_tiling(i, text, 5)) >= 0.5 * len(i) for i in near):
            left.append(r.doc_id)
    assert ids(stages[4]) == sorted(left)


def test_sequences(stages):
    verify(stages[5].collect(), stages[4].select("doc_id", "text").collect(), 2048)


def test_run(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF_DIR).select("doc_id", "piece", "length").collect()) == sorted(
        stages[5].select("doc_id", "piece", "length").collect()
    )


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_query_covers_its_table(spark, name):
    table = {"op6": "pages", "op7": "conversations"}.get(name.split("_")[0], "documents")
    source = spark.read.parquet(f"{SF_DIR}/{table}.parquet")
    rows = entry.queries()[name](spark, SF_DIR).collect()
    if name.startswith("op9"):
        assert {r.doc_id for r in rows} <= set(ids(source))
    elif name.startswith("op5"):
        assert {r.doc_id for r in rows} == set(ids(source))
    elif name.startswith("op11"):  # rows are of groups, not of documents: all pairs of a language's sources
        groups = {(r.lang or "", r.source or "") for r in source.select("lang", "source").collect()}
        pairs = sorted((*a, b[1]) for a in groups for b in groups if a[0] == b[0] and a[1] != b[1])
        assert sorted((r.lang, r.source, r.item) for r in rows if r.part == "pair") == pairs
    else:
        assert len(rows) == source.count()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    relation = con.sql(entry.oracle_sql()[name])
    df = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(relation.columns)
    rows = relation.select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in df.collect())


def test_the_rest_works_without_these_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("ordercast.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ordercast.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    import __spark_entry__ as without

    assert without.text_queries is None and set(without.queries()) == set(without._BY_PLAN)
