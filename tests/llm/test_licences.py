import math
import random
from collections import Counter

import duckdb
import pytest

from ordercast.llm import licences
from ordercast.llm.licences import TEMPLATES, tokens_of

from .conftest import prose

FILES = "path string, text string"


def plain(files):
    """path: (licence, origin, cosine, directory), by definition."""
    vectors = [Counter(tokens_of(t)) for _, t in TEMPLATES]
    df = Counter(w for v in vectors for w in v)
    idf = lambda w: math.log((1 + len(TEMPLATES)) / (1 + df[w])) + 1

    def best(text, least):
        v, out = Counter(tokens_of(text)), []
        norm = math.sqrt(sum((n * idf(w)) ** 2 for w, n in v.items()))
        for (name, _), t in zip(TEMPLATES, vectors):
            dot = sum(n * t[w] * idf(w) ** 2 for w, n in v.items())
            cosine = round(dot / norm / math.sqrt(sum((n * idf(w)) ** 2 for w, n in t.items())), 9) if v else 0
            if cosine >= least:
                out.append((-cosine, name))
        return out

    own, folders = {}, {}
    for path, text in files.items():
        whole = best(text, licences.FILE_LEAST)
        if found := whole + [b for line in text.split("\n") for b in best(line, licences.LINE_LEAST)]:
            own[path] = min(found)
            if whole:
                folder = path.rpartition("/")[0]
                folders[folder] = min(folders.get(folder, (1, "")), own[path])
    out = {}
    for path in files:
        if path in own:
            out[path] = own[path][1], "own", round(-own[path][0], 6), None
            continue
        out[path] = None, None, None, None
        folder = path
        while folder:
            folder = folder.rpartition("/")[0]
            if folder in folders:
                out[path] = folders[folder][1], "inherited", round(-folders[folder][0], 6), folder
                break
    return out


@pytest.fixture(scope="module")
def files():
    rng = random.Random(6)
    out = {}
    for k in range(250):
        path = "/".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4))) + f"/f{k}"
        lines = [prose(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 5))]
        notice = rng.choice(TEMPLATES)[1].split()
        if rng.random() < 0.3:
            for _ in range(rng.randint(0, 3)):
                notice[rng.randrange(len(notice))] = prose(rng, 1)
            lines.insert(rng.randint(0, len(lines)), "# " + " ".join(notice).upper())
        out[path.lstrip("/")] = "\n".join(lines)
    return out


def test_against_the_definition(spark, files):
    df = spark.createDataFrame(list(files.items()), FILES).selectExpr("*", "'own' as token", "'own' as line", "'own' as licence")
    found = {r.path: tuple(r)[1:] for r in licences.licences(df).collect()}
    want = plain(files)
    assert found == want
    assert Counter(w[1] for w in want.values()).keys() == {"own", "inherited", None}


def test_against_sql(spark, files):
    con = duckdb.connect()
    con.execute("CREATE TABLE files (path VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO files VALUES (?, ?)", [list(f) for f in files.items()])
    rows = con.sql(licences.oracle("path", "files")).fetchall()
    df = spark.createDataFrame(list(files.items()), FILES)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in licences.licences(df).collect())


def test_only_dataframe_functions_and_texts_are_read_once(spark, files, tmp_path):
    spark.createDataFrame(list(files.items()), FILES).write.parquet(str(tmp_path / "files"))
    table = spark.read.parquet(str(tmp_path / "files"))
    plans = [df._jdf.queryExecution().toString() for df in (licences.own_licences(table), licences.licences(table))]
    for plan in plans:
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD", "Cartesian", "NestedLoop"))
    physical = plans[1][plans[1].index("Physical Plan") :]
    assert "text#" not in physical and "rlike" not in physical.lower()


def test_odd_rows(spark):
    mit = TEMPLATES[7][1]
    rows = [(None, mit), ("a/b/x", None), ("a/LICENSE", mit), ("a/LICENSE", "more"), ("a/b/y", ""), ("z", "word " * 50_000), ("/q", mit), ("", None)]
    found = {r.path: r for r in licences.licences(spark.createDataFrame(rows, FILES)).collect()}
    assert set(found) == {"a/b/x", "a/LICENSE", "a/b/y", "z", "/q", ""}
    assert [found[p].origin for p in ("a/LICENSE", "a/b/x", "a/b/y")] == ["own", "inherited", "inherited"]
    assert found["a/b/x"].directory == "a" and found["/q"].licence == "MIT"
    assert licences.licences(spark.createDataFrame([], FILES)).collect() == []
