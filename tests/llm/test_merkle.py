import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ordercast.llm import merkle
from ordercast.llm.merkle import FANOUT

from .conftest import DOCUMENTS, prose

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row):
    return H(*map(field, row))


def tree(hashes):
    """The top, and for each leaf its (before, after) by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[k : k + FANOUT] for k in range(0, len(hashes), FANOUT)]
        for n, j in enumerate(at):
            run, place = runs[j // FANOUT], j % FANOUT
            paths[n].append(("".join(run[:place]), "".join(run[place + 1 :])))
        at = [j // FANOUT for j in at]
        hashes = [H(*run) for run in runs]
    return hashes[0], paths


def plain(rows):
    """The manifest by definition. Rows: doc_id, source, lang, n_chars, text."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources}
    root, upper = tree([made[s][0] for s in sources])
    out = []
    for s, above in zip(sources, upper):
        subroot, paths = made[s]
        for (_, _, leaf, r), path in zip(sorted(by_source[s], key=lambda x: x[:3]), paths):
            seen = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and seen is not None:
                seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in seen)
            h = leaf_of((*r[:4], seen))
            for before, after in path + above:
                h = H(before, h, after)
            out.append((r[0], leaf, subroot, root, H(*(b + a for b, a in path + above)), h, h == root))
    return sorted(out, key=repr)


def manifest(df):
    return sorted((tuple(r) for r in merkle.manifest(df, merkle.tampered(F.col("text"), F.col("doc_id"))).collect()), key=repr)


def picked(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("partitions", [1, 6])
def test_against_the_definition(spark, partitions):
    rng = random.Random(2)
    sizes = {"hot": 600, "one": 1, None: 17, "": 16, "é": 257, "z": 40}
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            k += rng.randint(0, 3)
            rows.append((k, rng.choice(["T", "t"]) + prose(rng, 3), rng.choice(["xx", None]), source, rng.choice([None, 5])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(partitions)
    want = plain(picked(df))
    assert manifest(df) == want
    assert {r[-1] for r in want} == {True, False} and len({r[2] for r in want}) == len(sizes)


def test_many_sources(spark):
    df = spark.range(300).selectExpr("id as doc_id", "'A' as text", "'l' as lang", "cast(id as string) as source", "id as n_chars")
    assert manifest(df) == plain(picked(df))


def test_one_row(spark):
    df = spark.createDataFrame([(3, "x", "l", "s", 1)], DOCUMENTS)
    (row,) = merkle.manifest(df).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == H("") and row.verified


def test_odd_rows(spark, odd, empty):
    odd = odd.withColumns({c: F.lit("own") for c in ("rank", "size", "hash", "level", "lo", "path", "children")})
    assert manifest(odd) == plain(picked(odd))
    assert manifest(empty) == []


def test_every_change_is_noticed(spark):
    df = spark.range(100).selectExpr("id as doc_id", "concat('Text ', id) as text", "'l' as lang", "'s' as source", "id as n_chars")
    found = merkle.manifest(df, F.concat(F.col("text"), F.lit(" "))).collect()
    assert len(found) == 100 and not any(r.verified for r in found)
    assert all(r.verified for r in merkle.manifest(df).collect())


def test_only_dataframe_functions_and_no_whole_tree(spark, tmp_path):
    spark.range(1000).selectExpr("id as doc_id", "'t' as text", "'l' as lang", "'s' as source", "id as n_chars").write.parquet(str(tmp_path / "d"))
    plan = merkle.manifest(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Cartesian", "NestedLoop", "Window"))
