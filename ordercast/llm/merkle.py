"""Merkle manifest of a table: leaves, subtrees by source, one root, and a proof for every row.

A leaf is the hash of a row's fields. Leaves of a source, in order of id, are hashed in runs of ``FANOUT``, and so are
the results, until one is left, the source's subroot; subroots, in order of source, are the leaves of the top tree.

Nodes are labelled by nested intervals: a node covers leaf ranks [lo, hi) of its tree. A node of level k starts at a
multiple of ``FANOUT ** k``, so a rank's ancestor at a level lies in the bucket ``rank div FANOUT ** k``, and the
containment join (node inside of parent) is an equi-join on tree, level and bucket, with the interval as its residue. The
siblings on a path are what the parent's interval holds less the node's own: the part before it and the part after it.
Going down from the root, each run of nodes takes over the path of its parent, so a path is made once for ``FANOUT``
rows and attached to rows in the last join only.

Ranks come from a range sort: a partition counts its rows per tree, counts of partitions add up to where each starts,
and a row's rank is that plus its place in the partition. So a source that holds a third of all rows is spread like the
others, no window runs over a tree's rows, and a run of ``FANOUT`` hashes is all that a task holds of a tree.

Null fields count as ``-``; a null source is a source of its own, sorted first, and so are null ids. Texts of any length
are hashed to the end. Rows that repeat an id are ordered by their leaf; equal rows are leaves of their own with equal
hashes, and either may take either place. An empty table gives no rows. Other columns are left out; columns whose names are
used in here do no harm, as only the fields are read. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercast.llm.common import stage

FANOUT = 16
#: Fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank``, from 0 in each ``tree`` by ``order``, and ``size``, the rows of the tree. Written once."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    written = stage(placed.withColumn("part", F.shiftright("place", 33)), "leaves")
    parts = written.groupBy(tree, "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(
        F.col(tree).alias("of"),
        F.col("part").alias("in_part"),
        (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size"),
    )
    parts = stage(parts, "parts")
    same = F.col(tree).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part"))
    return written.join(parts, same).select(*rows.columns, (F.col("place") + F.col("shift")).alias("rank"), "size")


def runs(nodes: DataFrame, tree: str, *payload: str) -> DataFrame:
    """Nodes of one level that are not yet alone, in runs of ``FANOUT``: a row is their parent, ``children`` in order.

    ``nodes``: tree, lo, hi, level, hash, size. The parent's interval and hash are the children's, joined.
    """
    above = F.col("level") + 1
    width = F.pow(F.lit(float(FANOUT)), above).cast("long")
    child = F.struct("lo", "hi", "hash", *payload)
    grouped = nodes.groupBy(tree, F.floor(F.col("lo") / width).alias("bucket"), above.alias("level"))
    grouped = grouped.agg(F.array_sort(F.collect_list(child)).alias("children"), F.first("size").alias("size"))
    joined = F.array_join(F.transform("children", lambda c: c["hash"]), "")
    return grouped.select(
        tree,
        "bucket",
        "level",
        F.element_at("children", 1)["lo"].alias("lo"),
        F.element_at("children", -1)["hi"].alias("hi"),
        F.sha2(joined, 256).alias("hash"),
        "children",
        "size",
    )


def _hashes_between(children: Column, lo: Column, hi: Column) -> Column:
    """The hashes of the children inside of [lo, hi), joined."""
    inside = F.filter(children, lambda c: (c["lo"] >= lo) & (c["hi"] <= hi))
    return F.array_join(F.transform(inside, lambda c: c["hash"]), "")


def _with_siblings(run: DataFrame, path: Column) -> DataFrame:
    """A row per child, its ``path``: what stands before and after it in the run, then the parent's path."""
    child = F.col("child")
    step = F.struct(
        _hashes_between(F.col("children"), F.col("lo"), child["lo"]).alias("left"),
        _hashes_between(F.col("children"), child["hi"], F.col("hi")).alias("right"),
    )
    return run.withColumn("child", F.explode("children")).withColumn("path", F.concat(F.array(step), path))


_PATH = "array<struct<left:string,right:string>>"


@dataclass
class Forest:
    """The trees over some leaves: runs of children by level, leaves that are alone, and each tree's top."""

    tree: str
    payload: tuple[str, ...]
    levels: list[DataFrame]
    alone: DataFrame
    tops: DataFrame


def build(leaves: DataFrame, tree: str, *payload: str) -> Forest:
    """``leaves``: tree, hash, rank, size and payload. ``tops`` has tree and top; a level is written, then hashed further."""
    nodes = leaves.select(tree, F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.lit(0).alias("level"), "hash", "size", *payload)
    alone = nodes.where("size = 1").select(tree, "hash", *payload)
    tops = alone.select(tree, F.col("hash").alias("top"))
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels: list[DataFrame] = []
    while FANOUT ** len(levels) < largest:
        # What is alone at this level stays out: it is its tree's top.
        more = nodes.where(F.col("size") > FANOUT ** len(levels))
        levels.append(stage(runs(more, tree, *(() if levels else payload)), f"level_{len(levels) + 1}"))
        nodes = levels[-1].drop("children", "bucket")
        tops = tops.unionAll(nodes.where(F.col("size") <= FANOUT ** len(levels)).select(tree, F.col("hash").alias("top")))
    return Forest(tree, payload, levels, alone, tops)


def paths(forest: Forest, above: DataFrame) -> DataFrame:
    """tree, hash, payload and path of every leaf, with what else ``above`` has.

    ``above`` has a row for each tree, with the path from its top on. A path has a step for each level, from the
    leaf up.
    """
    tree = forest.tree
    carried = [c for c in above.columns if c not in (tree, "path")]
    given = [F.col("a.path").alias("given"), *(F.col(f"a.{c}").alias(c) for c in carried)]
    same = lambda left: F.col(f"{left}.{tree}").eqNullSafe(F.col(f"a.{tree}"))
    start = above.alias("a")
    out = forest.alone.alias("l").join(start, same("l")).select("l.*", F.col("a.path").alias("path"), *given[1:])
    covering = None
    for k in range(len(forest.levels) - 1, -1, -1):
        run = forest.levels[k].alias("r")
        found = run.where(F.col("size") <= FANOUT ** (k + 1)).join(start, same("r")).select("r.*", *given)
        if covering is not None:
            covers = (F.col("a.lo") <= F.col("r.lo")) & (F.col("a.hi") >= F.col("r.hi"))
            at = (F.col("a.level") == F.col("r.level")) & (F.col("a.bucket") == F.col("r.bucket"))
            found = found.unionByName(run.join(covering.alias("a"), same("r") & at & covers).select("r.*", *given))
        down = _with_siblings(found, F.col("given"))
        if not k:
            picked = [F.col("child")[c].alias(c) for c in forest.payload]
            return out.unionByName(down.select(tree, F.col("child.hash").alias("hash"), "path", *picked, *carried))
        lo, hi = F.col("child.lo"), F.col("child.hi")
        bucket = F.floor(lo / FANOUT**k)
        covering = down.select(tree, F.lit(k).alias("level"), bucket.alias("bucket"), lo.alias("lo"), hi.alias("hi"), "path", *carried)
    return out


def proof(path: Column) -> Column:
    """The hash of all siblings on a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def tampered(text: Column, doc_id: Column, every: int = 5) -> Column:
    """The text; where ``every`` divides the crc32 of the id, with A-Z in lower case."""
    chosen = F.coalesce(F.crc32(doc_id.cast("string")) % every == 0, F.lit(False))
    return F.when(chosen, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def manifest(docs: DataFrame, seen: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    ``seen`` is the text as it is found at verification; without it, that of the table.
    """
    *rest, text = (F.col(c) for c in FIELDS)
    seen = text if seen is None else seen
    changed = F.when(~seen.eqNullSafe(text), leaf_hash(*rest, seen))
    leaves = docs.select("source", "doc_id", leaf_hash(*rest, text).alias("hash"), changed.alias("changed"))
    leaves = ranked(leaves, "source", ["doc_id", "hash"])
    sources = build(leaves, "source", "doc_id", "changed")
    subroots = stage(sources.tops.select(F.lit(0).alias("all"), "source", F.col("top").alias("hash")), "subroots")
    upper = build(ranked(subroots, "all", ["source"]), "all", "source")
    start = upper.tops.select("all", F.col("top").alias("root"), F.array().cast(_PATH).alias("path"))
    above = paths(upper, start).select("source", F.col("hash").alias("subroot"), "root", "path")
    whole = paths(sources, stage(above, "above"))
    return whole.select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32(text: str) -> str:
    """DuckDB SQL of a text's crc32: ASCII only, bit by bit."""
    shift = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {shift}), 4294967295)"


def _sql_tree(name: str, leaves: str, tree: str, levels: int) -> str:
    """CTEs of a tree over ``leaves`` (tree, r, hash): <name>_path_<levels> has node and siblings per leaf, <name>_top the tops."""
    n = f"{name}_0 AS (SELECT {tree}, r AS j, hash, count(*) OVER (PARTITION BY {tree}) AS n FROM {leaves})"
    ctes = [n]
    for k in range(levels):
        up = f"SELECT {tree}, j // {FANOUT} AS j, sha256(string_agg(hash, '' ORDER BY j)) AS hash, any_value(n) AS n FROM {name}_{k} WHERE n > 1 GROUP BY {tree}, j // {FANOUT}"
        ctes.append(f"{name}_up_{k} AS ({up})")
        ctes.append(
            f"{name}_{k + 1} AS (SELECT {tree}, j, hash, count(*) OVER (PARTITION BY {tree}) AS n FROM {name}_up_{k} "
            f"UNION ALL SELECT {tree}, j, hash, n FROM {name}_{k} WHERE n = 1)"
        )
        ctes.append(
            f"{name}_sib_{k} AS (SELECT a.{tree}, a.j, coalesce(string_agg(b.hash, '' ORDER BY b.j) FILTER (b.j < a.j), '') AS l, "
            f"coalesce(string_agg(b.hash, '' ORDER BY b.j) FILTER (b.j > a.j), '') AS r FROM {name}_{k} a JOIN {name}_{k} b "
            f"ON a.{tree} IS NOT DISTINCT FROM b.{tree} AND a.j // {FANOUT} = b.j // {FANOUT} WHERE a.n > 1 GROUP BY ALL)"
        )
    return ", ".join(ctes)


def oracle(levels: int = 5) -> str:
    """:func:`manifest` of ``documents`` with every fifth text tampered as DuckDB SQL, for up to 16**levels leaves."""
    fields = lambda text: " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR))::VARCHAR || ':' || CAST({c} AS VARCHAR), '-')" for c in (*FIELDS[:-1], text)
    )
    steps, fold = [], "p0 AS (SELECT *, '' AS sib, coalesce(changed, hash) AS f FROM leaves)"
    steps.append(fold)
    at = 0
    for name, key, place in (("s", "source", "r"), ("t", "one", "top_r")):
        for k in range(levels):
            steps.append(
                f"p{at + 1} AS (SELECT p.* REPLACE (sib || coalesce(x.l || x.r, '') AS sib, CASE WHEN x.l IS NULL THEN f ELSE sha256(x.l || f || x.r) END AS f) "
                f"FROM p{at} p LEFT JOIN {name}_sib_{k} x ON p.{key} IS NOT DISTINCT FROM x.{key} AND p.{place} // {FANOUT**k} = x.j)"
            )
            at += 1
    return f"""
WITH raw AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
        THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS seen FROM documents),
hashed AS (SELECT doc_id, source, sha256({fields("text")}) AS hash,
        CASE WHEN seen IS DISTINCT FROM text THEN sha256({fields("seen")}) END AS changed FROM raw),
ordered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS r FROM hashed),
{_sql_tree("s", "ordered", "source", levels)},
subroots AS (SELECT 0 AS one, source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r FROM s_{levels}),
{_sql_tree("t", "subroots", "one", levels)},
leaves AS (SELECT o.*, 0 AS one, b.r AS top_r, b.hash AS subroot FROM ordered o JOIN subroots b ON o.source IS NOT DISTINCT FROM b.source),
{", ".join(steps)}
SELECT doc_id, p.hash AS leaf, subroot, t.hash AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = t.hash AS verified
FROM p{at} p CROSS JOIN t_{levels} t
"""
