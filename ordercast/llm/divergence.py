"""How far the sources of a language diverge in their words, and which words set a source apart.

Terms are runs of ASCII letters and of all non-ASCII characters, A-Z in lower case. A language keeps the terms that
occur in at least ``min_docs`` of its documents; V is their number. A group (language, source) that has a kept term
``count`` times among N kept ones gives it p = 1 + floor(SCALE * (count + 2) / (N + 2 V)); so does the language as a whole.
Two p differ by f(p, q) = floor((p - q)**2 / (p + q)). All of it is in whole numbers.

- Part ``pair``: for each other source of the language the sum of f over all kept terms.
- Part ``term``: the ``top`` kept terms that the group has and uses more than its language, by f.

The sum of a pair is a row of a sparse matrix product, accumulated as by Gustavson. The index is term-major: the postings
of a kept term are its sources and counts. Hash blocks of terms hold whole postings; in a block each group goes through
its terms and scatters their postings into a dense accumulator with a slot for each peer, so no pair of postings is ever
a row. What a block sends on is accumulators: a number for each group and peer. Most terms are in one of two groups only,
or in neither; for these a count of zero still gives a p, the group's baseline b. So a pair's sum starts as V f(b, b'),
and a posting changes it: f(p, b') - f(b, b') for each peer (from the few different p of a group), and
f(p, p') - f(p, b') - f(b, p') + f(b, b') for each peer that has the term as well.

Terms are counted in the tasks, up to ``HELD`` entries at a time, and added up in one shuffle by (language, term), which no
frequent term and no large source makes uneven. The size of the index, which is written, sets the number of blocks. A
term's postings and an accumulator have at most as many entries as a language has sources.

Null text, language and source are ''. Texts of any length are read to the end. Each row is a document, also if its id is
null or repeated. A language that keeps no term has pairs of value 0 and no terms; a language's only source has no pairs; an
empty table has no rows. Ties go to the item that comes first in UTF-8. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordercast.llm.common import prepare, runs, stage

SCALE = 1_000_000_000
#: Counts that a task holds before it passes them on, and postings of a block, about.
HELD, BLOCK = 300_000, 200_000
#: Cells of an accumulator that are worked out at a time.
CELLS = 2_000_000

_LETTERS = bytes(c if c > 0x7F or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A else 0x20 for c in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The terms in UTF-8: splitting at ASCII bytes that are no letters leaves all other characters whole."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split(b" ")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): how often, and in how many documents, groups have each term; partial sums."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0

        def out() -> pd.DataFrame:
            rows = [(*group, t.decode("utf-8"), n, d[t]) for group, (often, d) in held.items() for t, n in often.items() if t]
            held.clear()
            return pd.DataFrame(rows, columns=["lang", "source", "term", "n", "d"])

        for batch in batches:
            texts = (t for part in runs(batch["text"]) for t in part)
            for lang, source, text in zip(batch["lang"], batch["source"], texts):
                often, d = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms_of(text)
                often.update(found)
                entries -= len(d)
                d.update(set(found))
                entries += len(d)
                if entries > HELD:
                    yield out()
                    entries = 0
        yield out()

    return docs.mapInPandas(counted, "lang string, source string, term string, n long, d long")


def index(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, source, n): the postings of kept terms, in one shuffle."""
    partial = term_counts(docs).repartition("lang", "term")
    groups = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = groups.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return terms.where(F.col("d") >= min_docs).select("lang", "term", F.inline("postings"))


def _shares(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """p of counts; in Python's whole numbers, which don't overflow."""
    return np.array([1 + SCALE * (int(c) + 2) // (total + 2 * v) for c in counts.tolist()], dtype=np.int64)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """At most 10**9 + 1, so squares of differences stay below 2**63."""
    gap = p - q
    return gap * gap // (p + q)


class Block:
    """The postings of some terms of a language, term-major and group-major."""

    def __init__(self, postings: pd.DataFrame, peers: pd.DataFrame):
        #: Peers by source; baselines; terms by number.
        self.peers = peers.sort_values("source", ignore_index=True)
        v, self.v_total = int(self.peers["v"].iloc[0]), int(self.peers["lang_total"].iloc[0])
        totals = [int(t) for t in self.peers["total"]]
        self.base = np.concatenate([_shares(np.zeros(1, dtype=np.int64), t, v) for t in totals])
        place = pd.Series(np.arange(len(self.peers)), index=self.peers["source"])
        self.term, self.terms = pd.factorize(postings["term"])
        order = np.argsort(self.term, kind="stable")
        self.term = self.term[order]
        self.group = place[postings["source"]].to_numpy()[order]
        counts = postings["n"].to_numpy(dtype=np.int64)[order]
        self.starts = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        self.p = np.zeros(len(counts), dtype=np.int64)
        for g in np.unique(self.group):
            mine = self.group == g
            different, back = np.unique(counts[mine], return_inverse=True)
            self.p[mine] = _shares(different, totals[g], v)[back]
        in_lang = [0] * len(self.terms)
        for t, n in zip(self.term.tolist(), counts.tolist()):
            in_lang[t] += n
        different, back = np.unique(np.array(in_lang, dtype=np.int64), return_inverse=True)
        self.q = _shares(different, self.v_total, v)[back]

    def row(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """What the terms of group ``g`` add to its sums with each peer: against baselines, and where both have the term."""
        mine = np.flatnonzero(self.group == g)
        against, both = np.zeros(len(self.base), dtype=np.int64), np.zeros(len(self.base), dtype=np.int64)
        p, times = np.unique(self.p[mine], return_counts=True)
        zero = _f(self.base[g], self.base)
        step = max(1, CELLS // len(self.base))
        for k in range(0, len(p), step):
            part = _f(p[k : k + step, None], self.base[None, :]) - zero
            against += (part * times[k : k + step, None]).sum(axis=0)
        # Scatter: the postings of each of the group's terms, into one slot per peer.
        for k in range(0, len(mine), step):
            part = mine[k : k + step]
            first, sizes = self.starts[self.term[part]], np.diff(self.starts)[self.term[part]]
            at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            own, peer, theirs = np.repeat(self.p[part], sizes), self.group[at], self.p[at]
            change = _f(own, theirs) - _f(own, self.base[peer]) - _f(self.base[g], theirs) + zero[peer]
            np.add.at(both, peer, change)
        return against, both

    def best(self, g: int, top: int) -> list[tuple[str, int]]:
        """The group's best terms of the block."""
        mine = np.flatnonzero(self.group == g)
        mine = mine[self.p[mine] > self.q[self.term[mine]]]
        value = _f(self.p[mine], self.q[self.term[mine]])
        if len(mine) > top:
            least = -np.partition(-value, top - 1)[top - 1]
            mine, value = mine[value >= least], value[value >= least]
        found = [(str(self.terms[t]), int(x)) for t, x in zip(self.term[mine], value)]
        return sorted(found, key=lambda r: (-r[1], r[0].encode("utf-8")))[:top]


_ROW = "lang string, source string, part string, item string, value long"


def _accumulate(postings: pd.DataFrame, peers: pd.DataFrame, top: int) -> Iterator[tuple]:
    lang, block = peers["lang"].iloc[0], Block(postings, peers)
    sources = block.peers["source"].tolist()
    for g in np.unique(block.group).tolist():
        against, both = block.row(g)
        for h, (one, two) in enumerate(zip((against + both).tolist(), against.tolist())):
            if h != g:
                yield lang, sources[g], "pair", sources[h], one
                yield lang, sources[h], "pair", sources[g], two
        for term, value in block.best(g, top):
            yield lang, sources[g], "term", term, value


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank for every group of ``docs`` (text, lang, source)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    postings = stage(index(docs, min_docs), "postings")
    blocks = max(1, -(-postings.count() // BLOCK))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("v"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stage(groups.na.fill(0), "groups")

    def accumulate(postings: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
        rows = _accumulate(postings, peers, top) if len(postings) else ()
        return pd.DataFrame(list(rows), columns=["lang", "source", "part", "item", "value"])

    dealt = postings.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    peers = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = dealt.groupBy("lang", "block").cogroup(peers.groupBy("lang", "block")).applyInPandas(accumulate, _ROW)
    found = stage(found, "accumulated")
    # The sums start with what terms in neither group give: a dense row for each group.
    base = F.expr(f"1 + {2 * SCALE} div (total + 2 * v)")
    based = groups.withColumn("b", F.when(F.col("v") > 0, base))
    row = F.collect_list(F.struct(F.col("source").alias("item"), F.col("b").alias("c"))).over(Window.partitionBy("lang"))
    dense = based.withColumn("row", row).select("lang", "source", "b", "v", F.inline("row")).where("item <> source")
    start = F.coalesce(F.expr("v * ((b - c) * (b - c) div (b + c))"), F.lit(0).cast("long"))
    dense = dense.select("lang", "source", F.lit("pair").alias("part"), "item", start.alias("value"))
    summed = dense.unionByName(found).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranking = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = summed.withColumn("rank", F.row_number().over(ranking))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def oracle(min_docs: int = 10, top: int = 10) -> str:
    """:func:`audit` of ``documents`` as DuckDB SQL, from the definition: every kept term for every group."""
    share = lambda n, total, v: f"1 + ({SCALE}::HUGEINT * ({n} + 2)) // ({total} + 2 * {v})"
    f = lambda p, q: f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
found AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source,
        unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM found GROUP BY ALL HAVING count(*) >= {min_docs}),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, sum(f.n) AS n FROM found f JOIN kept k USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
groups AS (SELECT d.lang, d.source, coalesce(t.total, 0) AS total, coalesce(l.v, 0) AS v, l.total AS lang_total
    FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN totals t USING (lang, source) LEFT JOIN langs l USING (lang)),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, ({share("coalesce(c.n, 0)", "g.total", "g.v")}) AS p,
        ({share("k.n", "g.lang_total", "g.v")}) AS q
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({f("a.p", "b.p")}) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL SELECT lang, source, 'term', term, {f("p", "q")} FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
