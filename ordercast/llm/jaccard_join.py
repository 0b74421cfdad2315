"""Exact Jaccard join of shingle sets by a token-group matrix.

Tokens. Shingles are put into one global order: those that a sample of the documents shows to be frequent
come last, the most frequent at the very end, the others in the order of their hashes. (The sample affects
the order only, and any order gives the same result.) Two sets that reach the threshold have so many shingles
in common that the first ones of each, a tenth at 0.9, must share some: at least ``need``, if the prefixes are
longer by as many. A set's tokens are its prefix. Passages that many documents share end up behind it.

Groups. Equal sets are one class and are compared once. Tokens of one class only are dropped; a class
without others is linked with nothing. Each class goes to the group of its most frequent token, and stays
there if others of the group share a third of its tokens; if not, it is a group of its own. So groups hold similar
sets. Groups of more shingles than ``group_shingles`` are divided. The matrix holds each group's union of tokens,
and the sizes of its smallest and largest set.

Queries. Every class queries the groups that share tokens with it: if they are fewer than a single member
would share, or no member's size is near enough, the group stays closed. Groups that are opened get their
members' full shingle sets, read again from the texts of the classes concerned, and exact intersections decide.

Links within one task that join what is already joined are left out, so a task reports fewer links than
it has members and queries, however alike they are. Nothing is sampled or capped.

Null texts, and texts without words, have empty sets, linked with nothing; texts of any length are read to the end. Rows
are told apart by a 64-bit hash of id and text, their key, and a class goes by the smallest key of its rows: so ids may
repeat, with the same text or another, and every row gets a result of its own. Rows without an id link like others and
get their size, but no component. An empty table gives no rows. Other columns are not read. Ties (equally frequent
tokens) go to the smaller token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercast.llm.common import fresh, frugal, perhaps_among, prepare, runs, stage
from ordercast.llm.components import components
from ordercast.llm.words import hashes, mix, shingle_set, words

#: One document in so many shows which shingles are frequent: those in at least ``FREQUENT`` of them.
SAMPLE, FREQUENT = 8, 3
#: Frequent shingles that are ordered by frequency, at most (16 bytes each are broadcast).
ORDERED = 1_000_000


@dataclass(frozen=True)
class Threshold:
    """Sets of sizes a and b link if ``den * intersection >= num * union``."""

    num: int = 90
    den: int = 100
    #: Tokens that linked sets have to share, if they are large enough.
    shared: int = 4

    def least(self, size: int) -> int:
        """Shingles of a set of this size that a linked set has at least."""
        return -(-size * self.num // self.den)

    def need(self, size: int) -> int:
        """Tokens that a linked set shares at least; it may be smaller than this one."""
        return min(self.shared, self.least(self.least(size)))

    def prefix(self, size: int) -> int:
        return min(size, size - self.least(size) + self.shared)


class Order:
    """The frequent shingles, sorted by hash, and their frequencies."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by_hash = np.argsort(shingles)
        self.shingles, self.counts = shingles[by_hash], counts[by_hash]

    def first(self, s: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of sorted shingles in the global order."""
        if not len(self.shingles):
            return s[:n]
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        frequent = self.shingles[at] == s
        rare = s[~frequent][:n]
        if len(rare) == n:
            return rare
        late, counts = s[frequent], self.counts[at[frequent]]
        return np.concatenate([rare, late[np.lexsort((late, counts))][: n - len(rare)]])


def order_of(docs: DataFrame, width: int) -> Order:
    """The order that a sample of ``docs`` suggests."""

    @frugal
    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for texts in runs(batch["text"]):
                sets = [shingle_set(hashes(words(t)), width) for t in texts]
                yield pd.DataFrame({"shingle": np.concatenate(sets).view(np.int64)})

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    counts = sample.mapInPandas(seen, "shingle long").groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "shingle").limit(ORDERED).toArrow()
    return Order(found["shingle"].to_numpy().view(np.uint64), found["count"].to_numpy())


def row_key() -> Column:
    """Equal for rows with equal id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))


def signatures(docs: DataFrame, width: int, rule: Threshold) -> DataFrame:
    """doc_id, key, n_shingles, two checksums of the set, its tokens, and how many of them a partner shares."""
    order = docs.sparkSession.sparkContext.broadcast(order_of(docs, width))

    @F.pandas_udf("n_shingles long, f1 long, f2 long, tokens array<long>, need int")
    @frugal
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for texts in runs(batch):
                for text in texts:
                    s = shingle_set(hashes(words(text)), width)
                    n = len(s)
                    tokens = order.value.first(s, rule.prefix(n)).view(np.int64)
                    f1, f2 = mix(s).sum(dtype=np.uint64), mix(mix(s) + np.uint64(n)).sum(dtype=np.uint64)
                    rows.append((n, f1.astype(np.int64), f2.astype(np.int64), tokens, rule.need(n)))
            yield pd.DataFrame(rows, columns=["n_shingles", "f1", "f2", "tokens", "need"])

    made = docs.select("doc_id", row_key().alias("key"), signed.asNondeterministic()("text").alias("s"))
    return made.select("doc_id", "key", "s.*")


def _compare(part: pd.DataFrame, rule: Threshold) -> pd.DataFrame:
    """Links between the members of a group and a block of its queries, as a forest."""
    sets = [np.frombuffer(b, dtype=np.uint64) for b in part["shingles"]]
    ids, is_member = part["rep"].to_numpy(), part["member"].to_numpy()
    members = np.flatnonzero(is_member)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(members)), sizes[members])
    tokens = np.concatenate([sets[m] for m in members]) if len(members) else np.zeros(0, dtype=np.uint64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    parent = {i: i for i in ids.tolist()}

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    for q in np.flatnonzero(~is_member):
        low, high = np.searchsorted(tokens, sets[q], "left"), np.searchsorted(tokens, sets[q], "right")
        n = high - low
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        shared = np.bincount(owner[at], minlength=len(members))
        either = sizes[members] + sizes[q] - shared
        for m in members[np.flatnonzero(rule.den * shared >= rule.num * either)]:
            a, b = root(int(ids[q])), root(int(ids[m]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(ids[q]), int(ids[m])))
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def links(docs: DataFrame, classes: DataFrame, width: int, rule: Threshold, group_shingles: int) -> DataFrame:
    """Links (a, b) that connect what the threshold connects. ``classes``: rep, n_shingles, tokens, n_tokens, need."""
    known = classes.select("rep", "n_shingles", "need", "n_tokens")
    held = classes.select("rep", F.explode("tokens").alias("token"))
    shared = held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only tokens of several classes are kept from here on.
    held = stage(held.join(shared, "token"), "tokens")
    most = F.max(F.struct("n", (-F.col("token")).alias("t"))).over(Window.partitionBy("rep"))
    tried = stage(held.select("token", "rep", most.getField("t").alias("g")), "tried")
    chosen = tried.select("rep", "g").distinct()
    often = tried.groupBy("token", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = tried.join(often, ["token", "g"], "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("common"))
    placed = chosen.join(known, "rep").join(common, "rep", "left")
    at_home = F.coalesce(F.col("common") * 3 >= F.col("n_tokens"), F.lit(False))
    placed = placed.withColumn("g", F.when(at_home, F.col("g")).otherwise(F.xxhash64("rep", F.lit("alone"))))
    room = placed.groupBy("g").agg(F.ceil(F.sum("n_shingles") / group_shingles).alias("parts"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    placed = placed.join(room, "g").withColumn("group", F.xxhash64("g", part))
    grouped = stage(placed.select("rep", "group", "n_shingles", "need"), "groups")

    rows = held.select("token", "rep").join(grouped.select("rep", "group", "need"), "rep")
    matrix = rows.groupBy("token", "group").agg(F.count(F.lit(1)).alias("members"))
    asking = rows.select("token", "rep", F.col("group").alias("own"), "need")
    # A pair is found from both sides; one will do, so queries look at their own group and larger ones. In its own
    # group, a query's token counts if another member has it.
    met = asking.join(matrix, "token").where("own < group or (own = group and members > 1)")
    met = met.groupBy("rep", "group", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").drop("need")
    sizes = grouped.groupBy("group").agg(F.min("n_shingles").alias("smallest"), F.max("n_shingles").alias("largest"))
    near = f"{rule.den} * largest >= {rule.num} * n_shingles and {rule.num} * smallest <= {rule.den} * n_shingles"
    opened = met.join(grouped.select("rep", "n_shingles"), "rep").join(sizes, "group").where(near)
    opened = stage(opened.select("rep", "group", "n_shingles"), "opened")

    # Queries of one group are dealt to blocks, with the members in each.
    blocks = opened.groupBy("group").agg(F.ceil(F.sum("n_shingles") / (2 * group_shingles)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    queries = opened.join(blocks, "group").select("rep", "group", block.alias("block"), F.lit(False).alias("member"))
    members = grouped.join(blocks, "group").select(
        "rep", "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("member")
    )
    rows = stage(queries.unionAll(members), "asked")
    sets = _sets(docs, stage(rows.select("rep").distinct(), "wanted"), width)
    compare = lambda part: _compare(part, rule)
    return rows.join(sets, "rep").groupBy("group", "block").applyInPandas(compare, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and text of the rows of ``wanted``, whose reps are distinct.

    An inner join: Spark moves a semi join below the filter's join, and every text would be shuffled before it.
    """
    return perhaps_among(docs.select(row_key().alias("rep"), "text"), "rep", wanted, "rep").join(wanted, "rep")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The shingle hashes of the texts of ``wanted``, read again: rep, shingles (binary)."""

    @F.pandas_udf("binary")
    @frugal
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(hashes(words(t)), width).tobytes() for ts in runs(batch) for t in ts], dtype=object)

    made = _texts(docs, wanted).select("rep", packed.asNondeterministic()("text").alias("shingles"))
    return made.dropDuplicates(["rep"])


def without_copies(docs: DataFrame, width: int = 5, rule: Threshold = Threshold(80, 100)) -> DataFrame:
    """``docs`` with one row of each component, one with the smallest id; all columns as they were.

    Rows with empty sets stay. Of rows with the same id in a component, that with the smallest key stays, and of
    those with the same id and text, one; a row without an id stays only where none has one.
    """
    labelled = stage(_labelled(docs, width, rule, GROUP_SHINGLES).where("n_shingles > 0"), "labelled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).getField("key")
    keepers = labelled.groupBy("component").agg(first.alias("kept"))
    gone = labelled.join(keepers, "component").where("key <> kept").select("key").distinct()
    again = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    gone, again = stage(gone, "copies"), stage(again.join(gone, "key", "left_anti"), "repeated")
    key = fresh(docs, "key")
    keyed, gone, again = docs.withColumn(key, row_key()), gone.withColumnRenamed("key", key), again.withColumnRenamed("key", key)
    once = keyed.join(gone.unionAll(again), key, "left_anti")
    one_of = keyed.join(again, key, "left_semi").dropDuplicates([key])
    return once.unionByName(one_of).select(docs.columns)


GROUP_SHINGLES = 400_000


def _labelled(docs: DataFrame, width: int, rule: Threshold, group_shingles: int) -> DataFrame:
    """doc_id, key, n_shingles, component (a key; null for empty sets) and component_id for every row."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = stage(signatures(docs, width, rule), "signatures")
    of = ["n_shingles", "f1", "f2"]
    full = signed.where("n_shingles > 0")
    classes = stage(full.groupBy(*of).agg(F.min("key").alias("rep"), F.min("doc_id").alias("least")), "classes")
    sized = full.withColumn("n_tokens", F.size("tokens")).withColumnRenamed("key", "rep")
    held = sized.join(classes.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    found = components(links(docs, held.select("rep", "n_shingles", "tokens", "n_tokens", "need"), width, rule, group_shingles))
    member = classes.join(found, classes["rep"] == found["vertex"], "left").withColumn("component", F.coalesce("component", "rep"))
    member = stage(member.select(*of, "component", "least"), "members")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = member.drop("least").join(least, "component")
    linked = full.select("doc_id", "key", *of).join(labels, of)
    rows = linked.select("doc_id", "key", "n_shingles", "component", "component_id")
    alone = signed.where("n_shingles = 0").withColumn("component", F.lit(None).cast("long"))
    rows = rows.unionAll(alone.select("doc_id", "key", "n_shingles", "component", F.col("doc_id").alias("component_id")))
    return rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def jaccard_components(
    docs: DataFrame, width: int = 3, rule: Threshold = Threshold(), group_shingles: int = GROUP_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest id reachable by links, the document's own included."""
    return _labelled(docs, width, rule, group_shingles).select("doc_id", "n_shingles", "component_id")


def oracle(width: int = 3, rule: Threshold = Threshold()) -> str:
    """:func:`jaccard_components` of ``documents`` as DuckDB SQL: shingles joined with shingles."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
    FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
        ELSE list_distinct([{shingle} FOR i IN range(1, len(w) - {width - 2})]) END AS s FROM texts),
shingles AS (SELECT r, len(s) AS n, hash(unnest(s)) AS x FROM sets),
links AS (SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.r <> b.r
    GROUP BY a.r, b.r HAVING {rule.den} * count(*) >= {rule.num} * (any_value(a.n) + any_value(b.n) - count(*))),
reached AS (SELECT r, r AS other FROM sets UNION SELECT r, b FROM reached JOIN links ON other = a),
least AS (SELECT r.r, min(doc_id) AS component_id FROM reached r JOIN sets s ON r.other = s.r GROUP BY r.r)
SELECT doc_id, len(s) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN component_id END AS component_id
FROM sets JOIN least USING (r)
"""
