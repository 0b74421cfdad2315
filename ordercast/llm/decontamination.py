"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared only if they share a window of ``min_match`` words (a seed),
and only if the item's words under shared seeds could reach the threshold at all; tiles are made of seeds,
so this bound loses nothing. Then the longest common runs of words are tiled, longest first, each word of
either side in one tile at most; runs are found by Karp-Rabin hashes of windows, whose length starts at the
longest possible run and shrinks. An item counts as leaked if its tiles cover ``min_coverage`` of its words,
in whatever order they come.

Items are sent to the tasks in blocks of at most ``block_words`` words, so what is broadcast has a size
bound; a larger benchmark takes several passes over the documents. Items shorter than ``min_match`` words
are seeds as a whole. Null or empty texts, of either side, match nothing. Repeated items are separate items;
null item ids are kept. Of equally long runs the one that comes first in the item, then in the document, is
tiled first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercast.llm.common import fresh, frugal, prepare, runs
from ordercast.llm.words import hashes, windows, words

#: Words of benchmark items in one broadcast: 16 bytes each.
BLOCK_WORDS = 2_000_000


@dataclass
class Items:
    """Benchmark items and, by window width, the sorted seeds with the items and positions that have them."""

    ids: list
    hashed: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple], min_match: int) -> Items:
        hashed = [hashes(words(text)) for _, text in rows]
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, h in enumerate(hashed):
            if len(h):
                width = min(min_match, len(h))
                by_width.setdefault(width, []).append((k, windows(h, width)))
        seeds = {}
        for width, found in by_width.items():
            all_seeds = np.concatenate([w for _, w in found])
            item = np.concatenate([np.full(len(w), k, dtype=np.int32) for k, w in found])
            at = np.concatenate([np.arange(len(w), dtype=np.int32) for _, w in found])
            order = np.argsort(all_seeds, kind="stable")
            seeds[width] = all_seeds[order], item[order], at[order]
        return Items([i for i, _ in rows], hashed, seeds)


def tile(item: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in item, start in text, length)."""
    free_item, free_text = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(item), len(text))
    while length >= shortest:
        # Windows of this length without a marked word, found by hash, then compared and extended.
        matches = []
        in_item, in_text = _free_windows(item, free_item, length), _free_windows(text, free_text, length)
        if len(in_item) and len(in_text):
            key_item, key_text = windows(item, length)[in_item], windows(text, length)[in_text]
            order = np.argsort(key_item, kind="stable")
            low = np.searchsorted(key_item[order], key_text, "left")
            high = np.searchsorted(key_item[order], key_text, "right")
            for t in np.flatnonzero(high > low):
                for k in order[low[t] : high[t]]:
                    a, b, n = int(in_item[k]), int(in_text[t]), length
                    if not np.array_equal(item[a : a + n], text[b : b + n]):
                        continue
                    while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n]:
                        if not (free_item[a + n] and free_text[b + n]):
                            break
                        n += 1
                    matches.append((-n, a, b))
        if matches:
            longest = max(-n for n, _, _ in matches)
            if longest > 2 * length:
                length = longest
                continue
            for n, a, b in sorted(matches):
                n = -n
                if free_item[a : a + n].all() and free_text[b : b + n].all():
                    tiles.append((a, b, n))
                    free_item[a : a + n] = free_text[b : b + n] = False
        # Matches cut by an earlier tile may leave runs of this length; they are found in the next round.
        elif length == shortest:
            break
        else:
            length = max(shortest, length // 2 if length > 2 * shortest else length - 1)
    return tiles


def _free_windows(h: np.ndarray, free: np.ndarray, length: int) -> np.ndarray:
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(marked[length:] == marked[:-length])


def _near_seeds(h: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The parts of a text under seeds, each followed by a word that no item has."""
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    keep = np.cumsum(covered[:-1]) > 0
    cuts = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0, append=0))
    gap = np.zeros(1, dtype=np.uint64)
    return np.concatenate([x for a, b in zip(cuts[::2], cuts[1::2]) for x in (h[a:b], gap)])


def leaks(h: np.ndarray, items: Items, min_match: int, min_coverage: float) -> list[tuple]:
    """(item, coverage, tiles, longest tile) of the items that the text with word hashes ``h`` leaks."""
    out = []
    for width, (seeds, item, at) in items.seeds.items():
        found = windows(h, width)
        if not len(found):
            continue
        low = np.searchsorted(seeds, found, "left")
        hit = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == found)
        if not len(hit):
            continue
        unique, back = np.unique(found[hit], return_inverse=True)
        first, last = np.searchsorted(seeds, unique, "left"), np.searchsorted(seeds, unique, "right")
        by_item: dict[int, list[int]] = {}
        for u, (a, b) in enumerate(zip(first, last)):
            for s in range(a, b):
                by_item.setdefault(int(item[s]), []).append((u, int(at[s])))
        for k, pairs in by_item.items():
            words_of = items.hashed[k]
            reachable = np.zeros(len(words_of), dtype=bool)
            for _, p in pairs:
                reachable[p : p + width] = True
            if reachable.sum() < min_coverage * len(words_of):
                continue
            wanted = np.zeros(len(unique), dtype=bool)
            wanted[[u for u, _ in pairs]] = True
            near = _near_seeds(h, hit[wanted[back]], width)
            tiles = tile(words_of, near, width)
            coverage = sum(n for _, _, n in tiles) / len(words_of)
            if coverage >= min_coverage:
                out.append((items.ids[k], coverage, len(tiles), max(n for _, _, n in tiles)))
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of about ``block_words`` words."""
    size = F.coalesce(F.size(F.split("text", r"[\x20\x09-\x0D]+")), F.lit(0))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // block_words)
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for b in range(blocks):
        part = benchmark.where(F.col("text").isNotNull() & (dealt == b))
        yield sorted(((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()), key=repr)


def _found(text: Column, items, id_type: str, min_match: int, min_coverage: float) -> Column:
    @F.pandas_udf(f"array<struct<item_id {id_type}, coverage double, n_tiles int, longest int>>")
    @frugal
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for texts in runs(batch):
                for t in texts:
                    rows = leaks(hashes(words(t)), items.value, min_match, min_coverage)
                    names = ("item_id", "coverage", "n_tiles", "longest")
                    out.append([dict(zip(names, r)) for r in rows])
            yield pd.Series(out, dtype=object)

    return found.asNondeterministic()(text)


def _passes(docs: DataFrame, benchmark: DataFrame, min_match: int, min_coverage: float, block_words: int):
    spark = docs.sparkSession
    prepare(spark)
    id_type = dict(benchmark.dtypes)["item_id"]
    for rows in _blocks(benchmark, block_words):
        items = spark.sparkContext.broadcast(Items.of(rows, min_match))
        yield _found(F.col("text"), items, id_type, min_match, min_coverage)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = 5,
    min_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest) for every leaked item of every document."""
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = "doc_id {}, item_id {}, coverage double, n_tiles int, longest int".format(*kinds)
    out = docs.sparkSession.createDataFrame([], schema)
    for found in _passes(docs, benchmark, min_match, min_coverage, block_words):
        out = out.unionAll(docs.select("doc_id", F.explode(found).alias("leak")).select("doc_id", "leak.*"))
    return out


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = 5,
    min_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the documents that leak an item; all columns as they were."""
    for found in _passes(docs, benchmark, min_match, min_coverage, block_words):
        name = fresh(docs, "leaks")
        docs = docs.withColumn(name, F.size(found)).where(F.col(name) == 0).drop(name)
    return docs
