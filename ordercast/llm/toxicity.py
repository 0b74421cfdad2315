"""Toxicity scores: a learned lexicon, matched with misspellings, weighed by context.

Learning uses a bounded sample of labelled rows (``PER_LABEL`` of each label, by hash of the id): words and
word beginnings (stems) that toxic rows have far more often than others become the lexicon. The rest of the
sample, which the lexicon hasn't seen, gives the weights of a logistic regression on the features of
:func:`features`, and label counts over all labelled rows give the intercept.

Matching. The lexicon is a trie. Its Levenshtein automaton reads a word and holds every place in the trie that
the letters so far lead to with at most one edit; places that no edit can save drop out. The automaton is made
deterministic while it reads: a set of places is a state, and steps between states are remembered. So a word costs
a look-up per letter, most words are done after a few, and every term within one edit is found (terms of under
five letters take no edit).

Context. Around each hit, a window of words tells a quotation (quote marks, a verb of saying) from abuse
(someone addressed, exclamation, further hits).

Null and empty texts have no hit and get the score of such texts. Without labelled rows of both kinds every
text has the same score. Null labels and ids are not learned from, and of documents that repeat an id one is;
repeated labels count as often as they occur in the intercept, and once elsewhere.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercast.llm.common import REMEMBERED, fresh, frugal, prepare, runs

#: Labelled rows of each label that are learned from, and entries of the lexicon, at most.
PER_LABEL = 4000
TERMS = 2000
#: Words on either side of a hit that are looked at.
WINDOW = 6
#: Terms from this length on may be misspelled by one edit.
FUZZY_FROM = 5

# Marks and words that tell quotations and addresses.
OPENING, CLOSING = "\"'“«„‘‹", "\"'”»“’›"
SAYING = frozenset("said says called calls wrote word term quote dit appelle mot cite sagt sagte nennt wort dijo dice llama palabra".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein ihr euch tu te toi vous ton ta tú ti usted".split())

_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”«»„‘’‹›…–—¡¿"


def normal(word: str) -> str:
    return word.lower().strip(_EDGES)


@dataclass
class Lexicon:
    """Terms with weights; stems match words that begin with them."""

    terms: list[str]
    stems: list[bool]
    weights: list[float]
    exact: dict[str, int] = field(default_factory=dict)
    by_length: dict[int, dict[str, int]] = field(default_factory=dict)

    def __post_init__(self):
        for k, term in enumerate(self.terms):
            if self.stems[k]:
                self.by_length.setdefault(len(term), {})[term] = k
            else:
                self.exact[term] = k
        self.automaton = Automaton(self)

    def better(self, a: int, b: int) -> int:
        """The heavier one of two terms; -1 is none."""
        if a < 0 or b < 0:
            return max(a, b)
        return max(a, b, key=lambda k: (self.weights[k], -k))

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, kind) of the best match: kind 0 the word itself, 1 a stem, 2 with an edit."""
        if not word:
            return None
        if (k := self.exact.get(word)) is not None:
            return k, 0
        found = [s[word[:n]] for n, s in self.by_length.items() if word[:n] in s]
        if found:
            return max(found, key=lambda k: (self.weights[k], -k)), 1
        k = self.automaton.read(word)
        return (k, 2) if k >= 0 else None


class Automaton:
    """The Levenshtein automaton of a lexicon's trie, for one edit, made deterministic as far as it is used.

    A state is the places (trie node, edits) that the letters so far lead to, and the best stem passed.
    """

    #: States are forgotten beyond so many.
    MOST = 200_000

    def __init__(self, lexicon: Lexicon):
        self._lexicon = lexicon
        self._children: list[dict[str, int]] = [{}]
        self._word: list[int] = [-1]
        self._stem: list[int] = [-1]
        for k, term in enumerate(lexicon.terms):
            if len(term) < FUZZY_FROM:
                continue
            node = 0
            for c in term:
                if c not in self._children[node]:
                    self._children[node][c] = len(self._children)
                    self._children.append({})
                    self._word.append(-1)
                    self._stem.append(-1)
                node = self._children[node][c]
            ends = self._stem if lexicon.stems[k] else self._word
            ends[node] = lexicon.better(ends[node], k)
        self._start()

    def _start(self) -> None:
        self._numbers: dict[tuple, int] = {}
        self._places: list[frozenset[tuple[int, int]]] = []
        self._passed: list[int] = []
        self._steps: list[dict[str, int]] = []
        self._ends: list[int] = []
        self._state({(0, 0)}, -1)

    def _state(self, places: set[tuple[int, int]], passed: int) -> int:
        """The number of a state, after letters of the trie may have been left out."""
        left_out = {(child, 1) for node, edits in places if not edits for child in self._children[node].values()}
        places = {(n, e) for n, e in places | left_out if not e or (n, 0) not in places}
        for node, _ in places:
            passed = self._lexicon.better(passed, self._stem[node])
        key = frozenset(places), passed
        number = self._numbers.get(key)
        if number is None:
            number = self._numbers[key] = len(self._places)
            best = passed
            for node, _ in places:
                best = self._lexicon.better(best, self._word[node])
            self._places.append(key[0])
            self._passed.append(passed)
            self._ends.append(best)
            self._steps.append({})
        return number

    def _step(self, state: int, letter: str) -> int:
        places = set()
        for node, edits in self._places[state]:
            children = self._children[node]
            if letter in children:
                places.add((children[letter], edits))
            if not edits:
                places.add((node, 1))
                places.update((child, 1) for child in children.values())
        return self._state(places, self._passed[state])

    def read(self, word: str) -> int:
        """The heaviest term within one edit of the word or, for stems, of a beginning of it; -1 if none is."""
        if len(self._places) > self.MOST:
            self._start()
        state, steps, places = 0, self._steps, self._places
        for letter in word:
            after = steps[state].get(letter)
            if after is None:
                after = steps[state][letter] = self._step(state, letter)
            state = after
            if not places[state]:
                break
        return self._ends[state]


FEATURES = ("strongest", "words", "stems", "edited", "quoted", "addressed", "density", "crowded")


class Reader:
    """Features of texts; remembers what it has found out about words."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self._known: dict[str, tuple[int, int] | None] = {}

    def features(self, text: str) -> list[float]:
        words = text.split()
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.lexicon.match(normal(w))
        hits = [i for i, w in enumerate(words) if known[w] is not None]
        if not hits:
            return [0.0] * len(FEATURES)
        weights = self.lexicon.weights
        strongest = quoted = addressed = crowded = 0.0
        sums: list[dict[int, float]] = [{}, {}, {}]
        for n, i in enumerate(hits):
            term, kind = known[words[i]]
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            around = {normal(w) for w in before} | {normal(w) for w in after}
            opened = any(w[0] in OPENING for w in [*before[-3:], words[i]])
            closed = any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in [words[i], *after[:3]] if w.rstrip(".,;:!?"))
            if opened and closed and (len(words[i]) > 1) or around & SAYING:
                quoted += 1
                continue
            strongest = max(strongest, weights[term] * (1.0, 0.7, 0.5)[kind])
            sums[kind][term] = weights[term]
            addressed += bool(around & ADDRESS) or "!" in words[i]
            near = (n and i - hits[n - 1] <= WINDOW) or (n + 1 < len(hits) and hits[n + 1] - i <= WINDOW)
            crowded += bool(near)
        words_sum, stems_sum, edited_sum = (math.log1p(sum(s.values())) for s in sums)
        density = math.log1p(100 * (len(hits) - quoted) / len(words))
        counts = (math.log1p(quoted), math.log1p(addressed), density, math.log1p(crowded))
        return [strongest, words_sum, stems_sum, edited_sum, *counts]


def _term_counts(sample: DataFrame, stem_lengths: range) -> DataFrame:
    """(term, stem, toxic, clean): in how many texts of either label words and stems occur."""

    @frugal
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                found = {normal(w) for w in (text if isinstance(text, str) else "").split()}
                terms = {(w, False) for w in found if 3 <= len(w) <= 40}
                terms |= {(w[:n], True) for w in found for n in stem_lengths if len(w) > n}
                counts.update((t, s, int(toxic)) for t, s in terms)
        rows = [(t, s, n if toxic else 0, 0 if toxic else n) for (t, s, toxic), n in counts.items()]
        yield pd.DataFrame(rows, columns=["term", "stem", "toxic", "clean"])

    partial = sample.select("text", "toxic").mapInPandas(counted, "term string, stem boolean, toxic long, clean long")
    return partial.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, least: float = 2.0, min_rows: int = 3) -> Lexicon:
    """The terms that toxic rows of the sample have more often, by log odds of at least ``least``."""
    totals = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon([], [], [])
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    good = _term_counts(sample, range(4, 9)).withColumn("odds", odds)
    # A stem needs more rows than a word, as it is a looser match.
    enough = F.col("toxic") >= F.when(F.col("stem"), 2 * min_rows).otherwise(min_rows)
    best = good.where(enough & (F.col("odds") >= least)).orderBy((-F.col("odds") * F.sqrt("toxic")), "term", "stem")
    rows = best.limit(4 * TERMS).collect()
    words = {r["term"]: r for r in rows if not r["stem"]}
    chosen = list(words.values())
    for r in rows:
        # A stem is worth keeping only if it occurs in clearly more rows than any one word with it.
        most = max((w["toxic"] for t, w in words.items() if t.startswith(r["term"])), default=0)
        if r["stem"] and r["toxic"] >= 1.3 * most + 1:
            chosen.append(r)
    chosen = sorted(chosen, key=lambda r: (-r["odds"] * math.sqrt(r["toxic"]), r["term"], r["stem"]))[:TERMS]
    return Lexicon([r["term"] for r in chosen], [r["stem"] for r in chosen], [float(r["odds"]) for r in chosen])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + keep @ w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, slope)
    return w


@dataclass
class Scorer:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, dtype=float).reshape(-1, len(FEATURES))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _features(text: Column, lexicon) -> Column:
    @F.pandas_udf("array<double>")
    @frugal
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(lexicon.value)
        for batch in batches:
            yield pd.Series([reader.features(t) for ts in runs(batch) for t in ts], dtype=object)

    return read.asNondeterministic()(text)


def learn(docs: DataFrame, labelled: DataFrame) -> Scorer:
    """``labelled``: doc_id and toxic (0 or 1) of the rows that may be learned from."""
    prepare(docs.sparkSession)
    labelled = labelled.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int"))
    totals = dict(labelled.groupBy("toxic").count().collect())
    order = F.xxhash64("doc_id")
    ids = labelled.distinct()
    parts = [ids.where(F.col("toxic") == v).orderBy(order, "doc_id").limit(PER_LABEL) for v in (0, 1)]
    chosen = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionAll(parts[1])), "doc_id")
    # Of rows that repeat an id, the one whose text has the smallest hash: at most 2 * PER_LABEL rows.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).getField("text")
    sample = chosen.groupBy("doc_id", "toxic").agg(one.alias("text"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10))
    lexicon = learn_lexicon(sample.where(share < 6))
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    rest = sample.where(share >= 6).select("toxic", _features(F.col("text"), sent).alias("x")).toPandas()
    weights = np.zeros(len(FEATURES) + 1)
    y = rest["toxic"].to_numpy(dtype=float)
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if 0 < y.sum() < len(y):
        weights = _logistic(np.stack(rest["x"].to_numpy()), y)
        weights[-1] += math.log(toxic / clean) - math.log(y.sum() / (len(y) - y.sum()))
    elif toxic + clean:
        weights[-1] = math.log((toxic + 0.5) / (clean + 0.5))
    return Scorer(lexicon, weights)


def score(text: Column, scorer) -> Column:
    """The score of a text, 0 to 1. ``scorer`` is a broadcast :class:`Scorer`."""

    @F.pandas_udf("double")
    @frugal
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(scorer.value.lexicon)
        for batch in batches:
            yield pd.Series(scorer.value.scores([reader.features(t) for ts in runs(batch) for t in ts]))

    return scored.asNondeterministic()(text)


def scores(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id and score for every document."""
    scorer = docs.sparkSession.sparkContext.broadcast(learn(docs, labelled))
    return docs.select("doc_id", score(F.col("text"), scorer).alias("score"))


def keep_harmless(docs: DataFrame, labelled: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; all columns as they were."""
    scorer = docs.sparkSession.sparkContext.broadcast(learn(docs, labelled))
    name = fresh(docs, "score")
    return docs.withColumn(name, score(F.col("text"), scorer)).where(F.col(name) < threshold).drop(name)
