"""Language of words and texts by a linear-chain conditional random field.

The chain's labels are the languages. A word's features are its prefixes and suffixes, its character n-grams
with word boundaries, and lexicon features: the word itself, and which languages' lexicons list it. Together
with a weight for each pair of neighbouring labels they are learned by gradient ascent on the likelihood of
label sequences, from a bounded sample of labelled texts (``TEXTS`` texts of each language, ``WORDS`` words of
each); stretches of different languages are strung together, so that transitions describe switches as well.

Forward-backward gives the probability of each label at each word. A text's language is the one with the
largest share, words counting by their letters; the share is the score. Chains are cut at ``CHAIN`` positions,
texts of any length are read to the end.

A word of more than ``_WIDTH`` characters, or a text without blanks, stands at several positions, one for each piece of
so many characters. Pieces have every n-gram once, those across their borders included; prefixes are the first one's,
suffixes the last one's, and lexicons list pieces.

Null texts and texts without a letter are ``und``, with score 0; so is every text if nothing can be learned.
Languages that tie go by name. Null labels and ids are not learned from, and of rows that repeat an id one is; repeated
rows get equal results.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercast.llm.common import REMEMBERED, prepare, runs

#: What is learned from: texts of each language, words of each text, words of each language's lexicon.
TEXTS, WORDS, LISTED = 300, 200, 2000
#: Longest chain; hashed features.
CHAIN, BUCKETS = 1000, 1 << 18
UNKNOWN = "und"

_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha()) + "“”«»„‘’‹›…–—¡¿"
_PRIME = 1_000_003
#: Characters of a word that one position of a chain has.
_WIDTH = 24
#: Marks of a piece of a word: that something comes before (three characters of it follow the mark), or after. No text has them.
_AFTER, _ON = "\ud800", "\ud801"


def normal(word: str) -> str:
    return word.lower().strip(_EDGES)


def pieces(form: str) -> list[str]:
    """A normal form, or its pieces if it is longer than one position takes."""
    if len(form) <= _WIDTH:
        return [form]
    cut = [_AFTER * (k > 0) + form[max(0, k - 3) : k + _WIDTH] + _ON for k in range(0, len(form), _WIDTH)]
    return [*cut[:-1], cut[-1][:-1]]


def positions(words: list[str]) -> tuple[list[str], list[int]]:
    """The words, or pieces, at a chain's positions, and how many of these each word has."""
    if max(map(len, words), default=0) <= _WIDTH:
        return words, [1] * len(words)
    cut = [[w] if len(w) <= _WIDTH else pieces(normal(w)) for w in words]
    return [p for ps in cut for p in ps], list(map(len, cut))


def letters(word: str) -> int:
    if word.startswith(_AFTER):
        word = word[4:]
    return len(word) if word.isalpha() else sum(map(str.isalpha, word))


def _ngram_features(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of normal forms, and the index of each one's form."""
    n = len(forms)
    after = np.fromiter((f.startswith(_AFTER) for f in forms), dtype=bool, count=n)
    on = np.fromiter((f.endswith(_ON) for f in forms), dtype=bool, count=n)
    cut = [f[1:] if f.startswith(_AFTER) else f"\x02{f}" for f in forms]
    cut = [f[:-1] if f.endswith(_ON) else f"{f}\x03" for f in cut]
    sizes = np.fromiter(map(len, cut), dtype=np.int64, count=n)
    grid = np.zeros((n, _WIDTH + 2 + 3 + 4), dtype=np.int64)
    at = np.arange(grid.shape[1]) < sizes[:, None]
    grid[at] = np.frombuffer("".join(cut).encode("utf-32-le", "replace"), dtype="<u4")
    features, owners = [], []
    everyone = np.arange(n)
    code = np.zeros_like(grid[:, :-4])
    for width in range(1, 5):
        # Every n-gram that isn't the piece's before; those at the word's boundaries are its prefixes and suffixes, and
        # get features of their own.
        code = code * _PRIME + grid[:, width - 1 : width - 1 + code.shape[1]]
        inside = np.arange(code.shape[1]) + width <= sizes[:, None]
        inside &= np.arange(code.shape[1]) + width > 3 * after[:, None]
        features.append((code[inside] * 31 + width) % BUCKETS)
        owners.append(np.repeat(everyone, inside.sum(axis=1)))
        first, last = np.flatnonzero((sizes >= width + 1) & ~after), np.flatnonzero((sizes >= width + 1) & ~on)
        prefix = code[first, 0] * 37 + 100 + width
        suffix = code[last, sizes[last] - width] * 41 + 200 + width
        features += [prefix % BUCKETS, suffix % BUCKETS]
        owners += [first, last]
    return np.concatenate(features), np.concatenate(owners)


@dataclass
class Field:
    """Labels, weights of hashed features and of lexicons, and transitions."""

    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    lexicon: dict[str, list[int]]  # a listed word: the labels whose lexicons list it
    listed: np.ndarray  # lexicon's label x label
    transitions: np.ndarray  # label x next label

    def emissions(self, forms: list[str]) -> np.ndarray:
        """The scores of each label for words in normal form; none for words without letters."""
        out = np.zeros((len(forms), len(self.labels)))
        feature, owner = _ngram_features(forms)
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(owner, weights=self.weights[feature, k], minlength=len(forms))
        for i, form in enumerate(forms):
            for k in self.lexicon.get(form, ()):
                out[i] += self.listed[k]
            if not letters(form):
                out[i] = 0.0
        return out


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities for chains x positions x labels; chains come in descending length."""
    n, steps, _ = emissions.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    ahead, back = np.empty_like(e), np.ones_like(e)
    alive = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # chains that reach a position
    for t in range(steps):
        a = alive[t]
        now = e[:a, t] if t == 0 else (ahead[:a, t - 1] @ move) * e[:a, t]
        ahead[:a, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        a = alive[t + 1]
        now = (back[:a, t + 1] * e[:a, t + 1]) @ move.T
        back[:a, t] = now / now.sum(axis=1, keepdims=True)
    both = ahead * back
    both /= np.maximum(both.sum(axis=2, keepdims=True), 1e-300)
    both[np.arange(steps) >= lengths[:, None]] = 0.0
    return both


def _pair_sums(p: np.ndarray, emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected label pairs of chains of equal length, given label probabilities ``p``."""
    n, steps, labels = p.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    total = np.zeros((labels, labels))
    ahead = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, steps):
        # p(next) = sum over labels of ahead * move * (what follows); so each pair's share of p(next) is known.
        come = ahead @ move
        total += (move * (ahead.T @ (p[:, t] / np.maximum(come, 1e-300))))
        ahead = come * e[:, t]
        ahead /= ahead.sum(axis=1, keepdims=True)
    return total


def train(texts: dict[str, list[list[str]]], epochs: int = 4, chains: int = 2000, steps: int = 40, seed: int = 7) -> Field:
    """Fit the field to words (in normal form) of texts of each language."""
    labels = sorted(texts)
    rng = np.random.default_rng(seed)
    counts: dict[str, Counter] = {k: Counter(w for t in texts[k] for w in t if w) for k in labels}
    everywhere: Counter = Counter()
    for c in counts.values():
        everywhere.update(c)
    lexicon: dict[str, list[int]] = defaultdict(list)
    for k, label in enumerate(labels):
        for word, n in counts[label].most_common(LISTED):
            if n >= 2 and n >= 0.2 * everywhere[word]:
                lexicon[word].append(k)
    sequences, truth = [], []
    for _ in range(chains):
        words: list[str] = []
        marks: list[int] = []
        while len(words) < steps:
            k = int(rng.integers(len(labels)))
            text = texts[labels[k]][int(rng.integers(len(texts[labels[k]])))]
            size = int(rng.integers(4, steps))
            start = int(rng.integers(max(1, len(text) - size + 1)))
            words += text[start : start + size]
            marks += [k] * len(text[start : start + size])
        sequences.append(words[:steps])
        truth.append(marks[:steps])
    marks = np.array(truth)
    forms, index = np.unique(np.array(sequences, dtype=object).ravel().astype(str), return_inverse=True)
    index = index.reshape(marks.shape)
    n = len(labels)
    feature, owner = _ngram_features(forms.tolist())
    by_form = np.argsort(owner, kind="stable")
    feature = feature[by_form]
    ends = np.cumsum(np.bincount(owner, minlength=len(forms)))
    has_letter = np.array([letters(f) > 0 for f in forms])
    lists = np.zeros((len(forms), n))
    for i, form in enumerate(forms.tolist()):
        lists[i, lexicon.get(form, [])] = 1.0
    field = Field(labels, np.zeros((BUCKETS, n)), dict(lexicon), np.zeros((n, n)), np.zeros((n, n)))
    speed = [np.full_like(w, 1e-6) for w in (field.weights, field.listed, field.transitions)]
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(chains), max(1, chains // 100)):
            used, where = np.unique(index[batch], return_inverse=True)
            where = where.reshape(len(batch), steps)
            spans = [np.arange(ends[u - 1] if u else 0, ends[u]) for u in used]
            mine = feature[np.concatenate(spans)]
            whose = np.repeat(np.arange(len(used)), [len(s) for s in spans])
            e = np.stack([np.bincount(whose, field.weights[mine, k], minlength=len(used)) for k in range(n)], axis=1)
            e = (e + lists[used] @ field.listed) * has_letter[used][:, None]
            chain = e[where]
            p = forward_backward(chain, np.full(len(batch), steps), field.transitions)
            miss = np.eye(n)[marks[batch]] - p
            seen = np.zeros((n, n))
            np.add.at(seen, (marks[batch][:, :-1].ravel(), marks[batch][:, 1:].ravel()), 1)
            per_form = np.stack([np.bincount(where.ravel(), miss[..., k].ravel(), minlength=len(used)) for k in range(n)], 1)
            per_form *= has_letter[used][:, None]
            gradient = np.stack([np.bincount(mine, per_form[whose, k], minlength=BUCKETS) for k in range(n)], axis=1)
            steps_up = (gradient, lists[used].T @ per_form, seen - _pair_sums(p, chain, field.transitions))
            for w, g, s in zip((field.weights, field.listed, field.transitions), steps_up, speed):
                s += (g / len(batch)) ** 2
                w += 0.1 * (g / len(batch)) / np.sqrt(s)
    return field


def learn(labelled: DataFrame) -> Field | None:
    """The field of a bounded sample of ``labelled`` (doc_id, text, lang); nothing if there are no words."""
    prepare(labelled.sparkSession)
    usable = labelled.where("doc_id is not null and text is not null and lang is not null")
    # Counts per bucket of hashes tell which first buckets hold enough ids; only these are put in order.
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ids = ids.withColumn("bucket", F.shiftrightunsigned("h", 48))
    earlier = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("lang", "bucket").agg(F.count_distinct("doc_id").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    few = ids.join(counts.where(F.col("before") < TEXTS).select("lang", "bucket"), ["lang", "bucket"]).distinct()
    first = Window.partitionBy("lang").orderBy("bucket", "h", "doc_id")
    chosen = few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= TEXTS)
    sample = usable.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])
    words = F.split("text", r"\s+")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.size(words) - WORDS + 1, F.lit(1))).cast("int") + 1
    # Of rows that repeat an id, the one whose text has the smallest hash: a bounded number of rows for each language.
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.slice(words, start, WORDS).alias("words")))
    rows = sample.groupBy("doc_id", "lang").agg(one.getField("words").alias("words")).toPandas().sort_values(["doc_id", "lang"])
    texts: dict[str, list[list[str]]] = defaultdict(list)
    for lang, found in zip(rows["lang"], rows["words"]):
        forms = [f for w in found for f in pieces(normal(w)) if letters(f)]
        if forms:
            texts[lang].append(forms)
    return train(texts) if texts else None


class Reader:
    """Applies a field to texts; remembers the emissions of words."""

    def __init__(self, field: Field):
        self.field = field
        self._rows: dict[str, int] = {}
        self._emissions = np.zeros((0, len(field.labels)))
        self._letters = np.zeros(0, dtype=np.int64)

    def _look_up(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self._rows) > REMEMBERED:
            self._rows = {}
            self._emissions, self._letters = self._emissions[:0], self._letters[:0]
        rows = self._rows
        new = list(set().union(*texts).difference(rows))
        if new:
            forms = [normal(w) for w in new]
            parts = [self.field.emissions(forms[k : k + 20_000]) for k in range(0, len(forms), 20_000)]
            self._emissions = np.concatenate([self._emissions, *parts])
            self._letters = np.concatenate([self._letters, np.fromiter(map(letters, forms), np.int64, len(forms))])
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
        return [np.fromiter(map(rows.__getitem__, t), dtype=np.int64, count=len(t)) for t in texts]

    def probabilities(self, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, its words' rows, label probabilities) for each chain of each text."""
        chains = []
        for k, rows in enumerate(self._look_up(texts)):
            chains += [(k, at, rows[at : at + CHAIN]) for at in range(0, len(rows), CHAIN)]
        chains.sort(key=lambda c: (-len(c[2]), c[0], c[1]))
        done = []
        while chains:
            # As many chains at a time as fill a bounded table.
            some = max(1, 400_000 // len(chains[0][2]))
            part, chains = chains[:some], chains[some:]
            lengths = np.array([len(c[2]) for c in part])
            table = np.zeros((len(part), lengths[0], len(self.field.labels)))
            for i, (_, _, rows) in enumerate(part):
                table[i, : len(rows)] = self._emissions[rows]
            p = forward_backward(table, lengths, self.field.transitions)
            done += [(k, at, rows, p[i, : len(rows)]) for i, (k, at, rows) in enumerate(part)]
        for k, _, rows, p in sorted(done, key=lambda d: d[:2]):
            yield k, rows, p

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        shares = np.zeros((len(texts), len(self.field.labels)))
        for k, rows, p in self.probabilities([positions(t.split())[0] for t in texts]):
            shares[k] += self._letters[rows] @ p
        total = shares.sum(axis=1)
        best = shares.argmax(axis=1)
        return [
            (self.field.labels[b], float(min(1.0, s[b] / n))) if n > 0 else (UNKNOWN, 0.0)
            for s, b, n in zip(shares, best, total)
        ]

    def words(self, texts: list[str]) -> list[list[str]]:
        """The likeliest label of each word."""
        cut = [positions(t.split()) for t in texts]
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for k, rows, p in self.probabilities([c for c, _ in cut]):
            # The pieces of a word count by their letters; a position without any hardly counts.
            found[k].append(np.maximum(self._letters[rows], 1e-9)[:, None] * p)
        out = []
        for (_, sizes), p in zip(cut, found):
            starts = np.cumsum([0, *sizes[:-1]])
            best = np.add.reduceat(np.concatenate(p), starts).argmax(axis=1) if sizes else []
            out.append([self.field.labels[b] for b in best])
        return out


def language(text: Column, field) -> Column:
    """A struct of lang_pred and score. ``field`` is a broadcast :class:`Field`, or None inside."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = Reader(field.value) if field.value else None
        for batch in batches:
            found = [r for ts in runs(batch) for r in (reader.predict(ts) if reader else [(UNKNOWN, 0.0)] * len(ts))]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return predicted.asNondeterministic()(text)


def word_languages(text: Column, field) -> Column:
    """The label of each word (between white space) of code-switched text."""

    @F.pandas_udf("array<string>")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(field.value)
        for batch in batches:
            yield pd.Series([r for ts in runs(batch) for r in reader.words(ts)], dtype=object)

    return labelled.asNondeterministic()(text)


def predict(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score for every document; learned from ``labelled`` (doc_id, text, lang)."""
    field = docs.sparkSession.sparkContext.broadcast(learn(labelled))
    return docs.select("doc_id", language(F.col("text"), field).alias("l")).select("doc_id", "l.*")
