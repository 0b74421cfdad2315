"""Exact token counts at every prefix of a text, for byte-level BPE.

Within a piece (the units that the tokenizer's pattern cuts a text into) the encoding of every
prefix follows from those of shorter ones: exactly one vocabulary entry ends at each position and
may follow the last token of the rest. "May follow" means that the two tokens, joined and encoded
again, come out as the same two. Which entries end at a position an automaton over the vocabulary tells, by its suffix
links, longest first; no other stretch is looked at. So one pass gives the count at each position, and no prefix is
encoded again: how long a text is, where it exceeds a budget, and what is left of it when cut at
any character are look-ups.

Null text counts as empty: no tokens. Repeated rows give repeated results; other columns are not
looked at. Very long texts are split at blanks, where pieces always end; only a stretch without
blanks is held together.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Tokenizer

from ordercast.llm.common import REMEMBERED, prepare, runs

#: The pre-tokenizer's pattern (fixed value), with its white space spelled out as the Unicode property.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_SPANS = regex.compile(r"(\p{White_Space}*)(\P{White_Space}+)|(\p{White_Space}+)")
_ADJACENT = re.compile(r"\s\s")
_BLANK = re.compile(r"(?<=\S)(?= \S)")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE writes for each byte.

    Printable bytes stand for themselves; the others get the code points from 256 on, in order.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class PrefixCounter:
    """Counts by prefix dynamic programming for one tokenizer file."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.model.tokenize
        self._vocab = tokenizer.get_vocab(with_added_tokens=False)
        #: Finds the entries that end at each position, longest first, by suffix links.
        self._entries = ahocorasick.Automaton()
        for token in self._vocab:
            self._entries.add_word(token, (token, len(token) - 1))
        self._entries.make_automaton()
        self._alphabet = byte_alphabet()
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, added))) if added else None
        #: Of a last token (None at the start of a piece): which tokens may follow, as far as known.
        self._follows: dict[str | None, dict[str, bool]] = {}
        self._known_pairs = 0
        self._chunks: dict[str, tuple[int, ...]] = {}
        self._totals: dict[str, int] = {}
        self._short: dict[str, list[int]] = {}

    def _learn(self, last: str | None, token: str) -> bool:
        """Whether ``token`` may follow: whether both together are encoded as just these two."""
        if self._known_pairs > 4 * REMEMBERED:
            self._follows.clear()
            self._known_pairs = 0
        self._known_pairs += 1
        pair = [token] if last is None else [last, token]
        known = [t.value for t in self._encode("".join(pair))] == pair
        self._follows.setdefault(last, {})[token] = known
        return known

    def piece(self, text: str) -> list[int]:
        """The count at each character of a piece, taken as a piece of its own."""
        letters = self._alphabet
        if text.isascii():
            shown, ends = "".join([letters[ord(c)] for c in text]), None
        else:
            encoded = text.encode("utf-8", "replace")
            shown = "".join([letters[b] for b in encoded])
            ends = list(accumulate(len(c.encode("utf-8", "replace")) for c in text))
        follows, nothing, done = self._follows, {}, -1
        last: list[str | None] = [None] * (len(shown) + 1)
        counts = [0] * (len(shown) + 1)
        for end, (token, before) in self._entries.iter(shown):
            if end == done:
                continue
            start = end - before
            may = follows.get(last[start], nothing).get(token)
            if may or (may is None and self._learn(last[start], token)):
                last[end + 1] = token
                counts[end + 1] = counts[start] + 1
                done = end
        if not all(counts[1:]):
            raise ValueError(f"the vocabulary has no encoding of {text!r}")
        return counts[1:] if ends is None else [counts[e] for e in ends]

    def _piece(self, text: str) -> list[int]:
        """As :meth:`piece`, remembered for the shortest ones: blanks and punctuation."""
        if len(text) > 2:
            return self.piece(text)
        known = self._short.get(text)
        if known is None:
            if len(self._short) > REMEMBERED:
                self._short.clear()
            known = self._short[text] = self.piece(text)
        return known

    def _stretch(self, chunk: str) -> list[int]:
        """Counts at each character of a text without special tokens, from the pieces' counts."""
        out: list[int] = []
        base = 0
        for span in _SPANS.finditer(chunk):
            blank, body = span[1] or span[3] or "", span[2] or ""
            out += [base + n for n in self._piece(blank)] if blank else []
            if not body:
                continue
            # The last blank is a piece of its own before a word, or, if a space, the word's first character.
            lead = blank[-1:] == " "
            if len(blank) > 1:
                base += self._piece(blank[:-1])[-1]
            if blank and not lead:
                base += self._piece(blank[-1])[-1]
            for k, part in enumerate(PIECES.findall(" " * lead + body)):
                counts = self._piece(part)
                if part in ("'re", "'ve", "'ll"):
                    counts[1] = 2  # cut short, the contraction is a quote and a letter
                out += [base + n for n in counts[lead and k == 0 :]]
                base += counts[-1]
        return out

    def _with_specials(self, text: str) -> list[int]:
        out: list[int] = []
        base = at = 0
        for found in self._special.finditer(text):
            # Until it is complete, a special token's string is ordinary text.
            counts = self._stretch(text[at : found.end() - 1])
            before = counts[found.start() - at - 1] if found.start() > at else 0
            out += [base + n for n in counts]
            base += before + 1
            out.append(base)
            at = found.end()
        return out + [base + n for n in self._stretch(text[at:])]

    def _counts(self, chunk: str) -> list[int]:
        # A word with the space before it is one piece, by far the most frequent kind of chunk.
        if chunk[1:].isalpha() and chunk[0] == " ":
            return self.piece(chunk)
        return self._with_specials(chunk) if self._special and self._special.search(chunk) else self._stretch(chunk)

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """The count at each character of a chunk."""
        known = self._chunks.get(chunk)
        if known is None:
            known = tuple(self._counts(chunk))
            if len(chunk) <= 64:
                if len(self._chunks) > REMEMBERED // 2:
                    self._chunks.clear()
                self._chunks[chunk] = known
        return known

    def chunks(self, text: str) -> list[str]:
        """Cut where pieces end in the text and in all its prefixes: at single blanks between words.

        A special token is never cut, as none has a blank in it that stands between two words.
        """
        if not text:
            return []
        if _ADJACENT.search(text) or (self._special and self._special.search(text)):
            return _BLANK.split(text)
        out = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if k:
                out.append("\n")
            if first:
                out.append(first)
            out += [" " + word for word in rest]
        return out

    def totals(self, chunks: list[str]) -> list[int]:
        known = self._totals
        try:
            return [known[c] for c in chunks]
        except KeyError:
            if len(known) > 3 * REMEMBERED:
                known.clear()
            for chunk in set(chunks).difference(known):
                known[chunk] = self._counts(chunk)[-1]
            return [known[c] for c in chunks]

    def count(self, text: str) -> int:
        return sum(self.totals(self.chunks(text)))

    def prefixes(self, text: str) -> list[int]:
        """The token count of each prefix, from the first character to the whole text."""
        out: list[int] = []
        base = 0
        for chunk in self.chunks(text):
            counts = self.chunk(chunk)
            out += [base + n for n in counts]
            base += counts[-1]
        return out

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """The tokens of the text, and the characters of its longest prefix of at most ``limit`` tokens."""
        chunks = self.chunks(text)
        ends = list(accumulate(self.totals(chunks)))
        total = ends[-1] if ends else 0
        if total <= limit:
            return total, len(text)
        # Chunks up to this one start within the limit; some prefix of it may still fit.
        k = bisect_right([0, *ends], limit - 1) - 1
        base = ends[k - 1] if k else 0
        fits = max((j for j, n in enumerate(self.chunk(chunks[k]), 1) if base + n <= limit), default=0)
        return total, sum(map(len, chunks[:k])) + fits


@cache
def counter(path: str) -> PrefixCounter:
    """One per worker."""
    return PrefixCounter(path)


def token_counts(text: Column, path: str, limit: int = 1024) -> Column:
    """A struct: n_bytes, n_tokens, and fit_chars, the longest prefix of at most ``limit`` tokens."""

    @F.pandas_udf("n_bytes long, n_tokens long, fit_chars long")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for texts in runs(batch):
                for t in texts:
                    rows.append((len(t.encode("utf-8", "replace")), *counter(path).measure(t, limit)))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "fit_chars"], dtype=np.int64)

    return measured.asNondeterministic()(text)


def prefix_counts(docs: DataFrame, path: str, text: str = "text", into: str = "prefix_tokens") -> DataFrame:
    """``docs`` with the token count at every prefix, one per character: the stored table.

    Budget and truncation questions are then look-ups, see :func:`tokens_at` and :func:`fitting`.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf(ArrayType(IntegerType()))
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([counter(path).prefixes(t) for texts in runs(batch) for t in texts], dtype=object)

    return docs.withColumn(into, stored(F.col(text)))


def tokens_at(prefix_tokens: Column, chars: Column | int) -> Column:
    """The tokens of the first ``chars`` characters."""
    at = F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(prefix_tokens))
    return F.when(at < 1, F.lit(0)).otherwise(F.get(prefix_tokens, at.cast("int") - 1))


def fitting(prefix_tokens: Column, budget: Column | int) -> Column:
    """The longest prefix, in characters, of at most ``budget`` tokens."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    fits = F.transform(prefix_tokens, lambda n, k: F.when(n <= limit, k + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))
