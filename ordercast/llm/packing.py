"""Packing token sequences into few blocks of a fixed capacity: linear grouping, then best fit.

1. Every document is tokenized once and cut into pieces; only sizes and checksums are kept. A piece
   gets its rank among the equally long pieces of its task.
2. What has to be decided depends on the sizes alone, and there are at most ``capacity`` of them. So
   the plan is made from the table "size, number of pieces", however many pieces there are:
   large sizes, in descending order, form groups of equal cardinality and are rounded up to the
   largest of their group; blocks are filled by few-size configurations (the largest size left, and
   with it the sizes that fill up the block best), each used as often as the groups allow;
   the actual sizes are put in place of the rounded ones; small sizes then go where they fit best.
   The result is a list of runs "pieces of this size with ranks from .. to go to blocks from ..".
3. Every piece looks up its run. No text, token or list of pieces is moved.

Null text counts as empty; an empty text still has its end mark. Ties among pieces of one size are
broken by where they were read; any order gives as many blocks. Rows with the same id are packed
separately. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ordercast.llm.common import REMEMBERED, frugal, prepare, runs, stage
from ordercast.llm.token_counts import PIECES, byte_alphabet

_ADJACENT = re.compile(r"\s\s")
_BLANK = re.compile(r"(?<=\S)(?= \S)")


class _Remembered:
    """Ids of parts of texts in arrays, encoded when first asked for; those not asked for lately are forgotten."""

    #: Parts of more bytes are not kept.
    LONGEST = 256

    def __init__(self):
        self.parts = pa.array([], pa.large_binary())
        self.ids = np.zeros(0, dtype="<u4")
        self.sizes = np.zeros(0, dtype=np.int64)
        self._asked = np.zeros(0, dtype=np.int64)
        self._run = 0

    def numbers(self, parts: pa.Array, encode) -> np.ndarray:
        """Where these distinct parts stand, until the next call. ``encode`` gives the ids of parts and their numbers."""
        self._forget()
        self._run += 1
        known = pc.index_in(parts, value_set=self.parts)
        at, new = known.fill_null(-1).to_numpy().astype(np.int64), parts.filter(known.is_null())
        if len(new):
            ids, sizes = encode(new)
            at[at < 0] = len(self.parts) + np.arange(len(new))
            self.parts = pa.concat_arrays([self.parts, new])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self._asked = np.concatenate([self._asked, np.zeros(len(new), dtype=np.int64)])
        self._asked[at] = self._run
        return at

    def _forget(self) -> None:
        stays = pc.binary_length(self.parts).to_numpy() <= self.LONGEST
        if len(stays) > REMEMBERED:
            stays &= self._asked > np.partition(self._asked, -REMEMBERED // 2)[-REMEMBERED // 2]
        if not stays.all():
            self.ids, self.parts = self.ids[np.repeat(stays, self.sizes)], self.parts.filter(pa.array(stays))
            self.sizes, self._asked = self.sizes[stays], self._asked[stays]


class TextTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    Texts are cut at single blanks between words and around line ends, where the tokenizer's own pieces end as
    well. The parts of all texts are numbered together by an Arrow dictionary, each distinct one is encoded once,
    and the ids are gathered by number. If the file's merges are in the order of their ids, as byte-level files
    have them, the faster of two libraries encodes the parts, with ranks taken from the same file;
    parts with special tokens go to the file's own library.
    """

    def __init__(self, path: str):
        self._path = path
        with open(path, encoding="utf-8") as file:  # a vocabulary on the worker's own disk, no input
            told = json.load(file)
        added = [t["content"] for t in told.get("added_tokens") or []]
        self._special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self._ranked = self._by_rank(told["model"], added)
        self._line_end = np.frombuffer(self._encode("\n"), dtype="<u4")[0]
        self._known = _Remembered()

    @functools.cached_property
    def _tokenizer(self) -> Tokenizer:
        return Tokenizer.from_file(self._path)

    def _by_rank(self, model: dict, added: list[str]) -> tiktoken.Encoding | None:
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if ids != sorted(ids):
            return None
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(to_byte[c] for c in t): k for t, k in model["vocab"].items() if t not in added}
        return tiktoken.Encoding("ranked", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, part: str) -> bytes:
        if self._ranked is None or self._special.search(part):
            return array("I", self._tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        return array("I", self._ranked.encode_ordinary(part)).tobytes()

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, one after the other, and how many each has."""
        text = parts.cast(pa.large_string())
        alone = pc.not_equal(pc.utf8_rtrim_whitespace(text), text).to_numpy(zero_copy_only=False)
        alone |= self._ranked is None
        values, found = text.to_numpy(zero_copy_only=False), [b""] * len(parts)
        for k in np.flatnonzero(alone):
            found[k] = self._encode(values[k])
        if len(together := np.flatnonzero(~alone)):
            # A line end between words is a piece and a token of its own.
            ids = self._ranked.encode_to_numpy("\n".join(values[together]), disallowed_special=())
            ends = np.flatnonzero(ids == self._line_end)
            sizes = np.diff(ends, prepend=-1, append=len(ids)) - 1
            if len(together) == len(parts):
                return np.delete(ids, ends), sizes
            for k, mine in zip(together.tolist(), np.split(np.delete(ids, ends), np.cumsum(sizes)[:-1])):
                found[k] = mine.astype("<u4").tobytes()
        return np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(f) // 4 for f in found], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        regular = [not (_ADJACENT.search(t) or self._special.search(t)) for t in texts]
        found = self._gathered([t.encode() for t, r in zip(texts, regular) if r])
        return [next(found) if r else b"".join(map(self._encode, _BLANK.split(t))) for t, r in zip(texts, regular)]

    def _gathered(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of texts without adjacent blanks and special tokens."""
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        codes = np.frombuffer(data, dtype=np.uint8)
        line = codes == ord("\n")
        begins = line | (codes == ord(" "))
        begins[1:] |= line[:-1]
        starts = np.append(0, ends[:-1])
        begins[starts[starts < len(data)]] = True
        at = np.flatnonzero(begins)
        buffers = [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
        known = self._known
        number = known.numbers(parts.dictionary, self._encode_parts)[parts.indices.to_numpy()]
        size = known.sizes[number]
        upto = np.append(0, np.cumsum(size))
        shift = (np.cumsum(known.sizes) - known.sizes)[number] - upto[:-1]
        ids = known.ids[np.arange(upto[-1]) + np.repeat(shift, size)]
        until = upto[np.searchsorted(at, ends)].tolist()
        for start, end in zip([0, *until], until):
            yield ids[start:end].tobytes()


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and (task, rank) among equal lengths.

    A document is its tokens and ``end_id``. Only if longer than ``capacity`` it is cut: the first
    piece has what is over, the others are full.
    """

    fields = ("piece", "start", "length", "ids_crc32", "task", "rank")

    @F.pandas_udf("array<struct<piece int, start long, length long, ids_crc32 long, task int, rank long>>")
    @frugal
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        task, ranks, end = TaskContext.get().partitionId(), Counter(), np.array([end_id], dtype="<u4").tobytes()
        encoder = TextTokenizer(path)  # the task's own: a worker doesn't hold on to vocabularies and words
        for batch in batches:
            out = []
            for texts in runs(batch):
                for ids in encoder.encode(texts):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    rows = []
                    for k, start in enumerate([0, *range(first, n, capacity)]):
                        length = first if k == 0 else capacity
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        rows.append(dict(zip(fields, (k, start, length, crc, task, ranks[length]))))
                        ranks[length] += 1
                    out.append(rows)
            yield pd.Series(out, dtype=object)

    made = docs.select("doc_id", F.explode(cut.asNondeterministic()("text")).alias("p"))
    return made.select("doc_id", "p.*")


@dataclass
class Runs:
    """Pieces of ``length`` with ranks ``rank .. rank + count - 1`` go, ``per`` to a block, to the blocks
    from ``block`` on, where the first lies at ``offset``."""

    rows: list[tuple[int, int, int, int, int, int]]  # length, rank, count, block, per, offset
    blocks: int = 0


class _Supply:
    """Pieces by descending size, handed out by rank in that order."""

    def __init__(self, counts: dict[int, int]):
        self.lengths = sorted(counts, reverse=True)
        self.ends = np.cumsum([counts[n] for n in self.lengths]).tolist()

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def length_at(self, rank: int) -> int:
        return self.lengths[bisect_left(self.ends, rank + 1)]

    def stretch(self, rank: int, count: int) -> Iterator[tuple[int, int, int, int]]:
        """(from, to, length, rank among that length) of each stretch of equal lengths, counted from ``rank``."""
        at = rank
        k = bisect_left(self.ends, rank + 1)
        while at < rank + count:
            end = min(self.ends[k], rank + count)
            yield at - rank, end - rank, self.lengths[k], at - (self.ends[k - 1] if k else 0)
            at, k = end, k + 1


def _fill(sizes: list[tuple[int, int]], room: int) -> dict[int, int]:
    """How often to take each of ``(size, available)``, so that their sum comes closest to ``room``.

    Sums that can be reached are the bits of an integer. Of equal fillings, the one with the largest
    sizes: ``sizes`` are given in descending order.
    """
    reach, steps = [1], []
    mask = (1 << (room + 1)) - 1
    for k in range(len(sizes) - 1, -1, -1):
        size, available = sizes[k]
        for _ in range(min(available, room // size)):
            reach.append((reach[-1] | reach[-1] << size) & mask)
            steps.append((k, size))
    left, taken = reach[-1].bit_length() - 1, Counter()
    for (k, size), before in zip(reversed(steps), reversed(reach[:-1])):
        if left >= size and before >> (left - size) & 1:
            taken[k] += 1
            left -= size
    return taken


def _configurations(sizes: list[int], left: list[int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """(pieces of each group in a block, number of such blocks), until every group is used up."""
    first = 0
    while True:
        while first < len(left) and not left[first]:
            first += 1
        if first == len(left):
            return
        room = capacity - sizes[first]
        open_groups = [g for g in range(first, len(left)) if left[g] - (g == first) > 0 and sizes[g] <= room]
        taken = _fill([(sizes[g], left[g] - (g == first)) for g in open_groups], room)
        block = Counter({first: 1}) + Counter({open_groups[k]: n for k, n in taken.items()})
        times = min(left[g] // n for g, n in block.items())
        for g, n in block.items():
            left[g] -= n * times
        yield block, times


def plan(counts: dict[int, int], capacity: int, groups: int = 1000, small: int | None = None) -> Runs:
    """The runs for ``counts[length]`` pieces of each length; sizes up to ``small`` go in by best fit."""
    small = capacity // 3 if small is None else small
    out = Runs([])
    if full := counts.get(capacity, 0):
        out.rows.append((capacity, 0, full, 0, 1, 0))
        out.blocks = full
    supply = _Supply({n: c for n, c in counts.items() if small < n < capacity})
    starts = sorted({supply.total * g // groups for g in range(groups)}) if supply.total else []
    sizes = [supply.length_at(s) for s in starts]
    left = [b - a for a, b in zip(starts, [*starts[1:], supply.total])]
    at = list(starts)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first block, blocks)
    for block, times in _configurations(sizes, left, capacity):
        # Each place of the configuration gets the next pieces of its group, in order; where their
        # actual length changes, a new stretch of alike blocks begins.
        places = []
        for g, n in sorted(block.items()):
            for _ in range(n):
                places.append(list(supply.stretch(at[g], times)))
                at[g] += times
        cuts = sorted({s[0] for place in places for s in place} | {times})
        cursor = [0] * len(places)
        for a, b in zip(cuts, cuts[1:]):
            offset = 0
            for p, place in enumerate(places):
                while place[cursor[p]][1] <= a:
                    cursor[p] += 1
                begin, _, length, rank = place[cursor[p]]
                out.rows.append((length, rank + a - begin, b - a, out.blocks + a, 1, offset))
                offset += length
            gaps[capacity - offset].append((out.blocks + a, b - a))
        out.blocks += times
    _best_fit({n: c for n, c in counts.items() if n <= small and n < capacity}, gaps, capacity, out)
    return out


def _best_fit(counts: dict[int, int], gaps: dict[int, list[tuple[int, int]]], capacity: int, out: Runs) -> None:
    """Put small sizes, in descending order, into the blocks with the least room that suffices."""
    rooms = sorted(gaps)
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                blocks = -(-left // (capacity // size))
                insort(rooms, capacity)
                gaps[capacity].append((out.blocks, blocks))
                out.blocks += blocks
                continue
            room = rooms[k]
            first, blocks = gaps[room].pop()
            per = min(room // size, left)
            used = min(blocks, left // per)
            out.rows.append((size, rank, per * used, first, per, capacity - room))
            rank += per * used
            left -= per * used
            if used < blocks:
                gaps[room].append((first + used, blocks - used))
            if not gaps[room]:
                del gaps[room], rooms[k]
            rest = room - per * size
            if rest:
                if rest not in gaps:
                    insort(rooms, rest)
                gaps[rest].append((first, used))


#: Cardinalities tried: with more groups than sizes, rounding loses nothing; with fewer, blocks are more alike.
GROUPS = (300, 1000, 3000)


def assign(cut: DataFrame, capacity: int, groups: tuple[int, ...] = GROUPS, small: int | None = None) -> DataFrame:
    """``cut``, a written table as :func:`pieces` makes it, with sequence_id and offset.

    To the driver come one row per size (at most ``capacity``), back goes the plan, whose length
    depends on ``capacity`` alone (the fewest blocks over the group numbers tried). What is shuffled are counts per (task, size) and the rows of ``cut``.
    """
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    counts = dict(cut.groupBy("length").count().collect())
    rows = sorted(min((plan(counts, capacity, g, small) for g in groups), key=lambda p: p.blocks).rows)
    length, rank, _, block, per, first_offset = np.array(rows, dtype=np.int64).reshape(-1, 6).T.copy()
    # Runs of a length follow one another by rank, so one key orders all of them.
    step = max(counts.values(), default=0) + 1
    keys = length * step + rank

    def place(of_length: pd.Series, of_rank: pd.Series) -> pd.DataFrame:
        n, r = of_length.to_numpy(), of_rank.to_numpy()
        k = np.searchsorted(keys, n * step + r, side="right") - 1
        within = r - rank[k]
        return pd.DataFrame({"sequence_id": block[k] + within // per[k], "offset": first_offset[k] + within % per[k] * n})

    placed = F.pandas_udf(place, "sequence_id long, offset long")
    at: Column = placed(F.col("length"), F.col("rank") + F.col("base"))
    joined = cut.join(bases, ["length", "task"]).withColumn("at", at)
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """Pack all ``docs``: one row per piece with its place, see the module's description."""
    prepare(docs.sparkSession)
    return assign(stage(pieces(docs, path, capacity, end_id), "pieces"), capacity, groups)
