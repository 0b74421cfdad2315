"""Quality rules on words, and bands on the perplexity of a modified Kneser-Ney model of symbols.

The model predicts a symbol from the ``ORDER - 1`` before it, across words: a text is its characters, with runs of
blanks as one and all digits alike. Characters fold into ``SYMBOLS`` symbols (ASCII and the next 896 code points have
one each, later ones share theirs), so an n-gram is a number, its own hash, and longer contexts follow by shifting.

**Counting.** Documents are dealt into blocks of neighbouring rows. A block sends its distinct n-grams with their
counts, sorted and packed, to hash partitions; n-grams whose last context symbols agree meet in one partition, so all
contexts and all shorter n-grams down to three symbols do too. Partitions add up and write sorted arrays of n-grams and
counts: the model, which grows with the corpus and is never in one place. N-grams of two symbols, at most
``SYMBOLS**2``, are added up by the driver and sent to every task. An n-gram comes at most once from a block, so
frequent ones make no partition large.

**Scoring.** Every document is judged by the model of the *other half* of the corpus (halves by the text's hash, so
exact copies are in one half): otherwise rare n-grams, junk too, would vouch for themselves. A partition is a file, and
with its arrays stand the places in them of what each block has sent. So partitions answer every block without
another shuffle of n-grams; a block's answers are one file, read by the task that has its texts. Texts are never
shuffled. Adjusted counts give three discounts per order and interpolated probabilities; what the other half hasn't
seen falls back to shorter contexts. Answers are log p in steps of ``1 / STEPS``.

**Bands.** A score is the mean of -log p over a text's symbols. For each language, the median and the spread of
all documents' scores that pass the basic rules give a lower and an upper band; means of fewer symbols are less
certain, so the spread is that of deviations times the root of the number of symbols, and short texts have
wider bands. Documents outside are taken out of the counts and all is scored again, ``refits`` times (their n-grams are
counted once more, and partitions take them off as they are read): what a
corpus has much of, mess too, looks usual until it no longer counts. Rejected are the documents outside of the last bands and
those that the basic rules reject: fewer than ``min_words`` words, or too many words in repeated 5-word windows.

Null is the empty text. It has no words, fails the basic rules and changes no band. Documents of a null language have
bands of their own. Rows that repeat an id are judged one by one. Texts of any length are read to the end, a text in one
piece; an empty table gives no rows; :func:`keep` hands on other columns, whatever their names, and
:func:`verdicts` doesn't read them. Ties at a band's edge are inside.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordercast.llm.common import fresh, frugal, new_path, prepare, slices, stage
from ordercast.llm.words import mix, windows, words

ORDER, BITS = 5, 10
SYMBOLS = 1 << BITS
START, BLANK, ZERO = 0, ord(" "), ord("0")
#: The shortest n-grams that partitions hold; shorter ones are bounded.
LEAST = 3
PAIRS = SYMBOLS**2
PARTS = 256
#: Rows of a file that make up a block.
BLOCK_ROWS = 16_384
#: Characters whose n-grams are taken together, and n-grams that wait to be added to a block's (no result depends on them).
CHARS, WAITING = 250_000, 250_000
#: Answers are whole numbers of such parts of a unit.
STEPS = 1 << 16


_MARK = 0x110000  # no character
_MARKS = _MARK.to_bytes(4, "little") * (ORDER - 1)


def _symbols() -> np.ndarray:
    """The symbol of each code point, and of the mark."""
    table = np.arange(_MARK + 1, dtype=np.int64)
    table[128:] = 128 + table[128:] % (SYMBOLS - 128)
    table[0] = 1
    table[9:14] = BLANK
    table[ZERO : ZERO + 10] = ZERO
    table[_MARK] = START
    return table


_TABLE = _symbols()


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts, one per symbol, as numbers, and the index of each one's text."""
    coded = [t.encode("utf-32-le", "replace") for t in texts]
    sizes = np.fromiter((len(c) // 4 + ORDER - 1 for c in coded), dtype=np.int64, count=len(coded))
    symbols = _TABLE.take(np.frombuffer(_MARKS + _MARKS.join(coded), dtype="<i4"))[: sizes.sum()]
    owner = np.repeat(np.arange(len(texts)), sizes)
    blank = symbols == BLANK
    again = np.flatnonzero(blank[1:] & blank[:-1])
    if len(again):
        symbols, owner = np.delete(symbols, again + 1), np.delete(owner, again + 1)
    real = symbols != START
    # One symbol, two, four, and the fifth.
    grams = symbols.copy()
    grams[1:] |= symbols[:-1] << BITS
    grams[2:] |= grams[:-2] << 2 * BITS
    grams[ORDER - 1 :] |= symbols[: 1 - ORDER] << BITS * (ORDER - 1)
    return grams[real], owner[real]


def half_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) & 1


def _halves(texts: list[str]) -> list[np.ndarray]:
    """Which texts are in each half."""
    half = np.fromiter(map(half_of, texts), dtype=np.int64, count=len(texts))
    return [np.flatnonzero(half == h) for h in (0, 1)]


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, back = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(back, weights=v, minlength=len(unique)).astype(np.int64) for v in values)


def _pack(values: np.ndarray) -> bytes:
    """Compressed, all first bytes of the numbers before all second ones and so on: high bytes are mostly 0."""
    planes = np.ascontiguousarray(values).reshape(-1, 1).view(np.uint8).T
    return zstandard.ZstdCompressor().compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def part_of(grams: np.ndarray) -> np.ndarray:
    """The partition, by the last symbols of the context that n-grams of ``LEAST`` symbols have."""
    context = (grams >> BITS) % SYMBOLS ** (LEAST - 1)
    return (mix(context.astype(np.uint64) + np.uint64(1)) % np.uint64(PARTS)).astype(np.int64)


def _discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more."""
    return _discounts_of(*(int((counts == k).sum()) for k in range(1, 5)))


def _discounts_of(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The same from how many n-grams were counted once, twice, three and four times."""
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    took = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k) for k, d in enumerate(took, 1))])


_SIGNS = b"#*$%&|<>"


def basics(text: str, found: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "replace")
    n = len(found)
    word_chars = len(text) - (len(data) - sum(map(len, found)))  # all but blanks, which are one byte each
    n_symbols = len(data) - len(data.translate(None, _SIGNS))
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line and not line.isspace():
            seen.add(line)
    repeated = 0
    # Hashes that hold within this process will do: they are compared within a text.
    w = windows(np.fromiter(map(hash, found), dtype=np.int64, count=n).view(np.uint64), 5)
    if len(w) and not np.diff(np.sort(w)).all():
        _, back, times = np.unique(w, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        edges = np.zeros(n + 1, dtype=np.int64)
        edges[: len(w)] += twice
        edges[5 : 5 + len(w)] -= twice
        repeated = int((np.cumsum(edges)[:n] > 0).sum())
    return n, word_chars, n_symbols, again, repeated


@dataclass
class Level:
    """N-grams of one length, sorted, with the raw and adjusted counts of both halves."""

    grams: np.ndarray
    raw: list[np.ndarray]
    adjusted: list[np.ndarray]


def levels(grams: np.ndarray, counts: list[np.ndarray]) -> list[Level]:
    """From ``ORDER`` symbols down to ``LEAST`` - 1. The last one's counts are a partition's share of them."""
    out = [Level(grams, counts, counts)]
    for k in range(ORDER - 1, LEAST - 2, -1):
        longer = out[-1]
        parts = [*longer.raw, *((a > 0) for a in longer.adjusted)]
        keys, *sums = _sum_by(longer.grams % SYMBOLS**k, *parts)
        # Nothing but marks can stand before a mark: an n-gram that begins with one keeps its own count.
        first = keys >> BITS * (k - 1) == START
        out.append(Level(keys, sums[:2], [np.where(first, raw, before) for raw, before in zip(sums[:2], sums[2:])]))
    return out


def mixed(grams: np.ndarray, counts: np.ndarray, take: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of sorted n-grams; those of unknown contexts are the shorter n-grams'."""
    off = take[np.minimum(counts, 3)]
    new = np.diff(grams >> BITS, prepend=-1) != 0
    context = np.cumsum(new) - 1
    total = np.bincount(context, weights=counts)[context] if len(grams) else np.zeros(0)
    weight = np.bincount(context, weights=off)[context] if len(grams) else np.zeros(0)
    some = np.maximum(total, 1)
    return np.where(total > 0, (counts - off) / some + weight / some * shorter, shorter)


ASKED = "part int, block long, grams binary, n binary"
MODEL = (
    "part int, grams binary, n binary, blocks array<long>, asks array<binary>, "
    "pairs binary, pair_n binary, classes binary"
)
TAKEN = "part int, grams binary, n binary"
FACTS = "pairs binary, pair_n binary, classes binary"
ANSWERED = "block long, part int, grams binary, p binary"


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns more, and their names: each row's block and its number in its file.

    Both come from the files that ``docs`` is read from, however a scan is split; if it isn't, it is written first.
    """
    names = fresh(docs, "block"), fresh(docs, "place")
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    half = F.xxhash64(path, F.floor(index / BLOCK_ROWS))
    place = lambda d: d.select("*", F.shiftleft(F.shiftright(half, 1), 1).alias(names[0]), index.alias(names[1]))
    try:
        return place(docs), *names
    except AnalysisException:
        return place(stage(docs, "documents")), *names


def _asks(block: int, halves: list[list[tuple]]) -> Iterator[tuple]:
    """A block's rows for partitions; blocks have even numbers, to which the half is added."""
    for half, found in enumerate(halves):
        if found:
            grams, n = _merged(found)
            part = part_of(grams)
            order = np.argsort(part, kind="stable")
            for places in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(places):
                    yield int(part[places[0]]), block + half, _pack_sorted(grams[places]), _pack(n[places])


def _merged(found: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams and counts, added up; the first ones are not sorted again, as they may be many more than the others."""
    (grams, n), *others = [f for f in found if len(f[0])] or found[:1]
    if not others:
        return grams, n
    more, m = (np.concatenate(x) for x in zip(*others))
    order = np.argsort(more, kind="stable")
    more = more[order]
    first = np.flatnonzero(np.diff(more, prepend=-1))
    more, m = more[first], np.add.reduceat(m[order], first)
    at = np.searchsorted(grams, more)
    new = grams.take(at, mode="clip") != more
    grams, n = np.insert(grams, at[new], more[new]), np.insert(n, at[new], m[new])
    n[(at + np.cumsum(new))[~new]] += m[~new]
    return grams, n


def _counted(texts: list[str], halves: list[list[tuple]]) -> None:
    """Add the n-grams of texts to their block's; few wait to be added up, however many texts a block has."""
    for part in slices(map(len, texts), CHARS):
        for h, mine in enumerate(_halves(texts[part])):
            halves[h].append(np.unique(ngrams([texts[part][k] for k in mine])[0], return_counts=True))
            if sum(len(g) for g, _ in halves[h][1:]) > WAITING:
                halves[h] = [_merged(halves[h])]


def count(texts: DataFrame, block: str, column: str = "text", place: str | None = None, only: str | None = None) -> DataFrame:
    """Distinct n-grams of each block and half with their counts, packed, a row per partition (``ASKED``).

    With ``only``, where :func:`_places` has written places, of the rows whose ``place`` is among them.
    """

    @frugal
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, halves, among = None, [[], []], _Among(only)
        for batch in batches:
            if only:
                batch = batch.filter(pa.array(among.chosen(batch.column(0).to_pylist(), batch.column(2).to_pylist()), pa.bool_()))
            blocks = batch.column(0).to_numpy()
            for rows in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
                if not len(rows):
                    continue
                if at is not None and blocks[rows[0]] != at:
                    yield _batch(list(_asks(at, halves)), ASKED)
                    halves = [[], []]
                at = int(blocks[rows[0]])
                _counted([t or "" for t in batch.column(1).take(pa.array(rows)).to_pylist()], halves)
        if at is not None:
            yield _batch(list(_asks(at, halves)), ASKED)

    return texts.select(block, column, *([place] if only else [])).mapInArrow(counted, ASKED)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), type=_KINDS[k]) for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def _added(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams of each row, all of them, and the counts of both halves (two rows)."""
    each = [_unpack_sorted(g) for g in rows["grams"]]
    n = np.concatenate([_unpack(c) for c in rows["n"]])
    half = np.concatenate([np.full(len(g), b & 1) for g, b in zip(each, rows["block"])])
    grams, *counts = _sum_by(np.concatenate(each), n * (half == 0), n * (half == 1))
    return each, grams, np.array(counts)


def _facts(grams: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """What all partitions need of one: its share of the pairs, and how many n-grams were counted 1 to 4 times."""
    *held, pairs = levels(grams, list(counts))
    classes = [[(level.adjusted[h] == c).sum() for c in range(1, 5)] for level in held for h in (0, 1)]
    return _pack_sorted(pairs.grams), _pack(np.array(pairs.adjusted)), np.array(classes, dtype=np.int64).tobytes()


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    """A partition of the model: its n-grams, the counts of both halves, where each block's n-grams are, its facts."""
    each, grams, counts = _added(rows)
    asked: dict[int, list[np.ndarray]] = {}
    for block, mine in zip(rows["block"].tolist(), each):
        asked.setdefault(block, []).append(np.searchsorted(grams, mine))
    # Tasks that share a block send some n-grams twice.
    asks = [_pack_sorted(at[0] if len(at) == 1 else np.unique(np.concatenate(at))) for at in asked.values()]
    row = int(rows["part"].iloc[0]), _pack_sorted(grams), _pack(counts), list(asked), asks, *_facts(grams, counts)
    return _frame([row], MODEL)


def _taken(rows: pd.DataFrame) -> pd.DataFrame:
    """What is to be taken off a partition's counts."""
    _, grams, counts = _added(rows)
    return _frame([(int(rows["part"].iloc[0]), _pack_sorted(grams), _pack(counts))], TAKEN)


def _left(part: int, grams: np.ndarray, n: bytes, off: str | None) -> np.ndarray:
    """A partition's counts of both halves, less what the table ``off`` says."""
    counts = _unpack(n).reshape(2, -1).copy()
    if off and (row := _row_of(off, "part", part)):
        counts[:, np.searchsorted(grams, _unpack_sorted(row["grams"]))] -= _unpack(row["n"]).reshape(2, -1)
    return counts


def _by(df: DataFrame, column: str, name: str) -> str:
    """Write ``df``, a folder for each value of ``column``, and say where."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(column).parquet(path)
    return path


def fit(asked: DataFrame) -> DataFrame:
    """The written model, a row and file for each partition."""
    path = _by(asked.groupBy("part").applyInPandas(_add_up, MODEL), "part", "model")
    return asked.sparkSession.read.schema(MODEL).parquet(path)


def take_off(asked: DataFrame) -> str:
    """Where the sums of these counts are, by partition."""
    return _by(asked.groupBy("part").applyInPandas(_taken, TAKEN), "part", "taken_off")


def shared(model: DataFrame, off: str | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """For both halves the probabilities of pairs; discounts by length and half.

    To the driver come ``PARTS`` rows with at most ``PAIRS`` counts each.
    """

    @frugal
    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                grams = _unpack_sorted(row.grams)
                yield _frame([_facts(grams, _left(row.part, grams, row.n, off))], FACTS)

    facts = model.select("part", "grams", "n").mapInPandas(reduced, FACTS) if off else model
    pairs = np.zeros((2, PAIRS), dtype=np.int64)
    classes = np.zeros((ORDER - LEAST + 1, 2, 4), dtype=np.int64)
    for row in facts.select("pairs", "pair_n", "classes").toLocalIterator():
        at = _unpack_sorted(row.pairs)
        pairs[:, at] += _unpack(row.pair_n).reshape(2, -1)
        classes += np.frombuffer(row.classes, dtype=np.int64).reshape(classes.shape)
    take = np.array([[_discounts_of(*map(int, c)) for c in level] for level in classes])
    return [_of_pairs(n) for n in pairs], take


def _of_pairs(n: np.ndarray) -> np.ndarray:
    """Probabilities of all pairs."""
    singles = (n.reshape(SYMBOLS, SYMBOLS) > 0).sum(axis=0)
    zero = np.full(SYMBOLS, 1 / SYMBOLS)
    one = mixed(np.arange(SYMBOLS), singles, _discounts(singles), zero)
    return mixed(np.arange(PAIRS), n, _discounts(n), np.tile(one, SYMBOLS))


def _probabilities(grams: np.ndarray, counts: list[np.ndarray], pairs: list[np.ndarray], take: np.ndarray) -> list[np.ndarray]:
    """By both halves' models, of all n-grams of a partition."""
    held = levels(grams, counts)[:-1]
    out = []
    for h in (0, 1):
        shorter, p = None, None
        for k, level in zip(range(LEAST, ORDER + 1), reversed(held)):
            rest = level.grams % SYMBOLS ** (k - 1)
            lower = pairs[h][rest] if shorter is None else p[np.searchsorted(shorter, rest)]
            shorter, p = level.grams, mixed(level.grams, level.adjusted[h], take[ORDER - k, h], lower)
        out.append(p)
    return out


def answer(model: DataFrame, off: str | None = None, keys: bool = True) -> str:
    """Where the answers are: a folder for each block and half, with a row of the log p of its n-grams.

    They come in the order of :func:`_dealt`. With ``keys`` the sorted n-grams stand beside them.
    """
    sent = model.sparkSession.sparkContext.broadcast(shared(model, off))

    @frugal
    def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                grams = _unpack_sorted(row.grams)
                p = _probabilities(grams, list(_left(row.part, grams, row.n, off)), *sent.value)
                logs = [np.rint(-np.log(q) * STEPS).astype(np.uint32) for q in p]
                rows = []
                for block, places in zip(row.blocks, row.asks):
                    at = _unpack_sorted(places)
                    named = _pack_sorted(grams[at]) if keys else None
                    rows.append((int(block), row.part, named, _pack(logs[1 - (block & 1)][at])))
                yield _frame(rows, ANSWERED)

    def gathered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        named = _pack_sorted(np.sort(np.concatenate([_unpack_sorted(g) for g in rows["grams"]]))) if keys else None
        p = np.concatenate([_unpack(b, np.uint32) for b in rows["p"]])
        return _frame([(int(rows["block"].iloc[0]), 0, named, _pack(p))], ANSWERED)

    answers = model.select("part", "grams", "n", "blocks", "asks").mapInPandas(answered, ANSWERED)
    return _by(answers.groupBy("block").applyInPandas(gathered, ANSWERED).drop("part"), "block", "answers")


def _dealt(grams: np.ndarray) -> np.ndarray:
    """The order in which sorted n-grams are answered: partition by partition."""
    return np.argsort(part_of(grams), kind="stable")


def _row_of(path: str, column: str, value: int) -> dict | None:
    """The row of ``value`` in a table that :func:`_by` has written, if there is one."""
    files, root = fs.FileSystem.from_uri(path)
    found = fs.FileSelector(f"{root}/{column}={value}", allow_not_found=True)
    for f in files.get_file_info(found):
        if f.base_name.endswith(".parquet"):
            return pq.ParquetFile(files.open_input_file(f.path)).read().to_pylist()[0]
    return None


#: Texts that are looked up together: a text's number and an n-gram share 64 bits.
_OWNER = 64 - ORDER * BITS


class Answers:
    """The log p of the n-grams of the block at hand; ``keys`` is where the n-grams are."""

    def __init__(self, path: str, keys: str):
        self.path, self.keys, self.block, self.known = path, keys, None, {}

    def _known(self, half: int) -> tuple[np.ndarray, np.ndarray]:
        if half not in self.known:
            grams = _unpack_sorted(_row_of(self.keys, "block", self.block + half)["grams"])
            loss = np.empty(len(grams), dtype=np.uint32)
            loss[_dealt(grams)] = _unpack(_row_of(self.path, "block", self.block + half)["p"], np.uint32)
            self.known[half] = grams, loss
        return self.known[half]

    def losses(self, block: int, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of symbols of each text, and the sum of their -log p."""
        if block != self.block:
            self.block, self.known = block, {}
        step = 1 << _OWNER
        found = [self._losses(texts[at : at + step]) for at in range(0, len(texts), step)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0))

    def _losses(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, loss = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
        for h, mine in enumerate(_halves(texts)):
            grams, owner = ngrams([texts[k] for k in mine])
            if not len(grams):
                continue
            sizes[mine] = np.bincount(owner, minlength=len(mine))
            # Sorted together with their texts, each n-gram is looked up once, in order.
            both = np.sort((grams << _OWNER | owner).view(np.uint64))
            gram = (both >> np.uint64(_OWNER)).view(np.int64)
            first = np.flatnonzero(np.diff(gram, prepend=-1))
            keys, known = self._known(h)
            of = np.repeat(known[np.searchsorted(keys, gram[first])], np.diff(first, append=len(gram)))
            text = (both & np.uint64((1 << _OWNER) - 1)).view(np.int64)
            loss[mine] = np.bincount(text, weights=of / STEPS, minlength=len(mine))
        return sizes, loss


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(texts: DataFrame, block: str, path: str, keys: str, column: str = "text", base: bool = True) -> DataFrame:
    """``texts`` without ``column``, with symbols, loss (mean of -log p) and, with ``base``, the basic counts."""
    names = [*(BASE if base else ()), "symbols", "loss"]
    others = [c for c in texts.columns if c != column]
    schema = texts.select(others).schema
    for name in names:
        schema = schema.add(name, "double" if name == "loss" else "long")

    @frugal
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(path, keys)
        for batch in batches:
            blocks = batch.column(block).to_numpy()
            values = [t or "" for t in batch.column(column).to_pylist()]
            out = []
            for rows in np.split(np.arange(len(blocks)), np.flatnonzero(np.diff(blocks)) + 1):
                mine = values[rows[0] : rows[-1] + 1] if len(rows) else []
                for part in slices(map(len, mine), CHARS):
                    n, total = answers.losses(int(blocks[rows[0]]), mine[part])
                    found = [basics(t, words(t, fold=False)) for t in mine[part]] if base else [()] * len(n)
                    out += [(*b, int(k), s / max(k, 1)) for b, k, s in zip(found, n, total.tolist())]
            columns = list(zip(*out)) if out else [[] for _ in names]
            arrays = [pa.array(c, type=pa.float64() if m == "loss" else pa.int64()) for m, c in zip(names, columns)]
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*others, *names])

    return texts.mapInArrow(scored, schema)


def _quartiles(scored: DataFrame, lang: str, value: Column, bin_width: float) -> DataFrame:
    """(band_lang, q1, q2, q3), exact to ``bin_width``, from counts per bin."""
    counts = scored.groupBy(F.col(lang).alias("band_lang"), F.round(value / bin_width).cast("long").alias("bin"))
    counts = counts.agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("band_lang")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))) * bin_width
    return ranked.groupBy("band_lang").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


#: A language's own spread of long texts, at least; and of one symbol, at least.
OWN, ONE = 0.01, 0.5


def judged(
    scored: DataFrame, lang: str = "lang", width: float = 4.0, min_words: int = 10, max_repeated: int = 20
) -> DataFrame:
    """``scored`` with base_failed, the language's bands at the text's length, perplexity and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    usual = scored.where(~failed & (F.col("symbols") > 0))
    with_band = lambda df, bands: df.join(bands, df[lang].eqNullSafe(bands["band_lang"]), "left").drop("band_lang")
    centres = _quartiles(usual, lang, F.col("loss"), 0.001).select("band_lang", F.col("q2").alias("centre"))
    apart = (F.col("loss") - F.col("centre")) * F.sqrt("symbols")
    spreads = _quartiles(with_band(usual, centres), lang, apart, 0.01)
    spreads = spreads.select("band_lang", F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(ONE)).alias("spread"))
    joined = with_band(with_band(scored, centres), spreads)
    half = width * F.sqrt(OWN**2 + F.col("spread") ** 2 / F.greatest("symbols", F.lit(1)))
    lower, upper = F.col("centre") - half, F.col("centre") + half
    return joined.withColumns(
        {
            "perplexity": F.exp("loss"),
            "lower": F.exp(lower),
            "upper": F.exp(upper),
            "kept": ~failed & F.coalesce(F.col("loss").between(lower, upper), F.lit(False)),
        }
    ).drop("centre", "spread")


def _places(rows: DataFrame, block: str, place: str) -> str:
    """Where the places of ``rows`` are, a folder for each block with a row; a block has ``BLOCK_ROWS`` at most."""
    found = rows.groupBy(F.col(block).alias("block")).agg(F.collect_list(place).alias("places"))
    return _by(found, "block", "places")


class _Among:
    """Which rows are those that :func:`_places` has written; reads a block's places once."""

    def __init__(self, path: str | None):
        self.path, self.block, self.known = path, None, set()

    def chosen(self, blocks: list[int], places: list[int]) -> list[bool]:
        out = []
        for b, p in zip(blocks, places):
            if b != self.block:
                self.block, row = b, _row_of(self.path, "block", b)
                self.known = set(row["places"]) if row else set()
            out.append(p in self.known)
        return out


def _among(path: str) -> Callable[[Column, Column], Column]:
    """A condition on block and place: whether the row is one of those that :func:`_places` has written."""

    @F.pandas_udf("boolean")
    def among(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = _Among(path)
        for blocks, places in batches:
            yield pd.Series(known.chosen(blocks.tolist(), places.tolist()), dtype=bool)

    return among


def _judged(texts: DataFrame, block: str, place: str, lang: str, refits: int = 2, trim: float = 2.0, **rules) -> DataFrame:
    """The verdicts, written, on ``texts`` (block, place, lang and so on, text): all columns but the text."""
    model = fit(count(texts, block))
    keys, off, found = None, None, None
    for k in range(refits + 1):
        path = answer(model, off, keys=k == 0)
        keys = keys or path
        scored = score(texts if k == 0 else texts.select(block, place, "text"), block, path, keys, base=k == 0)
        scored = stage(scored, "scored")
        if k == 0:
            found = scored
        else:
            again = scored.select(F.col(block).alias("b"), F.col(place).alias("p"), F.col("loss").alias("now"))
            found = found.join(again, (F.col(block) == F.col("b")) & (F.col(place) == F.col("p")))
            found = stage(found.withColumn("loss", F.col("now")).drop("b", "p", "now"), "found")
        if k < refits:
            # What is outside of narrower bands no longer counts: its n-grams are taken off.
            inner = judged(found, lang, **rules | {"width": trim})
            off = take_off(count(texts, block, place=place, only=_places(inner.where("NOT kept"), block, place)))
    return judged(found, lang, **rules)


def verdicts(docs: DataFrame, **rules) -> DataFrame:
    """doc_id, the basic counts, base_failed, the perplexity, the language's bands at the text's length, kept."""
    prepare(docs.sparkSession)
    rows, block, place = located(docs)
    texts = rows.select("doc_id", "lang", block, place, "text")
    return _judged(texts, block, place, "lang", **rules).drop("lang", "symbols", "loss", block, place)


def keep(docs: DataFrame, **rules) -> DataFrame:
    """``docs`` without the rejected ones; all columns as they were."""
    prepare(docs.sparkSession)
    rows, block, place = located(docs)
    verdict = _judged(rows.select("lang", block, place, "text"), block, place, "lang", **rules)
    inside = _among(_places(verdict.where("kept"), block, place))
    return rows.where(inside(F.col(block), F.col(place))).select(*(F.col(f"`{c}`") for c in docs.columns))
