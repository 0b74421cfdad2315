import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ordercast.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(counts, capacity, plan):
    """Every rank of every size has one place, and blocks are gapless and not too full."""
    seen, blocks = dict.fromkeys(counts, 0), {}
    for length, rank, count, block, per, offset in sorted(plan.rows):
        assert seen[length] == rank
        seen[length] += count
        for k in range(count):
            blocks.setdefault(block + k // per, []).append((offset + k % per * length, length))
    assert seen == counts and set(blocks) == set(range(plan.blocks))
    for rows in blocks.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity


def best_fit_decreasing(counts, capacity):
    rooms, blocks = [], 0
    for n in sorted(Counter(counts).elements(), reverse=True):
        k = bisect_left(rooms, n)
        room = rooms.pop(k) if k < len(rooms) else capacity
        blocks += room == capacity
        insort(rooms, room - n)
    return blocks


@pytest.mark.parametrize("counts", [{}, {1: 5000}, {64: 3}, {64: 2, 63: 2, 1: 1}, {22: 100}, {33: 7, 31: 7}])
def test_plans_of_few_sizes(counts):
    check(counts, 64, packing.plan(counts, 64))


def test_random_plans():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([8, 16, 50])
        counts = dict(Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 60))))
        check(counts, capacity, packing.plan(counts, capacity, rng.choice([1, 3, 10, 1000]), rng.choice([None, 0, 2])))


def test_as_few_blocks_as_piece_by_piece():
    rng = random.Random(5)
    for n in (100, 5000):
        sizes = (min(2048, max(1, int(rng.lognormvariate(6.7, 1)))) if rng.random() < 0.6 else rng.randint(1, 2048) for _ in range(n))
        counts = dict(Counter(sizes))
        fewest = min((packing.plan(counts, 2048, g) for g in packing.GROUPS), key=lambda p: p.blocks)
        check(counts, 2048, fewest)
        assert fewest.blocks <= 1.002 * best_fit_decreasing(counts, 2048) + 1


def test_hot_size():
    counts = {1034: 30_000} | {n: 30 for n in range(1, 2049) if n != 1034}
    check(counts, 2048, packing.plan(counts, 2048))


def test_ids_are_the_library_ids():
    rng = random.Random(6)
    parts = ["a", "the", " ", "\n", "'", "re", "é", "1", "!", "  ", "\t", "<|endoftext|>", "😀", "\xa0", "\x1d", "\x85", "İ"]
    texts = ["", " ", "a\n \nb  c ", " x", "x ", "a\n", "\n\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1000)]
    for text, ids in zip(texts, packing.TextTokenizer(PATH).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_whatever_is_remembered(monkeypatch):
    rng = random.Random(8)
    words = ["a", "the", "it's", "x9", "é", "…", "w" * 40, "1 000", "a\xa0b", "\u3000", "re:", "b\tc", "\n"]
    words += ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    monkeypatch.setattr(packing._Remembered, "LONGEST", 20)
    encoder = packing.TextTokenizer(PATH)
    for n in range(30):
        texts = [rng.choice(" \n").join(rng.choices(words, k=rng.randint(0, 20))) + rng.choice(["", " ", "\n"]) for _ in range(20)]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_words_are_encoded_together(monkeypatch):
    """A call of the library for each distinct word took half of the time."""
    calls, one = [], packing.TextTokenizer._encode
    monkeypatch.setattr(packing.TextTokenizer, "_encode", lambda self, part: calls.append(part) or one(self, part))
    encoder = packing.TextTokenizer(PATH)
    text = " ".join(f"w{k}" for k in range(3000))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(calls) < 10


def verify(rows, docs, capacity):
    want = sorted((d, LIBRARY.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in docs)
    used, by_block = {}, {}
    for r in rows:
        used.setdefault(r.doc_id, []).append(r)
        by_block.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(used) == {d for d, _ in want}
    for d, ids in want:
        at = 0
        for k, r in enumerate(sorted(used[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(used[d]) == 1) == (len(ids) <= capacity)
    for placed in by_block.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack(documents):
    rng = random.Random(7)
    texts = ["word " * rng.randint(0, 90) for _ in range(200)] + ["same text"] * 100 + [None, ""]
    docs = documents(texts, extra=("length", "rank", "task"))
    verify(packing.pack(docs, PATH, capacity=32).collect(), docs.select("doc_id", "text").collect(), 32)


def test_odd_rows(odd, empty):
    docs = odd.where("doc_id is null or doc_id <> 4")
    rows = packing.pack(docs, PATH, capacity=2048).collect()
    keep = [r for r in rows if r.doc_id is not None]
    assert len(rows) - len(keep) == 1 and (1 << 60) + 1 in {r.doc_id for r in keep}
    used = {r.doc_id: 0 for r in keep}
    for r in keep:
        used[r.doc_id] += r.length
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert used == {d: len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    twice = packing.pack(odd.where("doc_id = 4"), PATH).collect()
    assert len(twice) == 2 and sorted(r.offset for r in twice) == [0, twice[0].length]
    assert packing.pack(empty, PATH).collect() == []
