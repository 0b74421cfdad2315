import random

import numpy as np

from ordercast.llm import decontamination
from ordercast.llm.words import hashes, words

from .conftest import prose


def plain_tiling(item, text, shortest):
    """Greedy string tiling, letter by letter of its definition."""
    free_a, free_b, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = shortest - 1
        found = []
        for a in range(len(item)):
            for b in range(len(text)):
                n = 0
                while a + n < len(item) and b + n < len(text) and item[a + n] == text[b + n] and free_a[a + n] and free_b[b + n]:
                    n += 1
                if n > best:
                    best, found = n, [(a, b)]
                elif n == best and n >= shortest:
                    found.append((a, b))
        if not found:
            return tiles
        for a, b in found:
            if all(free_a[a : a + best]) and all(free_b[b : b + best]):
                tiles.append((a, b, best))
                free_a[a : a + best] = free_b[b : b + best] = [False] * best


def test_tiling_against_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = (rng.integers(0, 3, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        for shortest in (1, 2, 4):
            got, want = decontamination.tile(a, b, shortest), plain_tiling(a.tolist(), b.tolist(), shortest)
            assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)
            for i, j, n in got:
                assert (a[i : i + n] == b[j : j + n]).all()
            assert sum(n for _, _, n in got) == len({k for i, _, n in got for k in range(i, i + n)})


def corpus(documents, spark):
    rng = random.Random(3)
    items = [prose(rng, rng.randint(15, 60)) for _ in range(30)] + ["short one", ""]
    texts = []
    for item in items[:20]:
        w = item.split()
        third = len(w) // 3
        texts.append(f"{prose(rng, 30)} {item} {prose(rng, 30)}")
        texts.append(" ".join([*w[2 * third :], prose(rng, 9), *w[third : 2 * third], prose(rng, 9), *w[:third]]).upper())
        texts.append(" ".join(w[: third + 1]) + " " + prose(rng, 40))
    texts += [prose(rng, 200) for _ in range(40)] + ["a short one", None, ""]
    benchmark = spark.createDataFrame([*enumerate(items), (99, None)], "item_id long, text string")
    return documents(texts, extra=("score", "n")), benchmark, items, texts


def test_leaks_against_plain_tiling(documents, spark):
    docs, benchmark, items, texts = corpus(documents, spark)
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            w = words(item)
            if not w:
                continue
            tiles = plain_tiling(hashes(w).tolist(), hashes(words(text or "")).tolist(), min(5, len(w)))
            if sum(n for _, _, n in tiles) >= 0.5 * len(w):
                want.add((d, i))
    found = decontamination.contaminated(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert {(d, d // 3) for d in range(60) if d % 3 < 2} <= want
    assert all(r.coverage == 1 for r in found if r.doc_id < 60 and r.doc_id % 3 == 0 and r.item_id == r.doc_id // 3)
    # Several passes over the documents find the same.
    blocks = decontamination.contaminated(docs, benchmark, block_words=200).collect()
    assert sorted(blocks) == sorted(found)
    left = decontamination.clean(docs, benchmark, block_words=300)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_odd_rows(odd, empty, spark):
    benchmark = spark.createDataFrame([(1, "tie tie tie"), (1, "tie tie tie"), (None, "one two three four five six seven")], "item_id long, text string")
    found = decontamination.contaminated(odd, benchmark).collect()
    assert sorted((r.doc_id, r.item_id) for r in found if r.item_id) == [(7, 1), (7, 1), (8, 1), (8, 1)]
    assert [r.doc_id for r in found if r.item_id is None] == [4, 4]
    assert decontamination.clean(odd, benchmark).count() == odd.count() - 4
    assert decontamination.clean(odd, benchmark.limit(0)).count() == odd.count()
    assert decontamination.contaminated(empty, benchmark).collect() == []
