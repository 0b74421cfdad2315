import random
from collections import Counter, defaultdict

import pytest

from ordercast.llm import divergence
from ordercast.llm.divergence import SCALE, terms_of

from .conftest import DOCUMENTS, prose


def plain(rows, min_docs, top):
    """The result by definition, every kept term for every group. Rows: (text, lang, source)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    docs, often = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = [t.decode() for t in terms_of(text) if t]
        docs[lang].update(set(found))
        often[lang, source].update(found)
        often[lang].update(found)
    out = set()
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        sources = sorted({s for _, la, s in rows if la == lang})

        def share(key):
            total = sum(often[key][t] for t in kept)
            return {t: 1 + SCALE * (often[key][t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share((lang, s)) for s in sources}, share(lang)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if often[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out |= {(lang, s, part, *r, k) for k, r in enumerate(found[:most], 1)}
    return out


def rows_of(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for k in range(260):
        lang = rng.choice(["aa", "aa", "bb", "", None])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "ß", "é", None, "rare"])
        text = prose(rng, rng.randint(0, 30)) + rng.choice([" Ünd ÜND", " 漢字 x2y", "", " Äpfel-äpfel"])
        out.append((text, lang, "S" + source if lang == "bb" and source else source))
    return out


@pytest.mark.parametrize(("min_docs", "top", "block"), [(10, 10, 200_000), (3, 4, 50), (1, 2, 7)])
def test_against_the_definition(spark, rows, monkeypatch, min_docs, top, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 40)
    monkeypatch.setattr(divergence, "CELLS", 30)
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'own' as term", "'own' as n", "0 as block")
    found = rows_of(divergence.audit(df.repartition(5), min_docs, top))
    assert found == plain(rows, min_docs, top)
    assert {r[2] for r in found} == {"pair", "term"}


def test_large_counts_do_not_overflow():
    counts = divergence.np.array([10**15, 0, 3], dtype="int64")
    assert divergence._shares(counts, 10**17, 10**6).tolist() == [1 + SCALE * (c + 2) // (10**17 + 2 * 10**6) for c in (10**15, 0, 3)]


def test_terms():
    assert [t.decode() for t in terms_of("Don't STOP2go ÄB\x7fc\x00d—e") if t] == ["don", "t", "stop", "go", "Äb", "c", "d—e"]


def test_odd_rows(spark, odd, empty):
    found = rows_of(divergence.audit(odd, min_docs=2))
    by_hand = [(r.text, r.lang, r.source) for r in odd.select("text", "lang", "source").collect()]
    assert found == plain(by_hand, 2, 10)
    assert divergence.audit(empty).collect() == []


def test_no_kept_term(spark):
    rows = [(1, "a b", "x", "s", 0), (2, "c", "x", "t", 0), (3, None, "x", None, 0), (4, "d", "y", "s", 0)]
    found = rows_of(divergence.audit(spark.createDataFrame(rows, DOCUMENTS)))
    sources = ["", "s", "t"]
    assert found == {("x", a, "pair", b, 0, k) for a in sources for k, b in enumerate((s for s in sources if s != a), 1)}
