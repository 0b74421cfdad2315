import random

import pytest

from ordercast.llm import toxicity
from ordercast.llm.toxicity import Lexicon, Reader

from .conftest import prose

INSULTS = ["grobian", "schuft", "trottel", "flegel"]


def distances(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def test_automaton_against_edit_distances():
    rng = random.Random(3)
    for _ in range(150):
        terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(6)})
        lexicon = Lexicon(terms, [rng.random() < 0.4 for _ in terms], [rng.random() for _ in terms])
        for _ in range(25):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
            near = [
                k
                for k, term in enumerate(terms)
                if (min(distances(term, word)) if lexicon.stems[k] else distances(term, word)[-1]) <= 1
            ]
            assert lexicon.automaton.read(word) == max(near, key=lambda k: lexicon.weights[k], default=-1)


def test_matches():
    lexicon = Lexicon(["grobian", "ekel", "schuft"], [False, False, True], [3.0, 2.0, 4.0])
    assert lexicon.match("grobian") == (0, 0) and lexicon.match("grobain") is None  # two edits
    assert [lexicon.match(w) for w in ("gr0bian", "groban", "grobiann")] == [(0, 2)] * 3
    assert lexicon.match("ekel") == (1, 0) and lexicon.match("ekle") is None and lexicon.match("ek3l") is None
    assert lexicon.match("schuftig") == (2, 1) and lexicon.match("schvftig") == (2, 2)
    assert lexicon.match("") is None


def test_context():
    reader = Reader(Lexicon(["grobian"], [False], [3.0]))
    names = toxicity.FEATURES
    read = lambda text: dict(zip(names, reader.features(text)))
    assert read("du bist ein Grobian!")["addressed"] > 0
    quoted = read('das wort "Grobian" steht da')
    assert quoted["quoted"] > 0 and quoted["strongest"] == 0
    assert read("er sagt grobian dazu")["quoted"] > 0
    assert read("grobian und grobian")["crowded"] > 0
    assert set(reader.features("nichts davon")) == {0.0} and set(reader.features("")) == {0.0}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for k in range(500):
        words, toxic = prose(rng, rng.randint(5, 60)).split(), int(rng.random() < 0.2)
        for _ in range(rng.randint(1, 3) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        rows.append((k, " ".join(words), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_rows(corpus):
    learned = corpus.where("doc_id % 3 <> 0").select("doc_id", "toxic")
    scores = dict(toxicity.scores(corpus, learned).collect())
    rest = corpus.where("doc_id % 3 = 0").collect()
    right = sum((scores[r.doc_id] >= 0.3) == bool(r.toxic) for r in rest)
    assert right >= 0.95 * len(rest) and all(0 <= s <= 1 for s in scores.values())


def test_misspelled_terms_count(spark, corpus):
    docs = spark.createDataFrame([(1000, "so ein gr0bian und schuffft grobiam"), (1001, "so ein baba und dodo")], "doc_id long, text string")
    both = corpus.select("doc_id", "text").unionAll(docs)
    scores = dict(toxicity.scores(both, corpus.select("doc_id", "toxic")).where("doc_id >= 1000").collect())
    assert scores[1000] > scores[1001]


def test_odd_rows(odd, empty, corpus):
    labels = corpus.select("doc_id", "toxic")
    both = odd.select("doc_id", "text").unionAll(corpus.select("doc_id", "text"))
    scores = {r.doc_id: r.score for r in toxicity.scores(both, labels.where("doc_id > 10")).collect()}
    assert scores[1] == scores[2] == scores[3] < 0.3
    left = toxicity.keep_harmless(odd, labels)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert {r.score for r in toxicity.scores(odd, labels.limit(0)).collect()} == {0.5}
    assert toxicity.scores(empty, labels).collect() == []


def test_one_row_of_a_repeated_id_is_learned_from(spark, corpus, monkeypatch):
    rng = random.Random(5)
    more = spark.createDataFrame([(7, prose(rng, 8)) for _ in range(400)], "doc_id long, text string")
    seen, learn_lexicon = [], toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda sample: seen.append(sample.count()) or learn_lexicon(sample))
    docs, labels = corpus.select("doc_id", "text"), corpus.select("doc_id", "toxic")
    toxicity.learn(docs, labels)
    toxicity.learn(docs.unionAll(more), labels)
    toxicity.learn(docs, labels.unionAll(labels))
    assert seen == seen[:1] * 3
