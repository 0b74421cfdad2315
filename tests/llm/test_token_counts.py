import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ordercast.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "the", " ", "\n", "'", "re", "ll", "s", "é", "1", "!", "  ", "\t", "<|endoftext|>", "<|endo", "😀", "\xa0", "\x1c", "　"]


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def cases():
    rng = random.Random(1)
    fixed = ["", " ", "\n\n\n   z", "a\n \nb  c ", "it's we're 'll '' 're x'r", "'ll've", "a'", "aaaa" * 30, "a <|endoftext|>b\n<|endoftext|>\n c"]
    return fixed + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14))) for _ in range(250)]


def test_every_prefix_has_the_library_count():
    counter = token_counts.counter(PATH)
    for text in cases():
        assert counter.prefixes(text) == [count(text[:k]) for k in range(1, len(text) + 1)], text


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_longest_prefix_within_a_limit(limit):
    counter = token_counts.counter(PATH)
    for text in cases():
        sizes = [count(text[:k]) for k in range(1, len(text) + 1)]
        fits = max((k for k, n in enumerate(sizes, 1) if n <= limit), default=0)
        assert counter.measure(text, limit) == (count(text), fits), text


def test_stored_prefixes_answer_questions(documents):
    texts = [t for t in cases()[:60]] + [None]
    rows = token_counts.prefix_counts(documents(texts), PATH).select(
        "text",
        token_counts.tokens_at(F.col("prefix_tokens"), 4).alias("at"),
        token_counts.fitting(F.col("prefix_tokens"), 3).alias("fits"),
    )
    for text, at, fits in rows.collect():
        text = text or ""
        assert at == count(text[:4])
        assert fits == max((k for k in range(len(text) + 1) if count(text[:k]) <= 3))


def test_odd_rows(odd, empty):
    made = odd.select("doc_id", "text", token_counts.token_counts(F.col("text"), PATH).alias("c"))
    for _, text, c in made.collect():
        text = text or ""
        assert (c.n_bytes, c.n_tokens) == (len(text.encode()), count(text))
        assert c.fit_chars == len(text) if c.n_tokens <= 1024 else count(text[: c.fit_chars]) <= 1024 < c.n_tokens
    assert empty.select(token_counts.token_counts(F.col("text"), PATH)).collect() == []
