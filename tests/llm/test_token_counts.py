"""Token counts against the library that the vocabulary belongs to."""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pytest
from frames import no_documents, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gavelworks.llm import token_counts
from gavelworks.llm.token_counts import Transducer, count_tokens, letters_of_bytes, public_path

PATH = public_path(token_counts.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return Transducer(f.read())


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


PARTS = [*"abcdefghijklmnopqrstuvwxyzABZ 0123'.,!?-\n\t\x0b\x1c\x85  ", "'re", "'ll", "''s", "<|endoftext|>", "<|start", "|>"]
PARTS += ["ΑΣ", "é", "é", "ß", "İ", "漢字", "́", "🙂", "ǅ", "²", "Ⅷ", "٣", "가", "K", "​", "\x00"]


@pytest.mark.parametrize("seed", range(5))
def test_random_texts(library, counter, seed):
    draw = random.Random(seed)
    texts = ["".join(draw.choices(PARTS, k=draw.randrange(0, 80))) for _ in range(400)]
    assert counter.count(texts) == lengths(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x3000), max_size=40), max_size=5))
def test_any_texts(texts):
    counter, library = _both()
    assert counter.count(texts) == lengths(library, texts)


@cache
def _both():
    with open(PATH, encoding="utf-8") as f:
        return Transducer(f.read()), Tokenizer.from_file(PATH)


def test_words_longer_than_chunks(library, counter):
    draw = random.Random(9)
    texts = ["x" * 1000, "ab" * 777, "".join(draw.choices("abcdef", k=30_000)), "=-" * 3000, "the" * 999, "漢" * 700]
    assert counter.count(texts) == lengths(library, texts)


@pytest.mark.parametrize("chunk", [1, 2, 7, 10_000])
def test_chunks_of_any_length_give_the_same(counter, monkeypatch, chunk):
    draw = random.Random(3)
    text = "".join(draw.choices(PARTS[:36], k=3000))
    symbols, _ = counter.symbols(text)
    whole = counter.emitted(symbols)
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    assert np.array_equal(counter.emitted(symbols), whole)


def test_transitions_follow_the_merges(counter):
    """Emitted counts up to a word's end are the number of its tokens by merging, and states come back to the first."""
    letters = letters_of_bytes()
    for word in (b"unbelievably", b"'s", b"zzzzzz", "größe".encode()):
        symbols = np.array([*word[:-1], word[-1] + 256])
        merged = counter.merged([letters[b] for b in word[:-1]] + [letters[word[-1]] + "</w>"])
        assert counter.emitted(symbols).sum() == len(merged)
        assert counter.run(counter.columns(symbols)[:, None], np.zeros(1, np.int64))[0].tolist() == [0]


def test_forgetting_changes_nothing(library, monkeypatch):
    with open(PATH, encoding="utf-8") as f:
        counter = Transducer(f.read())
    monkeypatch.setattr(token_counts, "TABLE_BYTES", 0)
    texts = ["some words", "other words here", "some words"]
    for _ in range(2):
        assert counter.count(texts) == lengths(library, texts)


def test_other_kinds_of_vocabulary_are_refused():
    with open(public_path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises((ValueError, TypeError, KeyError)):
        Transducer(f.read())


def test_documents(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = count_tokens(docs).select("text", "n_tokens").collect()
    assert [r.n_tokens for r in rows] == lengths(library, [r.text or "" for r in rows])


def test_long_texts_are_counted_in_parts(spark, library, monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 30)
    texts = ["word it's\nline <|endoftext|> é x " * 50, "", "a" * 200, "b " * 100]
    parts = [token_counts._parts(t, 30) for t in texts]
    assert ["".join(p) for p in parts] == texts and len(parts[0]) > 10
    with open(PATH, encoding="utf-8") as f:
        counter = Transducer(f.read())
    assert [sum(counter.count(p)) for p in parts] == lengths(library, texts)


def test_odd_and_no_documents(spark, library):
    from pyspark.sql import functions as F

    odd = odd_documents(spark).withColumn("n_tokens", F.lit("replaced"))
    got = count_tokens(odd)
    assert got.columns == [*odd.columns[:-1], "n_tokens"]
    rows = got.collect()
    assert len(rows) == odd.count()
    assert [r.n_tokens for r in rows] == lengths(library, [r.text or "" for r in rows])
    assert all(r.n_tokens == 0 for r in rows if not r.text)
    assert count_tokens(no_documents(spark)).count() == 0
