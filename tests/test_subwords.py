"""Vectors of n-grams: unseen words, means, and what training does."""

from __future__ import annotations

import random

import numpy as np
import pytest

from gavelworks.operators import subwords
from gavelworks.operators.embeddings import nearest_words
from gavelworks.operators.subwords import document_vectors_by_subwords, learn_pairs, train_subword_vectors, word_vectors


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(1)
    wood, metal = ["table", "chair", "wooden", "oak", "furniture"], ["silver", "bracelet", "golden", "ring", "jewelry"]
    rows = [(i, [draw.choice(wood if i % 2 else metal) for _ in range(8)] + (["once"] if i == 3 else [])) for i in range(600)]
    rows += [(600, []), (601, None), (602, ["oak", None])]
    return spark.createDataFrame(rows, "item_id long, tokens array<string>").repartition(3, "item_id")


@pytest.fixture(scope="module")
def model(corpus):
    return train_subword_vectors(corpus, dimensions=20, window=4, epochs=12, buckets=1 << 12, rate=0.2)


def vectors(spark, model, words):
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.word: None if r.vector is None else np.array(r.vector) for r in word_vectors(frame, model).collect()}


def test_vocabulary_and_shapes(spark, model):
    words = {r.word: r.n for r in model.words.collect()}
    assert len(words) == 10 and "once" not in words and min(words.values()) > 100
    found = vectors(spark, model, ["table", "unknownword123", "", None])
    assert found["table"].shape == found["unknownword123"].shape == found[""].shape == (20,)
    assert found[None] is None and np.abs(found["unknownword123"]).sum() > 0


def test_words_of_a_kind_are_near(spark, model):
    frame = spark.createDataFrame([(w,) for w in ["table", "chair", "oak", "silver", "ring", "golden"]], "word string")
    nearest = {r.word: r.neighbour for r in nearest_words(word_vectors(frame, model), ["table", "ring"], 1).collect()}
    assert nearest["table"] in ("chair", "oak") and nearest["ring"] in ("silver", "golden")


def test_unseen_spelling_is_near_the_word(spark, model):
    words = ["tables", "furnitures", "table", "furniture", "silver", "bracelet"]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    nearest = {r.word: r.neighbour for r in nearest_words(word_vectors(frame, model), ["tables", "furnitures"], 1).collect()}
    assert nearest == {"tables": "table", "furnitures": "furniture"}


def test_documents_are_means_of_all_their_words(spark, model):
    rows = [(1, ["oak", "tables", "oak"]), (2, []), (3, None), (4, ["oak", None])]
    frame = spark.createDataFrame(rows, "item_id long, tokens array<string>")
    got = {r.item_id: np.array(r.embedding) for r in document_vectors_by_subwords(frame, model, ["item_id"]).collect()}
    single = vectors(spark, model, ["oak", "tables"])
    assert got[1] == pytest.approx((2 * single["oak"] + single["tables"]) / 3, abs=1e-6)
    assert not got[2].any() and not got[3].any() and got[4] == pytest.approx(single["oak"], abs=1e-6)
    assert document_vectors_by_subwords(frame.filter("false"), model, ["item_id"]).count() == 0


def test_same_corpus_same_vectors(corpus, model):
    again = train_subword_vectors(corpus, dimensions=20, window=4, epochs=12, buckets=1 << 12, rate=0.2)
    assert again.ngrams == pytest.approx(model.ngrams, abs=1e-6)


def test_a_step_follows_the_gradient():
    """A mini-batch changes the tables by the slope of its loss, as found by small differences."""
    draw = np.random.default_rng(3)
    words = subwords.Vocabulary(["oak", "table"], 32)
    ngrams, neighbours = draw.normal(size=(32, 4)), draw.normal(size=(32, 4))
    centres, others, wrong = np.array([0, 1, 0]), np.array([3, 4, 5]), np.array([[6, 7], [3, 9], [8, 8]])

    def loss(a, b):
        h = words.vectors(centres, a)
        s = lambda x: np.log(subwords._sigmoid(x))
        good = s((h * b[others]).sum(1)).sum()
        return good + s(-np.einsum("bd,bkd->bk", h, b[wrong])).sum()

    new = [ngrams.copy(), neighbours.copy()]
    learn_pairs(*new, words, centres, others, wrong, 1.0)
    for which, (table, changed) in enumerate(zip((ngrams, neighbours), new)):
        for row, column in [(int(words.rows[0]), 1), (3, 0), (8, 2), (int(words.places[1]), 3)]:
            tables = [[ngrams.copy(), neighbours.copy()] for _ in range(2)]
            tables[0][which][row, column] += 1e-5
            tables[1][which][row, column] -= 1e-5
            slope = (loss(*tables[0]) - loss(*tables[1])) / 2e-5
            assert changed[row, column] - table[row, column] == pytest.approx(slope, abs=1e-4)
