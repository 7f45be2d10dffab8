"""Phrases against counting every one of them in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from frames import no_documents, odd_documents

from gavelworks.llm import phrases
from gavelworks.llm.phrases import collocations, phrase_counts


def plain(rows, least, longest, cover, top):
    f, n = Counter(), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in found.items():
        score, k, l, r = min(
            (2_000_000 * a // (l + r), k, l, r)
            for k in range(1, len(words))
            for l, r in [(f[(lang, *words[:k])], f[(lang, *words[k:])])]
        )
        around = [
            b
            for (other, *longer), b in found.items()
            if other == lang
            and len(longer) > len(words)
            and any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        ]
        if not any(100 * b >= cover * a for b in around):
            out.append((lang, " ".join(words), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(ranked)


def result(frame, *args):
    got = collocations(frame, *args)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def sentences(seed, n):
    """Phrases that recur among random words, in two languages, with every kind of break and blank."""
    draw = random.Random(seed)
    vocabulary = [*"abcdefgh", "Ab", "été", "漢", " x"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(draw.randrange(0, 30)):
            words.append(draw.choice(["new york city hall", "a b", "x", draw.choice(vocabulary), draw.choice(vocabulary)]))
            words.append(draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; ", "\x0c\r"]))
        rows.append(("".join(words), draw.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("seed,longest,cover", [(1, 4, 80), (2, 3, 50), (3, 5, 95), (4, 2, 80)])
def test_agrees_with_counting_each_phrase(spark, seed, longest, cover):
    rows = sentences(seed, 150)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert result(frame, 5, longest, cover, 40) == plain(rows, 5, longest, cover, 40)


def test_full_table_of_pairs_changes_nothing(spark, monkeypatch):
    """With hardly any places nearly every pair looks frequent."""
    rows = sentences(5, 120)
    frame = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(phrases, "LEAST_BITS", 3)
    monkeypatch.setattr(phrases, "MOST_BITS", 3)
    assert result(frame, 5, 4, 80, 1000) == plain(rows, 5, 4, 80, 1000)


def test_overlaps_and_texts_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BATCH_BYTES", 50)
    rows = [("a a a a a a", "en"), ("b " * 500, "en"), ("a A a", "en")] * 3
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert result(frame, 3, 4, 80, 10) == plain(rows, 3, 4, 80, 10)


def test_only_frequent_words_and_totals_are_kept(spark):
    rows = [("a b c", "en")] * 4 + [("a", "en"), ("z", "de")]
    got = phrase_counts(spark.createDataFrame(rows, "text string, lang string"), 4, 2)
    assert sorted(map(tuple, got.collect())) == [
        ("de", 0, "", 1),
        ("en", 0, "", 13),
        ("en", 1, "a", 5),
        ("en", 1, "b", 4),
        ("en", 1, "c", 4),
        ("en", 2, "a b", 4),
        ("en", 2, "b c", 4),
    ]


def test_odd_and_no_documents(spark):
    odd = odd_documents(spark)
    assert result(odd, 2, 4, 80, 50) == plain([(r.text, r.lang) for r in odd.collect()], 2, 4, 80, 50)
    assert result(no_documents(spark), 2, 4, 80, 50) == []


def test_products_pass_64_bits(spark):
    """The score of counts near the end of a long."""
    big = 9_000_000_000_000_000_000
    sql = "cast(cast({0}L as decimal(20,0)) * 2000000 div (cast({0}L as decimal(20,0)) + cast({0}L as decimal(20,0))) as long)"
    assert spark.sql(f"SELECT {sql.format(big)}").first()[0] == 1_000_000
