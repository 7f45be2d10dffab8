import random
import re

import pytest
from pyspark.sql import functions as F

from gavelworks.llm import jaccard_join
from gavelworks.llm.components import components
from gavelworks.llm.jaccard_join import jaccard_components, one_of_each

from frames import no_documents, odd_documents


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, per_hundred):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= per_hundred * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None) if sets[i] else doc))
    return out


def near_copies(seed, families=12, members=14, words=60):
    """Families whose members drift apart by edits, some through a common passage, some by their last words alone."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=20)
    texts = []
    for f in range(families):
        text = rng.choices(vocabulary, k=rng.randint(4, words)) + (passage if f % 3 == 0 else [])
        for _ in range(rng.randint(1, members)):
            texts.append(" ".join(text))
            if rng.random() < 0.8:
                at = rng.randrange(len(text))
                text = text[:at] + rng.choices(vocabulary, k=rng.randint(0, 2)) + text[at + 1 :] or ["z"]
            else:
                text = text[:-1] + rng.choices(vocabulary, k=1)
    texts += ["", None, "one", "one", "One two", "one two", "a b c", "a b c d"]
    rng.shuffle(texts)
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,n,per_hundred", [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_agrees_with_all_pairs(spark, seed, n, per_hundred):
    rows = near_copies(seed)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, per_hundred)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    assert got == sorted(brute(rows, n, per_hundred))
    assert len({c for _, _, c in got}) < len(got) - 20


def test_odd_frames(spark):
    frame = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(frame).collect()]
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(got, key=key) == sorted(brute(rows, 5, 80), key=key)
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 1 3 4 5 6 7 None 8 9".split())
    assert jaccard_components(no_documents(spark)).collect() == []
    assert one_of_each(no_documents(spark)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100}
    assert {got[i] for i in range(200, 260)} == {7} and got[7] == 7
    assert got[301] == got[300] == 300


def test_the_join_stays_small_in_a_cluster(spark):
    """Copies with an edit each, all in one cluster: tests grow with its members, not with their pairs."""
    rng = random.Random(5)
    text = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(300):
        own = list(text)
        own[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert got.agg(F.count_distinct("component_id")).first()[0] == 1


def test_small_steps_for_executors(spark, monkeypatch):
    """Classes are numbers, texts go to Python in bounded batches, and no empty table starts workers of its own."""
    steps, limit = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    before, write = spark.conf.get(limit), jaccard_join.written

    def spied(df, name):
        steps.append((name, dict(df.dtypes), spark.conf.get(limit)))
        return write(df, name)

    frame = spark.createDataFrame(near_copies(4), "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "written", spied)
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: pytest.fail("Python workers for an empty table"))
    jaccard_components(frame, 4, 85)
    assert {name for name, _, _ in steps} >= {"signed", "classes", "members", "lists", "stars", "links", "least"}
    for name, kinds, most in steps:
        assert "binary" not in {kinds.get(c) for c in ("a", "b", "class", "component", "low", "high", "gid")}, name
        assert name not in ("signed", "links") or int(most) <= jaccard_join.BATCH_BYTES
    assert spark.conf.get(limit) == before
