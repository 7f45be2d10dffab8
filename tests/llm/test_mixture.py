import random

import pytest
from pyspark.sql import functions as F

from gavelworks.llm.mixture import mix, mixed_documents, schedule, source_targets

from frames import no_documents, odd_documents


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets, shared again until none is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if sizes[s] * most <= level * weight[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = sizes[s] * most
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 7, 500, 10_000]) for i in range(30)} | {None: 50, "é": 40, "Z": 3}
    rows = [(s, n - n // 2) for s, n in sizes.items()] + [(s, n // 2) for s, n in sizes.items()]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert abs(got[s] - want[s]) < 1e-6 * max(1, want[s]), s


def documents(spark, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None, "tiny"] if i < 20 else ["a", "b", "c", None])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 200, 900])), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_words(spark):
    docs = documents(spark)
    taken, slots = mix(docs)
    rows = taken.join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == 1500
    sums = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"] and sum(r.passes) == r.taken
        at = sums.setdefault(r.source, [0, r.target, r.source_size])
        at[0] += r.taken
    for source, (took, target, size) in sums.items():
        assert abs(took - target) <= max(1, size / 100), source
    assert sorted((r.doc_id, r.taken) for r in mix(docs)[0].collect()) == sorted((r.doc_id, r.taken) for r in rows)
    # Any stretch of the schedule is close to the whole.
    n = slots.count()
    share = {r.sid: r.n / n for r in slots.groupBy("sid").agg(F.count("*").alias("n")).collect()}
    top = slots.orderBy("slot").limit(n // 4)
    for r in top.groupBy("sid").agg(F.count("*").alias("n")).collect():
        assert abs(r.n / (n // 4) - share[r.sid]) < 0.03


def test_schedule_is_exact(spark):
    sources = spark.createDataFrame([(0, 3, 5), (1, 10_000, 9_000), (2, 1, 0), (3, 1, 2)], "sid long, blocks long, slots long")
    rows = schedule(sources).collect()
    assert len({r.slot for r in rows}) == len(rows) == 9007
    for sid, blocks, n in [(0, 3, 5), (1, 10_000, 9_000), (3, 1, 2)]:
        own = [(r.slot, r.epoch * blocks + r.block) for r in rows if r.sid == sid]
        assert [rank for _, rank in sorted(own)] == list(range(n))


def test_documents_of_the_mix(spark):
    docs = documents(spark).withColumn("n_chars", F.length("text")).withColumn("size", F.lit("x"))
    taken = {r.doc_id: r.taken for r in mix(docs)[0].collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert words == {d: n for d, n in taken.items() if n}
    assert out.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_odd_frames(spark):
    frame = odd_documents(spark)
    rows = mix(frame)[0].collect()
    assert len(rows) == 11
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert {str(r.doc_id) for r in rows if r["size"] == 0} == {"3", "4", "5"}
    assert mixed_documents(frame).columns == frame.columns
    assert mix(no_documents(spark))[0].collect() == [] and mixed_documents(no_documents(spark)).collect() == []
    empty = frame.filter("doc_id in (3, 4)")
    assert [(r.target, r.taken) for r in mix(empty)[0].collect()] == [(0.0, 0), (0.0, 0)]
