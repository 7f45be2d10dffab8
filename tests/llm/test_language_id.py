import numpy as np
from pyspark.sql import functions as F

from gavelworks.llm import language_id as li

from frames import no_documents, odd_documents


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    h = li.HIDDEN
    model = {k: rng.standard_normal(s) * 0.5 for k, s in {
        "wf": (256, 3 * h), "wb": (256, 3 * h), "uf": (h, 3 * h), "ub": (h, 3 * h), "v": (2 * h, 3), "b": (3,)}.items()}
    codes, lengths = li._packed([b"abc", b"d", b"efghi"])
    goal = np.array([0, 2, 1])

    def loss():
        p = li._forward(model, codes, lengths)
        live = np.arange(len(codes))[:, None] < lengths
        return -np.log(p[:, np.arange(3), goal])[live].sum() / lengths.sum()

    slopes = li._slopes(model, codes, lengths, goal)
    for name, at in [("wf", (97, 3)), ("wf", (101, 20)), ("wb", (99, 30)), ("wb", (103, 1)), ("uf", (2, 5)), ("uf", (3, 30)), ("ub", (4, 14)), ("ub", (1, 25)), ("v", (3, 1)), ("v", (20, 0)), ("b", (2,))]:
        old = model[name][at]
        model[name][at] = old + 1e-5
        up = loss()
        model[name][at] = old - 1e-5
        down = loss()
        model[name][at] = old
        assert abs((up - down) / 2e-5 - slopes[name][at]) < 1e-7, name


def test_padding_changes_nothing():
    rng = np.random.default_rng(1)
    model = li.train([b"abc", b"xyz", b"defgh"] * 10, np.array([0, 1, 0] * 10), 2, steps=5)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 2, 7, 31, 32, 33, 70)]
    together = li.word_totals(model, words)
    for word, total in zip(words, together):
        assert np.allclose(li.word_totals(model, [word])[0], total, atol=1e-5)
        assert abs(total.sum() - len(word)) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = rows.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 150 and right / n > 0.93


def test_odd_frames(spark):
    frame = odd_documents(spark)
    rows = li.identify(frame).collect()
    assert len(rows) == 11
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de")
    assert {r.lang_pred for r in li.identify(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    one = {(r.lang_pred, r.score) for r in li.identify(frame.withColumn("lang", F.lit("en"))).collect()}
    assert one == {("en", 1.0), ("und", 0.0)}
    assert li.identify(no_documents(spark)).collect() == []
