import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gavelworks.llm import toxicity

from frames import no_documents, odd_documents


def test_features_are_those_of_distinct_words():
    texts = pa.array(["Ab ab", "ab ba", None, "", "x"])
    row, feature = toxicity.text_features(texts)
    sets = [set(feature[row == i].tolist()) for i in range(5)]
    assert sets[2] == sets[3] == set()
    # " a", "ab", "b ", " ab", "ab ", " ab "
    assert len(sets[0]) == 6 and sets[0] < sets[1] and len(sets[1]) == 12
    assert len(sets[4]) == 3
    alone = toxicity.text_features(pa.array(["x"]))[1]
    assert set(alone.tolist()) == sets[4]


def test_words_decide():
    clean = [f"good day number {i} friend" for i in range(300)]
    bad = [f"good day number {i} nastyword" for i in range(300)]
    weight, intercept = toxicity.train(clean + bad, np.repeat([False, True], 300))
    row, feature = toxicity.text_features(pa.array(["a Nastyword!", "a friendly word"]), weight != 0)
    score = np.bincount(row, weight[feature], minlength=2) + intercept
    assert score[0] > 1 and score[1] < -0.5


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").withColumn("held", toxicity.fold(F.col("doc_id")) == 0)
    held = rows.filter("held").select("toxic", "score").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in held)
    assert len(held) > 50 and right / len(held) > 0.9
    clean = [r.score for r in held if r.toxic == 0]
    assert sum(s >= 0.5 for s in clean) <= 0.03 * len(clean)


def test_odd_frames(spark):
    frame = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (7, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame, labels)
    assert set(got.columns) == set(frame.columns) and got.schema["score"].dataType.simpleString() == "double"
    rows = got.collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    none = toxicity.score_toxicity(frame, labels.limit(0)).collect()
    assert all(r.score < 1e-6 for r in none)
    assert all(r.score > 1 - 1e-6 for r in toxicity.score_toxicity(frame, labels.filter("toxic = 1").withColumn("doc_id", F.lit(1))).collect())
    assert toxicity.score_toxicity(no_documents(spark), labels).collect() == []
