import uuid

import pytest

from gavelworks.llm.digest_index import DigestIndex, without_copies

from frames import no_documents, odd_documents


@pytest.fixture
def index(spark):
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", buckets=4)
    yield index
    index.drop()


def test_batches(spark, index):
    first = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b"), (4, None), (5, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in index.deduplicate(first, "one").collect()}
    assert {d: (r.keep_id, r.group_size, r.kept) for d, r in rows.items()} == {
        1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (5, 2, False), 5: (5, 2, True)}
    second = spark.createDataFrame([(6, "B"), (7, "É"), (8, "é"), (9, "a")], "doc_id long, text string")
    rows = {r.doc_id: r for r in index.deduplicate(second, "two").collect()}
    assert {d: (r.keep_id, r.kept) for d, r in rows.items()} == {6: (3, False), 7: (7, True), 8: (8, True), 9: (2, False)}
    # A batch that is run again decides as before, and adds nothing.
    n = index.read().count()
    again = {r.doc_id: r.kept for r in index.deduplicate(second, "two").collect()}
    assert again == {6: False, 7: True, 8: True, 9: False} and index.read().count() == n == 5


def test_the_index_is_not_dealt_out_again(spark, index):
    index.deduplicate(spark.range(100).selectExpr("id AS doc_id", "string(id) AS text"), "one").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = spark.range(9).selectExpr("unhex(sha2(string(id), 256)) AS digest").repartition(4, "digest")
        plan = fresh.join(index.read(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_odd_frames(spark, index):
    frame = odd_documents(spark)
    kept = without_copies(frame, index, "one")
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("2 4 5 6 7 None 8 9".split())
    index.drop()
    repeated = without_copies(frame.filter("doc_id = 1"), index, "one")
    assert repeated.count() == 2
    index.drop()
    assert index.deduplicate(no_documents(spark), "none").collect() == []
    assert index.read().count() == 0


def test_one_id_with_two_texts(spark, index):
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in without_copies(frame, index, "x").collect()) == [(1, "b"), (2, "a")]
