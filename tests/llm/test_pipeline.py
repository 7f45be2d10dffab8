import corpus_pipeline
import pytest

from frames import no_documents, odd_documents

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(scope="module")
def labels(tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, i % 2) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_keep_the_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(out.columns) == sorted(docs.columns), name
        out = out.cache()
        counts.append(out.count())
        docs = out
    toxic, exact, near = counts[0] - counts[1], counts[1] - counts[2], counts[2] - counts[3]
    assert toxic > 0 and exact > 0 and near > 0
    assert docs.filter("NOT lossless OR n_tokens <> size(tokens)").count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_frames(spark, labels, name, stage):
    frame = odd_documents(spark)
    out = stage(spark, frame, labels)
    if name != "pieces":
        assert sorted(out.columns) == sorted(frame.columns)
    out.collect()
    assert stage(spark, no_documents(spark), labels).collect() == []


def test_run_is_the_stages_in_turn(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert set(rows.columns) == {"doc_id", "source", "tokens", "n_tokens", "lossless"} and rows.count() > 0


def test_tokens_come_in_small_batches_of_one_python_step(spark, data, monkeypatch):
    """A second worker beside each task's first, and batches of ten thousand texts, do not fit an executor."""
    seen = []

    def write(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((plan.count("MapInArrow"), int(spark.conf.get(KEY))))
        return df

    monkeypatch.setattr(corpus_pipeline, "written", write)
    before = spark.conf.get(KEY)
    corpus_pipeline.to_tokens(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    assert seen == [(1, 1_000_000)] and spark.conf.get(KEY) == before
