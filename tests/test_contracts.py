"""What is checked and counted while tables are written."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gavelworks.operators import checks, summaries
from gavelworks.sources import tables


def test_contract_names_every_column(spark):
    target = spark.createDataFrame([], "a long, b string, c double, d int").schema
    given = spark.createDataFrame([], "c float, a string, x int, b string").schema
    assert tables.contract_report(given, target) == [
        ("a", "string", "bigint", "narrowed"),
        ("b", "string", "string", "same"),
        ("c", "float", "double", "widened"),
        ("d", None, "int", "missing"),
        ("x", "int", None, "extra"),
    ]


def test_contract_is_kept_or_nothing_is_written(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x", 1.5)], "a long, b string, c double").write.parquet(path)
    report = tables.append_to_contract(spark.createDataFrame([(2.5, 7)], "c float, a int"), path)
    assert [r[3] for r in report] == ["widened", "missing", "widened"]
    with pytest.raises(tables.ContractError, match="d: extra") as error:
        tables.append_to_contract(spark.createDataFrame([(1, 1)], "a long, d int"), path)
    assert error.value.report[-1] == ("d", "int", None, "extra")
    with pytest.raises(tables.ContractError, match="a: narrowed"):
        tables.append_to_contract(spark.createDataFrame([(1.0,)], "a double"), path)
    rows = spark.read.parquet(path)
    assert rows.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
    assert sorted(map(tuple, rows.collect())) == [(1, "x", 1.5), (7, None, 2.5)]


def test_report_is_counted_in_the_pass_that_writes(spark, tmp_path):
    """The rows go by once: a counter in the plan sees each row one time."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def passed(x):
        seen.add(1)
        return x

    rows = spark.range(100).select(passed(F.col("id").cast("int")).alias("n"))
    rules = {"small": F.col("n") < 10, "none": F.lit(None).cast("boolean")} | checks.column_rules(rows, ["n", "m"], ["n"])
    checks.write_with_report(rows, str(tmp_path / "rows"), str(tmp_path / "report"), rules)
    assert seen.value == 100
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "report")).collect()] == [
        ("small", 10, 100),
        ("none", 0, 100),
        ("Missing n", 0, 100),
        ("Missing m", 100, 100),
        ("Not a number: n", 0, 100),
    ]
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 100


def test_sketches_merge_in_any_order(spark, tmp_path):
    draw, path = random.Random(2), str(tmp_path / "s")
    values = [[draw.randrange(5000) for _ in range(3000)] for _ in range(3)]
    for batch, own in enumerate(values):
        frame = spark.createDataFrame([(v, None if v % 2 else str(v)) for v in own], "a long, b string")
        for _ in range(2):  # a batch that comes again replaces itself
            summaries.add_sketches(frame, ["a", "b"], str(batch), path)
    found = {r["column"]: r["distinct"] for r in summaries.merged_distinct_counts(spark.read.parquet(path)).collect()}
    everything = {v for own in values for v in own}
    assert found["a"] == pytest.approx(len(everything), rel=0.02)
    assert found["b"] == pytest.approx(len({v for v in everything if v % 2 == 0}), rel=0.02)
    shuffled = spark.read.parquet(path).orderBy(F.rand(1)).coalesce(1)
    assert {r["column"]: r["distinct"] for r in summaries.merged_distinct_counts(shuffled).collect()} == found
