"""What must grow with the input alone: shuffles and what a task holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import chunkers
from quillspark.plans import all_queries

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_segments_of_texts_need_no_shuffle(spark):
    assert "Exchange" not in plan(all_queries.queries()["C05_segments"](spark, SF))
    docs = spark.createDataFrame([(1, "a b\nc d e\n\nf"), (2, None), (3, ""), (4, "x " * 9 + "\ny")], "doc_id long, text string")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l")).select("doc_id", (F.col("p") + 1).cast("long").alias("k"), "l")
    got = sorted(map(tuple, chunkers.text_segments(docs, 4).collect()))
    assert got == sorted(map(tuple, chunkers.segments(lines, 4).collect()))
    assert got == [(1, 1, 1, 1, 2), (1, 2, 2, 4, 4), (3, 1, 1, 1, 0), (4, 1, 1, 1, 9), (4, 2, 2, 2, 1)]


def test_few_slides_are_held_at_once(spark, monkeypatch):
    """Batches of 10,000 texts became frames before."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("C14_atomic_lines", "C13_joined_lines"):
        assert "MapInPandas" not in plan(all_queries.queries()[name](spark, SF)), name
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_passages_are_joined_before_they_are_made_distinct(spark):
    text = plan(all_queries.queries()["J08_copied_passages"](spark, SF))
    assert "Exchange hashpartitioning" not in text[text.index("BroadcastHashJoin") :]
