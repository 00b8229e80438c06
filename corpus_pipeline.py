"""Document pipeline: quality rules, line de-duplication, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.decontamination import drop_contaminated
from quillspark.llm.jaccard_join import one_of_each_group
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.packing import pack
from quillspark.llm.quality import keep_good
from quillspark.llm.shared import release, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the language model of the first stage, nor the packing.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that has no word left, though it had repeated lines, goes with them."""
    out = dedup_lines(docs.select(*COLUMNS), exact_from=1)
    kept = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return one_of_each_group(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces and places of what is left."""
    return pack(docs)


def _stage(function):
    """What earlier stages wrote for themselves is deleted when the next one begins: its docs have been written since."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return function(spark, docs, sf_dir)

    run_stage.__doc__ = function.__doc__
    return run_stage


STAGES = [(f.__name__, _stage(f)) for f in (quality_rules, line_dedup, near_duplicates, decontamination, packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        result = stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        result.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
