"""Tables written in the middle of a job, so that what follows neither depends on lost executors nor is worked out again."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local one serves, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/quillspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession, passes: int = 1) -> None:
    """Lets Spark delete the shuffle files of finished jobs now: it does so when the driver collects garbage.

    What a pass lets go of may hold more, which the next one finds.
    """
    for k in range(passes):
        time.sleep(0.3 if k else 0)
        gc.collect()
        spark._jvm.System.gc()


def bound_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keeps an Arrow batch of whole texts small enough for a Python worker, for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of batches, so that few rows at a time become Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """The rows that `fold` makes of each group's rows, in order; one group at a time is held in memory.

    Groups lie one after the other in sorted partitions, so that many small ones share an Arrow batch, which groupBy with a
    Python function does not give them.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[dict] = []
        for batch in slices(batches):
            for row in batch.to_pylist():
                if group and any(row[k] != group[0][k] for k in keys):
                    out += fold(group)
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out = []
        if group:
            yield pa.RecordBatch.from_pylist(fold(group), schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str = "number") -> DataFrame:
    """df with `name`: each row's place in its group, from 1, in ascending order (nulls first).

    The same as row_number over a window by group, but no group, not even all rows as one, comes together in a task: rows
    are sorted by ranges and written, and places are prefix sums of the counts by group and range. Ties are numbered in
    some order.
    """
    keys = [*groups, *order]
    kept = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row_", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("row_", 33).alias("part_")
    counts = kept.groupBy(*groups, part).agg(F.count("*").alias("n_"), F.min("row_").alias("first_"))
    # A row for each group and range that it reaches into.
    before = Window.partitionBy(*groups).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.withColumn("base_", F.coalesce(F.sum("n_").over(before), F.lit(0))).drop("n_"), "numbered-bases")
    bases = bases.withColumnsRenamed({g: f"{g}_of_" for g in groups}).withColumnRenamed("part_", "of_part_")
    same = F.shiftright("row_", 33) == F.col("of_part_")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"{g}_of_"))
    small = F.broadcast(bases) if bases.count() <= 100_000 else bases
    return kept.join(small, same).select(*df.columns, (F.col("base_") + F.col("row_") - F.col("first_") + 1).alias(name))
