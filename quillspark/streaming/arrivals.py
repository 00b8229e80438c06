"""Files as they arrive, and rows that come late or twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def new_files(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "parquet", files_a_batch: int = 1000, pattern: str | None = None) -> DataFrame:
    """A stream of the rows of files in a folder, with file and modified; a checkpoint remembers which were read.

    pattern: of file names. At most files_a_batch files make a micro-batch, so a large backlog is no large batch.
    """
    reader = spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_a_batch)
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(folder).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def ingest(rows: DataFrame, target: str, checkpoint: str) -> int:
    """Appends what has arrived since the last call to a Parquet folder and ends; the number of rows read.

    The file sink's log makes a micro-batch that is repeated after a failure count once. No new files: nothing is written.
    """
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


def punctual(events: DataFrame, lateness: str, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """A stream's rows without those that repeat a key within `lateness` of event time; a repetition beyond it is late and left out."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def late_rows(path: str, lateness: int, keys: tuple[str, ...] = ("event_id",)) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that counts beside the stream: rows, late and repeated ones of each micro-batch, in path/counts/batch=n.

    A row is late if its ts is more than `lateness` seconds before the greatest ts of the batches before: what a watermark
    drops. A row repeats if its keys stand in an earlier row of the same batch (by ts), or in a punctual row of a batch
    before that is not more than `lateness` seconds behind. Rows without ts are neither. For batch n, path/state/n has
    the greatest ts and the keys that may still be repeated, worked out from path/state/n-1, so a batch done again
    overwrites what it wrote; the state before last is deleted.
    """

    def count(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = f"{path}/state"
        behind = F.expr(f"make_dt_interval(0, 0, 0, {lateness})")
        rows = batch.select(*keys, "ts")
        before = spark.read.parquet(f"{state}/{number - 1}") if number else None
        limit = before.agg(F.max("ts")).first()[0] if before is not None else None
        late = (F.col("ts") < F.lit(limit) - behind) if limit is not None else F.lit(False)
        marked = rows.withColumn("late", F.coalesce(late, F.lit(False)))
        again = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ts").asc_nulls_last())) > 1
        marked = marked.withColumn("again", again & F.col("ts").isNotNull())
        if before is not None:
            held = before.where("kept").select(*keys).withColumn("held", F.lit(True))
            marked = marked.join(held, list(keys), "left").withColumn("again", (F.col("again") | F.coalesce("held", F.lit(False))) & F.col("ts").isNotNull()).drop("held")
        counts = marked.agg(F.count("*").alias("rows"), F.count_if("late").alias("late"), F.count_if(F.col("again") & ~F.col("late")).alias("repeated"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")
        fresh = marked.where("NOT late AND NOT again AND ts IS NOT NULL").select(*keys, "ts", F.lit(True).alias("kept"))
        top = rows.agg(F.max("ts").alias("ts"))
        if before is not None:
            fresh = fresh.unionByName(before.where("kept"))
            top = top.unionByName(before.agg(F.max("ts").alias("ts"))).agg(F.max("ts").alias("ts"))
        top = top.withColumn("kept", F.lit(False))
        alive = fresh.crossJoin(F.broadcast(top.select(F.col("ts").alias("top")))).where(F.col("ts") >= F.col("top") - behind).drop("top")  # top is one row
        alive.unionByName(top, allowMissingColumns=True).write.mode("overwrite").parquet(f"{state}/{number}")
        if number > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{number - 2}")
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    return count
