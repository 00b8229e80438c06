"""Snapshot of jobs kept by a stream: patches merge field by field, and only buckets of jobs that a batch touches are written."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def _manifest(spark: SparkSession, path: str, step: int) -> list:
    """(bucket, version, run, batch) rows, at most one for each bucket and one more."""
    return spark.read.parquet(f"{path}/manifest/{step}").collect()


def _last(spark: SparkSession, path: str) -> int:
    """The last step whose manifest is complete, or -1."""
    steps = sorted((int(x) for x in _names(spark, f"{path}/manifest")), reverse=True)
    return next((s for s in steps if "_SUCCESS" in _names(spark, f"{path}/manifest/{s}")), -1)


def _rows(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    found = [f"{path}/data/{v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.parquet(*found) if found else None


def patch_jobs(path: str, fields: Sequence[str], run: str, create: bool = False, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges patches (job, ts, event_id and fields) into the snapshot in `path`.

    A field takes the value of the latest patch, by ts and event_id, in which it is not null, whatever batch that comes in;
    so a late patch fills what is missing and replaces nothing newer. Patches of a job that the snapshot lacks are ignored,
    unless create is set. Rows without job or ts are ignored.

    Jobs are dealt to buckets by their hash; a batch rewrites the buckets it touches under the number of its step, and then a
    manifest that says which step each bucket's rows are of, so a reader sees all of a batch or nothing. `run` names the
    checkpoint: a batch of the same run and number done again replaces its step; a new checkpoint, whose numbers begin
    again, goes on from what is there. Data that neither the last manifest nor the one before needs is deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = _last(spark, path)
        told = _manifest(spark, path, last) if last >= 0 else []
        again = any(r.bucket < 0 and r.run == run and r.batch == number for r in told)
        step, base = (last, last - 1) if again else (last + 1, last)
        versions = {r.bucket: r.version for r in (_manifest(spark, path, base) if base >= 0 and again else told if base >= 0 else []) if r.bucket >= 0}
        rows = batch.where("job IS NOT NULL AND ts IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("job"), F.lit(buckets)).cast("int"))
        at = F.struct("ts", F.coalesce(C("event_id").cast("long"), F.lit(0)).alias("event_id"))
        patches = rows.select("job", "bucket", at.alias("at"), *(F.when(C(f).isNotNull(), F.struct(at.alias("at"), C(f).alias("v"))).alias(f) for f in fields))
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        before = _rows(spark, path, {b: versions[b] for b in touched if b in versions})
        merged = patches.withColumn("old", F.lit(False))
        if before is not None:
            merged = merged.unionByName(before.select("job", F.pmod(F.xxhash64("job"), F.lit(buckets)).cast("int").alias("bucket"), "at", *fields, F.lit(True).alias("old")))
        merged = merged.groupBy("bucket", "job").agg(F.max("at").alias("at"), *(F.max(f).alias(f) for f in fields), F.max("old").alias("old"))
        merged = (merged if create else merged.where("old")).drop("old")
        if touched:
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{step}")
        # A bucket of which nothing was kept has no folder.
        made = {int(x.split("=")[1]) for x in _names(spark, f"{path}/data/{step}") if x.startswith("bucket=")}
        now = versions | {b: step for b in touched if b in made}
        lines = [(b, v, run, number) for b, v in now.items()] + [(-1, step, run, number)]
        spark.createDataFrame(lines, "bucket int, version int, run string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{step}")
        needed = {*now.values(), *versions.values(), step}
        for x in _names(spark, f"{path}/data"):
            if int(x) not in needed:
                _remove(spark, f"{path}/data/{x}")
        for x in _names(spark, f"{path}/manifest"):
            if int(x) < step - 1:
                _remove(spark, f"{path}/manifest/{x}")

    return merge


def snapshot(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """job, ts and event_id of the latest patch, and fields, by the last complete manifest; an error if there is none or it is empty."""
    last = _last(spark, path)
    rows = _rows(spark, path, {r.bucket: r.version for r in _manifest(spark, path, last) if r.bucket >= 0}) if last >= 0 else None
    if rows is None:
        raise ValueError(f"no snapshot in {path}")
    return rows.select("job", C("at.ts").alias("ts"), C("at.event_id").alias("event_id"), *(C(f"{f}.v").alias(f) for f in fields))


def newest(jobs: DataFrame, most: int = 100) -> DataFrame:
    """The history as it is shown: the `most` jobs with the latest patches, a top-k report."""
    return jobs.orderBy(F.desc("ts"), F.desc("event_id"), "job").limit(most)
