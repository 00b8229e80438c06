"""Streaming monitors of job events (job, chunk, event, ts): state, stalls, completion, windows and a snapshot sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def chunk_states(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Job, chunk, and the latest event's name; update mode. Ties go to the larger event_id."""
    return events.withWatermark("ts", lateness).groupBy("job", "chunk").agg(F.max_by("event", F.struct("ts", "event_id")).alias("state"))


def stalls(events: DataFrame, seconds: int = 25, lateness: str = "10 seconds") -> DataFrame:
    """Job, chunk, since: once for each silence of over `seconds`, when event time has passed it."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "chunk": [key[1]], "since": [pd.Timestamp(last, unit="us")]})
            return
        times = sorted(int(x.value // 1000) for f in frames for x in pd.to_datetime(f["ts"]))
        last = state.get[0] if state.exists else None
        for at in times:
            if last is not None and at - last > seconds * 1_000_000:
                yield pd.DataFrame({"job": [key[0]], "chunk": [key[1]], "since": [pd.Timestamp(last, unit="us")]})
            last = at if last is None else max(last, at)
        state.update((last,))
        limit = last // 1000 + seconds * 1000
        state.setTimeoutTimestamp(max(limit, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", lateness).groupBy("job", "chunk").applyInPandasWithState(watch, "job long, chunk long, since timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


#: Events after which a chunk is done, unless a later one begins it anew.
TERMINAL = ("SUCCESS", "DROP")


def completions(events: DataFrame, chunks: int, lateness: str = "1 hour", keep: int = 86_400) -> DataFrame:
    """Job, status, at: one row for each job, once `chunks` of its chunks are terminal and none is active.

    A chunk is what its latest event (by ts, then event_id) says: terminal after SUCCESS or DROP, else active; so a chunk begun
    anew after its end holds the job back. A job's state is its chunks' latest events, and a mark alone once the row is
    sent. `keep` seconds of event time after a job's last event the state goes: with the mark, so that a straggler within
    that time sends nothing again; without it, with a row of status abandoned. Rows later than the watermark are left out
    by Spark (`late_rows` counts them), so a job whose state is gone doesn't come back by them. Events without job, chunk or
    ts are ignored. After a restart from the checkpoint nothing is sent twice.
    """

    def gate(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, sent, last = (dict(zip(state.get[0], zip(*state.get[1:4]), strict=True)), state.get[4], state.get[5]) if state.exists else ({}, False, 0)
        if state.hasTimedOut:
            state.remove()
            if not sent:
                yield pd.DataFrame({"job": [key[0]], "status": ["abandoned"], "at": [pd.Timestamp(last, unit="us")]})
            return
        for f in frames:
            for chunk, event_id, event, ts in zip(f["chunk"], f["event_id"], f["event"], pd.to_datetime(f["ts"]), strict=True):
                at = int(ts.value // 1000)
                last = max(last, at)
                if not sent and (chunk not in known or known[chunk][:2] < (at, event_id)):
                    known[chunk] = (at, int(event_id), event)
        done = sum(e in TERMINAL for _, _, e in known.values())
        now = not sent and done >= chunks and done == len(known)
        if sent or now:
            known = {}
        columns = [list(x) for x in zip(*known.values(), strict=True)] or [[], [], []]
        state.update(([int(c) for c in known], *columns, sent or now, last))
        state.setTimeoutTimestamp(max(last // 1000 + keep * 1000, state.getCurrentWatermarkMs() + 1))
        if now:
            yield pd.DataFrame({"job": [key[0]], "status": ["complete"], "at": [pd.Timestamp(last, unit="us")]})

    whole = events.where("job IS NOT NULL AND chunk IS NOT NULL AND ts IS NOT NULL").select("job", "chunk", F.coalesce("event_id", F.lit(0).cast("long")).alias("event_id"), F.coalesce("event", F.lit("")).alias("event"), "ts")
    schema = "chunks array<long>, times array<long>, ids array<long>, events array<string>, sent boolean, last long"
    return whole.withWatermark("ts", lateness).groupBy("job").applyInPandasWithState(gate, "job long, status string, at timestamp", schema, "append", GroupStateTimeout.EventTimeTimeout)


def progress_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "2 hours") -> DataFrame:
    """Counts by event in tumbling or sliding windows; later rows than the watermark are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", lateness).groupBy(window, "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event", "n")


def first_answers(answers: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first answer of each learner and question is final."""
    return answers.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["learner", "question"])


def merge_snapshot(path: str):
    """A foreachBatch function that keeps the latest row of each job in a Parquet folder for each batch.

    The snapshot of batch n is path/n, from path/n-1 and the batch, so a repeated batch gives the same result. A late row
    does not replace a newer one of an earlier batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = spark.read.parquet(f"{path}/{number - 1}").unionByName(batch) if number else batch
        latest = rows.withColumn("r", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("ts"), F.desc("event_id")))).where("r = 1").drop("r")
        latest.write.mode("overwrite").parquet(f"{path}/{number}")

    return merge
