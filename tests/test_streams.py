"""Streams replayed file by file, with restarts, against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import arrivals, jobs

EVENT = "event_id long, job long, chunk long, event string, ts timestamp"
START = dt.datetime(2024, 1, 1)


def row(k, job, chunk, event, seconds):
    return (k, job, chunk, event, START + dt.timedelta(seconds=seconds))


def put(spark, folder, rows, schema=EVENT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(stream, checkpoint, sink=None, mode="append", target=None):
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(sink) if sink else w.format("parquet").option("path", target)
    query = w.start()
    query.awaitTermination()
    return query


def test_arrivals_are_read_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    stream = lambda: arrivals.new_files(spark, src, EVENT, files_a_batch=1)
    put(spark, src, [row(1, 1, 1, "PLAN", 0), row(2, 1, 1, "START", 1)])
    put(spark, src, [row(3, 1, 1, "SUCCESS", 2)])
    assert arrivals.ingest(stream(), out, mark) == 3
    assert arrivals.ingest(stream(), out, mark) == 0
    put(spark, src, [row(4, 2, 1, "PLAN", 3)])
    assert arrivals.ingest(stream(), out, mark) == 1
    got = spark.read.parquet(out)
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4]
    assert got.select("file").distinct().count() == 3 and got.where("modified IS NULL").isEmpty()


def test_one_complete_row_a_job_over_restarts(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    stream = lambda: jobs.completions(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src), 2, "10 seconds", 60)
    steps = [
        [row(1, 1, 10, "SUCCESS", 0), row(2, 1, 11, "START", 1), row(3, 2, 20, "START", 1), row(99, None, 1, "DROP", 1)],
        [row(4, 1, 10, "START", 3), row(5, 1, 11, "DROP", 4)],  # 10 is begun anew: active
        [row(6, 1, 10, "SUCCESS", 5), row(7, 1, 10, "START", 2)],  # an older event doesn't count
        [row(8, 1, 10, "SUCCESS", 6), row(9, 2, 20, "DROP", 7)],  # sent already; job 2 has one chunk only
        [row(10, 3, 30, "SUCCESS", 200), row(11, 3, 31, "SUCCESS", 200)],
        [row(12, 4, 40, "PLAN", 400)],
        [row(13, 4, 40, "PLAN", 500)],
    ]
    for step in steps:
        put(spark, src, step)
        query = run(stream(), mark, target=out)  # each call is a restart
    got = sorted((r.job, r.status) for r in spark.read.parquet(out).collect())
    assert got == [(1, "complete"), (2, "abandoned"), (3, "complete")]
    assert query.lastProgress.stateOperators[0].numRowsTotal == 1  # job 4 alone


def test_completion_of_random_jobs_equals_the_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [row(k, r.randint(1, 8), r.randint(1, 3), r.choice(["PLAN", "START", "HEARTBEAT", "SUCCESS", "SUCCESS", "DROP"]), k) for k in range(160)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sent, latest = {}, {}
    for a in range(0, 160, 16):
        put(spark, src, rows[a : a + 16])
        for k, job, chunk, event, ts in rows[a : a + 16]:
            latest.setdefault(job, {})[chunk] = event
        for job, found in latest.items():
            if job not in sent and len(found) >= 3 and set(found.values()) <= set(jobs.TERMINAL):
                sent[job] = a
    stream = jobs.completions(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src), 3, "1 hour", 10**6)
    run(stream, str(tmp_path / "mark"), target=out)
    assert sorted(x.job for x in spark.read.parquet(out).where("status = 'complete'").collect()) == sorted(sent)
    assert sent


def test_late_and_repeated_rows_are_counted(spark, tmp_path):
    r = random.Random(9)
    batches, n = [], 0
    for b in range(5):
        made = []
        for _ in range(30):
            n += 1
            made.append(row(n, 1, 1, "PLAN", b * 100 + r.randint(0, 99) - (r.choice([0, 0, 0, 150]))))
        if batches:
            made += r.sample([x for y in batches for x in y], 8)  # come again
        batches.append(made)
    src, path, mark = (str(tmp_path / x) for x in ("in", "late", "mark"))
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src)
    for k, made in enumerate(batches):
        put(spark, src, made)
        if k in (1, 2, 4):  # two batches in one run, then restarts
            run(stream(), mark, arrivals.late_rows(path, 60))
    top, kept, want = None, {}, {}
    for k, made in enumerate(batches):
        late = [x for x in made if top is not None and x[4] < top - dt.timedelta(seconds=60)]
        seen, repeated, fresh = set(), 0, []
        for x in sorted(made, key=lambda x: x[4]):
            again = x[0] in seen or x[0] in kept
            seen.add(x[0])
            if x not in late:
                repeated += again
                if not again:
                    fresh.append(x)
        want[k] = (len(made), len(late), repeated)
        top = max([x[4] for x in made] + ([top] if top else []))
        kept = {i: t for i, t in {**kept, **{x[0]: x[4] for x in fresh}}.items() if t >= top - dt.timedelta(seconds=60)}
    got = {x.batch: (x.rows, x.late, x.repeated) for x in spark.read.parquet(f"{path}/counts").collect()}
    assert got == want and sum(x[1] for x in want.values()) > 3 and sum(x[2] for x in want.values()) > 3
    arrivals.late_rows(path, 60)(spark.createDataFrame(batches[4], EVENT), 4)  # done again: the same
    assert {x.batch: (x.rows, x.late, x.repeated) for x in spark.read.parquet(f"{path}/counts").collect()} == want


def test_punctual_rows_come_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    stream = lambda: arrivals.punctual(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src), "60 seconds")
    for step in ([row(1, 1, 1, "PLAN", 0), row(1, 1, 1, "PLAN", 0), row(2, 1, 1, "PLAN", 100)], [row(1, 1, 1, "PLAN", 1), row(3, 1, 1, "PLAN", 101)], [row(2, 1, 1, "PLAN", 100), row(4, 1, 1, "PLAN", 5)]):
        put(spark, src, step)
        run(stream(), mark, target=out)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


@pytest.mark.parametrize("width", ["1 hour"])
def test_windows_slide(spark, width):
    events = spark.createDataFrame([row(k, 1, 1, "PLAN", 900 * k) for k in range(8)], EVENT)
    got = jobs.progress_windows(events, width, "30 minutes").agg(F.sum("n"), F.count("*")).first()
    assert tuple(got) == (16, 5)


FIELDS = ("state", "score")
PATCH = "job long, ts timestamp, event_id long, state string, score double"


def patch(job, seconds, event_id, state, score):
    return (job, START + dt.timedelta(seconds=seconds), event_id, state, score)


def now(spark, path):
    from quillspark.streaming import snapshots

    return {r.job: (r.state, r.score, r.event_id) for r in snapshots.snapshot(spark, path, FIELDS).collect()}


def test_patches_merge_field_by_field(spark, tmp_path):
    from quillspark.streaming import snapshots

    path = str(tmp_path / "snap")
    frame = lambda rows: spark.createDataFrame(rows, PATCH)
    create = snapshots.patch_jobs(path, FIELDS, "a", create=True, buckets=4)
    create(frame([patch(k, k, k, "new", None) for k in range(10)]), 0)
    merge = snapshots.patch_jobs(path, FIELDS, "a", buckets=4)
    second = frame([patch(1, 50, 11, None, 0.5), patch(1, 60, 12, "done", None), patch(99, 60, 13, "unknown", None), (None, START, 1, "x", 1.0), (2, None, 1, "x", 1.0)])
    merge(second, 1)
    assert now(spark, path)[1] == ("done", 0.5, 12) and 99 not in now(spark, path) and len(now(spark, path)) == 10
    before = now(spark, path)
    merge(second, 1)  # done again
    assert now(spark, path) == before
    merge(frame([patch(1, 55, 14, "late", 0.7), patch(2, 5, 15, None, 0.1)]), 2)
    assert now(spark, path)[1] == ("done", 0.7, 12) and now(spark, path)[2] == ("new", 0.1, 15)
    merge(frame([]), 3)
    other = snapshots.patch_jobs(path, FIELDS, "b", buckets=4)
    other(frame([patch(3, 90, 16, "after a new checkpoint", None)]), 0)
    assert now(spark, path)[3][0].startswith("after") and len(now(spark, path)) == 10
    kept = {p.name for p in (tmp_path / "snap/data").iterdir()}
    assert len(kept) <= 5 and len(list((tmp_path / "snap/manifest").iterdir())) == 2
    top = snapshots.newest(snapshots.snapshot(spark, path, FIELDS), 3).collect()
    assert [r.job for r in top] == [3, 1, 9]


def test_patches_of_a_stream_equal_the_batch(spark, tmp_path):
    from quillspark.streaming import snapshots

    r = random.Random(2)
    rows = [patch(r.randint(0, 12), r.randint(0, 999), k, r.choice(["a", "b", None]), r.choice([None, k / 10])) for k in range(120)]
    src, path = str(tmp_path / "in"), str(tmp_path / "snap")
    merge = snapshots.patch_jobs(path, FIELDS, "run", create=True, buckets=3)
    for a in range(0, 120, 30):
        put(spark, src, rows[a : a + 30], PATCH)
        if a in (30, 90):
            run(spark.readStream.schema(PATCH).option("maxFilesPerTrigger", 1).parquet(src), str(tmp_path / "mark"), merge)
    want = {}
    for job, ts, k, state, score in sorted(rows, key=lambda x: (x[1], x[2])):
        old = want.get(job, (None, None, None))
        want[job] = (state if state is not None else old[0], score if score is not None else old[1], k)
    assert now(spark, path) == want
