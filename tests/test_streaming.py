"""Streams over many files give what one batch gives; late rows are counted."""

import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from reflexgrid.operators import live
from reflexgrid.operators.ordered import Layout
from reflexgrid.plans import fixtures as fx
from reflexgrid.plans.catalog import QUERIES
from reflexgrid.plans.catalog.streams import frames
from reflexgrid.session import scratch
from reflexgrid.streaming import jobs, operators, pipelines
from reflexgrid.streaming.ordered import recording_phases


@pytest.fixture(scope="module")
def split_files(spark, sf):
    """The events in six files by id range, read one file per batch."""
    out = scratch(spark, "events")
    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(6):
        e.where(F.floor(F.col("event_id") * 6 / 1000) == k).coalesce(1).write.mode("append").parquet(out)
    return out


def _frames(spark, folder):
    return frames(spark, folder, "*.parquet", 1)


def closed(frames, make, name):
    ending = jobs.Ending(frames)
    return jobs.drain(make(ending.stream), name, ending=ending)


def _rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


FOLDS = {
    "ema": lambda f, delay: operators.stabilised(f, delay=delay),
    "throttle": lambda f, delay: operators.throttled(f, 3_600_000.0 * 6, delay=delay),
    "baseline": lambda f, delay: operators.baseline_states(f.withColumn("left_px", F.floor("px") / 10).withColumn("right_px", F.col("mm")), delay=delay),
    "phases": lambda f, delay: recording_phases(f, 3e8, 1e8, 6e8, 1e8, delay),
}


@pytest.mark.parametrize("name", FOLDS)
def test_many_batches_equal_one(spark, sf, split_files, name):
    many, query = closed(_frames(spark, split_files), lambda f: FOLDS[name](f, "10 seconds"), name)
    one, _ = closed(frames(spark, sf), lambda f: FOLDS[name](f, "10 seconds"), name)
    assert _rows(many) == _rows(one)
    # every session's state has ended with the stream
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


@pytest.mark.parametrize("name", FOLDS)
def test_rows_out_of_order_across_batches(spark, sf, name):
    """Files dealt by a hash of the row: each batch holds rows from anywhere in the delay."""
    out = scratch(spark, "shuffled")
    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(5):
        e.where(F.pmod(F.hash("event_id"), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(out)
    mixed, query = closed(_frames(spark, out), lambda f: FOLDS[name](f, "400 days"), name)
    one, _ = closed(frames(spark, sf), lambda f: FOLDS[name](f, "10 seconds"), name)
    assert _rows(mixed) == _rows(one)
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def _clip(spark, rows, make, per_file):
    """Frames (session, second, px, active) written `per_file` a file, in the order given."""
    out = scratch(spark, "clip")
    schema = "session_id long, sample_id long, ts timestamp, frame_ts_ms double, px double, left_px double, right_px double, active boolean"
    made = [(s, i, datetime.fromtimestamp(1e9 + t, timezone.utc), t * 1000.0, p, p, p, a) for i, (s, t, p, a) in enumerate(rows)]
    for k in range(0, len(made), per_file):
        spark.createDataFrame(made[k : k + per_file], schema).coalesce(1).write.mode("append").parquet(out)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(out)
    return closed(stream, make, "clip")[0].collect()


def test_inactive_frames_and_idle_time_reset_the_baseline(spark):
    steady = [(1, t, 40.0, True) for t in range(6)]
    rows = steady + [(1, 6, 40.0, False), (1, 7, 40.0, True)] + [(1, t, 40.0, True) for t in range(100, 106)]
    got = {r["sample_id"]: (r["window_count"], r["state"]) for r in _clip(spark, rows, lambda f: operators.baseline_states(f, idle_ms=30_000), 4)}
    assert got[5] == (6, "BASELINE_STABLE") and got[6] == (0, "IDLE") and got[7] == (1, "COLLECTING_RAW_BASELINE")
    assert got[8] == (1, "COLLECTING_RAW_BASELINE") and got[13] == (6, "BASELINE_STABLE")


def test_recording_closes_without_further_frames(spark):
    """Seconds as in the protocol; session 2 sees no pupil, session 3 ends early, session 1 gets frames after its end."""
    rows = [(1, t / 10, 40.0, True) for t in range(80)] + [(2, t / 10, None, True) for t in range(60)] + [(3, 0.5, 40.0, True)]
    order = sorted(rows, key=lambda r: (int(r[1]), -r[0], -r[1]))  # out of order within each second
    got = {(r["session_id"], r["phase"]): (r["at_ms"] - 10**12, r["frames"], r["valid"]) for r in _clip(spark, order, lambda f: recording_phases(f, 1500.0, 200.0, 3500.0, 60_000.0, "10 seconds"), 30)}
    assert {p: got[1, p] for s, p in got if s == 1} == {"BASELINE": (0, 0, 0), "STIMULUS": (1500, 15, 15), "CONSTRICTION_RECOVERY": (1700, 17, 17), "PROCESSING": (5200, 52, 52), "COMPLETE": (5200, 52, 52)}
    assert got[2, "FAILED_INCONCLUSIVE"] == (5200, 52, 0) and (2, "COMPLETE") not in got
    assert got[3, "COMPLETE"] == (5700, 1, 1)


def test_stream_ema_equals_batch(spark, sf):
    streamed = QUERIES["stream_ema"](spark, sf)
    e = F.col("event_id")
    px = F.when(F.col("event_type") != "error", F.floor((F.col("value") + 10) * 100 + 0.5) / 100)
    batch = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), e.alias("sample_id"), "ts", px.alias("px"), (px / 20).alias("mm"), (F.lit(0.3) + (e % 7) * F.lit(0.05)).alias("x"), (F.lit(0.4) + (e % 3) * F.lit(0.01)).alias("y")
    )
    batch = live.stabilise(batch, Layout(("session_id",), ("ts", "sample_id")))
    key = lambda df: {(r["session_id"], r["sample_id"]): (r["track_status"], r["smooth_px"] or 0.0) for r in df.collect()}
    got, want = key(streamed), key(batch)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [got[k][1] for k in sorted(got)] == pytest.approx([want[k][1] for k in sorted(got)], abs=1e-4)


def test_late_rows_are_dropped_and_counted(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ordered = scratch(spark, "late")
    # file sources order files by time; a watermark holds for late rows one batch after it was seen
    e.where("event_id between 500 and 989").coalesce(1).write.parquet(ordered)
    time.sleep(1.1)
    e.where("event_id >= 990").coalesce(1).write.mode("append").parquet(ordered)
    time.sleep(1.1)
    e.where("event_id < 100").coalesce(1).write.mode("append").parquet(ordered)
    listener = jobs.count_late_rows(spark)
    rows, query = jobs.drain(operators.frames_per_second(_frames(spark, ordered), "1 day"), "late")
    assert jobs.late_rows(query) > 0
    assert listener.of(query) == jobs.late_rows(query)
    spark.streams.removeListener(listener)
    first = e.where("event_id >= 500").agg(F.min("ts")).first()[0]
    assert rows.where(F.col("end") <= F.lit(first)).count() == 0


def test_recent_rows_keep_the_newest(spark, split_files):
    f = _frames(spark, split_files).select("session_id", "sample_id", "frame_ts_ms", F.col("px").alias("v"))
    got, _ = jobs.drain(operators.recent_rows(f, ["frame_ts_ms", "sample_id"], 5, ["v"]), "recent")
    # the last version of each session holds its newest rows
    whole = spark.read.parquet(split_files).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("sample_id"))
    newest = {}
    for r in whole.collect():
        newest.setdefault(r["session_id"], []).append(r["sample_id"])
    seen = {(r["session_id"], r["sample_id"]) for r in got.collect()}
    assert all((s, i) in seen for s, v in newest.items() for i in sorted(v)[-5:])


def test_state_settings_hold_for_the_start_only(spark):
    counts, log = ("spark.sql.streaming.stateStore.rocksdb." + n for n in ("trackTotalNumberOfRows", "changelogCheckpointing.enabled"))
    before = [spark.conf.get(n, None) for n in (counts, log)]
    with jobs._state_store(spark, False):
        assert (spark.conf.get(counts), spark.conf.get(log)) == ("false", "true")
    with jobs._state_store(spark, True):
        assert (spark.conf.get(counts, None), spark.conf.get(log)) == (before[0], "true")
    assert [spark.conf.get(n, None) for n in (counts, log)] == before


def test_upserted_table_does_not_grow(spark):
    import os

    path = scratch(spark, "upsert")
    for number in [*range(8), 7]:
        rows = spark.createDataFrame([(k, number) for k in range(number % 3, 10, 3)], "session_id long, v int")
        pipelines.upsert(rows, path, number)
    got = {r["session_id"]: r["v"] for r in pipelines.latest_statistics(spark, path).collect()}
    assert got == {k: 6 if k % 3 == 0 else 7 if k % 3 == 1 else 5 for k in range(10)}
    assert len([d for d in os.listdir(path.removeprefix("file:")) if d.startswith("v")]) <= 3


def test_rejects_are_split_and_counted(spark):
    out = scratch(spark, "in")
    schema = "ts timestamp, v int"
    files = [[(100, 1), (200, 99), (None, 1)], [(300, 1), (150, 1)], [(90, 1), (400, 1), (120, 99)]]
    for rows in files:
        spark.createDataFrame([(None if t is None else datetime.fromtimestamp(t, timezone.utc), v) for t, v in rows], schema).coalesce(1).write.mode("append").parquet(out)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(out)
    table, counts, _ = pipelines.split_rejects(stream, "rejects", 60_000, F.col("v") > 50)
    got = sorted((r["batch"], r["reason"], r["n"]) for r in table.groupBy("batch", "reason").agg(F.count("*").alias("n")).collect())
    assert got == [(0, "accepted", 1), (0, "bad", 1), (0, "untimed", 1), (1, "accepted", 2), (2, "accepted", 1), (2, "bad", 1), (2, "late", 1)]
    assert [tuple(r) for r in counts.orderBy("batch").select("batch", "rows", "late", "bad", "untimed").collect()] == [(0, 3, 0, 1, 1), (1, 2, 0, 0, 0), (2, 3, 1, 1, 0)]
