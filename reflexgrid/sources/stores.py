"""Raw and final measurement tables as Parquet folders, one writer at a time.

Records lie in `records`, by bucket of the session, version of the bucket and origin (insert or rewrite). `versions` names the
current version of each bucket that was ever rewritten; readers see these only. Deleting writes the rows that stay of the buckets it
touches as a new version and then switches to it, so a crash leaves the old state, and a row inserted again after it was
deleted is a row like any other. Subscribers read the inserted rows, each once, however often a bucket is rewritten.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..schemas import FINAL_RECORD, RAW_MEASUREMENT

BUCKETS = 64


def surrogate_id(*cols: str):
    return F.xxhash64(*cols)


def raw_records(samples: DataFrame) -> DataFrame:
    """Raw rows of the frames with both pupils found."""
    found = F.lit("DETECTED")
    return samples.where("left_px > 0 and right_px > 0").select(
        surrogate_id("session_id", "sample_id").alias("id"), "session_id", "sample_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        half_up(F.col("left_px"), 2).alias("left_pupil_px"), half_up(F.col("right_px"), 2).alias("right_pupil_px"), found.alias("left_status"), found.alias("right_status"),
        F.col("frame_ts_ms").alias("perf_timestamp_ms"),
    )


def final_records(reports: DataFrame, stimuli: DataFrame, finished: DataFrame, onset_px: DataFrame) -> DataFrame:
    """Final rows of the reliable reports. `finished` has (session_id, ts), `onset_px` the sizes at stimulus onset."""
    rows = reports.where("is_reliable").join(stimuli, "session_id").join(finished, "session_id").join(onset_px, "session_id", "left")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return rows.select(
        surrogate_id("session_id", "ts").alias("id"), "session_id", F.date_format("ts", iso).alias("timestamp"), F.col("left_baseline_px").alias("baseline_left_pupil_px"),
        F.col("right_baseline_px").alias("baseline_right_pupil_px"), F.date_format("ts", iso).alias("stimulus_onset_timestamp"), F.col("onset_ms").alias("stimulus_onset_ms"),
        F.coalesce("onset_left_px", "left_baseline_px").alias("stimulus_left_pupil_px"), F.coalesce("onset_right_px", "right_baseline_px").alias("stimulus_right_pupil_px"),
        F.col("actual_ms").alias("stimulus_duration_ms"), F.lit("FINALIZED").alias("status"),
    )


def px_at_onset(samples: DataFrame) -> DataFrame:
    """Sizes of the last frame at or before the onset that had one."""
    rank = F.struct("frame_ts_ms", "sample_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), rank))
    return samples.where("time_ms <= 0").groupBy("session_id").agg(last("left_px").alias("onset_left_px"), last("right_px").alias("onset_right_px"))


_PLACE = "bucket int, version bigint, origin string"


def _bucket() -> Column:
    return F.pmod(F.hash("session_id"), F.lit(BUCKETS))


def _versions(spark: SparkSession, store: str) -> dict[int, int]:
    """Current version of each rewritten bucket (at most BUCKETS rows); the others are at version 0."""
    try:
        rows = spark.read.schema("bucket int, version bigint").parquet(f"{store}/versions")
    except Exception as e:  # never rewritten
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return {r["bucket"]: r["version"] for r in rows.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def _version(versions: dict[int, int]) -> Column:
    at = F.lit(0).cast("long")
    for bucket, version in versions.items():
        at = F.when(F.col("bucket") == bucket, F.lit(version)).otherwise(at)
    return at


def _write(rows: DataFrame, store: str, origin: str) -> None:
    # a task per bucket (more for a large one), so that a write makes no file for every task and bucket
    placed = rows.withColumn("origin", F.lit(origin)).hint("rebalance", "bucket")
    placed.write.mode("append").partitionBy("bucket", "version", "origin").parquet(f"{store}/records")


def _switch(spark: SparkSession, store: str, buckets: list[int], version: int) -> None:
    spark.createDataFrame([(b, version) for b in buckets], "bucket int, version long").coalesce(1).write.mode("append").parquet(f"{store}/versions")


def append(df: DataFrame, store: str) -> None:
    versions = _versions(df.sparkSession, store)
    _write(df.withColumn("bucket", _bucket()).withColumn("version", _version(versions)), store, "insert")


def _current(spark: SparkSession, store: str, schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, {_PLACE}").parquet(f"{store}/records")
    return rows.where(F.col("version") == _version(_versions(spark, store)))


def read(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """The records as they stand; filters on the columns reach the Parquet scan, old versions are pruned as partitions."""
    return _current(spark, store, schema).drop("bucket", "version", "origin")


def read_raw(spark: SparkSession, store: str) -> DataFrame:
    return read(spark, store, RAW_MEASUREMENT)


def read_finals(spark: SparkSession, store: str) -> DataFrame:
    return read(spark, store, FINAL_RECORD)


def one_per_session(records: DataFrame) -> DataFrame:
    """The earliest record of each session, combined map-side."""
    rest = [c for c in records.columns if c != "session_id"]
    best = records.groupBy("session_id").agg(F.min_by(F.struct(*rest), F.struct("timestamp", "id")).alias("r"))
    return best.select("session_id", "r.*").select(*records.columns)


def insert_finals(new: DataFrame, store: str) -> None:
    """Add sessions that are not stored yet; running it again adds nothing."""
    spark = new.sparkSession
    fresh = one_per_session(new)
    try:
        fresh = fresh.join(read_finals(spark, store).select("session_id"), "session_id", "left_anti").select(*new.columns)
    except Exception as e:  # first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
    append(fresh, store)


def delete_ids(ids: DataFrame, store: str, schema: str = FINAL_RECORD) -> None:
    """Remove records by id: rewrite the buckets that hold one, then switch to the new versions."""
    spark = ids.sparkSession
    rows = _current(spark, store, schema)
    gone = ids.select("id")
    touched = [r["bucket"] for r in rows.join(gone, "id", "left_semi").select("bucket").distinct().collect()]  # at most BUCKETS
    if not touched:
        return
    version = _next(_versions(spark, store))
    stay = rows.where(F.col("bucket").isin(touched)).join(gone, "id", "left_anti")
    _write(stay.drop("origin").withColumn("version", F.lit(version)), store, "rewrite")
    _switch(spark, store, touched, version)


def _next(versions: dict[int, int]) -> int:
    """A version later than all before, also than one whose switch never came."""
    return max([time.time_ns() // 1000, *(v + 1 for v in versions.values())])


def clear(spark: SparkSession, store: str, schema: str) -> None:
    """Empty one store, by a switch to versions without rows; others are untouched."""
    _switch(spark, store, list(range(BUCKETS)), _next(_versions(spark, store)))


def compact(spark: SparkSession, store: str, schema: str) -> None:
    """Remove the folders of versions that are not current. Nothing is rewritten and no row is published again; subscribers should
    have read what they want of the old versions."""
    versions = _versions(spark, store)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{store}/records")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{store}/records/bucket=*/version=*")):
        path = status.getPath()
        bucket, version = int(path.getParent().getName().split("=")[1]), int(path.getName().split("=")[1])
        if version != versions.get(bucket, 0):
            fs.delete(path, True)


def new_rows(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """Stream of rows inserted into a store, for subscribers."""
    rows = spark.readStream.schema(f"{schema}, {_PLACE}").parquet(f"{store}/records")
    return rows.where("origin = 'insert'").drop("bucket", "version", "origin")


def write_valid(samples: DataFrame, checked: DataFrame, path: str) -> None:
    """The valid samples, one folder per split."""
    good = checked.where("is_valid").select("split", "sample")
    samples.join(good, ["split", "sample"], "left_semi").write.partitionBy("split").mode("overwrite").parquet(path)
