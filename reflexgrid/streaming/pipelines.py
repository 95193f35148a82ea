"""Streaming pipelines that combine operators with stores: alerts, closing sessions, running agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import LiveSettings, TriageSettings
from ..operators import agreement, triage
from ..session import scratch
from ..sources import stores
from . import operators
from .jobs import Ending, each_batch


def alerts(reports: DataFrame, contexts: DataFrame, cfg: TriageSettings = TriageSettings()) -> DataFrame:
    """Triage of each finished report as it arrives, joined to the static contexts."""
    rows = reports.join(contexts, "session_id").withColumn("has_report", F.lit(True))
    return triage.assess(triage.triggers(rows, cfg))


def close_and_report(finished: DataFrame, recordings, store: str, ending: Ending | None = None):
    """For every batch of finished sessions, run the batch kinetics on their frames and store the reliable reports.

    `recordings(ids)` gives the final records of these sessions; storing them twice changes nothing.
    """

    def batch(ids: DataFrame, _: int) -> None:
        stores.insert_finals(recordings(ids.select("session_id")), store)

    return each_batch(finished, "close", batch, ending)


def upsert(rows: DataFrame, path: str, number: int, key: str = "session_id") -> None:
    """Put the rows of batch `number` into the table at `path` in place of those with the same key. The table is one folder a version; a
    repeated batch replaces its own, and only the newest two are kept, so the table grows with its keys alone."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    known = sorted(_versions(fs, folder))
    before = [v for v in known if v < number]
    if before:
        rest = spark.read.schema(rows.schema).parquet(f"{path}/v{before[-1]}").join(rows.select(key), key, "left_anti")
        rows = rows.unionByName(rest)
    rows.write.mode("overwrite").parquet(f"{path}/v{number}")
    for old in before[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}"), True)


def _versions(fs, folder) -> list[int]:
    if not fs.exists(folder):
        return []
    return [int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName()[1:].isdigit()]


def running_agreement(compared: DataFrame, history: int = LiveSettings.history, every: str | None = None):
    """Keep the agreement statistics of every session up to date. Returns (statistics folder, query).

    The short history of a session lives in the stream's state; each batch replaces the statistics of the sessions it touched. With `every` ("1
    second") the query runs on that trigger until it is stopped; without, it ends when all that is there was read.
    """
    stats = scratch(compared.sparkSession, "agreement")
    recent = operators.recent_rows(compared, ["ts_ms", "sample_id"], history, ["left_px_b", "right_px_b"])

    def batch(rows: DataFrame, number: int) -> None:
        # whatever reads the batch again would run the join and the states again, so its result is written once
        path = f"{stats}-batch"
        agreement.statistics(rows, history).write.mode("overwrite").parquet(path)
        upsert(rows.sparkSession.read.parquet(path), stats, number)

    return stats, each_batch(recent, "agreement", batch, every=every)


def latest_statistics(spark, path: str) -> DataFrame:
    """The newest statistics of each session."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    newest = max(_versions(folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder))
    return spark.read.parquet(f"{path}/v{newest}")


def split_rejects(stream: DataFrame, name: str, delay_ms: int, bad: Column):
    """Separate a stream of (ts, ...) rows into accepted rows and rejects with a `reason`: no time, bad value, or late (behind the newest
    time of the batches before, less the delay). Returns (table, counts, query).

    The table is partitioned by batch and reason (or `accepted`), written in one pass; the counts of a batch are observed on that pass and
    kept beside it. Both replace themselves when a batch is repeated, and the watermark is taken from the kept counts, so a restart goes on
    with the right one.
    """
    spark = stream.sparkSession
    out = scratch(spark, name)
    counts = f"{out}-counts"
    schema = "batch long, rows long, late long, bad long, untimed long, newest_ms long"
    seen: dict[int, int | None] = {}

    def batch(rows: DataFrame, number: int) -> None:
        newest = max((v for b, v in seen.items() if b < number and v is not None), default=None)
        ms = F.unix_millis("ts")
        late = F.lit(False) if newest is None else ms < newest - delay_ms
        reason = F.when(F.col("ts").isNull(), "untimed").when(bad, "bad").when(late, "late").otherwise("accepted")
        seen_now = Observation(f"rejects-{number}")
        one = lambda r: F.count_if(F.col("reason") == r).alias(r)
        marked = rows.withColumn("reason", reason).observe(seen_now, F.count(F.lit(1)).alias("rows"), one("late"), one("bad"), one("untimed"), F.max(ms).alias("newest_ms"))
        marked.write.mode("overwrite").partitionBy("reason").parquet(f"{out}/batch={number}")
        got = seen_now.get
        seen[number] = got["newest_ms"]
        line = (number, got["rows"], got["late"], got["bad"], got["untimed"], got["newest_ms"])
        spark.createDataFrame([line], schema).coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")

    query = each_batch(stream, name, batch)
    table = spark.read.option("basePath", out).schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch long, reason string").parquet(out)
    return table, spark.read.schema(schema).parquet(counts), query
