"""Running streaming queries: file sources, sinks and progress figures."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..schemas import EVENT
from ..session import scratch
from .ordered import CLOSE, STORE, UNCOUNTED


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int = 8) -> DataFrame:
    """Stream of the event files in a folder; the number of files per batch bounds its size."""
    return spark.readStream.schema(EVENT).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", str(files_per_batch)).parquet(folder)


class Ending:
    """A source that can be closed: its last row, sent when everything else was read, lies at the end of time and lets every window and timer run out."""

    def __init__(self, source: DataFrame):
        self.spark, self.schema = source.sparkSession, source.schema
        self.folder = scratch(self.spark, "ending")
        self._row().where("false").write.parquet(self.folder)
        self.stream = source.unionByName(self.spark.readStream.schema(self.schema).parquet(self.folder))

    def _row(self) -> DataFrame:
        return self.spark.range(1).select(*[F.lit(CLOSE if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in self.schema])

    def close(self) -> None:
        self._row().coalesce(1).write.mode("append").parquet(self.folder)


@contextmanager
def _state_store(spark: SparkSession, counted: bool):
    """Timers and list states need the RocksDB store; a query takes the settings over when it starts. Streams that are closed count the entries
    left (`counted`), as their end is to leave none."""
    settings = STORE if counted else STORE | UNCOUNTED
    given = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in given.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def drain(stream: DataFrame, name: str, mode: str = "append", ending: Ending | None = None):
    """Process everything available into a Parquet table in the shared folder; with `ending`, close the stream after that, so that
    nothing stays open. Returns (table, query)."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-log").option("path", out)
    query = _run(writer, spark, ending)
    return spark.read.schema(stream.schema).parquet(out), query


def each_batch(stream: DataFrame, name: str, fn: Callable[[DataFrame, int], None], ending: Ending | None = None, every: str | None = None, mode: str = "append"):
    """Process everything available through `fn(batch, batch_id)`, which must be safe to repeat; with `every`, go on at that interval until stopped."""
    log = scratch(stream.sparkSession, f"{name}-log")
    writer = stream.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", log)
    if every is not None:
        with _state_store(stream.sparkSession, ending is not None):
            return writer.trigger(processingTime=every).start()
    return _run(writer, stream.sparkSession, ending)


def _run(writer, spark: SparkSession, ending: Ending | None):
    with _state_store(spark, ending is not None):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        if ending is not None:
            ending.close()
            query = writer.trigger(availableNow=True).start()
            query.awaitTermination()
    return query


def live(stream: DataFrame, name: str, path: str, mode: str = "append", every: str = "1 second"):
    """Start a continuous query into a Parquet table; the caller stops it."""
    return (
        stream.writeStream.queryName(name).format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-log").option("path", path).trigger(processingTime=every).start()
    )


class LateRows(StreamingQueryListener):
    """Counts rows that arrived behind the watermark, batch by batch as they end; unlike the recent progress it forgets none."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.rows.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.batches[run] = self.batches.get(run, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query, wait_s: float = 10.0) -> int:
        """Rows dropped by a query so far; for an ended one after its last event has come in."""
        end = time.monotonic() + wait_s
        while not query.isActive and str(query.runId) not in self.ended and time.monotonic() < end:
            time.sleep(0.05)
        return self.rows.get(str(query.runId), 0)


def count_late_rows(spark: SparkSession) -> LateRows:
    """Start counting for all queries of the session that start from now on. `spark.streams.removeListener` ends it."""
    listener = LateRows()
    spark.streams.addListener(listener)
    return listener


def late_rows(query) -> int:
    """Rows dropped behind the watermark in the batches that Spark still keeps (the newest 100 by default); see `count_late_rows`."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])
