"""Keyed folds over a stream in event-time order, whatever batches the rows arrive in.

Rows wait in a list state until the watermark has passed them; an event-time timer then releases all that are due, in order, through the fold. A
last timer, `idle_ms` after the newest row, ends the state of the session, so nothing is kept for sessions that are over. What waits is
bounded by the rows of the delay; the fold keeps a few numbers. The rows that a session gets at once are one entry of its state, as each entry
costs a conversion and a write of its own.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PACKED = "rows binary"
CLOSE = datetime(9999, 1, 1)  # the time of the row that ends a stream (see jobs.drain)
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a batch commits what it changed instead of a snapshot
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# without the number of entries, which costs a look-up for each write
UNCOUNTED = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}


def timed(frames: DataFrame, delay: str) -> DataFrame:
    """The rows with a watermark; the row that ends the stream moves it and goes no further."""
    return frames.withWatermark("ts", delay).where(F.col("ts") < F.lit(CLOSE).cast("timestamp"))


def packed(rows: list[tuple]) -> tuple:
    return (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),)


def unpacked(state) -> list[tuple]:
    """The rows of all entries of a list state."""
    return [r for entry in (state.get() if state.exists() else ()) for r in pickle.loads(entry[0])]


def names_of(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class InOrder(StatefulProcessor):
    """`step(state, row) -> (state, output values or None)` over the rows of a key in the order of `order`, then of the row itself.

    `state` is a tuple or None (at first, and after the session was idle)."""

    def __init__(self, columns: list[str], state: str, out: str, order: list[str], step: Callable, idle_ms: int):
        self.result = Row("session_id", *names_of(out))
        self.columns, self.kept, self.order, self.step, self.idle_ms = columns, state, order, step, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PACKED)
        self.state = handle.getValueState("state", f"{self.kept}, newest_ms long")
        self.places = [self.columns.index(c) for c in self.order]
        self.at = self.columns.index("at_ms")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in self.columns) for r in rows]
        if new:
            self.waiting.appendValue(packed(new))
            self.handle.registerTimer(min(r[self.at] for r in new) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = unpacked(self.waiting)
        due = [r for r in rows if r[self.at] < now]
        rest = [r for r in rows if r[self.at] >= now]
        state = tuple(self.state.get()) if self.state.exists() else None
        newest = state[-1] if state else None
        fold = None if state is None or all(v is None for v in state[:-1]) else state[:-1]
        out = []
        for r in sorted(due, key=lambda r: tuple((r[p] is not None, r[p]) for p in self.places)):
            if newest is not None and r[self.at] > newest + self.idle_ms:
                fold = None
            fold, values = self.step(fold, r)
            newest = r[self.at] if newest is None else max(newest, r[self.at])
            if values is not None:
                out.append(self.result(*key, *values))
        if due:
            self.waiting.put([packed(rest)]) if rest else self.waiting.clear()
            self.state.update((*(fold if fold is not None else self._blank()), newest))
        if rest:
            self.handle.registerTimer(min(r[self.at] for r in rest) + 1)
        elif newest is not None:
            end = newest + self.idle_ms + 1
            if end <= now:
                self.state.clear()
            else:
                self.handle.registerTimer(end)
        return iter(out)

    def _blank(self) -> tuple:
        return (None,) * len(names_of(self.kept))

    def close(self) -> None:
        pass


def in_order(frames: DataFrame, columns: list[str], state: str, out: str, order: list[str], step: Callable, idle_ms: float, delay: str) -> DataFrame:
    """Fold the sessions of `frames` (session_id, ts, ...); `columns` are those that `step` sees. Their order is
    that of the rows handed to `step`, with the event time in milliseconds (`at_ms`) at the end."""
    names = [*columns, "at_ms"]
    rows = timed(frames, delay).select("session_id", "ts", *columns, F.unix_millis("ts").alias("at_ms"))
    fold = InOrder(names, state, out, order, step, int(min(idle_ms, 1e14)))
    return rows.groupBy("session_id").transformWithState(fold, f"session_id long, {out}", "append", "eventtime")


class Recent(StatefulProcessor):
    """The newest `keep` rows of a session, and for each column in `also` the newest `keep` rows with a value; all of them are given out
    whenever rows arrive."""

    def __init__(self, columns: list[str], order: list[str], keep: int, also: list[str]):
        self.columns, self.keep = columns, keep
        self.places = [columns.index(c) for c in order]
        self.also = [columns.index(c) for c in also]
        self.result = Row(*columns)

    def init(self, handle) -> None:
        self.known = handle.getListState("known", PACKED)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = unpacked(self.known)
        known += [tuple(r[c] for c in self.columns) for r in rows]
        known.sort(key=lambda r: tuple((r[p] is not None, r[p]) for p in self.places))
        wanted = set(range(len(known))[-self.keep :])
        for c in self.also:
            wanted.update([i for i, r in enumerate(known) if r[c] is not None][-self.keep :])
        known = [known[i] for i in sorted(wanted)]
        self.known.put([packed(known)])
        return iter([self.result(*r) for r in known])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def recent_rows(rows: DataFrame, order: list[str], keep: int, also: list[str]) -> DataFrame:
    """After each batch, the newest `keep` rows of the sessions it touched, and for each column in `also` the newest `keep` rows with a value. The
    state is that short list itself."""
    ring = Recent(rows.columns, order, keep, also)
    return rows.groupBy("session_id").transformWithState(ring, rows.schema, "append", "none")


# ---- the recording protocol


class Phases(StatefulProcessor):
    """A recording per session: BASELINE from its first frame, then STIMULUS, CONSTRICTION_RECOVERY and, at the end, PROCESSING and COMPLETE (without any
    valid frame FAILED_INCONCLUSIVE). Each phase starts by a timer that the phase before it has set. Frames may come in any order within the delay; what comes after
    the end belongs to no recording until the session has been idle."""

    def __init__(self, marks: list[tuple[str, float]], idle_ms: int):
        self.marks, self.idle_ms = marks, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", "at_ms long, valid boolean")
        self.phase = handle.getValueState("phase", "start_ms long, next int, newest_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at_ms"], r["valid"]) for r in rows]
        start, step, newest = self.phase.get() if self.phase.exists() else (None, 0, None)
        newest = max([r[0] for r in new] + ([] if newest is None else [newest]))
        if step < len(self.marks):  # the recording is not over
            self.frames.appendList(new)
            if step == 0:
                start = min([r[0] for r in new] + ([] if start is None else [start]))
                self.handle.registerTimer(start + 1)
        self.phase.update((start, step, newest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.phase.exists():
            return iter(())
        now = timerValues.getCurrentWatermarkInMs()
        start, step, newest = self.phase.get()
        out = []
        while step < len(self.marks) and now > start + self.marks[step][1]:
            name, after = self.marks[step]
            frames = [tuple(f) for f in self.frames.get() if f[0] < start + after]
            valid = sum(1 for _, v in frames if v)
            if name == "COMPLETE" and not valid:
                name = "FAILED_INCONCLUSIVE"
            out.append(Row(session_id=key[0], phase=name, at_ms=int(start + after), frames=len(frames), valid=valid))
            step += 1
        if step < len(self.marks):
            self.handle.registerTimer(int(start + self.marks[step][1]) + 1)
            self.phase.update((start, step, newest))
            return iter(out)
        if self.frames.exists():
            self.frames.clear()
        end = max(newest, start + self.marks[-1][1]) + self.idle_ms
        if now > end:
            self.phase.clear()
        else:
            self.phase.update((start, step, newest))
            self.handle.registerTimer(int(end) + 1)
        return iter(out)

    def close(self) -> None:
        pass


def recording_phases(frames: DataFrame, baseline_ms: float, stimulus_ms: float, recovery_ms: float, idle_ms: float, delay: str) -> DataFrame:
    """(session_id, phase, at_ms, frames, valid): when each phase of a recording starts and what was recorded before. The recording
    closes `stimulus_ms + recovery_ms` after the onset of the stimulus."""
    onset = baseline_ms
    end = onset + stimulus_ms + recovery_ms
    marks = [("BASELINE", 0.0), ("STIMULUS", onset), ("CONSTRICTION_RECOVERY", onset + stimulus_ms), ("PROCESSING", end), ("COMPLETE", end)]
    rows = timed(frames, delay).select("session_id", "ts", F.unix_millis("ts").alias("at_ms"), F.col("px").isNotNull().alias("valid"))
    machine = Phases([(n, math.floor(v)) for n, v in marks], int(idle_ms))
    return rows.groupBy("session_id").transformWithState(machine, "session_id long, phase string, at_ms long, frames long, valid long", "append", "eventtime")
