"""Streaming operators on frame streams: (session_id, ts, frame_ts_ms, ...).

Windows, joins and duplicate removal are Spark's own. The folds (throttle, stabiliser, baseline
state) keep a few numbers per session and see its frames in event-time order across batches (`ordered`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import LiveSettings
from ..operators.live import ema_step
from .ordered import in_order, recent_rows, timed

DELAY = "10 seconds"
FOREVER_MS = 1e13  # longer than any recording; state then ends with the stream


def frames_per_second(frames: DataFrame, size: str = "1 second", delay: str = DELAY) -> DataFrame:
    """Frames per session and tumbling window, once the window is closed."""
    g = timed(frames, delay).groupBy("session_id", F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("frames"))
    return g.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def rolling_activity(frames: DataFrame, size: str, slide: str, delay: str = DELAY) -> DataFrame:
    """Frames per sliding window over all sessions."""
    g = timed(frames, delay).groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("frames"), F.count("px").alias("valid"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames", "valid")


def closed_sessions(frames: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    """Stretches of activity per session, closed after a gap in event time."""
    g = timed(frames, delay).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("frames"))
    return g.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def distinct_frames(frames: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """First arrival of each frame; a repeat within the delay is dropped."""
    return timed(frames, delay).dropDuplicatesWithinWatermark(keys)


def matched(a: DataFrame, b: DataFrame, delay: str = DELAY) -> DataFrame:
    """Rows of two methods with the same session and frame time (stale ones find no partner)."""
    left, right = timed(a, delay), b.withWatermark("ts_b", delay).withColumnRenamed("session_id", "_sid")
    late = F.expr(f"INTERVAL {delay}")
    near = F.col("ts_b").between(F.col("ts") - late, F.col("ts") + late)
    return left.join(right, (F.col("session_id") == F.col("_sid")) & (F.col("frame_ts_ms") == F.col("frame_ts_ms_b")) & near).drop("_sid")


def throttled(frames: DataFrame, interval_ms: float = LiveSettings.sampling_ms, delay: str = DELAY) -> DataFrame:
    """Valid frames at least `interval_ms` apart per session. A session's state ends when a frame would be kept anyway."""

    def step(state, row):
        t, sample, px, _ = row
        if px is None or (state is not None and t - state[0] < interval_ms):
            return state, None
        return (t,), (sample, t, px)

    columns = ["frame_ts_ms", "sample_id", "px"]
    return in_order(frames, columns, "last double", "sample_id long, frame_ts_ms double, px double", ["frame_ts_ms", "sample_id"], step, interval_ms, delay)


def stabilised(frames: DataFrame, cfg: LiveSettings = LiveSettings(), idle_ms: float = FOREVER_MS, delay: str = DELAY) -> DataFrame:
    """Exponential smoothing with restart after a loss, and after `idle_ms` without a frame; the state is the last smoothed point and the loss count."""

    def step(state, row):
        t, sample, px, cx, cy, m, _ = row
        radius, x, y, mm, lost = state or (None, None, None, None, 0)
        if px is None or px <= 0:
            lost += 1
            status = "UNCERTAIN" if lost <= cfg.drops_tolerated else "LOST"
            return (None, None, None, None, lost), (sample, t, status, None, None, None, None)
        point, (a, b, c, d, _) = ema_step(None if radius is None else (radius, x, y, mm), px, cx, cy, m, cfg)
        return (*point, 0), (sample, t, "DETECTED", a, b, c, d)

    columns = ["frame_ts_ms", "sample_id", "px", "x", "y", "mm"]
    out = "sample_id long, frame_ts_ms double, track_status string, smooth_px double, smooth_x double, smooth_y double, smooth_mm double"
    return in_order(frames, columns, "radius double, x double, y double, mm double, lost long", out, ["frame_ts_ms", "sample_id"], step, idle_ms, delay)


def baseline_states(frames: DataFrame, cfg: LiveSettings = LiveSettings(), idle_ms: float = FOREVER_MS, delay: str = DELAY) -> DataFrame:
    """IDLE / COLLECTING_RAW_BASELINE / BASELINE_STABLE per frame; the state is the short window and the loss count. A frame whose
    `active` is false (an optional column) empties the window, as do `idle_ms` without a frame."""

    def spread(v: list[float]) -> float:
        return max(v) - min(v)

    def step(state, row):
        _, sample, lv, rv, active, _ = row
        left, right, drops = state or ((), (), 0)
        left, right = list(left), list(right)
        if active is False:
            return ([], [], drops), (sample, 0, "IDLE")
        if lv is not None and rv is not None and lv > 0 and rv > 0:
            drops = 0
            left, right = [*left, lv][-cfg.stability_window :], [*right, rv][-cfg.stability_window :]
        else:
            drops += 1
            if drops > cfg.drops_tolerated:
                left, right = [], []
        full = len(left) >= cfg.stability_window
        stable = full and spread(left) <= cfg.stability_tolerance_px and spread(right) <= cfg.stability_tolerance_px
        label = "BASELINE_STABLE" if stable else "COLLECTING_RAW_BASELINE" if left else "IDLE"
        return (left, right, drops), (sample, len(left), label)

    if "active" not in frames.columns:
        frames = frames.withColumn("active", F.lit(True))
    columns = ["frame_ts_ms", "sample_id", "left_px", "right_px", "active"]
    out = "sample_id long, window_count int, state string"
    return in_order(frames, columns, "left array<double>, right array<double>, drops long", out, ["frame_ts_ms", "sample_id"], step, idle_ms, delay)


def finished_recordings(frames: DataFrame, length_ms: float, delay: str = DELAY) -> DataFrame:
    """(session_id, first and last ts, frames) of each recording, once event time is past its end."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "first_ms": [first], "last_ms": [last], "frames": [n]})
            return
        first, last, n = state.get if state.exists else (float("inf"), float("-inf"), 0)
        for pdf in batches:
            ms = pdf["ms"]
            first, last, n = min(first, float(ms.min())), max(last, float(ms.max())), n + len(pdf)
        state.update((first, last, n))
        state.setTimeoutTimestamp(max(int(first + length_ms), state.getCurrentWatermarkMs() + 1))

    rows = timed(frames, delay).select("session_id", "ts", (F.unix_micros("ts") / 1000).alias("ms"))
    return rows.groupBy("session_id").applyInPandasWithState(
        fold, "session_id long, first_ms double, last_ms double, frames long", "first double, last double, n long", "append", GroupStateTimeout.EventTimeTimeout
    )
