"""Operators on the live frame stream, in batch form: stability, stabiliser, throttling, rolling statistics."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LiveSettings
from ..functions.numeric import half_up
from .components import written
from .ordered import HALO, Layout
from .pointers import spaced


def stability(df: DataFrame, layout: Layout, cfg: LiveSettings = LiveSettings()) -> DataFrame:
    """Baseline state per frame: IDLE, COLLECTING_RAW_BASELINE or BASELINE_STABLE.

    The window holds the last `stability_window` valid frames; more than `drops_tolerated` lost
    frames in a row empty it. Valid frames of one window therefore lie close together, so a
    bounded row frame holds them all.
    """
    reset_after = cfg.drops_tolerated + 1
    reach = (cfg.stability_window - 1) * reset_after
    valid = F.col("valid")
    w = layout.window()
    framed = layout.extend(df, cfg.drops_tolerated, 0)
    recent = w.rowsBetween(-cfg.drops_tolerated, 0)
    lost = (F.sum(valid.cast("int")).over(recent) == 0) & (F.count(F.lit(1)).over(recent) == reset_after)
    rows = layout.prefix(layout.trim(framed.withColumn("_reset", lost)), {"_island": ("sum", F.col("_reset").cast("long"))})
    item = F.when(valid, F.struct(F.col("_island").alias("i"), F.col("left_px").alias("l"), F.col("right_px").alias("r")))
    framed = layout.extend(rows, reach, 0).withColumn("_seen", F.collect_list(item).over(w.rowsBetween(-reach, 0)))
    rows = layout.trim(framed)
    same = F.filter("_seen", lambda x: x["i"] == F.col("_island"))
    rows = rows.withColumn("_win", F.slice(same, F.greatest(F.size(same) - cfg.stability_window + 1, F.lit(1)), cfg.stability_window))
    spread = lambda f: F.array_max(F.transform("_win", lambda x: x[f])) - F.array_min(F.transform("_win", lambda x: x[f]))
    full = F.size("_win") >= cfg.stability_window
    rows = rows.withColumn("window_count", F.when(F.size(same) > 0, F.size("_win")).otherwise(F.lit(0)))
    stable = full & (spread("l") <= cfg.stability_tolerance_px) & (spread("r") <= cfg.stability_tolerance_px)
    state = F.when(stable, "BASELINE_STABLE").when(F.col("window_count") > 0, "COLLECTING_RAW_BASELINE").otherwise("IDLE")
    return rows.select(
        *df.columns, "window_count", F.when(full, half_up(spread("l"), 2)).otherwise(F.lit(0.0)).alias("left_delta"),
        F.when(full, half_up(spread("r"), 2)).otherwise(F.lit(0.0)).alias("right_delta"), state.alias("state"),
    )


def lost_runs(df: DataFrame, layout: Layout, cfg: LiveSettings = LiveSettings()) -> DataFrame:
    """Length of the current loss run and its status."""
    rows = layout.number(df, "_pos")
    rows = layout.nearest(rows, {"_last": (F.when(F.col("valid"), F.col("_pos")), True)}, inclusive=True)
    run = F.col("_pos") - F.coalesce(F.col("_last"), F.lit(0))
    status = F.when(run == 0, "DETECTED").when(run <= cfg.drops_tolerated, "UNCERTAIN").otherwise("LOST")
    return rows.select(*df.columns, run.alias("lost_run"), status.alias("track_status"))


def rolling_stats(df: DataFrame, layout: Layout, value: str, cfg: LiveSettings = LiveSettings()) -> DataFrame:
    """Statistics of the last `stats_window` valid values; null below `stats_min` values.

    A frame without a valid value keeps a row, with the statistics as they stood before it.
    """
    size = cfg.stats_window
    held = F.coalesce(F.col(value) > 0, F.lit(False))
    rows = layout.extend(df.where(held), size - 1, 0)
    w = layout.window().rowsBetween(-(size - 1), 0)
    rows = rows.select(
        "*", F.count(value).over(w).alias("_n"), F.min(value).over(w).alias("_min"), F.max(value).over(w).alias("_max"),
        F.avg(value).over(w).alias("_avg"), F.stddev_pop(value).over(w).alias("_std"), F.sort_array(F.collect_list(value).over(w)).alias("_all"),
    )
    rows = layout.trim(rows)
    n = F.col("_n")
    at = lambda k: F.element_at("_all", k.cast("int"))
    median = F.when(n % 2 == 0, (at(F.floor(n / 2)) + at(F.floor(n / 2) + 1)) / 2).otherwise(at(F.floor(n / 2) + 1))
    cv = F.when(F.col("_avg") > 0, F.col("_std") / F.col("_avg") * 100).otherwise(F.lit(0.0))
    figures = {
        "sample_count": n, "min_px": F.col("_min"), "max_px": F.col("_max"), "mean_px": F.col("_avg"), "median_px": median, "range_px": F.col("_max") - F.col("_min"),
        "std_px": F.col("_std"), "cv_percent": cv,
    }
    stats = F.when(n >= cfg.stats_min, F.struct(*[c.alias(name) for name, c in figures.items()]))
    seen = rows.select(*df.columns, stats.alias("_stats"))
    lost = df.where(~held).withColumn("_stats", F.lit(None).cast(seen.schema["_stats"].dataType))
    every = layout.nearest(seen.unionByName(lost), {"_last": (F.col("_stats"), True)}, inclusive=True)
    return every.select(*df.columns, *[F.col(f"_last.{name}").alias(name) for name in figures])


def rolling_mean(df: DataFrame, layout: Layout, value: str, size: int, out: str) -> DataFrame:
    """Mean of the last `size` rows."""
    rows = layout.extend(df, size - 1, 0)
    return layout.trim(rows.withColumn(out, F.avg(value).over(layout.window().rowsBetween(-(size - 1), 0))))


def drop_repeats(df: DataFrame, layout: Layout, value: str) -> DataFrame:
    """Drop rows whose value equals that of the row before."""
    rows = layout.extend(df, 1, 0)
    rows = layout.trim(rows.withColumn("_last", F.lag(value).over(layout.window())))
    return rows.where(F.col("_last").isNull() | (F.col("_last") != F.col(value))).drop("_last")


def raw_jumps(df: DataFrame, layout: Layout, cfg: LiveSettings = LiveSettings()) -> DataFrame:
    """Flag steps of the normalised centre (x, y) above `max_jump`; the stabiliser tests against its own smoothed centre instead."""
    w = layout.window()
    rows = layout.extend(df, 1, 0)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    return layout.trim(rows.withColumn("is_jump", F.coalesce(F.sqrt(dx * dx + dy * dy) > cfg.max_jump, F.lit(False))))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Newest n rows per key; Spark limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def increasing(df: DataFrame, layout: Layout, value: str, out: str) -> DataFrame:
    """Whole-millisecond times made strictly increasing: a late one becomes the last one plus 1."""
    rows = layout.number(df, "_pos")
    rows = layout.prefix(rows, {"_lead": ("max", F.col(value) - F.col("_pos"))})
    return rows.withColumn(out, F.col("_lead") + F.col("_pos")).drop("_pos", "_lead")


# ---- folds ------------------------------------------------------------------------------------------
# A fold runs over sorted rows and keeps only the last state, so it needs no group in memory.
# For calm keys the rows are partitioned by segment; segments are cut wherever the fold restarts anyway.
# For hot keys every chunk is folded on its own: it starts from a guess, made by folding some rows before
# the chunk, and the guess is then checked against the end of the chunk before. Chunks with a wrong guess
# are folded again from the right state until none is left, so the result is that of one long fold.


def _fold(df: DataFrame, segment: list[str], order: list[str], step, added: T.StructType) -> DataFrame:
    names = df.columns
    schema = T.StructType([*df.schema.fields, *added.fields])
    new = [f.name for f in added.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            made = []
            for row in zip(*[pdf[c].tolist() for c in names]):
                row = dict(zip(names, row))
                k = tuple(row[c] for c in segment)
                if k != key:
                    key, state = k, None
                state, values = step(state, row)
                made.append(values)
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(made, columns=new)], axis=1)

    return df.repartition(*segment).sortWithinPartitions(*segment, *order).mapInPandas(run, schema)


def _fold_chunks(df: DataFrame, layout: Layout, restart: str, step, added: T.StructType, warm_up: int) -> DataFrame:
    """The fold of each key over its chunks; a change of the `restart` column clears the state."""
    parts = layout.parts
    rows = written(layout.extend(df, warm_up, 0), "fold")
    names = [*rows.columns, "_given"]
    states = [T.StructField("_start", T.StringType()), T.StructField("_end", T.StringType())]
    schema = T.StructType([*rows.schema.fields, T.StructField("_given", T.StringType()), *added.fields, *states])
    blank = tuple(None for _ in added.fields)
    new = [f.name for f in [*added.fields, *states]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, begun = None, (None, None), False
        for pdf in batches:
            made = []
            for row in zip(*[pdf[c].tolist() for c in names]):
                row = dict(zip(names, row))
                k = tuple(row[c] for c in parts)
                if k != key:
                    key, state, begun = k, (None, None), False
                start = None
                if not row[HALO] and not begun:
                    begun = True
                    if isinstance(row["_given"], str):
                        state = json.loads(row["_given"])
                    start = json.dumps(state)
                if row[HALO] and begun:
                    made.append((*blank, None, None))
                    continue
                segment, inner = state
                inner, values = step(inner if row[restart] == segment else None, row)
                state = (row[restart], inner)
                made.append((*(blank if row[HALO] else values), start, None if row[HALO] else json.dumps(state)))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(made, columns=new).astype({"_start": object, "_end": object})], axis=1)

    # a round folds only the chunks whose start turned out wrong; of each chunk the newest round counts
    rounds, latest, given = [], None, None
    while True:
        now = rows.withColumn("_given", F.lit(None).cast("string")) if given is None else rows.join(given, parts)
        folded = now.repartition(*parts).sortWithinPartitions(*parts, *layout.order).mapInPandas(run, schema)
        done = written(folded.where(~F.col(HALO)).drop(HALO, "_given").withColumn("_round", F.lit(len(rounds))), "folded")
        rounds.append(done)
        ends = done.groupBy(*parts).agg(F.max("_start").alias("_start"), F.max_by("_end", F.struct(*layout.order)).alias("_end"), F.max("_round").alias("_round"))
        latest = written(ends if latest is None else latest.join(given, parts, "left_anti").unionByName(ends), "ends")
        before = F.lag("_end").over(Window.partitionBy(*layout.keys).orderBy(layout.chunk))
        wrong = written(latest.select(*parts, before.alias("_given"), "_start").where("_given <> _start").drop("_start"), "starts")
        if wrong.isEmpty():
            break
        given = wrong
    if len(rounds) == 1:
        return done.drop("_start", "_end", "_round")
    every = reduce(DataFrame.unionByName, rounds).drop("_start", "_end")
    return every.join(latest.select(*parts, "_round"), [*parts, "_round"], "left_semi").drop("_round")


def _fold_series(df: DataFrame, layout: Layout, restart: str, step, added: T.StructType, warm_up: int = 64) -> DataFrame:
    if layout.chunk:
        return _fold_chunks(df, layout, restart, step, added, warm_up)
    return _fold(df, [*layout.keys, restart], list(layout.order), step, added)


def throttle(df: DataFrame, layout: Layout, time: str, interval_ms: float) -> DataFrame:
    """Keep a row when at least `interval_ms` have passed since the last kept row."""
    return spaced(df, layout, time, interval_ms)


STABILISED = T.StructType(
    [
        T.StructField("smooth_px", T.DoubleType()), T.StructField("smooth_x", T.DoubleType()), T.StructField("smooth_y", T.DoubleType()),
        T.StructField("smooth_mm", T.DoubleType()), T.StructField("is_jump", T.BooleanType()),
    ]
)


def ema_step(state, px: float, x: float, y: float, mm: float | None, cfg: LiveSettings = LiveSettings()):
    """One step of the stabiliser; state is (radius, x, y, mm) or None after a loss."""
    mm = None if mm is None or mm != mm else mm
    if state is None:
        return (px / 2, x, y, mm), (px, x, y, mm, False)
    radius, px0, py0, mm0 = state
    jump = math.sqrt((x - px0) * (x - px0) + (y - py0) * (y - py0)) > cfg.max_jump
    a = cfg.jump_alpha if jump else cfg.alpha
    b = 1 - a
    radius = a * (px / 2) + b * radius
    x, y = a * x + b * px0, a * y + b * py0
    if mm is not None and mm0:
        mm = math.floor((a * mm + b * mm0) * 100.0 + 0.5) / 100.0
    return (radius, x, y, mm), (radius * 2, x, y, mm, jump)


def stabilise(df: DataFrame, layout: Layout, cfg: LiveSettings = LiveSettings(), warm_up: int = 64) -> DataFrame:
    """Exponential smoothing of (px, x, y, mm); a loss yields nulls and restarts the smoothing."""
    rows = lost_runs(df.withColumn("valid", F.coalesce(F.col("px") > 0, F.lit(False))), layout, cfg)
    rows = layout.prefix(rows, {"_run": ("sum", (~F.col("valid")).cast("long"))})

    def step(state, row):
        return ema_step(state, row["px"], row["x"], row["y"], row["mm"], cfg)

    seen = _fold_series(rows.where("valid"), layout, "_run", step, STABILISED, warm_up)
    gone = rows.where("not valid").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in STABILISED.fields])
    return seen.unionByName(gone).drop("_run", "valid", "lost_run")
