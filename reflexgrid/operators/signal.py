"""Series cleaning: gap repair, smoothing and numerical derivatives, as window functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RepairSettings
from ..functions.samples import is_usable
from .ordered import Layout

# Savitzky-Golay weights (5 and 7 points) and their divisors.
SG5 = (-3.0, 12.0, 17.0, 12.0, -3.0)
SG7 = (-2.0, 3.0, 6.0, 7.0, 6.0, 3.0, -2.0)
SG5_NORM = 35.0
SG7_NORM = 21.0
# Gaussian taps with sigma 1 at distance 0, 1, 2.
EDGE_TAPS = (1.0, math.exp(-0.5), math.exp(-2.0))
# Fixed value: shortest time step in seconds that still gives a slope.
MIN_STEP_S = 0.0001


def eyes_long(samples: DataFrame) -> DataFrame:
    """One row per frame and eye: (session_id, eye, time_ms, sample_id, raw_mm, confidence)."""
    both = F.array(
        F.struct(F.lit("L").alias("eye"), F.col("left_mm").alias("raw_mm")),
        F.struct(F.lit("R").alias("eye"), F.col("right_mm").alias("raw_mm")),
    )
    return samples.select("session_id", "sample_id", "time_ms", "confidence", F.explode(both).alias("e")).select(
        "session_id", "e.eye", "time_ms", "sample_id", "e.raw_mm", "confidence"
    )


def repair_gaps(df: DataFrame, layout: Layout, cfg: RepairSettings = RepairSettings()) -> DataFrame:
    """Keep valid points, fill short gaps, drop the rest.

    Inner gaps up to `max_gap_ms` are filled linearly; a gap at either end of the series repeats
    the nearest value for up to `edge_ms`.
    """
    ok = is_usable(F.col("raw_mm"), F.col("confidence"), cfg)
    point = F.when(ok, F.struct(F.col("time_ms").alias("t"), F.col("raw_mm").alias("v"), F.col("confidence").alias("c")))
    near = layout.nearest(df.withColumn("_ok", ok), {"_p": (point, True), "_n": (point, False)})
    t, has_p, has_n = F.col("time_ms"), F.col("_p").isNotNull(), F.col("_n").isNotNull()
    span = F.col("_n.t") - F.col("_p.t")
    share = (t - F.col("_p.t")) / F.nullif(span, F.lit(0.0))
    inner = ~F.col("_ok") & has_p & has_n & (span <= cfg.max_gap_ms)
    tail = ~F.col("_ok") & has_p & ~has_n & (t - F.col("_p.t") <= cfg.edge_ms)
    head = ~F.col("_ok") & ~has_p & has_n & (F.col("_n.t") - t <= cfg.edge_ms)
    value = (
        F.when(F.col("_ok"), F.col("raw_mm"))
        .when(inner, F.col("_p.v") + share * (F.col("_n.v") - F.col("_p.v")))
        .when(tail, F.col("_p.v"))
        .when(head, F.col("_n.v"))
    )
    confidence = (
        F.when(F.col("_ok"), F.col("confidence"))
        .when(inner, F.greatest(F.lit(cfg.inner_floor), F.least("_p.c", "_n.c") * F.lit(cfg.inner_factor)))
        .when(tail, F.col("_p.c") * F.lit(cfg.edge_factor))
        .when(head, F.col("_n.c") * F.lit(cfg.edge_factor))
    )
    names = [c for c in df.columns if c not in ("raw_mm", "confidence")]
    return near.where(F.col("_ok") | inner | tail | head).select(
        *names, value.alias("raw_mm"), confidence.alias("confidence"), (~F.col("_ok")).alias("is_interpolated")
    )


def smooth(df: DataFrame, layout: Layout, value: str = "raw_mm", out: str = "clean_mm", size: int = 5) -> DataFrame:
    """Savitzky-Golay inside, Gaussian at the two ends, short weights below five points."""
    if size not in (5, 7):
        raise ValueError("size must be 5 or 7")
    framed = layout.extend(df, 6, 6)
    w = layout.window()
    v = {k: (F.lag(value, -k) if k < 0 else F.lead(value, k)).over(w) if k else F.col(value) for k in range(-3, 4)}
    framed = framed.select("*", *[c.alias(f"_v{k + 3}") for k, c in v.items()], F.count(F.lit(1)).over(w.rowsBetween(-6, 6)).alias("_count"))
    v = {k: F.col(f"_v{k + 3}") for k in range(-3, 4)}

    def weighted(weights: tuple[float, ...], norm: float) -> Column:
        half = len(weights) // 2
        acc = v[-half] * F.lit(weights[0])
        for k in range(1 - half, half + 1):
            acc = acc + v[k] * F.lit(weights[k + half])
        return acc / F.lit(norm)

    def tapped(parts: list[tuple[int, float]]) -> Column:
        zero = F.lit(0.0)
        top, bottom = zero, zero
        for k, weight in parts:
            top = top + F.coalesce(v[k] * F.lit(weight), zero)
            bottom = bottom + F.when(v[k].isNotNull(), F.lit(weight)).otherwise(zero)
        return top / bottom

    n = F.col("_count")
    edge = tapped([(k, EDGE_TAPS[abs(k)]) for k in range(-2, 3)])
    short = tapped([(-1, 1.0), (0, 2.0), (1, 1.0)])
    in5 = v[-2].isNotNull() & v[2].isNotNull()
    five = F.when(in5, weighted(SG5, SG5_NORM)).otherwise(edge)
    clean = F.when(n < 3, v[0]).when(n < 5, short)
    if size == 7:
        in7 = v[-3].isNotNull() & v[3].isNotNull()
        clean = clean.when(n < 7, five).when(in7, weighted(SG7, SG7_NORM)).otherwise(edge)
    else:
        clean = clean.otherwise(five)
    done = framed.withColumn(out, clean).drop(*[f"_v{k}" for k in range(7)], "_count")
    return layout.trim(done)


def differentiate(df: DataFrame, layout: Layout, value: str = "clean_mm", out: str = "velocity", time: str = "time_ms") -> DataFrame:
    """Slope per second: central inside, one-sided at the ends; a zero time step repeats the last slope."""
    framed = layout.extend(df, 1, 1)
    w = layout.window()
    framed = framed.select(
        "*",
        F.lag(value).over(w).alias("_pv"), F.lag(time).over(w).alias("_pt"),
        F.lead(value).over(w).alias("_nv"), F.lead(time).over(w).alias("_nt"),
    )
    first, last = F.col("_pt").isNull(), F.col("_nt").isNull()
    high_v, low_v = F.when(last, F.col(value)).otherwise(F.col("_nv")), F.when(first, F.col(value)).otherwise(F.col("_pv"))
    high_t, low_t = F.when(last, F.col(time)).otherwise(F.col("_nt")), F.when(first, F.col(time)).otherwise(F.col("_pt"))
    step = (high_t - low_t) / F.lit(1000.0)
    slope = F.when(step > MIN_STEP_S, (high_v - low_v) / step).when(first | last, F.lit(0.0))
    done = layout.trim(framed.withColumn("_slope", slope).drop("_pv", "_pt", "_nv", "_nt"))
    return layout.nearest(done, {out: (F.col("_slope"), True)}, inclusive=True).drop("_slope")


def clean_series(df: DataFrame, layout: Layout) -> DataFrame:
    """Raw long rows to repaired, smoothed and differentiated rows with their position."""
    repaired = repair_gaps(df, layout)
    return layout.number(differentiate(smooth(repaired, layout), layout), "idx")
