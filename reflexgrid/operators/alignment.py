"""Joins on time within a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from .components import written
from .ranks import running_total

FAN_BITS = 3


def align_eyes(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left and right series on the union of their times."""
    pick = lambda df, s: df.select("session_id", "time_ms", half_up(F.col("clean_mm"), 2).alias(f"{s}_mm"), half_up(F.col("velocity"), 2).alias(f"{s}_velocity"))
    return pick(left, "left").join(pick(right, "right"), ["session_id", "time_ms"], "full_outer")


def all_times(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct times of either series."""
    return left.select("session_id", "time_ms").union(right.select("session_id", "time_ms")).distinct()


def with_stimulus(samples: DataFrame, stimuli: DataFrame) -> DataFrame:
    """Stimulus-relative time and the stimulus on/off flag of every frame of its session."""
    rows = samples.join(stimuli, "session_id")
    t = F.col("frame_ts_ms")
    return rows.select(
        *samples.columns, (t - F.col("onset_ms")).alias("rel_ms"), ((t >= F.col("onset_ms")) & (t <= F.col("offset_ms"))).alias("stimulus_active")
    )


def within(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str) -> DataFrame:
    """Interval join: points of `points` inside intervals of the same key, borders included.

    An interval belongs to the level of its length (the power of two above it) and to the one or two buckets of that width that it
    touches. A point looks into its own bucket of each level in use, so what meets is bounded by the matches and the intervals
    of a like length nearby, not by all intervals of the key.
    """
    spans = intervals.where(F.col(end) >= F.col(start))
    length = F.col(end) - F.col(start)
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0))))).cast("int")
    level = F.when(F.pow(F.lit(2.0), level) < length, level + 1).otherwise(level)
    spans = spans.withColumn("_level", level).withColumn("_width", F.pow(F.lit(2.0), F.col("_level")))
    buckets = F.sequence(F.floor(F.col(start) / F.col("_width")), F.floor(F.col(end) / F.col("_width")))
    placed = spans.withColumn("_bucket", F.explode(buckets)).drop("_width").withColumnRenamed(key, "_key")
    used = sorted(r["_level"] for r in spans.select("_level").distinct().collect()) or [0]  # one number per power of two
    probes = F.array(*[F.struct(F.lit(n).alias("_level"), F.floor(F.col(time) / F.lit(2.0**n)).alias("_bucket")) for n in used])
    asked = points.withColumn("_probe", F.explode(probes))
    same = (F.col(key) == F.col("_key")) & (F.col("_probe._level") == F.col("_level")) & (F.col("_probe._bucket") == F.col("_bucket"))
    return asked.join(placed, same & F.col(time).between(F.col(start), F.col(end))).drop("_probe", "_key", "_level", "_bucket")


def totals_within(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, value: str, by: str) -> DataFrame:
    """(by, n, least, most): how many points lie inside the intervals of each `by`, borders included, and their least and greatest `value`; nothing for
    intervals without a point.

    Points that lie in many intervals are not paired with them. The distinct times have positions, an interval is a run of positions, and totals are kept
    for blocks of 1, 8, 64, ... positions; an interval is made of at most 14 blocks of each size.
    """
    timed = points.where(F.col(key).isNotNull() & F.col(time).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(time).cast("double").alias("_t"))
    times = timed.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    spans = intervals.where((F.col(end) >= F.col(start)) & F.col(key).isNotNull())
    spans = written(spans.select(F.col(key).alias("_key"), F.col(start).cast("double").alias("_a"), F.col(end).cast("double").alias("_b"), by), "spans")
    bare = lambda n: [F.lit(None).cast("long").alias("n"), *[F.lit(None).cast(times.schema[c].dataType).alias(c) for c in ("least", "most")], F.lit(n).alias("_kind")]
    point = times.select("_key", "_t", "n", "least", "most", F.lit(1).alias("_kind"))
    # starts come before the points of their time, ends after them
    starts, ends = (spans.select("_key", F.col(c).alias("_t"), *bare(n)).distinct() for c, n in (("_a", 0), ("_b", 2)))
    every = point.unionByName(starts).unionByName(ends).withColumn("_one", (F.col("_kind") == 1).cast("long"))
    placed = written(running_total(every, ["_key", "_t", "_kind"], "_one", "_upto"), "placed")
    at = lambda n, c, name: placed.where(F.col("_kind") == n).select("_key", F.col("_t").alias(c), F.col("_upto").alias(name))
    runs = spans.join(at(0, "_a", "_lo"), ["_key", "_a"]).join(at(2, "_b", "_hi"), ["_key", "_b"]).where("_lo < _hi").select(by, "_lo", "_hi")
    runs = written(runs, "runs")
    longest = runs.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 1
    levels = range((int(longest).bit_length() - 1) // FAN_BITS + 1)
    first = lambda k: F.floor((F.col("_lo") + F.lit((1 << k * FAN_BITS) - 1)) / F.lit(1 << k * FAN_BITS))
    last = lambda k: F.floor(F.col("_hi") / F.lit(1 << k * FAN_BITS))
    none = F.array().cast("array<bigint>")
    between = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    def blocks(k: int):
        """Whole blocks of level `k` that lie in no whole block of the next level."""
        if k + 1 not in levels:
            return between(first(k), last(k))
        up, down = first(k + 1), last(k + 1)
        fan = F.lit(1 << FAN_BITS)
        return F.when(up < down, F.concat(between(first(k), up * fan), between(down * fan, last(k)))).otherwise(between(first(k), last(k)))

    named = lambda k: F.transform(blocks(k), lambda b: F.struct(F.lit(k).alias("_level"), b.alias("_block")))
    wanted = F.flatten(F.array(*[named(k) for k in levels]))
    pieces = runs.select(by, F.explode(wanted).alias("_p")).select(by, "_p._level", "_p._block")
    own = F.array(*[F.struct(F.lit(k).alias("_level"), F.shiftright(F.col("_upto") - 1, k * FAN_BITS).alias("_block")) for k in levels])
    held = placed.where("_kind = 1").select("n", "least", "most", F.explode(own).alias("_p")).groupBy("_p._level", "_p._block")
    totals = lambda g: g.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return totals(pieces.join(totals(held), ["_level", "_block"]).groupBy(by))


def during_stimulus(samples: DataFrame, stimuli: DataFrame) -> DataFrame:
    """Interval join: frames inside a stimulus interval of their session."""
    spans = stimuli.select("session_id", "onset_ms", "offset_ms")
    return within(samples, spans, "session_id", "frame_ts_ms", "onset_ms", "offset_ms").select(*samples.columns, "onset_ms", "offset_ms")
