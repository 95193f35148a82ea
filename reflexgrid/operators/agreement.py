"""Agreement of two measurement methods on the same frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LiveSettings
from ..functions.numeric import half_up, is_finite
from .ordered import Heat, Layout

SIDES = ("left", "right")


def _valid(px: Column, x: Column, y: Column, found: Column) -> Column:
    return F.coalesce(found & (px > 0) & ~F.isnan(px) & is_finite(x) & is_finite(y), F.lit(False))


def compare_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on equal (session_id, ts_ms) and compare each eye.

    `a` has {left,right}_px, center_x, center_y; `b` has the same names with the suffix _b.
    """
    return compare_matched(a.join(b.drop("sample_id"), ["session_id", "ts_ms"]))


def compare_matched(rows: DataFrame) -> DataFrame:
    """Compare rows that already carry both measurements (also on a stream)."""
    cols = {}
    for s in SIDES:
        pa, pb = F.col(f"{s}_px"), F.col(f"{s}_px_b")
        va = _valid(pa, F.col("center_x"), F.col("center_y"), pa.isNotNull())
        vb = _valid(pb, F.col("center_x_b"), F.col("center_y_b"), pb.isNotNull())
        both = va & vb
        diff = F.abs(pb - pa)
        dx, dy = F.col("center_x_b") - F.col("center_x"), F.col("center_y_b") - F.col("center_y")
        safe = lambda c: F.when(is_finite(c), c)
        cols |= {
            f"{s}_valid_a": va, f"{s}_valid_b": vb, f"{s}_diff_px": F.when(both, safe(diff)),
            f"{s}_distance_px": F.when(both, safe(F.sqrt(dx * dx + dy * dy))),
            f"{s}_error_pct": F.when(both, safe(diff / F.nullif(pa, F.lit(0.0)) * F.lit(100.0))),
        }
    rows = rows.select("session_id", "sample_id", "ts_ms", "left_px_b", "right_px_b", *[c.alias(n) for n, c in cols.items()])
    l, r = F.col("left_diff_px"), F.col("right_diff_px")  # noqa: E741
    n = l.isNotNull().cast("int") + r.isNotNull().cast("int")
    zero = F.lit(0.0)
    mean = lambda x, y: (F.coalesce(x, zero) + F.coalesce(y, zero)) / F.nullif(n, F.lit(0))
    dist = lambda s: F.when(F.col(f"{s}_diff_px").isNotNull(), F.coalesce(F.col(f"{s}_distance_px"), zero))
    return rows.select(
        "*", ((F.col("left_valid_a") == F.col("left_valid_b")) & (F.col("right_valid_a") == F.col("right_valid_b"))).alias("agrees"),
        mean(l, r).alias("mean_diff_px"), mean(dist("left"), dist("right")).alias("mean_distance_px"), (n > 0).alias("comparable"),
    )


def rejects(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `b` without a frame of the same time."""
    return b.join(a.select("session_id", "ts_ms"), ["session_id", "ts_ms"], "left_anti")


def signed_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Live telemetry form: b minus a per eye, two digits; zero counts as missing."""
    rows = a.join(b.drop("sample_id"), ["session_id", "ts_ms"])
    pair = lambda s: (F.coalesce(F.col(f"{s}_px"), F.lit(0.0)) != 0) & (F.coalesce(F.col(f"{s}_px_b"), F.lit(0.0)) != 0)
    dx, dy = F.col("center_x_b") - F.col("center_x"), F.col("center_y_b") - F.col("center_y")
    return rows.select(
        "session_id", "sample_id", *[F.when(pair(s), half_up(F.col(f"{s}_px_b") - F.col(f"{s}_px"), 2)).alias(f"{s}_delta_px") for s in SIDES],
        half_up(F.sqrt(dx * dx + dy * dy), 2).alias("centroid_distance_px"),
    )


def statistics(frames: DataFrame, history: int = LiveSettings.history) -> DataFrame:
    """Per session over the last `history` comparisons; medians take the upper middle element."""
    newest = Window.partitionBy("session_id").orderBy(F.col("ts_ms").desc(), F.col("sample_id").desc())
    so_far = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    finite = {s: is_finite(F.col(f"{s}_px_b")) for s in SIDES}
    # one sort serves all three ranks: of all frames, and of each side's frames with a value
    seen = {f"_{s}_rank": F.count(F.when(finite[s], 1)).over(so_far) for s in SIDES}
    ranked = frames.select("*", F.row_number().over(newest).alias("_rank"), *[c.alias(n) for n, c in seen.items()])
    kept = F.col("_rank") <= history
    side = lambda s: F.when(finite[s] & (F.col(f"_{s}_rank") <= history), F.col(f"{s}_px_b"))
    two = lambda f: F.when(kept, F.array_compact(F.array(f"left_{f}", f"right_{f}")))
    count = lambda c: F.count(F.when(kept & c, 1))
    stats = ranked.groupBy("session_id").agg(
        count(F.lit(True)).alias("n"), count(F.col("comparable")).alias("valid_comparisons"),
        F.sort_array(F.flatten(F.collect_list(two("diff_px")))).alias("_d"), F.sort_array(F.flatten(F.collect_list(two("distance_px")))).alias("_c"),
        count(F.col("left_valid_b") | F.col("right_valid_b")).alias("_b"), count(F.col("left_valid_a") | F.col("right_valid_a")).alias("_a"),
        count(F.col("agrees")).alias("_g"), *[f(side(s)).alias(f"_{s}_{n}") for s in SIDES for n, f in (("m", F.avg), ("d", F.stddev_pop))],
    )
    # the arrays hold at most 2 * history numbers
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(F.lit(0.0))
    upper = lambda a: F.when(F.size(a) > 0, F.get(a, F.floor(F.size(a) / 2).cast("int"))).otherwise(F.lit(0.0))
    pct = lambda c: F.col(c) / F.col("n") * F.lit(100.0)
    zero = F.lit(0.0)
    m, d = (lambda s: F.col(f"_{s}_m")), (lambda s: F.col(f"_{s}_d"))
    return stats.select(
        "session_id", "n", "valid_comparisons", mean("_d").alias("mean_diff_px"), upper("_d").alias("median_diff_px"),
        mean("_c").alias("mean_distance_px"), upper("_c").alias("median_distance_px"),
        pct("_b").alias("validity_b_pct"), pct("_a").alias("validity_a_pct"), pct("_g").alias("agreement_pct"),
        *[c for s in SIDES for c in (
            F.coalesce(m(s), zero).alias(f"{s}_mean_px"), F.coalesce(d(s), zero).alias(f"{s}_std_px"),
            F.when(m(s) > 0, d(s) / m(s) * F.lit(100.0)).otherwise(zero).alias(f"{s}_cv_pct"),
        )],
    )


def latest_before(a: DataFrame, b: DataFrame, heat: Heat, values: list[str]) -> DataFrame:
    """As-of join: every row of `a` with the latest row of `b` at or before its time."""
    only = F.struct(F.col("sample_id").alias("b_id"), *values)
    left = a.select("session_id", "ts_ms", F.lit(1).alias("_side"), "sample_id", F.lit(None).cast(b.select(only.alias("s")).schema["s"].dataType).alias("_b"))
    right = b.select("session_id", "ts_ms", F.lit(0).alias("_side"), "sample_id", only.alias("_b"))
    both = left.unionByName(right)

    def run(df: DataFrame, layout: Layout) -> DataFrame:
        return layout.nearest(df, {"_hit": (F.col("_b"), True)}, inclusive=True).where("_side = 1").select("session_id", "sample_id", "ts_ms", "_hit.*")

    return heat.apply(both, ("session_id",), ("ts_ms", "_side", "sample_id"), run)
