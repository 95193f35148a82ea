"""Operators on pixel tables (split, sample, y, x, lum): filters, resizing, hashing, dark-region search.

One image is bounded by its declared size, so windows and groups per image are bounded as well.
Where two window passes follow each other the rows are hashed by image once, which serves both.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import IRIS_MM, AuditSettings
from ..functions.numeric import clamp, half_up, pick
from .components import IMAGE, component_runs_of, dealt, to_pixels, written

# Luminance weights.
RGB = (0.299, 0.587, 0.114)


def luminance(red: Column, green: Column, blue: Column) -> Column:
    return F.lit(RGB[0]) * red + F.lit(RGB[1]) * green + F.lit(RGB[2]) * blue


def image_stats(pixels: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    return pixels.groupBy(*keys).agg(
        F.min("lum").alias("min_lum"), F.max("lum").alias("max_lum"), F.avg("lum").alias("mean_lum"), F.stddev_pop("lum").alias("std_lum")
    )


def image_flags(stats: DataFrame, cfg: AuditSettings = AuditSettings()) -> DataFrame:
    """At most one quality flag per image."""
    std = half_up(F.col("std_lum"), 9)
    flag = (
        F.when((F.col("max_lum") == 0) | (F.col("mean_lum") < 1.0), F.lit("COMPLETELY_BLACK"))
        .when((F.col("min_lum") == 255) | (F.col("mean_lum") > 254.0), F.lit("COMPLETELY_WHITE"))
        .when(std < cfg.low_std, F.format_string("EXTREMELY_LOW_VARIANCE (std=%.2f)", half_up(std, 2)))
    )
    return stats.withColumn("flags", F.array_compact(F.array(flag)))


def blur(pixels: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """3x3 weights 1-2-1 / 2-4-2 / 1-2-1 over 16, interior pixels only: two 1-2-1 passes on one exchange."""
    rows = dealt(pixels, keys)
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    three = lambda c, w: F.lag(c).over(w) + F.col(c) * F.lit(2.0) + F.lead(c).over(w)
    out = rows.withColumn("_h", three("lum", across)).withColumn("_v", three("_h", down))
    return out.where("_v is not null").select(*keys, "y", "x", (F.col("_v") / F.lit(16.0)).alias("lum"))


def resize_nearest(pixels: DataFrame, value: str, source: tuple[int, int], target: tuple[int, int], keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Nearest resize: each source pixel emits the target pixels it fills, so no join and no shuffle."""

    def spread(df: DataFrame, c: str, n: int, m: int) -> DataFrame:
        scale = n / m
        low = F.greatest(F.lit(0), F.ceil(F.col(c) / F.lit(scale) - F.lit(0.5)) - 1).cast("int")
        high = F.least(F.lit(m - 1), F.ceil((F.col(c) + 1) / F.lit(scale) - F.lit(0.5))).cast("int")
        rows = df.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias(f"_t{c}"))
        return rows.where(F.floor((F.col(f"_t{c}") + F.lit(0.5)) * F.lit(scale)) == F.col(c))

    rows = spread(pixels.select(*keys, "y", "x", value), "y", source[1], target[1])
    rows = spread(rows, "x", source[0], target[0])
    return rows.select(*keys, F.col("_ty").alias("y"), F.col("_tx").alias("x"), value)


def resize_bilinear(
    pixels: DataFrame, source: tuple[int, int], target: tuple[int, int], crop: tuple[int, int, int, int] | None = None, keys: tuple[str, ...] = IMAGE
) -> DataFrame:
    """Four-tap bilinear resize (half-pixel centres, edges clamped) as weighted sums of source pixels.

    `crop` is (x, y, width, height) in the source. Every source pixel emits its weighted share to the
    few target pixels it touches; the shares are summed map-side first.
    """
    x0, y0, cw, ch = crop or (0, 0, source[0], source[1])

    def spread(df: DataFrame, c: str, n: int, m: int, off: int, size: int) -> DataFrame:
        scale = size / m
        low = F.greatest(F.lit(0), F.floor((F.col(c) - F.lit(off + 0.5)) / F.lit(scale) - F.lit(0.5)) - 1).cast("int")
        high = F.least(F.lit(m - 1), F.ceil((F.col(c) - F.lit(off - 1.5)) / F.lit(scale) - F.lit(0.5)) + 1).cast("int")
        rows = df.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias(f"_t{c}"))
        at = F.lit(float(off)) + (F.col(f"_t{c}") + F.lit(0.5)) * F.lit(scale) - F.lit(0.5)
        rows = rows.withColumn("_at", at).withColumn("_base", F.floor("_at"))
        part = F.col("_at") - F.col("_base")
        hit = lambda k: F.greatest(F.lit(0), F.least(k, F.lit(n - 1))) == F.col(c)
        weight = F.when(hit(F.col("_base")), F.lit(1.0) - part).otherwise(F.lit(0.0)) + F.when(hit(F.col("_base") + 1), part).otherwise(F.lit(0.0))
        return rows.withColumn(f"_w{c}", weight).where(F.col(f"_w{c}") > 0).drop("_at", "_base")

    rows = spread(pixels.select(*keys, "y", "x", "lum"), "y", source[1], target[1], y0, ch)
    rows = spread(rows, "x", source[0], target[0], x0, cw)
    return rows.groupBy(*keys, F.col("_ty").alias("y"), F.col("_tx").alias("x")).agg(F.sum(F.col("lum") * F.col("_wy") * F.col("_wx")).alias("lum"))


def normalise(pixels: DataFrame, mode: str = "minmax", keys: tuple[str, ...] = IMAGE) -> DataFrame:
    lum = F.col("lum")
    if mode == "bipolar":
        value = lum / F.lit(127.5) - F.lit(1.0)
    elif mode == "standard":
        w = Window.partitionBy(*keys)
        value = (lum - F.avg(lum).over(w)) / (F.stddev_pop(lum).over(w) + F.lit(1e-7))
    else:
        value = lum / F.lit(255.0)
    return pixels.withColumn("norm", value)


def _unit(seed: int, *cols: str) -> Column:
    """Uniform number in (0, 1) that depends only on the columns and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def adjust_light(pixels: DataFrame, brightness: Column, contrast: Column, noise_std: float = 0.0, seed: int = 0, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Brightness, contrast about the image mean, optional noise, clipped to 0..255."""
    lit = F.col("lum") * brightness
    mean = F.avg(lit).over(Window.partitionBy(*keys))
    value = (lit - mean) * contrast + mean
    if noise_std > 0:
        u, v = _unit(seed, *keys, "y", "x"), _unit(seed + 1, *keys, "y", "x")
        value = value + F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2 * math.pi) * v) * F.lit(noise_std * 255.0)
    return pixels.withColumn("lum", clamp(value, 0.0, 255.0))


def random_factor(seed: int, low: float, high: float, keys: tuple[str, ...] = IMAGE) -> Column:
    """A factor per image, the same on every run."""
    return F.lit(low) + _unit(seed, *keys) * F.lit(high - low)


def remap(
    pixels: DataFrame, value: str, size: tuple[int, int], flip: Column, angle_deg: Column, dx: Column, dy: Column, method: str = "nearest", keys: tuple[str, ...] = IMAGE
) -> DataFrame:
    """Flip, rotate about the centre and shift, in this order; outside pixels become 0. Image and mask use the same map.

    The lookup undoes the steps backwards: shift, rotation, flip.

    Every target pixel looks up its source pixel ("nearest", for masks) or the four around its source
    point ("bilinear", for images), as an equi join on (image, y, x).
    """
    w, h = size
    a = -F.radians(angle_deg)
    cx, cy = F.col("x") - dx + F.lit(0.5 - w / 2), F.col("y") - dy + F.lit(0.5 - h / 2)
    turned_x, turned_y = F.cos(a) * cx + F.sin(a) * cy + F.lit(w / 2), -F.sin(a) * cx + F.cos(a) * cy + F.lit(h / 2)
    at_x, at_y = half_up(F.when(flip, F.lit(w) - turned_x).otherwise(turned_x), 9), half_up(turned_y, 9)
    source = pixels.select(*keys, F.col("y").alias("_sy"), F.col("x").alias("_sx"), value)
    if method == "nearest":
        wanted = pixels.select(*keys, "y", "x", F.floor(at_y).cast("int").alias("_sy"), F.floor(at_x).cast("int").alias("_sx"))
        return wanted.join(source, [*keys, "_sy", "_sx"], "left").select(*keys, "y", "x", F.coalesce(F.col(value), F.lit(0)).alias(value))
    spots = pixels.select(*keys, "y", "x", at_y.alias("_ay"), at_x.alias("_ax"))
    spots = spots.select("*", F.floor(F.col("_ay") - 0.5).alias("_by"), F.floor(F.col("_ax") - 0.5).alias("_bx"))
    fy, fx = F.col("_ay") - 0.5 - F.col("_by"), F.col("_ax") - 0.5 - F.col("_bx")
    inside = (F.col("_ax") >= 0) & (F.col("_ax") < w) & (F.col("_ay") >= 0) & (F.col("_ay") < h)

    def tap(i: int, j: int) -> Column:
        fit = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1))).cast("int")
        weight = (fy if i else F.lit(1.0) - fy) * (fx if j else F.lit(1.0) - fx)
        return F.struct(fit(F.col("_by") + i, h).alias("sy"), fit(F.col("_bx") + j, w).alias("sx"), weight.alias("w"))

    taps = F.when(inside, F.array(*[tap(i, j) for i in (0, 1) for j in (0, 1)]))
    wanted = spots.select(*keys, "y", "x", F.explode_outer(taps).alias("t")).select(*keys, "y", "x", F.col("t.sy").alias("_sy"), F.col("t.sx").alias("_sx"), F.col("t.w").alias("_w"))
    share = F.coalesce(F.sum(F.col(value) * F.col("_w")), F.lit(0.0))
    return wanted.join(source, [*keys, "_sy", "_sx"], "left").groupBy(*keys, "y", "x").agg(share.alias(value))


def difference_hash(pixels: DataFrame, width: int, height: int, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Signed 64-bit hash of the sign of horizontal steps, first bit highest ((width-1) bits per line)."""
    line = Window.partitionBy(*keys, "y").orderBy("x")
    bits = (width - 1) * height
    step = pixels.repartition(*keys).select(*keys, "y", "x", (F.lead("lum").over(line) > F.col("lum")).alias("_up"))
    place = (F.lit(bits - 1) - (F.col("y") * (width - 1) + F.col("x"))).cast("int")
    bit = F.when(F.col("_up"), F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long"))
    return step.where("_up is not null").groupBy(*keys).agg(F.bit_or(bit).alias("dhash"))


def content_hash(pixels: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """MD5 of the pixel values in line order (one image is one bounded group)."""
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", "lum")))
    text = F.concat_ws(",", F.transform(ordered, lambda p: p["lum"].cast("long").cast("string")))
    return pixels.groupBy(*keys).agg(F.md5(text).alias("md5"))


# ---- dark-region search ----------------------------------------------------------------------------


def around_iris(pixels: DataFrame, iris: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Pixels within the iris disc, with their squared distance; `iris` is (keys, icx, icy, ir), as many rows as images, so it is not broadcast."""
    d = (F.col("x") - F.col("icx")) * (F.col("x") - F.col("icx")) + (F.col("y") - F.col("icy")) * (F.col("y") - F.col("icy"))
    return dealt(pixels, keys).join(iris.hint("merge"), list(keys)).withColumn("d2", d).where(F.col("d2") <= F.col("ir") * F.col("ir"))


def dark_seed(disc: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Darkest pixel of the central 45 %, first in line order; the iris centre when there is none below 255."""
    core = (F.col("d2") <= (F.col("ir") * 0.45) * (F.col("ir") * 0.45)) & (F.col("lum") < 255)
    best = F.min(F.when(core, F.struct("lum", "y", "x")))
    return dealt(disc, keys).groupBy(*keys).agg(best.alias("b"), F.first("icx").alias("icx"), F.first("icy").alias("icy")).select(
        *keys, F.coalesce("b.x", half_up(F.col("icx")).cast("int")).alias("seed_x"), F.coalesce("b.y", half_up(F.col("icy")).cast("int")).alias("seed_y"),
        F.coalesce("b.lum", F.lit(255.0)).alias("seed_lum"),
    )


def adaptive_threshold(disc: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Dark threshold from the 5th percentile of the disc and the median of its outer ring (nearest rank)."""
    ring = F.col("d2").between((F.col("ir") * 0.50) * (F.col("ir") * 0.50), (F.col("ir") * 0.95) * (F.col("ir") * 0.95))
    w = Window.partitionBy(*keys)
    by = w.orderBy("lum", "y", "x")
    rows = dealt(disc, keys).withColumn("_ring", ring).select(
        *keys, "lum", "_ring", F.row_number().over(by).alias("_rk"), F.count(F.lit(1)).over(w).alias("_n"),
        F.count(F.when(F.col("_ring"), 1)).over(by).alias("_rrk"), F.count(F.when(F.col("_ring"), 1)).over(w).alias("_rn"),
    )
    nth = lambda rank, n, p, cond=F.lit(True): F.max(F.when(cond & (F.col(rank) == F.floor(F.col(n) * F.lit(p)) + 1), F.col("lum")))
    g = rows.groupBy(*keys).agg(
        nth("_rk", "_n", 0.05).alias("p05"), nth("_rrk", "_rn", 0.5, F.col("_ring")).alias("_stroma"), nth("_rk", "_n", 0.75).alias("_p75")
    )
    g = g.select(*keys, "p05", F.coalesce("_stroma", "_p75", F.col("p05") + 20).alias("stroma"))
    d = F.col("stroma") - F.col("p05")
    t = pick([(d > 15, F.col("p05") + d * F.lit(0.45)), (d > 5, F.col("p05") + d * F.lit(0.55) + F.lit(2.0))], F.col("p05") + F.lit(8.0))
    return g.select(*keys, "p05", "stroma", F.greatest(F.lit(0.0), d / F.lit(255.0)).alias("contrast"), t.alias("threshold"))


def grow_region(disc: DataFrame, seeds: DataFrame, thresholds: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Pixels of the dark region around the seed, bright reflections near the centre included.

    The region is the connected component of the seed among candidate pixels; with fewer than five
    pixels it is replaced by the dark pixels of a disc around the seed.
    """
    k = list(keys)
    joined = dealt(disc, k).join(seeds.hint("merge"), k).join(thresholds.hint("merge"), k)
    rows = written(joined, "disc")  # read four times below
    dark = F.col("lum") <= F.col("threshold")
    glint = ~dark & (F.col("d2") <= (F.col("ir") * 0.38) * (F.col("ir") * 0.38)) & (F.col("lum") > 75)
    near = F.col("d2") <= (F.col("ir") * 0.78) * (F.col("ir") * 0.78)
    is_seed = (F.col("x") == F.col("seed_x")) & (F.col("y") == F.col("seed_y"))
    candidates = rows.where((near & (dark | glint)) | is_seed)
    member = written(component_runs_of(candidates, rows.where(is_seed), keys), "member")
    big, few = to_pixels(member.where("n >= 5"), keys), member.where("n < 5").select(*keys)
    pixel = [*keys, "y", "x"]
    grown = rows.join(dealt(big, pixel, rows).hint("merge"), pixel, "left_semi")
    sx, sy = F.col("x") - F.col("seed_x"), F.col("y") - F.col("seed_y")
    close = (sx * sx + sy * sy <= (F.col("ir") * 0.35) * (F.col("ir") * 0.35)) & (F.col("lum") <= F.col("threshold") + 4)
    small = rows.where(close).join(dealt(few, k, rows).hint("merge"), k, "left_semi")
    return written(grown.unionByName(small), "region")


def region_moments(region: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Weighted centre and plain second moments of the region, as a fitted ellipse (a window and an aggregate per image, in line order)."""
    weight = F.greatest(F.lit(1.0), F.col("threshold") - F.col("lum") + F.lit(10.0))
    image = Window.partitionBy(*keys)
    centre = lambda c: (F.sum(F.col(c) * weight).over(image) / F.sum(weight).over(image)).alias(f"c{c}")
    rows = dealt(region, keys).sortWithinPartitions(*keys, "y", "x").select(*keys, "y", "x", F.count(F.lit(1)).over(image).alias("n"), centre("x"), centre("y"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    m = rows.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.avg(dx * dx).alias("u20"), F.avg(dy * dy).alias("u02"), F.avg(dx * dy).alias("u11")
    )
    u20, u02, u11 = F.col("u20"), F.col("u02"), F.col("u11")
    common = F.sqrt((u20 - u02) * (u20 - u02) + F.lit(4.0) * u11 * u11)
    radius = F.greatest(F.lit(1.5), F.sqrt(F.col("n") / F.lit(math.pi)))
    axis = lambda sign, floor: F.greatest(F.lit(2.0) * F.sqrt(F.greatest(F.lit(1.0), (u20 + u02 + F.lit(sign) * common) / 2)), radius * F.lit(floor))
    return m.where("n >= 4").select(
        *keys, "n", "cx", "cy", radius.alias("radius"), axis(1.0, 0.9).alias("major_axis"), axis(-1.0, 0.7).alias("minor_axis"),
        (F.lit(0.5) * F.atan2(F.lit(2.0) * u11, u20 - u02)).alias("angle"),
    )


def judge_region(moments: DataFrame, iris: DataFrame, thresholds: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Plausibility of the fitted region; far-off results fall back to 0.35 of the iris, as do images without one."""
    k = list(keys)
    rows = dealt(iris, k).join(moments.hint("merge"), k, "left").join(thresholds.hint("merge"), k, "left")
    ir = F.col("ir")
    off = F.sqrt((F.col("cx") - F.col("icx")) * (F.col("cx") - F.col("icx")) + (F.col("cy") - F.col("icy")) * (F.col("cy") - F.col("icy")))
    ratio = F.col("radius") / ir
    roundness = clamp(F.col("minor_axis") / F.col("major_axis"), 0.0, 1.0)
    none = F.col("n").isNull()
    odd = (off > ir * 0.55) | ~ratio.between(0.12, 0.80)
    wrong = odd & ((off > ir * 0.85) | (ratio < 0.08) | (ratio > 0.92))
    weak = (F.col("contrast") < 0.02) | (roundness < 0.25)
    back = none | F.coalesce(wrong, F.lit(False))
    radius = F.when(back, F.greatest(F.lit(2.0), ir * F.lit(0.35))).otherwise(F.col("radius"))
    return rows.select(
        *keys, F.when(back | odd | weak, "UNCERTAIN").otherwise("DETECTED").alias("status"), F.when(back, F.col("icx")).otherwise(F.col("cx")).alias("px_x"),
        F.when(back, F.col("icy")).otherwise(F.col("cy")).alias("px_y"), (radius * F.lit(2.0)).alias("diameter_px"),
        half_up(radius / ir * F.lit(IRIS_MM), 2).alias("diameter_mm"), F.coalesce(roundness, F.lit(0.85)).alias("circularity"),
        *[F.when(back, radius * F.lit(2.0)).otherwise(F.col(f"{a}_axis")).alias(f"{a}_axis") for a in ("major", "minor")], F.coalesce("angle", F.lit(0.0)).alias("angle"), "contrast",
    )
