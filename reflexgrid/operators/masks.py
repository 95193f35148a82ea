"""Geometry of class masks in pixel-table form (split, sample, y, x, class)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, half_up, pick
from .components import IMAGE, label_runs, largest, to_runs


def class_geometry(masks: DataFrame, cls: int, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Area, box, centre and aspect ratio of one class; an absent class gives a zero row."""
    on = F.col("class") == cls
    at = lambda c: F.when(on, F.col(c))
    zero = F.lit(0)
    g = masks.groupBy(*keys).agg(
        F.count(F.when(on, 1)).alias("area"), F.min(at("x")).alias("x0"), F.max(at("x")).alias("x1"), F.min(at("y")).alias("y0"), F.max(at("y")).alias("y1"),
        F.sum(at("x")).alias("_sx"), F.sum(at("y")).alias("_sy"),
    )
    w, h = F.coalesce(F.col("x1") - F.col("x0") + 1, zero), F.coalesce(F.col("y1") - F.col("y0") + 1, zero)
    mean = lambda c: F.when(F.col("area") > 0, F.col(c) / F.col("area")).otherwise(F.lit(0.0))
    return g.select(
        *keys, "area", *[F.coalesce(c, zero).alias(c) for c in ("x0", "y0", "x1", "y1")], mean("_sx").alias("cx"), mean("_sy").alias("cy"),
        w.alias("width"), h.alias("height"), (w / F.greatest(h, F.lit(1))).alias("aspect"),
    )


def boundary_contact(masks: DataFrame, cls: int, width: int, height: int, keys: tuple[str, ...] = IMAGE, min_contact: int = 10) -> DataFrame:
    """Whether the class reaches the image border, and how many border pixels it has (corners count twice)."""
    on = F.col("class") == cls
    sides = [F.col("x") == 0, F.col("x") == width - 1, F.col("y") == 0, F.col("y") == height - 1]
    hits = sum((s.cast("int") for s in sides[1:]), sides[0].cast("int"))
    contact = F.sum(F.when(on, hits).otherwise(F.lit(0)))
    return masks.groupBy(*keys).agg(contact.alias("contact")).select(
        *keys, "contact", (F.col("contact") > 0).alias("box_touches"), (F.col("contact") >= min_contact).alias("touches")
    )


def component_runs(pixels: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Runs of all components with their label, from the pixels of one class."""
    return label_runs(to_runs(pixels, keys), keys)


def region_geometry(labelled: DataFrame, width: int, height: int, keys: tuple[str, ...] = IMAGE, min_area: int = 10) -> DataFrame:
    """Largest component per image: area, centre, box, diameter, perimeter and circularity.

    All but the perimeter come straight from the runs. A pixel counts for the perimeter when one of
    its four neighbours is missing; the covered part of a run is the sum of its overlaps with the
    lines above and below, taken pixel-wise only for the winning component.
    """
    best = largest(labelled, keys, min_area)
    runs = labelled.join(best.drop("area"), [*keys, "label"])
    n = F.col("x1") - F.col("x0") + 1
    base = runs.groupBy(*keys).agg(
        F.sum(n).alias("area"), F.sum(n * (F.col("x0") + F.col("x1")) / 2).alias("_sx"), F.sum(n * F.col("y")).alias("_sy"),
        F.min("x0").alias("bx0"), F.max("x1").alias("bx1"), F.min("y").alias("by0"), F.max("y").alias("by1"),
    )
    px = runs.select(*keys, "y", "x0", "x1", F.explode(F.sequence("x0", "x1")).alias("x"))
    up = px.select(*keys, (F.col("y") + 1).alias("y"), "x", F.lit(1).alias("v"))
    down = px.select(*keys, (F.col("y") - 1).alias("y"), "x", F.lit(1).alias("v"))
    across = px.select(*keys, "y", "x", F.lit(0).alias("v"), (((F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1"))).cast("int")).alias("h"))
    cover = across.unionByName(up.unionByName(down).withColumn("h", F.lit(None).cast("int"))).groupBy(*keys, "y", "x").agg(F.max("h").alias("h"), F.sum("v").alias("v"))
    rim = cover.where(F.col("h").isNotNull()).groupBy(*keys).agg(F.count(F.when((F.col("h") == 0) | (F.col("v") < 2), 1)).alias("perimeter"))
    area, per = F.col("area"), F.col("perimeter")
    return base.join(rim, list(keys)).select(
        *keys, "area", (F.col("_sx") / area).alias("cx"), (F.col("_sy") / area).alias("cy"), "bx0", "by0",
        (F.col("bx1") - F.col("bx0") + 1).alias("bw"), (F.col("by1") - F.col("by0") + 1).alias("bh"),
        (F.lit(2.0) * F.sqrt(area / F.lit(math.pi))).alias("diameter"), "perimeter", (F.lit(4.0 * math.pi) * area / (per * per)).alias("circularity"),
    )


def geometry_status(circularity: Column, diameter: Column, crop_width: Column) -> tuple[Column, Column]:
    """(status, confidence): shape and size must be plausible."""
    c = clamp(circularity, 0.0, 1.0)
    ok = (c >= 0.25) & (diameter >= 4) & (diameter <= crop_width * F.lit(0.85))
    return F.when(ok, "DETECTED").otherwise("UNCERTAIN"), F.when(ok, c).otherwise(F.greatest(F.lit(0.1), c * F.lit(0.5)))


def area_confidence(circularity: Column, area: Column) -> Column:
    """Circularity in 0..1, halved for regions below 50 px."""
    c = clamp(circularity, 0.0, 1.0)
    return F.when(area < 50, c * F.lit(0.5)).otherwise(c)


def argmax_mask(logits: DataFrame, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Class with the highest score per pixel; the lower class wins ties."""
    return logits.groupBy(*keys, "y", "x").agg(F.max_by("class", F.struct(F.col("logit"), -F.col("class"))).alias("class"))


def pair_pixels(pairs: DataFrame, pixels: DataFrame, values: list[str], splits: tuple[str, str] = ("val", "train")) -> DataFrame:
    """Pixels of both images of each pair side by side (a_*, b_*); pairs are (pair_a, pair_b), sample ids of the two splits.

    A name may exist in both splits, so each side takes the pixels of its own split only.
    """
    side = lambda s, split: pixels.where(F.col("split") == split).select(F.col("sample").alias(f"pair_{s}"), "y", "x", *[F.col(v).alias(f"{s}_{v}") for v in values])
    return pairs.join(side("a", splits[0]), "pair_a").join(side("b", splits[1]), ["pair_b", "y", "x"])


def pair_metrics(joined: DataFrame) -> DataFrame:
    """Pixel differences and pupil overlap of image pairs, from a_lum, b_lum, a_class, b_class.

    The correlation is null where an image is constant.
    """
    a, b = F.col("a_lum"), F.col("b_lum")
    d = F.abs(a - b)
    pa, pb = F.col("a_class") == 2, F.col("b_class") == 2
    spread = F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.stddev_pop(a) * F.stddev_pop(b))
    g = joined.groupBy("pair_a", "pair_b").agg(
        F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.max(d).alias("max_diff"), F.try_divide(F.covar_pop(a, b), spread).alias("pearson"),
        F.count(F.when(pa & pb, 1)).alias("_i"), F.count(F.when(pa | pb, 1)).alias("_u"), (F.count(F.when(pa, 1)) + F.count(F.when(pb, 1))).alias("_s"),
    )
    one = F.lit(1)
    return g.select(
        "pair_a", "pair_b", "mae", "rmse", "max_diff", "pearson", (F.col("_i") / F.greatest("_u", one)).alias("iou"),
        (F.lit(2.0) * F.col("_i") / F.greatest("_s", one)).alias("dice"),
    )


def leak_class(same_subject: Column, mae: Column, dice: Column) -> tuple[Column, Column]:
    """(classification, recommendation) of a reviewed pair."""
    kind = pick(
        [(same_subject & (mae < 3) & (dice > 0.95), F.lit("LIKELY_DUPLICATE")), (same_subject, F.lit("LIKELY_SAME_SEQUENCE / NEAR_DUPLICATE"))],
        F.lit("LIKELY_DIFFERENT_SAMPLE"),
    )
    return kind, F.when(same_subject, "REMOVE_FROM_VALIDATION").otherwise("KEEP")


def overlap_scores(truth: DataFrame, predicted: DataFrame, cls: int, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Dice and IoU of one class per image."""
    both = truth.join(predicted.select(*keys, "y", "x", F.col("class").alias("_p")), [*keys, "y", "x"])
    t, p = F.col("class") == cls, F.col("_p") == cls
    g = both.groupBy(*keys).agg(F.count(F.when(t & p, 1)).alias("i"), F.count(F.when(t | p, 1)).alias("u"), F.count(F.when(t, 1)).alias("t"), F.count(F.when(p, 1)).alias("p"))
    one = F.lit(1)
    return g.select(*keys, (F.col("i") / F.greatest("u", one)).alias("iou"), (F.lit(2.0) * F.col("i") / F.greatest(F.col("t") + F.col("p"), one)).alias("dice"), "t", "p")


def preservation(raw: DataFrame, resized: DataFrame, scale_x: float, scale_y: float, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Geometry before and after a resize, with the pass rule."""
    b = resized.select(*keys, *[F.col(c).alias(f"n_{c}") for c in ("area", "cx", "cy", "width", "height", "aspect")])
    dx, dy = F.col("n_cx") - F.col("cx") * F.lit(scale_x), F.col("n_cy") - F.col("cy") * F.lit(scale_y)
    dist, err = F.sqrt(dx * dx + dy * dy), F.abs(F.col("n_aspect") - F.col("aspect"))
    one = F.lit(1)
    return raw.join(b, list(keys)).select(
        *keys, F.col("area").alias("raw_area"), F.col("n_area").alias("new_area"), half_up(F.col("n_area") / F.greatest("area", one), 4).alias("area_ratio"),
        half_up(F.col("n_width") / F.greatest("width", one), 4).alias("width_ratio"), half_up(F.col("n_height") / F.greatest("height", one), 4).alias("height_ratio"),
        half_up(err, 4).alias("aspect_error"), half_up(dist, 2).alias("centre_error_px"), ((err < 0.10) & (dist < 2.0)).alias("consistent"),
    )
