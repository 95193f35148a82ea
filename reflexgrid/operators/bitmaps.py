"""Regions of binary images in one pass: each image is one row (keys, height, width, data), a byte per pixel (its
class, or zero outside).

A task reads strips of at most `tile` lines, so an image of any height is read by many tasks. All strips of a batch are worked on together:
runs come from differences along the lines, touching runs from binary search, and labels from hooking each tree to the least tree it
touches and jumping to the roots. Strips of tall images are then joined by the links between the runs on both sides of their seams.
Each run also counts its rim, the pixels that lack one of their four neighbours, so geometry needs no pixel rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import IMAGE, LINE, connected, roots

TILE = 1024
STACK = 1 << 23  # bytes that are worked on at once


def strips(images: DataFrame, keys: tuple[str, ...] = IMAGE, tile: int = TILE) -> DataFrame:
    """(keys, y0, lines, width, top, data): strips with one line of the image above (`top` lines, 0 or 1) and below, where there is one."""
    y0 = F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(tile))).alias("y0")
    rows = images.where("height > 0 and width > 0").select(*keys, "height", "width", "data", y0)
    lines = F.least(F.lit(tile), F.col("height") - F.col("y0"))
    top = F.least(F.lit(1), F.col("y0"))
    end = F.least(F.col("height"), F.col("y0") + lines + 1)
    part = F.substring("data", (F.col("y0") - top) * F.col("width") + 1, (end - F.col("y0") + top) * F.col("width"))
    return rows.select(*keys, F.col("y0").cast("int").alias("y0"), lines.cast("int").alias("lines"), F.col("width").cast("int").alias("width"), top.cast("int").alias("top"), part.alias("data"))


def labelled_strips(images: DataFrame, keys: tuple[str, ...] = IMAGE, tile: int = TILE, cls: int | None = None) -> DataFrame:
    """(keys, y, x0, x1, run, label, rim) of every run; labels hold within a strip."""
    parts = strips(images, keys, tile)
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", y int, x0 int, x1 int, run bigint, label bigint, rim int"
    return parts.mapInArrow(partial(_label, keys=keys, cls=cls), schema)


def _label(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], cls: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.array(batch.column("lines").to_pylist(), np.int64) * np.array(batch.column("width").to_pylist(), np.int64)
        widths = np.array(batch.column("width").to_pylist(), np.int64)
        order = np.lexsort([np.arange(len(widths)), widths])
        start = 0
        while start < len(order):
            end, held = start, 0
            while end < len(order) and widths[order[end]] == widths[order[start]] and (end == start or held + sizes[order[end]] <= STACK):
                held += sizes[order[end]]
                end += 1
            yield _stack(batch.take(pa.array(order[start:end])), keys, cls)
            start = end


def _stack(batch: pa.RecordBatch, keys: tuple[str, ...], cls: int | None) -> pa.RecordBatch:
    """The strips of a batch, all of one width, above each other with their neighbouring lines between them."""
    y0, lines, top = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("y0", "lines", "top"))
    width = batch.column("width")[0].as_py()
    first = np.cumsum(lines + 2) - lines - 1  # the first own line of each strip
    image = np.zeros((int((lines + 2).sum()), width + 2), bool)
    own = np.zeros(len(image), bool)
    for i, data in enumerate(batch.column("data").to_pylist()):
        part = np.frombuffer(data, np.uint8).reshape(-1, width)
        at = first[i] - top[i]
        image[at : at + len(part), 1:-1] = part != 0 if cls is None else part == cls
        own[first[i] : first[i] + lines[i]] = True
    whole = image[1:-1, 1:-1]
    inner = np.zeros_like(image)
    inner[1:-1, 1:-1] = whole & image[:-2, 1:-1] & image[2:, 1:-1] & image[1:-1, :-2] & image[1:-1, 2:]
    image[~own] = False
    flat = image.ravel()
    step = np.diff(flat.view(np.int8))
    a, b = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1)  # lines end with an empty column, so no run crosses them
    seen = np.concatenate([[0], np.cumsum(inner.ravel(), dtype=np.int64)])
    rim = b - a + 1 - (seen[b + 1] - seen[a])
    line, x0, x1 = a // (width + 2), a % (width + 2) - 1, b % (width + 2) - 1
    strip = np.searchsorted(first, line, "right") - 1
    y = line - first[strip] + y0[strip]
    run = y * LINE + x0
    label = run[roots(line, x0, x1)]
    columns = [batch.column(k).take(pa.array(strip)) for k in keys]
    columns += [pa.array(v, t) for v, t in ((y, pa.int32()), (x0, pa.int32()), (x1, pa.int32()), (run, pa.int64()), (label, pa.int64()), (rim, pa.int32()))]
    return pa.record_batch(columns, names=[*keys, "y", "x0", "x1", "run", "label", "rim"])


def label_images(images: DataFrame, keys: tuple[str, ...] = IMAGE, tile: int = TILE, cls: int | None = None) -> DataFrame:
    """(keys, y, x0, x1, run, label, rim) of the pixels of class `cls`, or of all that are not zero; the label is the smallest run id of the component over the whole image."""
    rows = labelled_strips(images, keys, tile, cls)
    tall = images.where(F.col("height") > tile)
    if tall.isEmpty():  # there is no seam
        return rows
    return seamed(rows, labelled_strips(tall, keys, tile, cls), keys, tile)


def seamed(rows: DataFrame, parts: DataFrame, keys: tuple[str, ...], tile: int) -> DataFrame:
    """`rows` with the labels of strips joined where runs of `parts` touch across a seam."""
    upper = parts.where(F.col("y") % tile == tile - 1).select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("label").alias("a"))
    lower = parts.where((F.col("y") % tile == 0) & (F.col("y") > 0)).select(*keys, "y", "x0", "x1", "label")
    node = lambda label: F.struct(*keys, F.col(label).alias("label"))
    touch = upper.join(lower, [*keys, "y"]).where((F.col("x0") <= F.col("a1") + 1) & (F.col("a0") <= F.col("x1") + 1))
    roots = connected(touch.select(node("a").alias("a"), node("label").alias("b"))).select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.label").alias("label"), F.col("root.label").alias("_root"))
    names = rows.columns
    return rows.join(roots, [*keys, "label"], "left").withColumn("label", F.coalesce("_root", "label")).select(*names)


def geometry(labelled: DataFrame, keys: tuple[str, ...] = IMAGE, min_area: int = 10) -> DataFrame:
    """Largest component per image (the first in line order on ties): area, centre, box, diameter, perimeter and circularity, from two
    aggregates over runs on one key."""
    n = F.col("x1") - F.col("x0") + 1
    each = labelled.groupBy(*keys, "label").agg(
        F.sum(n).alias("area"), F.sum(n * (F.col("x0") + F.col("x1")) / 2).alias("_sx"), F.sum(n.cast("long") * F.col("y")).alias("_sy"), F.sum("rim").alias("perimeter"),
        F.min("x0").alias("bx0"), F.max("x1").alias("_bx1"), F.min("y").alias("by0"), F.max("y").alias("_by1"),
    )
    names = ["area", "_sx", "_sy", "perimeter", "bx0", "_bx1", "by0", "_by1"]
    best = each.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(-F.col("area"), F.col("label"))).alias("_b")).select(*keys, "_b.*").where(F.col("area") >= min_area)
    area, per = F.col("area"), F.col("perimeter")
    return best.select(
        *keys, "area", (F.col("_sx") / area).alias("cx"), (F.col("_sy") / area).alias("cy"), "bx0", "by0", (F.col("_bx1") - F.col("bx0") + 1).alias("bw"), (F.col("_by1") - F.col("by0") + 1).alias("bh"),
        (F.lit(2.0) * F.sqrt(area / F.lit(math.pi))).alias("diameter"), "perimeter", (F.lit(4.0 * math.pi) * area / (per * per)).alias("circularity"),
    )
