"""Audit of scanned images: one Arrow pass over the binary rows gives one summary row per image, and nothing is shuffled.

Rows are as the image scan gives them: keys, height, width, nChannels, data (lines top-down, colour bytes blue, green, red). An unreadable file
(height below 1, or data that do not fill the size) gives a row with `corrupt` and no figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuditSettings

# Luminance weights.
RGB = (0.299, 0.587, 0.114)
HASH = 8  # lines of the thumb, and bits per line
FIGURES = (
    "corrupt boolean, width int, height int, channels int, md5 string, dhash bigint, min_lum double, max_lum double, mean_lum double, std_lum double,"
    " classes array<int>, area bigint, iris_px bigint, pixels bigint, x0 int, y0 int, x1 int, y1 int"
)


def resampling(source: int, target: int, lobes: int = 3) -> np.ndarray:
    """Weights (target x source) of windowed-sinc resampling; when shrinking the window widens, so it also smooths."""
    scale = source / target
    wide = max(1.0, scale)
    centre = (np.arange(target) + 0.5) * scale
    x = (np.arange(source) + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(np.round(x, 6), 0, 255) + 0.5)


def thumb_hash(gray: np.ndarray) -> int:
    """64 bits, line by line: whether a pixel of the 9 x 8 thumb is brighter than its left neighbour; as a signed number."""
    h, w = gray.shape
    thumb = _bytes(gray)
    if w != HASH + 1:
        thumb = _bytes(thumb @ resampling(w, HASH + 1).T)
    if h != HASH:
        thumb = _bytes(resampling(h, HASH) @ thumb)
    bits = 0
    for bit in (thumb[:, 1:] > thumb[:, :-1]).ravel():
        bits = bits << 1 | int(bit)
    return bits - (1 << 64) if bits >> 63 else bits


def _figures(height: int | None, width: int | None, channels: int | None, data: bytes | None, cfg: AuditSettings) -> tuple:
    size = (height or 0) * (width or 0) * (channels or 0)
    if not size or min(height, width) < 1 or data is None or len(data) != size:
        return (True, *[None] * 17)
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    gray = a[..., 0].astype(float) if channels < 3 else a[..., 2] * RGB[0] + a[..., 1] * RGB[1] + a[..., 0] * RGB[2]
    counts = np.bincount(a.ravel(), minlength=256)
    hit = a[..., 0] == cfg.pupil_class
    ys, xs = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    box = [int(v) for v in (xs[0], ys[0], xs[-1], ys[-1])] if len(xs) else [0, 0, 0, 0]
    return (
        False, width, height, channels, hashlib.md5(data).hexdigest(), thumb_hash(gray), float(gray.min()), float(gray.max()), float(gray.mean()), float(gray.std()),
        np.flatnonzero(counts).tolist(), int(hit.sum()), int((a[..., 0] == cfg.iris_class).sum()), height * width, *box,
    )


def summaries(images: DataFrame, keys: tuple[str, ...] = ("split", "kind", "name"), cfg: AuditSettings = AuditSettings()) -> DataFrame:
    """Size, hashes, brightness, values in use, class areas and box of every image, in one pass over the binary rows."""
    rows = images.select(*keys, "height", "width", "nChannels", "data")
    schema = rows.select(*keys).schema
    full = type(schema)([*schema.fields, *_schema().fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kinds = len(keys), _arrow()
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                found = [_figures(*row, cfg) for row in zip(*(part.column(n + i).to_pylist() for i in range(4)), strict=True)]
                yield pa.record_batch([*part.columns[:n], *(pa.array([f[i] for f in found], k) for i, (_, k) in enumerate(kinds))], names=[*keys, *(name for name, _ in kinds)])

    return rows.mapInArrow(run, full)


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(FIGURES)


def _arrow() -> list[tuple[str, pa.DataType]]:
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return [(name, kinds[kind]) for name, kind in (part.split() for part in FIGURES.split(", "))]


def validity(images: DataFrame, masks: DataFrame, cfg: AuditSettings = AuditSettings(), keys: tuple[str, ...] = ("split", "name")) -> DataFrame:
    """Reasons why a pair of summaries is not usable. Pairs of a corrupt file have that reason alone, and stay in the result."""
    m = masks.select(*keys, *[F.col(c).alias(f"mask_{c}") for c in ("corrupt", "width", "height", "channels", "classes", "area", "iris_px", "pixels")])
    rows = images.join(m, list(keys))
    bad = F.array_except("mask_classes", F.array(*[F.lit(c) for c in cfg.classes]))
    read = F.array_compact(
        F.array(
            F.when((F.col("width") != cfg.width) | (F.col("height") != cfg.height), F.format_string("Invalid image dimensions: %dx%d", "width", "height")),
            F.when((F.col("mask_width") != F.col("width")) | (F.col("mask_height") != F.col("height")), F.lit("Mask dimensions do not match image")),
            F.when(F.col("mask_channels") != 1, F.lit("Mask is not single-channel 2D (ndim=3)")),
            F.when(F.size(bad) > 0, F.concat(F.lit("Mask contains invalid class values: ["), F.array_join(bad.cast("array<string>"), ", "), F.lit("]"))),
        )
    )
    reasons = F.when(F.col("corrupt"), F.array(F.lit("Corrupted image"))).when(F.col("mask_corrupt"), F.array(F.lit("Corrupted mask"))).otherwise(read)
    return rows.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def split_summary(checked: DataFrame) -> DataFrame:
    """Counts per split: pairs, valid ones, corrupt files and each kind of failure."""
    has = lambda text: F.count_if(F.exists("reasons", lambda r: r.startswith(text)))
    return checked.groupBy("split").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("is_valid").alias("valid"), has("Corrupted").alias("corrupted"), has("Invalid image").alias("bad_size"),
        has("Mask dim").alias("bad_mask_size"), has("Mask is not").alias("bad_channels"), has("Mask contains").alias("bad_values"),
    )
