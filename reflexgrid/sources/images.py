"""Image collections: scan, reject table, pixel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds.
AUDIT_EXTENSIONS = ("png", "jpg", "jpeg")
INSPECT_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff")


def _named(df: DataFrame, path: str) -> DataFrame:
    """Split, kind and name from .../<split>/<image|segmentation>/<name>."""
    p = F.col(path)
    return df.select(
        "*", F.regexp_extract(p, r"/([^/]+)/(?:image|segmentation)/[^/]+$", 1).alias("split"), F.regexp_extract(p, r"/(image|segmentation)/[^/]+$", 1).alias("kind"),
        F.regexp_extract(p, r"([^/]+)$", 1).alias("name"),
    )


def _is_image(extensions: tuple[str, ...]):
    return F.lower("name").rlike(r"\.(" + "|".join(extensions) + ")$") & ~F.col("name").startswith(".")


def scan_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = AUDIT_EXTENSIONS) -> DataFrame:
    """Decoded images below root; an unreadable file is a row of size -1."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root)
    named = _named(rows.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data"), "path")
    return named.where(_is_image(extensions))


def artifacts(spark: SparkSession, root: str, extensions: tuple[str, ...] = AUDIT_EXTENSIONS) -> DataFrame:
    """Files that are no images. The content column is never read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return _named(rows, "path").where(~_is_image(extensions)).select("split", "kind", "name", "length")


def corrupt(images: DataFrame) -> DataFrame:
    return images.where("height < 0").select("split", "kind", "name", "path")


def readable(images: DataFrame) -> DataFrame:
    return images.where("height > 0")


def to_pixels(images: DataFrame, keys: list[str]) -> DataFrame:
    """One row per byte: (keys, y, x, channel 0.., value). The hex text of an image is split JVM-side."""
    pairs = F.split(F.hex("data"), r"(?<=\G..)")
    rows = images.select(*keys, "width", "nChannels", F.posexplode(pairs).alias("i", "h")).where("h <> ''")
    line = F.col("width") * F.col("nChannels")
    return rows.select(
        *keys, F.floor(F.col("i") / line).cast("int").alias("y"), F.floor((F.col("i") % line) / F.col("nChannels")).cast("int").alias("x"),
        (F.col("i") % F.col("nChannels")).cast("int").alias("channel"), F.conv("h", 16, 10).cast("int").alias("value"),
    )


def gray_pixels(images: DataFrame, keys: list[str]) -> DataFrame:
    """Pixel rows with luminance; colour bytes are stored blue, green, red."""
    from ..operators.pixels import luminance

    px = to_pixels(images, keys)
    at = lambda c: F.max(F.when(F.col("channel") == c, F.col("value")))
    g = px.groupBy(*keys, "y", "x").agg(at(0).alias("b"), at(1).alias("g"), at(2).alias("r"))
    return g.select(*keys, "y", "x", F.when(F.col("g").isNull(), F.col("b").cast("double")).otherwise(luminance(F.col("r"), F.col("g"), F.col("b"))).alias("lum"))
