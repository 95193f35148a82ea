"""Queries on binary image rows, as the image scan gives them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.numeric import settle
from ...operators import scanned
from ...session import scratch
from .. import fixtures as fx
from .images import SMALL
from .registry import add
from .sql import cte, query, r, s

K = ["split", "name"]


def _binary(spark, sf):
    """8x8 gray images and masks as binary rows, written and read again, with marked faulty samples added to the given ones."""
    t = fx.thumbs(spark, sf).select("split", F.col("sample").alias("name"), "y", "x", F.floor(F.greatest(F.lit(0), F.least(F.lit(255), F.col("lum") / 2 + 128))).cast("int").alias("image"), fx.class_of(F.col("lum")).alias("segmentation"))
    hexed = lambda c: F.unhex(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("y", "x", c))), lambda p: F.lpad(F.hex(p[c]), 2, "0"))))
    both = t.groupBy(*K).agg(hexed("image").alias("image"), hexed("segmentation").alias("segmentation"))
    # the last octal digit of a name tells given samples (0) from added faults (1 to 6)
    rows = both.select("split", (F.col("name") * 8).alias("name"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.expr("stack(2, 'image', image, 'segmentation', segmentation) AS (kind, data)"))
    extra = lambda k: rows.where(F.col("name") / 8 % 7 == k).withColumn("name", F.col("name") + k + 1)
    seg = F.col("kind") == "segmentation"
    broken = extra(0).withColumn("height", F.when(~seg, -1).otherwise(F.col("height"))).withColumn("data", F.when(seg, F.col("data")))
    short = extra(1).withColumn("data", F.when(seg, F.substring("data", 1, 60)).otherwise(F.col("data")))
    wide = extra(2).withColumn("height", F.when(seg, 4).otherwise(8)).withColumn("width", F.when(seg, 16).otherwise(8))
    colour = extra(3).withColumn("height", F.when(seg, 4).otherwise(8)).withColumn("width", F.when(seg, 8).otherwise(8)).withColumn("nChannels", F.when(seg, 2).otherwise(1))
    large = extra(4).withColumn("height", F.lit(16)).withColumn("width", F.lit(4))
    odd = extra(5).withColumn("data", F.when(seg, F.concat(F.substring("data", 1, 63), F.unhex(F.lit("09")))).otherwise(F.col("data")))
    every = rows
    for part in (broken, short, wide, colour, large, odd):
        every = every.unionByName(part)
    path = scratch(spark, "images")
    every.write.parquet(path)
    return spark.read.schema(every.schema).parquet(path)


def _summaries(spark, sf):
    found = scanned.summaries(_binary(spark, sf), ("split", "kind", "name"), SMALL)
    return found.where("kind = 'image'").drop("kind"), found.where("kind = 'segmentation'").drop("kind")


GIVEN = "name % 8 = 0"
_given = lambda df: df.where(GIVEN).withColumn("name", F.expr("name div 8"))
cte("bytes", ("thumbs",), "SELECT split, sample AS name, y, x, CAST(floor(greatest(0, least(255, lum / 2 + 128))) AS INTEGER) AS b FROM thumbs")


def image_hashes64(spark, sf):
    return _given(_summaries(spark, sf)[0]).select(*K, "width", "height", "md5", "dhash")


# weights of the windowed sinc for 8 -> 9 columns; sinc(0) is 1
_SINC = lambda v: f"CASE WHEN {v} = 0 THEN 1e0 ELSE sin(pi() * ({v})) / (pi() * ({v})) END"
cte(
    "sinc9",
    (),
    f"""SELECT tx, x, w / sum(w) OVER (PARTITION BY tx) AS w FROM (SELECT tx, x, ({_SINC('d')}) * ({_SINC('d / 3e0')}) AS w
        FROM (SELECT CAST(a.range AS INT) AS tx, CAST(b.range AS INT) AS x, (b.range + 5e-1) - (a.range + 5e-1) * (8e0 / 9) AS d FROM range(9) a, range(8) b) WHERE abs(d) < 3)""",
)
add(
    "image_hashes64",
    image_hashes64,
    query(
        ("bytes", "sinc9"),
        f"""SELECT split, name, 8 AS width, 8 AS height, md5, dhash FROM (
              SELECT split, name, CAST(sum(CASE WHEN up THEN CASE WHEN y = 0 AND tx = 1 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (64 - (y * 8 + tx)) END ELSE 0 END) AS BIGINT) AS dhash
              FROM (SELECT split, name, y, tx, v > lag(v) OVER (PARTITION BY split, name, y ORDER BY tx) AS up FROM (
                SELECT split, name, y, tx, floor(greatest(0, least(255, {r('sum(b * w)', 6)})) + 5e-1) AS v FROM bytes JOIN sinc9 USING (x) GROUP BY ALL)) WHERE tx > 0 GROUP BY ALL)
            JOIN (SELECT split, name, md5(unhex(string_agg(printf('%02x', b), '' ORDER BY y, x))) AS md5 FROM bytes GROUP BY ALL) USING (split, name)""",
    ),
)


def image_summaries(spark, sf):
    images, masks = _summaries(spark, sf)
    both = _given(images).drop("classes").join(_given(masks).select(*K, F.array_join("classes", ",").alias("classes"), *[F.col(c).alias(f"pupil_{c}") for c in ("area", "x0", "y0", "x1", "y1")], F.col("iris_px").alias("iris_area")), K)
    return both.select(*K, "min_lum", "max_lum", settle(F.col("mean_lum"), 6).alias("mean_lum"), settle(F.col("std_lum"), 6).alias("std_lum"), F.col("classes"), "pupil_area", "iris_area", "pupil_x0", "pupil_y0", "pupil_x1", "pupil_y1")


# classes of the masks from the brightness, as the fixture defines them
cte("marked", ("thumbs",), "SELECT split, sample AS name, y, x, CASE WHEN lum > 20 THEN 2 WHEN lum > -50 THEN 3 WHEN lum > -120 THEN 1 ELSE 0 END AS class FROM thumbs")
add(
    "image_summaries",
    image_summaries,
    query(
        ("bytes", "marked"),
        f"""SELECT * FROM (SELECT split, name, min(b)::DOUBLE AS min_lum, max(b)::DOUBLE AS max_lum, {s('avg(b)', 6)} AS mean_lum, {s('stddev_pop(b)', 6)} AS std_lum FROM bytes GROUP BY ALL)
            JOIN (SELECT split, name, string_agg(DISTINCT class::VARCHAR, ',' ORDER BY class::VARCHAR) AS classes, count(*) FILTER (class = 2) AS pupil_area, count(*) FILTER (class = 3) AS iris_area,
                    coalesce(min(x) FILTER (class = 2), 0) AS pupil_x0, coalesce(min(y) FILTER (class = 2), 0) AS pupil_y0, coalesce(max(x) FILTER (class = 2), 0) AS pupil_x1, coalesce(max(y) FILTER (class = 2), 0) AS pupil_y1
                  FROM marked GROUP BY ALL) USING (split, name)""",
    ),
)


def split_counts(spark, sf):
    return scanned.split_summary(scanned.validity(*_summaries(spark, sf), SMALL))


def audit_from_images(spark, sf):
    """Pairs, valid ones and failures per split; one seventh of the samples occurs again with each kind of fault."""
    return split_counts(spark, sf)


add(
    "audit_from_images",
    audit_from_images,
    query(
        ("marked",),
        """SELECT split, count(*) + sum((name % 7 < 6)::INT)::BIGINT AS pairs, count(*) AS valid, count(*) FILTER (name % 7 IN (0, 1)) AS corrupted, count(*) FILTER (name % 7 = 4) AS bad_size,
             count(*) FILTER (name % 7 IN (2, 3)) AS bad_mask_size, count(*) FILTER (name % 7 = 3) AS bad_channels, count(*) FILTER (name % 7 = 5) AS bad_values
           FROM (SELECT DISTINCT split, name FROM marked) GROUP BY split""",
    ),
)


def corrupt_files(spark, sf):
    images, masks = _summaries(spark, sf)
    tag = lambda df, kind: df.where("corrupt").select("split", F.lit(kind).alias("kind"), "name")
    return tag(images, "image").unionByName(tag(masks, "segmentation"))


add(
    "corrupt_files",
    corrupt_files,
    query(
        ("marked",),
        """SELECT split, kind, name * 8 + name % 7 + 1 AS name FROM (SELECT DISTINCT split, name FROM marked WHERE name % 7 < 2), (VALUES ('image'), ('segmentation')) k(kind) WHERE kind = 'segmentation' AND name % 7 = 1 OR kind = 'image' AND name % 7 = 0""",
    ),
)
