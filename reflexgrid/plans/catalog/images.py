"""Queries on image and mask tables: geometry, components, resizing, dark-region search, audit, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...config import AuditSettings
from ...functions.numeric import half_up, settle
from ...operators import audit, bitmaps, components, image_pairs, masks, metrics, pixels, sketches
from ...operators.components import written
from .. import fixtures as fx
from .registry import add
from .sql import cte, query, r, rquery, s

K = ("split", "sample")
SMALL = AuditSettings(width=8, height=8, tiny_pupil_px=8, huge_pupil_px=28, low_std=115.0, hash_bits=56)


def rounded(df, cols, digits=6, keep=K):
    return df.select(*keep, *[settle(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns if c not in keep])


def _masks(spark, sf):
    return fx.masks(fx.thumbs(spark, sf))


# ---- mask geometry ----------------------------------------------------------------------------------
add(
    "mask_geometry",
    lambda spark, sf: rounded(masks.class_geometry(_masks(spark, sf), 2), ("cx", "cy", "aspect")),
    query(
        ("masks",),
        f"""SELECT split, sample, count(*) FILTER (class = 2) AS area, coalesce(min(x) FILTER (class = 2), 0) AS x0, coalesce(min(y) FILTER (class = 2), 0) AS y0,
            coalesce(max(x) FILTER (class = 2), 0) AS x1, coalesce(max(y) FILTER (class = 2), 0) AS y1, {s('coalesce(avg(x) FILTER (class = 2), 0e0)', 6)} AS cx,
            {s('coalesce(avg(y) FILTER (class = 2), 0e0)', 6)} AS cy, coalesce(max(x) FILTER (class = 2) - min(x) FILTER (class = 2) + 1, 0) AS width,
            coalesce(max(y) FILTER (class = 2) - min(y) FILTER (class = 2) + 1, 0) AS height,
            {s('coalesce((max(x) FILTER (class = 2) - min(x) FILTER (class = 2) + 1) / (max(y) FILTER (class = 2) - min(y) FILTER (class = 2) + 1)::DOUBLE, 0e0)', 6)} AS aspect
            FROM masks GROUP BY ALL""",
    ),
)
add(
    "boundary_contact",
    lambda spark, sf: masks.boundary_contact(_masks(spark, sf), 2, 8, 8),
    query(
        ("masks",),
        """SELECT split, sample, CAST(contact AS BIGINT) AS contact, contact > 0 AS box_touches, contact >= 10 AS touches FROM (SELECT split, sample,
           sum(CASE WHEN class = 2 THEN (x = 0)::INT + (x = 7)::INT + (y = 0)::INT + (y = 7)::INT ELSE 0 END) AS contact FROM masks GROUP BY ALL)""",
    ),
)
cte("pup", ("masks",), "SELECT split, sample, y, x FROM masks WHERE class = 2")
REACH = """SELECT split, sample, y, x, y * 8 + x AS root FROM pup UNION SELECT p.split, p.sample, p.y, p.x, r.root FROM reach r
   JOIN pup p ON p.split = r.split AND p.sample = r.sample AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1"""


def _labelled(spark, sf):
    return masks.component_runs(_masks(spark, sf).where("class = 2").select("split", "sample", "y", "x"))


add(
    "components",
    lambda spark, sf: _labelled(spark, sf).groupBy(*K, "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).select(
        *K, *[c.alias(n) for c, n in zip(components.label_pixel(F.col("label")), ("label_y", "label_x"))], "area"
    ),
    rquery(
        ("pup",), "reach", REACH,
        """SELECT split, sample, CAST(label // 8 AS INTEGER) AS label_y, CAST(label % 8 AS INTEGER) AS label_x, count(*) AS area
           FROM (SELECT split, sample, y, x, min(root) AS label FROM reach GROUP BY ALL) GROUP BY ALL""",
    ),
)
GEO = f"""SELECT split, sample, area, cx, cy, bx0, by0, bw, bh, 2e0 * sqrt(area / pi()) AS diameter, perimeter, 4e0 * pi() * area / (perimeter * perimeter)::DOUBLE AS circularity FROM (
   SELECT c.split, c.sample, count(*) AS area, avg(c.x) AS cx, avg(c.y) AS cy, min(c.x) AS bx0, min(c.y) AS by0, max(c.x) - min(c.x) + 1 AS bw, max(c.y) - min(c.y) + 1 AS bh,
     count(*) FILTER ((SELECT count(*) FROM comp d WHERE d.split = c.split AND d.sample = c.sample AND d.label = c.label AND abs(d.x - c.x) + abs(d.y - c.y) = 1) < 4) AS perimeter
   FROM comp c JOIN best b ON b.split = c.split AND b.sample = c.sample AND b.label = c.label GROUP BY ALL)"""
COMP = REACH + """), comp AS MATERIALIZED (SELECT split, sample, y, x, min(root) AS label FROM reach GROUP BY ALL),
   best AS MATERIALIZED (SELECT split, sample, label FROM (SELECT split, sample, label, count(*) AS n FROM comp GROUP BY ALL) WHERE n >= 10
     QUALIFY row_number() OVER (PARTITION BY split, sample ORDER BY n DESC, label) = 1"""


def _geometry(spark, sf, zoom=(1, 1)):
    return bitmaps.geometry(bitmaps.label_images(fx.thumb_images(spark, sf, zoom).withColumnRenamed("cls", "data"), cls=2))


add(
    "component_geometry",
    lambda spark, sf: rounded(_geometry(spark, sf), ("cx", "cy", "diameter", "circularity")),
    rquery(
        ("pup",), "reach", COMP,
        f"""SELECT split, sample, area, {s('cx', 6)} AS cx, {s('cy', 6)} AS cy, bx0, by0, bw, bh, {s('diameter', 6)} AS diameter, perimeter, {s('circularity', 6)} AS circularity FROM ({GEO})""",
    ),
)

# Each cell of an 8x8 image is 60 lines by 80 columns: rim pixels are those on its open sides.
_OPEN = lambda a, b: f"CASE WHEN EXISTS (SELECT 1 FROM comp d WHERE d.split = c.split AND d.sample = c.sample AND d.y = c.y + ({a}) AND d.x = c.x + ({b})) THEN 0 ELSE 1 END"
add(
    "component_geometry_640",
    lambda spark, sf: rounded(_geometry(spark, sf, (60, 80)), ("cx", "cy", "diameter", "circularity")),
    rquery(
        ("pup",), "reach", REACH + """), comp AS MATERIALIZED (SELECT split, sample, y, x, min(root) AS label FROM reach GROUP BY ALL),
           best AS MATERIALIZED (SELECT split, sample, label FROM (SELECT split, sample, label, count(*) AS n FROM comp GROUP BY ALL)
             QUALIFY row_number() OVER (PARTITION BY split, sample ORDER BY n DESC, label) = 1""",
        f"""SELECT split, sample, area, {s('cx', 6)} AS cx, {s('cy', 6)} AS cy, bx0, by0, bw, bh, {s('2e0 * sqrt(area / pi())', 6)} AS diameter, perimeter,
              {s('4e0 * pi() * area / (perimeter * perimeter)::DOUBLE', 6)} AS circularity
            FROM (SELECT split, sample, CAST(count(*) * 4800 AS BIGINT) AS area, (avg(x) + 5e-1) * 80 - 5e-1 AS cx, (avg(y) + 5e-1) * 60 - 5e-1 AS cy, CAST(min(x) * 80 AS INTEGER) AS bx0, CAST(min(y) * 60 AS INTEGER) AS by0,
                CAST((max(x) - min(x) + 1) * 80 AS INTEGER) AS bw, CAST((max(y) - min(y) + 1) * 60 AS INTEGER) AS bh, CAST(sum(4800 - (80 - l - r) * (60 - t - b)) AS BIGINT) AS perimeter
              FROM (SELECT c.*, {_OPEN(0, -1)} AS l, {_OPEN(0, 1)} AS r, {_OPEN(-1, 0)} AS t, {_OPEN(1, 0)} AS b FROM comp c JOIN best USING (split, sample, label)) GROUP BY split, sample)""",
    ),
)


def geometry_status(spark, sf):
    g = _geometry(spark, sf)
    status, conf = masks.geometry_status(F.col("circularity"), F.col("diameter"), F.lit(8.0))
    return g.select(*K, status.alias("status"), settle(conf, 3).alias("confidence"), settle(masks.area_confidence(F.col("circularity"), F.col("area")), 3).alias("confidence_b"))


add(
    "geometry_status",
    geometry_status,
    rquery(
        ("pup",), "reach", COMP,
        f"""SELECT split, sample, CASE WHEN ok THEN 'DETECTED' ELSE 'UNCERTAIN' END AS status, {s('CASE WHEN ok THEN c ELSE greatest(1e-1, c * 5e-1) END', 3)} AS confidence,
            {s('CASE WHEN area < 50 THEN c * 5e-1 ELSE c END', 3)} AS confidence_b
            FROM (SELECT *, least(1e0, circularity) AS c, least(1e0, circularity) >= 25e-2 AND diameter >= 4 AND diameter <= 8e0 * 85e-2 AS ok FROM ({GEO}))""",
    ),
)

# ---- resizing and filters ---------------------------------------------------------------------------
add(
    "resize_nearest",
    lambda spark, sf: pixels.resize_nearest(_masks(spark, sf), "class", (8, 8), (5, 6)),
    query(
        ("masks",),
        """SELECT m.split, m.sample, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, m.class FROM masks m, range(6) a(ty), range(5) b(tx)
           WHERE m.y = floor((ty + 5e-1) * (8e0 / 6)) AND m.x = floor((tx + 5e-1) * (8e0 / 5))""",
    ),
)


def resize_bilinear(spark, sf):
    out = pixels.resize_bilinear(fx.thumbs(spark, sf), (8, 8), (6, 4), crop=(0, 1, 8, 6))
    return out.select(*K, "y", "x", settle(F.col("lum"), 4).alias("lum"))


add(
    "resize_bilinear",
    resize_bilinear,
    query(
        ("thumbs",),
        f"""SELECT t.split, t.sample, CAST(g.ty AS INTEGER) AS y, CAST(g.tx AS INTEGER) AS x, {s('sum(t.lum * g.w)', 4)} AS lum FROM thumbs t JOIN (
              SELECT ty, tx, greatest(0, least(7, y1 + dy)) AS y, greatest(0, least(7, x1 + dx)) AS x, CASE WHEN dy = 0 THEN 1 - fy ELSE fy END * CASE WHEN dx = 0 THEN 1 - fx ELSE fx END AS w
              FROM (SELECT *, floor(sy)::INT AS y1, floor(sx)::INT AS x1, sy - floor(sy) AS fy, sx - floor(sx) AS fx
                    FROM (SELECT ty, tx, 1e0 + (ty + 5e-1) * (6e0 / 4) - 5e-1 AS sy, (tx + 5e-1) * (8e0 / 6) - 5e-1 AS sx FROM range(4) a(ty), range(6) b(tx))), range(2) c(dy), range(2) d(dx)
            ) g ON g.y = t.y AND g.x = t.x GROUP BY ALL""",
    ),
)
cte(
    "blurred",
    ("thumbs",),
    """SELECT a.split, a.sample, a.y, a.x, sum(b.lum * (2 - abs(a.x - b.x)) * (2 - abs(a.y - b.y))) / 16e0 AS lum FROM thumbs a
       JOIN thumbs b ON a.split = b.split AND a.sample = b.sample AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
       WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY ALL""",
)
add("blur3x3", lambda spark, sf: pixels.blur(fx.thumbs(spark, sf)), query(("blurred",), "SELECT split, sample, y, x, lum FROM blurred"))


def normalise(spark, sf):
    t = fx.thumbs(spark, sf)
    rows = pixels.normalise(t, "standard").withColumnRenamed("norm", "standard")
    return rows.select(
        *K, "y", "x", half_up(F.col("lum") / F.lit(255.0), 6).alias("minmax"), half_up(F.col("lum") / F.lit(127.5) - F.lit(1.0), 6).alias("bipolar"), settle(F.col("standard"), 5).alias("standard")
    )


add(
    "normalise",
    normalise,
    query(
        ("thumbs",),
        f"""SELECT split, sample, y, x, {r('lum / 255e0', 6)} AS minmax, {r('lum / 1275e-1 - 1e0', 6)} AS bipolar,
            {s('(lum - avg(lum) OVER (PARTITION BY split, sample)) / (stddev_pop(lum) OVER (PARTITION BY split, sample) + 1e-7)', 5)} AS standard FROM thumbs""",
    ),
)
cte("bright", ("thumbs",), "SELECT *, lum * 11e-1 AS lit FROM thumbs")
add(
    "augment_photometric",
    lambda spark, sf: pixels.adjust_light(fx.thumbs(spark, sf), F.lit(1.1), F.lit(0.95)).select(*K, "y", "x", settle(F.col("lum"), 4).alias("lum")),
    query(
        ("bright",),
        f"SELECT split, sample, y, x, {s('greatest(0e0, least(255e0, (lit - m) * 95e-2 + m))', 4)} AS lum FROM (SELECT *, avg(lit) OVER (PARTITION BY split, sample) AS m FROM bright)",
    ),
)
add(
    "augment_photometric_random",
    lambda spark, sf: pixels.adjust_light(
        fx.thumbs(spark, sf), pixels.random_factor(1, 0.92, 1.08), pixels.random_factor(2, 0.92, 1.08), noise_std=0.015, seed=3
    ).select(*K, "y", "x", "lum"),
)


def augment_geometric(spark, sf):
    """Flip, turn and shift of image and mask; some samples have all three."""
    odd = F.col("sample") % 2 == 1
    dx, dy = (F.col("sample") % 4 - 1).cast("int"), (F.col("sample") % 5 - 2).cast("int")
    turn = F.when(F.col("sample") % 3 == 0, F.lit(5.0)).when(F.col("sample") % 3 == 1, F.lit(-8.0)).otherwise(F.lit(0.0))
    how = dict(size=(8, 8), flip=odd, angle_deg=turn, dx=dx, dy=dy)
    t = fx.thumbs(spark, sf)
    image, mask = pixels.remap(t, "lum", **how), pixels.remap(fx.masks(t), "class", **how)
    return image.join(mask, [*K, "y", "x"])


_IN = "sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7"
add(
    "augment_geometric",
    augment_geometric,
    query(
        ("thumbs", "masks"),
        f"""SELECT split, sample, y, x, CASE WHEN {_IN} THEN ls[sy * 8 + sx + 1] ELSE 0e0 END AS lum, CASE WHEN {_IN} THEN cs[sy * 8 + sx + 1] ELSE 0 END AS class FROM (
              SELECT split, sample, ls, cs, y, x, floor({r('CASE WHEN sample % 2 = 1 THEN 8 - tx ELSE tx END', 9)})::INT AS sx, floor({r('ty', 9)})::INT AS sy FROM (
                SELECT *, cos(a) * cx + sin(a) * cy + 4e0 AS tx, -sin(a) * cx + cos(a) * cy + 4e0 AS ty FROM (
                  SELECT *, CASE sample % 3 WHEN 0 THEN -radians(5e0) WHEN 1 THEN radians(8e0) ELSE 0e0 END AS a, x - (sample % 4 - 1) - 35e-1 AS cx, y - (sample % 5 - 2) - 35e-1 AS cy
                  FROM (SELECT split, sample, list(lum ORDER BY y, x) AS ls FROM thumbs GROUP BY ALL) JOIN (SELECT split, sample, list(class ORDER BY y, x) AS cs FROM masks GROUP BY ALL) USING (split, sample),
                  (SELECT CAST(range // 8 AS INT) AS y, CAST(range % 8 AS INT) AS x FROM range(64)))))""",
    ),
)


def geometry_preservation(spark, sf):
    m = _masks(spark, sf)
    raw, new = masks.class_geometry(m, 2), masks.class_geometry(pixels.resize_nearest(m, "class", (8, 8), (4, 4)), 2)
    return masks.preservation(raw, new, 0.5, 0.5)


def _geo(source):
    c = "FILTER (class = 2)"
    return f"""SELECT split, sample, count(*) {c} AS area, coalesce(avg(x) {c}, 0e0) AS cx, coalesce(avg(y) {c}, 0e0) AS cy, coalesce(max(x) {c} - min(x) {c} + 1, 0) AS w,
       coalesce(max(y) {c} - min(y) {c} + 1, 0) AS h FROM {source} GROUP BY ALL"""


cte("half", ("masks",), "SELECT split, sample, y // 2 AS y, x // 2 AS x, class FROM masks WHERE y % 2 = 1 AND x % 2 = 1")
cte("geo_raw", ("masks",), _geo("masks"))
cte("geo_new", ("half",), _geo("half"))
add(
    "geometry_preservation",
    geometry_preservation,
    query(
        ("geo_raw", "geo_new"),
        f"""SELECT split, sample, raw_area, new_area, {r('new_area / greatest(raw_area, 1)', 4)} AS area_ratio, {r('nw / greatest(w, 1)', 4)} AS width_ratio,
              {r('nh / greatest(h, 1)', 4)} AS height_ratio, {r('err', 4)} AS aspect_error, {r('dist', 2)} AS centre_error_px, err < 1e-1 AND dist < 2 AS consistent
            FROM (SELECT a.split, a.sample, a.area AS raw_area, b.area AS new_area, a.w, a.h, b.w AS nw, b.h AS nh, abs(b.w / greatest(b.h, 1) - a.w / greatest(a.h, 1)) AS err,
                    sqrt((b.cx - a.cx * 5e-1) * (b.cx - a.cx * 5e-1) + (b.cy - a.cy * 5e-1) * (b.cy - a.cy * 5e-1)) AS dist
                  FROM geo_raw a JOIN geo_new b USING (split, sample))""",
    ),
)

# ---- dark-region search -----------------------------------------------------------------------------


def _disc(spark, sf):
    """Each step is written once, as the steps below read it several times; planned as one they would sort and blur again for every read, all in one task."""
    b = written(pixels.blur(fx.thumbs(spark, sf)), "blurred")
    iris = written(components.dealt(b.select(*K), K).distinct().select(*K, F.lit(3.5).alias("icx"), F.lit(3.5).alias("icy"), F.lit(3.4).alias("ir")), "iris")
    return iris, written(pixels.around_iris(b, iris), "disc")


cte("disc", ("blurred",), "SELECT *, (x - 35e-1) * (x - 35e-1) + (y - 35e-1) * (y - 35e-1) AS d2 FROM blurred WHERE (x - 35e-1) * (x - 35e-1) + (y - 35e-1) * (y - 35e-1) <= 34e-1 * 34e-1")
add(
    "iris_disc",
    lambda spark, sf: _disc(spark, sf)[1].groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("far")),
    query(("disc",), "SELECT split, sample, count(*) AS n, max(d2) AS far FROM disc GROUP BY ALL"),
)
cte(
    "seeds",
    ("disc",),
    "SELECT split, sample, x AS seed_x, y AS seed_y, lum AS seed_lum FROM disc WHERE d2 <= (34e-1 * 45e-2) * (34e-1 * 45e-2) QUALIFY row_number() OVER (PARTITION BY split, sample ORDER BY lum, y, x) = 1",
)
add("dark_seed", lambda spark, sf: pixels.dark_seed(_disc(spark, sf)[1]), query(("seeds",), "SELECT * FROM seeds"))
cte(
    "cuts",
    ("disc",),
    """SELECT split, sample, p05, stroma, greatest(0e0, (stroma - p05) / 255e0) AS contrast,
       CASE WHEN stroma - p05 > 15 THEN p05 + (stroma - p05) * 45e-2 WHEN stroma - p05 > 5 THEN p05 + (stroma - p05) * 55e-2 + 2e0 ELSE p05 + 8e0 END AS threshold
       FROM (SELECT split, sample, list_sort(list(lum))[CAST(floor(count(*) * 5e-2) AS INT) + 1] AS p05,
               list_sort(list(lum) FILTER (ring))[CAST(floor(count(*) FILTER (ring) * 5e-1) AS INT) + 1] AS stroma
             FROM (SELECT *, d2 >= (34e-1 * 5e-1) * (34e-1 * 5e-1) AND d2 <= (34e-1 * 95e-2) * (34e-1 * 95e-2) AS ring FROM disc) GROUP BY ALL)""",
)
add(
    "adaptive_threshold",
    lambda spark, sf: rounded(pixels.adaptive_threshold(_disc(spark, sf)[1]), ("p05", "stroma", "contrast", "threshold")),
    query(("cuts",), f"SELECT split, sample, {s('p05', 6)} AS p05, {s('stroma', 6)} AS stroma, {s('contrast', 6)} AS contrast, {s('threshold', 6)} AS threshold FROM cuts"),
)


def _region(spark, sf):
    iris, disc = _disc(spark, sf)
    cuts = written(pixels.adaptive_threshold(disc), "cuts")
    return iris, cuts, pixels.grow_region(disc, written(pixels.dark_seed(disc), "seeds"), cuts)


cte(
    "candidates",
    ("disc", "seeds", "cuts"),
    """SELECT d.*, threshold, x = seed_x AND y = seed_y AS is_seed, (d2 <= (34e-1 * 78e-2) * (34e-1 * 78e-2) AND (lum <= threshold OR (d2 <= (34e-1 * 38e-2) * (34e-1 * 38e-2) AND lum > 75))) OR (x = seed_x AND y = seed_y) AS cand,
       (x - seed_x) * (x - seed_x) + (y - seed_y) * (y - seed_y) <= (34e-1 * 35e-2) * (34e-1 * 35e-2) AND lum <= threshold + 4 AS near_dark
       FROM disc d JOIN seeds USING (split, sample) JOIN cuts USING (split, sample)""",
)
GROWN = """SELECT split, sample, y, x FROM candidates WHERE is_seed UNION SELECT c.split, c.sample, c.y, c.x FROM grown g
   JOIN candidates c ON c.split = g.split AND c.sample = g.sample AND abs(c.y - g.y) <= 1 AND abs(c.x - g.x) <= 1 AND c.cand), sized AS MATERIALIZED (
   SELECT split, sample, count(*) AS n FROM grown GROUP BY ALL), region AS MATERIALIZED (
   SELECT c.* FROM candidates c JOIN grown g USING (split, sample, y, x) JOIN sized z USING (split, sample) WHERE z.n >= 5
   UNION ALL SELECT c.* FROM candidates c JOIN sized z USING (split, sample) WHERE z.n < 5 AND near_dark"""
add("region_grow", lambda spark, sf: _region(spark, sf)[2].select(*K, "y", "x"), rquery(("candidates",), "grown", GROWN, "SELECT split, sample, y, x FROM region"))
MOMENTS = """SELECT split, sample, n, cx, cy, greatest(15e-1, sqrt(n / pi())) AS radius,
   greatest(2e0 * sqrt(greatest(1e0, (u20 + u02 + com) / 2)), greatest(15e-1, sqrt(n / pi())) * 9e-1) AS major_axis,
   greatest(2e0 * sqrt(greatest(1e0, (u20 + u02 - com) / 2)), greatest(15e-1, sqrt(n / pi())) * 7e-1) AS minor_axis, 5e-1 * atan2(2e0 * u11, u20 - u02) AS angle
   FROM (SELECT *, sqrt((u20 - u02) * (u20 - u02) + 4e0 * u11 * u11) AS com FROM (
     SELECT split, sample, count(*) AS n, any_value(cx) AS cx, any_value(cy) AS cy, avg((x - cx) * (x - cx)) AS u20, avg((y - cy) * (y - cy)) AS u02, avg((x - cx) * (y - cy)) AS u11
     FROM region JOIN (SELECT split, sample, sum(x * w) / sum(w) AS cx, sum(y * w) / sum(w) AS cy FROM (SELECT *, greatest(1e0, threshold - lum + 10) AS w FROM region) GROUP BY ALL) USING (split, sample)
     GROUP BY ALL)) WHERE n >= 4"""
add(
    "region_moments",
    lambda spark, sf: rounded(pixels.region_moments(_region(spark, sf)[2]), ("cx", "cy", "radius", "major_axis", "minor_axis"), 5).withColumn(
        "angle", half_up(F.abs(F.sin(F.col("angle") * 2)), 4)
    ),
    rquery(
        ("candidates",), "grown", GROWN,
        f"""SELECT split, sample, n, {s('cx', 5)} AS cx, {s('cy', 5)} AS cy, {s('radius', 5)} AS radius, {s('major_axis', 5)} AS major_axis, {s('minor_axis', 5)} AS minor_axis,
            {r('abs(sin(angle * 2))', 4)} AS angle FROM ({MOMENTS})""",
    ),
)


def pupil_detect(spark, sf):
    iris, cuts, region = _region(spark, sf)
    found = pixels.judge_region(written(pixels.region_moments(region), "moments"), iris, cuts)
    found = rounded(found, ("px_x", "px_y", "diameter_px", "circularity", "major_axis", "minor_axis", "contrast"), 4)
    return found.withColumn("angle", half_up(F.abs(F.sin(F.col("angle") * 2)), 4))


add(
    "pupil_detect",
    pupil_detect,
    rquery(
        ("candidates",), "grown", GROWN,
        f"""SELECT split, sample, CASE WHEN back OR odd OR weak THEN 'UNCERTAIN' ELSE 'DETECTED' END AS status, {s('CASE WHEN back THEN 35e-1 ELSE cx END', 4)} AS px_x,
              {s('CASE WHEN back THEN 35e-1 ELSE cy END', 4)} AS px_y, {s('rad * 2e0', 4)} AS diameter_px, {r('rad / 34e-1 * 117e-1', 2)} AS diameter_mm, {s('coalesce(rnd, 85e-2)', 4)} AS circularity,
              {s('CASE WHEN back THEN rad * 2e0 ELSE major_axis END', 4)} AS major_axis, {s('CASE WHEN back THEN rad * 2e0 ELSE minor_axis END', 4)} AS minor_axis, {s('contrast', 4)} AS contrast,
              {r('abs(sin(coalesce(angle, 0e0) * 2))', 4)} AS angle
            FROM (SELECT *, CASE WHEN back THEN greatest(2e0, 34e-1 * 35e-2) ELSE radius END AS rad FROM (
              SELECT *, n IS NULL OR (odd AND (off > 34e-1 * 85e-2 OR ratio < 8e-2 OR ratio > 92e-2)) AS back FROM (
                SELECT *, coalesce(off > 34e-1 * 55e-2 OR ratio NOT BETWEEN 12e-2 AND 8e-1, false) AS odd, coalesce(contrast < 2e-2 OR rnd < 25e-2, false) AS weak FROM (
                  SELECT c.split, c.sample, contrast, m.* EXCLUDE (split, sample), sqrt((cx - 35e-1) * (cx - 35e-1) + (cy - 35e-1) * (cy - 35e-1)) AS off, radius / 34e-1 AS ratio,
                    greatest(0e0, least(1e0, minor_axis / major_axis)) AS rnd FROM cuts c LEFT JOIN ({MOMENTS}) m USING (split, sample)))))""",
    ),
)

# ---- audit ------------------------------------------------------------------------------------------


def _files(spark, sf):
    name = lambda c: F.concat(F.lpad(F.col(c).cast("string"), 6, "0"), F.lit(".png"))
    split = F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train")
    images = fx.table(spark, sf, "documents").select(split.alias("split"), name("doc_id").alias("name"), "n_chars")
    masks_ = fx.table(spark, sf, "labels").select(split.alias("split"), name("doc_id").alias("name"), "quality", "doc_id")
    orphans = masks_.where("doc_id % 11 = 0").withColumn("name", F.concat(F.lit("x"), "name"))  # added, of no image
    return images, masks_.unionByName(orphans).drop("doc_id")


_file = "CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.png' AS name"
cte("image_files", (), f"SELECT {_file}, n_chars FROM documents")
cte("mask_files", (), f"SELECT {_file}, quality FROM labels UNION ALL SELECT split, 'x' || name, quality FROM (SELECT {_file}, quality, doc_id FROM labels) WHERE doc_id % 11 = 0")
add("pairing", lambda spark, sf: audit.pair_files(*_files(spark, sf)), query(("image_files", "mask_files"), "SELECT split, name, n_chars, quality FROM image_files JOIN mask_files USING (split, name)"))
add(
    "pair_counts",
    lambda spark, sf: audit.pair_counts(*_files(spark, sf)),
    query(
        ("image_files", "mask_files"),
        """SELECT split, images, masks, images = masks AS equal FROM (SELECT split, count(*) AS images FROM image_files GROUP BY 1) JOIN (SELECT split, count(*) AS masks FROM mask_files GROUP BY 1) USING (split)""",
    ),
)
add("missing_masks", lambda spark, sf: audit.missing_masks(*_files(spark, sf)).select("split", "name"), query(("image_files", "mask_files"), "SELECT split, name FROM image_files EXCEPT SELECT split, name FROM mask_files"))
add("orphan_masks", lambda spark, sf: audit.orphan_masks(*_files(spark, sf)).select("split", "name"), query(("image_files", "mask_files"), "SELECT split, name FROM mask_files EXCEPT SELECT split, name FROM image_files"))
add(
    "name_setops",
    lambda spark, sf: audit.name_sets(*_files(spark, sf)).groupBy("split", "found_in").agg(F.count(F.lit(1)).alias("names")),
    query(
        ("image_files", "mask_files"),
        """SELECT split, CASE WHEN i.name IS NULL THEN 'mask' WHEN m.name IS NULL THEN 'image' ELSE 'both' END AS found_in, count(*) AS names
           FROM image_files i FULL JOIN mask_files m USING (split, name) GROUP BY ALL""",
    ),
)
add(
    "class_distribution",
    lambda spark, sf: audit.class_counts(_masks(spark, sf), ("split",)),
    query(
        ("masks",),
        f"SELECT split, class, pixels, {r('pixels / t * 100e0', 4)} AS percent FROM (SELECT split, class, count(*) AS pixels FROM masks GROUP BY ALL) JOIN (SELECT split, count(*) AS t FROM masks GROUP BY ALL) USING (split)",
    ),
)
add(
    "class_counts",
    lambda spark, sf: audit.class_counts(_masks(spark, sf)),
    query(("masks",), f"SELECT split, sample, class, count(*) AS pixels, {r('count(*) / 64 * 100e0', 4)} AS percent FROM masks GROUP BY ALL"),
)
add(
    "class_rollup",
    lambda spark, sf: audit.class_rollup(_masks(spark, sf)),
    query(("masks",), "SELECT split, class, count(*) AS pixels FROM masks GROUP BY GROUPING SETS ((split, class), (class))"),
)
add(
    "combined_areas",
    lambda spark, sf: audit.split_rollup(_masks(spark, sf)),
    query(("masks",), "SELECT split, CAST(grouping(split) AS BIGINT) AS level, count(*) AS pixels, count(*) FILTER (class = 2) AS pupil_pixels FROM masks GROUP BY ROLLUP (split)"),
)


def _areas(spark, sf):
    return audit.class_areas(_masks(spark, sf), 2)


cte("areas", ("masks",), "SELECT split, sample, count(*) FILTER (class = 2) AS area, count(*) AS pixels FROM masks GROUP BY ALL")
add(
    "area_stats",
    lambda spark, sf: (lambda d: d.select("split", "samples", "min_px", "max_px", "min_pct", "max_pct", *[settle(F.col(c), 4).alias(c) for c in ("mean_px", "median_px", "std_px", "mean_pct")]))(
        audit.area_stats(_areas(spark, sf), ["split"])
    ),
    query(
        ("areas",),
        f"""SELECT split, count(*) AS samples, min(area) AS min_px, max(area) AS max_px, {s('avg(area)', 4)} AS mean_px, {s('median(area)', 4)} AS median_px, {s('stddev_pop(area)', 4)} AS std_px,
            min(pct) AS min_pct, max(pct) AS max_pct, {s('avg(pct)', 4)} AS mean_pct FROM (SELECT *, {r('area / pixels * 100e0', 4)} AS pct FROM areas) GROUP BY split""",
    ),
)


def area_percentiles(spark, sf):
    a = _areas(spark, sf)
    both = audit.area_percentiles(a, ["split"]).unionByName(audit.area_percentiles(a.withColumn("split", F.lit("combined")), ["split"]))
    return both.select("split", *[settle(F.col(f"p{p}"), 6).alias(f"p{p}") for p in audit.PERCENTS])


add(
    "area_percentiles",
    area_percentiles,
    query(
        ("areas",),
        f"""SELECT coalesce(split, 'combined') AS split, {', '.join(f"{s(f'quantile_cont(area, {p / 100}::DOUBLE)', 6)} AS p{p}" for p in audit.PERCENTS)} FROM areas GROUP BY ROLLUP (split)""",
    ),
)
add(
    "distinct_values",
    lambda spark, sf: audit.distinct_values(_masks(spark, sf)).select("split", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"), "samples"),
    query(("masks",), "SELECT split, array_to_string(list_sort(list(DISTINCT class)), ',') AS classes, count(DISTINCT sample) AS samples FROM masks GROUP BY split"),
)


def _raw_masks(spark, sf):
    """Masks as found: some carry an unknown class, some have a line too many."""
    t = fx.thumbs(spark, sf)
    odd = t.select(*K, "y", "x", F.when(F.col("lum") < -330, F.lit(7)).otherwise(fx.class_of(F.col("lum"))).alias("class"))
    return t, odd.unionByName(odd.where("sample % 13 = 0 and y = 7").withColumn("y", F.lit(8)))


cte(
    "raw_masks",
    ("thumbs",),
    "SELECT split, sample, y, x, CASE WHEN lum < -330 THEN 7 WHEN lum > 20 THEN 2 WHEN lum > -50 THEN 3 WHEN lum > -120 THEN 1 ELSE 0 END AS class FROM (SELECT * FROM thumbs UNION ALL SELECT * REPLACE (8 AS y) FROM thumbs WHERE sample % 13 = 0 AND y = 7)",
)
add(
    "illegal_values",
    lambda spark, sf: audit.illegal_values(_raw_masks(spark, sf)[1]).select(*K, F.array_join(F.col("illegal").cast("array<string>"), ",").alias("illegal")),
    query(("raw_masks",), "SELECT split, sample, string_agg(DISTINCT class, ',') AS illegal FROM raw_masks WHERE class NOT IN (0, 1, 2, 3) GROUP BY ALL"),
)


def _checked(spark, sf):
    return audit.validity(*_raw_masks(spark, sf), SMALL)


cte(
    "checked",
    ("raw_masks",),
    """SELECT split, sample, concat_ws('; ', CASE WHEN max(y) <> 7 THEN 'Mask dimensions do not match image' END,
         CASE WHEN count(*) FILTER (class > 3) > 0 THEN 'Mask contains invalid class values: [' || string_agg(DISTINCT class, ', ') FILTER (class > 3) || ']' END) AS reasons
       FROM raw_masks GROUP BY ALL""",
)
add(
    "validity_reasons",
    lambda spark, sf: _checked(spark, sf).select(*K, F.array_join("reasons", "; ").alias("reasons"), "is_valid"),
    query(("checked",), "SELECT split, sample, reasons, reasons = '' AS is_valid FROM checked"),
)
add(
    "load_checks",
    lambda spark, sf: audit.split_checks(_checked(spark, sf)),
    query(
        ("checked",),
        """SELECT split, count(*) AS pairs, bool_and(reasons = '') AS passed, 0::BIGINT AS bad_size, count(*) FILTER (contains(reasons, 'Mask dim')) AS bad_mask_size,
           count(*) FILTER (contains(reasons, 'Mask contains')) AS bad_values FROM checked GROUP BY split""",
    ),
)
cte("istats", ("thumbs",), "SELECT split, sample, min(lum) AS mn, max(lum) AS mx, avg(lum) AS av, stddev_pop(lum) AS sd FROM thumbs GROUP BY ALL")
cte(
    "iflags",
    ("istats",),
    f"""SELECT *, CASE WHEN mx = 0 OR av < 1 THEN 'COMPLETELY_BLACK' WHEN mn = 255 OR av > 254 THEN 'COMPLETELY_WHITE'
        WHEN {r('sd', 9)} < 115 THEN printf('EXTREMELY_LOW_VARIANCE (std=%.2f)', {s('sd', 2)}) ELSE '' END AS flags FROM istats""",
)


def _image_flags(spark, sf):
    return pixels.image_flags(pixels.image_stats(fx.thumbs(spark, sf)), SMALL)


add(
    "image_flags",
    lambda spark, sf: _image_flags(spark, sf).select(*K, "min_lum", "max_lum", settle(F.col("mean_lum"), 2).alias("mean_lum"), settle(F.col("std_lum"), 2).alias("std_lum"), F.array_join("flags", "; ").alias("flags")),
    query(("iflags",), f"SELECT split, sample, mn AS min_lum, mx AS max_lum, {s('av', 2)} AS mean_lum, {s('sd', 2)} AS std_lum, flags FROM iflags"),
)


def _mask_flags(spark, sf):
    m = _masks(spark, sf)
    return audit.mask_flags(masks.class_geometry(m, 2), audit.class_areas(m, 3), audit.class_areas(m, 2), SMALL)


cte(
    "mflags",
    ("masks",),
    f"""SELECT split, sample, a AS area, i AS iris_px, concat_ws('; ', CASE WHEN a = 0 THEN 'NO_PUPIL_PIXELS' END, CASE WHEN edge > 0 THEN 'PUPIL_TOUCHES_IMAGE_BOUNDARY' END,
          CASE WHEN a > 0 AND a < 8 THEN printf('TINY_PUPIL (%d px, %s%%)', a, CAST({r('a / 64 * 100e0', 4)} AS DOUBLE)::VARCHAR) WHEN a > 28 THEN printf('HUGE_PUPIL (%d px, %s%%)', a, CAST({r('a / 64 * 100e0', 4)} AS DOUBLE)::VARCHAR) END,
          CASE WHEN i = 0 THEN 'NO_IRIS_PIXELS' WHEN a > i THEN printf('PUPIL_LARGER_THAN_IRIS (pupil=%d, iris=%d)', a, i) END) AS flags
        FROM (SELECT split, sample, count(*) FILTER (class = 2) AS a, count(*) FILTER (class = 3) AS i, count(*) FILTER (class = 2 AND (x IN (0, 7) OR y IN (0, 7))) AS edge FROM masks GROUP BY ALL)""",
)
add(
    "mask_flags",
    lambda spark, sf: _mask_flags(spark, sf).select(*K, "area", "iris_px", F.array_join("flags", "; ").alias("flags")),
    query(("mflags",), "SELECT * FROM mflags"),
)
add(
    "review_union",
    lambda spark, sf: audit.review_list(_image_flags(spark, sf), _mask_flags(spark, sf)),
    query(("iflags", "mflags"), "SELECT split, sample, 'IMAGE_QUALITY' AS type, flags FROM iflags WHERE flags <> '' UNION ALL SELECT split, sample, 'MASK_ANOMALY', flags FROM mflags WHERE flags <> ''"),
)
add(
    "review_top",
    lambda spark, sf: audit.first_rows(audit.review_list(_image_flags(spark, sf), _mask_flags(spark, sf)), ["split", "sample", "type"], 25),
    query(
        ("iflags", "mflags"),
        """SELECT split, sample, type, flags, (SELECT greatest(count(*) - 25, 0) FROM listed) AS more FROM listed ORDER BY split, sample, type LIMIT 25""",
    ).replace("\nSELECT split", """, listed AS (SELECT split, sample, 'IMAGE_QUALITY' AS type, flags FROM iflags WHERE flags <> '' UNION ALL SELECT split, sample, 'MASK_ANOMALY', flags FROM mflags WHERE flags <> '')\nSELECT split""", 1),
)
add(
    "first_names",
    lambda spark, sf: audit.first_rows(audit.missing_masks(*_files(spark, sf)).select("split", "name"), ["name"], 10),
    query(
        ("image_files", "mask_files"),
        """SELECT split, name, (SELECT count(*) FROM image_files WHERE name NOT IN (SELECT name FROM mask_files)) - 10 AS more FROM image_files WHERE name NOT IN (SELECT name FROM mask_files) ORDER BY name LIMIT 10""",
    ),
)
add(
    "augment_geometric_bilinear",
    lambda spark, sf: pixels.remap(fx.thumbs(spark, sf), "lum", (8, 8), F.lit(False), F.lit(5.0), F.lit(1), F.lit(0), "bilinear").select(*K, "y", "x", settle(F.col("lum"), 4).alias("lum")),
    query(
        ("thumbs",),
        f"""SELECT g.split, g.sample, g.y, g.x, {s("coalesce(sum(t.lum * g.w), 0e0)", 4)} AS lum FROM (
              SELECT *, greatest(0, least(7, by_ + i)) AS sy, greatest(0, least(7, bx_ + j)) AS sx, CASE WHEN i = 1 THEN ay - 5e-1 - by_ ELSE 1 - (ay - 5e-1 - by_) END * CASE WHEN j = 1 THEN ax - 5e-1 - bx_ ELSE 1 - (ax - 5e-1 - bx_) END AS w
              FROM (SELECT *, floor(ay - 5e-1)::INT AS by_, floor(ax - 5e-1)::INT AS bx_ FROM (
                SELECT split, sample, y, x, {r("cos(-radians(5e0)) * (x - 1 - 35e-1) + sin(-radians(5e0)) * (y - 35e-1) + 4e0", 9)} AS ax, {r("-sin(-radians(5e0)) * (x - 1 - 35e-1) + cos(-radians(5e0)) * (y - 35e-1) + 4e0", 9)} AS ay FROM thumbs)),
                range(2) a(i), range(2) b(j)) g
            LEFT JOIN thumbs t ON t.split = g.split AND t.sample = g.sample AND t.y = g.sy AND t.x = g.sx AND g.ax >= 0 AND g.ax < 8 AND g.ay >= 0 AND g.ay < 8 GROUP BY ALL""",
    ),
)
add(
    "audit_summary",
    lambda spark, sf: audit.run_summary(_checked(spark, sf), audit.review_list(_image_flags(spark, sf), _mask_flags(spark, sf))),
    query(
        ("checked", "iflags", "mflags"),
        """SELECT count(*) FILTER (split = 'train') AS original_train, count(*) FILTER (split = 'val') AS original_val, count(*) FILTER (split = 'train' AND reasons = '') AS clean_train,
           count(*) FILTER (split = 'val' AND reasons = '') AS clean_val, count(*) FILTER (contains(reasons, 'Mask contains')) AS invalid_masks,
           (SELECT count(*) FROM iflags WHERE flags <> '') + (SELECT count(*) FROM mflags WHERE flags <> '') AS manual_review,
           CASE WHEN count(*) FILTER (split = 'train' AND reasons = '') > 0 THEN 'READY FOR PREPROCESSING' ELSE 'NOT READY' END AS status FROM checked""",
    ),
)


def _document_hashes(spark, sf):
    split = F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train")
    return fx.table(spark, sf, "documents").select(split.alias("split"), F.col("doc_id").alias("sample"), F.md5("text").alias("md5"))


add(
    "exact_duplicates",
    lambda spark, sf: audit.duplicate_groups(_document_hashes(spark, sf), "md5", "sample", ["split"]),
    "SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, md5(text) AS md5, count(*) AS copies, min(doc_id) AS first_name FROM documents GROUP BY ALL HAVING count(*) > 1",
)
add(
    "duplicate_members",
    lambda spark, sf: audit.duplicate_members(_document_hashes(spark, sf), "md5", "sample", ["split"]),
    """SELECT split, md5, sample, first_name, copies FROM (SELECT *, count(*) OVER (PARTITION BY split, md5) AS copies, min(sample) OVER (PARTITION BY split, md5) AS first_name
       FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, md5(text) AS md5, doc_id AS sample FROM documents)) WHERE copies > 1""",
)


def _hashed(spark, sf):
    t = fx.thumbs(spark, sf)
    subject = t.groupBy(*K).agg(F.min("subject").alias("subject"))
    return pixels.difference_hash(t, 8, 8).join(pixels.content_hash(t), list(K)).join(subject, list(K))


cte(
    "hashed",
    ("thumbs",),
    """SELECT split, sample, any_value(subject) AS subject, CAST(sum(CASE WHEN up THEN 1::BIGINT << (55 - (y * 7 + x)) ELSE 0 END) AS BIGINT) AS dhash, md5(string_agg(CAST(lum AS BIGINT), ',' ORDER BY y, x)) AS md5
       FROM (SELECT *, lead(lum) OVER (PARTITION BY split, sample, y ORDER BY x) > lum AS up FROM thumbs) GROUP BY split, sample""",
)
add("dhash", lambda spark, sf: _hashed(spark, sf), query(("hashed",), "SELECT * FROM hashed"))
add(
    "leak_exact",
    lambda spark, sf: audit.exact_leaks(_hashed(spark, sf)),
    query(
        ("hashed",),
        """SELECT v.sample AS val_sample, min(t.sample) AS first_train, count(*) AS train_copies, 1e0 AS similarity, 0 AS distance FROM hashed v JOIN hashed t ON v.md5 = t.md5
           WHERE v.split = 'val' AND t.split = 'train' GROUP BY v.sample""",
    ),
)
add(
    "leak_perceptual",
    lambda spark, sf: audit.near_leaks(_hashed(spark, sf), bits=SMALL.hash_bits),
    query(
        ("hashed",),
        f"""SELECT val_hash, train_hash, CAST(distance AS INTEGER) AS distance, pairs, (SELECT min(sample) FROM hashed h WHERE h.split = 'val' AND h.dhash = val_hash) AS val_first,
              (SELECT min(sample) FROM hashed h WHERE h.split = 'train' AND h.dhash = train_hash) AS train_first, {r('(64 - distance) / 64e0', 4)} AS similarity
            FROM (SELECT v.dhash AS val_hash, t.dhash AS train_hash, bit_count(xor(v.dhash, t.dhash)) AS distance, count(*) AS pairs FROM hashed v, hashed t
                  WHERE v.split = 'val' AND t.split = 'train' AND v.md5 <> t.md5 AND bit_count(xor(v.dhash, t.dhash)) <= 2 GROUP BY ALL)""",
    ),
)


def _hashed_leaks(spark, sf):
    h = _hashed(spark, sf)
    return h, audit.near_leaks(h, bits=SMALL.hash_bits)


def _near_pairs(spark, sf):
    h, leaks = _hashed_leaks(spark, sf)
    return h, audit.expand_pairs(leaks, h)


cte(
    "near_pairs",
    ("hashed",),
    f"""SELECT v.sample AS val_sample, t.sample AS train_sample, CAST(bit_count(xor(v.dhash, t.dhash)) AS INTEGER) AS distance, {r('(64 - bit_count(xor(v.dhash, t.dhash))) / 64e0', 4)} AS similarity,
          v.subject = t.subject AS same_subject
        FROM (SELECT split, dhash, md5, min(sample) AS sample, arg_min(subject, sample) AS subject FROM hashed GROUP BY ALL) v, (SELECT split, dhash, md5, min(sample) AS sample, arg_min(subject, sample) AS subject FROM hashed GROUP BY ALL) t
        WHERE v.split = 'val' AND t.split = 'train' AND v.md5 <> t.md5 AND bit_count(xor(v.dhash, t.dhash)) <= 2""",
)
add("leak_pairs", lambda spark, sf: _near_pairs(spark, sf)[1], query(("near_pairs",), "SELECT val_sample, train_sample, distance, similarity FROM near_pairs"))
add("leak_subjects", lambda spark, sf: audit.subject_overlap(_hashed(spark, sf)), query(("hashed",), "SELECT subject, count(*) FILTER (split = 'train') AS train_n, count(*) FILTER (split = 'val') AS val_n FROM hashed GROUP BY 1 HAVING train_n > 0 AND val_n > 0"))


def leak_review(spark, sf):
    h, near = _near_pairs(spark, sf)
    pairs = near.select(F.col("val_sample").alias("pair_a"), F.col("train_sample").alias("pair_b"))
    who = lambda s, split: h.where(F.col("split") == split).select(F.col("sample").alias(f"pair_{s}"), F.col("subject").alias(f"subject_{s}"))
    m = image_pairs.pair_metrics(pairs, fx.thumb_images(spark, sf)).join(who("a", "val"), "pair_a").join(who("b", "train"), "pair_b")
    kind, advice = masks.leak_class(F.col("subject_a") == F.col("subject_b"), F.col("mae"), F.col("dice"))
    return m.select("pair_a", "pair_b", *[settle(F.col(c), 4).alias(c) for c in ("mae", "rmse", "max_diff", "pearson", "iou", "dice")], kind.alias("classification"), advice.alias("recommendation"))


add(
    "leak_review",
    leak_review,
    query(
        ("near_pairs", "thumbs", "masks"),
        f"""SELECT pair_a, pair_b, {s('mae', 4)} AS mae, {s('rmse', 4)} AS rmse, {s('max_diff', 4)} AS max_diff, {s('pearson', 4)} AS pearson, {s('iou', 4)} AS iou, {s('dice', 4)} AS dice,
              CASE WHEN same_subject AND mae < 3 AND dice > 95e-2 THEN 'LIKELY_DUPLICATE' WHEN same_subject THEN 'LIKELY_SAME_SEQUENCE / NEAR_DUPLICATE' ELSE 'LIKELY_DIFFERENT_SAMPLE' END AS classification,
              CASE WHEN same_subject THEN 'REMOVE_FROM_VALIDATION' ELSE 'KEEP' END AS recommendation
            FROM (SELECT val_sample AS pair_a, train_sample AS pair_b, same_subject, avg(abs(a.lum - b.lum)) AS mae, sqrt(avg((a.lum - b.lum) * (a.lum - b.lum))) AS rmse, max(abs(a.lum - b.lum)) AS max_diff,
                    corr(a.lum, b.lum) AS pearson, count(*) FILTER (ma.class = 2 AND mb.class = 2) / greatest(1, count(*) FILTER (ma.class = 2 OR mb.class = 2)) AS iou,
                    2e0 * count(*) FILTER (ma.class = 2 AND mb.class = 2) / greatest(1, count(*) FILTER (ma.class = 2) + count(*) FILTER (mb.class = 2)) AS dice
                  FROM near_pairs p JOIN thumbs a ON a.split = 'val' AND a.sample = val_sample JOIN thumbs b ON b.split = 'train' AND b.sample = train_sample AND a.y = b.y AND a.x = b.x
                  JOIN masks ma ON ma.split = 'val' AND ma.sample = a.sample AND ma.y = a.y AND ma.x = a.x JOIN masks mb ON mb.split = 'train' AND mb.sample = b.sample AND mb.y = a.y AND mb.x = a.x GROUP BY ALL)""",
    ),
)


_MARKS = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


def length_sketches(spark, sf):
    """Sketches per split and day, kept as a table and merged by split: whether the estimates lie within their stated bounds of the exact figures."""
    split = F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train")
    docs = fx.table(spark, sf, "documents").select(split.alias("split"), (F.col("doc_id") % 30).alias("day"), F.col("doc_id").cast("string").alias("name"), "n_chars")
    kept = written(sketches.sketched(docs, ["split", "day"], "name", "n_chars"), "sketches")
    found = sketches.figures(sketches.merged(kept, ["split"]), ["split"], _MARKS)
    share = lambda c: F.count_if(c) / F.count("n_chars")
    ranks = [f(F.col("n_chars"), F.col(f"_{m}")) for m in _MARKS for f in (lambda a, b: share(a < b), lambda a, b: share(a <= b))]
    named = [c.alias(f"{side}_{m}") for c, (m, side) in zip(ranks, [(m, side) for m in _MARKS for side in ("low", "high")], strict=True)]
    exact = docs.join(found.select("split", *[F.col(m).alias(f"_{m}") for m in _MARKS]), "split").groupBy("split").agg(F.count_distinct("name").alias("names"), *named)
    near = [((F.col(f"low_{m}") <= q + 0.0266) & (F.col(f"high_{m}") >= q - 0.0266)).alias(f"{m}_near") for m, q in _MARKS.items()]
    return found.join(exact, "split").select("split", "n", (F.abs(F.col("distinct") - F.col("names")) <= F.col("names") * 0.05).alias("distinct_near"), *near)


add(
    "length_sketches",
    length_sketches,
    "SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, true AS distinct_near, true AS p05_near, true AS p50_near, true AS p95_near FROM documents GROUP BY 1",
)


def representatives(spark, sf):
    m = _masks(spark, sf).where("split = 'train'")
    touch = masks.boundary_contact(m, 2, 8, 8, min_contact=3).select(*K, "touches")
    rows = audit.class_areas(m, 2).join(audit.class_areas(m, 3).select(*K, F.col("area").alias("iris_area")), list(K)).join(touch, list(K))
    return audit.representatives(rows, {"small": (6, 9), "medium": (18, 20), "large": (30, 40)}, 2, 8)


cte(
    "picks",
    ("masks",),
    """SELECT sample, count(*) FILTER (class = 2) AS area, count(*) FILTER (class = 3) AS iris_area,
         sum(CASE WHEN class = 2 THEN (x = 0)::INT + (x = 7)::INT + (y = 0)::INT + (y = 7)::INT ELSE 0 END) >= 3 AS touches FROM masks WHERE split = 'train' GROUP BY sample HAVING area >= 2""",
)
_first = lambda kind, cond, order: f"SELECT '{kind}' AS kind, sample, area FROM (SELECT *, ({cond}) AS hit FROM picks) ORDER BY hit DESC, {order} LIMIT 1"
add(
    "representatives",
    representatives,
    query(
        ("picks",),
        f"""({_first('small', 'area BETWEEN 6 AND 9', 'area, sample')}) UNION ALL ({_first('large', 'area BETWEEN 30 AND 40', 'area DESC, sample DESC')})
            UNION ALL SELECT * FROM (WITH hit AS (SELECT *, row_number() OVER (ORDER BY area, sample) AS k, count(*) OVER () AS n FROM picks WHERE area BETWEEN 18 AND 20)
                SELECT 'medium', sample, area FROM hit WHERE k = n // 2 + 1)
            UNION ALL (SELECT 'boundary', sample, area FROM picks WHERE touches AND area > 8 ORDER BY sample LIMIT 1)
            UNION ALL (SELECT 'unusual', sample, area FROM picks ORDER BY area / greatest(iris_area, 1) DESC, sample LIMIT 1)""",
    ),
)
add(
    "linspace_pick",
    lambda spark, sf: audit.evenly_spaced(fx.table(spark, sf, "documents").select("doc_id"), "doc_id", 6).select("k", "doc_id"),
    """SELECT k, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), (SELECT CAST(range AS INTEGER) AS k FROM range(6))
       WHERE i = floor(k * (n - 1) / 5e0)""",
)
CANDIDATES = ((256, 192), (320, 240), (256, 256))


def resolution_matrix(spark, sf):
    """Candidate model sizes against every image size in use."""
    found = audit.sizes(_raw_masks(spark, sf)[1]).groupBy("width", "height").agg(F.count(F.lit(1)).alias("images"))
    options = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in CANDIDATES])).alias("c")
    rows = found.select("width", "height", "images", options)
    match = F.abs(F.col("c.w") / F.col("c.h") - F.col("width") / F.col("height")) < 0.01
    return rows.select(
        "width", "height", "images", F.col("c.w").alias("target_w"), F.col("c.h").alias("target_h"), match.alias("aspect_match"),
        ((F.col("c.w") % 32 == 0) & (F.col("c.h") % 32 == 0)).alias("divisible_by_32"), (F.col("c.w") * F.col("c.h")).alias("target_pixels"),
        half_up(F.col("c.w") / F.col("width"), 4).alias("scale_x"), half_up(F.col("c.h") / F.col("height"), 4).alias("scale_y"),
    )


add(
    "resolution_matrix",
    resolution_matrix,
    query(
        ("raw_masks",),
        f"""SELECT width, height, images, w AS target_w, h AS target_h, abs(w / h - width / height) < 1e-2 AS aspect_match, w % 32 = 0 AND h % 32 = 0 AS divisible_by_32, w * h AS target_pixels,
            {r('w / width', 4)} AS scale_x, {r('h / height', 4)} AS scale_y FROM (SELECT width, height, count(*) AS images FROM (SELECT max(x) + 1 AS width, max(y) + 1 AS height FROM raw_masks GROUP BY split, sample) GROUP BY ALL),
            (VALUES (256, 192), (320, 240), (256, 256)) v(w, h)""",
    ),
)

# ---- evaluation -------------------------------------------------------------------------------------
add(
    "argmax_mask",
    lambda spark, sf: masks.argmax_mask(fx.logits(spark, sf)),
    query(("logits",), "SELECT sample, y, x, class FROM logits QUALIFY row_number() OVER (PARTITION BY sample, y, x ORDER BY logit DESC, class) = 1"),
)


def class_weights(spark, sf):
    counts = _masks(spark, sf).groupBy("class").agg(F.count(F.lit(1)).alias("pixels"))
    parts = [metrics.class_weights(counts, s_).select(F.lit(s_).alias("strategy"), "class", settle(F.col("weight"), 6).alias("weight")) for s_ in ("inverse_sqrt", "inverse_freq", "uniform")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


add(
    "class_weights",
    class_weights,
    query(
        ("masks",),
        f"""SELECT strategy, class, {s('raw * 4 / sum(raw) OVER (PARTITION BY strategy)', 6)} AS weight FROM (SELECT strategy, class, CASE strategy WHEN 'inverse_sqrt' THEN 1e0 / sqrt(f) WHEN 'inverse_freq' THEN 1e0 / f ELSE 1e0 END AS raw
            FROM (SELECT class, count(*) / sum(count(*)) OVER () AS f FROM masks GROUP BY 1), (VALUES ('inverse_sqrt'), ('inverse_freq'), ('uniform')) t(strategy))""",
    ),
)
# Class weights of the default configuration.
WEIGHTS = (0.427, 0.840, 1.597, 1.139)


def softmax_ce_dice(spark, sf):
    target = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).select(
        "sample", F.floor(F.col("i") / 4).cast("int").alias("y"), (F.col("i") % 4).cast("int").alias("x"), ((F.col("sample") + F.col("i")) % 4).cast("int").alias("class")
    )
    rows = metrics.losses(metrics.class_scores(fx.logits(spark, sf), target), WEIGHTS)
    return rows.select(*[settle(F.col(c), 6).alias(c) for c in ("loss_ce", "loss_dice", "loss_total")])


add(
    "softmax_ce_dice",
    softmax_ce_dice,
    query(
        ("logits",),
        f"""SELECT {s('ce', 6)} AS loss_ce, {s('dice', 6)} AS loss_dice, {s('ce + dice', 6)} AS loss_total FROM (
              SELECT sum(w * nll) / greatest(1e0, sum(w * t)) AS ce, sum((1e0 - (2e0 * i + 1e-5) / (p + t + 1e-5)) * dw) / sum(dw) AS dice FROM (
                SELECT class, CASE class WHEN 0 THEN 427e-3 WHEN 1 THEN 84e-2 WHEN 2 THEN 1597e-3 ELSE 1139e-3 END AS w, CASE class WHEN 0 THEN 427e-3 WHEN 1 THEN 84e-2 WHEN 2 THEN 1597e-3 * 2 ELSE 1139e-3 END AS dw,
                  sum(prob) AS p, count(*) FILTER (hit) AS t, coalesce(sum(prob) FILTER (hit), 0e0) AS i, coalesce(sum(-ln(prob + 1e-7)) FILTER (hit), 0e0) AS nll
                FROM (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY sample, y, x) AS prob, class = (sample + y * 4 + x) % 4 AS hit FROM logits) GROUP BY class))""",
    ),
)


def _two(spark, sf):
    t = fx.thumbs(spark, sf)
    return fx.masks(t), fx.masks(t, 10.0)


cte(
    "overlap",
    ("masks", "pred_masks"),
    """SELECT split, sample, count(*) FILTER (m.class = 2 AND p.class = 2) AS i, count(*) FILTER (m.class = 2 OR p.class = 2) AS u, count(*) FILTER (m.class = 2) AS t, count(*) FILTER (p.class = 2) AS p
       FROM masks m JOIN pred_masks p USING (split, sample, y, x) GROUP BY ALL""",
)
add(
    "seg_metrics",
    lambda spark, sf: rounded(masks.overlap_scores(*_two(spark, sf), 2), ("iou", "dice")),
    query(("overlap",), f"SELECT split, sample, {s('i / greatest(u, 1)', 6)} AS iou, {s('2e0 * i / greatest(t + p, 1)', 6)} AS dice, t, p FROM overlap"),
)


def _geo2(source, cls, p):
    return f"SELECT split, sample, count(*) AS {p}_n, avg(x) AS {p}_x, avg(y) AS {p}_y FROM {source} WHERE class = {cls} GROUP BY ALL"


add(
    "seg_size_errors",
    lambda spark, sf: rounded(metrics.size_errors(*_two(spark, sf)), ("diameter_error_pct", "centre_error_px", "iris_ratio_error_pct"), 5),
    query(
        ("masks", "pred_masks"),
        f"""SELECT split, sample, {s('abs(sqrt(c_n) - sqrt(a_n)) / sqrt(a_n) * 100', 5)} AS diameter_error_pct, {s('sqrt((c_x - a_x) ** 2 + (c_y - a_y) ** 2)', 5)} AS centre_error_px,
            {s('abs(sqrt(c_n / d_n) - sqrt(a_n / b_n)) / sqrt(a_n / b_n) * 100', 5)} AS iris_ratio_error_pct
            FROM ({_geo2('masks', 2, 'a')}) JOIN ({_geo2('pred_masks', 2, 'c')}) USING (split, sample) LEFT JOIN ({_geo2('masks', 3, 'b')}) USING (split, sample) LEFT JOIN ({_geo2('pred_masks', 3, 'd')}) USING (split, sample)""",
    ),
)


def _scored(spark, sf):
    d, lab = fx.table(spark, sf, "documents").select("doc_id", "n_chars"), fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return lab.join(d, "doc_id").select("label", F.col("n_chars").alias("score"), (F.col("n_chars") > 1000).cast("int").alias("predicted"))


cte("scored_docs", (), "SELECT quality AS label, n_chars AS score, (n_chars > 1000)::INT AS predicted FROM labels JOIN documents USING (doc_id)")
add(
    "confusion",
    lambda spark, sf: (lambda d: d.select("tp", "fp", "fn", "tn", *[half_up(F.col(c), 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")]))(metrics.confusion(_scored(spark, sf))),
    query(
        ("scored_docs",),
        f"""SELECT tp, fp, fn, tn, {r('(tp + tn) / (tp + fp + fn + tn)', 6)} AS accuracy, {r('tp / (tp + fp)', 6)} AS precision, {r('tp / (tp + fn)', 6)} AS recall, {r('2 * tp / (2 * tp + fp + fn)', 6)} AS f1
            FROM (SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM scored_docs)""",
    ),
)
add(
    "roc_auc",
    lambda spark, sf: metrics.roc_auc(_scored(spark, sf)).select("positives", "negatives", half_up(F.col("auc"), 6).alias("auc")),
    query(
        ("scored_docs",),
        f"""SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
            {r("(SELECT avg(CASE WHEN p.score > n.score THEN 1e0 WHEN p.score = n.score THEN 5e-1 ELSE 0e0 END) FROM scored_docs p, scored_docs n WHERE p.label = 1 AND n.label = 0)", 6)} AS auc FROM scored_docs""",
    ),
)


# ---- pixel rows from binary images ------------------------------------------------------------------
def pixel_table(spark, sf):
    """Binary gray images (as an image scan gives them) to pixel rows, with RGB luminance."""
    from ...sources.images import to_pixels

    e = fx.table(spark, sf, "embeddings")
    byte = lambda v: F.lpad(F.hex((F.floor(F.abs(v.cast("double")) * F.lit(1000.0)) % 256).cast("long")), 2, "0")
    images = e.select(
        F.col("vec_id").alias("sample"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"),
        F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("data"),
    )
    return to_pixels(images, ["sample"]).select("sample", "y", "x", F.col("value").cast("long").alias("value"))


add(
    "pixel_table",
    pixel_table,
    """SELECT vec_id AS sample, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 1000e0) AS BIGINT) % 256 AS value FROM embeddings, range(64) t(i)""",
)
add(
    "luminance",
    lambda spark, sf: fx.thumbs(spark, sf).select(*K, "y", "x", half_up(pixels.luminance(F.col("lum"), F.col("lum") + F.col("x"), F.col("lum") + F.col("y")), 6).alias("gray")),
    query(("thumbs",), f"SELECT split, sample, y, x, {r('299e-3 * lum + 587e-3 * (lum + x) + 114e-3 * (lum + y)', 6)} AS gray FROM thumbs"),
)
