"""Queries on landmark arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import landmarks as lmk
from ...functions.numeric import half_up
from .. import fixtures as fx
from .registry import add
from .sql import cte, query, r


def _parts(spark, sf):
    lm = F.col("lm")
    return fx.landmarks(spark, sf).select(
        "sample", "lm", lmk.left_eye(lm).alias("le"), lmk.right_eye(lm).alias("re"), lmk.left_iris(lm).alias("li"), lmk.right_iris(lm).alias("ri")
    )


def landmark_eyes(spark, sf):
    p = _parts(spark, sf)
    six = lambda c, n: half_up(F.col(c), 6).alias(n)
    return p.select(
        "sample", F.col("le.contour_points").alias("contour_points"), six("le.min_x", "l_min_x"), six("le.max_y", "l_max_y"), six("le.width", "l_width"), six("re.height", "r_height"),
        six("li.x", "li_x"), six("li.radius", "li_radius"), six("ri.y", "ri_y"), six("ri.radius", "ri_radius"), half_up(lmk.interpupillary(F.col("li"), F.col("ri")), 6).alias("ipd"),
    )


cte(
    "pts",
    (),
    """SELECT vec_id AS sample, i, (CAST(embedding[i % 64 + 1] AS DOUBLE) + 1e0) / 2e0 AS x, (CAST(embedding[(i * 7) % 64 + 1] AS DOUBLE) + 1e0) / 2e0 AS y,
       vec_id % 11 <> 0 AS full_face FROM embeddings, range(478) t(i) WHERE vec_id % 11 <> 0 OR i < 468""",
)


def _list(v):
    return "(" + ", ".join(str(i) for i in v) + ")"


def _iris(c, ring, p):
    return f"""SELECT sample, any_value(cx) AS {p}_x, any_value(cy) AS {p}_y, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS {p}_r
      FROM pts JOIN (SELECT sample, x AS cx, y AS cy FROM pts WHERE i = {c}) USING (sample) WHERE i IN {_list(ring)} AND full_face GROUP BY sample"""


cte(
    "faces",
    ("pts",),
    f"""SELECT b.*, li.* EXCLUDE (sample), ri.* EXCLUDE (sample) FROM (
        SELECT sample, CAST(count(*) FILTER (i IN {_list(lmk.LEFT_EYE)}) AS INTEGER) AS contour_points,
          min(x) FILTER (i IN {_list(lmk.LEFT_EYE)}) AS lx0, max(x) FILTER (i IN {_list(lmk.LEFT_EYE)}) AS lx1, max(y) FILTER (i IN {_list(lmk.LEFT_EYE)}) AS ly1,
          min(y) FILTER (i IN {_list(lmk.RIGHT_EYE)}) AS ry0, max(y) FILTER (i IN {_list(lmk.RIGHT_EYE)}) AS ry1,
          min(x) FILTER (i IN {_list(lmk.FACE_OVAL)}) AS fx0, max(x) FILTER (i IN {_list(lmk.FACE_OVAL)}) AS fx1, min(y) FILTER (i IN {_list(lmk.FACE_OVAL)}) AS fy0, max(y) FILTER (i IN {_list(lmk.FACE_OVAL)}) AS fy1
        FROM pts GROUP BY sample) b LEFT JOIN ({_iris(468, lmk.LEFT_IRIS_RING, 'li')}) li USING (sample) LEFT JOIN ({_iris(473, lmk.RIGHT_IRIS_RING, 'ri')}) ri USING (sample)""",
)
add(
    "landmark_eyes",
    landmark_eyes,
    query(
        ("faces",),
        f"""SELECT sample, contour_points, {r('lx0', 6)} AS l_min_x, {r('ly1', 6)} AS l_max_y, {r('lx1 - lx0', 6)} AS l_width, {r('ry1 - ry0', 6)} AS r_height, {r('li_x', 6)} AS li_x, {r('li_r', 6)} AS li_radius,
            {r('ri_y', 6)} AS ri_y, {r('ri_r', 6)} AS ri_radius, {r('sqrt((li_x - ri_x) * (li_x - ri_x) + (li_y - ri_y) * (li_y - ri_y))', 6)} AS ipd FROM faces""",
    ),
)


def tracking_quality(spark, sf):
    """All faces, and some of them again without a face, without eyes, without the left one and without the right one (last octal digit 1 to 4)."""
    given = _parts(spark, sf)
    every = given.withColumn("sample", F.col("sample") * 8)
    for k, gone in enumerate((("lm", "le", "re", "li", "ri"), ("le", "re"), ("le",), ("re",)), start=1):
        part = given.where(F.col("sample") % 5 == k).withColumn("sample", F.col("sample") * 8 + k)
        every = every.unionByName(part.withColumns({c: F.lit(None).cast(given.schema[c].dataType) for c in gone}))
    status, text = lmk.tracking(F.col("lm"), F.col("le"), F.col("re"), F.col("li"), F.col("ri"))
    return every.select("sample", status.alias("status"), text.alias("guidance"))


_g = lmk.GUIDANCE
add(
    "tracking_quality",
    tracking_quality,
    query(
        ("faces",),
        f"""SELECT sample, CASE rule WHEN 'good' THEN 'GOOD' WHEN 'none' THEN 'LOST' ELSE 'DEGRADED' END AS status, CASE rule {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _g.items())} END AS guidance
            FROM (SELECT sample * 8 + k AS sample, rule FROM (SELECT sample FROM faces), (VALUES (1, 'none'), (2, 'eyes'), (3, 'left'), (4, 'right')) v(k, rule) WHERE sample % 5 = k
                  UNION ALL SELECT sample * 8, CASE WHEN li_x IS NULL OR ri_x IS NULL THEN 'iris' WHEN fx0 < 5e-2 OR fx1 > 95e-2 OR fy0 < 5e-2 OR fy1 > 95e-2 THEN 'edge' WHEN fx1 - fx0 < 18e-2 THEN 'far'
                  WHEN fx1 - fx0 > 85e-2 THEN 'close' ELSE 'good' END AS rule FROM faces)""",
    ),
)


def crop_box(spark, sf):
    """All three crop rules and the way back from crop to frame."""
    p = _parts(spark, sf)
    eye = lmk.eye_crop(F.col("li.x"), F.col("li.y"), F.col("le.width") * F.lit(0.2), 1280.0, 720.0)
    iris = lmk.iris_crop(F.col("li.x"), F.col("li.y"), F.col("li.radius") * F.lit(0.5), 1280.0, 720.0)
    centre = lmk.centre_crop(F.lit(640) + F.col("sample") % 3 * 100, F.lit(480))
    rows = p.select("sample", eye.alias("e"), iris.alias("i"), centre.alias("c"))
    back = lmk.roi_to_frame(F.lit(128.0), F.lit(96.0), F.lit(40.0), F.lit(1256.0), F.col("i"), 256.0, 192.0)
    flat = lambda s: [F.col(f"{s}.{f}").alias(f"{s}_{f}") for f in ("x", "y", "w", "h")]
    return rows.select("sample", *flat("e"), *flat("i"), *flat("c"), half_up(back["x"], 4).alias("frame_x"), half_up(back["diameter"], 4).alias("frame_d"), half_up(back["area"], 3).alias("frame_area"))


add(
    "crop_box",
    crop_box,
    query(
        ("faces",),
        f"""SELECT sample, CASE WHEN inside THEN ex END AS e_x, CASE WHEN inside THEN ey END AS e_y, CASE WHEN inside THEN ew END AS e_w, CASE WHEN inside THEN eh END AS e_h,
              CASE WHEN i_w IS NOT NULL THEN i_x END AS i_x, CASE WHEN i_w IS NOT NULL THEN i_y END AS i_y, i_w, i_h, c_x, 0e0 AS c_y, c_w, c_h, {r('i_x + 128e0 * (i_w / 256e0)', 4)} AS frame_x, {r('40e0 * (i_w / 256e0)', 4)} AS frame_d, {r('1256e0 * (i_w / 256e0) * (i_h / 192e0)', 3)} AS frame_area
            FROM (SELECT *, ex >= 0 AND ey >= 0 AND ex + ew <= 1280 AND ey + eh <= 720 AS inside, greatest(0e0, least(floor(li_x * 1280e0 - i_w / 2), 1280e0 - i_w)) AS i_x, greatest(0e0, least(floor(li_y * 720e0 - i_h / 2), 720e0 - i_h)) AS i_y
              FROM (SELECT *, {r('li_x * 1280e0 - ew / 2')} AS ex, {r('li_y * 720e0 - eh / 2')} AS ey FROM (
                SELECT *, {r('ew * 75e-2')} AS eh, {r('i_w * 75e-2')} AS i_h FROM (
                  SELECT sample, li_x, li_y, {r('(lx1 - lx0) * 2e-1 * 1280e0 * 25e-1')} AS ew,
                    CASE WHEN li_r * 5e-1 * 720e0 >= 4 THEN least(greatest(ceil(li_r * 5e-1 * 720e0 * 48e-1), 48e0), 1280e0) END AS i_w,
                    CASE sample % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 50e0 ELSE 100e0 END AS c_x, 640e0 AS c_w, 480e0 AS c_h FROM faces))))""",
    ),
)
