"""Column functions on arrays of face landmarks: eye contours, irises, tracking quality, crop boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up, pick

# Landmark indices (subject's left and right).
LEFT_EYE = (362, 382, 381, 380, 374, 373, 390, 249, 263, 466, 388, 387, 386, 385, 384, 398)
RIGHT_EYE = (33, 7, 163, 144, 145, 153, 154, 155, 133, 173, 157, 158, 159, 160, 161, 246)
LEFT_CORNERS = (362, 263, 386, 374)
RIGHT_CORNERS = (133, 33, 159, 145)
LEFT_IRIS, LEFT_IRIS_RING = 468, (469, 470, 471, 472)
RIGHT_IRIS, RIGHT_IRIS_RING = 473, (474, 475, 476, 477)
FACE_OVAL = (
    10, 338, 297, 332, 284, 251, 389, 356, 454, 323, 361, 288, 397, 365, 379, 378, 400, 377, 152, 148, 176, 149, 150, 136,
    172, 58, 132, 93, 234, 127, 162, 21, 54, 103, 67, 109,
)
MIN_FACE, MIN_IRIS = 468, 478


def points(lm: Column, indices: tuple[int, ...]) -> Column:
    """The landmarks at these indices, missing ones left out."""
    return F.array_compact(F.array(*[F.get(lm, F.lit(i)) for i in indices]))


def bounding_box(pts: Column) -> Column:
    """Box of normalised points; the lower corner starts at 1 and the upper one at 0."""
    low = lambda f: F.least(F.lit(1.0), F.array_min(F.transform(pts, lambda p: p[f])))
    high = lambda f: F.greatest(F.lit(0.0), F.array_max(F.transform(pts, lambda p: p[f])))
    return F.struct(low("x").alias("min_x"), low("y").alias("min_y"), high("x").alias("max_x"), high("y").alias("max_y"))


def eye(lm: Column, contour: tuple[int, ...], corners: tuple[int, ...]) -> Column:
    """Eye box and contour size, or null when the face or a corner is missing."""
    pts = points(lm, contour)
    box = bounding_box(pts)
    ok = (F.size(lm) >= MIN_FACE) & (F.size(points(lm, corners)) == 4) & (F.size(pts) >= 4)
    return F.when(
        ok,
        F.struct(
            F.size(pts).alias("contour_points"), box["min_x"].alias("min_x"), box["min_y"].alias("min_y"), box["max_x"].alias("max_x"), box["max_y"].alias("max_y"),
            (box["max_x"] - box["min_x"]).alias("width"), (box["max_y"] - box["min_y"]).alias("height"),
        ),
    )


def left_eye(lm: Column) -> Column:
    return eye(lm, LEFT_EYE, LEFT_CORNERS)


def right_eye(lm: Column) -> Column:
    return eye(lm, RIGHT_EYE, RIGHT_CORNERS)


def iris(lm: Column, center: int, ring: tuple[int, ...]) -> Column:
    """Iris centre and mean distance of the ring points."""
    c, pts = F.get(lm, F.lit(center)), points(lm, ring)
    far = lambda p: F.sqrt((p["x"] - c["x"]) * (p["x"] - c["x"]) + (p["y"] - c["y"]) * (p["y"] - c["y"]))
    radius = F.aggregate(F.transform(pts, far), F.lit(0.0), lambda s, d: s + d) / F.size(pts)
    ok = (F.size(lm) >= MIN_IRIS) & c.isNotNull() & (F.size(pts) >= 4)
    return F.when(ok, F.struct(c["x"].alias("x"), c["y"].alias("y"), radius.alias("radius")))


def left_iris(lm: Column) -> Column:
    return iris(lm, LEFT_IRIS, LEFT_IRIS_RING)


def right_iris(lm: Column) -> Column:
    return iris(lm, RIGHT_IRIS, RIGHT_IRIS_RING)


def interpupillary(left: Column, right: Column) -> Column:
    dx, dy = left["x"] - right["x"], left["y"] - right["y"]
    return F.sqrt(dx * dx + dy * dy)


# Guidance texts.
GUIDANCE = {
    "none": "No face detected. Position your face in front of the camera.",
    "eyes": "Eyes not detected. Ensure face and eyes are unobstructed.",
    "left": "Left eye occluded or poorly visible.",
    "right": "Right eye occluded or poorly visible.",
    "iris": "Iris tracking degraded. Adjust ambient lighting or position.",
    "edge": "Face is near frame edge. Center your face in the guide.",
    "far": "Move slightly closer to the camera.",
    "close": "Move slightly back from the camera.",
    "good": "Tracking optimal. Keep your head steady.",
}


def tracking(lm: Column, left: Column, right: Column, left_ir: Column, right_ir: Column) -> tuple[Column, Column]:
    """(status, guidance) from the face oval and the found parts, first rule wins."""
    box = bounding_box(points(lm, FACE_OVAL))
    width = box["max_x"] - box["min_x"]
    edge = (box["min_x"] < 0.05) | (box["max_x"] > 0.95) | (box["min_y"] < 0.05) | (box["max_y"] > 0.95)
    parts = left.isNull() | right.isNull() | left_ir.isNull() | right_ir.isNull()
    rules = [
        ("none", lm.isNull() | (F.size(lm) == 0)), ("eyes", left.isNull() & right.isNull()), ("left", left.isNull()), ("right", right.isNull()),
        ("iris", parts), ("edge", edge), ("far", width < 0.18), ("close", width > 0.85),
    ]
    rule = pick([(c, F.lit(n)) for n, c in rules], F.lit("good"))
    status = pick([(rule == "none", F.lit("LOST")), (rule == "good", F.lit("GOOD"))], F.lit("DEGRADED"))
    text = pick([(rule == k, F.lit(v)) for k, v in GUIDANCE.items() if k != "good"], F.lit(GUIDANCE["good"]))
    return status, text


def eye_crop(cx: Column, cy: Column, eye_width: Column, video_w: float, video_h: float) -> Column:
    """4:3 box, 2.5 eye widths wide; null when it leaves the frame. All in pixels, cx, cy, eye_width normalised."""
    w = half_up(eye_width * F.lit(video_w) * F.lit(2.5))
    h = half_up(w * F.lit(0.75))
    x, y = half_up(cx * F.lit(video_w) - w / 2), half_up(cy * F.lit(video_h) - h / 2)
    inside = (x >= 0) & (y >= 0) & (x + w <= video_w) & (y + h <= video_h)
    return F.when(inside, F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def iris_crop(cx: Column, cy: Column, radius_norm: Column, video_w: float, video_h: float) -> Column:
    """4:3 box, 4.8 iris radii wide, moved inside the frame; null for an iris below 4 px."""
    radius = radius_norm * F.lit(min(video_w, video_h))
    w = F.least(F.greatest(F.ceil(radius * F.lit(4.8)).cast("double"), F.lit(48.0)), F.lit(video_w))
    h = half_up(w * F.lit(0.75))
    place = lambda c, size, full: F.greatest(F.lit(0.0), F.least(F.floor(c * F.lit(full) - size / 2).cast("double"), F.lit(full) - size))
    return F.when(radius >= 4, F.struct(place(cx, w, video_w).alias("x"), place(cy, h, video_h).alias("y"), w.alias("w"), h.alias("h")))


def centre_crop(width: Column, height: Column) -> Column:
    """Largest centred 4:3 box of an image of any shape."""
    aspect = F.lit(4.0 / 3.0)
    same = F.abs(width / height - aspect) <= 0.01
    wide = width / height > aspect
    w = F.when(same | ~wide, width).otherwise(half_up(height * aspect))
    h = F.when(same | wide, height).otherwise(half_up(width / aspect))
    return F.struct(
        F.floor((width - w) / 2).cast("double").alias("x"), F.floor((height - h) / 2).cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h")
    )


def roi_to_frame(cx: Column, cy: Column, diameter: Column, area: Column, crop: Column, roi_w: float, roi_h: float) -> Column:
    """Centre, diameter and area of a region inside a crop, back in frame pixels."""
    sx, sy = crop["w"] / F.lit(roi_w), crop["h"] / F.lit(roi_h)
    return F.struct(
        (crop["x"] + cx * sx).alias("x"), (crop["y"] + cy * sy).alias("y"), (diameter * sx).alias("diameter"), (area * sx * sy).alias("area")
    )
