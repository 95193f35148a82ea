"""Audit of image collections: pairing, validity, statistics, duplicates and leakage between splits."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AuditSettings
from ..functions.numeric import half_up
from .components import IMAGE, written
from .ranks import at_ranks

PERCENTS = (1, 5, 25, 50, 75, 95, 99)


# ---- pairing ----------------------------------------------------------------------------------------


def pair_files(images: DataFrame, masks: DataFrame) -> DataFrame:
    return images.join(masks, ["split", "name"])


def missing_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    return images.join(masks.select("split", "name"), ["split", "name"], "left_anti")


def orphan_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    return masks.join(images.select("split", "name"), ["split", "name"], "left_anti")


def name_sets(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Both, only-image and only-mask names as one labelled table."""
    a, b = images.select("split", "name"), masks.select("split", "name")
    tag = lambda df, t: df.select("split", "name", F.lit(t).alias("found_in"))
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "image")).unionByName(tag(b.exceptAll(a), "mask"))


# ---- class statistics -------------------------------------------------------------------------------


def class_counts(masks: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Pixels and percent of each class per key."""
    counts = masks.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("pixels"))
    every = F.sum("pixels").over(Window.partitionBy(*keys))  # over the few counts of a key
    return counts.select(*keys, "class", "pixels", half_up(F.col("pixels") / every * F.lit(100.0), 4).alias("percent"))


def class_rollup(masks: DataFrame) -> DataFrame:
    """Class pixels per split and combined (split is null)."""
    counts = masks.groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"))
    sets = [[F.col("split"), F.col("class")], [F.col("class")]]
    return counts.groupingSets(sets, "split", "class").agg(F.sum("n").alias("pixels")).select("split", "class", "pixels")


def split_rollup(masks: DataFrame) -> DataFrame:
    """Pixels and pupil pixels per split with the grand total in one pass."""
    counts = masks.groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"))
    return counts.rollup("split").agg(
        F.grouping_id().cast("long").alias("level"), F.sum("n").alias("pixels"), F.sum(F.when(F.col("class") == 2, F.col("n")).otherwise(F.lit(0))).alias("pupil_pixels")
    )


def class_areas(masks: DataFrame, cls: int, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    return masks.groupBy(*keys).agg(F.count(F.when(F.col("class") == cls, 1)).alias("area"), F.count(F.lit(1)).alias("pixels"))


def area_stats(areas: DataFrame, by: list[str]) -> DataFrame:
    """Extremes, mean, median and population deviation; an area is a whole number no larger than an
    image, so the exact percentile keeps a bounded table of counts."""
    pct = half_up(F.col("area") / F.col("pixels") * F.lit(100.0), 4)
    return areas.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.min("area").alias("min_px"), F.max("area").alias("max_px"), F.avg("area").alias("mean_px"),
        F.percentile("area", 0.5).alias("median_px"), F.stddev_pop("area").alias("std_px"), F.min(pct).alias("min_pct"), F.max(pct).alias("max_pct"), F.avg(pct).alias("mean_pct"),
    )


def area_percentiles(areas: DataFrame, by: list[str]) -> DataFrame:
    marks = F.percentile("area", F.array(*[F.lit(p / 100) for p in PERCENTS]))
    return areas.groupBy(*by).agg(marks.alias("_p")).select(*by, *[F.get("_p", F.lit(i)).alias(f"p{p}") for i, p in enumerate(PERCENTS)])


def distinct_values(masks: DataFrame) -> DataFrame:
    """Values in use and exact distinct counts per split (class values are a small fixed domain)."""
    return masks.groupBy("split").agg(F.sort_array(F.collect_set("class")).alias("classes"), F.count_distinct("sample").alias("samples"))


def distinct_formats(images: DataFrame) -> DataFrame:
    """Sizes and channel counts in use per split and kind, with exact and approximate file counts."""
    return images.groupBy("split", "kind", "width", "height", "nChannels").agg(F.count(F.lit(1)).alias("files"), F.approx_count_distinct("name").alias("approx_names"))


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows for a report, with the number of rows left out (a top-k, not a full sort)."""
    rest = df.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0))).scalar()
    return df.orderBy(*order).limit(n).withColumn("more", rest)


def illegal_values(masks: DataFrame, allowed: tuple[int, ...] = AuditSettings.classes, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Images whose masks hold other values than the allowed ones."""
    found = masks.groupBy(*keys).agg(F.sort_array(F.collect_set("class")).alias("classes"))
    bad = F.array_except("classes", F.array(*[F.lit(c) for c in allowed]))
    return found.withColumn("illegal", bad).where(F.size("illegal") > 0)


def sizes(pixels: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


# ---- validity ---------------------------------------------------------------------------------------


def validity(images: DataFrame, masks: DataFrame, cfg: AuditSettings = AuditSettings(), keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Reasons why a sample is not usable, from the sizes and values found in its tables."""
    m = masks.groupBy(*keys).agg(
        (F.max("x") + 1).alias("mask_w"), (F.max("y") + 1).alias("mask_h"), F.sort_array(F.collect_set("class")).alias("classes")
    )
    rows = sizes(images, keys).join(m, list(keys))
    bad = F.array_except("classes", F.array(*[F.lit(c) for c in cfg.classes]))
    reasons = F.array_compact(
        F.array(
            F.when((F.col("width") != cfg.width) | (F.col("height") != cfg.height), F.format_string("Invalid image dimensions: %dx%d", "width", "height")),
            F.when((F.col("mask_w") != F.col("width")) | (F.col("mask_h") != F.col("height")), F.lit("Mask dimensions do not match image")),
            F.when(F.size(bad) > 0, F.concat(F.lit("Mask contains invalid class values: ["), F.array_join(bad.cast("array<string>"), ", "), F.lit("]"))),
        )
    )
    return rows.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def shortest(value: Column) -> Column:
    """A number of at most four decimals without needless zeros, but with one decimal at least."""
    return F.regexp_replace(F.format_string("%.4f", value), r"(\.\d+?)0+$", "$1")


def mask_flags(geometry: DataFrame, iris: DataFrame, pixels: DataFrame, cfg: AuditSettings = AuditSettings(), keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Several flags per mask: missing, touching the border, tiny, huge, larger than the iris."""
    rows = geometry.join(iris.select(*keys, F.col("area").alias("iris_px")), list(keys)).join(pixels.select(*keys, "pixels"), list(keys))
    a, i = F.col("area"), F.col("iris_px")
    pct = half_up(a / F.col("pixels") * F.lit(100.0), 4)
    touches = (a > 0) & ((F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == cfg.width - 1) | (F.col("y1") == cfg.height - 1))
    flags = F.array(
        F.when(a == 0, F.lit("NO_PUPIL_PIXELS")), F.when(touches, F.lit("PUPIL_TOUCHES_IMAGE_BOUNDARY")),
        F.when((a > 0) & (a < cfg.tiny_pupil_px), F.format_string("TINY_PUPIL (%d px, %s%%)", a, shortest(pct)))
        .when(a > cfg.huge_pupil_px, F.format_string("HUGE_PUPIL (%d px, %s%%)", a, shortest(pct))),
        F.when(i == 0, F.lit("NO_IRIS_PIXELS")).when(a > i, F.format_string("PUPIL_LARGER_THAN_IRIS (pupil=%d, iris=%d)", a, i)),
    )
    return rows.withColumn("flags", F.array_compact(flags))


def pair_counts(images: DataFrame, masks: DataFrame, by: str = "split") -> DataFrame:
    """Numbers of images and masks per split, and whether they are equal."""
    each = images.select(by, F.lit(1).alias("i"), F.lit(0).alias("m")).unionByName(masks.select(by, F.lit(0).alias("i"), F.lit(1).alias("m")))
    return each.groupBy(by).agg(F.sum("i").alias("images"), F.sum("m").alias("masks")).withColumn("equal", F.col("images") == F.col("masks"))


def require_pairs(images: DataFrame, masks: DataFrame, by: str = "split") -> DataFrame:
    """The counts; the job fails at a split whose images and masks differ in number."""
    text = F.concat(F.lit("unequal pairs in "), F.col(by).cast("string"), F.lit(": "), F.col("images").cast("string"), F.lit(" and "), F.col("masks").cast("string"))
    return pair_counts(images, masks, by).where(F.assert_true("equal", text).isNull())


def review_list(image_flags: DataFrame, mask_flags_: DataFrame, keys: tuple[str, ...] = IMAGE) -> DataFrame:
    """Flagged images and masks as one list."""
    part = lambda df, t: df.where(F.size("flags") > 0).select(*keys, F.lit(t).alias("type"), F.array_join("flags", "; ").alias("flags"))
    return part(image_flags, "IMAGE_QUALITY").unionByName(part(mask_flags_, "MASK_ANOMALY"))


def split_checks(checked: DataFrame) -> DataFrame:
    """Pass or fail per split with counts by kind of failure."""
    has = lambda text: F.count_if(F.exists("reasons", lambda r: r.startswith(text)))
    return checked.groupBy("split").agg(
        F.count(F.lit(1)).alias("pairs"), F.bool_and("is_valid").alias("passed"), has("Invalid image").alias("bad_size"), has("Mask dim").alias("bad_mask_size"),
        has("Mask contains").alias("bad_values"),
    )


def run_summary(checked: DataFrame, review: DataFrame, corrupted: int | Column = 0) -> DataFrame:
    """One row over both splits with the readiness status."""
    train, val = F.col("split") == "train", F.col("split") == "val"
    ok = F.col("is_valid")
    sums = checked.agg(
        F.count_if(train).alias("original_train"), F.count_if(val).alias("original_val"), F.count_if(train & ok).alias("clean_train"), F.count_if(val & ok).alias("clean_val"),
        F.count_if(F.exists("reasons", lambda r: r.startswith("Mask contains"))).alias("invalid_masks"),
    )
    flagged = review.agg(F.count(F.lit(1)).alias("n")).scalar()
    status = F.when((F.col("clean_train") > 0) & (F.lit(corrupted) == 0), "READY FOR PREPROCESSING").otherwise("NOT READY")
    return sums.select("*", flagged.alias("manual_review"), status.alias("status"))


def require_valid(checked: DataFrame) -> DataFrame:
    """Fail the job on the first invalid sample."""
    return checked.where(F.assert_true(F.col("is_valid"), F.concat(F.lit("invalid sample "), F.col("sample").cast("string"))).isNull())


# ---- duplicates and leakage -------------------------------------------------------------------------


def duplicate_groups(hashed: DataFrame, hash_col: str, name_col: str, by: list[str]) -> DataFrame:
    """Groups of equal content: size and first name. Members stay in their table (see `duplicate_members`)."""
    return hashed.groupBy(*by, hash_col).agg(F.count(F.lit(1)).alias("copies"), F.min(name_col).alias("first_name")).where("copies > 1")


def duplicate_members(hashed: DataFrame, hash_col: str, name_col: str, by: list[str]) -> DataFrame:
    """Every sample that has a copy, one row each, with the first name of its group."""
    groups = duplicate_groups(hashed, hash_col, name_col, by)
    return hashed.join(groups, [*by, hash_col]).select(*by, hash_col, name_col, "first_name", "copies")


def exact_leaks(hashed: DataFrame, hash_col: str = "md5", name_col: str = "sample") -> DataFrame:
    """Val samples whose content also occurs in train; the train side is first reduced to one row per content."""
    train = hashed.where("split = 'train'").groupBy(hash_col).agg(F.count(F.lit(1)).alias("train_copies"), F.min(name_col).alias("first_train"))
    return hashed.where("split = 'val'").join(train, hash_col).select(
        F.col(name_col).alias("val_sample"), "first_train", "train_copies", F.lit(1.0).alias("similarity"), F.lit(0).alias("distance")
    )


HEAVY = 1_000_000  # pairs of a bucket beyond which it is cut again


def _bands(positions: list[int], distance: int) -> list[int]:
    """Masks of the pairs of blocks of these bits, of which two hashes that differ in at most `distance` of them agree on at least one."""
    n = distance + 2
    blocks = [positions[len(positions) * i // n : len(positions) * (i + 1) // n] for i in range(n)]
    return [sum(1 << p for p in blocks[i] + blocks[j]) for i, j in combinations(range(n), 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_hashes(left: DataFrame, right: DataFrame, distance: int = AuditSettings.hash_distance, bits: int = AuditSettings.hash_bits, heavy: int = HEAVY) -> DataFrame:
    """All pairs of distinct hashes within a Hamming distance, without comparing all with all.

    The bits are cut into `distance + 2` blocks. Two hashes within the distance agree on at least two
    blocks, so every pair meets on one of the block pairs; the first agreeing one reports it, which
    makes a later distinct unnecessary. Both sides are distinct hashes, so copies do not multiply.

    A bucket of more than `heavy` pairs is cut again in the same way on the bits that it has not agreed on, and so on, like a
    trie: each level fixes half of the bits left, until buckets are small or no bit is left.
    """
    xor = F.col("left_hash").bitwiseXOR(F.col("right_hash"))
    agree = F.forall("earlier", lambda e: xor.bitwiseAND(e) != 0)  # none of the block pairs before: the first one reports a pair
    found = []
    sides = [df.select(F.col("dhash").alias(name), F.lit("").alias("path")) for df, name in ((left, "left_hash"), (right, "right_hash"))]
    levels = {"": (list(range(bits)), 0)}  # a path lists the block pairs taken; with it the bits left and the mask of those agreed on
    while True:
        rows, below = [], {}
        for path, (free, used) in levels.items():
            bands = _bands(free, distance)
            for k, m in enumerate(bands):
                rows.append((path, f"{path}{k}.", _signed(used | m), [_signed(e) for e in bands[:k]]))
                below[f"{path}{k}."] = ([p for p in free if not m >> p & 1], used | m)
        # six probes a path, and paths are few
        by_path: dict[str, list] = {}
        for path, further, mask, earlier in rows:
            probe = F.struct(F.lit(further).alias("next"), F.lit(mask).alias("mask"), F.array(*[F.lit(e) for e in earlier]).cast("array<long>").alias("earlier"))
            by_path.setdefault(path, []).append(probe)
        choice = F.create_map(*[c for path, probes in by_path.items() for c in (F.lit(path), F.array(*probes))])

        def probed(df: DataFrame, name: str, choice=choice) -> DataFrame:
            each = df.select(name, F.explode(F.element_at(choice, F.col("path"))).alias("_p"))
            return each.select(name, F.col("_p.next").alias("path"), F.col(name).bitwiseAND(F.col("_p.mask")).alias("b"), F.col("_p.earlier").alias("earlier"))

        keyed = [probed(df, name) for df, name in zip(sides, ("left_hash", "right_hash"), strict=True)]
        keyed[1] = keyed[1].drop("earlier")
        hot = None
        if any(len(free) > distance + 2 for free, _ in below.values()):  # else a bucket of distinct hashes is small
            count = [df.groupBy("path", "b").agg(F.count(F.lit(1)).alias(f"_n{i}")) for i, df in enumerate(keyed)]
            hot = written(count[0].join(count[1], ["path", "b"]).where(F.col("_n0") * F.col("_n1") > heavy).select("path", "b"), "heavy")
            if hot.isEmpty():
                hot = None
        calm = keyed if hot is None else [df.join(hot, ["path", "b"], "left_anti") for df in keyed]
        both = calm[0].join(calm[1], ["path", "b"])
        found.append(both.where((F.bit_count(xor) <= distance) & agree).select("left_hash", "right_hash", F.bit_count(xor).cast("int").alias("distance")))
        if hot is None:
            break
        sides = [df.join(hot, ["path", "b"], "left_semi").select(name, "path") for df, name in zip(keyed, ("left_hash", "right_hash"), strict=True)]
        levels = {r["path"]: below[r["path"]] for r in hot.select("path").distinct().collect()}  # at most as many as there are paths
    # below the first level a pair can come by several paths
    return found[0] if len(found) == 1 else reduce(DataFrame.unionByName, found).distinct()


def near_leaks(hashed: DataFrame, distance: int = AuditSettings.hash_distance, bits: int = AuditSettings.hash_bits) -> DataFrame:
    """Val x train pairs of different content with close hashes, one row per pair of hashes.

    `pairs` counts the sample pairs behind a row. Equal content has equal hashes, so only rows with
    distance 0 have such pairs to subtract. `expand_pairs` lists them where that is wanted.
    """
    by_hash = hashed.groupBy("split", "dhash").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("first_sample"))
    side = lambda s: by_hash.where(F.col("split") == s)
    close = near_hashes(side("val").select("dhash"), side("train").select("dhash"), distance, bits)
    content = hashed.groupBy("split", "dhash", "md5").agg(F.count(F.lit(1)).alias("n"))
    same = (
        content.groupBy("dhash", "md5")
        .agg((F.sum(F.when(F.col("split") == "val", F.col("n")).otherwise(0)) * F.sum(F.when(F.col("split") == "train", F.col("n")).otherwise(0))).alias("s"))
        .groupBy("dhash").agg(F.sum("s").alias("same"))
    )
    part = lambda s, h: side(s).select(F.col("dhash").alias(h), F.col("n").alias(f"{s}_n"), F.col("first_sample").alias(f"{s}_first"))
    rows = close.join(part("val", "left_hash"), "left_hash").join(part("train", "right_hash"), "right_hash")
    rows = rows.join(same.withColumnRenamed("dhash", "left_hash"), "left_hash", "left")
    pairs = F.col("val_n") * F.col("train_n") - F.when(F.col("distance") == 0, F.coalesce("same", F.lit(0))).otherwise(F.lit(0))
    return rows.withColumn("pairs", pairs).where("pairs > 0").select(
        F.col("left_hash").alias("val_hash"), F.col("right_hash").alias("train_hash"), "distance", "pairs", "val_first", "train_first",
        half_up((F.lit(64) - F.col("distance")) / F.lit(64.0), 4).alias("similarity"),
    )


def expand_pairs(leaks: DataFrame, hashed: DataFrame) -> DataFrame:
    """Sample pairs behind `near_leaks` rows, one per pair of different contents (copies are not repeated)."""
    content = hashed.groupBy("split", "dhash", "md5").agg(F.min("sample").alias("sample"))
    side = lambda s: content.where(F.col("split") == s).select(F.col("dhash").alias(f"{s}_hash"), F.col("md5").alias(f"{s}_md5"), F.col("sample").alias(f"{s}_sample"))
    rows = leaks.join(side("val"), "val_hash").join(side("train"), "train_hash")
    return rows.where("val_md5 <> train_md5").select("val_sample", "train_sample", "distance", "similarity")


def subject_overlap(samples: DataFrame) -> DataFrame:
    """Subjects that occur in both splits, with their counts."""
    g = samples.groupBy("subject").agg(F.count_if(F.col("split") == "train").alias("train_n"), F.count_if(F.col("split") == "val").alias("val_n"))
    return g.where((F.col("train_n") > 0) & (F.col("val_n") > 0))


def subject_of(name: Column) -> Column:
    return F.split(name, "_")[0]


# ---- picks ------------------------------------------------------------------------------------------


def representatives(areas: DataFrame, bands: dict[str, tuple[int, int]], min_area: int, boundary_area: int) -> DataFrame:
    """Typical samples: first of the small band, middle of the medium band, last of the large band, one at the
    border and the one with the highest pupil/iris ratio. Without a match the overall first, middle or last is used.

    `areas` has sample, area, iris_area, touches. Only the middle needs a rank; only the range that holds it is sorted.
    """
    a = areas.where(F.col("area") >= min_area)
    by_area = F.struct("area", "sample")
    inside = lambda b: F.col("area").between(*bands[b])
    ratio = F.col("area") / F.greatest("iris_area", F.lit(1))
    ends = a.agg(
        F.coalesce(F.min(F.when(inside("small"), by_area)), F.min(by_area)).alias("small"),
        F.coalesce(F.max(F.when(inside("large"), by_area)), F.max(by_area)).alias("large"),
        F.coalesce(F.min_by(by_area, F.when(F.col("touches") & (F.col("area") > boundary_area), F.col("sample"))), F.min(by_area)).alias("boundary"),
        F.min_by(by_area, F.struct(-ratio, F.col("sample"))).alias("unusual"),
    )
    band = a.where(inside("medium"))
    middle = at_ranks((a if band.isEmpty() else band).select("area", "sample"), ["area", "sample"], lambda n: [n // 2])
    rows = ends.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in ("small", "large", "boundary", "unusual")]), F.array("small", "large", "boundary", "unusual"))).alias("kind", "s"))
    return rows.select("kind", "s.sample", "s.area").unionByName(middle.select(F.lit("medium").alias("kind"), "sample", "area"))


def evenly_spaced(df: DataFrame, id_col: str, picks: int) -> DataFrame:
    """Rows at `picks` evenly spaced positions of the id order, first and last included."""
    places = lambda n: [k * (n - 1) // max(1, picks - 1) for k in range(picks)] if n else []
    return at_ranks(df, [id_col], places)
