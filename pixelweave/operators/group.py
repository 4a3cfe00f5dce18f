"""Group operators: statistics, spatial joins and filters, features."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions import CARDINAL, CORNERS, upper_median
from pixelweave.functions.tables import written
from pixelweave.operators import tiles

ID = ["frame_idx", "blob_id"]


def statistics(blob_px: DataFrame) -> DataFrame:
    """Size, whole-number mean, upper median, maximum and bounds (both ends inside) of each group."""
    mean = F.floor(F.sum("intensity") / F.count("*")).cast("int")
    return blob_px.groupBy(*ID).agg(F.count("*").alias("size"), mean.alias("mean_intensity"), upper_median(F.col("intensity")).alias("median_intensity"), F.max("intensity").alias("max_intensity"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def qualify(stats: DataFrame, min_size: int, min_median: int, small_size: int, small_median: int) -> DataFrame:
    """Without groups that are too small, too dim, or both rather small and rather dim."""
    return stats.where((F.col("size") > min_size) & (F.col("median_intensity") >= min_median) & ~((F.col("size") < small_size) & (F.col("median_intensity") < small_median)))


def near(stats: DataFrame, blob_px: DataFrame, scan: int, cell: int = 32) -> DataFrame:
    """``frame_idx, blob_id, other_id``: the groups with a pixel in a group's bounds, widened by ``scan`` on all sides. Not symmetric.

    Widened bounds go to all cells of a grid that they touch and pixels to theirs, so this is an equi-join on the cell; a
    pixel lies in one cell, so no pair of group and pixel meets twice.
    """
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - scan) / cell), F.floor((F.col(hi) + scan) / cell)))
    boxes = stats.select("frame_idx", "blob_id", "min_x", "min_y", "max_x", "max_y", span("min_x", "max_x").alias("cx")).select("*", span("min_y", "max_y").alias("cy"))
    pixels = blob_px.select("frame_idx", F.col("blob_id").alias("other_id"), "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    inside = F.col("x").between(F.col("min_x") - scan, F.col("max_x") + scan) & F.col("y").between(F.col("min_y") - scan, F.col("max_y") + scan)
    return boxes.join(pixels, ["frame_idx", "cx", "cy"]).where(inside & (F.col("blob_id") != F.col("other_id"))).select("frame_idx", "blob_id", "other_id").distinct()


def isolated(stats: DataFrame, blob_px: DataFrame, scan: int, need: int, neighbour_over: int, up_to: int) -> DataFrame:
    """Groups that stay: those larger than ``up_to``, and those with ``need`` neighbours larger than ``neighbour_over``."""
    large = stats.where(F.col("size") > neighbour_over).select("frame_idx", F.col("blob_id").alias("other_id"))
    pairs = near(stats.where(F.col("size") <= up_to), blob_px, scan).join(large, ["frame_idx", "other_id"])
    kept = pairs.groupBy(*ID).agg(F.count("*").alias("n")).where(F.col("n") >= need).select(*ID)
    return stats.where(F.col("size") > up_to).unionByName(stats.where(F.col("size") <= up_to).join(kept, ID, "left_semi"))


def dim_isolated(stats: DataFrame, blob_px: DataFrame, scan: int, need: int, up_to: int = 24) -> DataFrame:
    """Groups that stay: the large, those brighter than the frame's middle median, and those with ``need`` neighbours
    brighter than the median a quarter up."""
    sorted_medians = F.array_sort(F.collect_list("median_intensity"))
    limits = stats.groupBy("frame_idx").agg(F.count("*").alias("n"), sorted_medians.alias("m")).select("frame_idx", F.element_at("m", F.floor(F.col("n") / 2).cast("int") + 1).alias("half"), F.element_at("m", F.floor(F.col("n") / 4).cast("int") + 1).alias("quarter"))
    rows = stats.join(limits, "frame_idx")
    doubtful = (F.col("size") <= up_to) & (F.col("median_intensity") <= F.col("half"))
    bright = rows.where("median_intensity > quarter").select("frame_idx", F.col("blob_id").alias("other_id"))
    kept = near(rows.where(doubtful), blob_px, scan).join(bright, ["frame_idx", "other_id"]).groupBy(*ID).agg(F.count("*").alias("n")).where(F.col("n") >= need).select(*ID)
    return rows.where(~doubtful).select(*stats.columns).unionByName(rows.where(doubtful).join(kept, ID, "left_semi").select(*stats.columns))


def overlapping_bounds(stats: DataFrame) -> DataFrame:
    """``frame_idx, a, b, overlap``: pairs of groups of a frame and the next whose bounds overlap by more than an edge."""
    b = stats.select((F.col("frame_idx") - 1).alias("frame_idx"), F.col("blob_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    cell = 32
    spread = lambda df, p: df.withColumn("cx", F.explode(F.sequence(F.floor(F.col(f"{p}min_x") / cell), F.floor(F.col(f"{p}max_x") / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col(f"{p}min_y") / cell), F.floor(F.col(f"{p}max_y") / cell))))
    strict = (F.col("min_x") < F.col("b_max_x")) & (F.col("b_min_x") < F.col("max_x")) & (F.col("min_y") < F.col("b_max_y")) & (F.col("b_min_y") < F.col("max_y"))
    w = F.least("max_x", "b_max_x") - F.greatest("min_x", "b_min_x") + 1
    h = F.least("max_y", "b_max_y") - F.greatest("min_y", "b_min_y") + 1
    pairs = spread(stats.withColumnRenamed("blob_id", "a"), "").join(spread(b, "b_"), ["frame_idx", "cx", "cy"]).where(strict)
    return pairs.select("frame_idx", "a", "b", (w * h).alias("overlap")).distinct()


def shape_features(stats: DataFrame, width: int, height: int) -> DataFrame:
    """Size, bounds, centre and their ratios, in parts of the frame."""
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    r = lambda c: F.round(c.cast("double"), 9)
    return stats.select(
        *ID, r(F.col("size") / (width * height)).alias("f_size"), r(w / width).alias("f_width"), r(h / height).alias("f_height"),
        r(F.floor(F.col("min_x") + w / 2) / width).alias("f_center_x"), r(F.floor(F.col("min_y") + h / 2) / height).alias("f_center_y"),
        r(F.col("min_x") / width).alias("f_min_x"), r(F.col("min_y") / height).alias("f_min_y"), r(F.col("max_x") / width).alias("f_max_x"), r(F.col("max_y") / height).alias("f_max_y"),
        r(F.sqrt((w * w + h * h).cast("double")) / (width * height)).alias("f_hypotenuse"), r(w / h).alias("f_aspect_ratio"), r(F.col("size") / (w * h)).alias("f_fill_amount"),
        F.col("mean_intensity").cast("double").alias("f_average_brightness"), F.col("median_intensity").cast("double").alias("f_median_brightness"), F.col("max_intensity").cast("double").alias("f_max_brightness"),
    )


def _inside(blob_px: DataFrame, pairs: tuple[tuple[int, int], ...]) -> DataFrame:
    """Each pixel with its group and how many of the places around it are in the group too."""

    def look(image: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
        return np.sum([image[at + d] == image[at] for d in tiles.steps(pairs, side)], axis=0)

    return tiles.stencil(blob_px, "blob_id", look, "n").withColumn("blob_id", F.col("blob_id").cast("int"))


def surface_ratio(blob_px: DataFrame) -> DataFrame:
    """The share of pixels that lack one of their four neighbours in the group."""
    return _inside(blob_px, CARDINAL).groupBy(*ID).agg(F.round(F.avg((F.col("n") < 4).cast("double")), 9).alias("f_surface_ratio"))


def diagonal_border(blob_px: DataFrame) -> DataFrame:
    """The mean number of diagonal neighbours in the group."""
    return _inside(blob_px, CORNERS).groupBy(*ID).agg(F.round(F.avg("n"), 9).alias("f_pixel_border"))


def nearby_count(stats: DataFrame, blob_px: DataFrame, width: int, scan: int = 80) -> DataFrame:
    """For each group the others near it whose centre is less than an eighth of the frame's width away."""
    centre = [F.floor(F.col("min_x") + (F.col("max_x") - F.col("min_x") + 1) / 2).alias("cx"), F.floor(F.col("min_y") + (F.col("max_y") - F.col("min_y") + 1) / 2).alias("cy")]
    c = stats.select(*ID, *centre)
    other = c.select("frame_idx", F.col("blob_id").alias("other_id"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    close = near(stats, blob_px, scan).join(c, ID).join(other, ["frame_idx", "other_id"]).where(F.hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy")) < width / 8)
    return c.select(*ID).join(close.groupBy(*ID).agg(F.count("*").alias("n")), ID, "left").select(*ID, F.coalesce("n", F.lit(0)).alias("f_nearby"))


def _neighbours(blob_px: DataFrame) -> DataFrame:
    """Each group with the number of frames beside its own that exist."""
    frames = blob_px.select("frame_idx").distinct()
    beside = frames.select(F.explode(F.array(F.col("frame_idx") - 1, F.col("frame_idx") + 1)).alias("frame_idx")).groupBy("frame_idx").agg(F.count("*").alias("n_frames"))
    return frames.join(beside, "frame_idx", "left").select("frame_idx", F.coalesce("n_frames", F.lit(0)).alias("n_frames"))


def direct_overlap(blob_px: DataFrame) -> DataFrame:
    """The share of a group's pixels that are labelled in the frames before and after."""
    other = blob_px.select(F.explode(F.array(F.col("frame_idx") - 1, F.col("frame_idx") + 1)).alias("frame_idx"), "x", "y")
    hits = blob_px.join(other, ["frame_idx", "x", "y"]).groupBy(*ID).agg(F.count("*").alias("hits"))
    rows = blob_px.groupBy(*ID).agg(F.count("*").alias("n")).join(_neighbours(blob_px), "frame_idx").join(hits, ID, "left")
    return rows.select(*ID, F.round(F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), F.col("n") * F.col("n_frames")), F.lit(0.0)), 9).alias("f_direct_overlap"))


def bounds_overlap(stats: DataFrame, blob_px: DataFrame, cell: int = 32) -> DataFrame:
    """The share of a group's bounds that is labelled in the frames before and after; 0 if the bounds are under 3 high."""
    area = (F.col("max_x") - F.col("min_x") + 1) * (F.col("max_y") - F.col("min_y") + 1)
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    boxes = stats.where("max_y - min_y + 1 >= 3").withColumn("cx", span("min_x", "max_x")).withColumn("cy", span("min_y", "max_y"))
    pixels = blob_px.select(F.explode(F.array(F.col("frame_idx") - 1, F.col("frame_idx") + 1)).alias("frame_idx"), "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    hits = boxes.join(pixels, ["frame_idx", "cx", "cy"]).where("x between min_x and max_x and y between min_y and max_y").groupBy(*ID).agg(F.count("*").alias("hits"))
    rows = stats.join(_neighbours(blob_px), "frame_idx").join(hits, ID, "left")
    return rows.select(*ID, F.round(F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), area * F.col("n_frames")), F.lit(0.0)), 9).alias("f_bounds_overlap"))


def razor(blob_px: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels inside a box ``frame_idx, min_x, min_y, max_x, max_y`` leave their groups and become one new group of their frame."""
    first = blob_px.groupBy("frame_idx").agg((F.max("blob_id") + 1).alias("new_id"))
    cut = blob_px.join(boxes, "frame_idx").where("x between min_x and max_x and y between min_y and max_y").select("frame_idx", "x", "y").distinct().withColumn("cut", F.lit(True))
    rows = blob_px.join(first, "frame_idx").join(cut, ["frame_idx", "x", "y"], "left")
    return rows.select("frame_idx", F.when(F.col("cut"), F.col("new_id")).otherwise(F.col("blob_id")).alias("blob_id"), "x", "y", "intensity")


def razor_in_order(blob_px: DataFrame, slices: DataFrame) -> DataFrame:
    """``frame_idx, blob_id, x, y, intensity`` after slices ``frame_idx, ord, min_x, min_y, max_x, max_y`` one after the other: each takes the pixels in its box, also those an earlier
    one took, for a new group. New groups are numbered on from the frame's greatest id; a slice without a pixel uses no number."""
    boxes = slices.select(F.col("frame_idx").alias("frame"), "ord", "min_x", "min_y", "max_x", "max_y")
    px = blob_px.select(*ID, "x", "y", "intensity")
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    cuts = px.join(boxes, (F.col("frame") == F.col("frame_idx")) & inside).select("frame_idx", "x", "y", "ord")
    first = px.groupBy("frame_idx").agg(F.max("blob_id").alias("last_id"))
    # a row for each slice of a frame, so the window is as small as what a user drew there
    ids = cuts.select("frame_idx", "ord").distinct().withColumn("n", F.row_number().over(Window.partitionBy("frame_idx").orderBy("ord"))).join(first, "frame_idx")
    newest = cuts.groupBy("frame_idx", "x", "y").agg(F.max("ord").alias("ord")).join(ids, ["frame_idx", "ord"]).select("frame_idx", "x", "y", (F.col("last_id") + F.col("n")).cast("int").alias("new_id"))
    return px.join(newest, ["frame_idx", "x", "y"], "left").select("frame_idx", F.coalesce("new_id", "blob_id").alias("blob_id"), "x", "y", "intensity")


def nearest(points: DataFrame, blob_px: DataFrame, cell: int = 16) -> DataFrame:
    """``frame_idx, blob_id, other_id, distance_sq``: for each of ``points(frame_idx, blob_id, x, y)``, whole numbers and one for each group, the other group of the frame with the nearest
    pixel; ties to the smaller id, nulls if the frame has no other group.

    Pixels lie in cells of a grid. Rings of cells are searched outward, each time as many as before and one more; a point is done once no ring outside can have a
    nearer pixel, so only points in empty surroundings go on, and a frame's size bounds the rounds. Points with a null place are done without a neighbour.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    pixels = written(blob_px.select(F.col("frame_idx"), F.col("blob_id").alias("other_id"), F.col("x").alias("other_x"), F.col("y").alias("other_y"), at("x").alias("cx"), at("y").alias("cy")), "pixels-by-cell")
    todo = written(points.select(*ID, "x", "y", at("x").alias("from_x"), at("y").alias("from_y"), F.lit(None).cast("struct<d: bigint, id: int>").alias("best")), "points")
    reach = lambda df, a, b: df.agg(F.min(F.least(a, b)), F.max(F.greatest(a, b))).first()
    ends = [v for pair in (reach(pixels, "cx", "cy"), reach(todo, "from_x", "from_y")) for v in pair if v is not None]
    widest = max(ends, default=0) - min(ends, default=0)
    done, low, high = [], 0, 1
    while True:
        ring = F.explode(F.sequence(F.lit(-high), F.lit(high)))
        cells = todo.withColumn("dx", ring).withColumn("dy", ring).where(F.greatest(F.abs("dx"), F.abs("dy")) >= low)
        met = cells.select(*ID, "x", "y", (F.col("from_x") + F.col("dx")).alias("cx"), (F.col("from_y") + F.col("dy")).alias("cy")).join(pixels, ["frame_idx", "cx", "cy"]).where("other_id <> blob_id")
        d = (F.col("x") - F.col("other_x")).cast("long") ** 2 + (F.col("y") - F.col("other_y")).cast("long") ** 2
        found = met.groupBy(*ID).agg(F.min(F.struct(d.cast("long").alias("d"), F.col("other_id").alias("id"))).alias("found"))
        rows = written(todo.join(found, ID, "left").withColumn("best", F.least("best", "found")).drop("found"), "nearest")
        # what is in rings further out is further away than ``high`` cells
        settled = F.coalesce(F.col("best.d") <= (high * cell) ** 2, F.lit(False)) | F.col("x").isNull() | F.col("y").isNull() | F.lit(high >= widest)
        done.append(rows.where(settled))
        todo = rows.where(~settled)
        if high >= widest or todo.isEmpty():
            break
        low, high = high + 1, min(2 * high + 1, widest)
    return functools.reduce(DataFrame.unionByName, done).select(*ID, F.col("best.id").alias("other_id"), F.col("best.d").alias("distance_sq"))


def pixel_overlap(blob_px: DataFrame, stats: DataFrame) -> DataFrame:
    """``frame_idx, a, b, f_pixel_overlap``: groups of a frame and the next that share pixels' places: how many, over the mean of their sizes. The first place of
    either group's bounds doesn't count; pairs without another shared place have no row."""
    corner = (F.col("x") == F.col("min_x")) & (F.col("y") == F.col("min_y"))
    own = blob_px.select(*ID, "x", "y").join(stats.select(*ID, "size", "min_x", "min_y"), ID).where(~corner)
    one = own.select("frame_idx", F.col("blob_id").alias("a"), "x", "y", F.col("size").alias("size_a"))
    two = own.select((F.col("frame_idx") - 1).alias("frame_idx"), F.col("blob_id").alias("b"), "x", "y", F.col("size").alias("size_b"))
    both = one.join(two, ["frame_idx", "x", "y"]).groupBy("frame_idx", "a", "b").agg((F.count("*") / ((F.first("size_a") + F.first("size_b")) / 2)).alias("share"))
    return both.select("frame_idx", "a", "b", F.round("share", 9).alias("f_pixel_overlap"))
