"""Straight lines by voting: the classical Hough transform as a grouped sum, the best line of a group and how well it fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.functions import AROUND, box, box_crossings, central, lower_median, offsets
from pixelweave.operators.group import ID

#: Sines and cosines are whole millionths, so votes don't depend on rounding.
SCALE = 1_000_000


def angles(step: int = 1) -> list[tuple[int, int, int]]:
    """``theta, cosine, sine`` of the half circle's degrees."""
    return [(t, round(math.cos(math.radians(t)) * SCALE), round(math.sin(math.radians(t)) * SCALE)) for t in range(0, 180, step)]


def votes(px: DataFrame, least: int, step: int = 1) -> DataFrame:
    """``frame_idx, theta, rho, votes``: lines with more than ``least`` pixels on them. Sums are partial before the shuffle."""
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).cast("long").alias("c"), F.lit(s).cast("long").alias("s")) for t, c, s in angles(step)])
    at = px.select("frame_idx", "x", "y", F.explode(table).alias("a"))
    rho = F.floor((F.col("x") * F.col("a.c") + F.col("y") * F.col("a.s")) / SCALE).cast("int")
    return at.groupBy("frame_idx", F.col("a.t").alias("theta"), rho.alias("rho")).agg(F.count("*").alias("votes")).where(F.col("votes") > least)


def peaks(lines: DataFrame, k: int, reach: int = 5) -> DataFrame:
    """The ``k`` lines of each frame with the most votes that no line within ``reach`` in both directions outvotes; ties to the smaller theta, then rho."""
    # the most votes near a line: first over the angles, then over the distances
    near = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    by_theta = lines.select("frame_idx", F.col("votes").alias("more"), "theta", "rho", near.alias("d")).groupBy("frame_idx", (F.col("theta") + F.col("d")).alias("theta"), "rho").agg(F.max("more").alias("more"))
    best = by_theta.select("frame_idx", "theta", "rho", "more", near.alias("d")).groupBy("frame_idx", "theta", (F.col("rho") + F.col("d")).alias("rho")).agg(F.max("more").alias("most"))
    top = lines.join(best, ["frame_idx", "theta", "rho"]).where("votes = most")
    place = F.row_number().over(Window.partitionBy("frame_idx").orderBy(F.desc("votes"), "theta", "rho"))
    return top.withColumn("place", place).where(F.col("place") <= k).select("frame_idx", "theta", "rho", "votes", "place")


def theta_histogram(lines: DataFrame, width: int = 10) -> DataFrame:
    """Votes of each frame's lines by bands of ``width`` degrees, with the band's share of the frame's votes."""
    bands = lines.groupBy("frame_idx", F.floor(F.col("theta") / width).cast("int").alias("band")).agg(F.sum("votes").alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("frame_idx"))
    return bands.withColumn("share", F.round(F.col("votes") / total, 9))


def theta_match(histogram: DataFrame, width: int = 10) -> DataFrame:
    """``frame_idx, score, max_theta``: how far the bands of a frame and the next agree, by the largest band of the lesser shares; and the first degree of the
    frame's largest band, the first of equals. Frames without a next one have a null score."""
    later = histogram.select((F.col("frame_idx") - 1).alias("frame_idx"), "band", F.col("share").alias("next_share"))
    both = histogram.join(later, ["frame_idx", "band"], "left").groupBy("frame_idx").agg(F.max(F.least("share", F.coalesce("next_share", F.lit(0.0)))).alias("score"), F.max_by("band", F.struct("share", -F.col("band"))).alias("band"))
    there = later.select("frame_idx").distinct().withColumn("there", F.lit(True))
    return both.join(there, "frame_idx", "left").select("frame_idx", F.when(F.col("there"), F.col("score")).alias("score"), (F.col("band") * width).alias("max_theta"))


def coefficients(p: str = "") -> tuple[Column, Column, Column]:
    """Of a row's line, in millionths: ``ax + by + c = 0``."""
    return F.col(f"{p}cosine"), F.col(f"{p}sine"), -F.col(f"{p}rho").cast("long") * SCALE


def _off(p: str = "") -> Column:
    """How many millionths a pixel lies off its line."""
    a, b, c = coefficients(p)
    return F.abs(a * F.col("x") + b * F.col("y") + c)


def best_line(x: np.ndarray, y: np.ndarray, k: int = 10, step: int = 1) -> tuple[int, int, int, int, int, int]:
    """``theta, rho, cosine, sine, votes, distance sum`` of the best line of some pixels, see `best_lines`."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    table = np.array(angles(step), dtype=np.int64)
    rho = (x[:, None] * table[:, 1] + y[:, None] * table[:, 2] + SCALE // 2) // SCALE  # the nearest
    low = rho.min()
    width = int(rho.max() - low) + 1
    counts = np.bincount((rho - low + np.arange(len(table)) * width).ravel(), minlength=1)
    voted = np.flatnonzero(counts)
    if len(voted) > k:
        voted = voted[counts[voted] >= np.partition(counts[voted], len(voted) - k)[len(voted) - k]]
    top = voted[np.argsort(-counts[voted], kind="stable")][:k]  # places are in order of theta, then rho
    of, at = table[top // width], top % width + low
    off = np.abs(x[:, None] * of[:, 1] + y[:, None] * of[:, 2] - at * SCALE)
    best = int(np.argmin(np.sort(off, axis=0)[(len(x) - 1) // 2]))
    return int(of[best, 0]), int(at[best]), int(of[best, 1]), int(of[best, 2]), int(counts[top[best]]), int(off[:, best].sum())


def best_lines(blob_px: DataFrame, k: int = 10, least: int = 3, step: int = 1) -> DataFrame:
    """``frame_idx, blob_id, theta, rho, cosine, sine, votes``: of the ``k`` lines with the most votes of a group's pixels the one of least lower-median distance to them;
    ties to more votes, then to the smaller theta and rho. Groups of fewer than ``least`` pixels have none.

    Pixels are shuffled once, by frame; a frame's groups vote in arrays of angles by distances, which an image bounds.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["blob_id"].to_numpy(), kind="stable")
        ids, x, y = (frame[c].to_numpy()[order] for c in ("blob_id", "x", "y"))
        found = []
        for at in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
            if len(at) >= least:
                found.append((int(frame["frame_idx"].iloc[0]), int(ids[at[0]]), *best_line(x[at], y[at], k, step)[:5]))
        return pd.DataFrame(found, columns=[*ID, "theta", "rho", "cosine", "sine", "votes"])

    return blob_px.select(*ID, "x", "y").groupBy("frame_idx").applyInPandas(run, "frame_idx int, blob_id int, theta int, rho int, cosine long, sine long, votes long")


def walk(lines: DataFrame, start: Column, end: Column, beside: int) -> DataFrame:
    """``lines`` with ``x, y`` of each place on a line between ``start`` and ``end`` on its longer axis, and of ``beside`` places to either side across it; none is negative."""
    a, b, c = coefficients()
    along = lines.withColumn("level", F.abs("sine") > F.abs("cosine")).withColumn("t", F.explode(F.sequence(F.least(start, end).cast("int"), F.greatest(start, end).cast("int"))))
    u = F.when(F.col("level"), F.try_divide(-c - a * F.col("t"), b)).otherwise(F.try_divide(-c - b * F.col("t"), a)).cast("int")
    along = along.withColumn("u", u).where("t >= 0 and u >= 0").withColumn("v", F.explode(F.sequence(F.col("u") - beside, F.col("u") + beside))).where("v >= 0")
    return along.withColumn("x", F.when(F.col("level"), F.col("t")).otherwise(F.col("v"))).withColumn("y", F.when(F.col("level"), F.col("v")).otherwise(F.col("t"))).drop("level", "t", "u", "v")


def line_fill(stats: DataFrame, blob_px: DataFrame, lines: DataFrame) -> DataFrame:
    """``frame_idx, blob_id, f_line_fill``: the share of the places on and beside a group's line, between where it meets the group's bounds, that the group covers;
    0 without a line or if it meets fewer than two sides."""
    met = stats.join(lines, ID).withColumn("met", box_crossings(box(), coefficients())).where(F.size("met") > 1)
    side = F.when(F.abs("sine") > F.abs("cosine"), F.lit("x")).otherwise(F.lit("y"))
    end = lambda n: F.when(side == "x", F.col("met")[n]["x"]).otherwise(F.col("met")[n]["y"])
    places = walk(met.select(*ID, "rho", "cosine", "sine", end(0).alias("from"), end(1).alias("to")), F.col("from"), F.col("to"), 1).select(*ID, "x", "y")
    hits = places.join(blob_px.select(*ID, "x", "y", F.lit(1).alias("hit")), [*ID, "x", "y"], "left").groupBy(*ID).agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    return stats.select(*ID).join(hits, ID, "left").select(*ID, F.round(F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)), 9).alias("f_line_fill"))


def line_fit(blob_px: DataFrame, lines: DataFrame) -> DataFrame:
    """How a group's pixels lie about its line: mean, lower median and greatest distance, the length of the line as the diagonal of the bounds of pixels nearer than 4, and
    its votes for each pixel. Without a line: 4294967295 for the distances but the greatest, 420420420 for ``ideal_distance``, and 0."""
    near = _off() < 4 * SCALE
    span = lambda c: F.max(F.when(near, F.col(c))) - F.min(F.when(near, F.col(c)))
    fit = blob_px.join(lines, ID).groupBy(*ID).agg(
        (F.sum(_off()) / F.count("*") / SCALE).alias("mean"), (lower_median(_off()) / SCALE).alias("median"), (F.max(_off()) / SCALE).alias("most"),
        F.hypot(span("x").cast("double"), span("y").cast("double")).alias("length"), (F.first("votes") / F.count("*")).alias("per_pixel"))
    r = lambda c, without: F.round(F.coalesce(c, F.lit(without)), 9)
    return blob_px.select(*ID).distinct().join(fit, ID, "left").select(
        *ID, r(F.col("mean"), 4294967295.0).alias("f_average_line"), r(F.col("median"), 4294967295.0).alias("f_median_line"), r(F.col("most"), 0.0).alias("max_line"),
        r(F.col("mean"), 420420420.0).alias("ideal_distance"), r(F.col("length"), 0.0).alias("f_line_length"), r(F.col("per_pixel"), 0.0).alias("f_max_hough"))


def neighbours_inside(blob_px: DataFrame) -> DataFrame:
    """Each pixel of a group with ``n``, how many of the eight around it are in the group too."""
    own = blob_px.select(*ID, "x", "y")
    around = own.select(*ID, F.explode(offsets(AROUND)).alias("o"), "x", "y").select(*ID, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return blob_px.join(around.groupBy(*ID, "x", "y").agg(F.count("*").alias("n")), [*ID, "x", "y"], "left").fillna(0, ["n"])


def neighbour_trim(blob_px: DataFrame, over: int = 2) -> DataFrame:
    """Pixels with more than ``over`` of the eight around them in their group."""
    return neighbours_inside(blob_px).where(F.col("n") > over).drop("n")


def line_trim(blob_px: DataFrame, lines: DataFrame, stray: bool = False) -> DataFrame:
    """Pixels no farther from their group's line than the middle of the median and the greatest distance. With ``stray`` instead: those nearer than 2, those nearer than the
    median with over 2 neighbours in the group, and others with over 1. Groups without a line stay as they are."""
    fit = blob_px.join(lines, ID).groupBy(*ID).agg(lower_median(_off()).alias("middle"), F.max(_off()).alias("most"))
    rows = (neighbours_inside(blob_px) if stray else blob_px).join(lines, ID, "left").join(fit, ID, "left")
    keep = (_off() < 2 * SCALE) | F.when(_off() < F.col("middle"), F.col("n") > 2).otherwise(F.col("n") > 1) if stray else 2 * _off() <= F.col("middle") + F.col("most")
    return rows.where(F.col("rho").isNull() | keep).select(*blob_px.columns)


def _central(lines: DataFrame, stats: DataFrame) -> DataFrame:
    """``lines`` with ``centre``, the place on a group's line beside the centre of its bounds."""
    middle = lambda lo, hi: F.col(lo) + (F.col(hi) - F.col(lo) + 1) / 2
    return lines.join(stats.select(*ID, middle("min_x", "max_x").alias("mid_x"), middle("min_y", "max_y").alias("mid_y")), ID).withColumn("centre", central(*coefficients(), F.col("mid_x"), F.col("mid_y")))


def nearest_pixels(blob_px: DataFrame, stats: DataFrame, lines: DataFrame, x: int, y: int) -> DataFrame:
    """``frame_idx, blob_id, to_line, to_point, centre_x, centre_y``: how near a group's nearest pixel is to its line and to a point, and the place on the line beside the
    centre of its bounds. Without a line only ``to_point`` is there."""
    point = F.min((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y))
    rows = blob_px.select(*ID, "x", "y").join(_central(lines, stats).select(*ID, "rho", "cosine", "sine", "centre"), ID, "left")
    found = rows.groupBy(*ID).agg(F.min(_off()).alias("off"), F.sqrt(point.cast("double")).alias("to_point"), F.first("centre").alias("centre"))
    r = lambda c: F.round(c, 6) + 0.0
    return found.select(*ID, r(F.col("off") / SCALE).alias("to_line"), r(F.col("to_point")).alias("to_point"), r(F.col("centre.x")).alias("centre_x"), r(F.col("centre.y")).alias("centre_y"))


def walk_until(px: DataFrame, stats: DataFrame, lines: DataFrame, width: int, height: int, gap: int = 0) -> DataFrame:
    """``frame_idx, blob_id, first, last, hits``: from the place beside a group's centre outward along its line in both directions until more than ``gap`` places in a row
    hold no pixel of ``px``: the least and the greatest place held on the line's longer axis, and how many are. Lines whose walk ends at once have no row.

    Places are those of a frame of ``width`` by ``height``; each direction is a window over a line's own places, so no longer than a frame's side."""
    side = F.when(F.abs("sine") > F.abs("cosine"), F.col("centre.x")).otherwise(F.col("centre.y")).cast("int")
    own = _central(lines, stats).select(*ID, "rho", "cosine", "sine", side.alias("start"))
    level = F.abs("sine") > F.abs("cosine")
    places = walk(own, F.lit(0), F.when(level, F.lit(width - 1)).otherwise(F.lit(height - 1)), 0)
    held = places.join(px.select("frame_idx", "x", "y").distinct(), ["frame_idx", "x", "y"]).select(*ID, "start", F.when(level, F.col("x")).otherwise(F.col("y")).alias("t"))
    # the start belongs to both directions
    both = held.withColumn("way", F.explode(F.when(F.col("t") == F.col("start"), F.array(F.lit(1), F.lit(-1))).when(F.col("t") > F.col("start"), F.array(F.lit(1))).otherwise(F.array(F.lit(-1))))).withColumn("step", F.abs(F.col("t") - F.col("start")))
    outward = Window.partitionBy(*ID, "way").orderBy("step")
    missed = F.col("step") - F.coalesce(F.lag("step").over(outward), F.lit(-1)) - 1
    kept = both.withColumn("ended", (missed > gap).cast("int")).withColumn("ended", F.sum("ended").over(outward)).where("ended = 0")
    return kept.groupBy(*ID).agg(F.min("t").alias("first"), F.max("t").alias("last"), F.countDistinct("t").alias("hits"))
