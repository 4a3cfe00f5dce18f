"""Pixel operators: subtraction, admission, seeds, borders, painting."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.functions import AROUND, blend, contrast, disc, offsets
from pixelweave.operators import tiles

KEYS = ["frame_idx", "x", "y"]
FULL = 65535


def subtract(frames: DataFrame, aligned: DataFrame) -> DataFrame:
    """``frame_idx, x, y, intensity``: a third of what the channels of a frame are brighter together than those of
    its aligned neighbour, 0 where it is darker or the neighbour's pixel isn't opaque."""
    other = aligned.select(*KEYS, (F.col("r") + F.col("g") + F.col("b")).alias("theirs"), "a")
    d = F.col("r") + F.col("g") + F.col("b") - F.col("theirs")
    value = F.when(F.col("a").isNotNull() & (F.col("a") != FULL), 0).otherwise(F.floor(F.greatest(d, F.lit(0)) / 3))
    return frames.select(*KEYS, "r", "g", "b").join(other, KEYS).select(*KEYS, value.cast("int").alias("intensity"))


def admit(px: DataFrame, least: int, min_contrast: float, height: int, ignore_rows: int) -> DataFrame:
    """Pixels that can start a group (``seedable``) or only join one; rows at the bottom and dim pixels go."""
    rows = px.where(F.col("y") < height - ignore_rows).withColumn("seedable", F.col("intensity") > least)
    return rows.where(F.col("seedable") | (contrast(F.col("intensity"), F.lit(least)) < min_contrast))


def contrast_edges(px: DataFrame, below: float) -> DataFrame:
    """For each pixel with a like neighbour: how many of the eight differ in contrast by less than ``below``."""

    def look(image: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
        own, n = image[at], np.zeros(len(at), dtype=np.int32)
        for d in tiles.steps(AROUND, side):
            other = image[at + d]
            n += (other >= 0) & (np.abs(own - other) / np.maximum(np.maximum(own, other), 1) * 100.0 < below)
        return n

    return tiles.stencil(px, "intensity", look, "n_like").where("n_like > 0").select(*KEYS, F.col("n_like").cast("long").alias("n_like"))


def seed_candidates(px: DataFrame, least: int) -> DataFrame:
    """Pixels above ``least`` with no brighter one of the eight around them."""

    def look(image: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
        return np.max([image[at + d] for d in tiles.steps(AROUND, side)], axis=0)

    found = tiles.stencil(px.where(F.col("intensity") > least), "intensity", look, "brightest", "long").where("brightest <= intensity")
    return found.select(*KEYS, F.col("intensity").cast("int").alias("intensity"))


def border_brightness(blob_px: DataFrame, px: DataFrame) -> DataFrame:
    """``frame_idx, blob_id, n_brighter, n_darker, ratio``: pixels around a group against its own; the ratio is null if none is darker."""
    own = blob_px.select("frame_idx", "blob_id", "x", "y", "intensity")
    at = own.select("frame_idx", "blob_id", F.col("intensity").alias("inside"), "x", "y", F.explode(offsets(AROUND)).alias("o"))
    at = at.select("frame_idx", "blob_id", "inside", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    outside = at.join(own.select(*KEYS, "blob_id"), [*KEYS, "blob_id"], "left_anti").join(px, KEYS)
    counts = outside.groupBy("frame_idx", "blob_id").agg(F.count_if(F.col("intensity") > F.col("inside")).alias("n_brighter"), F.count_if(F.col("intensity") <= F.col("inside")).alias("n_darker"))
    return counts.withColumn("ratio", F.round(F.try_divide("n_brighter", "n_darker"), 9))


def mask_kernel(inner: int = 2, radius: int = 6) -> list[tuple[int, int, float]]:
    """``dx, dy, weight`` from a painted pixel: 1 within ``inner``, fading to 0 at ``radius``. The kernel's centre lies one
    right of and below the pixel, as its corner is put ``radius`` before it while its middle is ``radius + 1`` in."""
    middle, out = radius + 1, []
    for y in range(2 * middle + 1):
        for x in range(2 * middle + 1):
            d = math.hypot(x - middle, y - middle)
            w = 1.0 if d <= inner else max(0.0, (radius - d) / (radius - inner))
            if w > 0:
                out.append((x - radius, y - radius, w))
    return out


def alpha_plane(painted: DataFrame, width: int, height: int, inner: int = 2, radius: int = 6) -> DataFrame:
    """``frame_idx, x, y, alpha``: at each pixel the greatest weight of the kernels of all painted pixels."""
    found = tiles.spread_most(painted.select(*KEYS).distinct(), mask_kernel(inner, radius), width, height)
    return found.select(*KEYS, F.round("weight", 9).alias("alpha"))


def paint_mask(alpha: DataFrame) -> DataFrame:
    """The alpha plane as an image of 8 bits."""
    return alpha.select(*KEYS, F.least((F.col("alpha") * 255).cast("int"), F.lit(255)).alias("mask"))


def paint(px: DataFrame, other: DataFrame, alpha: DataFrame) -> DataFrame:
    """``px`` with ``other`` blended in where there is an alpha; pixels without another keep their own."""
    rows = px.join(other.select(*KEYS, F.col("intensity").alias("theirs")), KEYS, "left").join(alpha, KEYS, "left")
    mixed = F.when(F.col("alpha") >= 1, F.col("theirs")).otherwise(blend(F.col("theirs"), F.col("intensity"), F.col("alpha")))
    return rows.select(*KEYS, F.when(F.col("alpha").isNotNull() & F.col("theirs").isNotNull(), mixed).otherwise(F.col("intensity")).cast("int").alias("intensity"))


def dilate(blob_px: DataFrame, width: int, height: int) -> DataFrame:
    """Distinct pixels of all groups and the eight around each, within the frame."""
    at = blob_px.select("frame_idx", "x", "y", F.explode(offsets(AROUND + ((0, 0),))).alias("o")).select("frame_idx", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
    return at.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()


def paint_channels(px: DataFrame, other: DataFrame, alpha: DataFrame) -> DataFrame:
    """`paint` for ``frame_idx, x, y, r, g, b, a``: red, green and blue are blended each by itself; where the other pixel isn't opaque, or there is none, a pixel stays."""
    theirs = other.select(*KEYS, *[F.col(c).alias(f"their_{c}") for c in "rgba"])
    rows = px.join(theirs, KEYS, "left").join(alpha, KEYS, "left")
    hit = F.col("alpha").isNotNull() & F.coalesce(F.col("their_a") == FULL, F.lit(False))
    mixed = lambda c: F.when(F.col("alpha") >= 1, F.col(f"their_{c}")).otherwise(blend(F.col(f"their_{c}"), F.col(c), F.col("alpha")))
    return rows.select(*KEYS, *[F.when(hit, mixed(c)).otherwise(F.col(c)).cast("int").alias(c) for c in "rgb"], "a")


def within_disc(px: DataFrame, radius: int) -> DataFrame:
    """Places within ``radius`` of a pixel, with the distance of the nearest one."""
    table = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(d).alias("d")) for dx, dy, d in disc(radius)])
    at = px.select("frame_idx", "x", "y", F.explode(table).alias("o")).select("frame_idx", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "o.d")
    return at.where("x >= 0 and y >= 0").groupBy(*KEYS).agg(F.round(F.min("d"), 9).alias("distance"))
