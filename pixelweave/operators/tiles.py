"""What depends on the pixels around one: a frame is cut into square tiles, each with a margin of its neighbours, so that pixels are shuffled once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 128


def _tiles(c: str, before: int, after: int) -> Column:
    """The tiles along an axis that a place reaches, which lie from ``before`` in front of it to ``after`` behind it."""
    return F.explode(F.sequence(F.floor((F.col(c) - before) / TILE).cast("int"), F.floor((F.col(c) + after) / TILE).cast("int")))


def stencil(px: DataFrame, value: str, look: Callable[[np.ndarray, np.ndarray, int], np.ndarray], column: str, kind: str = "int") -> DataFrame:
    """``frame_idx, x, y``, ``value`` and a ``column`` of each pixel: ``look(image, at, side)`` gets a tile with a margin of one, row after row of ``side`` places, -1 where
    there is no pixel, and the places of its own pixels. ``value`` is a whole number from 0; a place has one row."""
    at = px.select("frame_idx", "x", "y", F.col(value).cast("long").alias(value), _tiles("x", 1, 1).alias("tx")).select("*", _tiles("y", 1, 1).alias("ty"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        side = TILE + 2
        x, y = (rows[c].to_numpy() - rows[t].to_numpy() * TILE + 1 for c, t in (("x", "tx"), ("y", "ty")))
        place = y * side + x
        image = np.full(side * side, -1, dtype=np.int64)
        image[place] = rows[value].to_numpy()
        own = (x >= 1) & (x <= TILE) & (y >= 1) & (y <= TILE)
        return rows.loc[own, ["frame_idx", "x", "y", value]].assign(**{column: look(image, place[own], side)})

    return at.groupBy("frame_idx", "tx", "ty").applyInPandas(run, f"frame_idx int, x int, y int, {value} long, {column} {kind}")


def steps(pairs: tuple[tuple[int, int], ...], side: int) -> list[int]:
    """Offsets as differences of places."""
    return [dy * side + dx for dx, dy in pairs]


def spread_most(px: DataFrame, kernel: list[tuple[int, int, float]], width: int, height: int) -> DataFrame:
    """``frame_idx, x, y, weight``: at each place of the frame the greatest weight that ``kernel(dx, dy, weight)`` brings from any pixel of ``px``."""
    reach = [min(k[0] for k in kernel), max(k[0] for k in kernel), min(k[1] for k in kernel), max(k[1] for k in kernel)]
    at = px.select("frame_idx", "x", "y", _tiles("x", max(0, -reach[0]), max(0, reach[1])).alias("tx")).select("*", _tiles("y", max(0, -reach[2]), max(0, reach[3])).alias("ty"))
    margin = max(map(abs, reach))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(rows["tx"].iloc[0]), int(rows["ty"].iloc[0])
        side = TILE + 2 * margin
        set_ = np.zeros((side, side), dtype=bool)
        set_[rows["y"].to_numpy() - ty * TILE + margin, rows["x"].to_numpy() - tx * TILE + margin] = True
        weight = np.zeros((TILE, TILE))
        for dx, dy, w in kernel:
            np.maximum(weight, w * set_[margin - dy : margin - dy + TILE, margin - dx : margin - dx + TILE], out=weight)
        y, x = np.nonzero(weight)
        out = pd.DataFrame({"frame_idx": rows["frame_idx"].iloc[0], "x": x + tx * TILE, "y": y + ty * TILE, "weight": weight[y, x]})
        return out[out["x"].between(0, width - 1) & out["y"].between(0, height - 1)]

    return at.groupBy("frame_idx", "tx", "ty").applyInPandas(run, "frame_idx int, x int, y int, weight double")
