"""Order-dependent steps, frame by frame: growing groups from seeds, and clouds of near groups.

A frame is one group of rows and never larger than its image, so a grouped function has bounded memory: some arrays of an image's size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A frame has fewer groups than this, as its ids have 16 bits.
MOST_IDS = 65_535
FREE, BACKGROUND = 0, -1


def _image(rows: pd.DataFrame, width: int, height: int) -> np.ndarray:
    """Intensities by ``y * width + x`` with an empty border of one place; -1 where there is no pixel."""
    out = np.full(width * height, -1, dtype=np.int32)
    out[(rows["y"].to_numpy() + 1) * width + rows["x"].to_numpy() + 1] = rows["intensity"].to_numpy()
    return out


def grow_groups(px: DataFrame, least: int, min_contrast: float, original: DataFrame | None = None, most_ratio: float = 0.1) -> DataFrame:
    """``frame_idx, blob_id, x, y, intensity``: groups grown from the brightest pixels down.

    Pixels go by falling intensity, then y, then x. One that is still free and has no brighter neighbour seeds a group if it is above ``least``; else it is
    background. A group takes free neighbours whose contrast to its seed is below ``min_contrast``; the others it touches become background.

    With ``original(frame_idx, x, y, intensity)``, the whole frames before subtraction, a group goes unless places around its pixels are brighter there than the
    pixel fewer than ``most_ratio`` times as often as not; one without a place around it goes too. Its pixels stay consumed, and the next group gets its id.
    Coordinates and intensities are not negative; a place has one row.
    """

    def run(rows: pd.DataFrame, whole: pd.DataFrame | None = None) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({c: [] for c in ("frame_idx", "blob_id", "x", "y", "intensity")})
        both = [rows] if whole is None or whole.empty else [rows, whole]
        width, height = (max(int(r[c].max()) for r in both) + 3 for c in ("x", "y"))
        around = np.array([-width - 1, -width, -width + 1, -1, 1, width - 1, width, width + 1])
        value = _image(rows, width, height)
        image = None if whole is None else _image(whole, width, height)
        place = (rows["y"].to_numpy() + 1) * width + rows["x"].to_numpy() + 1
        order = place[np.lexsort((place, -value[place].astype(np.int64)))]
        # when its turn comes a free pixel is consumed, so a group takes only those whose turn is later than its seed's
        turn = np.zeros(width * height, dtype=np.int32)
        turn[order] = np.arange(1, len(order) + 1)
        top = value[order]
        for d in around:
            top = np.maximum(top, value[order + d])
        seeds = order[(value[order] > least) & (top == value[order])]
        owner = np.zeros(width * height, dtype=np.int32)
        n, found = 0, []
        for seed in seeds.tolist():
            if n + 1 == MOST_IDS:
                break
            if owner[seed] != FREE:
                continue
            n += 1
            own, now = float(value[seed]), turn[seed]
            owner[seed] = n
            front, members = np.array([seed]), [np.array([seed])]
            while len(front):
                near = np.unique((front[:, None] + around).ravel())
                near = near[(turn[near] > now) & (owner[near] == FREE)]
                v = value[near].astype(float)
                joins = np.abs(own - v) / np.maximum(np.maximum(own, v), 1) * 100 < min_contrast
                owner[near] = np.where(joins, n, BACKGROUND)
                front = near[joins]
                members.append(front)
            own_places = np.concatenate(members)
            if image is not None and not _dark_border(own_places, owner, n, image, around, most_ratio):
                owner[own_places] = BACKGROUND
                n -= 1
                continue
            found.append(pd.DataFrame({"blob_id": n, "x": own_places % width - 1, "y": own_places // width - 1, "intensity": value[own_places]}))
        out = pd.concat(found) if found else pd.DataFrame({c: [] for c in ("blob_id", "x", "y", "intensity")})
        return out.assign(frame_idx=rows["frame_idx"].iloc[0])[["frame_idx", "blob_id", "x", "y", "intensity"]]

    schema = "frame_idx int, blob_id int, x int, y int, intensity int"
    px = px.select("frame_idx", "x", "y", "intensity")
    if original is None:
        return px.groupBy("frame_idx").applyInPandas(lambda rows: run(rows), schema)
    # columns of their own names, as both sides may come from one table
    whole = original.select(F.col("frame_idx").alias("whole_frame"), F.col("x").alias("whole_x"), F.col("y").alias("whole_y"), F.col("intensity").alias("whole_intensity"))
    plain = {"whole_frame": "frame_idx", "whole_x": "x", "whole_y": "y", "whole_intensity": "intensity"}
    return px.groupBy("frame_idx").cogroup(whole.groupBy("whole_frame")).applyInPandas(lambda rows, other: run(rows, other.rename(columns=plain)), schema)


def _dark_border(members: np.ndarray, owner: np.ndarray, n: int, image: np.ndarray, around: np.ndarray, most_ratio: float) -> bool:
    size, members = len(members), members[image[members] >= 0]
    beside = members[:, None] + around
    real = (image[beside] >= 0) & (owner[beside] != n)
    more = image[beside] > image[members][:, None]
    brighter, darker = int((real & more).sum()), int((real & ~more).sum())
    # both by the group's size first, so that a ratio at the bound is rounded as in the original
    return darker > 0 and (brighter / size) / (darker / size) < most_ratio


def clouds(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """``frame_idx, blob_id, cloud_id, cloud_size``: groups connected by pairs, in either direction; the cloud is named by its least group.
    ``pairs`` may come from the same table as ``groups``."""
    pairs = pairs.select(F.col("frame_idx").alias("pair_frame"), F.col("blob_id").alias("a"), F.col("other_id").alias("b"))

    def run(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(own["blob_id"].unique())
        root = dict(zip(ids.tolist(), ids.tolist(), strict=True))

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = a = root[root[a]]
            return a

        for a, b in zip(links["a"].tolist(), links["b"].tolist(), strict=True):
            if a in root and b in root:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        cloud = pd.Series([find(i) for i in ids.tolist()], index=ids)
        return pd.DataFrame({"frame_idx": own["frame_idx"].iloc[0], "blob_id": ids, "cloud_id": cloud.to_numpy(), "cloud_size": cloud.map(cloud.value_counts()).to_numpy()}) if len(ids) else pd.DataFrame({c: [] for c in ("frame_idx", "blob_id", "cloud_id", "cloud_size")})

    return groups.groupBy("frame_idx").cogroup(pairs.groupBy("pair_frame")).applyInPandas(run, "frame_idx int, blob_id int, cloud_id int, cloud_size int")
