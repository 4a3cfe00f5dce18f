"""Filters of groups in order, as a frame's groups are gone through from the largest to the smallest (ties by id): what one loses, the next no longer sees.

A step changes a `Frame`, the groups of one frame. All steps of a frame run in one grouped function, so a pipeline is a single shuffle by frame, a frame is never larger than
its image, and one that has come to rest costs nothing while others are still changing. No step looks beyond its frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators import lines

#: Steps that run until nothing changes run so many times at most.
ROUNDS = 9
PIXELS = "frame_idx int, blob_id int, x int, y int, intensity int"


@dataclass(frozen=True)
class Group:
    """A group's pixels, as places in its frame's arrays."""

    id: int
    at: np.ndarray
    box: tuple[int, int, int, int]
    median: int

    @property
    def size(self) -> int:
        return len(self.at)


class Frame:
    """The groups of one frame. Which group a pixel was of at first stays as it is; groups that have gone or were joined are no longer in ``groups``."""

    def __init__(self, rows: pd.DataFrame, boxes: list[tuple[int, int, int, int]] | None = None) -> None:
        order = np.lexsort((rows["x"].to_numpy(), rows["y"].to_numpy()))
        self.x, self.y, self.value, self.first = (rows[c].to_numpy()[order].astype(np.int64) for c in ("x", "y", "intensity", "blob_id"))
        self.boxes = boxes or []
        by_id = np.argsort(self.first, kind="stable")
        parts = np.split(by_id, np.flatnonzero(np.diff(self.first[by_id])) + 1) if len(by_id) else []
        self.groups = {int(self.first[at[0]]): self.group(int(self.first[at[0]]), at) for at in parts}

    def group(self, own: int, at: np.ndarray) -> Group:
        x, y, v = self.x[at], self.y[at], np.sort(self.value[at])
        return Group(own, at, (int(x.min()), int(y.min()), int(x.max()), int(y.max())), int(v[len(v) // 2]))

    def by_size(self) -> list[Group]:
        return sorted(self.groups.values(), key=lambda g: (-g.size, g.id))

    def near(self, g: Group, scan: int) -> list[Group]:
        """The others that have a pixel within ``scan`` of a group's bounds, in order of id."""
        x0, y0, x1, y1 = g.box
        a, b = np.searchsorted(self.y, (y0 - scan, y1 + scan + 1))
        ids = np.unique(self.first[a:b][(self.x[a:b] >= x0 - scan) & (self.x[a:b] <= x1 + scan)]).tolist()
        return [self.groups[i] for i in ids if i != g.id and i in self.groups]

    def cloud(self, seed: Group, scan: int, done: set[int]) -> list[Group]:
        """What is near a seed, near that, and so on, without the seed. Groups in ``done`` are left out, those found are added to it."""
        found, todo = [], [seed]
        while todo:
            for other in self.near(todo.pop(0), scan):
                if other.id not in done:
                    done.add(other.id)
                    found.append(other)
                    todo.append(other)
        return found

    def clouds(self, scan: int, smaller_than: int, from_size: int) -> list[tuple[Group, list[Group]]]:
        """Seeds and their clouds, to be gone through one after the other, as a group may have gone when its turn comes. Every group is done once it has had its turn, whatever
        its size, so a larger one is in no later cloud."""
        done: set[int] = set()
        for g in self.by_size():
            if g.id in done:
                continue
            done.add(g.id)
            if from_size <= g.size < smaller_than:
                yield g, self.cloud(g, scan, done)

    def rows(self, frame_idx: int) -> pd.DataFrame:
        """A place that several groups hold is the largest one's, of equal ones that of the least id."""
        label = np.zeros(len(self.x), dtype=np.int64)
        for g in reversed(self.by_size()):
            label[g.at] = g.id
        kept = label > 0
        return pd.DataFrame({"frame_idx": frame_idx, "blob_id": label[kept], "x": self.x[kept], "y": self.y[kept], "intensity": self.value[kept]})


Step = Callable[[Frame], None]


def run(px: DataFrame, steps: list[tuple[str, Step]], slices: DataFrame | None = None) -> DataFrame:
    """``px(frame_idx, blob_id, x, y, intensity)`` after all steps in order. Ids are positive. ``slices(frame_idx, ord, min_x, min_y, max_x, max_y)`` are for the step `sliced`."""

    def frame(rows: pd.DataFrame, boxes: pd.DataFrame | None = None) -> pd.DataFrame:
        if rows.empty:
            return rows
        own = None if boxes is None else list(boxes.sort_values("slice_ord")[["min_x", "min_y", "max_x", "max_y"]].itertuples(index=False, name=None))
        f = Frame(rows, own)
        for _, step in steps:
            step(f)
        return f.rows(int(rows["frame_idx"].iloc[0]))

    grouped = px.select("frame_idx", "blob_id", "x", "y", "intensity").groupBy("frame_idx")
    if slices is None:
        return grouped.applyInPandas(lambda rows: frame(rows), PIXELS)
    # names of their own, as both sides may come from one table
    boxes = slices.select(F.col("frame_idx").alias("slice_frame"), F.col("ord").alias("slice_ord"), "min_x", "min_y", "max_x", "max_y")
    return grouped.cogroup(boxes.groupBy("slice_frame")).applyInPandas(lambda rows, own: frame(rows, own), PIXELS)


def fixpoint(step: Step, most: int = ROUNDS) -> Step:
    """``step`` again and again until no group goes, ``most`` times at most."""

    def repeated(f: Frame) -> None:
        for _ in range(most):
            n = len(f.groups)
            step(f)
            if len(f.groups) == n:
                break

    return repeated


def qualify(min_size: int, min_median: int, small_size: int, small_median: int) -> Step:
    """Drops groups that are too small, too dim, or both rather small and rather dim."""

    def step(f: Frame) -> None:
        f.groups = {i: g for i, g in f.groups.items() if g.size > min_size and g.median >= min_median and not (g.size < small_size and g.median < small_median)}

    return step


def isolated(scan: int = 12, need: int = 1, neighbour_over: int = 0, up_to: int = 24) -> Step:
    """Drops groups of ``up_to`` pixels or fewer that have under ``need`` neighbours larger than ``neighbour_over``, until nothing changes."""

    def step(f: Frame) -> None:
        for g in f.by_size():
            if g.size <= up_to and sum(o.size > neighbour_over for o in f.near(g, scan)) < need:
                del f.groups[g.id]

    return fixpoint(step)


def dim_isolated(scan: int = 12, need: int = 1, up_to: int = 24) -> Step:
    """Drops groups of ``up_to`` pixels or fewer that are no brighter than the frame's middle median and have under ``need`` neighbours brighter than the median a quarter up, until nothing
    changes; the medians are those of the groups there as a round begins."""

    def step(f: Frame) -> None:
        if not f.groups:
            return
        medians = sorted(g.median for g in f.groups.values())
        half, quarter = medians[len(medians) // 2], medians[len(medians) // 4]
        for g in f.by_size():
            if g.size <= up_to and g.median <= half and sum(o.median > quarter for o in f.near(g, scan)) < need:
                del f.groups[g.id]

    return fixpoint(step)


def disconnected(scan: int = 28, smaller_than: int = 24, from_size: int = 0, need: int = 4) -> Step:
    """Drops a seed of ``from_size`` to under ``smaller_than`` pixels with its whole cloud, if the cloud has under ``need`` groups and seed and cloud are under ``smaller_than`` pixels on average.
    A cloud's groups may be of any size, but larger ones than the seed have had their turn, so a small group beside a large one alone goes."""

    def step(f: Frame) -> None:
        for g, cloud in f.clouds(scan, smaller_than, from_size):
            if len(cloud) < need and sum(o.size for o in [g, *cloud]) < smaller_than * (len(cloud) + 1):
                for o in [g, *cloud]:
                    f.groups.pop(o.id, None)

    return step


def connected_by_lines(scan: int, smaller_than: int, border: int = 0, width: int = 1 << 15, height: int = 1 << 15, beside: int = 5, most_off: float = 50.0, rounds: int = 10, from_size: int = 0, least: int = 3) -> Step:
    """Joins what lies on the line of a cloud.

    A seed of ``from_size`` to under ``smaller_than`` pixels has a cloud; the pixels of the cloud, without the seed, have a best line. If they lie within ``most_off`` of it on average, the line is
    walked from ``border`` before to ``border`` after their bounds, ``beside`` places to either side. If more than one group is met, all are joined with the cloud to one group, which has
    the cloud's least id, and that one's line is walked again, ``rounds`` times more at most. Groups of a cloud that aren't met stay besides. What one cloud has joined the next sees as it is then.
    """

    def line(f: Frame, at: np.ndarray) -> tuple[int, ...] | None:
        return lines.best_line(f.x[at], f.y[at]) if len(at) >= least else None

    def met(f: Frame, keys: np.ndarray, at: np.ndarray, best: tuple[int, ...]) -> list[Group]:
        _, rho, cosine, sine, _, _ = best
        level = abs(sine) > abs(cosine)
        along, size = (f.x[at], width) if level else (f.y[at], height)
        t = np.arange(max(int(along.min()) - border, 0), min(int(along.max()) + border, size - 1) + 1)
        u = np.trunc((rho * lines.SCALE - (cosine if level else sine) * t) / (sine if level else cosine)).astype(np.int64)
        v = (u[:, None] + np.arange(-beside, beside + 1)).ravel()
        t = np.repeat(t, 2 * beside + 1)
        able = np.repeat(u >= 0, 2 * beside + 1) & (v >= 0)
        x, y = (t, v) if level else (v, t)
        able &= (x < width) & (y < height)
        asked = y[able] * (1 << 31) + x[able]
        found = np.searchsorted(keys, asked)
        found = found[(found < len(keys)) & (keys[np.minimum(found, len(keys) - 1)] == asked)]
        return [f.groups[i] for i in np.unique(f.first[found]).tolist() if i in f.groups]

    def step(f: Frame) -> None:
        keys = f.y * (1 << 31) + f.x
        for _, cloud in f.clouds(scan, smaller_than, from_size):
            if not cloud:
                continue
            own, at = min(g.id for g in cloud), np.unique(np.concatenate([g.at for g in cloud]))
            best = line(f, at)
            if best is None or best[5] / len(at) / lines.SCALE >= most_off:
                continue
            for _ in range(rounds + 1):
                found = met(f, keys, at, best)
                if len(found) < 2:
                    break
                at = np.unique(np.concatenate([at, *[g.at for g in found]]))
                for g in found:
                    del f.groups[g.id]
                f.groups[own] = f.group(own, at)
                best = line(f, at)

    return step


def sliced(f: Frame) -> None:
    """User slices, one after the other: the pixels in a box leave their groups and become a new group, whose id is one more than the greatest. Where boxes overlap the last one has the pixels."""
    for x0, y0, x1, y1 in f.boxes:
        inside = np.flatnonzero((f.x >= x0) & (f.x <= x1) & (f.y >= y0) & (f.y <= y1))
        held = np.zeros(0, dtype=np.int64)
        new = max(f.groups, default=0) + 1
        for g in list(f.groups.values()):
            cut = np.intersect1d(g.at, inside)
            if len(cut):
                held, rest = np.union1d(held, cut), np.setdiff1d(g.at, cut)
                del f.groups[g.id]
                if len(rest):
                    f.groups[g.id] = f.group(g.id, rest)
        if len(held):
            f.groups[new] = f.group(new, held)


def default_steps(min_size: int, min_median: int, small_size: int, small_median: int, width: int, height: int) -> list[tuple[str, Step]]:
    """The usual order: close groups on lines are joined, then small, dim, isolated and disconnected ones go in turn with more joining, then the user's slices."""
    return [
        ("connect-close", connected_by_lines(24, 80, 20, width, height)),
        ("qualify", qualify(min_size, min_median, small_size, small_median)),
        ("dim-isolated", dim_isolated(50, 2)),
        ("isolated", isolated(24, 1, 6)),
        ("disconnected-small", disconnected(60, 18, 0, 2)),
        ("connect-wider", connected_by_lines(30, 120, 10, width, height)),
        ("disconnected-large", disconnected(60, 50, 18, 2)),
        ("isolated-near", isolated(12, 1)),
        ("connect-last", connected_by_lines(20, 80, 0, width, height)),
        ("isolated-last", isolated(6, 1, 0, 50)),
        ("slices", sliced),
    ]


def size_clouds(px: DataFrame, scan: int, smaller_than: int, from_size: int = 0) -> DataFrame:
    """``frame_idx, blob_id, seed_id, cloud_size``: the cloud that each group is in, from seeds of falling size, each of which takes what it reaches and no earlier one took; ``cloud_size`` is
    without the seed. Groups of other sizes that no seed reaches have no row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(int(rows["frame_idx"].iloc[0]), g.id, seed.id, len(cloud)) for seed, cloud in Frame(rows).clouds(scan, smaller_than, from_size) for g in [seed, *cloud]]
        return pd.DataFrame(found, columns=["frame_idx", "blob_id", "seed_id", "cloud_size"])

    return px.groupBy("frame_idx").applyInPandas(run, "frame_idx int, blob_id int, seed_id int, cloud_size int")
