"""Decisions and review: counts, bulk selection and deletion, sequence planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Groups of each frame that will be painted, won't be, and are undecided."""
    p = F.col("will_paint")
    return decisions.groupBy("frame_idx").agg(F.count_if(p).alias("n_positive"), F.count_if(~p).alias("n_negative"), F.count_if(p.isNull()).alias("n_undecided"))


def apply_undecided(decisions: DataFrame, score: Column) -> DataFrame:
    """A classifier's score decides groups that have no decision; a score of 0 doesn't paint."""
    open_ = F.col("will_paint").isNull()
    changed = {"reason_kind": F.lit("fromClassifier"), "reason_value": score, "will_paint": score > 0}
    return decisions.withColumns({c: F.when(open_, v).otherwise(F.col(c)) for c, v in changed.items()})


def override(blob_px: DataFrame, validation_px: DataFrame) -> DataFrame:
    """``frame_idx, blob_id, will_paint``: a group is painted if any of its pixels is set in the validation image."""
    hit = validation_px.select("frame_idx", "x", "y").distinct().withColumn("hit", F.lit(1))
    return blob_px.join(hit, ["frame_idx", "x", "y"], "left").groupBy("frame_idx", "blob_id").agg((F.count("hit") > 0).alias("will_paint"))


def inside(box: tuple[int, int, int, int]) -> Column:
    """Whether a group's bounds lie in the box, edges included."""
    x0, y0, x1, y1 = box
    return (F.col("min_x") >= x0) & (F.col("min_y") >= y0) & (F.col("max_x") <= x1) & (F.col("max_y") <= y1)


def select_inside(groups: DataFrame, frames: tuple[int, int], box: tuple[int, int, int, int], paint: bool) -> DataFrame:
    """The user's decision for all groups inside a box in a run of frames; others keep theirs."""
    hit = F.col("frame_idx").between(*frames) & inside(box)
    return groups.withColumn("will_paint", F.when(hit, F.lit(paint)).otherwise(F.col("will_paint")))


def delete_inside(groups: DataFrame, frames: tuple[int, int], box: tuple[int, int, int, int]) -> DataFrame:
    """Without the groups inside a box in a run of frames."""
    return groups.where(~(F.col("frame_idx").between(*frames) & inside(box)))


def overlapping(blob_px: DataFrame) -> DataFrame:
    """``frame_idx, blob_id, other_id``: groups of the next frame that share a pixel's place with a group."""
    other = blob_px.select((F.col("frame_idx") - 1).alias("frame_idx"), F.col("blob_id").alias("other_id"), "x", "y")
    return blob_px.join(other, ["frame_idx", "x", "y"]).select("frame_idx", "blob_id", "other_id").distinct()


def frame_links(frames: DataFrame) -> DataFrame:
    """Each frame with the one before, the one after, and the one it is compared with: the next, or the last one's previous.

    Neighbours are rows of the dense frame numbering, so links are joins and no window over all frames is needed."""
    f = frames.select("frame_idx").distinct()
    before = f.select((F.col("frame_idx") + 1).alias("frame_idx"), F.col("frame_idx").alias("previous"))
    after = f.select((F.col("frame_idx") - 1).alias("frame_idx"), F.col("frame_idx").alias("next"))
    return f.join(before, "frame_idx", "left").join(after, "frame_idx", "left").withColumn("compared_with", F.coalesce("next", "previous"))


def incremental_plan(frames: DataFrame, done: DataFrame, radius: int = 2) -> DataFrame:
    """Frames without output, and those up to ``radius`` around them."""
    f = frames.select("frame_idx").distinct()
    missing = f.join(done.select("frame_idx"), "frame_idx", "left_anti")
    wanted = missing.select(F.explode(F.sequence(F.col("frame_idx") - radius, F.col("frame_idx") + radius)).alias("frame_idx")).distinct()
    return f.join(wanted, "frame_idx", "left_semi")


#: Frames of one task when the next frame of a kind is looked for.
FRAMES_A_BLOCK = 4096


def advance(counts: DataFrame, has: Column, forward: bool = True) -> DataFrame:
    """``frame_idx, advance_to``: for each frame the nearest later one, or earlier one, for which ``has`` is true; the last, or first, frame if there is none.

    ``counts`` has a row for each frame. Frames are searched by blocks, and a block's end goes on to the first hit of a later block, of which there is a row each."""
    block = F.floor(F.col("frame_idx") / FRAMES_A_BLOCK)
    rows = counts.select("frame_idx", block.alias("block"), F.when(has, F.col("frame_idx")).alias("hit"))
    pick, order = (F.min, "frame_idx") if forward else (F.max, F.desc("frame_idx"))
    later = Window.partitionBy("block").orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(pick("hit").alias("first"), F.max("frame_idx").alias("high"), F.min("frame_idx").alias("low"))
    beyond = Window.orderBy("block" if forward else F.desc("block")).rowsBetween(1, Window.unboundedFollowing)
    end = F.max("high").over(Window.partitionBy()) if forward else F.min("low").over(Window.partitionBy())
    ends = blocks.select("block", pick("first").over(beyond).alias("next"), end.alias("end"))
    return rows.withColumn("to", pick("hit").over(later)).join(ends, "block").select("frame_idx", F.coalesce("to", "next", "end").alias("advance_to"))


def next_frame_with(counts: DataFrame, column: str) -> DataFrame:
    """For each frame the next one whose ``column`` is above 0, or the last frame."""
    return advance(counts, F.col(column) > 0)


def has_any() -> Column:
    """Of `decision_counts`: whether a frame has groups of any kind."""
    return F.col("n_positive") + F.col("n_negative") + F.col("n_undecided") > 0


def apply_unselected(decisions: DataFrame, score: Column) -> DataFrame:
    """A classifier's score decides all groups but those that the user decided."""
    own = F.coalesce(F.col("reason_kind") == "userSelected", F.lit(False))
    changed = {"reason_kind": F.lit("fromClassifier"), "reason_value": score, "will_paint": score > 0}
    return decisions.withColumns({c: F.when(own, F.col(c)).otherwise(v) for c, v in changed.items()})


def user_select(decisions: DataFrame, which: Column, paint: bool) -> DataFrame:
    """The user's decision for the groups for which ``which`` is true: all of a scope, or those that are undecided."""
    hit = F.coalesce(which, F.lit(False))
    changed = {"reason_kind": F.lit("userSelected"), "reason_value": F.lit(float(paint)), "will_paint": F.lit(paint)}
    return decisions.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changed.items()})


def undecided() -> Column:
    return F.col("will_paint").isNull()


def scope(kind: str, frame: int = 0, n: int = 0) -> Column:
    """Which frames a choice is for: ``all``, ``from`` or ``to`` a frame, the ``next`` or ``previous`` n and the frame itself."""
    at = F.col("frame_idx")
    return {"all": F.lit(True), "from": at >= frame, "to": at <= frame, "next": at.between(frame, frame + n), "previous": at.between(frame - n, frame)}[kind]


def select_overlapping(decisions: DataFrame, blob_px: DataFrame, chosen: DataFrame, paint: bool) -> DataFrame:
    """The user's decision for the groups that share a pixel's place with ``chosen(x, y)``, in the frames of ``decisions``."""
    places = chosen.select("x", "y").distinct()
    hit = blob_px.join(places, ["x", "y"], "left_semi").select("frame_idx", "blob_id").distinct().withColumn("hit", F.lit(True))
    rows = decisions.join(hit, ["frame_idx", "blob_id"], "left")
    return user_select(rows, F.col("hit"), paint).select(*decisions.columns)


def in_scope(decisions: DataFrame, frames: Column, action: str, where: Column | None = None) -> DataFrame:
    """``paint``, ``clear`` or ``delete`` for the groups of a scope for which ``where`` is true, by default all."""
    hit = frames & (F.lit(True) if where is None else where)
    return decisions.where(~F.coalesce(hit, F.lit(False))) if action == "delete" else user_select(decisions, hit, action == "paint")


def table_view(groups: DataFrame, by: str = "size", descending: bool = False) -> DataFrame:
    """Groups as a list shows them: in order of a column, fractions to five significant digits."""

    def shown(c: Column) -> Column:
        unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - 4)
        return F.when(c == 0, c).otherwise(F.round(F.round(c / unit) * unit, 9))

    columns = [shown(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in groups.schema]
    order = F.desc(by) if descending else F.asc(by)
    return groups.orderBy(order, *[c for c in ("frame_idx", "blob_id") if c in groups.columns]).select(*columns)


def decide(blob_px: DataFrame, validation_px: DataFrame, scores: DataFrame) -> DataFrame:
    """``frame_idx, blob_id, reason_kind, reason_value, will_paint``. Frames with a validation image (any row of ``validation_px(frame_idx, x, y, value)``, also of value 0) are
    decided by it: what has a pixel set there is painted, as if the user had said so. In all others ``scores(frame_idx, blob_id, score)`` decide; a group without a score
    stays undecided."""
    groups = blob_px.select("frame_idx", "blob_id", "x", "y")
    images = validation_px.select("frame_idx").distinct().withColumn("image", F.lit(True))
    set_ = validation_px.where(F.col("value") != 0).select("frame_idx", "x", "y").distinct().withColumn("hit", F.lit(True))
    hits = groups.join(set_, ["frame_idx", "x", "y"], "left").groupBy("frame_idx", "blob_id").agg((F.count("hit") > 0).alias("hit"))
    rows = hits.join(images, "frame_idx", "left").join(scores.select("frame_idx", "blob_id", "score"), ["frame_idx", "blob_id"], "left")
    by_image = F.coalesce("image", F.lit(False))
    return rows.select(
        "frame_idx", "blob_id", F.when(by_image, F.lit("userSelected")).when(F.col("score").isNotNull(), F.lit("fromClassifier")).alias("reason_kind"),
        F.when(by_image, F.col("hit").cast("double")).otherwise(F.col("score")).alias("reason_value"), F.when(by_image, F.col("hit")).otherwise(F.col("score") > 0).alias("will_paint"))


def recorded_slices(slices: DataFrame, blob_px: DataFrame) -> DataFrame:
    """``frame_idx, ord, min_x, min_y, max_x, max_y`` of the slices that a frame's record holds after all were made in order of ``ord``: those that cut a pixel and that no later
    one which cut a pixel overlaps by more than an edge. Repeated rows count once; slices with a null anywhere cut nothing."""
    columns = ["frame_idx", "ord", "min_x", "min_y", "max_x", "max_y"]
    made = slices.select(*columns).distinct()
    inside = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    pixels = blob_px.select(F.col("frame_idx").alias("frame"), "x", "y")
    cut = made.join(pixels, (F.col("frame") == F.col("frame_idx")) & inside, "left_semi")
    later = cut.select(*[F.col(c).alias(f"later_{c}") for c in columns])
    over = (F.col("min_x") < F.col("later_max_x")) & (F.col("min_y") < F.col("later_max_y")) & (F.col("later_min_x") < F.col("max_x")) & (F.col("later_min_y") < F.col("max_y"))
    return cut.join(later, (F.col("frame_idx") == F.col("later_frame_idx")) & (F.col("later_ord") > F.col("ord")) & over, "left_anti")
