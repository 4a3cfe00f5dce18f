"""Each operator as a query over tables read as image sequences (see `pixelweave.sources`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions import box, box_crossings, centre_theta, crossing, edge_distance, line_through, mean_pixel, overlap_amount, packed, pixel_difference, polar, polar_points, same_line, shifted, unpacked, y_at
from pixelweave.functions.tables import written
from pixelweave.operators import filters, group, grow, learn, lines, pixel, review
from pixelweave.sources.files import FEATURES as FEATURE_NAMES
from pixelweave.sources import HEIGHT, LABELLED, WIDTH, decisions, dense_pixels, labelled_pixels, sparse_pixels, training_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FEATURES = ["f0", "f1", "f2"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _channels(px: DataFrame, shift: int = 0) -> DataFrame:
    alpha = F.when((F.col("x") + F.col("y")) % 7 == 0, 65534).otherwise(65535)
    return px.select((F.col("frame_idx") - shift).alias("frame_idx"), "x", "y", F.col("intensity").alias("r"), F.floor(F.col("intensity") / 2).cast("int").alias("g"), F.floor(F.col("intensity") / 4).cast("int").alias("b"), alpha.alias("a"))


def _later(px: DataFrame) -> DataFrame:
    return px.withColumn("frame_idx", F.col("frame_idx") - 1)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.statistics(labelled_pixels(spark, sf_dir))


@query
def px_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_pixels(spark, sf_dir)


@query
def px_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_pixels(spark, sf_dir)


@query
def subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = sparse_pixels(spark, sf_dir)
    return pixel.subtract(_channels(px), _channels(px, 1))


@query
def admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.admit(sparse_pixels(spark, sf_dir), LABELLED, 50.0, HEIGHT, 10)


@query
def contrast_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.contrast_edges(sparse_pixels(spark, sf_dir), 20.0)


@query
def seed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.seed_candidates(sparse_pixels(spark, sf_dir), LABELLED)


@query
def border_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.border_brightness(labelled_pixels(spark, sf_dir), sparse_pixels(spark, sf_dir))


@query
def alpha_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.alpha_plane(sparse_pixels(spark, sf_dir).where(F.col("intensity") > 48_000), WIDTH, HEIGHT)


@query
def blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = sparse_pixels(spark, sf_dir)
    return pixel.paint(px, _later(px), alpha_plane(spark, sf_dir))


@query
def dilate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.dilate(labelled_pixels(spark, sf_dir), WIDTH, HEIGHT)


@query
def blob_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query
def qualify_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.qualify(_stats(spark, sf_dir), 2, 32_000, 5, 36_000)


@query
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.near(_stats(spark, sf_dir), labelled_pixels(spark, sf_dir), 4)


@query
def isolated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.isolated(_stats(spark, sf_dir), labelled_pixels(spark, sf_dir), 6, 3, 1, 24).select("frame_idx", "blob_id", "size")


@query
def dim_isolated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.dim_isolated(_stats(spark, sf_dir), labelled_pixels(spark, sf_dir), 6, 4).select("frame_idx", "blob_id", "size")


@query
def bbox_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.overlapping_bounds(_stats(spark, sf_dir))


@query
def feature_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.shape_features(_stats(spark, sf_dir), WIDTH, HEIGHT)


@query
def surface_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.surface_ratio(labelled_pixels(spark, sf_dir))


@query
def diag_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.diagonal_border(labelled_pixels(spark, sf_dir))


@query
def nearby_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.nearby_count(_stats(spark, sf_dir), labelled_pixels(spark, sf_dir), WIDTH, 20)


@query
def direct_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.direct_overlap(labelled_pixels(spark, sf_dir))


@query
def bbox_overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.bounds_overlap(_stats(spark, sf_dir), labelled_pixels(spark, sf_dir))


@query
def razor(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = labelled_pixels(spark, sf_dir)
    boxes = px.select("frame_idx").distinct().select("frame_idx", F.lit(10).alias("min_x"), F.lit(10).alias("min_y"), F.lit(40).alias("max_x"), F.lit(30).alias("max_y"))
    return group.razor(px, boxes)


@query
def overlapping_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.overlapping(labelled_pixels(spark, sf_dir))


@query
def frame_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.frame_links(sparse_pixels(spark, sf_dir))


@query
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = sparse_pixels(spark, sf_dir)
    return review.incremental_plan(frames, frames.select("frame_idx").distinct().where("frame_idx % 11 <> 5"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.votes(dense_pixels(spark, sf_dir).where(F.col("intensity") > LABELLED), 3)


@query
def hough_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.peaks(_votes(spark, sf_dir), 10)


@query
def theta_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.theta_histogram(_votes(spark, sf_dir))


@query
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.decision_counts(decisions(spark, sf_dir))


@query
def apply_undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = review.apply_undecided(decisions(spark, sf_dir), (F.col("group_id") % 21 - 10) / 10.0)
    return d.select("frame_idx", "group_id", "reason_kind", F.round("reason_value", 6).alias("reason_value"), "will_paint")


@query
def validation_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.override(labelled_pixels(spark, sf_dir), sparse_pixels(spark, sf_dir).where(F.col("intensity") > 49_000))


@query
def select_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = review.decision_counts(decisions(spark, sf_dir)).select("frame_idx", (F.col("n_positive") > 1).alias("will_paint"))
    s = _stats(spark, sf_dir).join(g, "frame_idx", "left")
    return review.select_inside(s, (10, 60), (0, 0, 63, 63), True).select("frame_idx", "blob_id", "will_paint")


@query
def delete_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.delete_inside(_stats(spark, sf_dir), (10, 60), (0, 0, 63, 63)).select("frame_idx", "blob_id")


@query
def next_positive_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.next_frame_with(review.decision_counts(decisions(spark, sf_dir)), "n_positive")


@query
def fold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.fold_split(training_rows(spark, sf_dir), 8).select("id", "label", "fold")


@query
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.chunk_split(training_rows(spark, sf_dir), 6).select("id", "label", "chunk")


@query
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.train_test_split(training_rows(spark, sf_dir)).select("id", "label", "is_test")


@query
def class_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = learn.class_statistics(training_rows(spark, sf_dir).withColumn("node", F.lit(1)), FEATURES)
    return s.select("label", "feature", "low", "high", F.round("mean", 6).alias("mean"), "median")


@query
def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(training_rows(spark, sf_dir).withColumn("node", F.lit(1)), "training-rows")
    return learn.split_scores(rows, FEATURES, learn.thresholds(learn.class_statistics(rows, FEATURES))).select("feature", "threshold", "score")


@query
def forest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: trees are grown level by level."""
    rows = written(training_rows(spark, sf_dir), "training-rows")
    trees = learn.forest(rows, FEATURES, 3, 3)
    return rows.select("id", "label", F.round(learn.forest_score(trees), 9).alias("score"))


@query
def grow_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: growth depends on the order of pixels. The dense frames are the originals too, and no rows at their bottom are ignored."""
    px = dense_pixels(spark, sf_dir)
    return grow.grow_groups(pixel.admit(px, LABELLED, 50.0, 64, 0), LABELLED, 50.0, px)


@query
def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure over each frame's pairs."""
    px = labelled_pixels(spark, sf_dir)
    stats = group.statistics(px)
    return grow.clouds(stats.select("frame_idx", "blob_id"), group.near(stats, px, 1))


@query
def disconnected_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: what goes depends on what has gone before."""
    return group.statistics(filters.run(labelled_pixels(spark, sf_dir), [("disconnected", filters.disconnected(2, 12, 0, 3))])).select("frame_idx", "blob_id", "size")


@query
def size_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: larger seeds take what smaller ones would reach."""
    return filters.size_clouds(labelled_pixels(spark, sf_dir), 1, 12)


@query
def isolated_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: groups that have gone no longer count, until nothing changes."""
    return group.statistics(filters.run(labelled_pixels(spark, sf_dir), [("isolated", filters.isolated(2, 4, 3))])).select("frame_idx", "blob_id", "size")


@query
def dim_isolated_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL, like `isolated_in_order`."""
    return group.statistics(filters.run(labelled_pixels(spark, sf_dir), [("dim-isolated", filters.dim_isolated(4, 4))])).select("frame_idx", "blob_id", "size")


@query
def connect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: lines are fitted again to what they joined."""
    return group.statistics(filters.run(labelled_pixels(spark, sf_dir), [("connect", filters.connected_by_lines(1, 12, 2, WIDTH, HEIGHT, 1))]))


@query
def filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: all the usual filters in order, some of them until nothing changes, and two slices of each frame."""
    px = labelled_pixels(spark, sf_dir)
    return group.statistics(filters.run(px, filters.default_steps(1, 31_000, 3, 34_000, WIDTH, HEIGHT), _slices(px)))


def _slices(px: DataFrame) -> DataFrame:
    boxes = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ord", "min_x", "min_y", "max_x", "max_y"), b, strict=True)]) for b in ((1, 10, 10, 40, 30), (2, 30, 20, 60, 50))])
    return px.select("frame_idx").distinct().select("frame_idx", F.explode(boxes).alias("b")).select("frame_idx", "b.*")


def _lines(px: DataFrame) -> DataFrame:
    return written(lines.best_lines(px), "lines")


@query
def best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.best_lines(labelled_pixels(spark, sf_dir))


@query
def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = labelled_pixels(spark, sf_dir)
    return lines.line_fit(px, _lines(px))


@query
def line_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = labelled_pixels(spark, sf_dir)
    return lines.line_fill(group.statistics(px), px, _lines(px))


@query
def line_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = labelled_pixels(spark, sf_dir)
    return lines.line_trim(px, _lines(px))


@query
def stray_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = labelled_pixels(spark, sf_dir)
    return lines.line_trim(px, _lines(px), stray=True)


@query
def neighbour_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.neighbour_trim(labelled_pixels(spark, sf_dir))


@query
def line_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each best line through two of its points and back, where it is at x = 10, and where it meets the line y = x."""
    rows = lines.best_lines(labelled_pixels(spark, sf_dir))
    x1, y1, x2, y2 = polar_points(F.col("theta").cast("double"), F.col("rho").cast("double"))
    a, b, c = (F.col(n) for n in ("la", "lb", "lc"))
    rows = rows.select(*group.ID, *[v.alias(n) for v, n in zip(line_through(x1, y1, x2, y2), ("la", "lb", "lc"), strict=True)])
    theta, rho = polar(a, b, c)
    met = crossing((a, b, c), (F.lit(1.0), F.lit(-1.0), F.lit(0.0)))
    r = lambda v: F.round(v, 4) + 0.0
    return rows.select(*group.ID, r(rho).alias("rho"), r(F.cos(F.radians(theta))).alias("cosine"), r(F.when(F.abs(b) > 1e-6, y_at(a, b, c, F.lit(10.0)))).alias("y_at_10"), r(F.when(F.abs(a + b) > 1e-6, met["x"])).alias("met_x"), same_line((a, b, c), (a, b, c)).alias("same"))


@query
def box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near groups of a frame: how their bounds lie to each other, and how many sides of the first the line of their centres meets."""
    stats = _stats(spark, sf_dir)
    bounds = ["min_x", "min_y", "max_x", "max_y"]
    pairs = group.near(stats, labelled_pixels(spark, sf_dir), 4).where("blob_id < other_id")
    one = stats.select("frame_idx", F.col("blob_id").alias("blob_id"), *[F.col(c).alias(f"p_{c}") for c in bounds])
    two = stats.select("frame_idx", F.col("blob_id").alias("other_id"), *[F.col(c).alias(f"q_{c}") for c in bounds])
    p, q = box("p_"), box("q_")
    both = pairs.join(one, ["frame_idx", "blob_id"]).join(two, ["frame_idx", "other_id"])
    diagonal = line_through(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    r = lambda v: F.round(v, 6) + 0.0
    return both.select("frame_idx", "blob_id", "other_id", r(overlap_amount(p, q)).alias("overlap"), r(centre_theta(p, q)).alias("theta"), r(edge_distance(p, q)).alias("edge_distance"), F.size(box_crossings(p, diagonal)).alias("n_met"))


@query
def pixel_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group.pixel_overlap(labelled_pixels(spark, sf_dir), _stats(spark, sf_dir))


@query
def theta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.theta_match(lines.theta_histogram(_votes(spark, sf_dir)))


#: Of each feature its column in the tables it is made of.
FEATURE_COLUMNS = dict(zip(FEATURE_NAMES, (
    "f_size", "f_width", "f_height", "f_center_x", "f_center_y", "f_min_x", "f_min_y", "f_max_x", "f_max_y", "f_hypotenuse", "f_aspect_ratio", "f_fill_amount", "f_surface_ratio", "f_average_brightness",
    "f_median_brightness", "f_max_brightness", "f_nearby", "f_max_hough", "f_pixel_border", "f_average_line", "f_median_line", "f_line_length", "f_direct_overlap", "f_bounds_overlap", "f_line_fill",
), strict=True))


@query
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every group, in the order of feature files."""
    px = written(labelled_pixels(spark, sf_dir), "labelled")
    stats, best = written(group.statistics(px), "statistics"), _lines(px)
    rows = group.shape_features(stats, WIDTH, HEIGHT)
    for more in (group.surface_ratio(px), group.diagonal_border(px), group.nearby_count(stats, px, WIDTH, 20), group.direct_overlap(px), group.bounds_overlap(stats, px), lines.line_fit(px, best), lines.line_fill(stats, px, best)):
        rows = rows.join(more, group.ID)
    return rows.select(*group.ID, *[F.col(c).cast("double").alias(n) for n, c in FEATURE_COLUMNS.items()])


@query
def mean_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean pixel of each place over all frames."""
    return _channels(sparse_pixels(spark, sf_dir)).groupBy("x", "y").agg(*mean_pixel())


@query
def channel_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _channels(sparse_pixels(spark, sf_dir))
    other = _later(px).select(*pixel.KEYS, *[F.col(c).alias(f"other_{c}") for c in "rgb"])
    return px.join(other, pixel.KEYS).select(*pixel.KEYS, pixel_difference().alias("difference"))


@query
def packed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels in one number and back."""
    px = _channels(sparse_pixels(spark, sf_dir))
    return px.select(*pixel.KEYS, packed(*[F.col(c) for c in "rgba"]).alias("packed")).select("*", *unpacked(F.col("packed")))


@query
def blend_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = written(sparse_pixels(spark, sf_dir), "sparse")
    alpha = pixel.alpha_plane(px.where(F.col("intensity") > 48_000), WIDTH, HEIGHT)
    other = _channels(_later(px)).withColumn("a", F.when((F.col("x") + F.col("y")) % 7 == 0, 65534).otherwise(65535))
    return pixel.paint_channels(_channels(px), other, alpha)


@query
def paint_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.paint_mask(alpha_plane(spark, sf_dir))


@query
def within_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixel.within_disc(sparse_pixels(spark, sf_dir).where(F.col("intensity") > 49_000), 3)


@query
def apply_unselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = review.apply_unselected(decisions(spark, sf_dir), (F.col("group_id") % 21 - 10) / 10.0)
    return d.select("frame_idx", "group_id", "reason_kind", F.round("reason_value", 6).alias("reason_value"), "will_paint")


@query
def select_undecided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.user_select(decisions(spark, sf_dir), review.undecided(), True).select("frame_idx", "group_id", "reason_kind", "reason_value", "will_paint")


@query
def scope_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One action in each kind of scope, one after the other."""
    d = decisions(spark, sf_dir)
    inside = F.col("min_x").between(10, 60) & F.col("min_y").between(10, 60)
    d = review.in_scope(d, review.scope("from", 300), "paint", inside)
    d = review.in_scope(d, review.scope("to", 20), "clear")
    d = review.in_scope(d, review.scope("next", 100, 10), "delete", inside)
    d = review.in_scope(d, review.scope("previous", 200, 10), "paint", review.undecided())
    return review.in_scope(d, review.scope("all"), "delete", F.col("min_x") == 127).select("frame_idx", "group_id", "reason_kind", "reason_value", "will_paint")


@query
def select_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that overlap the first group of frame 10, in frames 5 to 15, are to be painted."""
    px = labelled_pixels(spark, sf_dir)
    first = px.where("frame_idx = 10").agg(F.min("blob_id").alias("first_id"))
    chosen = px.where("frame_idx = 10").join(F.broadcast(first), F.col("blob_id") == F.col("first_id"))
    d = _stats(spark, sf_dir).where("frame_idx between 5 and 15").select("frame_idx", "blob_id", F.lit(None).cast("string").alias("reason_kind"), F.lit(None).cast("double").alias("reason_value"), F.lit(None).cast("boolean").alias("will_paint"))
    return review.select_overlapping(d, px, chosen, True).select("frame_idx", "blob_id", "reason_kind", "will_paint")


@query
def previous_undecided_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = review.decision_counts(decisions(spark, sf_dir))
    return review.advance(counts, F.col("n_undecided") > F.col("n_positive") + F.col("n_negative"), forward=False)


@query
def next_frame_of_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.advance(review.decision_counts(decisions(spark, sf_dir)), review.has_any())


@query
def group_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.table_view(group.shape_features(_stats(spark, sf_dir), WIDTH, HEIGHT).select("frame_idx", "blob_id", "f_width", "f_average_brightness"), "f_width")


@query
def linear_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    low, high = rows.agg(F.min("f0"), F.max("f0")).first()
    return rows.select("id", F.round(learn.linear_leaf(F.col("f0"), low, high), 9).alias("score"))


@query
def tree_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: trees of each subset of features, grown on the training part and judged on the rest."""
    # written first, as dealing rows by ranges reads them twice
    rows = written(learn.train_test_split(written(training_rows(spark, sf_dir), "training-rows")), "split-rows")
    subsets = learn.feature_subsets(FEATURES)
    each = F.explode(F.array(*[F.lit(i) for i in range(len(subsets))])).alias("tree")
    grown = learn.grow_trees(rows.where("not is_test").select("*", each), subsets, 3)
    trees = {"+".join(names): tree.column() for names, tree in zip(subsets, grown, strict=True)}
    return learn.report(trees, rows.where("is_test"))


def _drawn(px: DataFrame) -> DataFrame:
    """Four slices for each frame, some of which overlap."""
    at = lambda n, most: F.abs(F.col("frame_idx")) * n * F.col("ord") % most
    slices = px.select("frame_idx").distinct().select("frame_idx", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ord"))
    slices = slices.select("*", at(7, 90).alias("min_x"), at(5, 60).alias("min_y"))
    return slices.select("*", (F.col("min_x") + 20 + F.col("ord")).alias("max_x"), (F.col("min_y") + 15).alias("max_y"))


@query
def razor_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = labelled_pixels(spark, sf_dir)
    return group.razor_in_order(px, _drawn(px))


@query
def recorded_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = labelled_pixels(spark, sf_dir)
    return review.recorded_slices(_drawn(px), px)


@query
def decide_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame has a validation image."""
    px = labelled_pixels(spark, sf_dir)
    image = sparse_pixels(spark, sf_dir).where("frame_idx % 3 = 0").select("frame_idx", "x", "y", F.when(F.col("intensity") > 49_000, 255).otherwise(0).alias("value"))
    scores = px.select(*group.ID).distinct().where("blob_id % 5 > 0").withColumn("score", (F.col("blob_id") % 21 - 10) / 10.0)
    return review.decide(px, image, scores)


@query
def nearest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group nearest to each group's centre."""
    px = written(labelled_pixels(spark, sf_dir), "labelled")
    centre = lambda c: F.floor((F.col(f"min_{c}") + F.col(f"max_{c}") + 1) / 2).cast("int").alias(c)
    return group.nearest(group.statistics(px).select(*group.ID, centre("x"), centre("y")), px, 8)


@query
def nearest_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = labelled_pixels(spark, sf_dir)
    return lines.nearest_pixels(px, group.statistics(px), _lines(px), WIDTH // 2, HEIGHT // 2)


@query
def shifted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line given from the corner of its group's bounds, from the frame's corner."""
    px = labelled_pixels(spark, sf_dir)
    rows = group.statistics(px).join(_lines(px), group.ID)
    a, b, c = shifted(*lines.coefficients(), F.col("min_x"), F.col("min_y"))
    return rows.select(*group.ID, a.alias("a"), b.alias("b"), c.alias("c"))


@query
def walk_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = labelled_pixels(spark, sf_dir)
    return lines.walk_until(px, group.statistics(px), _lines(px), WIDTH, HEIGHT, 2)
