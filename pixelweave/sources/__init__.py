"""Tables as image sequences: pixels, labels, decisions and training rows from relational data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 128, 96
#: Pixels above this are labelled.
LABELLED = 30_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sparse_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_idx, x, y, intensity`` of `lineitem`: a frame for each month of shipping, 128 by 96."""
    t = table(spark, sf_dir, "lineitem")
    frame = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 23940).cast("int").alias("frame_idx")
    cell = [(F.col("l_partkey") % WIDTH).cast("int").alias("x"), (F.col("l_suppkey") % HEIGHT).cast("int").alias("y")]
    return t.groupBy(frame, *cell).agg(F.max(F.floor(F.col("l_extendedprice") / 2)).cast("int").alias("intensity"))


def dense_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_idx, x, y, intensity`` of `embeddings`: 64 vectors of 64 components are a frame."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return t.select(F.floor(F.col("vec_id") / 64).cast("int").alias("frame_idx"), F.col("x").cast("int").alias("x"), (F.col("vec_id") % 64).cast("int").alias("y"), F.floor(F.abs(F.col("v").cast("double")) * 100000).cast("int").alias("intensity"))


def labelled_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_idx, blob_id, x, y, intensity``: a label image; bright pixels of one 8 by 8 cell are a group."""
    px = sparse_pixels(spark, sf_dir).where(F.col("intensity") > LABELLED)
    cell = F.floor(F.col("y") / 8) * 16 + F.floor(F.col("x") / 8) + 1
    return px.select("frame_idx", cell.cast("int").alias("blob_id"), "x", "y", "intensity")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frame_idx, group_id, reason_kind, reason_value, will_paint`` of `events`: one group each, undecided unless bought or failed."""
    t = table(spark, sf_dir, "events")
    paint = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    day = F.datediff(F.col("ts"), F.lit("2020-01-01").cast("date")).cast("int")
    return t.select(day.alias("frame_idx"), F.col("event_id").alias("group_id"), F.when(paint.isNotNull(), F.lit("userSelected")).alias("reason_kind"), F.when(paint.isNotNull(), F.col("value")).alias("reason_value"), paint.alias("will_paint"), (F.col("user_id") % WIDTH).cast("int").alias("min_x"), (F.col("event_id") % HEIGHT).cast("int").alias("min_y"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, f0, f1, f2``: labelled documents by sizes of their text."""
    # sizes are taken before the join, so that no text is shuffled
    upper = F.length(F.regexp_replace("text", "[^A-Z]", ""))
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("double").alias("f0"), upper.cast("double").alias("f1"), F.length(F.regexp_replace("text", "[A-Za-z]", "")).cast("double").alias("f2"))
    joined = table(spark, sf_dir, "labels").join(sizes, "doc_id")
    return joined.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("label"), "f0", "f1", "f2")
