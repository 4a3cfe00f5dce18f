"""Files that stand beside a sequence: its frames by name, feature tables, decisions."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.functions.tables import placed

#: The features of a group, in the fixed order that feature files use.
FEATURES = (
    "size", "width", "height", "centerX", "centerY", "minX", "minY", "maxX", "maxY", "hypotenuse", "aspectRatio", "fillAmount", "surfaceAreaRatio",
    "averagebrightness", "medianBrightness", "maxBrightness", "numberOfNearbyOutliersInSameFrame", "maxHoughTransformCount", "pixelBorderAmount",
    "averageLineVariance", "medianLineVariance", "lineLength", "nearbyDirectOverlapScore", "boundingBoxOverlapScore", "lineFillAmount",
)
SPECIAL = {"nanValue": "nan", "positiveInf": "inf", "negativeInf": "-inf"}


def frames(paths: DataFrame, suffixes: tuple[str, ...] = (".tif", ".tiff")) -> DataFrame:
    """``frame_idx, path, base_name`` of ``paths(path)``: image files in the order of their names without suffix, numbered from 0.

    Names are compared as text, and numbered by ranges of them."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("base_name")).where(F.lower(F.col("path")).rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    numbered = placed(rows.withColumn("all", F.lit(1)), ["all"], ["base_name", "path"])
    return numbered.select(F.col("before").cast("int").alias("frame_idx"), "path", "base_name")


def write_features(features: DataFrame, folder: str, names: tuple[str, ...] = FEATURES) -> None:
    """``group_id`` and the features without a header, and their names in a file of their own. What is there already stays."""
    spark = features.sparkSession
    spark.createDataFrame([(",".join(names),)], "value string").coalesce(1).write.mode("ignore").text(f"{folder}/types.csv")
    features.select("group_id", *[F.col(n).cast("double") for n in names]).write.mode("ignore").options(**SPECIAL).csv(f"{folder}/outlier_data.csv")


def _same_names(spark: SparkSession, folder: str, names: tuple[str, ...]) -> bool:
    first = spark.read.text(f"{folder}/types.csv").first()
    return first is not None and tuple(first[0].strip().split(",")) == names


def _rows(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """The fields of lines as text, by name. Of each file a last line with too few or too many fields goes; other short lines have nulls at their end."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.split("value", ",").alias("fields"), F.col("_metadata.file_path").alias("file"), place.alias("place"), "value")
    lines = lines.where(F.trim("value") != "")
    last = lines.groupBy("file").agg(F.max("place").alias("place"))  # a row for each file
    broken = last.join(lines.where(F.size("fields") != len(names)), ["file", "place"]).select("file", "place")
    return lines.join(broken, ["file", "place"], "left_anti").select(*[F.trim(F.get("fields", F.lit(i))).alias(n) for i, n in enumerate(names)])


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).alias(name)


def read_features(spark: SparkSession, folder: str, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``group_id`` and the features. A folder whose names differ has no rows; what isn't a number is 0, and a broken last line goes."""
    rows = _rows(spark, f"{folder}/outlier_data.csv", ("group_id", *names)).select(F.col("group_id").try_cast("long").alias("group_id"), *map(_number, names))
    return rows if _same_names(spark, folder, names) else rows.where(F.lit(False))


def read_labelled(spark: SparkSession, folder: str, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``label`` and the features of the two files of classified rows, which have no ids. Guarded as `read_features`."""
    parts = [_rows(spark, f"{folder}/{kind}_data.csv", names).select(F.lit(kind == "positive").alias("label"), *map(_number, names)) for kind in ("positive", "negative")]
    rows = parts[0].unionByName(parts[1])
    return rows if _same_names(spark, folder, names) else rows.where(F.lit(False))


def label_features(features: DataFrame, decisions: DataFrame) -> DataFrame:
    """Features with the decision of their group as ``label``; undecided groups go."""
    decided = decisions.where(F.col("will_paint").isNotNull()).select("frame_idx", "group_id", F.col("will_paint").alias("label"))
    return features.join(decided, ["frame_idx", "group_id"])


def write_decisions(decisions: DataFrame, folder: str) -> None:
    """Decided groups as JSON, a folder for each frame; only frames that ``decisions`` holds are replaced."""
    rows = decisions.where(F.col("will_paint").isNotNull()).select("frame_idx", "group_id", "reason_kind", "reason_value", "will_paint")
    rows.repartition("frame_idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frame_idx").json(folder)


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    schema = "group_id long, reason_kind string, reason_value double, will_paint boolean, frame_idx int"
    return spark.read.schema(schema).json(folder).select("frame_idx", "group_id", "reason_kind", "reason_value", "will_paint")


def read_config(spark: SparkSession, path: str) -> dict[str, object]:
    """A sequence's settings, one JSON object; what is missing is missing here too."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


SLICES = "frame_idx int, ord int, min_x int, min_y int, max_x int, max_y int"


def write_slices(slices: DataFrame, folder: str) -> None:
    """The user's slices as JSON, a folder for each frame; frames that ``slices`` doesn't hold keep theirs."""
    rows = slices.select("frame_idx", "ord", "min_x", "min_y", "max_x", "max_y")
    rows.repartition("frame_idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frame_idx").json(folder)


def read_slices(spark: SparkSession, folder: str) -> DataFrame:
    """``frame_idx, ord, min_x, min_y, max_x, max_y``; none if nothing was written yet. Broken lines are left out; ``ord`` is 0 where it wasn't written."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(SLICES).option("mode", "DROPMALFORMED").json(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], SLICES)
    return rows.select("frame_idx", F.coalesce("ord", F.lit(0)).alias("ord"), "min_x", "min_y", "max_x", "max_y")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``base, sequence`` of a JSON object of folders with lists of validated sequences; a broken one gives no row."""
    text = spark.read.text(path, wholetext=True)
    lists = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("base", "sequences"))
    return lists.select("base", F.explode("sequences").alias("sequence"))


def read_many_features(spark: SparkSession, folders: list[str], names: tuple[str, ...] = FEATURES) -> DataFrame:
    """The feature tables of many frames as one; folders whose names differ have no rows."""
    return functools.reduce(DataFrame.unionByName, [read_features(spark, f, names) for f in folders])
