"""Written tables between steps, and places in an order that no single task sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder of ``spark.checkpoint.dir``: computed once, and there after an executor is lost. Only a local session may do
    without that setting."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(folder or _OWN.setdefault('dir', 'file://' + tempfile.mkdtemp(prefix='spark-'))).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, keys: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``rows`` with ``before``: how many rows with the same ``keys`` come before each by ``order``, or the sum of their ``weight``.

    Rows are dealt by ranges of keys and order, so a key's rows may lie in many tasks; each range counts its own and the ranges before it are added. Ties are
    counted one after another in any order, so ``order`` should tell rows apart.
    """
    amount = F.col(weight) if weight else F.lit(1)
    dealt = written(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), "ranges")
    running = Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part", *keys).agg(F.sum(amount).alias("own"))
    # a row for each range and key that meet
    earlier = totals.withColumn("ahead", F.coalesce(F.sum("own").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("own")
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    inside = dealt.withColumn("inside", F.coalesce(F.sum(amount).over(running), F.lit(0)))
    joined = inside.alias("d").join(earlier.alias("e"), [F.col("e.part") == F.col("d.part"), *same])
    return joined.select(*[F.col(f"d.{c}") for c in rows.columns], (F.col("d.inside") + F.col("e.ahead")).alias("before"))
