"""From raw documents to training sequences: five operators of ``pixelweave.llm``, one after the other.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; what it returns
is written as Parquet and read again as the next one's ``docs``. Each stage sets how much text goes to Python at a time, as all of them share the executors' memory. All stages keep all columns, whatever their names, but the last, which returns
pieces; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelweave.llm import decontaminate, packing, pii, quality, simhash
from pixelweave.llm.common import small_batches, table, written
from pixelweave.llm.tokens import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored as empty; null ids, ties and repeated rows make no
    difference, as a text alone decides; without labels all documents stay."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word similarity of 0.8 or more) the row of the smallest id stays, of rows that repeat id and text one.
    Null, empty and blank texts are one group; rows without an id are decided by their text and come after all ids."""
    small_batches(spark)
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none; null ids and repeated rows make no difference."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind. Every row stays; null and empty texts stay as they are. Of overlapping spans the first, then the
    longer one, counts."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence. A null or empty text is its end alone; null ids and repeated rows are packed like
    others; pieces of one length go by their place in the table."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", keep_good), ("near-duplicates", keep_one), ("decontamination", drop_leaks), ("personal data", mask_personal), ("packing", pack)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
