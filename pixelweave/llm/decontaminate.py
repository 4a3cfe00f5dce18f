"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

An item of n distinct shingles is contained in a document if the document has ``ceil(threshold * n)`` of
them or more. Items are grouped by size; an item's sketch is its ``n - ceil(threshold * n) + 1`` shingles
of least hash. As a containing document misses at most ``n - ceil(threshold * n)`` shingles, it has one of
the sketch, so the search loses nothing. A document is searched only with shingles whose hash is no
greater than the greatest of any sketch, only for sizes that it can contain, and what is found is
verified by counting the item's shingles in the document, as strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import clean_text, let, small_side, written

#: Sizes are grouped by powers of this.
SIZE_BASE = 1.25
_KEY = "_key_of_text"
WHITE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; an empty array if there is none."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), WHITE), lambda w: w != "")


def _runs(words: Column, k: int, f: Callable[[Column], Column], kind: str) -> Column:
    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: f(F.slice(w, i, k)))
        return F.when(n >= k, many).when(n > 0, F.array(f(w))).otherwise(F.array().cast(f"array<{kind}>"))

    return let(words, of)


def shingles_of(words: Column, k: int) -> Column:
    """All runs of ``k`` words, joined by a space; the whole sequence if it is shorter, nothing if empty."""
    return _runs(words, k, lambda w: F.array_join(w, " "), "string")


def hashes_of(words: Column, k: int) -> Column:
    """Hashes of the shingles, from the words' hashes."""
    return _runs(F.transform(words, lambda w: F.xxhash64(w)), k, lambda h: F.xxhash64(h), "bigint")


def contained(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment`` of each pair whose containment reaches ``threshold``.

    Null texts count as empty. Items without words are in no document. Items that share an id are one item
    with the shingles of all; documents that share an id are searched each by itself, and a pair has the
    best of them. Rows without an id are left out, as no pair can name them. A text shorter than a shingle
    is one shingle. Either table empty: no pairs.
    """
    spark = docs.sparkSession
    item = clean_text(items, item_col, item_text_col).where("doc_id is not null").select(F.col("doc_id").alias("item_id"), words_of(F.col("text")).alias("w"))
    both = F.arrays_zip(shingles_of(F.col("w"), words).alias("shingle"), hashes_of(F.col("w"), words).alias("h"))
    item = written(item.select("item_id", F.explode(both).alias("s")).select("item_id", "s.shingle", "s.h").distinct(), "benchmark-shingles")
    size = item.groupBy("item_id").agg(F.count("*").cast("int").alias("n_shingles"), F.array_sort(F.collect_list("h")).alias("hs"))
    size = size.withColumn("need", F.ceil(F.col("n_shingles") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    size = size.withColumn("part", F.floor(F.log(F.col("need").cast("double")) / F.log(F.lit(SIZE_BASE))).cast("int"))
    # equal hashes of different shingles only lengthen a sketch's reach
    sketch = written(size.select("item_id", "need", "part", F.explode(F.expr("slice(hs, 1, n_shingles - need + 1)")).alias("h")).distinct(), "benchmark-sketches")
    parts = sketch.groupBy("part").agg(F.min("need").alias("need"), F.max("h").alias("reach")).orderBy("need").collect()  # a row for each power of SIZE_BASE
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shingles int, n_found int, containment double")
    # the greatest hash with which a document of n shingles is searched: that of the parts it can contain
    n, reach = F.size("hs"), F.lit(None).cast("long")
    most = parts[0]["reach"]
    for p in parts:
        most = max(most, p["reach"])
        reach = F.when(n >= p["need"], F.lit(most)).otherwise(reach)
    doc = clean_text(docs, id_col, text_col).where("doc_id is not null").withColumn("copy", F.xxhash64("text"))
    hashed = doc.select("doc_id", "copy", hashes_of(words_of(F.col("text")), words).alias("hs")).select("doc_id", "copy", "hs", n.alias("n"), reach.alias("reach")).where("reach is not null")
    probe = hashed.select("doc_id", "copy", "n", F.explode(F.filter("hs", lambda h: h <= F.col("reach"))).alias("h"))
    found = probe.join(small_side(sketch.select("item_id", "need", "h")), "h").where("n >= need")
    candidates = written(found.select("doc_id", "copy", "item_id").distinct(), "contamination-candidates")
    texts = doc.join(small_side(candidates.select("doc_id", "copy").distinct()), ["doc_id", "copy"], "left_semi")
    texts = texts.select("doc_id", "copy", F.explode(F.array_distinct(shingles_of(words_of(F.col("text")), words))).alias("shingle"))
    counted = texts.join(small_side(item.select("item_id", "shingle")), "shingle").join(candidates, ["doc_id", "copy", "item_id"], "left_semi")
    counted = counted.groupBy("doc_id", "copy", "item_id").agg(F.countDistinct("shingle").cast("int").alias("n_found"))
    counted = counted.groupBy("doc_id", "item_id").agg(F.max("n_found").alias("n_found")).join(small_side(size.select("item_id", "n_shingles", "need")), "item_id")
    return counted.where("n_found >= need").select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without those that contain an item.

    Rows are decided by their text, so those with a null or repeated id are like all others. Null and empty texts contain nothing and stay, as do
    repeated clean rows and all columns, whatever their names. Without items all rows stay.
    """
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = contained(docs.select(key.alias("doc_id"), "text"), items, words, threshold)
    bad = written(found.select(F.col("doc_id").alias(_KEY)).distinct(), "contaminated")
    return docs.withColumn(_KEY, key).join(small_side(bad), _KEY, "left_anti").select(*docs.columns)
