"""Hard negatives by slot-decomposed selection.

A positive of an anchor asks for the best negatives whose score lies in a window under the positive's own score. The windows of an anchor overlap, but they are
answered at once: the windows' upper limits cut scores into slots that don't overlap, every block of rows keeps the best few of each slot, and the best few under an upper
limit are the first of its slot and those below, which follow each other in falling order. A window's lower limit then cuts the end off.

Anchors meet rows in blocks of bounded size. A block keeps a few rows for each anchor, so no pairs leave it, and a label with many rows has many blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import small_side, written

#: The most anchors and rows, and of a table too small for a block for each task the least rows, that meet in one group on average.
ANCHORS, ROWS, LEAST_ROWS = 16_384, 16_384, 1_024
#: So many scores are held at once.
SCORES = 1 << 22


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """``vec_id, label, v``: components scaled to 256ths and rounded down, as whole doubles.

    Rows with a null id, label or vector, and those with a null or non-finite component, take no part; nor do vectors of another length than the commonest (of
    equally common ones the longest). Rows that are equal in all three count once. Other columns go, whatever their names.
    """
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.transform(F.when(finite, x), lambda c: F.floor(c * 256).cast("double")).alias("v"))
    rows = written(rows.where("vec_id is not null and label is not null and v is not null").dropDuplicates(), "negatives-rows")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows if length is None else rows.where(F.size("v") == length["n"])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of whole numbers; as doubles if those hold them."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return a @ b.T
    whole = [[int(x) for x in r] for r in a], [[int(x) for x in r] for r in b]
    return np.array([[sum(x * y for x, y in zip(p, q, strict=True)) for q in whole[1]] for p in whole[0]], dtype=np.int64).reshape(len(a), len(b))  # raises beyond 64 bits


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest allowed scores of each row; of equal ones those of the first columns."""
    least = -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min
    shown = np.where(allowed, scores, least)
    if shown.shape[1] > k:
        bound = np.partition(shown, shown.shape[1] - k, axis=1)[:, shown.shape[1] - k, None]
        allowed = allowed & (shown >= bound)
    r, c = np.nonzero(allowed)
    order = np.lexsort((c, -shown[r, c], r))
    r, c = r[order], c[order]
    first = np.r_[0, np.flatnonzero(np.diff(r)) + 1] if len(r) else np.zeros(0, dtype=int)
    place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
    return r[place < k], c[place < k]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _met(asked: DataFrame, rows: DataFrame, by: str | None, find, schema: str) -> DataFrame:
    """``find(anchors, rows)`` for each block of anchors with each block of rows, of equal ``by`` if it is given."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    group = F.lit(0).cast("long") if by is None else F.col(by)
    asked, rows = asked.withColumn("of", group), rows.withColumn("of", group)
    n = rows.groupBy("of").agg(F.count("*").alias("n")).join(asked.groupBy("of").agg(F.count("*").alias("m")), "of")
    sizes = written(n.select("of", F.greatest(F.ceil(F.col("n") / ROWS), F.least(F.lit(tasks), F.ceil(F.col("n") / LEAST_ROWS))).alias("nr"), F.ceil(F.col("m") / ANCHORS).alias("na")), "negatives-blocks")
    sizes = small_side(sizes)
    dealt = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c != "of"]), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, "of").select(*asked.columns, dealt(asked, "na").alias("a"), every("nr").alias("r"))
    right = rows.join(sizes, "of").select(F.col("of").alias("row_of"), F.col("vec_id"), F.col("label").alias("row_label"), F.col("v").alias("row_v"), dealt(rows, "nr").alias("row_r"), every("na").alias("row_a"))

    def run(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(other):
            other = other.sort_values("vec_id", kind="stable")  # of equal scores the smaller id comes first
            a, b = _matrix(own["v"]), _matrix(other["row_v"])
            step = max(1, SCORES // len(own))
            found = [find(own, other.iloc[at : at + step], _scores(a, b[at : at + step])) for at in range(0, len(other), step)]
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return left.groupBy("of", "a", "r").cogroup(right.groupBy("row_of", "row_a", "row_r")).applyInPandas(run, schema)


def _first(rows: DataFrame, of: list[str], score: str, key: str, k: int) -> DataFrame:
    """The first ``k`` of each group, also before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc(score), key))).where(F.col("place") <= k)


def positives(rows: DataFrame, anchor: Column, k: int = 5) -> DataFrame:
    """``anchor_id, anchor, positive_id, positive_score, place``: of each anchor, told from others of its id by the hash ``anchor``, the ``k`` rows of its label with the highest inner product, ties by the smaller id. A row never
    answers an anchor of its own id."""

    def find(own: pd.DataFrame, other: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        ids = other["vec_id"].to_numpy()
        r, c = _best(scores, own["anchor_id"].to_numpy()[:, None] != ids[None, :], k)
        return pd.DataFrame({"anchor_id": own["anchor_id"].to_numpy()[r], "anchor": own["anchor"].to_numpy()[r], "positive_id": ids[c], "positive_score": scores[r, c].astype(np.int64)})

    asked = rows.where(anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v").withColumn("anchor", F.xxhash64("anchor_id", "label", "v"))
    best = _met(asked, rows, "label", find, "anchor_id long, anchor long, positive_id long, positive_score long")
    best = _first(best, ["anchor_id", "anchor"], "positive_score", "positive_id", k)
    return best.select("anchor_id", "anchor", "positive_id", "positive_score", "place")


def mine(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its positives the first rows of other labels whose score is
    between ``low`` and ``high`` per cent of the positive's, both bounds included.

    ``rows(vec_id, label, v)`` are as `vectors` gives them; ``anchor`` is a condition on them. Scores are exact inner products; higher ones come first, ties by the smaller
    id. A positive without such rows, which includes every positive of a negative score, has no row in the result, nor has an anchor without positives. Rows of one id that
    differ are rows of their own, each an anchor of its own if it is one, but never answer each other. An empty table gives an empty one. Scores beyond 64 bits raise an error.
    """
    good = written(positives(rows, anchor, n_positives), "negatives-positives")
    windows = good.where("positive_score >= 0").select("*", F.expr(f"cast(positive_score as decimal(20,0)) * {high} div 100").alias("upper"), F.expr(f"(cast(positive_score as decimal(20,0)) * {low} + 99) div 100").alias("lower")).where("lower <= upper")
    slots = written(windows.groupBy("anchor_id", "anchor").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("tops"), F.min("lower").alias("least")), "negatives-slots")
    asked = rows.where(anchor).select(F.col("vec_id").alias("anchor_id"), "label", "v").withColumn("anchor", F.xxhash64("anchor_id", "label", "v")).join(slots, ["anchor_id", "anchor"])

    def find(own: pd.DataFrame, other: pd.DataFrame, scores: np.ndarray) -> pd.DataFrame:
        ids, found = other["vec_id"].to_numpy(), []
        tops = np.full((len(own), n_positives), np.iinfo(np.int64).min, dtype=np.int64)
        for i, t in enumerate(own["tops"]):
            tops[i, : len(t)] = t
        able = (own["label"].to_numpy()[:, None] != other["row_label"].to_numpy()[None, :]) & (own["anchor_id"].to_numpy()[:, None] != ids[None, :]) & (scores >= own["least"].to_numpy()[:, None])
        slot = sum((scores <= tops[:, j : j + 1]).astype(np.int8) for j in range(n_positives))
        for j in range(1, n_positives + 1):
            r, c = _best(scores, able & (slot == j), n_negatives)
            found.append(pd.DataFrame({"anchor_id": own["anchor_id"].to_numpy()[r], "anchor": own["anchor"].to_numpy()[r], "slot": j, "negative_id": ids[c], "negative_score": scores[r, c].astype(np.int64)}))
        return pd.concat(found)

    best = _first(_met(asked, rows, None, find, "anchor_id long, anchor long, slot int, negative_id long, negative_score long"), ["anchor_id", "anchor", "slot"], "negative_score", "negative_id", n_negatives)
    # of an anchor at most positives * negatives rows, in falling order of score as slots are
    kept = best.groupBy("anchor_id", "anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "negative_id", "negative_score"))).alias("kept"))
    each = windows.join(slots.select("anchor_id", "anchor", "tops"), ["anchor_id", "anchor"]).join(kept, ["anchor_id", "anchor"])
    under = F.slice(F.filter("kept", lambda e: e["slot"] >= F.array_position("tops", F.col("upper"))), 1, n_negatives)
    each = each.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter(under, lambda e: e["negative_score"] >= F.col("lower"))).alias("place", "e"))
    return each.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("e.negative_id").alias("negative_id"), "positive_score", F.col("e.negative_score").alias("negative_score"))
