"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a sample of at most ``FIT_ROWS`` vectors and broadcast; every vector is put into the leaf
that nearest centres lead to. A query keeps a priority queue of tree nodes by the distance to their
centres and takes leaves from it, nearest first. How many it takes is calibrated: for ``CALIBRATE`` queries the true
neighbours are found by brute force over all rows, and the number of leaves grows until the share of them
that lies in visited leaves reaches ``target`` recall. Leaves of one part of the tree lie on one shelf; a query goes once to each shelf
on which it has leaves, and its nearest from all of these come back together.

Equal vectors are searched once; of their ids the ``k + 1`` smallest are kept, which is all that a result of k
with ties to the smaller id can hold.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import written

FIT_ROWS = 65_536
#: Vectors in a leaf, and most children of a node.
LEAF_ROWS, BRANCHES = 48, 16
CALIBRATE, TARGET_RECALL = 192, 0.94
#: Leaves that stand together are one shelf, of about so many distinct vectors; a fuller one is searched in parts.
SHELF_ROWS = 16_384
SEED = 5


@dataclass
class Tree:
    """Node i has the children ``first[i]`` to ``last[i]``, none if it is a leaf; ``centres[i]`` is its centre."""

    centres: np.ndarray
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return sum(a == b for a, b in zip(self.first, self.last, strict=True))

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that nearest centres lead each row to, the first of equals."""
        out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.first[node] == self.last[node]:
                out[rows] = node
                continue
            c = self.centres[self.first[node] : self.last[node]]
            near = ((c * c).sum(1)[None, :] - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(self.first[node] + k, rows[near == k]) for k in range(len(c)) if (near == k).any()]
        return out

    def best_bins(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < visits:
            _, node = heapq.heappop(queue)
            a, b = self.first[node], self.last[node]
            if a == b:
                out.append(node)
            else:
                for k, d in enumerate(((self.centres[a:b] - q) ** 2).sum(axis=1).tolist()):
                    heapq.heappush(queue, (d, a + k))
        return out


def fit_tree(sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES) -> Tree:
    """A tree for ``rows`` vectors, of which ``sample`` is one: nodes are cut until a leaf stands for about ``leaf_rows``."""
    rng = np.random.default_rng(SEED)
    share = rows / max(1, len(sample))
    centres, first, last = [sample.mean(axis=0)], [0], [0]
    todo = [(0, sample)]
    while todo:
        node, x = todo.pop(0)
        first[node] = last[node] = len(centres)
        k = min(branches, int(np.ceil(len(x) * share / leaf_rows)), len(x) // 4)
        if k < 2:
            continue
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
        near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        kept = [j for j in range(k) if (near == j).any()]
        if len(kept) < 2:
            continue
        for j in kept:
            centres.append(c[j])
            first.append(0)
            last.append(0)
            todo.append((len(centres) - 1, x[near == j]))
        last[node] = len(centres)
    return Tree(np.array(centres), first, last)


def _top(ids: list[np.ndarray], d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors with their ascending ids and distances the k nearest ids, ties to the smaller."""
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        ids, d = [ids[i] for i in near], d[near]
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    far = np.repeat(d, [len(i) for i in ids])
    order = np.lexsort((flat, far))[:k]
    return flat[order], far[order]


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """``rows(vec_id, vec binary)`` by distinct vector: ``vec, ids``, the ``keep`` smallest ids. A batch, then a salt, then a
    vector gives at most ``keep`` ids each, so that a very common vector is never gathered."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, pdf in enumerate(batches):
            pdf = pdf.drop_duplicates().sort_values("vec_id")
            yield pdf.groupby("vec", sort=False).head(keep).assign(salt=n % 64)

    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    partial = rows.mapInPandas(first, "vec_id long, vec binary, salt int").withColumn("salt", F.pmod(F.spark_partition_id() + F.col("salt"), F.lit(64)))
    return partial.withColumn("ids", F.array("vec_id")).groupBy("vec", "salt").agg(smallest.alias("ids")).groupBy("vec").agg(smallest.alias("ids"))


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, vec``: the vectors that take part, as the bytes of their doubles. Not those with a null id, that are null, empty or zero, that
    hold null or non-finite components, or whose length isn't the most common one (the longer of equals)."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("v") == (size["n"] if size else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) + 0.0  # no negative zeros
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "vec"])

    return rows.mapInArrow(pack, "vec_id long, vec binary")


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), dtype=np.float64).reshape(len(vecs), -1)


def search(vectors: DataFrame, k: int = 10, every: int = 100, target: float = TARGET_RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by ``every`` its k nearest others found.

    ``score`` is the Euclidean distance in double precision. What takes part says `valid`; rows that repeat an id and its vector are one; an id with
    several vectors has each of them as a query and as a candidate. Fewer rows than k: all of them. An empty table gives an empty one.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    rows = written(valid(vectors, id_col, vec_col), "ann-rows")
    distinct = written(_distinct(rows, k + 1), "ann-distinct")
    n = distinct.count()
    if n == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    share = F.pmod(F.xxhash64("vec"), F.lit(1_000_000))
    sample = distinct.where(share < int(min(1.0, FIT_ROWS / n) * 1_000_000) + 1).select("vec").orderBy("vec").limit(2 * FIT_ROWS).toPandas()
    tree = fit_tree(_matrix(sample["vec"]), n)
    shared = distinct.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=shared.value.leaf_of(_matrix(pdf["vec"])))

    indexed = written(distinct.mapInPandas(assign, "vec binary, ids array<long>, leaf int"), "ann-index")
    visits = _calibrated(indexed, tree, k, target)

    leaves = [i for i, (a, b) in enumerate(zip(tree.first, tree.last, strict=True)) if a == b]
    per_shelf = max(1, len(leaves) * SHELF_ROWS // n)
    shelf = {leaf: i // per_shelf for i, leaf in enumerate(leaves)}
    shelf_of = distinct.sparkSession.createDataFrame(list(shelf.items()), "leaf int, shelf int")  # as many rows as the tree has leaves

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw, q in zip(pdf["vec"], _matrix(pdf["vec"]) if len(pdf) else [], strict=True):
                by: dict[int, list[int]] = {}
                for leaf in shared.value.best_bins(q, visits):
                    by.setdefault(shelf[leaf], []).append(leaf)
                out += [(raw, s, own) for s, own in by.items()]
            yield pd.DataFrame(out, columns=["query", "shelf", "leaves"])

    asking = rows.where(F.col("vec_id") % every == 0).distinct()
    shelved = indexed.join(F.broadcast(shelf_of), "leaf")
    parts = written(shelved.groupBy("shelf").agg(F.ceil(F.count("*") / (2 * SHELF_ROWS)).cast("int").alias("parts")), "ann-shelves")
    probes = asking.select("vec").distinct().mapInPandas(bins, "query binary, shelf int, leaves array<int>").join(F.broadcast(parts), "shelf")  # a row for each shelf
    probes = probes.select("query", "leaves", "shelf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    stored = shelved.join(F.broadcast(parts), "shelf").select("vec", "ids", "leaf", F.col("shelf").alias("on_shelf"), F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int").alias("in_part"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("leaf", kind="stable")
            leaf, x, ids = right["leaf"].to_numpy(), _matrix(right["vec"]), [np.asarray(i, dtype=np.int64) for i in right["ids"]]
            for raw, q, wanted in zip(left["query"], _matrix(left["query"]), left["leaves"], strict=True):
                ends = np.searchsorted(leaf, wanted, side="right")
                at = np.concatenate([np.arange(a, b) for a, b in zip(np.searchsorted(leaf, wanted), ends, strict=True)])
                found, far = _top([ids[i] for i in at.tolist()], np.sqrt(((x[at] - q) ** 2).sum(axis=1)), k + 1)
                out.append(pd.DataFrame({"query": [raw] * len(found), "vec_id": found, "score": far}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "vec_id": [], "score": []})

    found = probes.groupBy("shelf", "part").cogroup(stored.groupBy("on_shelf", "in_part")).applyInPandas(compare, "query binary, vec_id long, score double")
    # k + 1 rows for each query and part of a shelf at most
    best = found.distinct().withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    named = asking.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")).join(best, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrated(indexed: DataFrame, tree: Tree, k: int, target: float) -> int:
    """How many leaves to visit for ``target`` recall, by the true neighbours of ``CALIBRATE`` vectors among all."""
    chosen = indexed.orderBy(F.xxhash64("vec", F.lit("calibrate"))).select("vec").limit(CALIBRATE).toPandas()
    queries = _matrix(chosen["vec"])

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, leaf = _matrix(pdf["vec"]), pdf["leaf"].to_numpy()
            for i, q in enumerate(queries):
                d = np.sqrt(((x - q) ** 2).sum(axis=1))
                near = np.argsort(d, kind="stable")[: k + 1]
                yield pd.DataFrame({"query": i, "d": d[near], "leaf": leaf[near]})

    near = indexed.select("vec", "leaf").mapInPandas(exact, "query int, d double, leaf int")
    # its own vector comes first and doesn't count
    place = F.row_number().over(Window.partitionBy("query").orderBy("d", "leaf"))
    truth = near.withColumn("place", place).where(F.col("place").between(2, k + 1)).select("query", "leaf").toPandas()
    if not len(truth):
        return 1
    needed = []
    for i, leaves in truth.groupby("query")["leaf"]:
        order = {leaf: n for n, leaf in enumerate(tree.best_bins(queries[i], tree.leaves), 1)}
        needed += [order[x] for x in leaves]
    return int(np.sort(needed)[int(np.ceil(target * len(needed))) - 1])
