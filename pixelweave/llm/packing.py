"""Packing token sequences into windows by non-negative least squares over a length histogram.

Documents are cut into whole windows and a rest. A piece's class is its length in units of ``unit`` ids,
rounded up. All combinations of up to ``depth`` classes that fill a window exactly are columns of a
system whose right side is the histogram; its non-negative least-squares solution says how often each is
used. Rounded down to what the histogram has, this leaves residual pieces, which go, longest first, into the
open window with the least room that still holds them. Only histograms reach the driver. Each piece then
finds its window from its rank within its class.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import clean_text, written
from pixelweave.llm.tokens import encoder

WINDOW, UNIT, DEPTH, END = 4096, 16, 3, 2


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, unit: int = UNIT, end: int = END) -> DataFrame:
    """Each document's pieces, with their place among the pieces of their class in their ``block`` of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, seen = encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for b in batches:
            for part in range(0, len(b), 2000):
                own = b.slice(part, 2000)
                out: list[tuple] = []
                for i, raw in zip(own.column(0).to_pylist(), enc.encode(own.column(1)), strict=True):
                    ids = np.append(np.frombuffer(raw, dtype=enc.dtype).astype("<u4"), np.uint32(end))
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        kind = -(-len(piece) // unit)
                        out.append((i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), block, kind, seen[kind]))
                        seen[kind] += 1
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "kind", "place"]
    schema = pa.schema([(n, pa.int32() if n in ("block", "kind") else pa.int64()) for n in names])
    return clean_text(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block int, kind int, place long")


def combinations(size: int, kinds: set[int], depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All non-increasing runs of up to ``depth`` of the ``kinds`` that sum to ``size``."""

    def of(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if left in kinds and left <= most:
            yield (left,)
        if depth > 1:
            for k in range(min(most, left - 1), 0, -1):
                if k * depth < left:
                    break
                if k in kinds:
                    for rest in of(left - k, k, depth - 1):
                        yield (k, *rest)

    return list(of(size, size, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 of least ``|ax - b|``, by active sets; a few columns of steepest descent enter at a time."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[active] = -1
        enter = np.argsort(-slope, kind="stable")[:8]
        enter = enter[slope[enter] > 1e-9 * max(1.0, np.abs(b).max())]
        if not len(enter):
            break
        active[enter] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 1e-12
            step = np.min(np.where(bad, x[at] / np.maximum(x[at] - z, 1e-300), 1.0))
            x[at] += step * (z - x[at])
            drop = at[bad & (x[at] <= 1e-9)]
            if not len(drop):
                drop = at[bad]
            active[drop] = False
            x[drop] = 0
            if not active.any():
                break
    return x


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """How often which classes share a window, for all pieces of ``histogram`` and windows of ``size`` units."""
    left = Counter({k: n for k, n in histogram.items() if n > 0})
    out: list[tuple[tuple[int, ...], int]] = []

    def use(combination: tuple[int, ...], times: int) -> None:
        times = min([times, *(left[k] // m for k, m in Counter(combination).items())])
        if times > 0:
            out.append((combination, times))
            left.subtract({k: m * times for k, m in Counter(combination).items()})

    if left[size]:
        use((size,), left[size])
    short = {k for k in left if left[k] > 0}
    if columns := combinations(size, short):
        rows = {k: i for i, k in enumerate(sorted(short))}
        a = np.zeros((len(rows), len(columns)))
        for j, c in enumerate(columns):
            for k in c:
                a[rows[k], j] += 1
        b = np.array([left[k] for k in sorted(short)], dtype=float)
        x = nnls(a, b)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1:
                break
            use(columns[j], int(x[j]))
    # residual pieces, whole classes at a time, longest first, into the open windows with the least room
    opened: Counter[tuple[int, ...]] = Counter()
    for kind in sorted((k for k in left if left[k] > 0), reverse=True):
        n = left[kind]
        while n:
            fits = [c for c, m in opened.items() if m and size - sum(c) >= kind]
            if fits:
                best = max(fits, key=lambda c: (sum(c), c))
                times = min(n, opened[best])
                opened[best] -= times
                opened[(*best, kind)] += times
            else:
                each = size // kind
                times, each = (n // each, each) if n >= each else (1, n)
                opened[(kind,) * each] += times
                times *= each
            n -= times
    return out + [(c, m) for c, m in opened.items() if m]


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, unit: int = UNIT, end: int = END) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of every document.

    A document is its ids and then ``end``, so a null or empty text is one id. Null ids, repeated ids and repeated rows are
    packed like any other. Each id lies in one piece; a sequence's pieces follow each other from offset 0 and have
    ``window`` ids or fewer together. An empty table gives an empty one.
    """
    rows = written(pieces(docs, vocabulary, window, unit, end), "packing-pieces")
    counts = rows.groupBy("block", "kind").agg(F.count("*").alias("n"))
    counts = written(counts, "packing-counts")
    histogram = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # window / unit rows
    slots: dict[int, list[tuple[int, int, int]]] = {}
    first, used = 0, Counter()
    for combination, times in plan(histogram, window // unit):
        for kind, each in Counter(combination).items():
            slots.setdefault(kind, []).append((used[kind], first, each))
            used[kind] += each * times
        first += times
    tables = {k: np.array(v, dtype=np.int64).T for k, v in slots.items()}
    before = F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(counts.select("block", "kind", before.alias("before")), ["block", "kind"]).withColumn("rank", F.col("before") + F.col("place"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence = np.zeros(len(pdf), dtype=np.int64)
            kinds, ranks = pdf["kind"].to_numpy(), pdf["rank"].to_numpy()
            for kind in np.unique(kinds):
                own = kinds == kind
                lo, base, each = tables[kind]
                at = np.searchsorted(lo, ranks[own], side="right") - 1
                sequence[own] = base[at] + (ranks[own] - lo[at]) // each[at]
            yield pdf.assign(sequence_id=sequence)

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank").mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, rank long, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))
