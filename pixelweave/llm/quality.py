"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of the whole text, standardised, go through ``cos(Wx + b)`` with seeded normal W, which
approximates a Gaussian kernel. Each partition of the labelled rows sums its own part of the normal
equations; their sum gives the ridge weights. Rows set apart by their hash then fit the rising broken line that turns a ridge score into
a probability: steps found by pooling adjacent violators, joined by straight pieces between one step's last point and the next one's first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import clean_text, written

#: At most about so many labelled rows are fitted, taken by a hash of the id.
FIT_ROWS = 200_000
N_FOURIER, GAMMA, RIDGE, SEED = 256, 0.05, 1e-2, 7
#: Standardised statistics beyond this count as this, so that a text unlike all others is still near some.
CLIP = 3.0
#: One labelled row in so many calibrates.
CALIBRATE_ONE_IN = 4
_SPACE, _LETTER, _UPPER, _DIGIT, _MARK = (np.zeros(256, dtype=bool) for _ in range(5))
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_MARK[33:128] = True
_MARK &= ~(_LETTER | _DIGIT)
_COMMON_MARKS = np.zeros(256, dtype=bool)
_COMMON_MARKS[[ord(c) for c in ".,'\"-"]] = True
N_STATISTICS = 14


def statistics(text: bytes) -> list[float]:
    """Of a whole text: sizes on a log scale and shares between 0 and 1; zeros for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * N_STATISTICS
    b = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n, n_words = len(text), len(words)
    lines = text.split(b"\n")
    distinct = set(words)
    pairs = set(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
    solid = max(1, n - int(b[_SPACE].sum()))
    marks = int(b[_MARK].sum())
    bare = sum(1 for w in distinct if not w[:1].isalnum() and w[0] < 128)
    return [
        float(np.log1p(n_words)), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        len(distinct) / n_words, len(pairs) / max(1, n_words - 1), len(set(lines)) / len(lines),
        float(np.log1p(n_words / len(lines))), b[_LETTER].sum() / solid, b[_UPPER].sum() / solid,
        b[_DIGIT].sum() / solid, marks / solid, int(b[_MARK & ~_COMMON_MARKS].sum()) / solid,
        (marks - int(b[_MARK & ~_COMMON_MARKS].sum())) / n_words, bare / len(distinct),
    ]


def _table(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts.cast(pa.binary())], dtype=np.float64).reshape(-1, N_STATISTICS)


@dataclass
class Model:
    """``mean`` and ``scale`` of the statistics, Fourier ``frequencies`` and ``phases``, ridge ``weights``,
    and the ``steps`` and ``values`` of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _fourier(_standard(x, self.mean, self.scale), self.frequencies, self.phases) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.values)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -CLIP, CLIP)


def _fourier(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / len(b)) * np.cos(x @ w + b)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of y over x, as the points of a broken line; equal x share one value."""
    xs, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at).astype(float)
    total = np.bincount(at, weights=y)
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for s, w, v in zip(total, weight, xs, strict=True):
        blocks.append([s, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, _, last = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += w2
            blocks[-1][3] = last
    points = [(v, b[0] / b[1]) for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from the rows of ``labels(doc_id, ...)`` that are not held out and whose label is 0 or 1.

    An id with several labels counts by its largest. Without labelled rows, or with one class only, every text
    gets that class's share, 0.5 if there is none.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id")))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * fit_rows / n)))
    rows = clean_text(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")  # known: fit_rows at most

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _table(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    measured = written(rows.mapInArrow(measure, "doc_id long, label int, x array<double>"), "quality-statistics")
    columns = [F.col("x")[i] for i in range(N_STATISTICS)]
    moments = measured.agg(F.count("*"), F.sum("label"), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    n, positive = moments[0], moments[1] or 0
    rng = np.random.default_rng(SEED)
    w, phases = rng.normal(scale=np.sqrt(2 * GAMMA), size=(N_STATISTICS, N_FOURIER)), rng.uniform(0, 2 * np.pi, N_FOURIER)
    if n == 0 or positive in (0, n):
        share = positive / n if n else 0.5
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), w, phases, np.zeros(N_FOURIER + 1), np.zeros(1), np.array([share]))
    mean = np.array(moments[2 : 2 + N_STATISTICS])
    scale = np.array([s if s > 1e-9 else 1.0 for s in moments[2 + N_STATISTICS :]])
    for_ridge = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE_ONE_IN)) != 0
    # classes weigh the same in the equations, so that the rarer one shapes the score too
    weigh = {0: n / 2 / (n - positive), 1: n / 2 / positive}
    width = N_FOURIER + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((width, width + 1))
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, N_STATISTICS)
            y = b.column(0).to_numpy().astype(float)
            z = _fourier(_standard(x, mean, scale), w, phases)
            wz = z * np.where(y > 0, weigh[1], weigh[0])[:, None]
            a += wz.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], names=["a"])

    parts = measured.where(for_ridge).select("label", "x").coalesce(16).mapInArrow(equations, "a binary").collect()  # 16 matrices at most
    a = sum((np.frombuffer(r[0]).reshape(width, width + 1) for r in parts), np.zeros((width, width + 1)))
    weights = np.linalg.solve(a[:, :width] + RIDGE * n / width * np.eye(width), a[:, width])
    model = Model(mean, scale, w, phases, weights, np.zeros(1), np.zeros(1))
    apart = measured.where(~for_ridge).select("label", "x").toPandas()  # a part of fit_rows
    if len(apart) == 0:
        apart = measured.select("label", "x").toPandas()
    raw = model.raw(np.array(apart["x"].tolist()).reshape(-1, N_STATISTICS))
    model.steps, model.values = isotonic(raw, apart["label"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row: the probability of label 1, of the whole text alone. Null texts count as empty, null ids stay null, repeated rows stay
    and equal texts score the same; other columns go. An empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(_table(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return clean_text(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def is_held_out(doc_id: int | None) -> bool:
    """`held_out` for one id."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``least``. A text alone decides, a null one as if empty, so null ids make no difference; all columns and repeated
    rows stay. Without labels, or an equal share of both and nothing to tell them apart, all rows score 0.5 and stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary()).fill_null(b"")
            yield b.filter(pa.array(model.value.score(_table(texts)) >= least))

    return docs.mapInArrow(run, schema)
