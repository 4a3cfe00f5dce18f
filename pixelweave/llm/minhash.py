"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has a number for each of its coordinates. In round after round every shingle is thrown into one coordinate, which keeps the least of round and hash; a second series of rounds
fills coordinate after coordinate with all shingles, so each one is filled, after few rounds if there are many shingles, and the share of equal coordinates of two sketches is as
concentrated around the similarity of their sets as that of independent hashes.

Coordinates are banded; texts that share a band are looked at. There are so many bands that a pair at the bound is missed once in ten millions. A crowded band isn't turned into pairs:
each text is proposed with the first of its bands, what that connects is one class, and only texts of different classes that share a band are compared by their sketches, in blocks. A pair is
given up if its sketches agree less than five standard deviations under the bound. What remains is verified on the full sets, in blocks of texts, each block's sets being there once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import HUB_EDGES, clean_text, components, small_side, written

#: Coordinates of a sketch, and those of a band.
SIZE, BAND = 256, 4
#: The chance that no band of a pair at the bound is equal.
MISSED = 1e-7
#: How far below the bound sketches may agree, in standard deviations.
DEVIATIONS = 5
#: Texts of a block, on average, as sketches are compared and as sets are verified.
COMPARED, VERIFIED = 1024, 1024
#: Rows that are compared in one group, on average.
SHELF_ROWS = 16_384
#: The candidates of a text in a block that are verified first.
FIRST = 4
#: Hashes that a round works on.
WORK = 1 << 14
#: How a row takes part where a band is compared: others are compared with it, it is compared with those, or both.
STAYS, SENT, BOTH = 0, 1, 2
_FULL = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted hashes of a text's different shingles; of the whole sequence, if it is shorter than one; none without words."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), dtype=np.int64, count=len(tokens))
    h = np.array([xxhash.xxh64_intdigest(t) for t in number], dtype=np.uint64)[ids]
    k = min(words, len(h))
    n = len(h) - k + 1
    out = _mixed(h[:n] + np.uint64(k))
    for j in range(1, k):
        out = _mixed(out * np.uint64(3) + h[j : j + n])
    return np.unique(out)


def sketch(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The fast similarity sketch of a set that isn't empty."""
    out, at = np.full(size, _FULL, dtype=np.uint64), 0
    while at < 2 * size and (out == _FULL).any():
        n = max(1, min(2 * size - at, WORK // len(hashes)))
        rounds = np.arange(at, at + n)
        x = _mixed(hashes[None, :] ^ _mixed(rounds.astype(np.uint64) + np.uint64(1))[:, None])
        place = ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        place = np.where(rounds[:, None] < size, place, rounds[:, None] - size)
        # a later round is more than any number of an earlier one
        np.minimum.at(out, place.ravel(), ((rounds.astype(np.uint64) << np.uint64(32))[:, None] | (x & np.uint64(0xFFFFFFFF))).ravel())
        at += n
    return out


def banding(similarity: float) -> int:
    """So many bands miss a pair of this similarity with a chance of `MISSED` at most."""
    return math.ceil(math.log(MISSED) / math.log1p(-(similarity**BAND)))


def least_agreement(similarity: float) -> int:
    """Coordinates that agree in sketches of sets at the bound, less some standard deviations."""
    return math.floor(SIZE * similarity - DEVIATIONS * math.sqrt(SIZE * similarity * (1 - similarity)))


def sketches(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``doc_id, n, key, sketch, bands`` of ``docs(doc_id, text)``: the size of the set, 128 bits that stand for it, its sketch's numbers cut to 16 bits, and a hash of each band. An empty set has neither."""
    import xxhash

    bands = banding(similarity)
    if bands * BAND > SIZE:
        raise ValueError("a sketch is too short for this similarity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_sketched(t.as_py(), words, bands, xxhash) for t in b.column(1).cast(pa.large_binary())]
            n, key, cut, hashes = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(cut, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "sketch", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, sketch binary, bands array<long>")


def _sketched(text: bytes, words: int, bands: int, xxhash) -> tuple[int, bytes | None, bytes | None, list[int] | None]:
    hashes = shingle_set(text, words)
    if not len(hashes):
        return 0, None, None, None
    full = sketch(hashes)
    own = _mixed(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(BAND):
        own = _mixed(own * np.uint64(3) + full[j : bands * BAND : BAND])
    return len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), (full & np.uint64(0xFFFF)).astype("<u2").tobytes(), own.view(np.int64).tolist()


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``key, hs`` for each of ``wanted(key, first_id)``: the set of its text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingle_set(t.as_py(), words).tobytes() for t in b.column(0).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["key", "hs"])

    ids = small_side(written(wanted.select(F.col("first_id").alias("doc_id")).where("doc_id is not null").distinct(), "minhash-asked"))
    none = wanted.where("first_id is null").isEmpty()
    texts = docs.where("doc_id is not null").join(ids, "doc_id", "left_semi")
    texts = texts if none else texts.unionByName(docs.where("doc_id is null"))
    found = texts.select("text").mapInArrow(run, "key binary, hs binary")
    return found.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _verified(asked: DataFrame, sets: DataFrame, blocks: int, similarity: float) -> DataFrame:
    """``a, b``: those of ``asked(one, block, others)`` whose sets are alike: a text with several of one block. A block's sets are in a group once, and a text's set is sent to it with all it is
    compared with there."""

    def run(own: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        there = dict(zip(own["key"], own["hs"], strict=True))
        a, b = [], []
        for one, others, hs in zip(packs["one"], packs["others"], packs["one_hs"], strict=True):
            x = np.frombuffer(hs, dtype=np.uint64)
            for other in others:
                y = np.frombuffer(there[other], dtype=np.uint64)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    a.append(one)
                    b.append(other)
        return pd.DataFrame({"a": a, "b": b})

    packs = asked.join(sets.select(F.col("key").alias("one"), F.col("hs").alias("one_hs")), "one").select("block", "one", "others", "one_hs")
    return sets.withColumn("of", _block(F.col("key"), blocks)).groupBy("of").cogroup(packs.groupBy("block")).applyInPandas(run, "a binary, b binary")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _packed(pairs: DataFrame, blocks: int) -> DataFrame:
    """``one, block, others`` of ``pairs(one, other)``; a block bounds the others."""
    return pairs.groupBy("one", _block(F.col("other"), blocks).alias("block")).agg(F.collect_set("other").alias("others"))


def _agreement(numbers: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Coordinates in which each of the sketches ``numbers`` agrees with ``one``."""
    return (numbers == one).sum(axis=1)


@dataclass(frozen=True)
class Alike:
    """How bytes of ``width`` numbers of type ``kind`` are compared: ``measure`` of many with one must reach ``least`` for a pair to be verified."""

    kind: str
    width: int
    measure: Callable[[np.ndarray, np.ndarray], np.ndarray]
    least: int


def _classed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``shared(key, ...)`` with the class of each key as ``root``."""
    return shared.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def _in_blocks(shared: DataFrame, roots: DataFrame, sketched: DataFrame) -> tuple[DataFrame, int]:
    """The rows that are compared of bands of any size, and their number. Of a band's largest class no two are compared, so a text of it goes only to blocks that others are sent to."""
    own = written(_classed(shared.select("band", "key"), roots), "minhash-classes")
    counted = own.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("band").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("in_main")).where("classes > 1")
    mixed = written(mixed.select("band", "main", "n", "in_main", F.ceil(F.col("n") / COMPARED).alias("blocks"), F.ceil((F.col("n") - F.col("in_main")) / COMPARED).alias("others")), "minhash-mixed")
    rows = own.join(mixed.drop("n", "in_main"), "band").join(sketched, "key").withColumn("is_main", F.col("root") == F.col("main"))
    here, every = lambda n: F.pmod(F.xxhash64("key"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    stay = rows.select("band", here("blocks").alias("block"), every("others").alias("part"), "key", "root", "n", "sketch", "is_main", F.lit(STAYS).alias("role"))
    sent = rows.where(~F.col("is_main")).select("band", every("blocks").alias("block"), here("others").alias("part"), "key", "root", "n", "sketch", "is_main", F.lit(SENT).alias("role"))
    return stay.unionByName(sent), mixed.agg(F.sum(F.col("n") * F.col("others") + (F.col("n") - F.col("in_main")) * F.col("blocks"))).first()[0] or 0


def _rows_compared(shared: DataFrame, roots: DataFrame, sketched: DataFrame) -> tuple[DataFrame, int]:
    """The rows that are compared, and their number. Where ``shared`` has a band's number of texts as ``in_band`` and the texts' own ``n, sketch``, a text of a band of one block is one row as it
    is: no sketch is joined to it, and which of the block's texts are of one class is seen where they are compared."""
    if "sketch" not in shared.columns:
        return _in_blocks(shared, roots, sketched)
    one, zero = shared.where(F.col("in_band") <= COMPARED), F.lit(0).cast("long")
    rows = _classed(one, roots).select("band", zero.alias("block"), zero.alias("part"), "key", "root", "n", "sketch", F.lit(False).alias("is_main"), F.lit(BOTH).alias("role"))
    crowded = shared.where(F.col("in_band") > COMPARED)
    if crowded.isEmpty():
        return rows, one.count()
    more, n = _in_blocks(crowded, roots, sketched)
    return rows.unionByName(more.select(*rows.columns)), one.count() + n


def _compared(shared: DataFrame, roots: DataFrame, sketched: DataFrame, blocks: int, similarity: float, alike: Alike, first: int | None) -> DataFrame:
    """``one, block, others``, a text with all it is to be verified against in a block: texts of one band and of different classes whose sketches agree so far as to be looked at. With ``first`` only
    the best of each text and part of a band, else all, a pair once. Pairs never become rows."""
    rows, n_rows = _rows_compared(shared, roots, sketched)
    rows = rows.withColumn("of", _block(F.col("key"), blocks))

    def run(shelf: pd.DataFrame) -> pd.DataFrame:
        numbers = np.frombuffer(b"".join(shelf["sketch"]), dtype=alike.kind).reshape(len(shelf), alike.width)
        keys, block, size, role = (shelf[c].to_numpy() for c in ("key", "of", "n", "role"))
        root, main = pd.factorize(shelf["root"])[0], shelf["is_main"].to_numpy(copy=True)
        found: dict[tuple[bytes, int], set[bytes]] = {}
        for group in shelf.groupby(["band", "block", "part"], sort=False).indices.values():
            if role[group[0]] == BOTH:
                classes, own, n = np.unique(root[group], return_inverse=True, return_counts=True)
                if len(classes) == 1:
                    continue
                main[group] = own == n.argmax()
                to, of = group, group[~main[group]]
            else:
                to, of = group[role[group] == STAYS], group[role[group] == SENT]
            for i in of.tolist() if len(to) else []:
                able = (root[to] != root[i]) & (np.minimum(size[to], size[i]) >= similarity * np.maximum(size[to], size[i]) - 1e-9)
                if first is None:
                    able &= main[to] | (keys[to] > keys[i])
                at = to[able]
                agree = alike.measure(numbers[at], numbers[i])
                at, agree = at[agree >= alike.least], agree[agree >= alike.least]
                if first is not None:
                    at = at[np.argsort(-agree, kind="stable")[:first]]
                for other, b in zip(keys[at].tolist(), block[at].tolist(), strict=True):
                    found.setdefault((keys[i], b), set()).add(other)
        return pd.DataFrame({"one": [k for k, _ in found], "block": [b for _, b in found], "others": pd.Series([sorted(v) for v in found.values()], dtype=object)})

    # small bands are compared many in a group, whose rows are bounded on average
    shelves = max(n_rows // SHELF_ROWS, shared.sparkSession.sparkContext.defaultParallelism)
    shelf = F.pmod(F.xxhash64("band", "block", "part"), F.lit(shelves))
    both = rows.groupBy(shelf.alias("shelf")).applyInPandas(run, "one binary, block long, others array<binary>")
    return both.groupBy("one", "block").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))


def _roots(edges: DataFrame) -> DataFrame:
    return written(components(edges, "minhash-components", edges.count() <= HUB_EDGES // 2).withColumnRenamed("node", "key"), "minhash-roots")


def linked(docs: DataFrame, sketched: DataFrame, shared: DataFrame, leads: DataFrame, words: int, similarity: float, alike: Alike) -> tuple[DataFrame, DataFrame]:
    """``a, b``, links of sets that connect what all verified pairs within a band of ``shared(band, key, first_id)`` connect, and ``key, root`` of the sets that have one.

    ``shared`` may hold ``in_band, n, sketch`` too, the texts of a band and each one's own size and sketch, which spares a join of every row with ``sketched``.

    First each set is verified against one of its ``leads(key, lead, lead_id)``, then against the best few of other classes in its bands, then against all that are still of other classes and
    that ``alike`` doesn't exclude by ``sketched(key, n, sketch)``. ``docs(doc_id, text)`` holds the texts.
    """
    spark = docs.sparkSession
    near = written(shared.select("key", "first_id").distinct(), "minhash-near")
    blocks = max(math.ceil(near.count() / VERIFIED), spark.sparkContext.defaultParallelism)
    sets = written(_sets(docs, near, words), "minhash-shingles")
    one = F.min(F.struct(F.col("lead_id").isNull().alias("no_id"), "lead_id", "lead")).alias("l")
    first = leads.groupBy("key").agg(one).select(F.col("l.lead").alias("one"), F.col("key").alias("other"))
    edges = written(_verified(_packed(first, blocks), sets, blocks, similarity), "minhash-links")
    # a text has one lead, so those linked to the same are known to be of one component
    roots = edges.select(F.col("b").alias("key"), F.col("a").alias("root"))
    pairs = _compared(shared, roots, sketched, blocks, similarity, alike, FIRST)
    edges = written(edges.unionByName(_verified(pairs, sets, blocks, similarity)), "minhash-links")
    roots = _roots(edges)
    pairs = _compared(shared, roots, sketched, blocks, similarity, alike, None)
    more = written(_verified(pairs, sets, blocks, similarity), "minhash-links")
    edges = edges.unionByName(more)
    return edges, roots if more.isEmpty() else _roots(edges)


def near_duplicates(docs: DataFrame, words: int = 4, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are lower-cased A-Z and cut at ASCII white space; a text's set holds its different shingles of ``words`` words, or its whole sequence if that is shorter. Texts are linked whose sets have
    a Jaccard similarity of ``similarity`` or more, and ``component_id`` is the smallest doc_id reachable. Null and empty texts and those without words have empty sets and are linked with nothing,
    so each row of them is its own component. A row with a null doc_id belongs to its component but never names it, has a null component_id if no other row does, and isn't kept. Repeated
    rows stay, each with the same values. Other columns go, whatever their names. An empty table gives an empty one.
    """
    docs = clean_text(docs, id_col, text_col)
    rows = written(sketches(docs, words, similarity), "minhash-sketches")
    distinct = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.min(F.struct("sketch", "bands")).alias("s"))
    distinct = written(distinct.select("key", "first_id", "n", "s.sketch", "s.bands"), "minhash-sets")
    banded = distinct.select("key", "first_id", F.explode("bands").alias("band"))
    least = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "key"))
    common = written(banded.groupBy("band").agg(F.count("*").alias("n"), least.alias("lead")).where("n > 1").select("band", F.col("lead.key").alias("lead")), "minhash-bands")
    shared = written(banded.join(common, "band").select("band", "key", "first_id", "lead"), "minhash-shared")
    # the lead of the smallest id, often what copies were made from
    leads = shared.where("key <> lead").join(shared.select(F.col("key").alias("lead"), F.col("first_id").alias("lead_id")).distinct(), "lead")
    alike = Alike("<u2", SIZE, _agreement, least_agreement(similarity))
    _, roots = linked(docs, distinct.select("key", "n", "sketch"), shared.select("band", "key", "first_id"), leads.select("key", "lead", "lead_id"), words, similarity, alike)
    own = distinct.select("key", "first_id").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least_id = written(own.groupBy("root").agg(F.min("first_id").alias("component_id")), "minhash-least")
    named = own.join(least_id, "root").select("key", "component_id")
    out = rows.select("doc_id", "n", "key").join(named, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
