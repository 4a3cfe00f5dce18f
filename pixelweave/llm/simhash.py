"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint. Fingerprints that differ in ``radius`` bits or fewer are linked,
and all such links are found: the bit positions carry vectors of ``radius + 1`` bits, and for each
non-zero vector v a table keeps the positions whose vector has an odd product with v. At most ``radius``
positions differ in a pair, so some v is orthogonal to the vectors of all of them, and in its table the
pair has one key. A bucket that is too full for one task is cut by the same construction over the
positions its table left out, which again separates no pair within the radius. The vectors are dealt so
that every table keeps about half of however few positions are left, so each level about halves them, and
a bucket's size is bounded by the construction itself.

`near_duplicates` links fingerprints alone. `keep_one` decides by five-word shingles: fingerprints of word pairs, which few edits move far,
under several seeds propose pairs of texts, and those whose shingles' Jaccard similarity is 0.8 or more are linked.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm import minhash
from pixelweave.llm.common import clean_text, components, small_side, written

#: Fuller buckets are cut once more.
BUCKET_ROWS = 1024
SEED = 42
#: Of `keep_one`: fingerprints of so many words a shingle, for each of these seeds, within so many bits.
FINGERPRINT_WORDS, SEEDS, RADIUS = 2, (42, 43, 44), 5
_KEY, _DECIDED = "_key_of_text", "_decided_by_text"


def simhash(text: bytes, words: int, seed: int = SEED) -> int:
    """The fingerprint of one text: a bit is set if it is in over half of the shingles' hashes."""
    return simhashes(text, words, (seed,))[0]


def simhashes(text: bytes, words: int, seeds: tuple[int, ...]) -> list[int]:
    """A fingerprint for each seed. All but the first are of the first one's hashes, mixed with the seed."""
    import xxhash

    tokens = text.lower().split()
    if not tokens:
        return [0] * len(seeds)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = ends - [len(t) for t in tokens]
    k = min(words, len(tokens))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seeds[0]) for a, b in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    return [_majority(hashes if n == 0 else _mixed(hashes, seed)) for n, seed in enumerate(seeds)]


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the numbers."""
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes from hashes, as if by another seed."""
    x = hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp long`` for every row; ``fp`` holds the 64 bits. Null and empty texts have fingerprint 0,
    null ids stay null, repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py(), words) for t in texts), dtype="<u8", count=len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("<i8"))], names=["doc_id", "fp"])

    return clean_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


@functools.cache
def _dealt(bits: int, n: int) -> list[int]:
    """The first ``n`` of the non-zero vectors of ``bits`` bits, in an order in which each vector raises the
    least products most: of any first ``bits`` or more, every non-zero v has an odd product with some, and with
    about half."""
    every = np.arange(1, 1 << bits)
    odd = np.bitwise_count(every[:, None] & every[None, :]) % 2
    weights, order = np.zeros(len(every), dtype=np.int64), []
    left = list(range(len(every)))
    for _ in range(min(n, len(every))):
        best = max(left, key=lambda i: (np.sort(weights + odd[i]).tolist(), -i))
        left.remove(best)
        weights += odd[best]
        order.append(int(every[best]))
    return order


def covering_masks(positions: list[int], radius: int, seed: int = SEED) -> list[int]:
    """For every non-zero vector of ``radius + 1`` bits, the mask of the positions it keeps. Positions carry
    the non-zero vectors in turn, dealt by a seeded shuffle, so all masks keep about half of them, and none keeps
    nothing if there are more positions than ``radius``."""
    dealt = _dealt(radius + 1, len(positions))
    vectors = [dealt[i % len(dealt)] for i in range(len(positions))]
    order = np.random.default_rng(seed).permutation(positions).tolist()
    masks = {sum(1 << p for p, m in zip(order, vectors, strict=True) if (m & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))}
    return sorted(masks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """From each fingerprint of one bucket to the least of those it is connected with inside the bucket."""
    if len(fps) == 2:
        a, b = fps
        return [(max(a, b), min(a, b))] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius else []
    left, out = np.sort(np.array(fps, dtype=np.int64)), []
    while len(left):
        group, front, left = [left[:1]], [int(left[0])], left[1:]
        while front and len(left):
            near = np.bitwise_count((left ^ front.pop()).view(np.uint64)) <= radius
            if near.any():
                group.append(left[near])
                front += left[near].tolist()
                left = left[~near]
        found = np.concatenate(group).tolist()
        out += [(x, found[0]) for x in found[1:]]
    return out


def buckets(fps: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> Iterator[DataFrame]:
    """``path, key, fp``, level by level: the buckets of two or more of the distinct fingerprints of ``fps(fp)``, so that each pair within
    ``radius`` bits shares one."""
    spark, masks, free = fps.sparkSession, {1: [(1 + i, m) for i, m in enumerate(covering_masks(list(range(64)), radius))]}, {}
    tables = F.array(*[F.struct(F.lit(t).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in masks[1]])
    keyed = fps.select("fp", F.explode(tables).alias("t")).select("fp", "t.path", "t.key")
    while True:
        # counts are partial before the shuffle, so a crowded bucket is never gathered
        sizes = keyed.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
        sizes = written(sizes, "simhash-sizes")
        crowded = sizes.where(F.col("n") > bucket_rows).select("path", "key")
        any_crowded = not crowded.isEmpty()
        whole = {t: m for ms in masks.values() for t, m in ms}
        free = {t: [p for p in range(64) if not m >> p & 1] for t, m in whole.items()}
        # with 10 positions left a bucket has 1024 fingerprints at most; while there are more than radius, each level leaves fewer
        last = all(len(p) <= max(10, radius) for p in free.values())
        split = any_crowded and not last
        # a bucket of two is known by its least and greatest; most others are so few that only their keys go to the rows
        two = sizes.where("n = 2").select("path", "key", F.explode(F.array("lo", "hi")).alias("fp"))
        more = sizes.where((F.col("n") > 2) & (F.col("n") <= bucket_rows) if split else F.col("n") > 2).select("path", "key")
        yield written(two.unionByName(keyed.join(small_side(more), ["path", "key"], "left_semi").select("path", "key", "fp")), "simhash-buckets")
        if not split:
            return
        full = keyed.join(small_side(crowded), ["path", "key"], "left_semi")
        paths = sorted(r[0] for r in crowded.select("path").distinct().collect())  # at most one for each table
        number = itertools.count(1)
        masks = {p: [(next(number), whole[p] | m) for m in covering_masks(free[p], radius)] for p in paths}
        # of three levels the last has 31 ** 3 tables for radius 4
        next_tables = F.broadcast(spark.createDataFrame([(p, t, _signed(m)) for p, ms in masks.items() for t, m in ms], "path int, to int, mask long"))
        keyed = full.join(next_tables, "path").select("fp", F.col("to").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def links(fps: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints of ``fps(fp)`` exactly as all pairs within
    ``radius`` bits do. Within a bucket only one link for each fingerprint leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for group in b.column(0).to_pylist() for x in _links(group, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    levels = [small.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, "a long, b long") for small in buckets(fps, radius, bucket_rows)]
    return functools.reduce(DataFrame.unionByName, levels).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Texts are lower-cased A-Z and cut into words at ASCII white space; a text with fewer words than a
    shingle is one shingle, and one without words has fingerprint 0 and is linked like any other.
    ``component_id`` is the smallest doc_id reachable over links. Null texts count as empty; a row with a
    null doc_id belongs to its component but never names it, and has a null component_id if no other row
    does. Repeated rows stay. An empty table gives an empty one.
    """
    rows = written(fingerprints(docs, words, id_col, text_col), "simhash")
    first = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", _node("first_id", "fp")), "simhash-distinct")
    found = written(links(first.select("fp"), radius), "simhash-links")
    ends = [first.select(F.col("fp").alias(e), F.col("node").alias(f"node_{e}")) for e in "ab"]
    edges = found.join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    # nodes are ordered by id, so a component's root has its number
    roots = components(edges, "simhash-components")
    own = first.join(roots, "node", "left").select("fp", F.when(F.col("root").isNull(), F.col("first_id")).when(~F.col("root.no_id"), F.col("root.id")).alias("component_id"))
    return rows.join(own, "fp").select("doc_id", "fp", "component_id")


def _node(id_col: str, other: str) -> Column:
    """A node of a graph, in order of its id; without one, after all others."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.col(other)).alias("id"))


def _text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit("again")).alias("k2"))


def _fingerprinted(texts: DataFrame, words: int, set_words: int, seeds: tuple[int, ...]) -> DataFrame:
    """``doc_id, text_key, key, n, fps`` for every row of ``texts(doc_id, text)``; ``key`` is 128 bits that stand for the text's set of shingles of ``set_words`` words, ``n`` their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            fps, keys, sizes = [], [], []
            for t in b.column(2).cast(pa.large_binary()):
                text = t.as_py()
                hashes = minhash.shingle_set(text, set_words)
                fps.append(np.array(simhashes(text, words, seeds), dtype="<u8").view("<i8").tolist())
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "text_key", "key", "n", "fps"])

    return texts.select("doc_id", _text_key(F.col("text")).alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key struct<k1:long,k2:long>, key binary, n long, fps array<long>")


def _nearness(fps: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Less the bits in which each row's fingerprints differ from ``one``'s, by the nearest of the seeds."""
    return -np.bitwise_count(fps ^ one).min(axis=1).astype(np.int64)


def _bytes_of(fps: Column, n: int) -> Column:
    """Little-endian bytes of the numbers."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(fps[i], 8 * j).bitwiseAND(F.lit(255).cast("long"))), 2, "0") for i in range(n) for j in range(8)]))


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = RADIUS, seeds: tuple[int, ...] = SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``docs(doc_id, text)`` as ``doc_id, text_key, key, n, fps``, where ``key`` stands for a text's set of ``words``-word shingles; links ``a, b`` of
    keys whose sets have a Jaccard similarity of ``similarity`` or more; and ``key, root`` of all keys that links connect with others.

    Texts are proposed to each other that share a bucket of a seed's covering tables over fingerprints of word pairs, or a fingerprint. Each text is verified against the first of its
    buckets, then all pairs of a bucket that are within the radius under some seed and not connected by then, however full it is: what all verified pairs
    within the radius connect is connected. Pairs travel as lists, a text with all of a block, in blocks of bounded size. Texts without words have one key.
    """
    docs = clean_text(docs, "doc_id", "text")
    rows = written(_fingerprinted(docs, FINGERPRINT_WORDS, words, seeds), "dedup-fingerprints")
    distinct = written(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.min("fps").alias("fps")).withColumn("sketch", _bytes_of(F.col("fps"), len(seeds))), "dedup-sets")
    parts = []
    for s in range(len(seeds)):
        own = distinct.select(F.col("fps")[s].alias("fp"), F.col("key").alias("of"), "first_id", "n", "sketch")
        parts.append(own.select(F.xxhash64(F.lit(s), F.lit(-1), "fp").alias("band"), *own.columns))
        for level, small in enumerate(buckets(own.select("fp").distinct(), radius)):
            parts.append(small.select(F.xxhash64(F.lit(s), F.lit(level), "path", "key").alias("band"), "fp").join(own, "fp").select("band", *own.columns))
    banded = functools.reduce(DataFrame.unionByName, parts).withColumnRenamed("of", "key")
    least = F.min(F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "key", "fp"))
    common = written(banded.groupBy("band").agg(F.count("*").alias("in_band"), least.alias("lead")).where("in_band > 1"), "dedup-bands")
    near_lead = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= radius
    shared = banded.join(common, "band").select("band", "in_band", "key", "first_id", "n", "sketch", F.when(near_lead & (F.col("key") != F.col("lead.key")), F.struct("lead.key", "lead.first_id")).alias("lead"))
    shared = written(shared, "dedup-shared")
    leads = shared.where("lead is not null").select("key", F.col("lead.key").alias("lead"), F.col("lead.first_id").alias("lead_id"))
    alike = minhash.Alike("<u8", len(seeds), _nearness, -radius)
    edges, roots = minhash.linked(docs, distinct.select("key", "n", "sketch"), shared.drop("lead"), leads, words, similarity, alike)
    return rows, edges, roots


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of texts that links of `similar_texts` connect: the row of the smallest doc_id; of rows without an id, and
    of several texts of that id, the one of least hash of its text; of rows that repeat id and text, any one.

    Rows go by their text, so those with a null or repeated id are decided like all others. Null and empty texts and those without words
    are one group. All columns stay, whatever their names. An empty table gives an empty one.
    """
    rows, _, roots = similar_texts(docs, words, similarity)
    texts = rows.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"), F.any_value("key").alias("key")).join(roots, "key", "left")
    node = F.struct(F.col("first_id").isNull().alias("no_id"), F.coalesce("first_id", F.lit(0).cast("long")).alias("id"), F.col("text_key.k1"), F.col("text_key.k2"))
    texts = written(texts.select("text_key", "first_id", "n_rows", F.coalesce("root", "key").alias("class"), node.alias("node")), "dedup-texts")
    # only texts with other rows or in a class with others lose rows
    classes = written(texts.groupBy("class").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("class", "least"), "dedup-classes")
    found = texts.join(small_side(classes), "class", "left").where("n_rows > 1 or least is not null")
    found = written(found.select(F.col("text_key").alias("key"), "first_id", F.coalesce(F.col("node") == F.col("least"), F.lit(True)).alias("stays")), "dedup-decisions")
    doc = docs.withColumn(_KEY, _text_key(F.col("text")))
    named = small_side(found.select(F.col("key").alias(_KEY), F.struct("first_id", "stays").alias(_DECIDED)))
    alone = doc.join(small_side(found.select(F.col("key").alias(_KEY))), _KEY, "left_anti")
    chosen = doc.join(named, _KEY).where(F.col(f"{_DECIDED}.stays") & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{_DECIDED}.first_id"))).dropDuplicates([_KEY])
    return alone.select(*docs.columns).unionByName(chosen.select(*docs.columns))
