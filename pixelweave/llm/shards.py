"""Flat files of token ids, a minimal perfect hash index over them, and a scan that needs no index.

A shard is a file of little-endian unsigned ids, two bytes each where the vocabulary allows it and four
otherwise, documents one after another, each with its end id. Shards lie in the shared folder and are
written under a name of their attempt and then renamed, so a task that runs again leaves the same file.

The index cuts keys into buckets by hash. In a bucket of n keys a minimal perfect hash (hash, displace)
gives every key a slot of its own below n; the slot holds the key's fingerprint, against keys that were
never stored, and its document's shard, offset and length.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import clean_text, fresh_path, written
from pixelweave.llm.tokens import encoder

#: About so many keys share a bucket of the index.
BUCKET_KEYS = 16_384
#: A separator scan reads so many bytes at a time.
SCAN_BYTES = 4 << 20


class ShardWriter:
    """A shard under way; ``close`` puts it in its place."""

    def __init__(self, folder: str, shard: int):
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.own = f"{path}/shard-{shard:06d}.ids", f"{path}/.{shard:06d}-{uuid.uuid4().hex}"
        self.file = self.fs.open_output_stream(self.own)

    def close(self) -> None:
        self.file.close()
        self.fs.move(self.own, self.path)


def _open(folder: str, shard: int) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(folder)
    return store.open_input_file(f"{path}/shard-{shard:06d}.ids")


def _write(docs: DataFrame, folder: str, vocabulary: str, end: int, dtype: str) -> DataFrame:
    """Each partition of ``docs(doc_id, text)`` becomes a shard, in order; ``doc_id, again, shard, ordinal, offset, n_tokens``
    of its documents, where ``again`` counts the rows before with the same id, if these stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, out = encoder(vocabulary), TaskContext.get().partitionId(), None
        offset, ordinal, last, again = 0, 0, (None, False), 0
        tail = np.array([end], dtype=dtype).tobytes()
        for b in batches:
            for part in range(0, len(b), 2000):
                own = b.slice(part, 2000)
                ids = own.column(0).to_pylist()
                rows = []
                out = out or ShardWriter(folder, shard)
                for i, raw in zip(ids, enc.encode(own.column(1)), strict=True):
                    raw = raw if enc.dtype == np.dtype(dtype) else np.frombuffer(raw, enc.dtype).astype(dtype).tobytes()
                    out.file.write(raw + tail)
                    n = len(raw) // np.dtype(dtype).itemsize + 1
                    again = again + 1 if last == (i, True) else 0
                    rows.append((i, again, shard, ordinal, offset, n))
                    last, offset, ordinal = (i, True), offset + n, ordinal + 1
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        if out:
            out.close()

    names, types = ["doc_id", "again", "shard", "ordinal", "offset", "n_tokens"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.mapInArrow(run, "doc_id long, again long, shard int, ordinal long, offset long, n_tokens long")


def _dtype(vocabulary: str, end: int) -> str:
    return "<u2" if max(encoder(vocabulary).tokenizer.get_vocab_size() - 1, end) < 1 << 16 else "<u4"


def perfect_hash(h: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of distinct 64-bit hashes: a seed, displacements of groups of about four keys, and each key's slot."""
    n = len(h)
    m = max(1, n // 4)
    for seed in range(1, 100):
        group = _mixed(h, 2 * seed) % np.uint64(m)
        a, b = _mixed(h, 2 * seed + 1) % np.uint64(n), np.uint64(1) + _mixed(h, 2 * seed + 1) // np.uint64(n) % np.uint64(max(1, n - 1))
        order = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[order], np.arange(m + 1, dtype=np.uint64))
        taken, slots, displaced = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(m, dtype=np.uint32)
        for g in np.argsort(-(starts[1:] - starts[:-1]), kind="stable"):
            keys = order[starts[g] : starts[g + 1]]
            if not len(keys):
                break
            for d in range(0, 64 * n + 64, 64):
                tries = (a[keys][None, :] + np.arange(d, d + 64, dtype=np.uint64)[:, None] * b[keys][None, :] + np.arange(d, d + 64, dtype=np.uint64)[:, None] // np.uint64(n)) % np.uint64(n)
                tries = tries.astype(np.int64)
                free = ~taken[tries].any(axis=1)
                if len(keys) > 1:
                    s = np.sort(tries, axis=1)
                    free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if free.any():
                    k = int(free.argmax())
                    displaced[g], slots[keys] = d + k, tries[k]
                    taken[tries[k]] = True
                    break
            else:
                break
        if taken.all():
            return seed, displaced, slots
    raise ValueError("keys are not distinct")


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer, so that one hash of a key serves as many."""
    x = h.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots_of(h: np.ndarray, seed: int, displaced: np.ndarray, n: int) -> np.ndarray:
    """The slots that `perfect_hash` gave these hashes."""
    d = displaced[(_mixed(h, 2 * seed) % np.uint64(len(displaced))).astype(np.int64)].astype(np.uint64)
    x = _mixed(h, 2 * seed + 1)
    return ((x % np.uint64(n) + d * (np.uint64(1) + x // np.uint64(n) % np.uint64(max(1, n - 1))) + d // np.uint64(n)) % np.uint64(n)).astype(np.int64)


def _hash() -> Column:
    """Of a key; a null id is told from all others."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "again")


def _keyed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("h", _hash()).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int"))


def _numbered(entries: DataFrame, sizes: list[Row]) -> DataFrame:
    """``entries`` with ``again`` counted on from the shards before: an id's rows may go on through several shards. ``sizes``: of each
    shard, in order, its first and last id and how many rows it has of each."""
    last, held, ahead = None, 0, []
    for r in sizes:
        before = held if last == (r["low"],) else 0
        if before:
            ahead.append((r["shard"], before))
        last, held = (r["high"],), r["n_high"] + (before if r["low"] == r["high"] else 0)
    if not ahead:
        return entries
    low = {r["shard"]: r["low"] for r in sizes}
    # a row for each shard at most
    carried = F.broadcast(entries.sparkSession.createDataFrame([(k, low[k], n) for k, n in ahead], "in_shard int, low long, n_ahead long"))
    joined = entries.join(carried, (F.col("shard") == F.col("in_shard")) & F.col("doc_id").eqNullSafe(F.col("low")), "left")
    return joined.withColumn("again", F.col("again") + F.coalesce("n_ahead", F.lit(0))).select(*entries.columns)


def _split_id() -> list[Column]:
    """An id in two columns without nulls, as one with nulls would reach pandas as a float."""
    return [F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id")]


def _whole_id() -> Column:
    return F.when(~F.col("no_id"), F.col("id")).alias("doc_id")


class TokenStore:
    """Shards in a folder with their index and the ids before each shard."""

    def __init__(self, spark: SparkSession, folder: str, index: DataFrame, buckets: int, dtype: str, before: dict[int, int]):
        self.spark, self.folder, self.index, self.buckets, self.dtype, self.before = spark, folder, index, buckets, dtype, before

    @classmethod
    def write(cls, docs: DataFrame, vocabulary: str, end: int = 2, folder: str | None = None) -> TokenStore:
        """Encode whole texts (null: empty), in ascending order of doc_id, null ids first; equal ids in the order of a hash of their text."""
        spark, dtype = docs.sparkSession, _dtype(vocabulary, end)
        folder = folder or fresh_path(spark, "token-shards")
        doc = clean_text(docs, "doc_id", "text")
        # by the text too, so that rows that share an id needn't share a shard
        doc = doc.withColumn("of_text", F.xxhash64("text"))
        ordered = doc.repartitionByRange("doc_id", "of_text").sortWithinPartitions("doc_id", "of_text").select("doc_id", "text")
        entries = written(_write(ordered, folder, vocabulary, end, dtype), "token-entries")
        edges = [F.min_by("doc_id", "ordinal").alias("low"), F.max_by("doc_id", "ordinal").alias("high"), (F.max_by("again", "ordinal") + 1).alias("n_high")]
        sizes = entries.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("keys"), *edges).orderBy("shard").collect()  # a row for each shard
        entries = _numbered(entries, sizes)
        before, total = {}, 0
        for r in sizes:
            before[r["shard"]] = total
            total += r["n"]
        buckets = max(1, sum(r["keys"] for r in sizes) // BUCKET_KEYS)

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            # of keys that share a hash all but one are listed beside the table
            twice = rows["h"].duplicated()
            side = rows.loc[twice, ["id", "no_id", "again", "shard", "offset", "n_tokens"]].to_dict("records")
            rows = rows[~twice]
            h = rows["h"].to_numpy().view(np.uint64)
            seed, displaced, slots = perfect_hash(h)
            at = np.argsort(slots)
            columns = {"fingerprint": (_mixed(h, 0) >> np.uint64(32)).astype("<u4"), "shard": rows["shard"].to_numpy("<i4"), "offset": rows["offset"].to_numpy("<i8"), "length": rows["n_tokens"].to_numpy("<i8")}
            return pd.DataFrame([{"bucket": rows["bucket"].iloc[0], "n": len(h), "seed": seed, "displaced": displaced.astype("<u4").tobytes(), "side": side} | {k: v[at].tobytes() for k, v in columns.items()}])

        schema = "bucket int, n long, seed int, displaced binary, fingerprint binary, shard binary, offset binary, length binary, side array<struct<id:long,no_id:boolean,again:long,shard:int,offset:long,n_tokens:long>>"
        index = _keyed(entries, buckets).select("bucket", *_split_id(), "again", "h", "shard", "offset", "n_tokens").groupBy("bucket").applyInPandas(build, schema)
        return cls(spark, folder, written(index, "token-index"), buckets, dtype, before)

    def locate(self, keys: DataFrame) -> DataFrame:
        """``doc_id, again`` to ``doc_id, again, shard, offset, n_tokens``, by the index alone; keys it doesn't hold are left out."""

        def find(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(index):
                return pd.DataFrame(columns=["id", "no_id", "again", "shard", "offset", "n_tokens"])
            r = index.iloc[0]
            h = asked["h"].to_numpy().view(np.uint64)
            slot = slots_of(h, int(r["seed"]), np.frombuffer(r["displaced"], "<u4"), int(r["n"]))
            hit = np.frombuffer(r["fingerprint"], "<u4")[slot] == (_mixed(h, 0) >> np.uint64(32)).astype(np.uint32)
            slot, own = slot[hit], asked.loc[hit, ["id", "no_id", "again"]]
            found = own.assign(shard=np.frombuffer(r["shard"], "<i4")[slot], offset=np.frombuffer(r["offset"], "<i8")[slot], n_tokens=np.frombuffer(r["length"], "<i8")[slot])
            if len(r["side"]):
                side = pd.DataFrame(list(r["side"])).set_index(["id", "no_id", "again"])
                found = found.set_index(["id", "no_id", "again"])
                found.update(side)
                found = found.astype("int64").reset_index()
            return found

        asked = _keyed(keys, self.buckets).select("bucket", *_split_id(), "again", "h")
        found = asked.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInPandas(find, "id long, no_id boolean, again long, shard int, offset long, n_tokens long")
        return found.select(_whole_id(), "again", "shard", "offset", "n_tokens")

    def read(self, keys: DataFrame) -> DataFrame:
        """Of each key's document ``doc_id, start, n_tokens, ids_crc32``, from its ids in the shards; start counts all ids before it."""
        folder, dtype, before = self.folder, self.dtype, self.before

        def fetch(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("offset")
            size, crcs = np.dtype(dtype).itemsize, []
            with _open(folder, int(rows["shard"].iloc[0])) as f:
                for offset, n in zip(rows["offset"].tolist(), rows["n_tokens"].tolist(), strict=True):
                    crcs.append(zlib.crc32(np.frombuffer(f.read_at(n * size, offset * size), dtype).astype("<u4").tobytes()))
            return pd.DataFrame({"id": rows["id"], "no_id": rows["no_id"], "start": rows["offset"] + before[int(rows["shard"].iloc[0])], "n_tokens": rows["n_tokens"], "ids_crc32": np.array(crcs, dtype=np.int64)})

        rows = self.locate(keys).select(*_split_id(), "shard", "offset", "n_tokens")
        read = rows.groupBy("shard").applyInPandas(fetch, "id long, no_id boolean, start long, n_tokens long, ids_crc32 long")
        return read.select(_whole_id(), "start", "n_tokens", "ids_crc32")


def keys_of(docs: DataFrame) -> DataFrame:
    """``doc_id, again``: a key for every row of ``docs``."""
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count()
    return counts.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("again"))


def write_flat(docs: DataFrame, vocabulary: str, end: int, folder: str) -> DataFrame:
    """Encode ``docs(doc_id, text)`` as it is dealt, a shard for each partition, without an index; returns ``shard, ordinal, doc_id`` only.

    Null texts count as empty, so they are their end alone; null ids and repeated ids and rows are written like any other; other columns go.
    An empty table leaves no file and gives no row.
    """
    rows = _write(clean_text(docs, "doc_id", "text"), folder, vocabulary, end, _dtype(vocabulary, end))
    return written(rows.select("shard", "ordinal", "doc_id"), "flat-order")


def scan_counts(spark: SparkSession, folder: str, end: int, dtype: str, block_bytes: int = SCAN_BYTES) -> DataFrame:
    """``shard, ordinal, start, n_tokens`` of every document in the flat files of ``folder``.

    Blocks are searched for the end id on their own; a prefix scan over the blocks' counts and last ends gives
    each block's first document its number and its start. Ids after the last end are a document without one.
    An empty file has none, and neither has a folder without files. Documents are told by their place only, so null and repeated ids make no difference.
    """
    store, path = fs.FileSystem.from_uri(folder)
    size = np.dtype(dtype).itemsize
    block = block_bytes // size
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    files = [(int(f.base_name[6:12]), f.size // size) for f in found if f.base_name.startswith("shard-") and f.size]
    listed = spark.createDataFrame(files, "shard int, total long")
    blocks = listed.select("shard", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block))).alias("block"))
    # a file's blocks go to as many tasks as there are, a few blocks to each
    blocks = blocks.repartition(max(1, min(sum(-(-n // block) for _, n in files) // 4, 100_000)), "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, total, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(folder, shard) as f:
                    ids = np.frombuffer(f.read_at(min(block, total - k * block) * size, k * block * size), dtype)
                ends = np.flatnonzero(ids == end).astype(np.int64) + k * block + 1
                if k * block + len(ids) == total and (not len(ends) or ends[-1] != total):
                    ends = np.append(ends, total)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], names=["shard", "block", "ends"])

    hits = written(blocks.mapInArrow(search, "shard int, block long, ends array<long>"), "flat-ends")
    above = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = hits.select("shard", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    carry = carry.select("shard", "block", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(above), F.lit(0)).alias("begun"))
    lagged = F.concat(F.array("begun"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    docs = hits.where(F.size("ends") > 0).join(carry, ["shard", "block"]).select("shard", "first", "ends", lagged.alias("starts"))
    out = docs.select("shard", "first", F.posexplode(F.arrays_zip("starts", "ends")).alias("at", "d"))
    return out.select("shard", (F.col("first") + F.col("at")).alias("ordinal"), F.col("d.starts").alias("start"), (F.col("d.ends") - F.col("d.starts")).alias("n_tokens"))
