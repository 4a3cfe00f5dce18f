"""Language-model scores by context-tree weighting over bytes.

A text is the bytes of its words (between ASCII white space, A-Z lower-cased), a space after each, and an end mark (a line feed). A byte
is eight binary decisions, one for each level of a binary tree over bytes. For every decision node, contexts are the last 0 to
``DEPTH`` bytes of the text so far, across words, with end marks before its start; each context node has a Krichevsky-Trofimov estimate
from its counts, and the weighted probability P(s) = (K(s) + product of P(children of s)) / 2 mixes all depths. A byte's
probability mixes the estimates along its context path by the posterior weights of stopping there;
a context never seen in training has no say, so the path ends above it.

A gram is a context of full depth and the byte after it; a text's score is the sum of its grams' scores. Blocks of documents count their
distinct grams, which are summed by shuffle. Context trees are built in subtrees, each of the contexts with the same last byte, or more
bytes where that would be too many grams for a task; only the subtrees' roots reach the driver, which mixes the few nodes above them. Each block then
asks for the scores of its own distinct grams, and its words' counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.llm.common import clean_text, small_batches, written

DEPTH = 5
#: A block is about so many bytes of text, twice as many at most; the more there are, the fewer scores are asked for in all, and the more memory a task takes.
BLOCK_BYTES = 32 << 20
#: Of a block, texts of about so many bytes are packed for the last shuffle and cut into words together, and so many bytes are cut into grams.
PART_BYTES, SLICE_BYTES = 1 << 20, 1 << 19
#: The words of so many parts are searched together.
SEARCHED_PARTS = 8
#: Subtrees of more distinct grams are cut by one more byte of context; a task builds subtrees of about so many grams in all.
SHARD_GRAMS = 100_000
END = "\n"


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 5; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0, by Stirling's series from 8 on and the recurrence below."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _mix(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability, and the posterior weight of stopping here."""
    log_p = np.logaddexp(kt, below) - np.log(2)
    return log_p, np.exp(np.minimum(0.0, kt - np.log(2) - log_p))


class Texts:
    """Texts as words, and as one run of bytes with ``depth`` end marks before each text."""

    def __init__(self, texts: pa.Array, depth: int = DEPTH):
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
        joined = pc.binary_join(lists, " ")
        empty = pc.equal(pc.binary_length(joined), 0)
        #: Of each text its number of words, 0 if it is empty; and all words, the one of an empty text being empty.
        self.n_words = pc.if_else(empty, 0, pc.list_value_length(lists)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words, self.word_at = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
        streams = pc.binary_join_element_wise(END * depth, joined, pc.if_else(empty, END, " " + END), "")
        self.depth = depth
        self.at = np.append(0, np.cumsum(pc.binary_length(streams).to_numpy(zero_copy_only=False))).astype(np.int64)
        self.flat = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(streams)], pa.int32()), streams), "")[0].as_buffer(), dtype=np.uint8)

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each slice of the bytes its start, its grams (the newest byte lowest), and which of them are a text's own."""
        for lo in range(0, len(self.flat), SLICE_BYTES):
            hi = min(lo + SLICE_BYTES, len(self.flat))
            own = self.flat[max(0, lo - self.depth) : hi]
            own = np.concatenate([np.zeros(self.depth - min(lo, self.depth), dtype=np.uint8), own]).astype(np.int64)
            key = np.zeros(hi - lo, dtype=np.int64)
            for back in range(self.depth, -1, -1):
                key = (key << 8) | own[self.depth - back : len(own) - back]
            real = np.ones(hi - lo, dtype=bool)
            starts = self.at[max(0, np.searchsorted(self.at, lo) - 1) : np.searchsorted(self.at, hi)]
            for k in range(self.depth):
                pad = starts + k - lo
                real[pad[(pad >= 0) & (pad < hi - lo)]] = False
            yield lo, key, real

    def sums(self, index: pd.Index, scores: np.ndarray) -> np.ndarray:
        """Of each text the sum of its grams' scores, which stand in the order of ``index``."""
        total = np.zeros(len(self.at) - 1)
        for lo, key, real in self.grams():
            value = np.zeros(len(key))
            value[real] = scores[index.get_indexer(key[real])]
            first, last = np.searchsorted(self.at, lo, side="right") - 1, np.searchsorted(self.at, lo + len(key))
            total[first:last] += np.add.reduceat(value, np.maximum(self.at[first:last] - lo, 0))
        return total

    def distinct(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams with their counts in the texts of ``train``."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, key, real in self.grams():
            first, last = np.searchsorted(self.at, lo, side="right") - 1, np.searchsorted(self.at, lo + len(key))
            counts = np.repeat(train[first:last], np.diff(np.minimum(np.append(np.maximum(self.at[first:last], lo), self.at[last]), lo + len(key))))
            u, n = np.unique(key[real & counts], return_counts=True)
            other = np.unique(key[real & ~counts])
            held += [(u, n), (other, np.zeros(len(other), dtype=np.int64))]
            if len(held) > 12:
                held = [_summed(held)]
        return _summed(held)


def _packed(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _unpacked(parts: pa.Array | pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield from pa.ipc.open_stream(part.as_buffer())


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(u, kind="stable")
    u, n = u[order], n[order]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, dtype=np.int64)
    return u[first], np.add.reduceat(n, first) if len(u) else n


def _levels(keys: np.ndarray, counts: np.ndarray, top: int, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray, dict, np.ndarray]]:
    """For each of the eight levels of a byte: each gram's decision node (1 to 255) and bit; the context nodes of depth ``depth`` to ``top``,
    as their keys (context, then decision node), each gram's place among them, counts and weights of stopping; and ln P of those of ``top``."""
    for level in range(8):
        node, bit = (1 << level) | ((keys & 255) >> (8 - level)), ((keys & 255) >> (7 - level)) & 1
        below, own = None, {}
        for d in range(depth, top - 1, -1):
            unique, at = np.unique(((keys >> 8) & ((1 << (8 * d)) - 1)) << 8 | node, return_inverse=True)
            n1 = np.bincount(at, weights=counts * bit)
            n0 = np.bincount(at, weights=counts) - n1
            log_p = kt = log_kt(n0, n1)
            stop = np.ones_like(kt)
            if below is not None:
                # a child's parent is that of any of its grams
                child_at, child_p = below
                parent = np.zeros(len(child_p), dtype=np.int64)
                parent[child_at] = at
                log_p, stop = _mix(kt, np.bincount(parent, weights=child_p, minlength=len(unique)))
            own[d] = (unique, at, n0, n1, stop)
            below = (at, log_p)
        yield node, bit, own, below[1]


def roots(keys: np.ndarray, counts: np.ndarray, top: int, depth: int = DEPTH) -> pd.DataFrame:
    """The context nodes of depth ``top``: ``top, key, n0, n1, log_p``."""
    parts = [pd.DataFrame({"top": top, "key": own[top][0], "n0": own[top][2], "n1": own[top][3], "log_p": log_p}) for _, _, own, log_p in _levels(keys, counts, top, depth)]
    return pd.concat(parts)


class Top:
    """The context nodes above the subtrees, by depth: sorted keys with counts and weights of stopping."""

    def __init__(self, rows: pd.DataFrame):
        self.nodes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        below = pd.DataFrame({"key": np.zeros(0, dtype=np.int64), "n0": [], "n1": [], "log_p": []})
        for d in range(int(rows["top"].max()) - 1 if len(rows) else 0, -1, -1):
            children = pd.concat([below, rows.loc[rows["top"] == d + 1, ["key", "n0", "n1", "log_p"]]])
            key = children["key"].to_numpy(dtype=np.int64)
            parent = ((key >> 8) & ((1 << (8 * d)) - 1)) << 8 | key & 255
            unique, at = np.unique(parent, return_inverse=True)
            n0, n1, inner = (np.bincount(at, weights=children[c], minlength=len(unique)) for c in ("n0", "n1", "log_p"))
            log_p, stop = _mix(log_kt(n0, n1), inner)
            self.nodes[d] = (unique, n0, n1, stop)
            below = pd.DataFrame({"key": unique, "n0": n0, "n1": n1, "log_p": log_p})


def _kt(a: np.ndarray, b: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (np.where(bit == 1, b, a) + 0.5) / (a + b + 1)


def scores(keys: np.ndarray, counts: np.ndarray, top: int, above: Top, depth: int = DEPTH) -> np.ndarray:
    """ln probability of each gram's byte in its context."""
    total = np.zeros(len(keys))
    for node, bit, own, _ in _levels(keys, counts, top, depth):
        p = seen = None
        for d in range(depth, -1, -1):
            if d >= top:
                _, at, n0, n1, stop = own[d]
            else:
                unique, n0, n1, stop = above.nodes[d]
                at = np.searchsorted(unique, ((keys >> 8) & ((1 << (8 * d)) - 1)) << 8 | node)
            a, b, w = n0[at], n1[at], stop[at]
            p = _kt(a, b, bit) if p is None else np.where(seen, w * _kt(a, b, bit) + (1 - w) * p, _kt(a, b, bit))
            seen = a + b > 0
        total += np.log(p)
    return total


def _blocks(docs: DataFrame) -> DataFrame:
    """``block, doc_id, held_out, text``: ``docs(doc_id, held_out, text)`` in blocks of about ``BLOCK_BYTES`` of text, whose rows follow one another. They are stored
    as rows, as a reader holds thousands of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            ends = size + np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            yield pa.RecordBatch.from_arrays([pa.array(first + ends // (2 * BLOCK_BYTES)), *b.columns], names=["block", "doc_id", "held_out", "text"])
            size = int(ends[-1]) if len(ends) else size

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.coalesce(max(1, total // BLOCK_BYTES)).mapInArrow(run, "block long, doc_id long, held_out boolean, text string")


def _runs(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The blocks of a batch, each with runs of its rows of about ``PART_BYTES``."""
    block = b.column(0).to_numpy()
    part = np.cumsum(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64) + 64) // PART_BYTES
    cuts = np.flatnonzero(np.append(True, (np.diff(block) != 0) | (np.diff(part) != 0))).tolist() if len(b) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(b)]):
        yield int(block[lo]), b.slice(lo, hi - lo).select(["doc_id", "held_out", "text"])


def _parts(blocks: DataFrame) -> DataFrame:
    """``block, part``: some of a block's rows, compressed, as they are shuffled as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, rows in _runs(b):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(rows)], pa.binary())], names=["block", "part"])

    return blocks.mapInArrow(run, "block long, part binary")


def _asked(blocks: DataFrame) -> DataFrame:
    """``block, gram, word, n``: each block's distinct grams and distinct words with their counts in its training texts. A block's rows follow one another."""

    def flush(block: int, grams: list[tuple[np.ndarray, np.ndarray]], words: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        gram, n = _summed(grams)
        word = counted(words)
        grams.clear()
        words.clear()
        pa.default_memory_pool().release_unused()  # workers live on, with what they hold
        both = pa.concat_tables([
            pa.table([pa.array(np.full(len(gram), block)), pa.array(gram), pa.nulls(len(gram), pa.string()), pa.array(n)], names=names),
            pa.table([pa.array(np.full(len(word), block)), pa.nulls(len(word), pa.int64()), word.column("word"), word.column("n")], names=names),
        ])
        yield from both.to_batches(50_000)

    def counted(words: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(words).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, grams, words = None, [], []
        for b in batches:
            for number, rows in _runs(b):
                if block is not None and number != block:
                    yield from flush(block, grams, words)
                block = number
                own, train = Texts(rows.column("text")), ~rows.column("held_out").to_numpy(zero_copy_only=False)
                grams.append(own.distinct(train))
                word = own.words.dictionary_encode()
                n = np.bincount(word.indices.to_numpy(), weights=np.repeat(train, np.diff(own.word_at)), minlength=len(word.dictionary)).astype(np.int64)
                words.append(pa.table({"word": word.dictionary, "n": n}))
                if len(grams) > 4:
                    grams[:], words[:] = [_summed(grams)], [counted(words)]
                    pa.default_memory_pool().release_unused()
        if block is not None:
            yield from flush(block, grams, words)

    names = ["block", "gram", "word", "n"]
    return blocks.mapInArrow(run, "block long, gram long, word string, n long")


def _sharded(counted: DataFrame, shard_grams: int) -> DataFrame:
    """``gram, n, top, shard``: the depth of each gram's subtree and the task that builds it."""
    total, crowded, depth = counted.count(), [], 1
    rows = counted.withColumn("top", F.lit(1))
    suffix = lambda d: F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1))
    while depth < DEPTH:
        found = rows.where(F.col("top") == depth).groupBy(suffix(depth).alias("full")).count().where(F.col("count") > shard_grams).select("full")
        crowded = found.collect()  # fewer than total / shard_grams
        if not crowded:
            break
        full = F.broadcast(counted.sparkSession.createDataFrame(crowded, "full long"))
        hit = (F.col("top") == depth) & (suffix(depth) == F.col("full"))
        rows = rows.join(full, hit, "left").withColumn("top", F.when(F.col("full").isNotNull(), depth + 1).otherwise(F.col("top"))).drop("full")
        depth += 1
    root = suffix(DEPTH).bitwiseAND(F.expr("shiftleft(1L, top * 8) - 1"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("top", root), F.lit(total // shard_grams + 1)).cast("int"))


def _gram_scores(counted: DataFrame, shard_grams: int) -> DataFrame:
    """``gram, n`` to ``gram, lp``: ln probability of each gram's byte in its context."""

    def by_top(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for top, own in rows.groupby("top"):
            yield int(top), own["gram"].to_numpy(), own["n"].to_numpy(dtype=float)

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([roots(k, n, top) for top, k, n in by_top(rows)])

    def scored(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"gram": k, "lp": scores(k, n, top, shared.value)}) for top, k, n in by_top(rows)])

    rows = written(_sharded(counted, shard_grams).repartition("shard"), "ctw-shards")
    # 256 * 255 rows at most for the whole tree and for each subtree that was cut, of which there are fewer than grams / shard_grams at each depth
    above = Top(rows.groupBy("shard").applyInPandas(found, "top int, key long, n0 double, n1 double, log_p double").toPandas())
    shared = counted.sparkSession.sparkContext.broadcast(above)
    return rows.groupBy("shard").applyInPandas(scored, "gram long, lp double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """For every row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``base_score`` is the unigram score with half-counts, ``score`` the context-tree model's, both log10
    probabilities of the whole text; ``bits_per_byte`` is the model's code length over the bytes it codes. Learns from all
    rows that are not held out. Null texts count as empty: one token, the end. Rows with a null id learn and are scored; repeated rows stay.
    Other columns go, whatever their names. An empty table gives an empty one.
    """
    rows = clean_text(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    small_batches(docs.sparkSession)
    blocks = written(_blocks(rows), "ctw-blocks", "zstd")
    asked = written(_asked(blocks), "ctw-asked")
    counted = written(asked.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "ctw-grams")
    words = written(asked.where("word <> ''").groupBy("word").agg(F.sum("n").alias("c")), "ctw-words")
    ends = rows.where("not held_out").count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_train, distinct = int(total[0]) + ends, int(total[1]) + (ends > 0)
    shift = float(np.log10(n_train + 0.5 * (distinct + 1)))
    base_end = float(np.log10(ends + 0.5)) - shift
    of_grams = asked.where("gram is not null").select("block", "gram").join(_gram_scores(counted, shard_grams), "gram").select("block", "gram", F.lit(None).cast("string").alias("word"), F.col("lp").alias("value"))
    of_words = asked.where("word <> ''").select("block", "word").join(words, "word").select("block", F.lit(None).cast("long").alias("gram"), "word", F.col("c").cast("double").alias("value"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.select(["gram", "value"]).filter(pc.is_valid(right.column("gram")))
        # a block whose file two tasks read asks twice for some
        gram, at = np.unique(found.column("gram").to_numpy(), return_index=True)
        index, lp = pd.Index(gram), found.column("value").to_numpy()[at] / np.log(10)
        found = right.select(["word", "value"]).filter(pc.is_valid(right.column("word")))
        known, c_known = found.column("word").combine_chunks(), np.append(found.column("value").to_numpy(), 0.0)
        out, held = [schema.empty_table()], []

        def flush() -> None:
            # the block's words are hashed anew by each search, so parts are searched together by their different words
            at = pc.index_in(pa.chunked_array([h[3].dictionary for h in held], pa.string()), value_set=known).fill_null(-1).to_numpy()
            ends_at = np.cumsum([len(h[3].dictionary) for h in held])
            for (rows, own, model, word), lo, hi in zip(held, [0, *ends_at[:-1]], ends_at, strict=True):
                n_words, word_at, coded = own
                c = c_known[at[lo:hi]][word.indices.to_numpy()]
                real = np.repeat(n_words > 0, np.diff(word_at))
                base = np.add.reduceat(np.where(real, np.log10(c + 0.5) - shift, 0.0), word_at[:-1]) + base_end
                n_known = np.add.reduceat((real & (c > 0)).astype(np.int64), word_at[:-1]) + (ends > 0)
                columns = [rows.column("doc_id"), rows.column("held_out"), n_words + 1, n_known, np.full(len(rows), n_train), base, model, -model * np.log2(10) / coded]
                out.append(pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema))
            held.clear()

        for rows in _unpacked(left.column("part")):
            own = Texts(rows.column("text"))
            held.append((rows.select(["doc_id", "held_out"]), (own.n_words, own.word_at, np.diff(own.at) - own.depth), own.sums(index, lp), own.words.dictionary_encode()))
            if len(held) == SEARCHED_PARTS:
                flush()
        if held:
            flush()
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    both = _parts(blocks).groupBy("block").cogroup(of_grams.unionByName(of_words).groupBy("block"))
    return both.applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
