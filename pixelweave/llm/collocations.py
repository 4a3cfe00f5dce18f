"""Phrases whose words belong together, counted on a weighted de Bruijn graph.

Texts are cut into runs of words. Each place of a run gives one edge, the longest gram that begins there: five words, between the nodes of its first and its last four, or what is
left before the run's end. Edges are summed over the corpus. Where a node has one edge in and one out, and no run begins or ends there, its edges become one path; a passage
that many documents share is a single row then. How often a shorter phrase occurs is the flow out of its node, the weight of all edges that begin with it, plus the runs that end with it.

A gram also ends, like at a run's end, before the words that cannot belong to a candidate with it: a phrase that occurs ``least`` times consists of words, pairs and triples of
words that occur so often. Which ones do is known from counts over the whole corpus, told to the tasks as three bitmaps of fixed size. They may say yes too often, by chance, which adds
edges, but never no, so they change no count of a candidate.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import written

#: Bits of the bitmap of frequent words, and of those of pairs and of triples; two and eight megabytes.
WORD_BITS, PAIR_BITS = 1 << 24, 1 << 26
#: Counts of pairs and triples are dealt to so many parts that a part is of so many places of the corpus.
PART_WORDS = 1 << 21
#: Bits of a bitmap that one task makes.
CHUNK_BITS = 1 << 19
#: Texts are cut into words so many bytes at a time.
TEXT_BYTES = 8 << 20
LONGEST = 5
_PLACES = bytes(ord("\n") if c in b".,;:!?\n\x0b\x0c\r" else ord(" ") if c == ord("\t") else c for c in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts of one language: ``ids`` in order, -1 between pieces and texts, and each id's word and hash."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        import xxhash

        # full stops are places between pieces by now, so one alone can mark them
        flat = b"\n".join(texts).lower().translate(_PLACES).replace(b"\n", b" . ")
        whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(flat)], dtype=np.int64)), pa.py_buffer(flat)])
        coded = pc.ascii_split_whitespace(whole).flatten().dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        none = np.array([w in ("", ".") for w in self.words], dtype=bool)
        ids = coded.indices.to_numpy().astype(np.int64)
        self.ids = np.where(none[ids], -1, ids) if len(ids) else ids
        of = lang.encode() + b"\n"
        self.hashes = np.array([xxhash.xxh64_intdigest(of + w.encode()) for w in self.words], dtype=np.uint64)

    def pair_hashes(self, at: np.ndarray) -> np.ndarray:
        return _mixed(_mixed(self.hashes[self.ids[at]]) * np.uint64(3) + self.hashes[self.ids[at + 1]])

    def triple_hashes(self, at: np.ndarray) -> np.ndarray:
        return _mixed(self.pair_hashes(at) * np.uint64(3) + self.hashes[self.ids[at + 2]])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """The words of each language, of a bounded share of a batch at a time, or of one text."""
    for b in batches:
        langs, texts = b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())
        by: dict[str, list[bytes]] = {}
        size = 0
        for lang, t in zip(langs, texts, strict=True):
            text = t.as_py()
            by.setdefault(lang, []).append(text)
            size += len(text)
            if size > TEXT_BYTES:
                yield from ((k, Words(k, v)) for k, v in by.items())
                by, size = {}, 0
        yield from ((k, Words(k, v)) for k, v in by.items())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, w in _each(batches):
        counts = np.bincount(w.ids[w.ids >= 0], minlength=len(w.words))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([w.words[i] for i in some], pa.string()), pa.array(w.hashes[some].view(np.int64)), pa.array(counts[some])], names=["lang", "word", "h", "n"])


def _has(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = (hashes % np.uint64(bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _beside(w: Words, word_map: np.ndarray, bits: int) -> np.ndarray:
    """Places whose word and next word are in the bitmap and in one piece."""
    often = np.append(_has(word_map, w.hashes, bits), False)[w.ids]  # the last for -1
    return np.flatnonzero(often[:-1] & often[1:]) if len(often) else np.zeros(0, dtype=np.int64)


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes' places, of a fixed size: made in chunks, which are all that reaches the driver."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chunk = np.zeros(CHUNK_BITS, dtype=np.uint8)
        chunk[rows["at"].to_numpy() % CHUNK_BITS] = 1
        return pd.DataFrame({"chunk": [int(rows["at"].iloc[0] // CHUNK_BITS)], "b": [np.packbits(chunk, bitorder="little").tobytes()]})

    # unsigned modulo of a power of two
    at = hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at")).distinct()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in at.groupBy(F.floor(F.col("at") / CHUNK_BITS).alias("c")).applyInPandas(run, "chunk long, b binary").toLocalIterator():
        out[r["chunk"] * CHUNK_BITS // 8 :][: CHUNK_BITS // 8] = np.frombuffer(r["b"], dtype=np.uint8)
    return out


def _codes(w: Words, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of given lengths at given places: of each a first place's number, and the count."""
    code = np.zeros(len(at), dtype=np.int64)
    for j in range(LONGEST):
        inside = lengths > j
        word = np.where(inside, w.ids[np.minimum(at + j, len(w.ids) - 1)] + 1, 0)
        code = np.unique(code * (len(w.words) + 1) + word, return_inverse=True)[1]
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return first, counts


def _shared(spark: SparkSession, value: np.ndarray) -> Callable[[], np.ndarray]:
    sent = spark.sparkContext.broadcast(value)
    return lambda: sent.value


def _frequent(docs: DataFrame, hashes: Callable[[Words], np.ndarray], parts: int, least: int) -> DataFrame:
    """``h``: the hashes that occur ``least`` times or more in the corpus. Each piece of a batch counts its own; the counts go packed to the part of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in _each(batches):
            found, counts = np.unique(hashes(w), return_counts=True)
            part = (found >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part, found, counts = part[order], found[order], counts[order].astype(np.int64)
            at = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, dtype=int)
            each = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[at[:-1]].astype(np.int64)), pa.array([found[a:b].tobytes() for a, b in each], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in each], pa.binary())], names=["part", "hs", "ns"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        h, n = (np.frombuffer(b"".join(rows[c]), dtype=np.int64) for c in ("hs", "ns"))
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return pd.DataFrame({"h": h[first][np.add.reduceat(n, first) >= least]})

    return docs.mapInArrow(run, "part long, hs binary, ns binary").groupBy("part").applyInPandas(add, "h long")


def edges(docs: DataFrame, least: int, word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS) -> tuple[DataFrame, DataFrame]:
    """Words and edges of ``docs(lang, text)`` without nulls: ``lang, word, n`` of all words, and ``lang, gram, k, n`` of grams of ``k`` words, two to five: the longest at each place of a run."""
    spark, docs = docs.sparkSession, docs.select("lang", "text")
    counted = docs.mapInArrow(_word_counts, "lang string, word string, h long, n long").groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("n").alias("n"))
    counted = written(counted, "phrase-words")
    parts = (counted.agg(F.sum("n")).first()[0] or 0) // PART_WORDS + spark.sparkContext.defaultParallelism
    words = _shared(spark, _bitmap(counted.where(F.col("n") >= least).select("h"), word_bits))
    beside = lambda w: _beside(w, words(), word_bits)
    pairs = _shared(spark, _bitmap(_frequent(docs, lambda w: w.pair_hashes(beside(w)), parts, least), pair_bits))

    def paired(w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places that begin a frequent pair, and whether the next one does too."""
        at = beside(w)
        at = at[_has(pairs(), w.pair_hashes(at), pair_bits)]
        goes = np.zeros(len(w.ids) + 1, dtype=bool)
        goes[at] = True
        return at, goes[at + 1]

    def tripled(w: Words) -> np.ndarray:
        at, more = paired(w)
        return w.triple_hashes(at[more])

    triples = _shared(spark, _bitmap(_frequent(docs, tripled, parts, least), pair_bits))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, w in _each(batches):
            at, more = paired(w)
            goes = np.zeros(len(w.ids) + LONGEST, dtype=bool)
            threes = at[more]
            goes[threes[_has(triples(), w.triple_hashes(threes), pair_bits)]] = True
            ahead, on = np.full(len(at), 2), np.ones(len(at), dtype=bool)
            for j in range(LONGEST - 2):
                on = on & goes[at + j]
                ahead += on
            first, counts = _codes(w, at, ahead)
            names = [" ".join(w.words[i] for i in w.ids[a : a + k].tolist()) for a, k in zip(at[first].tolist(), ahead[first].tolist(), strict=True)]
            by: dict[int, list[int]] = {}
            for i, name in enumerate(names):
                by.setdefault(zlib.crc32(name.encode()) % parts, []).append(i)
            own = list(by.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array([lang] * len(by), pa.string()), pa.array(["\n".join(names[i] for i in at) for at in own], pa.string()), pa.array([counts[at].tolist() for at in own], pa.list_(pa.int64()))], names=["part", "lang", "grams", "ns"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        sums: dict[tuple[str, str], int] = {}
        for lang, names, ns in zip(rows["lang"], rows["grams"], rows["ns"], strict=True):
            for name, n in zip(names.split("\n"), ns.tolist(), strict=True):
                sums[lang, name] = sums.get((lang, name), 0) + n
        return pd.DataFrame({"lang": [x for x, _ in sums], "gram": [x for _, x in sums], "k": [x.count(" ") + 1 for _, x in sums], "n": list(sums.values())})

    # no word holds a line end, so grams of one part go as lines
    found = docs.mapInArrow(grams, "part long, lang string, grams string, ns array<long>").groupBy("part").applyInPandas(add, "lang string, gram string, k int, n long")
    return counted.select("lang", "word", "n"), written(found, "phrase-edges")


def _head(gram: str, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def _tail(gram: str, k: int) -> Column:
    return F.substring_index(gram, " ", -k)


def paths(found: DataFrame, least: int) -> DataFrame:
    """``lang, words, n``: the five-word edges of ``found``, those that follow each other over unary nodes as one path; ``n`` is the weight of all edges of a path.

    A node is unary if it has one edge in and one out of the same weight and no run ends at it (so none begins there). Paths are put together by pointer doubling, in as many rounds as
    the longest path has binary digits. Edges under ``least`` stay single.
    """
    five = found.where(F.col("k") == LONGEST)
    ends = found.where(F.col("k") == LONGEST - 1).select("lang", F.col("gram").alias("node"), F.lit(0).alias("out"), F.lit(0).alias("into"), F.lit(None).cast("string").alias("edge"), F.lit(1).alias("ended"), F.lit(0).cast("long").alias("flow"))
    row = lambda node, out, sign: five.select("lang", node.alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"), F.when(F.lit(out == 0), F.col("gram")).alias("edge"), F.lit(0).alias("ended"), (F.col("n") * sign).alias("flow"))
    nodes = row(_head("gram", LONGEST - 1), 1, 1).unionByName(row(_tail("gram", LONGEST - 1), 0, -1)).unionByName(ends)
    nodes = nodes.groupBy("lang", "node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"), F.max("edge").alias("edge"), F.max("ended").alias("ended"), F.sum("flow").alias("flow"))
    unary = written(nodes.where("out = 1 and into = 1 and ended = 0 and flow = 0").select("lang", "node", "edge"), "phrase-unary")
    heavy = five.where(F.col("n") >= least).withColumn("node", _head("gram", LONGEST - 1)).join(unary, ["lang", "node"], "left")
    state = written(heavy.select("lang", "gram", "n", F.coalesce("edge", "gram").alias("start"), F.when(F.col("edge").isNotNull(), 1).otherwise(0).cast("long").alias("far")), "phrase-pointers")
    total = None
    while True:
        now = state.agg(F.sum("far")).first()[0]
        if now == total:
            break
        total = now
        to = state.select("lang", F.col("gram").alias("start"), F.col("start").alias("next"), F.col("far").alias("more"))
        state = written(state.join(to, ["lang", "start"]).select("lang", "gram", "n", F.col("next").alias("start"), (F.col("far") + F.col("more")).alias("far")), "phrase-pointers")
    # a path is no longer than a text
    along = F.transform(F.array_sort(F.collect_list(F.struct("far", F.substring_index("gram", " ", -1).alias("w")))), lambda e: e["w"])
    whole = state.groupBy("lang", "start").agg(along.alias("along"), F.max("n").alias("n"))
    whole = whole.select("lang", F.concat(F.split(_head("start", LONGEST - 1), " "), "along").alias("words"), "n")
    return written(whole.unionByName(five.where(F.col("n") < least).select("lang", F.split("gram", " ").alias("words"), "n")), "phrase-paths")


def counts(found: DataFrame, whole: DataFrame) -> DataFrame:
    """``lang, phrase, k, f``: how often grams of two to five words occur in runs, from edges and paths. Grams of four words inside a path occur as often as it;
    others as often as edges flow out of them, with the runs that end with them."""
    windows = lambda k, trim: F.transform(F.sequence(F.lit(1 + trim), F.size("words") - k + 1 - trim), lambda i: F.array_join(F.slice("words", i, k), " "))
    five = whole.select("lang", F.explode(windows(LONGEST, 0)).alias("phrase"), F.col("n").alias("f"))
    inside = whole.where(F.size("words") > LONGEST).select("lang", F.explode(windows(LONGEST - 1, 1)).alias("phrase"), F.col("n").alias("f"))
    out = whole.select("lang", F.array_join(F.slice("words", 1, LONGEST - 1), " ").alias("phrase"), F.col("n").alias("f"))
    all_of = [five.withColumn("k", F.lit(LONGEST))]
    ended = lambda k: found.where(F.col("k") == k).select("lang", F.col("gram").alias("phrase"), F.col("n").alias("f"))
    summed = lambda rows: rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    four = written(summed(out.unionByName(ended(LONGEST - 1))).unionByName(inside), "phrase-counts")
    below = four
    all_of.append(four.withColumn("k", F.lit(LONGEST - 1)))
    for k in range(LONGEST - 2, 1, -1):
        below = written(summed(below.select("lang", _head("phrase", k).alias("phrase"), "f").unionByName(ended(k))), "phrase-counts")
        all_of.append(below.withColumn("k", F.lit(k)))
    rows = all_of[0]
    for more in all_of[1:]:
        rows = rows.unionByName(more)
    return rows


def phrases(docs: DataFrame, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", word_bits: int = WORD_BITS, pair_bits: int = PAIR_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: of each language the ``top`` phrases of two to five words that hold together best.

    A-Z are lower-cased; ``.,;:!?`` and line ends cut a text into pieces, spaces and tabs those into words. ``n`` are all words of a language, ``a`` the occurrences of a phrase, ``l`` and
    ``r`` those of its parts at the cut where ``1000 * a * n / (l * r)``, rounded down, is least, the first of equal ones. Phrases with under ``least`` occurrences are left out, and those inside a
    longer one that occurs as often. Ties go by more occurrences, then by the phrase's bytes. Null texts are empty, null languages are `und`; repeated rows count again; other columns
    and ids play no part. An empty table gives an empty one. Counts and the score are exact: products are decimals of 38 digits.
    """
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    words, found = edges(docs, least, word_bits, pair_bits)
    often = written(counts(found, paths(found, least)).where(F.col("f") >= least), "phrase-often")
    singles = words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    parts = written(often.select("lang", "phrase", "f").unionByName(singles), "phrase-parts")
    # what is inside a longer phrase of the same count is so inside one that is a word longer
    longer = often.where("k > 2").select("lang", "f", F.explode(F.expr("array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k))")).alias("phrase")).distinct()
    left = often.join(longer, ["lang", "phrase", "f"], "left_anti")
    cut = left.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("one"), F.expr("substring_index(phrase, ' ', cut - k)").alias("two"))
    both = cut.join(parts.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), ["lang", "one"]).join(parts.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r")), ["lang", "two"])
    both = both.join(F.broadcast(words.groupBy("lang").agg(F.sum("n").alias("n"))), "lang")  # a row for each language
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = both.withColumn("up", (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("down", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("up div down"))
    least_cut = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("best")).select("lang", "phrase", "best.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return least_cut.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
