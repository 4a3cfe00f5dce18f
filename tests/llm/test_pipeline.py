"""The corpus pipeline on a small corpus: each stage's decisions take effect, clean documents stay."""

import random

import pyarrow as pa
from pyspark.sql import functions as F


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = words(40, 1)
    rows = [(i, words(80, 100 + i)) for i in range(120)]
    junk = [(200 + i, " ".join(w.upper() + "!!" for w in words(8, i).split()) * 6) for i in range(60)]
    rows += [(300, rows[0][1]), (301, words(50, 2) + " " + item + " " + words(9, 3)), (302, words(60, 4) + " mail a.b@c.example now")] + junk
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r[0] for r in at.select("doc_id").collect()}
    clean = set(range(120)) | {302}
    assert seen["quality"] >= clean | {300, 301} and not seen["quality"] & set(range(200, 260))
    assert seen["quality"] - seen["near-duplicates"] == {300}
    assert seen["near-duplicates"] - seen["decontamination"] == {301}
    masked = spark.read.parquet(f"{tmp_path}/personal data").where("doc_id = 302").first()
    assert masked["text"].endswith("mail [EMAIL] now") and masked["n_chars"] == len(masked["text"])
    assert seen["packing"] == clean
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first() == at.agg(F.sum("length")).first()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, columns named like those that the operators use themselves, empty tables."""
    import corpus_pipeline

    long = words(20_000, 5)
    rows = [(1, words(60, 2)), (1, words(60, 2)), (2, words(60, 2)), (3, None), (4, ""), (5, " \n "), (None, words(60, 7)), (None, words(60, 7)), (None, None), (6, long), (7, words(40, 9)), (None, words(40, 9)), (8, "mail a.b@c.example"), (8, "other")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int, node string, key string, block long, kind string"
    docs = spark.createDataFrame([(i, t, None, None, None, None, "n", None, 1, "k") for i, t in rows], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, words(40, 9)), (None, "x"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, at, none = {}, docs, docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        at, none = stage(spark, at, str(tmp_path)), stage(spark, none, str(tmp_path))
        last = name == corpus_pipeline.STAGES[-1][0]
        assert none.count() == 0 and (last or at.columns == docs.columns == none.columns)
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at.count() if last else sorted(((r[0] or 0, r[1]) for r in at.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1] or ""))
    assert len(seen["quality"]) == len(rows)
    assert seen["near-duplicates"] == sorted([(1, words(60, 2)), (3, None), (0, words(60, 7)), (6, long), (7, words(40, 9)), (8, "mail a.b@c.example"), (8, "other")], key=lambda r: (r[0], r[1] or ""))
    assert seen["decontamination"] == [r for r in seen["near-duplicates"] if r[0] != 7]
    assert (8, "mail [EMAIL]") in seen["personal data"] and len(seen["personal data"]) == 6
    assert seen["packing"] >= 6


def test_stages_give_python_small_batches(spark):
    import corpus_pipeline
    from pixelweave.llm import common

    keys = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(k).rstrip("b") for k in keys]
    lengths = lambda batches: (pa.RecordBatch.from_pydict({"rows": [len(b)], "bytes": [b.nbytes]}) for b in batches)
    docs = spark.range(0, 5000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 4000).alias("text"))
    try:
        assert docs.mapInArrow(lengths, "rows long, bytes long").agg(F.max("bytes")).first()[0] > 8 * common.BATCH_BYTES
        corpus_pipeline.keep_good(spark, docs.limit(3), "/root/testdata/sf0.001")
        seen = docs.mapInArrow(lengths, "rows long, bytes long").agg(F.max("rows"), F.max("bytes"), F.sum("rows")).first()
        assert seen[0] <= common.BATCH_ROWS and seen[1] < 2 * common.BATCH_BYTES and seen[2] == 5000
        spark.conf.set(keys[0], "10")
        common.small_batches(spark)
        assert spark.conf.get(keys[0]) == "10"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
