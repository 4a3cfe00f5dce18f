"""The registered queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import ann, collocations, ctw, decontaminate, html, minhash, negatives, packing, pii, quality, shards, simhash
from pixelweave.llm.common import fresh_path, table
from pixelweave.llm.tokens import vocabulary


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = shards.TokenStore.write(docs, vocabulary("byte_bpe_50k.json"), end=2)
    return store.read(shards.keys_of(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(pii.BASE), 256).alias("base_sha256"), pii.listed(pii.BASE + pii.SCORED).alias("spans"))


#: Not an id of the vocabulary, so a text can't hold it.
FLAT_END = 50_257


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "flat-tokens")
    order = shards.write_flat(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), FLAT_END, folder)
    found = shards.scan_counts(spark, folder, FLAT_END, "<u2")
    return order.join(found, ["shard", "ordinal"]).select("doc_id", "shard", "ordinal", "start", "n_tokens")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.vectors(table(spark, sf_dir, "embeddings"), label=label), F.col("vec_id") % 50 == 0)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_store, op3_packing, op4_ann, op5_html, op6_simhash, op7_quality, op8_ctw, op9_pii, op10_token_counts, op11_hard_negatives, op12_minhash, op13_phrases)}
