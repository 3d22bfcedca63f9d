"""The queries of this subpackage over the given tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import chat, divergence, near_dedup, neighbours, packing, personal, pieces, quality, repair, spotsigs, suffix_dedup, warc, window_dedup
from ledgerflow.llm.registry import query


def tokenizer_file(name: str) -> str:
    """Where the installed tokenizer files lie; the same on every machine."""
    return importlib.import_module("public_tokenizers").path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op7_sentencepiece_round_trip")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, what they decode to, and where in the text they come from."""
    e = pieces.encode_text(F.coalesce("text", F.lit("")), tokenizer_file("piece_bpe_32k.model"))
    return documents(spark, sf_dir).select("doc_id", e.alias("e")).select(
        "doc_id", F.col("e.n").alias("n_tokens"), F.sha2("e.ids", 256).alias("ids_sha256"),
        F.sha2("e.decoded", 256).alias("decoded_sha256"), F.col("e.spans_sha256").alias("spans_sha256"),
    )


@query("op9_bin_completion_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    cut = packing.cut_pieces(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), 4096, 1, keep_ids=False)
    return packing.pack(cut, 4096).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op10_compression_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of good quality of every document, learnt outside fold 0."""
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = docs.select(
        "doc_id", (quality.in_fold(F.col("doc_id")) == 0).alias("held_out"), quality.score(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text that strings of 100 bytes which start earlier cover, and the rest."""
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), 100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op8_window_doubling")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text that a repeated window of 35 words covers, and the rest."""
    return window_dedup.remove_repeated_windows(documents(spark, sf_dir), 35).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op6_multiprobe_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return neighbours.nearest(rows.filter(F.col("id") % 20 == 0), rows, 20)


@query("op2_perspective_rotation", chat.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side, turn by turn, with masks."""
    return chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op4_hyperminhash_near_dedup", near_dedup.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query("op5_bootstrapped_personal_data")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: base counts and digest, and all spans."""
    found = personal.find_personal(documents(spark, sf_dir))
    counts = [personal.counted(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(personal.KINDS)]
    return found.select("doc_id", *counts, F.sha2(personal.listed(F.col("base")), 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans"))


@query("op3_spot_signatures")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every text, of its edited form, and likeness to that and to the next one."""
    rows = spotsigs.compared(documents(spark, sf_dir))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("signatures")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


@query("op11_warc_round_trip", warc.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to web archives and what a sequential reader finds there."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op12_conversation_repair", repair.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return repair.damage_and_repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op13_source_divergence_audit", divergence.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark each source."""
    return divergence.audit(documents(spark, sf_dir))
