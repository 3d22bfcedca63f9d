"""A training corpus from the documents table: five stages, each over all that the one before
kept. What a stage returns is written as Parquet in the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import members, near_dedup, packing, personal, quality, suffix_dedup
from ledgerflow.llm.queries import tokenizer_file
from ledgerflow.sources.readers import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
THRESHOLD = 0.3
CAPACITY = 4096


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality reaches the threshold. The score is learnt
    from the labelled ones among them outside fold 0. With no label every document stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, quality.training_labels(labels))
    return docs.select(*COLUMNS, quality.score(F.col("text"), model).alias("probability")).filter(
        F.col("probability") >= THRESHOLD
    ).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Of rows that
    share an id one stays. Documents without words or without an id all stay."""
    groups = near_dedup.near_duplicates(docs).filter(F.col("doc_id").isNotNull())
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("stays"))
    special = materialise(ids.filter(~F.col("stays") | (F.col("rows") > 1)).select("doc_id", "stays"))
    # only texts of ids that go or repeat are exchanged, not those of the many that stay
    own = members.marked(docs.select(*COLUMNS), special)
    asked = own.filter("maybe").select(*COLUMNS)
    other = asked.join(special.select("doc_id"), "doc_id", "left_anti")
    several = asked.join(special.filter("stays").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return own.filter(~F.col("maybe")).select(*COLUMNS).unionByName(other).unionByName(several).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a string of 100 bytes which starts earlier covers. What a cut
    leaves of a character goes too, and n_chars counts what is left. Documents of which
    nothing is left stay, empty."""
    own = docs.withColumn("absent", F.col("text").isNull())
    out = suffix_dedup.remove_repeats(own, 100, carry=("absent", "lang", "source", "n_chars"), characters=True)
    return out.withColumn("text", F.when(~F.col("carry.absent"), F.col("kept").cast("string"))).select(
        "doc_id", "text", "carry.lang", "carry.source",
        F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("carry.n_chars")).alias("n_chars"),
    )


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars counts the new text."""
    found = personal.find_personal(docs).filter(F.size("spans") > 0).select(
        F.col("doc_id").alias("d"), F.col("h").alias("hh"), "spans"
    ).dropDuplicates(["d", "hh"])
    own = docs.select(*COLUMNS).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = own.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("hh")), "left")
    hit = F.col("spans").isNotNull()
    text = F.when(hit, personal.masked(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return joined.withColumn("masked", text).select(
        "doc_id", F.col("masked").alias("text"), "lang", "source",
        F.when(hit, F.length("masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 4096 tokens and their places in sequences."""
    pieces = packing.cut_pieces(docs, tokenizer_file("word_bpe_49k.json"), CAPACITY, 1, keep_ids=False)
    return packing.pack(pieces, CAPACITY).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

#: Learnt scores and the packing can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
