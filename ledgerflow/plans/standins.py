"""The given tables seen as ledgers, targets and panels, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.scalars import as_code, hash60, shard_of
from ledgerflow.schema import ColumnSpec, EventSchema

CATEGORIES = ("event_type", "event_subtype", "currency", "src_a", "src_b", "dst_a", "dst_b")
NUMERICS = ("amount", "balance")
LEDGER = EventSchema("client_id", "event_time", CATEGORIES, NUMERICS)
DOUBLE_CODES = ("event_type", "src_a", "src_b", "dst_b")
SPECS = [ColumnSpec(c, "categorical") for c in CATEGORIES] + [ColumnSpec(c, "numeric") for c in NUMERICS]
SLOTS = {
    "event_type": "col_2", "event_subtype": "col_3", "currency": "col_4", "src_a": "col_5",
    "src_b": "col_6", "dst_a": "col_7", "dst_b": "col_8", "amount": "col_11", "balance": "col_12",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named ledger with integer-like codes stored as DOUBLE and with missing values."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("client_id"),
        (F.col("l_shipdate") + F.make_dt_interval(hours=F.pmod("l_partkey", F.lit(24)).cast("int"))).alias("event_time"),
        F.when(F.col("l_discount") == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("amount"),
        F.col("o_totalprice").alias("balance"),
        F.col("l_quantity").alias("event_type"),
        F.col("l_linenumber").cast("bigint").alias("event_subtype"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.substring("o_orderpriority", 1, 1).cast("bigint")).alias("currency"),
        F.when(F.col("l_tax") > 0, F.col("l_tax") * 100).alias("src_a"),
        (F.col("l_discount") * 100).alias("src_b"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).cast("bigint").alias("dst_a"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 2.0).alias("dst_b"),
        F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"),
    )


RAW_SQL = """raw AS (
  SELECT o_custkey AS client_id, l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS event_time,
    CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE l_extendedprice END AS amount, o_totalprice AS balance,
    l_quantity AS event_type, CAST(l_linenumber AS BIGINT) AS event_subtype,
    CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(substr(o_orderpriority, 1, 1) AS BIGINT) END AS currency,
    CASE WHEN l_tax > 0 THEN l_tax * 100 END AS src_a, l_discount * 100 AS src_b,
    CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS dst_a,
    CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 2.0::DOUBLE END AS dst_b,
    l_orderkey, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger with all codes as BIGINT."""
    raw = raw_ledger(spark, sf_dir)
    return raw.select(
        "client_id", "event_time",
        *[(as_code(c) if c in DOUBLE_CODES else F.col(c)).alias(c) for c in CATEGORIES], *NUMERICS,
    )


LEDGER_SQL = RAW_SQL + """,
led AS (
  SELECT client_id, event_time, CAST(round_even(event_type, 0) AS BIGINT) AS event_type, event_subtype, currency,
    CAST(round_even(src_a, 0) AS BIGINT) AS src_a, CAST(round_even(src_b, 0) AS BIGINT) AS src_b, dst_a,
    CAST(round_even(dst_b, 0) AS BIGINT) AS dst_b, amount, balance
  FROM raw)"""

FEATURES_DESC = ", ".join(f"{c} DESC NULLS LAST" for c in ("event_time", *LEDGER.features))
FEATURES_ASC = ", ".join(f"{c} ASC NULLS FIRST" for c in ("event_time", *LEDGER.features))
MAX_EVENTS = 500


def capped_sql(n: int = MAX_EVENTS) -> str:
    return LEDGER_SQL + f""",
cap AS (SELECT * FROM led QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY {FEATURES_DESC}) <= {n})"""


def sql_hash(seed: str, *cols: str) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 15)) AS BIGINT)"


def sql_uniform(seed: str, *cols: str) -> str:
    return f"(CAST({sql_hash(seed, *cols)} AS DOUBLE) / 1152921504606846976.0::DOUBLE)"


def sql_shard(n: int, *cols: str, seed: str = "shard") -> str:
    return f"CAST({sql_hash(seed, *cols)} % {n} AS INTEGER)"


def fold(client: str | Column) -> Column:
    return shard_of(5, client, seed="fold")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, month, y1, y2, y3, fold) from the orders of each customer and month."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(
        F.col("o_custkey").alias("id"), F.trunc("o_orderdate", "MM").alias("month")
    ).agg(
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("y1"),
        F.max((F.col("o_totalprice") > 300000).cast("int")).alias("y2"),
        F.max((F.col("o_orderstatus") == "F").cast("int")).alias("y3"),
    ).withColumn("fold", fold("id"))


TARGETS_SQL = f"""tgt AS (
  SELECT *, {sql_shard(5, 'id', seed='fold')} AS fold FROM (
    SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
      max(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS y1, max(CAST(o_totalprice > 300000 AS INTEGER)) AS y2,
      max(CAST(o_orderstatus = 'F' AS INTEGER)) AS y3
    FROM orders GROUP BY 1, 2))"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, date, emb): the vectors, with the label as month."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.add_months(F.lit("1997-01-01").cast("date"), F.col("label")).alias("date"),
        F.col("embedding").alias("emb"),
    )


PANEL_SQL = """pan AS (
  SELECT vec_id AS id, CAST(DATE '1997-01-01' + to_months(label) AS DATE) AS date, embedding AS emb FROM embeddings)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, model, y, score): labelled documents with a tied and a hashed score."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    y = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    base = d.join(y, "doc_id")
    tied = base.select("doc_id", "lang", F.lit("tied").alias("model"), "y", (F.pmod("n_chars", F.lit(97)) / F.lit(97.0)).alias("score"))
    fine = base.select("doc_id", "lang", F.lit("fine").alias("model"), "y", (hash60("score", "doc_id") / F.lit(float(2**60))).alias("score"))
    return tied.unionByName(fine)


SCORES_SQL = f"""base AS (SELECT doc_id, n_chars, lang, quality AS y FROM documents JOIN labels USING (doc_id)),
sc AS (
  SELECT doc_id, lang, 'tied' AS model, y, CAST(n_chars % 97 AS DOUBLE) / 97.0::DOUBLE AS score FROM base
  UNION ALL SELECT doc_id, lang, 'fine', y, {sql_uniform('score', 'doc_id')} FROM base)"""
