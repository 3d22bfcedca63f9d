"""Rows whose id is in a table of ids, told from most others before anything is exchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 32  # per id; about 3 % of the other rows are taken for members
MOST_BITS = 1 << 26  # 8 MB; a fuller map takes more rows for members, so that more are exchanged


def marked(rows: DataFrame, ids: DataFrame, name: str = "maybe") -> DataFrame:
    """Rows (doc_id, ...) with a boolean ``name``: true for every row whose doc_id is in ``ids``
    (doc_id), and for a few others, which a join has to tell apart; false for null ids.

    The ids are hashed to a bitmap of a bounded size, which is broadcast in blocks of 4 KB. So a
    join with a part of the rows exchanges that part, however many rows and ids there are.
    ``ids`` is read twice and should be a table."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    block, position = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    known = ids.filter(F.col("doc_id").isNotNull()).select(block.alias("_block"), position.alias("_position"))
    # by block first: partial maps of every task would be more than the ids
    maps = known.repartition("_block").groupBy("_block").agg(F.bitmap_construct_agg("_position").alias("_map"))
    byte = F.col("_map").substr((F.floor(position / 8) + 1).cast("int"), F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int")) == 1
    joined = rows.withColumn("_of", block).join(F.broadcast(maps), F.col("_of") == F.col("_block"), "left")
    return joined.withColumn(name, F.coalesce(F.col("doc_id").isNotNull() & bit, F.lit(False))).drop("_of", "_block", "_map")
