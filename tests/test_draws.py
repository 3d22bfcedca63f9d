"""Draws of many seeds at once against the definition by MD5 and against the row expression."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from ledgerflow.functions import draws
from ledgerflow.functions.scalars import uniform


def expected(seed, key):
    return float(int(hashlib.md5((seed + key).encode()).hexdigest()[:15], 16)) / 2.0**60


def test_draws_equal_md5_for_keys_of_any_length():
    r = random.Random(5)
    seeds = ["0:0:mask", "12:3:radius", "s", "x" * 70, "é:1"]
    keys = ["", ":1", ":" + "x" * 46 + "é", ":" + "y" * 200] + [":" + "q" * r.randint(0, 130) for _ in range(60)]
    got = draws.all_hashed(seeds, pa.array(keys))
    assert got.tolist() == [[expected(s, k) for k in keys] for s in seeds]
    assert draws.all_hashed(seeds, pa.array(keys).slice(3, 9)).tolist() == [row[3:12] for row in got.tolist()]
    which, rows = np.array([4, 0, 2]), np.array([1, 1, 3])
    assert draws.hashed(seeds, pa.array(keys), which, rows).tolist() == [expected("é:1", ":1"), expected("0:0:mask", ":1"), expected("s", keys[3])]
    assert draws.all_hashed(seeds, pa.array([], pa.string())).shape == (5, 0)


def test_draws_equal_the_row_expression_with_missing_keys(spark):
    rows = [(1, "a"), (None, "b"), (3, None), (None, None), (-7, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    for r in df.select(draws.key_text("k", "t").alias("key"), uniform("9:2:pick", "k", "t").alias("u")).collect():
        assert draws.all_hashed(["9:2:pick"], pa.array([r["key"]]))[0, 0] == r["u"]
