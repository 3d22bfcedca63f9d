"""Noisy copies packed into codes: the same passports and dependences as those of the columns themselves."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import noise as N
from ledgerflow.operators import profile as P
from ledgerflow.operators import sweep as W
from ledgerflow.schema import ColumnSpec
from ledgerflow.sources.readers import materialise

SPECS = [ColumnSpec("kind", "categorical"), ColumnSpec("value", "numeric"), ColumnSpec("code", "categorical"), ColumnSpec("one", "categorical"), ColumnSpec("none", "categorical"), ColumnSpec("size", "numeric")]


@pytest.fixture(scope="module")
def ledger(spark):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        kind = rng.choice("abcdefg")
        code = rng.choice([None, float("nan"), 1.0, 2.0, 3.0]) if k % 9 == 0 else float(ord(kind) % 3)
        value = rng.choice([None, float("inf"), 0.0]) if k % 11 == 0 else rng.lognormvariate(1, 1)
        rows.append((k, kind, value, code, "same", None, rng.randint(1, 500)))
    return materialise(spark.createDataFrame(rows, "key long, kind string, value double, code double, one string, none string, size long"))


def rounded(row):
    cells = row.asDict().items()
    return {k: round(v, 12) if isinstance(v, float) else [round(x, 12) for x in v] if isinstance(v, list) else v for k, v in cells}


def found(passports, dependences):
    """Sums are taken in another order, so the last digits may differ."""
    rows = [{r["column"]: rounded(r) for r in passports.collect()}, {(r["left"], r["right"]): rounded(r) for r in dependences.collect()}]
    assert all(rows)
    return rows


@pytest.mark.parametrize("arrays, dense", [(1024, True), (3, True), (3, False)])
def test_packed_copies_have_the_passports_and_dependences_of_columns(ledger, monkeypatch, arrays, dense):
    monkeypatch.setattr(N, "ARRAY_VALUES", arrays)
    if not dense:
        monkeypatch.setattr(N, "code_type", lambda most: "<u4")
    cases = W.sweep_cases(["clean", "mixed_030", "categorical_015"], [1, 2])
    clean = P.matching_source(ledger, SPECS)[0]
    wide, own = N.corrupt_variants(ledger, SPECS, clean, cases, ["key"])
    table, same = N.packed_variants(ledger, SPECS, clean, cases, ["key"])
    assert same == own and table.rows.columns == ["codes", "values"]  # not a column per copy
    kinds = {own[c[0], s.name]: s.kind for c in cases for s in SPECS}
    pairs = list(dict.fromkeys((own[c[0], a.name], own[c[0], b.name]) for c in cases for i, a in enumerate(SPECS) for b in SPECS[i + 1:]))
    want = found(*P.matching_source(materialise(wide), [ColumnSpec(c, k) for c, k in kinds.items()], pairs=pairs, max_categories=5))
    assert found(*P.packed_source(table.materialised(), pairs, max_categories=5)) == want


def test_packed_numbers_or_categories_alone_and_no_rows(ledger):
    cases = W.sweep_cases(["mixed_015"], [1])
    for kind, rows in (("numeric", ledger), ("categorical", ledger), ("numeric", ledger.limit(0))):
        specs = [s for s in SPECS if s.kind == kind]
        clean = P.matching_source(ledger, specs)[0]
        table, own = N.packed_variants(rows, specs, clean, cases, ["key"])
        assert table.rows.count() == rows.count() and len(own) == len(specs)


def test_packed_noise_that_overflows_raises(ledger):
    clean = P.matching_source(ledger.where(F.col("value").isNotNull()), SPECS)[0]
    with pytest.raises(Exception, match="overflows in"):
        N.packed_variants(ledger, SPECS, clean, [("big", 1e308, 0.0, 4)], ["key"])[0].rows.collect()
