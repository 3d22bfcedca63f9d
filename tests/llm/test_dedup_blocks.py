"""Suffix-array dedup: hashes worked out in blocks, and only what may repeat is sorted."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerflow.llm import chunks, suffix_dedup


@pytest.mark.parametrize("size", [0, 1, 31, 32, 100, chunks.BLOCK + 31, 2 * chunks.BLOCK + 5])
def test_hashes_in_blocks_equal_their_definition(size):
    values = np.random.default_rng(size).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(3)
    for width in (1, 5, 32):
        n = max(0, size - width + 1)
        expected, least = np.zeros(n, np.uint64), values[:n].copy()
        for i in range(width):
            expected = expected * np.uint64(chunks.FACTOR) + values[i : i + n]
            least = np.minimum(least, values[i : i + n])
        assert np.array_equal(chunks.rolling(values, width, chunks.FACTOR), expected)
        assert np.array_equal(chunks.sliding(values, width), least)
    assert len(np.unique(chunks.mix(values))) == len(np.unique(values))


def test_only_runs_with_repeated_strings_are_sorted(monkeypatch):
    rng = np.random.default_rng(3)
    sorted_bytes = []
    sort = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text, depth: sorted_bytes.append(len(text)) or sort(text, depth))
    texts = [bytes(rng.integers(97, 123, 149, dtype=np.uint8)) for _ in range(40)]
    size = np.full(40, 50)
    doc, start = np.arange(40) + 1, np.arange(40) * 3
    assert not suffix_dedup._first_marks(texts, doc, start, size, 100).any() and not sorted_bytes
    # strings 0..9 of run 7 come again as 40..49 of run 3, a smaller document; 30 bytes four times inside run 20 are too short to count
    texts[3] = texts[3][:40] + texts[7][:109]
    texts[20] = texts[20][:30] * 2 + texts[20][60:110] + texts[20][:39]
    marks = suffix_dedup._first_marks(texts, doc, start, size, 100)
    assert marks[7] == (1 << 10) - 1 and marks.sum() == marks[7]
    assert sorted_bytes == [300]


def test_strings_that_repeat_inside_a_run_are_marked():
    text = bytes([97]) * 120
    marks = suffix_dedup._first_marks([text], np.array([1]), np.array([0]), np.array([21]), 100)
    assert marks[0] == (1 << 21) - 2
