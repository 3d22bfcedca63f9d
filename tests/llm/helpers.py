"""Brute-force versions and small tables for the tests of this folder."""

import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")
SMALL = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def texts_frame(spark, texts, extra=True):
    """Documents with ids from 1, and columns whose names the operators use inside."""
    rows = [(i, t, 1, b"x", 2.0) for i, t in enumerate(texts, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, chunk int, data binary, score double")
    return frame if extra else frame.select("doc_id", "text")


def odd_texts():
    line = " ".join(f"w{i}" for i in range(60))
    return [None, "", " \t\n", "one", line, "x " + line, line, "a " * 200, "z" * 3000, "é漢😀 " * 30, line + " tail", "The the of and", "1.2.3.4 a@b.c"]


def covered_bytes(texts, length):
    """Per text which bytes an earlier string of that length covers."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        out.append(gone)
    return out


def covered_words(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((w, gone))
    return out
