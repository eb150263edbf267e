"""Operator 13 against brute force over all windows."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from riskloom.llm.suffix_trees import deep, subtree, without_passages

SCHEMA = "doc_id long, text string, key string, slice int, kept string"
ODD = [None, "", " \n\t", "a", "a  b\x0bc\x0cd\re", " same words here again ", "same words here again", "same  words here again", "x\x85y\xa0z x\x85y\xa0z x\x85y\xa0z", "a a a a a a a a a a a a", "ünï 日本語 😀 ünï 日本語 😀 ünï"]


def brute(rows, length):
    """Every document's words, of which go those that a window covers that starts anywhere else too."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return collections.Counter(out)


def mixed(seed, n):
    """Texts of few words that share passages, with copies and near copies."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(4, 40))] for _ in range(6)]
    out = []
    for _ in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(passages)
        out.append(" ".join(w))
        if r.random() < 0.2:
            out.append(out[r.randrange(len(out))])
    return out


@pytest.mark.parametrize(
    "seed, length, options",
    [(1, 8, {"prefix": 3}), (2, 8, {"prefix": 3, "memory": 4, "bucket": 40, "slice_": 600}), (3, 5, {"prefix": 4, "memory": 1, "slice_": 300}), (4, 6, {"prefix": 9, "bucket": 10}), (5, 1, {"prefix": 1}), (6, 12, {"prefix": 1, "memory": 30, "bucket": 100})],
)
def test_against_brute_force(spark, seed, length, options):
    texts = ODD + mixed(seed, 120)
    rows = [(i, t, "k", 1, "x") for i, t in enumerate(texts)]
    rows += [rows[5], rows[20], rows[20], (None, texts[20], None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    if length == 1:
        docs = docs.where("doc_id < 40 or doc_id is null")
    got = collections.Counter(map(tuple, without_passages(docs, length, **options).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], length)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = collections.Counter(map(tuple, without_passages(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 35)
    assert without_passages(docs.limit(0)).count() == 0


def test_subtree():
    """Inner nodes over sorted leaves: words that neighbours of one group share."""
    def record(name, words, weight):
        return np.frombuffer(name.to_bytes(8, "big") + b"".join(w.to_bytes(4, "big") for w in words) + bytes([weight]), np.uint8)

    records = np.stack([record(7, [1, 2, 3], 1), record(9, [1, 2, 3], 1), record(7, [1, 2, 4], 1), record(7, [1, 2, 3], 1), record(8, [5, 5, 5], 2)])
    order, depth = subtree(records, 10)
    assert [[0, 3], [2], [4], [1]] == [sorted(order[:2].tolist()), [order[2]], [order[3]], [order[4]]]
    assert depth.tolist() == [13, 12, 0, 0]
    assert deep(records, 10, 13).tolist() == [True, False, False, True, True]
    assert deep(records, 10, 12).tolist() == [True, False, True, True, True]
