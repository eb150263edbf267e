"""Operator 12 against full search, with the awkward cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import pytest

from riskloom.llm.vector_codes import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _id string, v int"


def brute(rows, parts, entries, rounds, scale=1024):
    """(id, code, error, label_error, sha) by measuring every distance."""
    kept = [(i, e, lab) for i, e, lab in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    kept = [(i, [math.floor(scale * x) for x in e], lab) for i, e, lab in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for c in cut:
                own[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else e for j, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = collections.Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] += e
    return collections.Counter((i, "".join(f"{j:02x}" for _, j in f), e, by[lab], sha) for (i, _, lab), f, e in zip(kept, found, errors, strict=True))


def rows_of(seed, n, size, grid):
    r = random.Random(seed)
    centres = [[r.choice(grid) for _ in range(size)] for _ in range(7)]
    return [(i, [x + r.choice(grid) / 8 for x in r.choice(centres)], r.choice([None, 1, 2])) for i in range(n)]


# A coarse grid makes many ties; a fine one hardly any; large values leave the floats.
@pytest.mark.parametrize("seed, grid, entries", [(1, [0.0, 0.001, -0.001], 12), (2, [-0.5, 0.25, 0.75, 0.1], 20), (3, [1000.0, -2000.0, 30000.0], 9)])
def test_codes(spark, seed, grid, entries):
    odd = [(None, [0.5] * 8, 1), (None, [0.25] * 8, None), (5, [0.1] * 8, 2), (5, [0.1] * 8, 2), (900, None, 1), (901, [], 1), (902, [float("nan")] + [0.0] * 7, 1), (903, [float("inf")] * 8, 1), (904, [None] + [0.0] * 7, 1), (905, [1.0] * 4, 1)]
    rows = rows_of(seed, 150, 8, grid) + odd
    frame = spark.createDataFrame([(i, e, lab, "c", "x", 1) for i, e, lab in rows], SCHEMA)
    stored = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    out, books = vector_codes(frame, parts=4, entries=entries, rounds=4)
    got = out.collect()
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute(stored, 4, entries, 4)
    assert books.shape == (4, entries, 2)
    assert sum(r.tried for r in got) < len(got) * 5 * 4 * entries  # some distances were never measured


def test_few_and_none(spark):
    frame = spark.createDataFrame([(1, [0.0, 1.0], 3, "", "", 0), (2, [0.5, 1.0], 3, "", "", 0)], SCHEMA)
    got = vector_codes(frame, parts=2)[0].collect()
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == brute([(1, [0.0, 1.0], 3), (2, [0.5, 1.0], 3)], 2, 256, 4)
    assert vector_codes(frame.limit(0))[0].count() == 0
    with pytest.raises(ValueError):
        vector_codes(frame)
