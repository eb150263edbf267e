"""YAML as rows against the structures that were written, and rules and results read from it."""

from __future__ import annotations

import json
import random

from riskloom.sources import yamlfiles

TEXT = """---
# c
sources:
  - kind: call   # note
    method: "<a.B: java.lang.String get(java.lang.String)>"
  - kind: 'x # y'
    args: [a, "b, c", {k: v, l: [1, 2]}]
sinks:
- method: m
  deep:
    - - p
      - q
    - r
-   method: n
text: |
  one
    two
folded: >-
  a
  b
last: {a: 1, b: {c: 2}}
url: http://x:80/y
empty:
none: []
"""


def test_scalars():
    assert list(yamlfiles.scalars(TEXT)) == [
        (("sources", "0", "kind"), "call"), (("sources", "0", "method"), "<a.B: java.lang.String get(java.lang.String)>"), (("sources", "1", "kind"), "x # y"), (("sources", "1", "args", "0"), "a"),
        (("sources", "1", "args", "1"), "b, c"), (("sources", "1", "args", "2", "k"), "v"), (("sources", "1", "args", "2", "l", "0"), "1"), (("sources", "1", "args", "2", "l", "1"), "2"), (("sinks", "0", "method"), "m"),
        (("sinks", "0", "deep", "0", "0"), "p"), (("sinks", "0", "deep", "0", "1"), "q"), (("sinks", "0", "deep", "1"), "r"), (("sinks", "1", "method"), "n"), (("text",), "one\ntwo"), (("folded",), "a b"),
        (("last", "a"), "1"), (("last", "b", "c"), "2"), (("url",), "http://x:80/y"),
    ]
    assert list(yamlfiles.scalars(None)) == list(yamlfiles.scalars("")) == list(yamlfiles.scalars("# only\n---\n")) == []


def written(x, indent, r):
    """A structure as block YAML, now and then with a flow collection; quoted where plain text would be read otherwise."""
    pad = " " * indent
    if isinstance(x, dict):
        return "".join(f"{pad}{k}:{tail(v, indent + 2, r)}" for k, v in x.items())
    return "".join(f"{pad}-{tail(v, indent + 2, r)}" for v in x)


def tail(v, indent, r):
    if isinstance(v, str):
        return f" {json.dumps(v) if r.random() < 0.5 or any(c in v for c in ':#,[]{}') else v}\n"
    if r.random() < 0.2:
        return f" {json.dumps(v)}  # flow\n"
    return "\n" + written(v, indent, r)


def leaves(x, path=()):
    if isinstance(x, str):
        return [(path, x)]
    return [leaf for k, v in (x.items() if isinstance(x, dict) else enumerate(x)) for leaf in leaves(v, (*path, str(k)))]


def test_what_was_written_is_read():
    for seed in range(200):
        r = random.Random(seed)

        def made(depth, r=r):
            kind = r.randrange(3) if depth else 2
            if kind == 0:
                return {f"k{i}": made(depth - 1) for i in range(r.randint(1, 3))}
            if kind == 1:
                return [made(depth - 1) for _ in range(r.randint(1, 3))]
            return r.choice(["plain", "two words", "a: b", "x # y", "<p.Q: void f(int,int)>", "[1, 2]", "{z}", "it's", "3"])

        x = {"top": made(4), "more": [made(3), made(2)]}
        assert list(yamlfiles.scalars(written(x, 0, r))) == leaves(x), written(x, 0, random.Random(seed))


def test_points_to_statistics(spark):
    texts = [
        ("a", "pointsTo:\n- pointer: x\n  pointsTo:\n  - allocation: s1\n  - alloc: s2\n- pointer: y\n  pts: []\n- pointer: z\n  pts:\n  - obj: {allocation: s1}\n  - other: s9\n"),
        ("b", "deep:\n  list:\n  - points-to:\n    - points_to: [{alloc: q}]\n"), ("c", "x: 1\n"), ("d", None),
    ]
    rows = yamlfiles.values(spark.createDataFrame(texts, "file_id string, code string"))
    assert {tuple(r) for r in yamlfiles.points_to_statistics(rows).collect()} == {("a", 2, 2), ("b", 1, 1)}
