"""YAML files as rows of paths and values, and what rule files and analysis results hold.

A file is one Arrow value.  Its lines are taken in order with a stack of the open keys and list places by indentation; each scalar
is a row (file_id, place, path, value), path the keys and list places down to it.  Read are block and flow collections, plain
and quoted scalars, block scalars (without their indentation) and comments; anchors and tags stay text.  An empty or null file has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "file_id string, place int, path array<string>, value string"
_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#\[\]{},"'][^#]*?|[^\s#\[\]{},"']):(?=\s|$)\s*""")
_FLOW = re.compile(r"""\s*([\[\]{},]|"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\[\]{},:"'\s][^\[\]{},:]*|:)""")


def _plain(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    return text[1:-1].replace("''", "'") if len(text) > 1 and text[0] == text[-1] == "'" else text


def _uncommented(line: str) -> str:
    """The line without a comment that stands outside of quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and (quote == "'" or line[i - 1] != "\\") else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " [{,:-"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def _flow(text: str, path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str]]:
    """The scalars of a flow collection on one line."""
    marks, stack, key = _FLOW.findall(text), [], None
    for i, m in enumerate(marks):
        if m in "[{":
            stack.append([m, 0, key])
            key = None
        elif m in "]}":
            if stack:
                stack.pop()
            key = None
        elif m == ",":
            if stack:
                stack[-1][1] += 1
            key = None
        elif m == ":":
            continue
        elif stack and stack[-1][0] == "{" and marks[i + 1 : i + 2] == [":"] and key is None:
            key = _plain(m)
        else:
            inner = [x for level, (_, _, k) in enumerate(stack) for x in ([] if level == 0 else [str(stack[level - 1][1])] if stack[level - 1][0] == "[" else [k or ""])]
            yield (*path, *inner, key if stack and stack[-1][0] == "{" else str(stack[-1][1]) if stack else ""), _plain(m)


def scalars(text: str | None) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path, value) of every scalar of a file, in order."""
    stack: list[list] = []  # [indent, key or place, whether a list]
    lines, i = (text or "").split("\n"), 0
    while i < len(lines):
        line = _uncommented(lines[i].rstrip("\r"))
        i += 1
        rest = line.strip()
        if not rest or rest in ("---", "...") or rest.startswith("%"):
            continue
        indent = len(line) - len(line.lstrip(" "))
        while True:
            if rest == "-" or rest.startswith("- "):
                while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and not stack[-1][2] and any(s[2] and s[0] == indent for s in stack[:-1]))):
                    stack.pop()
                if stack and stack[-1][2] and stack[-1][0] == indent:
                    stack[-1][1] += 1
                else:
                    stack.append([indent, 0, True])
                inner = rest[1:].lstrip()
                indent += len(rest) - len(inner)
                rest = inner
                if rest:
                    continue
                break
            m = _KEY.match(rest)
            if m:
                while stack and (stack[-1][0] > indent or (stack[-1][0] == indent)):
                    stack.pop()
                stack.append([indent, _plain(m[1]), False])
                rest = rest[m.end() :].strip()
            break
        path = tuple(str(s[1]) for s in stack)
        if not rest:
            continue
        if re.fullmatch(r"[|>][+-]?\d*", rest):
            held = []
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip(" ")) > stack[-1][0]):
                held.append(lines[i].strip())
                i += 1
            yield path, ("\n" if rest[0] == "|" else " ").join(held).strip()
        elif rest[0] in "[{":
            yield from _flow(rest, path)
        else:
            yield path, _plain(rest)


def values(files: DataFrame, id_: str = "file_id", text: str = "code") -> DataFrame:
    """The scalars of files, a whole file in each row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("file_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = list(scalars(body))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array([p for p, _ in rows], pa.list_(pa.string())), pa.array([v for _, v in rows], pa.string())], names=["file_id", "place", "path", "value"])

    return files.select(F.col(id_).cast("string").alias("file_id"), F.col(text).alias("text")).mapInArrow(read, SCHEMA)


def taint_rules(rows: DataFrame) -> DataFrame:
    """(file_id, section, entry, kind, class, method, arity, index, from, to) of the sources, sinks, transfers and sanitizers of rule files."""
    p = F.col("path")
    own = rows.where((F.size(p) == 3) & p[0].isin("sources", "sinks", "transfers", "sanitizers"))
    of = lambda key: F.max(F.when(p[2] == key, F.col("value")))
    told = own.groupBy("file_id", p[0].alias("section"), p[1].cast("int").alias("entry")).agg(*[of(k).alias(k) for k in ("kind", "method", "index", "from", "to")])
    signature = r"^<([^:]+): \S+ ([^(]+)\(([^)]*)\)>$"
    part = lambda i: F.regexp_extract("method", signature, i)
    return told.select("file_id", "section", "entry", "kind", part(1).alias("class"), part(2).alias("method"), F.when(part(3) == "", 0).otherwise(F.size(F.split(part(3), ","))).alias("arity"), "index", "from", "to")


POINTS, OBJECTS, ALLOCATIONS = ("pointsTo", "points-to", "points_to"), ("pointsTo", "points-to", "points_to", "pts"), ("allocation", "alloc")


def _first(path: Column, names: tuple[str, ...], start: Column | int = 0) -> Column:
    """The place in path, from start, of the first of the names; -1 without one."""
    hit = F.transform(path, lambda x, i: F.when((i >= start) & x.isin(*names), i))
    return F.coalesce(F.array_min(hit), F.lit(-1))


def points_to_statistics(rows: DataFrame) -> DataFrame:
    """(file_id, pointers, sites) of analysis results: entries whose points-to list isn't empty, and different allocations in them."""
    p = F.col("path")
    found = rows.withColumn("a", _first(p, POINTS)).where("a >= 0").withColumn("b", _first(p, OBJECTS, F.col("a") + 2)).where("b >= 0 and size(path) > b + 1")
    entry = F.array_join(F.slice(p, 1, F.col("a") + 2), "/")
    inner = F.slice(p, F.col("b") + 3, F.size(p))
    site = (F.size(inner) == 1) & inner[0].isin(*ALLOCATIONS) | (F.size(inner) == 2) & (inner[0] == "obj") & F.element_at(inner, -1).isin(*ALLOCATIONS)
    return found.groupBy("file_id").agg(F.count_distinct(entry).alias("pointers"), F.count_distinct(F.when(site, F.col("value"))).alias("sites"))
