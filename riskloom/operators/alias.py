"""Alias facts from code: what is allocated, copied, stored and loaded, who may point where, and answers about pairs.

Facts come from each file's syntax tree in one Arrow pass, (file_id, fact, line, target, source, field, detail):
`allocate` (target is made at the line, detail its type or the call that made it), `allocate_via` (the same through a cast or ternary), `copy` (target = source), `load` (target =
source.field), `store` (target.field = source) and `access` (source.field is read or written; no call).  Casts are looked through, and both
ends of a ternary count.  Names are a file's; a call's result, a literal and an array's element tell nothing.

`points_to` solves the inclusion constraints of the facts: a variable holds what its sources hold, and a field of an object is
a variable of its own.  A round passes on only what the last round found new, over the edges that were there, and all that is known
over the edges that new objects brought (difference propagation).

`answers` follows the reference's rules on pairs, which know allocations and fields only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graph import cut
from riskloom.operators.syntax import Node, Tree, parsed

SCHEMA = "file_id string, fact string, line int, target string, source string, field string, detail string"
#: Calls on a name whose result is a new object, whole names and beginnings of names.
FACTORIES, FACTORY_BEGINNINGS = ("newInstance", "getInstance", "valueOf"), ("create", "parse")


def _place(node: Node) -> tuple[str, str] | None:
    """(base, field) of a name or of a field of a name; field is '' of a plain name."""
    if node.kind == "name":
        return node.name, ""
    if node.kind == "access" and node.children[0].kind == "name":
        return node.children[0].name, node.name
    return None


def _values(node: Node) -> Iterator[Node]:
    """The nodes that a value may come from."""
    if node.kind == "cast":
        yield from _values(node.children[0])
    elif node.kind == "ternary":
        for child in node.children[1:]:
            yield from _values(child)
    elif node.kind == "assign":
        yield from _values(node.children[1])
    else:
        yield node


def _made(value: Node) -> str:
    """The type, or the call, that makes a new object; '' if none does."""
    if value.kind == "new":
        return value.name
    if value.kind == "call" and len(value.children) == 2 and value.children[0].kind == "name":
        whole = value.name in FACTORIES or (value.name.startswith(FACTORY_BEGINNINGS[0]) or (value.name.startswith(FACTORY_BEGINNINGS[1]) and len(value.name) > len(FACTORY_BEGINNINGS[1])))
        return f"{value.children[0].name}.{value.name}" if whole else ""
    return ""


def _rows(tree: Tree) -> Iterator[tuple]:
    for node in tree.nodes:
        line = tree.line[node.begin]
        place = _place(node) if node.kind == "access" else None
        if place:
            yield "access", line, None, *place, None
        if node.kind == "return":
            for value in node.children[:1]:
                for v in _values(value):
                    if v.kind == "new":
                        yield "allocate" if v is value else "allocate_via", line, f"return@L{line}", None, None, v.name
        if node.kind == "declare" and node.children:
            target, value = (node.name, ""), node.children[0]
        elif node.kind == "assign" and node.detail == "=":
            target, value = _place(node.children[0]), node.children[1]
        else:
            continue
        if target is None:
            continue
        for v in _values(value):
            made, source, name = _made(v), _place(v), ".".join(filter(None, target))
            if made:
                yield "allocate" if v is value else "allocate_via", line, name, None, None, made
            if made and target[1]:
                yield "store", line, target[0], name, target[1], None
            elif source and target[1] and not source[1]:
                yield "store", line, target[0], source[0], target[1], None
            elif source and source[1] and not target[1]:
                yield "load", line, target[0], source[0], source[1], None
            elif source and not source[1]:
                yield "copy", line, target[0], source[0], None, None
            elif source:  # from field to field, by a variable of its own
                yield "load", line, f"{name}@L{line}", source[0], source[1], None
                yield "store", line, target[0], f"{name}@L{line}", target[1], None


def facts(files: DataFrame, id_: str = "file_id", code: str = "code") -> DataFrame:
    """The alias facts of files, a whole file in each row."""
    return parsed(files, _rows, SCHEMA, id_, code)


def points_to(found: DataFrame) -> DataFrame:
    """(file_id, variable, site): the sites, as type@line, whose objects a variable may hold; of a field the variable is #site.field."""
    site = F.concat(F.col("detail"), F.lit("@"), F.col("line").cast("string"))
    known = new = cut(found.where("fact in ('allocate', 'allocate_via')").select("file_id", F.col("target").alias("variable"), site.alias("site")).distinct())
    edges = cut(found.where("fact = 'copy'").select("file_id", F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    stores = cut(found.where("fact = 'store'").select("file_id", F.col("target").alias("variable"), "field", F.col("source").alias("other"), F.lit(True).alias("stored")).unionAll(
        found.where("fact = 'load'").select("file_id", F.col("source").alias("variable"), "field", F.col("target").alias("other"), F.lit(False).alias("stored"))
    ).distinct())
    while True:
        # Objects that are new to a base bring edges from or to their fields.
        cell = F.concat(F.lit("#"), F.col("site"), F.lit("."), F.col("field"))
        brought = new.join(stores, ["file_id", "variable"])
        brought = brought.select("file_id", F.when(F.col("stored"), F.col("other")).otherwise(cell).alias("a"), F.when(F.col("stored"), cell).otherwise(F.col("other")).alias("b"))
        brought = cut(brought.distinct().join(edges, ["file_id", "a", "b"], "left_anti"))
        moved = [(new, edges), (known, brought)]
        steps = [p.join(e, (p.file_id == e.file_id) & (p.variable == e.a)).select(p.file_id, F.col("b").alias("variable"), "site") for p, e in moved]
        new = cut(steps[0].unionAll(steps[1]).distinct().join(known, ["file_id", "variable", "site"], "left_anti"))
        if new.isEmpty():
            return known
        known, edges = known.unionAll(new), edges.unionAll(brought)


def allocated(found: DataFrame) -> DataFrame:
    """(file_id, name) of allocated names as the pair rules know them: no types with arguments; a field's name counts alone too."""
    rows = found.where("fact = 'allocate' and detail not like '%<%'").select("file_id", F.explode(F.array("target", F.element_at(F.split("target", r"\."), -1))).alias("name"))
    return rows.distinct()


def fields(found: DataFrame) -> DataFrame:
    """(file_id, name, base, field): fields that are accessed, named base.field."""
    return found.where("fact = 'access'").select("file_id", F.concat_ws(".", "source", "field").alias("name"), F.col("source").alias("base"), "field").distinct()


def answers(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, a, b, alias, confidence) of pairs(file_id, a, b).

    must if they are one name; must_not if both are allocated; may if both go back to one allocated name, a field to its base; else unknown.
    """
    known = allocated(found).withColumn("root", F.col("name"))
    via = fields(found).join(known.select("file_id", F.col("name").alias("base")), ["file_id", "base"]).join(known.select("file_id", "name"), ["file_id", "name"], "left_anti")
    roots = known.withColumn("own", F.lit(True)).unionByName(via.select("file_id", "name", F.col("base").alias("root"), F.lit(False).alias("own")))
    out = pairs
    for c in ("a", "b"):
        out = out.join(roots.select("file_id", F.col("name").alias(c), F.col("root").alias(f"root_{c}"), F.col("own").alias(f"own_{c}")), ["file_id", c], "left")
    same, apart, kin = F.col("a") == F.col("b"), F.coalesce(F.col("own_a") & F.col("own_b"), F.lit(False)), F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))
    alias = F.when(same, "must").when(apart, "must_not").when(kin, "may").otherwise("unknown")
    return out.select("file_id", "a", "b", alias.alias("alias"), F.when(same | apart, 1.0).when(kin, 0.7).otherwise(0.3).alias("confidence"))


def refined(found: DataFrame, tainted: DataFrame) -> DataFrame:
    """(file_id, variables, pairs, must_not) of tainted(file_id, name): its pairs, and those whose names are both allocated, counted by file without making them."""
    own = allocated(found).withColumn("own", F.lit(1))
    told = tainted.distinct().join(own, ["file_id", "name"], "left").groupBy("file_id").agg(F.count("*").alias("variables"), F.count("own").alias("n"))
    two = lambda n: (F.col(n) * (F.col(n) - 1) / 2).cast("long")
    return told.select("file_id", "variables", two("variables").alias("pairs"), two("n").alias("must_not"))


def statistics(found: DataFrame, tainted: DataFrame) -> DataFrame:
    """(file_id, variables, sites, accesses): names allocated, accessed as fields or tainted; allocated names; fields by base."""
    names = allocated(found).withColumn("kind", F.lit("site")).unionByName(fields(found).select("file_id", "name", F.lit("access").alias("kind"))).unionByName(tainted.select("file_id", "name", F.lit("tainted").alias("kind")))
    of = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("name")))
    return names.groupBy("file_id").agg(F.count_distinct("name").alias("variables"), of("site").alias("sites"), of("access").alias("accesses"))
