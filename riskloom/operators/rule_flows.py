"""Taint by rules of a file rather than fixed lists: sources, sinks, transfers and sanitizers of named methods, over program graphs.

A value spreads from a node to what takes it over: from a definition to the uses that it reaches, from an operand to its
expression, from a value to what it is assigned to.  Through a call it spreads only by a transfer rule, from an argument
or the object to the result or the object; an object that takes something over is tainted at all its uses
that the same definition reaches.  A sanitizer's result takes nothing over.  What reaches an argument, or the object, that a sink names is a flow.

Methods are told by name and number of arguments, constructors by their class's name.  Rules are a table; it is broadcast
if it is small, as Spark measures it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators import program_graph
from riskloom.operators.graph import closure, cut

#: Kinds of nodes that take over what any of their children holds.
PASSING = ("binary", "cast", "ternary", "declare", "array", "lambda", "return")


def _id(file: str, node: str) -> Column:
    return F.concat_ws(":", F.col(file), F.col(node).cast("string"))


def _calls(nodes: DataFrame) -> DataFrame:
    """(file_id, call, line, method, arity, list) of calls and constructions; list: the node of their arguments."""
    listed = nodes.where("kind = 'arguments'").select("file_id", F.col("node").alias("list"), F.col("parent").alias("call"))
    many = nodes.groupBy("file_id", F.col("parent").alias("list")).agg(F.count("*").alias("n"))
    simple = F.regexp_extract("name", r"([\w$]+)(<.*)?$", 1)
    own = nodes.where("kind in ('call', 'new')").select("file_id", F.col("node").alias("call"), "line", F.when(F.col("kind") == "new", F.concat(simple, F.lit(".<init>"))).otherwise(F.col("name")).alias("method"))
    return own.join(listed, ["file_id", "call"]).join(many, ["file_id", "list"], "left").select("file_id", "call", "line", "method", F.coalesce("n", F.lit(0)).alias("arity"), "list")


def _ends(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(file_id, call, at, node): the arguments of calls by number, and what they are called on as `base`."""
    child = nodes.select("file_id", "node", "parent", "kind")
    given = child.join(calls.select("file_id", "call", F.col("list").alias("parent")), ["file_id", "parent"])
    given = given.select("file_id", "call", (F.row_number().over(Window.partitionBy("file_id", "call").orderBy("node")) - 1).cast("string").alias("at"), "node")
    base = child.where("kind <> 'arguments'").join(calls.select("file_id", "call", F.col("call").alias("parent")), ["file_id", "parent"]).where("node = call + 1")
    return given.unionByName(base.select("file_id", "call", F.lit("base").alias("at"), "node"))


def flows(nodes: DataFrame, flow: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, source, source_line, sink, sink_line): calls of sources whose result reaches a sink, by methods and lines.

    nodes and flow: syntax trees and control flow of the same files, computed once; rules(section, class, method, arity, index, from, to).
    """
    name = F.when(F.col("method") == "<init>", F.concat(F.element_at(F.split("class", r"\."), -1), F.lit(".<init>"))).otherwise(F.col("method"))
    known = cut(rules.withColumn("method", name).select("section", "method", "arity", "index", "from", "to").distinct())
    calls = cut(_calls(nodes))
    ends = cut(_ends(nodes, calls))
    ruled = lambda section, *columns: calls.join(known.where(F.col("section") == section).select("method", "arity", *columns), ["method", "arity"])
    clean = ruled("sanitizers").select("file_id", F.col("call").alias("target")).distinct()
    data = cut(program_graph.data_flow(nodes, flow).select("file_id", F.col("source").alias("definition"), F.col("target").alias("use")))
    child = nodes.select("file_id", "node", F.col("parent").alias("up"))
    passing = child.join(nodes.where(F.col("kind").isin(*PASSING)).select("file_id", F.col("node").alias("up")), ["file_id", "up"]).select("file_id", F.col("node").alias("source"), F.col("up").alias("target"))
    # Of an assignment the value, which is the last child, goes to the assignment, which defines its variable.
    assigned = child.join(nodes.where("kind = 'assign'").select("file_id", F.col("node").alias("up")), ["file_id", "up"]).groupBy("file_id", F.col("up").alias("target")).agg(F.max("node").alias("source"))
    moved = ruled("transfers", "from", "to").join(ends.withColumnRenamed("at", "from"), ["file_id", "call", "from"])
    to_result = moved.where("to = 'result'").select("file_id", F.col("node").alias("source"), F.col("call").alias("target"))
    base = ends.where("at = 'base'").select("file_id", "call", F.col("node").alias("use"))
    to_base = moved.where("to = 'base'").join(base, ["file_id", "call"]).join(data, ["file_id", "use"]).select("file_id", F.col("node").alias("source"), F.col("definition").alias("target"))
    steps = data.select("file_id", F.col("definition").alias("source"), F.col("use").alias("target"))
    for part in (passing, assigned, to_result, to_base):
        steps = steps.unionByName(part.select("file_id", "source", "target"))
    steps = steps.join(clean, ["file_id", "target"], "left_anti")
    starts = cut(ruled("sources").select("file_id", F.col("call").alias("node"), F.col("method").alias("source"), F.col("line").alias("source_line")).distinct())
    reached = closure(steps.select(_id("file_id", "source").alias("source"), _id("file_id", "target").alias("target")), starts.select(_id("file_id", "node").alias("seed")))
    sinks = ruled("sinks", "index").join(ends.withColumnRenamed("at", "index"), ["file_id", "call", "index"]).select("file_id", _id("file_id", "node").alias("node"), F.col("method").alias("sink"), F.col("line").alias("sink_line"))
    begun = starts.select(_id("file_id", "node").alias("seed"), "source", "source_line")
    return reached.join(sinks, "node").join(begun, "seed").select("file_id", "source", "source_line", "sink", "sink_line").distinct()
