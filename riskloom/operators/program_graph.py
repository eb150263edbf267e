"""Program graphs of code files: five families of edges between the nodes of syntax trees, in one table.

AST: parent to child.  CFG: a step of a method to the next, over blocks without steps.  DFG: a definition of a variable
to the uses that it reaches.  CDG: a control structure to all that stands within it.  CALL: a call without an object, or on
`this`, to the method of its name and number of arguments in the same file.

A parameter, a declaration with a value, an assignment and ++ or -- define; a variable that a loop or catch declares is defined
there.  What a step uses is read before what it defines, and steps of a block follow each other as they stand.
Definitions spread over blocks as a fixpoint: a round passes on the pairs of definition and block that the last found
new, and a block that defines the variable itself passes nothing on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.graph import cut
from riskloom.operators.syntax import within

#: The families and their numbers.
FAMILIES = {"AST": 0, "CFG": 1, "DFG": 2, "CDG": 3, "CALL": 4}
#: Kinds of control structures.
CONTROL = ("if", "else", "while", "do", "for", "foreach", "switch", "try", "catch", "finally", "break", "continue")
BLOCK = ["file_id", "method", "block"]


def _steps(flow: DataFrame) -> DataFrame:
    return flow.where("what = 'step'").select("file_id", "method", F.col("a").alias("block"), F.col("b").alias("step"))


def _block_edges(flow: DataFrame) -> DataFrame:
    return flow.where("what = 'edge'").select("file_id", "method", F.col("a").alias("block"), F.col("b").alias("next")).distinct()


def control_flow(flow: DataFrame) -> DataFrame:
    """(file_id, source, target): steps and what follows them."""
    steps = _steps(flow)
    ends = steps.groupBy(*BLOCK).agg(F.min("step").alias("first"), F.max("step").alias("final"))
    inside = steps.select("file_id", F.col("step").alias("source"), F.lead("step").over(Window.partitionBy(*BLOCK).orderBy("step")).alias("target")).where("target is not null")
    edges = cut(_block_edges(flow))
    to = ends.select("file_id", "method", F.col("block").alias("next"), "first")
    front = ends.select(*BLOCK, "final").join(edges, BLOCK).select("file_id", "method", "final", "next")
    known, out = None, inside
    while True:
        # What leads into a block without steps goes on to those after it.
        front = cut(front.distinct() if known is None else front.distinct().join(known, ["file_id", "method", "final", "next"], "left_anti"))
        if front.isEmpty():
            return out.distinct()
        known = front if known is None else known.unionAll(front)
        met = front.join(to, ["file_id", "method", "next"], "left")
        out = out.unionByName(met.where("first is not null").select("file_id", F.col("final").alias("source"), F.col("first").alias("target")))
        front = met.where("first is null").select("file_id", "method", "final", F.col("next").alias("block")).join(edges, BLOCK).select("file_id", "method", "final", "next")


def definitions(nodes: DataFrame) -> DataFrame:
    """(file_id, node, name): nodes that define a variable."""
    child = nodes.select("file_id", F.col("parent").alias("node"), F.col("node").alias("c"), F.col("kind").alias("ck"), F.col("name").alias("cn"))
    first = child.where(F.col("c") == F.col("node") + 1)
    declared = nodes.where("kind = 'declare' and last > node or kind = 'parameter'").select("file_id", "node", "name")
    over = nodes.where("kind in ('foreach', 'catch')").select("file_id", "node").join(first.where("ck = 'declare'"), ["file_id", "node"]).select("file_id", F.col("c").alias("node"), F.col("cn").alias("name"))
    changed = nodes.where("kind = 'assign' or kind = 'unary' and detail in ('++', '--')").select("file_id", "node").join(first.where("ck = 'name'"), ["file_id", "node"]).select("file_id", "node", F.col("cn").alias("name"))
    return declared.unionByName(over).unionByName(changed).distinct()


def uses(nodes: DataFrame) -> DataFrame:
    """(file_id, node, name): names that are read, so none that a plain assignment sets."""
    plain = nodes.where("kind = 'assign' and detail = '='").select("file_id", (F.col("node") + 1).alias("node"))
    return nodes.where("kind = 'name'").select("file_id", "node", "name").join(plain, ["file_id", "node"], "left_anti")


def data_flow(nodes: DataFrame, flow: DataFrame) -> DataFrame:
    """(file_id, source, target): definitions and the uses that they reach."""
    span = nodes.select("file_id", F.col("node").alias("step"), "last")
    steps = _steps(flow).join(span, ["file_id", "step"])

    def placed(rows: DataFrame) -> DataFrame:
        """rows(file_id, node, name) with the step that holds each; steps of one method don't hold each other."""
        r = rows.select(F.col("file_id").alias("rf"), "node", "name")
        return steps.join(r, (F.col("file_id") == F.col("rf")) & (F.col("node") >= F.col("step")) & (F.col("node") <= F.col("last"))).select(*BLOCK, "step", "node", "name")

    defined = definitions(nodes)
    given = nodes.where("kind = 'parameter'").select("file_id", F.col("parent").alias("method"), F.lit(0).alias("block"), F.lit(0).alias("step"), "node", "name")
    methods = flow.where("what = 'block' and a = 0").select("file_id", "method")
    inner = placed(defined.join(nodes.where("kind = 'parameter'").select("file_id", "node"), ["file_id", "node"], "left_anti"))
    defs = cut(given.join(methods, ["file_id", "method"], "left_semi").unionByName(inner))
    used = placed(uses(nodes)).select(*BLOCK, F.col("step").alias("at"), F.col("node").alias("use"), "name")
    # Of the steps before a use in its block, the last that defines the variable; else what reaches the block.
    before = used.join(defs, [*BLOCK, "name"]).where("step < at")
    local = before.groupBy("file_id", "use").agg(F.max_by("node", F.struct("step", "node")).alias("source"))
    edges = cut(_block_edges(flow))
    final = defs.groupBy(*BLOCK, "name").agg(F.max_by("node", F.struct("step", "node")).alias("node"))
    new = final.join(edges, BLOCK).select("file_id", "method", F.col("next").alias("block"), "name", "node").distinct()
    key = [*BLOCK, "name", "node"]
    known = new = cut(new)
    own = defs.select(*BLOCK, "name").distinct()
    while True:
        new = new.join(own, [*BLOCK, "name"], "left_anti").join(edges, BLOCK).select("file_id", "method", F.col("next").alias("block"), "name", "node").distinct()
        new = cut(new.join(known, key, "left_anti"))
        if new.isEmpty():
            break
        known = known.unionAll(new)
    entering = used.join(local.select("file_id", "use"), ["file_id", "use"], "left_anti").join(known, [*BLOCK, "name"])
    told = local.select("file_id", "source", F.col("use").alias("target")).unionByName(entering.select("file_id", F.col("node").alias("source"), F.col("use").alias("target")))
    return told.distinct()


def calls(nodes: DataFrame) -> DataFrame:
    """(file_id, source, target): calls and the methods of their file that they name."""
    arguments = nodes.where("kind = 'arguments'").select("file_id", F.col("node").alias("list"), F.col("parent").alias("node"))
    counts = nodes.groupBy("file_id", F.col("parent").alias("list")).agg(F.count("*").alias("n"))
    arity = arguments.join(counts, ["file_id", "list"], "left").select("file_id", "node", "list", F.coalesce("n", F.lit(0)).alias("n"))
    first = nodes.select("file_id", F.col("parent").alias("node"), (F.col("node") - 1).alias("before"), "kind", "name").where("before = node").select("file_id", "node", F.col("kind").alias("fk"), F.col("name").alias("fn"))
    own = nodes.where("kind = 'call'").select("file_id", "node", "name").join(first, ["file_id", "node"]).where("fk = 'arguments' or fk = 'name' and fn = 'this'").join(arity, ["file_id", "node"])
    given = nodes.where("kind = 'parameter'").groupBy("file_id", F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    methods = nodes.where("kind = 'method'").select("file_id", "node", "name").join(given, ["file_id", "node"], "left").select("file_id", F.col("node").alias("target"), "name", F.coalesce("k", F.lit(0)).alias("n"))
    return own.join(methods, ["file_id", "name", "n"]).groupBy("file_id", F.col("node").alias("source")).agg(F.min("target").alias("target"))


def control_dependence(nodes: DataFrame) -> DataFrame:
    """(file_id, source, target): control structures and what stands within them."""
    outer = nodes.where(F.col("kind").isin(*CONTROL)).select("file_id", "node", "last")
    return within(outer, nodes.select("file_id", "node")).where("in_node > node").select("file_id", F.col("node").alias("source"), F.col("in_node").alias("target"))


def edges(nodes: DataFrame, flow: DataFrame) -> DataFrame:
    """(file_id, source, target, edge_type, edge_type_id) of all families; nodes and flow are those of the same files, computed once."""
    tree = nodes.where("parent > 0").select("file_id", F.col("parent").alias("source"), F.col("node").alias("target"))
    out = None
    for family, part in (("AST", tree), ("CFG", control_flow(flow)), ("DFG", data_flow(nodes, flow)), ("CDG", control_dependence(nodes)), ("CALL", calls(nodes))):
        one = part.select("file_id", "source", "target", F.lit(family).alias("edge_type"), F.lit(FAMILIES[family]).alias("edge_type_id"))
        out = one if out is None else out.unionByName(one)
    return out


def graphs(nodes: DataFrame, edges_: DataFrame) -> DataFrame:
    """A graph in each row, (file_id, nodes, edges), as the reader of program graphs takes them; a file's graph is bounded by the file."""
    kind = F.when(F.col("kind") == "name", "IDENTIFIER").otherwise(F.upper("kind"))
    node = F.struct(F.col("node").alias("id"), kind.alias("node_type"), F.col("kind").alias("category"), F.col("detail").alias("code"), "name", "line", F.col("begin").alias("column"), F.col("node").alias("order"))
    edge = F.struct("source", "target", "edge_type", "edge_type_id")
    told = edges_.groupBy("file_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(node)).alias("nodes")).join(told, "file_id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(told.schema["edges"].dataType)))
