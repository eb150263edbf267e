"""Control flow of methods as tables: basic blocks, their edges, dominators and loops.

Blocks and edges come from each method's syntax tree in one Arrow pass.  A block is entered at its first statement and left
after its last.  Kinds of edges: `fall-through` (a test holds), `branch` (it doesn't, or a jump), `sequential`, `switch`,
`switch-default`, and `exception` (from every block of a try to its catches).  A return or throw ends its block as an
exit, and so does the end of the method; that a finally block comes between is left out.  Lambdas, and classes within methods,
are no part of a method's flow; their methods have their own.

Dominators and loops are fixpoints over all methods at once: a round joins the edges with the pairs that the last round
found, so its work is that of the new pairs.  Pairs are at most the squares of methods' blocks, never across methods.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graph import cut
from riskloom.operators.syntax import Node, Tree, parsed

#: what: block (a: its number, b: statements, kind: exit or empty), edge (a, b: from and to) or step (a: block, b: node of a statement, in order of nodes).
SCHEMA = "file_id string, method int, name string, what string, a int, b int, kind string, line int"
METHOD = ["file_id", "method"]


class Flow:
    """Blocks and edges of one method."""

    def __init__(self, tree: Tree, method: Node):
        self.tree, self.steps, self.edges, self.exits = tree, [[]], [], set()
        self.targets: list[tuple[str, list[int], int | None]] = []  # label, blocks that break, where a continue goes
        self.label = ""
        self.now: int | None = 0
        body = method.of("block")
        if body:
            self.walk(body)
        if self.now is not None:
            self.exits.add(self.now)

    def new(self, *before: tuple[int | None, str]) -> int:
        """A block, with edges from others, as what follows now."""
        self.steps.append([])
        self.now = len(self.steps) - 1
        for block, kind in before:
            self.edge(block, self.now, kind)
        return self.now

    def edge(self, a: int | None, b: int, kind: str) -> None:
        if a is not None:
            self.edges.append((a, b, kind))

    def add(self, node: Node | None) -> None:
        if node is not None:
            if self.now is None:
                self.new()  # nothing leads here
            self.steps[self.now].append(node)

    def walk(self, node: Node) -> None:
        step = getattr(self, f"_{node.kind}", None)
        label, self.label = self.label, ""
        if step is None:
            self.add(node)
        elif node.kind in LOOPS:
            step(node, label)
        else:
            step(node)

    def _block(self, node: Node) -> None:
        for child in node.children:
            self.walk(child)

    def _class(self, node: Node) -> None:
        pass

    _method = _class

    def _label(self, node: Node) -> None:
        self.label = node.name
        inner = node.children[0]
        if inner.kind in LOOPS:
            self.walk(inner)
            return
        breaks: list[int] = []
        self.targets.append((node.name, breaks, None))
        self.label = ""
        self.walk(inner)
        self.targets.pop()
        if breaks:
            self.new((self.now, "sequential"), *[(b, "branch") for b in breaks])

    def _if(self, node: Node) -> None:
        test, yes, *other = node.children
        self.add(test)
        head = self.now
        self.new((head, "fall-through"))
        self.walk(yes)
        ended = self.now
        if other:
            self.new((head, "branch"))
            self.walk(other[0].children[0])
            if ended is not None or self.now is not None:
                self.new((ended, "branch"), (self.now, "sequential"))
        else:
            self.new((head, "branch"), (ended, "sequential"))

    def loop(self, label: str, body: Node, test: int, step: Node | None, endless: bool) -> None:
        """The body after a test, and what the loop ends with."""
        breaks: list[int] = []
        self.new((test, "fall-through"))
        again = test
        if step is not None:
            first = self.now
            again, self.now = self.new(), first
        self.targets.append((label, breaks, again))
        self.walk(body)
        self.targets.pop()
        if step is not None:
            self.edge(self.now, again, "sequential")
            self.now = again
            for child in step.children:
                self.add(child)
        self.edge(self.now, test, "branch")
        left = [(b, "branch") for b in breaks] if endless else [(test, "branch"), *[(b, "branch") for b in breaks]]
        self.now = self.new(*left) if left else None

    def _while(self, node: Node, label: str) -> None:
        test = self.new((self.now, "sequential"))
        self.add(node.children[0])
        self.loop(label, node.children[1], test, None, node.children[0].name == "true")

    def _for(self, node: Node, label: str) -> None:
        first, condition, step, body = node.children
        for child in first.children:
            self.add(child)
        test = self.new((self.now, "sequential"))
        for child in condition.children:
            self.add(child)
        self.loop(label, body, test, step, not condition.children)

    def _foreach(self, node: Node, label: str) -> None:
        variable, over, body = node.children
        self.add(over)
        test = self.new((self.now, "sequential"))
        self.add(variable)
        self.loop(label, body, test, None, False)

    def _do(self, node: Node, label: str) -> None:
        first = self.new((self.now, "sequential"))
        test, breaks = self.new(), []
        self.now = first
        self.targets.append((label, breaks, test))
        self.walk(node.children[0])
        self.targets.pop()
        self.edge(self.now, test, "sequential")
        self.now = test
        self.add(node.children[1])
        self.edge(test, first, "branch")
        self.new((test, "fall-through"), *[(b, "branch") for b in breaks])

    def _switch(self, node: Node, label: str) -> None:
        self.add(node.children[0])
        head, before, breaks, default = self.now, None, [], False
        self.targets.append((label, breaks, None))
        for case in node.children[1:]:
            default |= case.detail == "default"
            self.new((head, "switch-default" if case.detail == "default" else "switch"), (before, "sequential"))
            self.walk(case.children[-1])
            before = self.now
            if case.detail == "arrow" and before is not None:
                breaks.append(before)
                before = None
        self.targets.pop()
        left = [(before, "sequential"), *[(b, "branch") for b in breaks]] + ([] if default else [(head, "switch-default")])
        self.now = self.new(*left) if any(b is not None for b, _ in left) else None

    def _try(self, node: Node) -> None:
        body = node.of("block")
        for child in node.children[: node.children.index(body)]:
            self.add(child)
        first = self.new((self.now, "sequential"))
        self.walk(body)
        ends, inside = [self.now], range(first, len(self.steps))
        for part in node.children:
            if part.kind == "catch":
                self.new(*[(b, "exception") for b in inside])
                for child in part.children:
                    self.walk(child)
                ends.append(self.now)
        last = node.of("finally")
        if last or any(e is not None for e in ends):
            self.new(*[(e, "sequential") for e in ends])
        if last:
            self._block(last)

    def _synchronized(self, node: Node) -> None:
        for child in node.children:
            self.walk(child)

    def _return(self, node: Node) -> None:
        self.add(node)
        self.exits.add(self.now)
        self.now = None

    _throw = _return

    def _break(self, node: Node) -> None:
        self.add(node)
        found = next((t for t in reversed(self.targets) if not node.name or t[0] == node.name), None)
        if found and (node.name or found[1] is not None):
            found[1].append(self.now)
        self.now = None

    _yield = _break

    def _continue(self, node: Node) -> None:
        self.add(node)
        found = next((t for t in reversed(self.targets) if t[2] is not None and (not node.name or t[0] == node.name)), None)
        if found:
            self.edge(self.now, found[2], "branch")
        self.now = None


LOOPS = frozenset(("while", "for", "foreach", "do", "switch"))


def _rows(tree: Tree) -> Iterator[tuple]:
    for method in tree.nodes:
        if method.kind != "method" or not method.of("block"):
            continue
        flow = Flow(tree, method)
        for i, steps in enumerate(flow.steps):
            line = tree.line[steps[0].begin] if steps else None
            yield method.number, method.name, "block", i, len(steps), "exit" if i in flow.exits else "", line
            for s in steps:
                yield method.number, method.name, "step", i, s.number, s.kind, tree.line[s.begin]
        for a, b, kind in dict.fromkeys(flow.edges):
            yield method.number, method.name, "edge", a, b, kind, None


def flow(files: DataFrame, id_: str = "file_id", code: str = "code") -> DataFrame:
    """Blocks, edges and steps of all methods with a body in files, a whole file in each row; method: its node."""
    return parsed(files, _rows, SCHEMA, id_, code)


def blocks(found: DataFrame) -> DataFrame:
    return found.where("what = 'block'").select("file_id", "method", "name", F.col("a").alias("block"), F.col("b").alias("steps"), (F.col("kind") == "exit").alias("is_exit"), "line")


def edges(found: DataFrame) -> DataFrame:
    return found.where("what = 'edge'").select("file_id", "method", "name", F.col("a").alias("source"), F.col("b").alias("target"), "kind")


def _grown(known: DataFrame, step: DataFrame, key: list[str], stop: str) -> DataFrame:
    """known(*key, at) with all that step(file_id, method, source, target) leads to, but for targets that are the key's `stop`."""
    known = new = cut(known)
    while True:
        new = new.join(step, (F.col("at") == F.col("source")) & (F.col("file_id") == F.col("sf")) & (F.col("method") == F.col("sm")) & (F.col(stop) != F.col("target")))
        new = new.select(*key, F.col("target").alias("at")).distinct()
        new = cut(new.join(known, [*key, "at"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionAll(new)


def _step(edges_: DataFrame, back: bool = False) -> DataFrame:
    a, b = ("target", "source") if back else ("source", "target")
    return edges_.select(F.col("file_id").alias("sf"), F.col("method").alias("sm"), F.col(a).alias("source"), F.col(b).alias("target")).distinct()


def dominators(blocks_: DataFrame, edges_: DataFrame) -> DataFrame:
    """(file_id, method, dominator, block): every path from block 0 to the block goes through the dominator; itself included.

    u dominates v if v can be reached, but not without u: what is reached without each u grows from block 0.
    Blocks that can't be reached have no dominators.  Pairs stay within a method, whose length the language bounds.
    """
    step = cut(_step(edges_))
    seeds = blocks_.select(*METHOD, F.when(F.col("block") == 0, -1).otherwise(F.col("block")).alias("without"), F.lit(0).alias("at"))  # block 0's row goes without none
    reached = _grown(seeds, step, [*METHOD, "without"], "without")
    there = reached.where("without = -1").select(*METHOD, F.col("at").alias("block"))
    # The entry dominates all; another u those that were reached, but not without it.
    pairs = there.join(there.select(*METHOD, F.col("block").alias("dominator")), METHOD)
    avoided = reached.where("without >= 0").select(*METHOD, F.col("without").alias("dominator"), F.col("at").alias("block"))
    return pairs.join(avoided, [*METHOD, "dominator", "block"], "left_anti").select(*METHOD, "dominator", "block")


def immediate(found: DataFrame) -> DataFrame:
    """(file_id, method, block, idom) of dominators: of a block's others the one that has most dominators itself."""
    depth = found.groupBy(*METHOD, F.col("block").alias("dominator")).agg(F.count("*").alias("depth"))
    return found.where("dominator <> block").join(depth, [*METHOD, "dominator"]).groupBy(*METHOD, "block").agg(F.max_by("dominator", "depth").alias("idom"))


def loops(edges_: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, method, head, block): the natural loops of the edges that lead back to a dominator, one for each head."""
    back = edges_.select(*METHOD, F.col("source").alias("block"), F.col("target").alias("dominator")).join(found, [*METHOD, "block", "dominator"], "left_semi")
    starts = back.select(*METHOD, F.col("dominator").alias("head"), F.col("block").alias("at")).distinct()
    heads = starts.select(*METHOD, "head", F.col("head").alias("at")).distinct()
    body = _grown(starts.where("at <> head"), cut(_step(edges_, back=True)), [*METHOD, "head"], "head")
    return body.unionAll(heads).select(*METHOD, "head", F.col("at").alias("block"))
