"""Syntax trees, control flow and alias facts against what is known by hand and against brute force."""

from __future__ import annotations

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from riskloom.operators import alias, flow, graph, program_graph, syntax
from riskloom.operators.syntax import Tree
from riskloom.plans.code import CODE


def shape(code: str) -> str:
    """The tree on one line: kind:name:detail(children)."""

    def told(n) -> str:
        inner = " ".join(told(c) for c in n.children)
        return ":".join(x for x in (n.kind, n.name, n.detail) if x) + (f"({inner})" if inner else "")

    return " ".join(told(n) for n in Tree(code).top)


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("a = b + c * d;", "assign:=(name:a binary:+(name:b binary:*(name:c name:d)))"),
        ("a = b - c - d;", "assign:=(name:a binary:-(binary:-(name:b name:c) name:d))"),
        ("x >>>= y >> 2;", "assign:>>>=(name:x binary:>>(name:y literal:2))"),
        ("a < b && c > d;", "binary:&&(binary:<(name:a name:b) binary:>(name:c name:d))"),
        ("Map<String, List<A>> m = null;", "declare:m:Map<String,List<A>>(literal:null)"),
        ("o.f().g(h(1)).k;", "access:k(call:g(call:f(name:o arguments) arguments(call:h(arguments(literal:1)))))"),
        ("(int) -x; (a) - b; (A) b;", "cast:int(unary:-(name:x)) binary:-(name:a name:b) cast:A(name:b)"),
        ("f(x -> x, (a, b) -> { g(); }, A::new);", "call:f(arguments(lambda(parameter:x name:x) lambda(parameter:a parameter:b block(call:g(arguments))) reference:new(name:A)))"),
        ("new int[3][]; new A.B<C>(1) { void f() {} };", "new:int:array(literal:3) new:A.B<C>(arguments(literal:1) method:f:void(block))"),
        ('// f();\n/* g(); */ s = "h(); // \\" {";', 'assign:=(name:s literal:"h(); // \\" {")'),
        ("if (a) b(); else if (c) d();", "if(name:a call:b(arguments) else(if(name:c call:d(arguments))))"),
        ("switch (x) { case A -> f(); default -> g(); }", "switch(name:x case:arrow(name:A block(call:f(arguments))) case:default(block(call:g(arguments))))"),
        ("for (A a : b) c(a);", "foreach(declare:a:A name:b call:c(arguments(name:a)))"),
        ("enum E { A(1), B { void f() {} }; int x; }", "class:E:enum(arguments(literal:1) method:f:void(block) declare:x:int)"),
        ("record P(int x, int y) { }", "class:P:record(parameter:x:int parameter:y:int)"),
        ("@A(x = 1) public static <T> T f(final T t, int... n) throws E;", "method:f:public static T(parameter:t:T parameter:n:int...)"),
        ("if (a; b(); }", "call:b(arguments)"),
        ("x instanceof A a && a.b;", "binary:&&(binary:a:instanceof A(name:x) access:b(name:a))"),
        ("Some words; and (more words) of prose.", "declare:words:Some name:words"),
        ("", ""),
    ],
)
def test_shapes(code, want):
    assert shape(code) == want


def test_intervals_and_places(spark):
    rows = syntax.tree(spark.createDataFrame([*CODE, (None, "a(b);")], "file_id string, code string")).collect()
    code = dict(CODE)
    for r in rows:
        assert r.node <= r.last and r.parent < r.node
        if r.kind == "name" and r.file_id:
            assert code[r.file_id][r.begin : r.end] == r.name
            assert code[r.file_id][: r.begin].count("\n") + 1 == r.line
    assert {r.file_id for r in rows} == {"c1", "c2", "c3", None}


def test_deep_and_broken_code_ends():
    assert len(Tree("(" * 50_000 + "a;").nodes) <= 1
    assert Tree("a" + " + a" * 20_000 + ";").nodes[0].last == 40_001
    assert Tree("x = " + "(" * 3000 + "a" + ")" * 3000 + "; f();").nodes is not None
    assert Tree(None).nodes == []


def brute_dominators(n, edges):
    """(u, v): u dominates v, by taking u away."""

    def reached(without):
        seen, todo = set(), [0] if without != 0 else []
        while todo:
            x = todo.pop()
            if x not in seen and x != without:
                seen.add(x)
                todo += [b for a, b in edges if a == x]
        return seen

    there = reached(None)
    return {(u, v) for u in there for v in there if v not in reached(u)}


def test_dominators_and_loops(spark):
    """Random graphs, all in one run, as methods of two files."""
    r, blocks, edges, want_dominators, want_immediate, want_loops = random.Random(7), [], [], set(), set(), set()
    for m in range(12):
        n = r.randint(1, 9)
        own = {(a, b) for a, b in pairwise(range(n)) if r.random() < 0.8} | {(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 8))}
        key = (f"f{m % 2}", m)
        blocks += [(*key, b) for b in range(n)]
        edges += [(*key, a, b) for a, b in own]
        pairs = brute_dominators(n, own)
        want_dominators |= {(*key, u, v) for u, v in pairs}
        depth = {v: sum(1 for a, b in pairs if b == v) for _, v in pairs}
        want_immediate |= {(*key, v, max((u for u, w in pairs if w == v and u != v), key=depth.get)) for v in depth if v != 0}
        for a, h in own:
            if (h, a) in pairs:
                body, todo = {h}, [a]
                while todo:
                    x = todo.pop()
                    if x not in body:
                        body.add(x)
                        todo += [p for p, q in own if q == x]
                want_loops |= {(*key, h, b) for b in body}
    b = spark.createDataFrame(blocks, "file_id string, method int, block int")
    e = spark.createDataFrame(edges, "file_id string, method int, source int, target int")
    found = flow.dominators(b, e).cache()
    assert {tuple(x) for x in found.collect()} == want_dominators
    assert {tuple(x) for x in flow.immediate(found).collect()} == want_immediate
    assert {tuple(x) for x in flow.loops(e, found).collect()} == want_loops


def brute_points_to(facts):
    """Andersen's inclusions, naively until nothing changes."""
    pts = {}
    for f, line, target, _, _, detail in facts:
        if f.startswith("allocate"):
            pts.setdefault(target, set()).add(f"{detail}@{line}")
    while True:
        before = {k: set(v) for k, v in pts.items()}
        for f, _, target, source, field, _ in facts:
            if f == "copy":
                pts.setdefault(target, set()).update(pts.get(source, ()))
            for site in list(pts.get(target if f == "store" else source, ())) if f in ("store", "load") else ():
                cell = f"#{site}.{field}"
                a, b = (source, cell) if f == "store" else (cell, target)
                pts.setdefault(b, set()).update(pts.get(a, ()))
        if before == pts or before == {k: v for k, v in pts.items() if v}:
            return {(k, s) for k, v in pts.items() for s in v}


def test_points_to(spark):
    r = random.Random(3)
    names, files = [f"v{i}" for i in range(6)], {}
    for i in range(8):
        lines = []
        for _ in range(14):
            a, b = r.choice(names), r.choice(names)
            lines.append(r.choice([f"{a} = new T();", f"{a} = {b};", f"{a}.f = {b};", f"{a} = {b}.f;", f"{a}.g = {b}.f;", f"{a} = x ? {b} : (T) new U();", f"{a}.f = new V();", f"// {a} = new W();"]))
        files[f"f{i}"] = "\n".join(lines)
    found = alias.facts(spark.createDataFrame([*files.items(), ("n", None)], "file_id string, code string")).cache()
    want = set()
    for name in files:
        want |= {(name, *x) for x in brute_points_to([tuple(x)[1:] for x in found.where(F.col("file_id") == name).collect()])}
    assert {tuple(x) for x in alias.points_to(found).collect()} == want
    assert want


def test_alias_metrics(spark):
    """Imports and packages are no field accesses; fields that are read or written are."""
    none = "package shop.till.one;\nimport shop.stock.Shelf;\nimport shop.stock.Price;\nclass Till {\n  String read(Shelf shelf) {\n    return shelf.label(\"a.b\"); // shelf.size\n  }\n}"
    some = "package shop.till;\nclass Till {\n  void fill() {\n    Box f = new Box();\n    f.x = 2;\n    int y = f.x + 1;\n  }\n}"
    found = alias.facts(spark.createDataFrame([("none", none), ("some", some)], "file_id string, code string"))
    assert [tuple(r) for r in alias.fields(found).collect()] == [("some", "f.x", "f", "x")]
    told = alias.answers(found, spark.createDataFrame([("some", "f.x", "f"), ("some", "y", "y"), ("some", "y", "f")], "file_id string, a string, b string"))
    assert {(r.a, r.b, r.alias, r.confidence) for r in told.collect()} == {("f.x", "f", "may", 0.7), ("y", "y", "must", 1.0), ("y", "f", "unknown", 0.3)}


def brute_reaching(tree, f):
    """(definition, use) by nodes of one method without parameters, following single paths over steps until nothing new is seen."""
    own = flow.Flow(tree, f)
    steps = [[s.number for s in b] for b in own.steps]
    last = {n.number: n.last for n in tree.nodes}
    by = {n.number: n for n in tree.nodes}

    def defs(s):
        out = []
        for k in range(s, last[s] + 1):
            n = by[k]
            if n.kind == "declare" and n.children:
                out.append((k, n.name))
            if (n.kind == "assign" or (n.kind == "unary" and n.detail in ("++", "--"))) and n.children[0].kind == "name":
                out.append((k, n.children[0].name))
        return out

    def reads(s):
        set_ = {by[k].children[0].number for k in range(s, last[s] + 1) if by[k].kind == "assign" and by[k].detail == "="}
        return [(k, by[k].name) for k in range(s, last[s] + 1) if by[k].kind == "name" and k not in set_]

    found, seen, todo = set(), set(), [(0, ())]
    while todo:
        block, state = todo.pop()
        if (block, state) in seen:
            continue
        seen.add((block, state))
        now = dict(state)
        for s in steps[block]:
            found |= {(now[v], u) for u, v in reads(s) if v in now}
            now.update({v: d for d, v in defs(s)})
        todo += [(b, tuple(sorted(now.items()))) for a, b, _ in own.edges if a == block]
    return found


def test_definitions_reach(spark):
    r, files = random.Random(5), {}

    def statement(depth):
        v, w = r.choice("abc"), r.choice("abc")
        kind = r.randrange(8 if depth else 4)
        inner = lambda: "{ " + " ".join(statement(depth - 1) for _ in range(r.randint(0, 3))) + " }"
        if kind < 4:
            return [f"{v} = {w} + 1;", f"{v} += {w};", f"{v}++;", f"f({v}, {w});"][kind]
        if kind == 4:
            return f"if ({v} > 0) {inner()} else {inner()}"
        return [f"while ({v} < 3) ", f"if ({v} == 0) ", f"for (; {v} < {w}; {w}++) "][kind - 5] + inner()

    for i in range(10):
        files[f"f{i}"] = "void m() { int a = 0; " + " ".join(statement(3) for _ in range(5)) + " return a; }"
    df = spark.createDataFrame([*files.items()], "file_id string, code string")
    nodes, flows = syntax.tree(df).cache(), flow.flow(df).cache()
    want = {(k, d, u) for k, code in files.items() for t in [Tree(code)] for d, u in brute_reaching(t, t.top[0])}
    assert {(x.file_id, x.source, x.target) for x in program_graph.data_flow(nodes, flows).collect()} == want
    # Everything within a control structure is what the closure over the tree's edges finds.
    tree = nodes.where("parent > 0").select(F.concat_ws(":", "file_id", "parent").alias("source"), F.concat_ws(":", "file_id", "node").alias("target"))
    control = nodes.where(F.col("kind").isin(*program_graph.CONTROL)).select(F.concat_ws(":", "file_id", "node").alias("seed"))
    closed = {tuple(x) for x in graph.closure(tree, control).where("seed <> node").collect()}
    assert {(f"{x.file_id}:{x.source}", f"{x.file_id}:{x.target}") for x in program_graph.control_dependence(nodes).collect()} == closed


def test_calls_find_methods(spark):
    code = "class A { void f() { g(1); this.g(2, 3); o.g(4); h(); } void g(int a) { f(); } void g(int a, int b) { } }"
    nodes = syntax.tree(spark.createDataFrame([("a", code), ("b", "void h() { }")], "file_id string, code string")).cache()
    name = {r.node: f"{r.name}{sum(1 for c in nodes.collect() if c.kind == 'parameter' and c.parent == r.node)}" for r in nodes.where("file_id = 'a' and kind in ('method', 'call')").collect()}
    assert sorted((name[r.source], name[r.target]) for r in program_graph.calls(nodes).collect()) == [("f0", "f0"), ("g0", "g1"), ("g0", "g2")]
