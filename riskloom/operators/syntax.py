"""Syntax trees of code files as a table, a row for each node.

A file is one Arrow value; a tokenizer and a recursive descent over it give the nodes, numbered before their children
(`node`) with the number of their last descendant (`last`).  So b is within a if a.node <= b.node <= a.last, and rules over
nesting are joins on that interval (`within`), not patterns over text.

Comments are no tokens, and strings are single ones.  Pieces of code outside any class are parsed as members or
statements, whichever fits; where nothing fits, the tokens up to the failure give no nodes.  A null or empty text has no nodes.

Kinds: class, method, parameter, declare, block; if, else, while, do, for, for_init, for_test, for_step, foreach, switch, case,
try, catch, finally, return, throw, break, continue, label, synchronized, assert, yield; assign, ternary, binary, unary, cast, call,
arguments, new, access, index, name, literal, array, lambda, reference.
`name`: of what is declared, called, accessed or read; the text of a literal.  `detail`: a type, an operator, or of a case `default`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.graph import cut

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"{3}.*?(?:\"{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<number>\d[\w.]*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)"""
    r"""|(?P<mark>\.\.\.|->|::|\+\+|--|&&|\|\||<<=|[-+*/%&|^!=<]=|<<|.)""",
    re.DOTALL,
)
MODIFIERS = frozenset(("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"))
PRIMITIVES = frozenset(("boolean", "byte", "char", "short", "int", "long", "float", "double", "void"))
CLASSES = frozenset(("class", "interface", "enum", "record"))
#: Words that begin no type and no name.
RESERVED = frozenset(("if", "else", "while", "do", "for", "switch", "case", "try", "catch", "finally", "return", "throw", "break", "continue", "new", "instanceof", "assert", "import", "package", "throws", "extends", "implements", "goto"))
LITERALS = frozenset(("true", "false", "null"))
ASSIGNMENTS = frozenset(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="))
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">=", "instanceof"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"))
BINDING = {op: level for level, ops in enumerate(LEVELS) for op in ops}
PAIRS = {"(": ")", "[": "]", "{": "}"}


class Bad(Exception):
    """What stands here isn't what was expected."""


class Node:
    __slots__ = ("begin", "children", "detail", "end", "kind", "last", "name", "number", "parent")

    def __init__(self, kind: str, name: str, begin: int, end: int, children: list[Node], detail: str = ""):
        self.kind, self.name, self.begin, self.end, self.children, self.detail = kind, name, begin, end, [c for c in children if c], detail
        self.number = self.last = self.parent = 0

    def of(self, kind: str) -> Node | None:
        return next((c for c in self.children if c.kind == kind), None)


class Parser:
    """Recursive descent over the tokens of one file; every method begins at token `i` and leaves it after what it took."""

    def __init__(self, code: str):
        self.text, self.kind, self.start = [], [], []
        for m in _TOKEN.finditer(code):
            if m.lastgroup != "skip":
                self.text.append(m.group())
                self.kind.append(m.lastgroup)
                self.start.append(m.start())
        self.n = len(self.text)
        self.closing = self._closings()
        self.in_label = False  # where -> follows the labels of a case
        self.text += [""] * 3
        self.kind += ["end"] * 3
        self.i = 0

    def _closings(self) -> dict[int, int]:
        """The place of the bracket that closes each bracket."""
        out, open_ = {}, []
        for i, t in enumerate(self.text):
            if self.kind[i] != "mark":
                continue
            if t in PAIRS:
                open_.append(i)
            elif t in ")]}":
                while open_ and PAIRS[self.text[open_[-1]]] != t:
                    open_.pop()
                if open_:
                    out[open_.pop()] = i
        return out

    # Small steps.

    def at(self, *texts: str) -> bool:
        return self.text[self.i] in texts and self.kind[self.i] != "string"

    def take(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise Bad

    def word(self) -> str:
        if not self.is_name(self.i):
            raise Bad
        self.i += 1
        return self.text[self.i - 1]

    def is_name(self, i: int) -> bool:
        return self.kind[i] == "word" and self.text[i] not in RESERVED

    def closed(self, i: int) -> int:
        """The place after the bracket that closes the one at i."""
        if i not in self.closing:
            raise Bad
        return self.closing[i] + 1

    def made(self, kind: str, name: str, begin: int, children: list, detail: str = "") -> Node:
        return Node(kind, name, begin, self.i, children, detail)

    def listed(self, one: Callable[[], Node], end: str) -> list[Node]:
        """One after the other with commas between, up to a closing bracket."""
        out = []
        while not self.at(end):
            out.append(one())
            if not self.take(","):
                break
        self.need(end)
        return out

    # Types are looked at, not kept as nodes.

    def type_end(self, i: int) -> int:
        """The place after a type that begins at i; 0 if there is none."""
        if not self.is_name(i) or self.text[i] in LITERALS or self.text[i] in MODIFIERS:
            return 0
        i += 1
        while True:
            if self.text[i] == "<" and self.kind[i] == "mark":
                i = self.generic_end(i)
                if not i:
                    return 0
            elif self.text[i] == "." and self.is_name(i + 1):
                i += 2
            else:
                break
        while self.text[i] == "[" and self.text[i + 1] == "]":
            i += 2
        return i + 1 if self.text[i] == "..." else i

    def generic_end(self, i: int) -> int:
        depth = 0
        while True:
            t = self.text[i]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif not (self.kind[i] == "word" or t in (",", "?", ".", "&", "[", "]")):
                return 0
            i += 1

    def spelled(self, begin: int, end: int) -> str:
        """Tokens without space between them, but between words."""
        out = ""
        for i in range(begin, end):
            out += (" " if out and self.kind[i] == "word" == self.kind[i - 1] else "") + self.text[i]
        return out

    def modifiers(self) -> set[str]:
        found = set()
        while True:
            if self.at("@") and self.text[self.i + 1] != "interface" and self.is_name(self.i + 1):
                self.i = self.i + 2
                while self.at(".") and self.is_name(self.i + 1):
                    self.i += 2
                if self.at("("):
                    self.i = self.closed(self.i)
            elif self.text[self.i] in MODIFIERS and self.kind[self.i] == "word" and self.text[self.i + 1] not in ("(", ":", "->"):
                found.add(self.text[self.i])
                self.i += 1
            else:
                return found

    # Declarations and statements.

    def items(self, end: str = "") -> list[Node]:
        """Members or statements up to a closing brace or the end; what fails is left out up to the failure."""
        out = []
        while self.i < self.n and not (end and self.at(end)):
            begin = self.i
            try:
                out += self.item()
            except (Bad, RecursionError):
                self.i = max(self.i, begin + 1)
            if self.i == begin:
                self.i += 1
        return out

    def item(self) -> list[Node]:
        begin = self.i
        if self.at("import", "package"):
            while self.i < self.n and not self.take(";"):
                self.i += 1
            return []
        if self.at("synchronized") and self.text[self.i + 1] == "(":
            return [self.statement()]
        given = self.modifiers()
        if self.at("@"):
            self.i += 1
        if self.text[self.i] in CLASSES and self.is_name(self.i + 1) and (self.text[self.i] != "record" or self.text[self.i + 2] in ("(", "<")):
            return [self.class_(begin)]
        if self.at("<"):
            self.i = self.generic_end(self.i) or self.i
        if self.is_name(self.i) and self.text[self.i + 1] == "(" and self.text[self.i] not in ("this", "super") and self.i + 1 in self.closing:
            if self.text[self.closing[self.i + 1] + 1] in ("{", "throws"):
                return [self.method(begin, "", given)]
        end = self.type_end(self.i)
        if end and self.is_name(end) and self.text[end] not in LITERALS:
            if self.text[end + 1] == "(" and end + 1 in self.closing and self.text[self.closing[end + 1] + 1] in ("{", ";", "throws", "default", ""):
                kind = self.spelled(self.i, end)
                self.i = end
                return [self.method(begin, kind, given)]
            if self.text[end + 1] in ("=", ";", ",", "["):
                out = self.declared(begin)
                self.take(";")
                return out
        if self.at("{"):
            return [self.block()]
        return [x for x in [self.statement()] if x]

    def declared(self, begin: int) -> list[Node]:
        """A declaration of one or more variables, without what ends it."""
        end = self.type_end(self.i)
        kind, out = self.spelled(self.i, end), []
        self.i = end
        while True:
            first, name = self.i, self.word()
            while self.at("[") and self.text[self.i + 1] == "]":
                self.i += 2
            value = self.value() if self.take("=") else None
            out.append(self.made("declare", name, begin if not out else first, [value], kind))
            if not self.take(","):
                return out

    def value(self) -> Node:
        return self.array() if self.at("{") else self.expression()

    def array(self) -> Node:
        begin = self.i
        self.need("{")
        return self.made("array", "", begin, self.listed(self.value, "}"))

    def class_(self, begin: int) -> Node:
        kind = self.text[self.i]
        self.i += 1
        name = self.word()
        parts: list[Node] = []
        while self.i < self.n and not self.at("{"):
            if kind == "record" and self.at("("):
                parts += self.parameters()
            else:
                self.i += 1
        return self.made("class", name, begin, parts + self.body(kind == "enum"), kind)

    def body(self, enum: bool = False) -> list[Node]:
        self.need("{")
        out = []
        while enum and self.is_name(self.i):  # constants, with arguments and bodies
            self.i += 1
            if self.at("("):
                out.append(self.arguments())
            if self.at("{"):
                out += self.body()
            if not self.take(","):
                break
        out += self.items("}")
        self.take("}")
        return out

    def parameters(self) -> list[Node]:
        self.need("(")

        def one() -> Node:
            begin = self.i
            self.modifiers()
            end = self.type_end(self.i)
            if not end:
                raise Bad
            kind = self.spelled(self.i, end)
            self.i = end
            name = self.word()
            while self.at("[") and self.text[self.i + 1] == "]":
                self.i += 2
            return self.made("parameter", name, begin, [], kind)

        return self.listed(one, ")")

    def method(self, begin: int, kind: str, given: set[str]) -> Node:
        name, place = self.word(), self.i
        try:
            parts = self.parameters()
        except Bad:  # a list that isn't one of parameters
            parts, self.i = [], self.closed(place)
        while self.i < self.n and not self.at("{", ";"):
            self.i += 1
        if self.at("{"):
            parts.append(self.block())
        else:
            self.take(";")
        return self.made("method", name, begin, parts, " ".join([*sorted(given), *([kind] if kind else [])]))

    def block(self) -> Node:
        begin = self.i
        return self.made("block", "", begin, self.body())

    def one(self) -> Node:
        """A statement as a single node."""
        begin, found = self.i, self.item()
        return found[0] if len(found) == 1 else self.made("block", "", begin, found)

    def head(self) -> Node:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    def statement(self) -> Node | None:
        begin, t = self.i, self.text[self.i]
        special = getattr(self, f"_{t}", None) if self.kind[self.i] == "word" and t in STATEMENTS else None
        if special:
            self.i += 1
            return special(begin)
        if self.take(";"):
            return None
        if self.is_name(self.i) and self.text[self.i + 1] == ":" and self.text[self.i + 2] != ":":
            self.i += 2
            return self.made("label", t, begin, [self.one()])
        out = self.expression()
        if not self.take(";") and not self.at("}", ")", ""):
            raise Bad
        return out

    def _if(self, begin: int) -> Node:
        parts = [self.head(), self.one()]
        if self.at("else"):
            place = self.i
            self.i += 1
            other = self.one()
            parts.append(self.made("else", "", place, [other]))
        return self.made("if", "", begin, parts)

    def _while(self, begin: int) -> Node:
        return self.made("while", "", begin, [self.head(), self.one()])

    def _do(self, begin: int) -> Node:
        parts = [self.one()]
        self.need("while")
        parts.append(self.head())
        self.take(";")
        return self.made("do", "", begin, parts)

    def _for(self, begin: int) -> Node:
        place = self.i
        self.need("(")
        self.modifiers()
        end = self.type_end(self.i)
        if end and self.is_name(end) and self.text[end + 1] == ":":
            first, kind = self.i, self.spelled(self.i, end)
            self.i = end
            variable = self.made("declare", self.word(), first, [], kind)
            self.need(":")
            over = self.expression()
            self.need(")")
            return self.made("foreach", "", begin, [variable, over, self.one()])
        parts, name = [], iter(("for_init", "for_test", "for_step"))
        for stop in (";", ";", ")"):
            first, own = self.i, []
            while not self.at(stop):
                end = self.type_end(self.i)
                own += self.declared(self.i) if end and self.is_name(end) else [self.expression()]
                if not self.take(","):
                    break
            parts.append(self.made(next(name), "", first, own))
            self.need(stop)
        if self.i != self.closed(place):
            raise Bad
        return self.made("for", "", begin, [*parts, self.one()])

    def _switch(self, begin: int) -> Node:
        parts = [self.head()]
        self.need("{")
        while self.at("case", "default"):
            place, word, labels = self.i, self.text[self.i], []
            self.i += 1
            while not self.at(":", "->", "}", "") and word == "case":
                self.in_label = True
                try:
                    labels.append(self.ternary())
                finally:
                    self.in_label = False
                if not self.take(","):
                    break
            if self.take("->"):
                inner = [self.one()]
                arrow = True
            else:
                self.need(":")
                inner, arrow = [], False
                while self.i < self.n and not self.at("case", "default", "}"):
                    inner += self.items_until_case()
            parts.append(self.made("case", "", place, [*labels, self.made("block", "", place, inner)], "default" if word == "default" else "arrow" if arrow else ""))
        self.take("}")
        return self.made("switch", "", begin, parts)

    def items_until_case(self) -> list[Node]:
        before = self.i
        out = self.item()
        if self.i == before:
            raise Bad
        return out

    def _try(self, begin: int) -> Node:
        parts: list[Node] = []
        if self.take("("):
            while not self.at(")"):
                first = self.i
                self.modifiers()
                end = self.type_end(self.i)
                parts += self.declared(first) if end and self.is_name(end) else [self.expression()]
                self.take(";")
            self.need(")")
        parts.append(self.block())
        while self.at("catch"):
            first = self.i
            self.i += 1
            self.need("(")
            self.modifiers()
            kinds = self.i
            self.i = self.type_end(self.i)
            while self.take("|"):
                self.i = self.type_end(self.i)
            kind = self.spelled(kinds, self.i)
            variable = self.made("declare", self.word(), kinds, [], kind)
            self.need(")")
            body = self.block()
            parts.append(self.made("catch", "", first, [variable, body], kind))
        if self.at("finally"):
            first = self.i
            self.i += 1
            body = self.block()
            parts.append(self.made("finally", "", first, [body]))
        return self.made("try", "", begin, parts)

    def _synchronized(self, begin: int) -> Node:
        return self.made("synchronized", "", begin, [self.head(), self.block()])

    def _leave(self, begin: int) -> Node:
        kind = self.text[begin]
        parts = [] if self.at(";", "}", "") else [self.expression()]
        while kind == "assert" and self.take(":"):
            parts.append(self.expression())
        self.take(";")
        return self.made(kind, "", begin, parts)

    _return = _throw = _yield = _assert = _leave

    def _jump(self, begin: int) -> Node:
        label = self.word() if self.is_name(self.i) else ""
        self.take(";")
        return self.made(self.text[begin], label, begin, [])

    _break = _continue = _jump

    # Expressions.

    def expression(self) -> Node:
        begin, left = self.i, self.ternary()
        op = self.operator(ASSIGNMENTS)
        return self.made("assign", "", begin, [left, self.value()], op) if op else left

    def operator(self, known: frozenset[str]) -> str:
        """Takes an operator of these; the signs of > are tokens of their own, as types end with them."""
        whole, i = self.text[self.i], self.i
        while whole and set(whole) == {">"} and self.text[i + 1] in (">", ">=", "=") and self.start_of(i + 1) == self.start_of(i) + 1:
            i += 1
            whole += self.text[i]
        if whole in known and self.kind[self.i] != "string":
            self.i = i + 1
            return whole
        return ""

    def start_of(self, i: int) -> int:
        return self.start[i] if i < self.n else -1

    def ternary(self) -> Node:
        begin, test = self.i, self.binary(0)
        if not self.take("?"):
            return test
        yes = self.expression()
        self.need(":")
        return self.made("ternary", "", begin, [test, yes, self.expression()])

    def binary(self, level: int) -> Node:
        begin, left = self.i, self.unary()
        while True:
            before = self.i
            op = self.operator(OPERATORS)
            if not op or BINDING[op] < level:
                self.i = before
                return left
            if op == "instanceof":
                self.modifiers()
                end = self.type_end(self.i)
                if not end:
                    raise Bad
                kind, self.i = self.spelled(self.i, end), end
                name = self.word() if self.is_name(self.i) else ""
                left = self.made("binary", name, begin, [left], f"instanceof {kind}")
            else:
                left = self.made("binary", "", begin, [left, self.binary(BINDING[op] + 1)], op)

    def unary(self) -> Node:
        begin = self.i
        if self.at("+", "-", "!", "~", "++", "--"):
            op = self.text[self.i]
            self.i += 1
            return self.made("unary", "", begin, [self.unary()], op)
        if self.at("(") and self.i in self.closing:
            end = self.type_end(self.i + 1)
            while end and self.text[end] == "&":
                end = self.type_end(end + 1)
            after = end + 1
            if end and self.text[end] == ")" and self.text[after] != "->":
                primitive = self.text[self.i + 1] in PRIMITIVES
                if primitive or self.kind[after] in ("string", "number") or self.text[after] in ("(", "!", "~") or (self.kind[after] == "word" and self.text[after] != "instanceof"):
                    kind, self.i = self.spelled(self.i + 1, end), after
                    return self.made("cast", "", begin, [self.unary()], kind)
        return self.postfix()

    def arguments(self) -> Node:
        begin = self.i
        self.need("(")
        return self.made("arguments", "", begin, self.listed(self.expression, ")"))

    def postfix(self) -> Node:
        begin, out = self.i, self.primary()
        while True:
            if self.at("."):
                self.i += 1
                if self.at("<"):
                    self.i = self.generic_end(self.i) or self.i
                if self.at("new"):
                    out = self.made("new", "", begin, [out, self.primary()])
                    continue
                if self.kind[self.i] != "word":
                    raise Bad
                name = self.text[self.i]
                self.i += 1
                out = self.made("call", name, begin, [out, self.arguments()]) if self.at("(") else self.made("access", name, begin, [out])
            elif self.at("["):
                self.i += 1
                if self.take("]"):  # an array's type, as in String[].class
                    continue
                inner = self.expression()
                self.need("]")
                out = self.made("index", "", begin, [out, inner])
            elif self.at("++", "--"):
                self.i += 1
                out = self.made("unary", "", begin, [out], self.text[self.i - 1])
            elif self.at("::"):
                self.i += 2
                out = self.made("reference", self.text[self.i - 1], begin, [out])
            else:
                return out

    def primary(self) -> Node:
        begin, t, kind = self.i, self.text[self.i], self.kind[self.i]
        if kind in ("string", "number") or t in LITERALS:
            self.i += 1
            return self.made("literal", t, begin, [])
        if t == "(":
            if self.text[self.closed(begin)] == "->" and not self.in_label:
                return self.lambda_(begin)
            self.i += 1
            out = self.expression()
            self.need(")")
            return out
        if t == "new":
            return self.new()
        if t == "switch":
            self.i += 1
            return self._switch(begin)
        if not self.is_name(begin):
            raise Bad
        if self.text[begin + 1] == "->" and not self.in_label:
            return self.lambda_(begin)
        self.i += 1
        if self.at("("):
            return self.made("call", t, begin, [self.arguments()])
        end = self.generic_end(self.i) if self.at("<") else 0
        if end and self.text[end] == "::":
            self.i = end
        return self.made("name", t, begin, [])

    def lambda_(self, begin: int) -> Node:
        names: list[Node] = []
        if self.at("("):
            try:
                names = self.parameters()
            except Bad:  # names without types
                self.i = begin + 1
                names = self.listed(lambda: Node("parameter", self.word(), self.i - 1, self.i, []), ")")
        else:
            names.append(Node("parameter", self.word(), begin, self.i, []))
        self.need("->")
        return self.made("lambda", "", begin, [*names, self.block() if self.at("{") else self.expression()])

    def new(self) -> Node:
        begin = self.i
        self.i += 1
        self.modifiers()
        place = self.i
        self.word()
        while self.at(".", "<"):
            self.i = self.generic_end(self.i) if self.at("<") else self.i + 2
            if not self.i:
                raise Bad
        kind, parts = self.spelled(place, self.i), []
        if self.at("["):
            while self.take("["):
                if not self.at("]"):
                    parts.append(self.expression())
                self.need("]")
            if self.at("{"):
                parts.append(self.array())
            return self.made("new", kind, begin, parts, "array")
        parts.append(self.arguments())
        if self.at("{"):
            parts += self.body()
        return self.made("new", kind, begin, parts)


STATEMENTS = frozenset(("if", "while", "do", "for", "switch", "try", "synchronized", "return", "throw", "yield", "assert", "break", "continue"))
OPERATORS = frozenset(BINDING)


class Tree:
    """The parsed file: its nodes in order, with their lines."""

    def __init__(self, code: str | None):
        code = code or ""
        self.code, self.parser = code, Parser(code)
        parser = self.parser
        self.starts = parser.start
        self.ends = [s + len(t) for s, t in zip(parser.start, parser.text, strict=False)]
        breaks = [m.start() for m in re.finditer("\n", code)]
        self.line, at = [], 0
        for s in parser.start:
            while at < len(breaks) and breaks[at] < s:
                at += 1
            self.line.append(at + 1)
        self.nodes: list[Node] = []
        self.top = parser.items()
        waiting = [(n, 0) for n in reversed(self.top)]
        while waiting:
            node, parent = waiting.pop()
            if node is None:
                continue
            self.nodes.append(node)
            node.number, node.parent = len(self.nodes), parent
            waiting += [(c, node.number) for c in reversed(node.children)]
        for node in reversed(self.nodes):
            node.last = max([node.number, *(c.last for c in node.children[-1:])])

    def rows(self) -> Iterator[tuple]:
        for n in self.nodes:
            yield n.number, n.last, n.parent, n.kind, n.name, n.detail, self.line[n.begin], self.starts[n.begin], self.ends[max(n.end - 1, n.begin)]


SCHEMA = "file_id string, node int, last int, parent int, kind string, name string, detail string, line int, begin int, end int"


def parsed(files: DataFrame, rows_of: Callable[[Tree], Iterator[tuple]], schema: str, id_: str = "file_id", code: str = "code") -> DataFrame:
    """What rows_of makes of each file's tree, behind the file's id."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[f.split()[1]] for f in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column("file_id").to_pylist(), batch.column("code").to_pylist(), strict=True):
                rows = [(i, *r) for r in rows_of(Tree(text))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    rows = files.select(F.col(id_).cast("string").alias("file_id"), F.col(code).alias("code"))
    # A call, a statement or a block takes one of these marks; text without them never leaves the JVM.
    return rows.where(F.col("code").rlike("[;{]")).mapInArrow(made, schema)


def tree(files: DataFrame, id_: str = "file_id", code: str = "code") -> DataFrame:
    """The nodes of files, a whole file in each row; begin and end are places of characters, from 0, of which end is the first after it."""
    return parsed(files, Tree.rows, SCHEMA, id_, code)


def within(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs of a node of outer and one of inner in its subtree, itself included: columns of outer, and of inner after `in_`."""
    told = inner.select(*[F.col(c).alias(f"in_{c}") for c in inner.columns])
    return outer.join(told, (F.col("file_id") == F.col("in_file_id")) & (F.col("in_node") >= F.col("node")) & (F.col("in_node") <= F.col("last")))


#: What the rules of the tree scan find, its weakness, and how sure they are.
TREE_RULES = (
    ("SQL_INJECTION", "CWE-89", "0.86"),
    ("COMMAND_INJECTION", "CWE-78", "0.88"),
    ("XSS", "CWE-79", "0.8"),
    ("PATH_TRAVERSAL", "CWE-22", "0.75"),
)


def tree_findings(nodes: DataFrame) -> DataFrame:
    """(file_id, node, line, vuln_type, cwe, confidence) of calls and constructions in nodes, as the tree scan judges them.

    A call counts with all that stands within it: its receiver, its arguments, and calls in these.  Each rule marks
    the nodes that tell, and the calls around a mark are found by the interval; two marks are asked of one call.
    """
    said = F.concat(F.col("name"), F.lit(" "), F.col("detail"))
    calls = nodes.where("kind = 'call'").select("file_id", "node", "last", "line")
    # A receiver is a call's first child, and what it is called on.
    receiver = nodes.where("kind = 'call'").select(F.col("file_id").alias("rf"), F.col("node").alias("rn"), F.col("parent").alias("rp"), F.col("name").alias("rname"), F.col("last").alias("rlast"))
    on = nodes.where("kind = 'call'").join(receiver, (F.col("file_id") == F.col("rf")) & (F.col("rp") == F.col("node")) & (F.col("rn") == F.col("node") + 1))
    empty = nodes.where("kind = 'arguments' and node = last").select(F.col("file_id").alias("ef"), F.col("parent").alias("ep"))
    chained = on.join(empty, (F.col("rf") == F.col("ef")) & (F.col("rn") == F.col("ep")), "left_semi")
    runtime = chained.where("rname = 'getRuntime' and name like 'exec%'").join(
        nodes.where("kind in ('name', 'access') and name = 'Runtime'").select(F.col("file_id").alias("nf"), F.col("node").alias("nn")), (F.col("file_id") == F.col("nf")) & (F.col("nn") == F.col("rn") + 1), "left_semi"
    )
    writer = chained.where("rname = 'getWriter' and (name like 'print%' or name like 'write%')")
    columns = ["file_id", "node"]
    marks = {
        "execute": nodes.where(said.contains("execute")).select(*columns),
        "plus": nodes.where("(kind in ('binary', 'unary', 'assign') and detail like '%+%') or (kind = 'literal' and name like '%+%')").select(*columns),
        "command": runtime.select(*columns).unionByName(nodes.where(said.contains("ProcessBuilder")).select(*columns)),
        "writer": writer.select(*columns),
    }

    def around(mark: str) -> DataFrame:
        return within(calls, marks[mark]).select("file_id", "node", "line").distinct()

    both = around("execute").join(around("plus").select("file_id", "node"), ["file_id", "node"], "left_semi")
    files = nodes.where("kind = 'new'").select("file_id", "node", "last", "line")
    inner = within(files, nodes.where("kind in ('new', 'call') and name like '%File' and detail = ''").select(*columns)).select("file_id", "node", "line").distinct()
    dots = within(files, nodes.where(F.col("name").contains("../") | F.col("name").contains("..\\")).select(*columns)).select("file_id", "node").distinct()
    found = {"SQL_INJECTION": both, "COMMAND_INJECTION": around("command"), "XSS": around("writer"), "PATH_TRAVERSAL": inner.join(dots, ["file_id", "node"], "left_semi")}
    out = None
    for kind, cwe, confidence in TREE_RULES:
        one = found[kind].select("file_id", "node", "line", F.lit(kind).alias("vuln_type"), F.lit(cwe).alias("cwe"), F.lit(float(confidence)).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out
