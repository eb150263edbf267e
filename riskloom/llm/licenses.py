"""Operator 2: licence scan by Aho-Corasick and a shunting-yard parser.

Texts become lines of lower-case words with one space between them; one automaton over all phrases
finds notice phrases and identifier tags at word borders in a single pass.  What follows an
identifier tag on its line is parsed as a licence expression of `and`, `or`, `with` and parentheses
(`with` binds tightest, then `and`) into postfix form, and evaluated against the licences that are
permitted; the identifiers of a well-formed expression are labels too.

Null and empty texts have no words.  A malformed expression gives no label and is not evaluated.
Rows that repeat are judged each on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, WORD, bounded_batches, chunks, joined, runs, table

#: Fixed: base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed: further notice phrases, their labels and how surely they are a notice.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc", "boost software license": "bsl",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "cc0 1 0": "cc0", "the unlicense": "unlicense", "zlib license": "zlib", "artistic license": "artistic",
}
#: Fixed: words that introduce a notice; a phrase near one is surer to be a grant than a mention.
GRANTS = ("licensed under", "released under", "distributed under", "under the terms of")
TAG = "spdx license identifier"
#: Fixed: the family of an identifier's beginning; the longest that fits counts.
FAMILIES = {
    "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "cc-by": "cc-by", "cc0": "cc0",
    "unlicense": "unlicense", "zlib": "zlib", "artistic": "artistic", "bsl": "bsl",
}
#: Licences that an expression may rest on.
PERMITTED = frozenset({"apache", "mit", "bsd", "isc", "cc0", "unlicense", "zlib", "bsl", "cc-by"})
#: Words between a grant and its phrase at most.
NEAR = 6
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of an identifier: its family's, else itself in lower case."""
    low = identifier.lower()
    return next((FAMILIES[k] for k in sorted(FAMILIES, key=len, reverse=True) if low.startswith(k)), low)


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the expression's tokens in postfix order, None if it is malformed.

    The expression ends at the first character that can't belong to it.
    """
    out: list[str] = []
    held: list[str] = []
    at, operand = 0, True  # operand: whether one must come now
    while match := _TOKEN.match(expression, at):
        token, low = match[1], match[1].lower()
        if low in _BINDS and not operand:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif token == "(" and operand:
            held.append(token)
        elif token == ")" and not operand and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif operand and token not in "()" and low not in _BINDS:
            out.append(token.rstrip(".:"))
            operand = False
        else:
            break  # the sentence goes on after a whole expression, or it is malformed
        at = match.end()
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(tokens: list[str], permitted: frozenset[str] = PERMITTED) -> tuple[bool, set[str]]:
    """Whether permitted licences satisfy a postfix expression, and its licences' labels."""
    stack: list[bool] = []
    names: list[str] = []
    labels = set()
    for i, token in enumerate(tokens):
        if token == "with":
            stack.pop()  # an exception only adds permissions
        elif token in _BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append((a and b) if token == "and" else (a or b))
        else:
            exception = i + 1 < len(tokens) and tokens[i + 1] == "with"
            names.append(token)
            stack.append(family(token) in permitted)
            if not exception:
                labels.add(family(token))
    return stack.pop(), labels


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for kind, phrases in enumerate((BASE, NOTICES, dict.fromkeys(GRANTS), {TAG: None})):
            for phrase in phrases:
                self.automaton.add_word(f" {phrase} ", (kind, phrase, phrase.count(" ") + 1))
        self.automaton.make_automaton()

    def scan(self, column: pa.Array) -> list[tuple]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, expression, permitted of each text."""
        data, offsets = joined(column)
        start, end = runs(WORD[data])
        begin = np.searchsorted(start, offsets)
        # A buffer of words alone: a space before each, and a newline between texts.
        size = end - start
        n = len(offsets) - 1
        place = np.cumsum(size + 1) - size + 2 * np.repeat(np.arange(n), np.diff(begin))
        flat = np.full(int(size.sum()) + len(size) + 2 * n + 1, 32, np.uint8)
        source = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        flat[np.repeat(place - np.cumsum(size) + size, size) + np.arange(size.sum())] = LOWER[data[source]]
        ends = np.cumsum(np.add.reduceat(np.append(size + 1, 0), np.minimum(begin[:-1], len(size))) * (np.diff(begin) > 0)) + 2 * np.arange(n)
        flat[ends + 1] = 10
        found: dict[int, list[tuple[int, int, str, int]]] = {}
        for at, (kind, phrase, words) in self.automaton.iter(flat.tobytes().decode("latin-1")):
            word = int(np.searchsorted(place, at - len(phrase)))
            text = int(np.searchsorted(begin, word, "right")) - 1
            found.setdefault(text, []).append((word - int(begin[text]), kind, phrase, words))
        count = np.diff(begin).tolist()
        out: list[tuple] = [(c, 0, None, None, "", "", 0.0, None, None) for c in count]
        for text, places in found.items():
            out[text] = (count[text], *self._judge(places, lambda w, t=text: data[end[begin[t] + w] : offsets[t + 1]]))
        return out

    def _judge(self, places: list[tuple[int, int, str, int]], rest) -> tuple:
        base = [(w, p) for w, kind, p, _ in places if kind == 0]
        grants = sorted(w for w, kind, _, _ in places if kind == 2)
        labels, base_labels = {BASE[p] for _, p in base}, {BASE[p] for _, p in base}
        doubt, expression, permitted = 1.0, None, None
        for w, kind, phrase, words in sorted(places):
            if kind < 2:
                labels.add(BASE[phrase] if kind == 0 else NOTICES[phrase])
                doubt *= 0.2 if any(0 <= w - g <= NEAR for g in grants) else 0.5
            elif kind == 3:
                line = rest(w + words - 1)
                line = line[: int(np.argmax(line == 10))] if (line == 10).any() else line
                tokens = postfix(line.tobytes().decode("utf-8", "replace").lstrip(": \t"))
                if tokens:
                    allowed, own = evaluate(tokens)
                    labels |= own
                    expression = expression or " ".join(tokens)
                    permitted = allowed if permitted is None else permitted and allowed
                    doubt *= 0.05
        starts = [w for w, _ in base]
        return len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 - doubt, expression, permitted


def license_scan(docs: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """id_, n_words, n_base, first_word, last_word, base_labels, labels, score, expression (the first
    identifier tag's, in postfix order) and permitted (whether all tags' expressions are) of every row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_).alias("_id"), F.col(text).alias("_text"))
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expression": pa.string(), "permitted": pa.bool_()}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for part in chunks(batch, "_text"):
                columns = zip(*scanner.scan(part.column("_text")), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], names=["_id", *kinds])

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, permitted boolean"
    return rows.mapInArrow(scanned, schema).withColumnRenamed("_id", id_)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
