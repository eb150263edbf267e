"""A small algebra of text predicates.

A rule is a tree of `has` (any literal occurs), `matches` (a regular expression is found), `all_of`,
`any_of` and `negated`.  `column` compiles it to one Catalyst expression, so a bank of rules is a
single projection in generated code; `sql` renders the same tree as SQL text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule:
    def __and__(self, other: Rule) -> Rule:
        return Both("AND", (self, other))

    def __or__(self, other: Rule) -> Rule:
        return Both("OR", (self, other))

    def __invert__(self) -> Rule:
        return Negated(self)


@dataclass(frozen=True)
class Has(Rule):
    words: tuple[str, ...]
    subject: str

    def column(self, subjects: dict[str, Column]) -> Column:
        return reduce(Column.__or__, (subjects[self.subject].contains(F.lit(w)) for w in self.words))

    def sql(self, subjects: dict[str, str]) -> str:
        return "(" + " OR ".join(f"contains({subjects[self.subject]}, {quoted(w)})" for w in self.words) + ")"


@dataclass(frozen=True)
class Matches(Rule):
    patterns: tuple[str, ...]
    subject: str
    ignore_case: bool
    needs: tuple[str, ...] = ()

    def _patterns(self) -> list[str]:
        return [("(?i)" if self.ignore_case else "") + p for p in self.patterns]

    def column(self, subjects: dict[str, Column]) -> Column:
        found = reduce(Column.__or__, (subjects[self.subject].rlike(p) for p in self._patterns()))
        return Has(self.needs, self.subject).column(subjects) & found if self.needs else found

    def sql(self, subjects: dict[str, str]) -> str:
        return "(" + " OR ".join(f"regexp_matches({subjects[self.subject]}, {quoted(p)})" for p in self._patterns()) + ")"


@dataclass(frozen=True)
class Both(Rule):
    word: str
    parts: tuple[Rule, ...]

    def column(self, subjects: dict[str, Column]) -> Column:
        return reduce(Column.__and__ if self.word == "AND" else Column.__or__, (p.column(subjects) for p in self.parts))

    def sql(self, subjects: dict[str, str]) -> str:
        return "(" + f" {self.word} ".join(p.sql(subjects) for p in self.parts) + ")"


@dataclass(frozen=True)
class Negated(Rule):
    part: Rule

    def column(self, subjects: dict[str, Column]) -> Column:
        return ~self.part.column(subjects)

    def sql(self, subjects: dict[str, str]) -> str:
        return f"(NOT {self.part.sql(subjects)})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(*words: str, subject: str = "code") -> Rule:
    return Has(words, subject)


def matches(*patterns: str, subject: str = "code", ignore_case: bool = False, needs: tuple[str, ...] = ()) -> Rule:
    """needs: literals of which every match holds one; a text without any is told by them, before any regular expression."""
    return Matches(patterns, subject, ignore_case, needs)


def without_class_lines(code: Column) -> Column:
    """The code without the lines that declare a class."""
    return F.array_join(F.filter(F.split(code, "\n"), lambda x: ~(F.ltrim(x).startswith("public class") | F.ltrim(x).startswith("class"))), "\n")


def subjects(code: Column) -> dict[str, Column]:
    return {"code": code, "lower": F.lower(code), "body": without_class_lines(code)}


SQL_SUBJECTS = {
    "code": "code",
    "lower": "lower(code)",
    "body": "array_to_string(list_filter(string_split(code, chr(10)), lambda x: NOT (starts_with(ltrim(x), 'public class') OR starts_with(ltrim(x), 'class'))), chr(10))",
}
