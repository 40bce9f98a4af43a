"""Atom selections: a small boolean language that becomes a Column over the atoms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WATER = ("HOH", "WAT")
WORDS = re.compile(r"[()]|[^\s()]+")


class SelectionError(RuntimeError):
    pass


@dataclass(frozen=True)
class Atom:
    index: int
    name: str
    residue_name: str
    residue_index: int
    chain: str
    element: str
    mass_da: float = 0.0


@dataclass(frozen=True)
class Term:
    """A predicate in two forms: over an Atom on the driver and as a Column over the atoms table."""

    test: Callable[[Atom], bool]
    column: Column | None


def _hydrogen(atom: Atom) -> bool:
    if atom.element:
        return atom.element.upper() == "H"
    letters = [c for c in atom.name if c.isascii() and c.isalpha()]
    return bool(letters) and letters[0] in "hH"


class _Reader:
    """Precedence: or, and, not, then a term or parentheses."""

    def __init__(self, text: str, columns: bool):
        self.text, self.words, self.at, self.columns = text, WORDS.findall(text), 0, columns

    def fail(self, why: str) -> SelectionError:
        return SelectionError(f"Malformed selection '{self.text}': {why}")

    def peek(self) -> str:
        return self.words[self.at].lower() if self.at < len(self.words) else ""

    def take(self, what: str) -> str:
        if self.at >= len(self.words):
            raise self.fail(f"expected {what}")
        self.at += 1
        return self.words[self.at - 1]

    def column(self, make: Callable[[], Column]) -> Column | None:
        return make() if self.columns else None

    def chain(self, word: str, inner: Callable[[], Term], both: Callable) -> Term:
        left = inner()
        while self.peek() == word:
            self.at += 1
            left = both(left, inner())
        return left

    def any(self) -> Term:
        return self.chain("or", self.all, lambda a, b: Term(lambda x: a.test(x) or b.test(x), self.column(lambda: a.column | b.column)))

    def all(self) -> Term:
        return self.chain("and", self.negated, lambda a, b: Term(lambda x: a.test(x) and b.test(x), self.column(lambda: a.column & b.column)))

    def negated(self) -> Term:
        if self.peek() == "not":
            self.at += 1
            a = self.negated()
            return Term(lambda x: not a.test(x), self.column(lambda: ~a.column))
        return self.term()

    def term(self) -> Term:
        word = self.take("a selection term")
        if word == "(":
            inner = self.any()
            if self.take("')'") != ")":
                raise self.fail("expected ')'")
            return inner
        key = word.lower()
        if key == "protein":
            return Term(lambda x: x.residue_name not in WATER, self.column(lambda: ~F.col("residue_name").isin(*WATER)))
        if key == "hydrogen":
            letter = lambda: F.regexp_extract("name", "[A-Za-z]", 0)
            return Term(_hydrogen, self.column(lambda: F.when(F.col("element") != "", F.upper("element") == "H").otherwise(F.upper(letter()) == "H")))
        if key == "resid":
            low, high = self.residues(self.take("a residue number"))
            return Term(lambda x: low <= x.residue_index <= high, self.column(lambda: F.col("residue_index").between(low, high)))
        if key in ("name", "resname", "chain"):
            value = self.take(f"a value after '{word}'")
            field = {"name": "name", "resname": "residue_name", "chain": "chain"}[key]
            if key == "chain" and len(value) != 1:
                raise SelectionError(f"Chain selection expects one character: {value}")
            return Term(lambda x: getattr(x, field) == value, self.column(lambda: F.col(field) == value))
        raise self.fail(f"unknown term '{word}'")

    def residues(self, text: str) -> tuple[int, int]:
        ends = text.split(":")
        if len(ends) > 2 or not all(re.fullmatch(r"[+-]?\d+", e) for e in ends):
            raise SelectionError(f"Unknown residue selection: {text}")
        low, high = int(ends[0]), int(ends[-1])
        if low > high:
            raise SelectionError(f"Residue range start exceeds end: {text}")
        return low, high

    def whole(self) -> Term:
        out = self.any()
        if self.at < len(self.words):
            raise self.fail(f"unexpected '{self.words[self.at]}'")
        return out


def predicate(text: str) -> Column:
    """The selection as a boolean Column over a table of atoms."""
    return _Reader(text, True).whole().column


def resolve(text: str, atoms: Iterable[Atom]) -> list[int]:
    """The ascending indices of the atoms that a selection matches; none is an error."""
    term = _Reader(text, False).whole()
    found = sorted(a.index for a in atoms if term.test(a))
    if not found:
        raise SelectionError(f"Selection '{text}' matched zero atoms")
    return found
