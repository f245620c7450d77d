"""Many regular expressions over texts: literals that a match can't do without decide where an expression runs at all.

Of each expression a set of literals is taken from its parse tree such that every match contains one of them. All sets together are one automaton, which walks
a text once. An expression runs only on texts in which one of its literals occurs; if it has a greatest width and doesn't look beyond its match, it runs only
on windows around these places. Expressions without such literals run on all texts. The matches are those of running every expression on every text.
"""

from __future__ import annotations

import re
import re._constants as codes
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alternatives that one expression is looked for by, and characters of a match that windows are cut for.
MOST_LITERALS, WIDEST = 64, 1024
#: So many literals are tested in the JVM before a text goes to Python.
JVM_LITERALS = 16
#: Letters that also match characters outside ASCII if case is ignored.
_FOLDED = set("iks")


@dataclass(frozen=True)
class Need:
    """Every match holds one of literals; with nocase they are in lower case and looked for in the lowered text."""

    literals: tuple[str, ...]
    nocase: bool


def _better(a: list[str] | None, b: list[str] | None) -> list[str] | None:
    """The set whose shortest literal is longer; of equals the smaller one."""
    rank = lambda x: (min(map(len, x)), -len(x))
    return max((x for x in (a, b) if x), key=rank, default=None)


def _needed(items, nocase: bool) -> list[str] | None:
    """A set of literals of which one is in every match of a sequence, or None."""
    best, run = None, ""

    def close() -> None:
        nonlocal best, run
        if run:
            best = _better(best, [run])
        run = ""

    for op, arg in items:
        if op is codes.LITERAL:
            c = chr(arg)
            if nocase and (not c.isascii() or c.lower() in _FOLDED):
                close()
            else:
                run += c.lower() if nocase else c
            continue
        if op is codes.SUBPATTERN:
            group, add, drop, inner = arg
            if not add and not drop and (sole := _sole(inner, nocase)) is not None:
                run += sole
                continue
            close()
            ignored = bool(add & re.IGNORECASE)
            if ignored == nocase or not (add or drop):
                best = _better(best, _needed(inner, nocase))
        elif op is codes.ATOMIC_GROUP:
            close()
            best = _better(best, _needed(arg, nocase))
        elif op is codes.BRANCH:
            close()
            sets = [_needed(x, nocase) for x in arg[1]]
            if all(sets) and sum(map(len, sets)) <= MOST_LITERALS:
                best = _better(best, sorted({y for x in sets for y in x}))
        elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
            close()
            if arg[0] > 0:
                best = _better(best, _needed(arg[2], nocase))
        elif op is codes.IN and (chars := _few(arg)) and not nocase:
            close()
            best = _better(best, chars)
        elif op is not codes.AT:  # a place has no width
            close()
    close()
    return best


def _sole(items, nocase: bool) -> str | None:
    """The text of a sequence of nothing but literals."""
    if nocase or any(op is not codes.LITERAL for op, _ in items):
        return None
    return "".join(chr(arg) for _, arg in items)


def _few(members) -> list[str] | None:
    """The characters of a small class."""
    if any(op is not codes.LITERAL for op, _ in members) or len(members) > 4:
        return None
    return [chr(arg) for _, arg in members]


def need(expression: str) -> Need | None:
    """What every match of expression contains, or None where nothing is sure."""
    tree = parser.parse(expression)
    nocase = bool(tree.state.flags & re.IGNORECASE)
    found = _needed(tree, nocase)
    return Need(tuple(found), nocase) if found else None


def _looks_around(items) -> bool:
    """Whether a match depends on what is beside it, or on the places of others."""
    for op, arg in items:
        if op in (codes.AT, codes.ASSERT, codes.ASSERT_NOT, codes.GROUPREF, codes.GROUPREF_EXISTS):
            return True
        inner = {codes.SUBPATTERN: lambda: [arg[3]], codes.BRANCH: lambda: arg[1], codes.ATOMIC_GROUP: lambda: [arg]}.get(op)
        if op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT):
            inner = lambda: [arg[2]]  # noqa: B023, E731
        if inner and any(map(_looks_around, inner())):
            return True
    return False


def reach_of(expression: str) -> int | None:
    """The greatest width of a match, where windows of twice that give the same matches as the whole text; None otherwise."""
    tree = parser.parse(expression)
    least, most = tree.getwidth()
    return int(most) if 0 < least and most <= WIDEST and not _looks_around(tree) else None


class Patterns:
    """Expressions, compiled with their automatons; made once in each task."""

    def __init__(self, expressions: list[str]):
        self.compiled = [re.compile(e) for e in expressions]
        self.reach = [reach_of(e) for e in expressions]
        needs = [need(e) for e in expressions]
        self.always = [i for i, n in enumerate(needs) if n is None]
        self.automatons = [(nocase, a) for nocase in (False, True) if (a := self._automaton(needs, nocase))]

    @staticmethod
    def _automaton(needs: list[Need | None], nocase: bool):
        by_literal: dict[str, list[int]] = {}
        for i, n in enumerate(needs):
            for literal in n.literals if n and n.nocase == nocase else ():
                by_literal.setdefault(literal, []).append(i)
        if not by_literal:
            return None
        automaton = ahocorasick.Automaton()
        for literal, users in by_literal.items():
            automaton.add_word(literal, (len(literal), users))
        automaton.make_automaton()
        return automaton

    def places(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Where literals of each expression that has some in text stand, by their ends."""
        found: dict[int, list[tuple[int, int]]] = {}
        for nocase, automaton in self.automatons:
            for last, (length, users) in automaton.iter(_lowered(text) if nocase else text):
                for i in users:
                    found.setdefault(i, []).append((last + 1 - length, last + 1))
        return found

    def matching(self, text: str) -> list[int]:
        """The expressions that match text anywhere, in order."""
        found = self.places(text)
        windows = lambda i: _windows(found[i], self.reach[i], len(text)) if i in found and self.reach[i] is not None else [(0, len(text))]
        return [i for i in sorted([*found, *self.always]) if any(self.compiled[i].search(text, low, high) for low, high in windows(i))]

    def matches(self, text: str) -> Iterator[tuple[int, re.Match]]:
        """(expression, match), by expression and then from left to right."""
        found = self.places(text)
        for i in sorted([*found, *self.always]):
            reach = self.reach[i]
            if i not in found or reach is None:
                yield from ((i, m) for m in self.compiled[i].finditer(text))
                continue
            for low, high in _windows(found[i], reach, len(text)):
                yield from ((i, m) for m in self.compiled[i].finditer(text, low, high))


def _lowered(text: str) -> str:
    """A-Z in lower case; all else keeps its place."""
    return text.translate(_LOWER) if not text.isascii() else text.lower()


_LOWER = {c: c + 32 for c in range(65, 91)}


def _windows(places: list[tuple[int, int]], reach: int, size: int) -> Iterator[tuple[int, int]]:
    """Stretches that hold every match with one of places in it, apart from each other."""
    low = high = None
    for begin, end in sorted(places):
        b, e = max(0, end - reach), min(size, begin + reach)
        if low is not None and b <= high:
            high = max(high, e)
            continue
        if low is not None:
            yield low, high
        low, high = b, e
    if low is not None:
        yield low, high


def may_match(text: Column, expressions: list[str]) -> Column | None:
    """A test in the JVM that is true for all texts that any expression matches; None where there is none that is cheap."""
    needs = [need(e) for e in expressions]
    if any(n is None or n.nocase for n in needs) or sum(len(n.literals) for n in needs) > JVM_LITERALS:
        return None
    tests = [F.contains(text, F.lit(x)) for x in sorted({x for n in needs for x in n.literals})]
    return reduce(lambda a, b: a | b, tests)
