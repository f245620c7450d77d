"""Relations between spans, and arithmetic on offsets. All are column expressions on begin and end.

In relation(op, a, b, ...) the first span is the subject: `embeds` holds where b lies in a.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

RELATIONS = ("equals", "overlaps", "embeds", "embedded", "before", "after", "precedes", "succeeds", "samebegin", "sameend", "inset", "samerange")
#: The longest gap of white space that a search bridges; the pairwise test has no such limit.
GAP = 10


@dataclass(frozen=True)
class Relation:
    """A relation and its modifiers. whitespace: precedes and succeeds allow a gap of white space only."""

    op: str
    every: bool = False
    negate: bool = False
    limit: int | None = None
    whitespace: bool = True

    def __post_init__(self):
        if self.op not in RELATIONS:
            raise ValueError(f"unknown relation {self.op}")


def relation(r: Relation | str, ab: Column, ae: Column, bb: Column, be: Column, text: Column | None = None, gap: int | None = None) -> Column:
    """Whether a (ab, ae) stands in relation r to b (bb, be). text: the resource's, needed for gaps of white space."""
    r = Relation(r) if isinstance(r, str) else r

    def blank(begin: Column, end: Column) -> Column:
        if text is None or not r.whitespace:
            return F.lit(False)
        short = F.lit(True) if gap is None else end - begin <= gap
        return (end > begin) & short & F.substr(text, begin + 1, end - begin).rlike(r"^\s*$")

    near = lambda distance: F.lit(True) if r.limit is None else distance <= r.limit
    found = {
        "equals": lambda: (ab == bb) & (ae == be),
        "inset": lambda: (ab == bb) & (ae == be),
        "samerange": lambda: (ab == bb) & (ae == be),
        "overlaps": lambda: (bb < ae) & (be > ab),
        "embeds": lambda: (bb >= ab) & (be <= ae),
        "embedded": lambda: (ab >= bb) & (ae <= be) & near(ab - bb) & near(be - ae),
        "before": lambda: (ae <= bb) & near(bb - ae),
        "after": lambda: (ab >= be) & near(ab - be),
        "precedes": lambda: (bb == ae) | blank(ae, bb),
        "succeeds": lambda: (be == ab) | blank(be, ab),
        "samebegin": lambda: ab == bb,
        "sameend": lambda: ae == be,
    }[r.op]()
    return ~found if r.negate else found


def intersection(ab: Column, ae: Column, bb: Column, be: Column) -> Column:
    """The shared span as a struct, null where there is none."""
    begin, end = F.greatest(ab, bb), F.least(ae, be)
    return F.when(begin < end, F.struct(begin.alias("begin"), end.alias("end")))


def text_of(text: Column, begin: Column, end: Column) -> Column:
    return F.substr(text, begin + 1, end - begin)


def absolute(cursor: Column, length: Column, from_end: Column | bool) -> Column:
    """A cursor from the begin, or (not above 0) from the end, as a position; null outside the text."""
    at = F.when(F.lit(from_end) if isinstance(from_end, bool) else from_end, length + cursor).otherwise(cursor)
    return F.when((at >= 0) & (at <= length), at)


def relative(begin: Column, end: Column, cb: Column, ce: Column, mode: str = "BeginBegin") -> Column:
    """The offset of a span in its container: struct of begin and end in one of four alignments; null if not inside."""
    b = begin - cb if mode.startswith("Begin") else begin - ce
    e = end - cb if mode.endswith("Begin") else end - ce
    return F.when((begin >= cb) & (end <= ce), F.struct(b.alias("begin"), e.alias("end"), F.lit(mode).alias("mode")))


def resolve(begin: Column, end: Column, mode: Column, cb: Column, ce: Column) -> Column:
    """The absolute span of an offset in a container; null if it is not inside or ends before it begins."""
    b = F.when(mode.startswith("Begin"), cb + begin).otherwise(ce + begin)
    e = F.when(mode.endswith("Begin"), cb + end).otherwise(ce + end)
    return F.when((b >= cb) & (e <= ce) & (b <= e), F.struct(b.alias("begin"), e.alias("end")))


@dataclass(frozen=True)
class Offset:
    """Two cursors; a negative number or -0 counts from the end."""

    begin: int
    end: int
    begin_from_end: bool = False
    end_from_end: bool = False

    @property
    def mode(self) -> str:
        return ("End" if self.begin_from_end else "Begin") + ("End" if self.end_from_end else "Begin")

    def __len__(self) -> int:
        if self.begin_from_end != self.end_from_end:
            raise ValueError("the length depends on the text")
        return self.end - self.begin

    def shift(self, distance: int) -> Offset:
        moved = Offset(self.begin + distance, self.end + distance, self.begin_from_end, self.end_from_end)
        if not self.begin_from_end and moved.begin < 0 or self.end_from_end and moved.end > 0:
            raise ValueError("the offset leaves the text")
        return moved

    def columns(self, length: Column) -> tuple[Column, Column]:
        return absolute(F.lit(self.begin), length, self.begin_from_end), absolute(F.lit(self.end), length, self.end_from_end)

    @staticmethod
    def whole() -> Offset:
        return Offset(0, 0, False, True)

    @staticmethod
    def parse(s: str) -> Offset:
        """`b:e` or `b,e`; a part with a minus sign counts from the end, a missing end is the end of the text."""
        m = re.fullmatch(r"\s*(-?\d+)?\s*[:,]\s*(-?\d+)?\s*", s)
        if not m:
            raise ValueError(f"no offset: {s!r}")
        b, e = m[1] or "0", m[2] or "-0"
        return Offset(int(b), int(e), b.startswith("-"), e.startswith("-"))
