"""Interval joins inside resources, and relations between sets of spans.

A plain equi join on the resource compares all spans of a long text with all others. For relations whose spans must
touch, spans are first cut into bins of `width` code points: a pair of spans can only meet in a bin they both reach, and is
kept in the first such bin alone, so it comes out once. Bins are as wide as a relation reaches, so that a span is in a handful of them
whatever its limit. before, after and negated relations without a limit have no such bound; their pairs are joined on the resource, and are as many as they are.
Where only the related spans are asked for and not the pairs, the least and greatest begins and ends of a resource decide, and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import GAP, Relation, relation
from spanloom.model import Store

WIDTH = 256


def _bins(begin: Column, end: Column, width: int) -> Column:
    low = F.call_function("div", begin, F.lit(width))
    high = F.call_function("div", F.greatest(end, begin), F.lit(width))
    return F.sequence(F.greatest(low, F.lit(0).cast("long")), F.greatest(high, F.lit(0).cast("long")))


def reach(r: Relation) -> int | None:
    """How far from a span a related one can lie; None: anywhere in the text."""
    if r.negate or r.op in ("before", "after") and r.limit is None:
        return None
    if r.op in ("before", "after"):
        return r.limit
    return GAP if r.op in ("precedes", "succeeds") and r.whitespace else 0


def same_columns(r: Relation) -> list[str]:
    """What related spans have in common beside the resource; none for relations that are no equality."""
    if r.negate:
        return []
    return {"samebegin": ["begin"], "sameend": ["end"], "equals": ["begin", "end"], "inset": ["begin", "end"], "samerange": ["begin", "end"]}.get(r.op, [])


def join_related(left: DataFrame, right: DataFrame, r: Relation | str, resources: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """Pairs of left (res, begin, end, ...) and right in relation r; right's columns other than res get the prefix r_.

    resources (res, text) is needed for gaps of white space.
    """
    r = Relation(r) if isinstance(r, str) else r
    renamed = right.select("res", *[F.col(c).alias(f"r_{c}") for c in right.columns if c != "res"])
    if same := same_columns(r):  # an equi join
        keyed = renamed.withColumns({c: F.col(f"r_{c}") for c in same})
        return left.join(keyed, ["res", *same]).select(*left.columns, *[c for c in renamed.columns if c != "res"])
    far = reach(r)
    while far is not None and width < far:
        width *= 2
    gap = r.op in ("precedes", "succeeds") and r.whitespace and resources is not None
    if far is not None:
        one = left.withColumn("_bin", F.explode(_bins(F.col("begin") - far, F.col("end") + far, width)))
        two = renamed.withColumn("_bin", F.explode(_bins(F.col("r_begin"), F.col("r_end"), width)))
        pairs = one.join(two, ["res", "_bin"])
        first = F.call_function("div", F.greatest(F.col("begin") - far, F.col("r_begin"), F.lit(0)), F.lit(width))
        pairs = pairs.filter(F.col("_bin") == first).drop("_bin")
    else:
        pairs = left.join(renamed, "res")
    spans = [F.col(c) for c in ("begin", "end", "r_begin", "r_end")]
    if not gap:
        return pairs.filter(relation(r, *spans))
    # Only pairs with a gap look at the text.
    exact = Relation(r.op, r.every, r.negate, r.limit, whitespace=False)
    close = pairs.filter(F.abs(F.when(F.lit(r.op == "precedes"), spans[2] - spans[1]).otherwise(spans[0] - spans[3])) <= GAP) if not r.negate else pairs
    text = resources.select("res", F.col("text").alias("_text"))
    return close.join(text, "res").filter(relation(exact if r.negate and not r.whitespace else r, *spans, text=F.col("_text"), gap=GAP)).drop("_text")


def _extremes(spans: DataFrame) -> DataFrame:
    """res and for begin and end the least and the greatest, each with the next one that is of another span: a row per resource."""
    ways = {"low_begin": (F.min, "begin"), "high_begin": (F.max, "begin"), "low_end": (F.min, "end"), "high_end": (F.max, "end")}
    by = lambda c: F.struct(F.col(c).alias("at"), F.col("begin").alias("b"), F.col("end").alias("e"))
    first = spans.groupBy("res").agg(*[f(by(c)).alias(n) for n, (f, c) in ways.items()])
    other = lambda n: (F.col("begin") != F.col(f"{n}.b")) | (F.col("end") != F.col(f"{n}.e"))
    second = spans.join(first, "res").groupBy("res").agg(*[f(F.when(other(n), by(c))).alias(f"{n}_2") for n, (f, c) in ways.items()])
    return first.join(second, "res")


def _one_sided(r: Relation, b: Column, e: Column, low_begin: Column, high_begin: Column, low_end: Column, high_end: Column) -> Column | None:
    """Whether some span with these extremes stands in relation r to (b, e); None where extremes don't tell."""
    if not r.negate:
        return {"before": low_end <= b, "after": high_begin >= e}[r.op]
    far = (lambda x: F.lit(False)) if r.limit is None else (lambda x: x)
    limit = F.lit(r.limit or 0)
    same = (low_begin != b) | (high_begin != b) | (low_end != e) | (high_end != e)
    return {
        "equals": lambda: same,
        "inset": lambda: same,
        "samerange": lambda: same,
        "overlaps": lambda: (low_end <= b) | (high_begin >= e),
        "embeds": lambda: (high_begin > b) | (low_end < e),
        "embedded": lambda: (low_begin < b) | (high_end > e) | far((high_begin > b + limit) | (low_end < e - limit)),
        "before": lambda: (high_end > b) | far(low_end < b - limit),
        "after": lambda: (low_begin < e) | far(high_begin > e + limit),
        "samebegin": lambda: (low_begin != b) | (high_begin != b),
        "sameend": lambda: (low_end != e) | (high_end != e),
        # Beyond the longest gap and on the wrong side nothing is next to each other; what is nearer is looked at one by one.
        "precedes": lambda: (low_end != b) | (high_end != b) if not r.whitespace else (high_end > b) | (low_end < b - GAP),
        "succeeds": lambda: (low_begin != e) | (high_begin != e) if not r.whitespace else (low_begin < e) | (high_begin > e + GAP),
    }[r.op]()


def any_related(spans: DataFrame, candidates: DataFrame, r: Relation, resources: DataFrame | None = None) -> DataFrame:
    """The candidates (res, begin, end, ...) to which some other one of spans stands in relation r, which is before, after or negated. No pairs are made.

    Under equals, inset and samerange a candidate itself counts as one of spans.
    """
    own = spans.select("res", "begin", "end").distinct()
    itself = r.op in ("equals", "inset", "samerange")
    b, e = F.col("begin"), F.col("end")
    joined = candidates.join(_extremes(own), "res")

    def value(name: str) -> Column:
        best = F.col(name)
        return best["at"] if itself else F.when((best["b"] == b) & (best["e"] == e), F.col(f"{name}_2.at")).otherwise(best["at"])

    # A resource whose only span is the candidate has no other one: nulls, which no comparison passes.
    found = joined.filter(F.coalesce(_one_sided(r, b, e, *map(value, ("low_begin", "high_begin", "low_end", "high_end"))), F.lit(False))).select(candidates.columns)
    if not (r.negate and r.whitespace and r.op in ("precedes", "succeeds") and resources is not None):
        return found
    # The others have nothing but near spans on the right side: these are pairs within GAP, and some of them may have more than blanks between.
    rest = candidates.join(found.select("res", "begin", "end").distinct(), ["res", "begin", "end"], "left_anti")
    near = join_related(own, rest, Relation({"precedes": "before", "succeeds": "after"}[r.op], limit=GAP))
    near = near.filter((F.col("begin") != F.col("r_begin")) | (F.col("end") != F.col("r_end"))).join(resources.select("res", F.col("text").alias("_text")), "res")
    apart = near.filter(relation(r, b, e, F.col("r_begin"), F.col("r_end"), text=F.col("_text"), gap=GAP)).select("res", F.col("r_begin").alias("begin"), F.col("r_end").alias("end")).distinct()
    return found.unionByName(rest.join(apart, ["res", "begin", "end"], "left_semi").select(candidates.columns))


def related_text(store: Store, spans: DataFrame, r: Relation | str) -> DataFrame:
    """Known selections that stand in relation r to any of spans: res, ts, begin, end, different ones.

    A span itself is not among its related ones, except under equals.
    """
    r = Relation(r) if isinstance(r, str) else r
    own = spans.select("res", "begin", "end").distinct()
    if reach(r) is None:
        return any_related(own, store.textselections, r, store.resources).select("res", "ts", "begin", "end")
    pairs = join_related(own, store.textselections, r, store.resources)
    if r.op not in ("equals", "inset", "samerange"):
        pairs = pairs.filter((F.col("begin") != F.col("r_begin")) | (F.col("end") != F.col("r_end")))
    return pairs.select("res", F.col("r_ts").alias("ts"), F.col("r_begin").alias("begin"), F.col("r_end").alias("end")).distinct()


def members(spans: DataFrame, group: list[str]) -> DataFrame:
    """Sets of spans (group, res, begin, end) with their outer borders and sizes: group, res, n, first, last, spans.

    Borders are those of the leftmost and the rightmost member.
    """
    s = F.struct("begin", "end")
    return spans.select(*group, "res", "begin", "end").distinct().groupBy(*group, "res").agg(F.count("*").alias("n"), F.min("begin").alias("first"), F.max("end").alias("last"), F.min(s).alias("leftmost"), F.max(F.struct("end", "begin")).alias("rightmost"), F.array_sort(F.collect_list(s)).alias("spans"))


def set_related(subject: DataFrame, other: DataFrame, group: list[str], other_group: list[str], r: Relation, resources: DataFrame | None = None) -> DataFrame:
    """Pairs of sets (group, other_group) in one resource whose sets of spans stand in relation r.

    every unset: each member of the subject is in relation to some member of the other set (equals: and sizes agree). every
    set: to each member; for relations that look at one side only, to the border of the other set: precedes, samebegin: its leftmost
    begin; succeeds, sameend: its rightmost end; samerange: both borders. negate: the pairs of sets in one resource that aren't so.
    """
    a = members(subject, group)
    b = members(other, other_group).select("res", *[F.col(c).alias(f"o_{c}") for c in other_group], *[F.col(c).alias(f"o_{c}") for c in ("n", "first", "last", "spans")])
    both = a.join(b, "res")
    plain = Relation(r.op, limit=r.limit, whitespace=r.whitespace)
    text = None
    if resources is not None and r.whitespace and r.op in ("precedes", "succeeds"):
        both = both.join(resources.select("res", F.col("text").alias("_text")), "res")
        text = F.col("_text")
    pair = lambda x, y: relation(plain, x["begin"], x["end"], y["begin"], y["end"], text)
    outer = F.struct(F.col("o_first").alias("begin"), F.col("o_last").alias("end"))
    if r.op == "samerange":
        found = (F.col("first") == F.col("o_first")) & (F.col("last") == F.col("o_last"))
    elif r.every and r.op in ("precedes", "succeeds", "samebegin", "sameend"):
        mine = {"precedes": ("rightmost", "end"), "sameend": ("rightmost", "end"), "succeeds": ("leftmost", "begin"), "samebegin": ("leftmost", "begin")}[r.op][0]
        x = F.col(mine)
        found = relation(plain, x["begin"], x["end"], outer["begin"], outer["end"], text)
    elif r.every:
        found = F.forall("spans", lambda x: F.forall("o_spans", lambda y: pair(x, y)))
    else:
        found = F.forall("spans", lambda x: F.exists("o_spans", lambda y: pair(x, y)))
        if r.op == "equals":
            found = found & (F.col("n") == F.col("o_n"))
    return both.filter(~found if r.negate else found).select(*group, *[F.col(f"o_{c}") for c in other_group], "res").distinct()
