"""Predicates on typed values.

An operator is a tuple of a name and arguments, built by the functions below and turned into a column by `test`. A pair
of operator and value type that isn't listed is false. Int and Float never compare with each other; strings that are
numbers do match numbers; Not is plain negation, so it holds for other types.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that equal true.
TRUTHY = ("yes", "1", "enable", "enabled", "on", "true")
COMPARISONS = {
    "eq": lambda a, b: a == b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}
_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_INSTANT = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"


def null():
    return ("null",)


def anything():
    return ("any",)


def equals(x):
    """Equal to a str, bool, int, float or datetime."""
    return compare("eq", x)


def compare(how: str, x):
    """how: eq, gt, ge, lt or le."""
    if isinstance(x, bool):
        return ("true",) if x else ("false",)
    if isinstance(x, str):
        return ("str", x)
    kind = "i" if isinstance(x, int) else "f" if isinstance(x, float) else "t" if isinstance(x, datetime) else None
    if kind is None:
        raise TypeError(f"no comparison with {x!r}")
    return ("cmp", kind, how, x)


def has_element(x):
    """A list with an element that equals x, or (x a str) a map with that key."""
    return ("has", x)


def get_index(i: int, op=None):
    return ("index", i, op)


def get_key(k: str, op=None):
    return ("key", k, op)


def negate(op):
    return ("not", op)


def both(*ops):
    return ("and", *ops)


def either(*ops):
    return ("or", *ops)


def _equals_text(v: Column, x: str) -> Column:
    kind = v["vtype"]
    number = F.lit(int(x)) == v["i"] if _is(x, _INT) and abs(int(x)) < 2**63 else F.lit(False)
    real = F.lit(float(x)) == v["f"] if _is(x, _FLOAT) else F.lit(False)
    instant = F.lit(datetime.fromisoformat(x.replace("Z", "+00:00").replace("z", "+00:00"))) == v["t"] if _is(x, _INSTANT) else F.lit(False)
    return (
        F.when(kind == "String", v["s"] == x)
        .when(kind == "Bool", v["b"] == F.lit(x.lower() in TRUTHY))
        .when(kind == "Int", number)
        .when(kind == "Float", real)
        .when(kind == "Datetime", instant)
        .otherwise(F.lit(False))
    )


def _is(x: str, pattern: str) -> bool:
    import re

    return re.match(pattern, x) is not None


#: Elements of lists and maps are one level of tagged JSON; deeper levels are JSON again.
_ITEM = "struct<`@type`: string, value: string>"


def element(item: Column) -> Column:
    """The value struct of a tagged JSON item, null for null."""
    kind, raw = item["@type"], item["value"]
    slot = lambda name, sql: F.when(kind == name, F.expr("null").cast(sql) if raw is None else raw.try_cast(sql))
    found = F.struct(
        kind.alias("vtype"),
        F.when(kind == "String", raw).alias("s"),
        slot("Bool", "boolean").alias("b"),
        slot("Int", "bigint").alias("i"),
        slot("Float", "double").alias("f"),
        slot("Datetime", "timestamp").alias("t"),
        F.lit(None).cast("string").alias("tz"),
        F.when(kind.isin("List", "Map"), raw).alias("j"),
    )
    return F.when(item.isNotNull() & kind.isNotNull(), found)


def items(v: Column) -> Column:
    """The elements of a list value."""
    return F.from_json(v["j"], f"array<{_ITEM}>")


def entries(v: Column) -> Column:
    """The entries of a map value."""
    return F.from_json(v["j"], f"map<string, {_ITEM}>")


def test(v: Column, op: tuple) -> Column:
    """Whether the value struct v passes op; never null."""
    name, *args = op
    kind = v["vtype"]
    if name == "null":
        out = kind == "Null"
    elif name == "any":
        return F.lit(True)
    elif name in ("true", "false"):
        out = (kind == "Bool") & (v["b"] == F.lit(name == "true"))
    elif name == "str":
        out = _equals_text(v, args[0])
    elif name == "cmp":
        slot, how, x = args
        out = (kind == {"i": "Int", "f": "Float", "t": "Datetime"}[slot]) & COMPARISONS[how](v[slot], F.lit(x))
    elif name == "has":
        x = args[0]
        listed = F.exists(items(v), lambda e: F.coalesce(test(element(e), equals(x)), F.lit(False)))
        out = F.when(kind == "List", listed)
        if isinstance(x, str):
            out = out.when(kind == "Map", F.map_contains_key(entries(v), F.lit(x)))
    elif name == "index":
        i, inner = args
        item = element(F.get(items(v), F.lit(i)))
        out = (kind == "List") & (F.lit(i >= 0)) & (item.isNotNull() if inner is None else item.isNotNull() & test(item, inner))
    elif name == "key":
        k, inner = args
        item = element(F.element_at(entries(v), F.lit(k)))
        out = (kind == "Map") & (item.isNotNull() if inner is None else item.isNotNull() & test(item, inner))
    elif name == "not":
        return ~test(v, args[0])
    elif name in ("and", "or"):
        out = F.lit(name == "and")
        for a in args:
            out = out & test(v, a) if name == "and" else out | test(v, a)
        return out
    else:
        raise ValueError(f"unknown operator {name}")
    return F.coalesce(out, F.lit(False))


def display(v: Column) -> Column:
    """The value as text: lists as `a, b`, maps as `k: v`, datetimes in RFC 3339, Null as `null`."""
    kind = v["vtype"]
    one = lambda e: F.coalesce(e["value"], F.lit(""))
    return (
        F.when(kind == "Null", F.lit("null"))
        .when(kind == "String", v["s"])
        .when(kind == "Bool", v["b"].cast("string"))
        .when(kind == "Int", v["i"].cast("string"))
        .when(kind == "Float", v["f"].cast("string"))
        .when(kind == "Datetime", F.concat(F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(v["t"], F.current_timezone()), F.coalesce(v["tz"], F.lit("+00:00"))), "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(v["tz"], F.lit("+00:00"))))
        .when(kind == "List", F.array_join(F.transform(items(v), one), ", "))
        .when(kind == "Map", F.array_join(F.transform(F.map_entries(entries(v)), lambda e: F.concat(e["key"], F.lit(": "), one(e["value"]))), ", "))
    )
