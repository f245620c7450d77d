"""Scans and point lookups. Each gives a DataFrame; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import Offset
from spanloom.model import ROOT, Store

HANDLES = {"annotations": ["a"], "resources": ["res"], "datasets": ["set"], "keys": ["set", "key"], "data": ["set", "data"], "substores": ["ss"], "textselections": ["res", "ts"]}
_TEMPORARY = {"annotations": "!A", "resources": "!R", "datasets": "!S", "keys": "!K", "data": "!D", "substores": "!I"}
_MEMBER = {"annotations": "annotation", "resources": "resource", "datasets": "dataset"}


def scan(store: Store, table: str) -> DataFrame:
    return getattr(store, table)


def without_substores(store: Store, table: str) -> DataFrame:
    """Items of the root store only (annotations, resources, datasets)."""
    members = store.substore_membership.filter((F.col("item_type") == _MEMBER[table]) & (F.col("ss") != ROOT)).select(F.col("item").alias(HANDLES[table][0]))
    return scan(store, table).join(members, HANDLES[table], "left_anti")


def substores(store: Store, nested: bool = False) -> DataFrame:
    """Substores of the root, or all of them."""
    return store.substores if nested else store.substores.filter(F.array_contains("parents", F.lit(ROOT)))


def lookup(store: Store, table: str, item: str | int, set_id: str | int | None = None) -> DataFrame:
    """The item with a handle, a public id or a temporary id (`!A12`), in a set if the table is keys or data."""
    df = scan(store, table)
    if set_id is not None:
        df = df.join(lookup(store, "datasets", set_id).select("set"), "set", "left_semi")
    handle = HANDLES[table][-1]
    if isinstance(item, int):
        return df.filter(F.col(handle) == item)
    prefix = _TEMPORARY.get(table)
    test = F.col("id") == item
    if prefix and item.startswith(prefix) and item[len(prefix) :].isdigit():
        test = F.coalesce(test, F.lit(False)) | (F.col(handle) == int(item[len(prefix) :]))
    return df.filter(test)


def resolve_ids(store: Store, table: str, ids: DataFrame) -> DataFrame:
    """ids (a column id) with the handle of each, null where nothing has that id."""
    temporary = F.concat(F.lit(_TEMPORARY[table]), F.col(HANDLES[table][-1]).cast("string"))
    known = scan(store, table).select(F.explode(F.array_compact(F.array("id", temporary))).alias("id"), *HANDLES[table])
    return ids.join(known, "id", "left")


def selection(store: Store, res: int, offset: Offset) -> DataFrame:
    """One span of a resource: res, begin, end and its handle ts, null if no annotation is on it; no row outside the text."""
    begin, end = offset.columns(F.col("textlen"))
    span = store.resources.filter(F.col("res") == res).select("res", begin.alias("begin"), end.alias("end")).filter("begin <= end")
    return span.join(store.textselections, ["res", "begin", "end"], "left")


def known(store: Store, spans: DataFrame) -> DataFrame:
    """spans (res, begin, end) with ts, null for those that no annotation is on."""
    return spans.join(store.textselections, ["res", "begin", "end"], "left")


def selections_in_range(store: Store, begin: int, end: int, by: str = "begin") -> DataFrame:
    """Known selections whose begin (or end) lies in [begin, end), in each resource."""
    return store.textselections.filter((F.col(by) >= begin) & (F.col(by) < end))


def positions(store: Store, mode: str = "both", begin: int | None = None, end: int | None = None) -> DataFrame:
    """Different positions (res, at) where known selections begin, end, or either."""
    sides = {"begin": ["begin"], "end": ["end"], "both": ["begin", "end"]}[mode]
    out = store.textselections.select("res", F.explode(F.array(*sides)).alias("at"))
    if begin is not None:
        out = out.filter(F.col("at") >= begin)
    if end is not None:
        out = out.filter(F.col("at") < end)
    return out.distinct()


def numbered(df: DataFrame, order: list[str], name: str = "n", within: list[str] | None = None) -> DataFrame:
    """df with the row's number from 0 in an order, within groups."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(within or [])).orderBy(*order)) - 1)
