"""What the items of query rows say: their text, their JSON, the first value of annotations. All are joins over the rows of compiler.bindings.

Items are told by their type and handles, written as JSON, so that items of all types are looked up together, each different one once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.values import display
from spanloom.model import Store
from spanloom.operators import traversals
from spanloom.plans.compiler import HANDLES, bound_to
from spanloom.sources import includes, stores


def _items(rows: DataFrame, item: Column) -> DataFrame:
    """rows with item and what it is told by."""
    return rows.withColumn("_item", item).withColumn("_told", F.to_json("_item"))


def _of(items: DataFrame, kind: str) -> DataFrame:
    """The different items of a type: _told and their handles."""
    own = items.filter(F.col("_item.type") == kind)
    return own.select("_told", *[F.col("_item")[h].alias(h) for h in HANDLES[kind]]).distinct()


def _joined(items: DataFrame, found: list[DataFrame], name: str) -> DataFrame:
    told = reduce(lambda a, b: a.unionByName(b), [f.select("_told", name) for f in found])
    return items.join(told, "_told", "left").drop("_told", "_item")


def with_text(store: Store, rows: DataFrame, variable: str | None = None, last: bool = False, delimiter: str | None = None) -> DataFrame:
    """rows of bindings with text: that of the item in a variable, or of the first or last one. Null for items without a text and, unless there is a delimiter, for annotations on several spans."""
    items = _items(rows, bound_to(rows, variable, last))
    annotations = _of(items, "ANNOTATION")
    spans = traversals.selection_text(store, _of(items, "TEXT"))
    whole = _of(items, "RESOURCE").join(store.resources.select("res", F.coalesce("text", F.lit("")).alias("text")), "res")
    found = [annotations.join(traversals.annotation_text(store, annotations, delimiter), "a"), spans, whole]
    return _joined(items, found, "text")


def with_json(store: Store, rows: DataFrame, variable: str | None = None, last: bool = False) -> DataFrame:
    """rows of bindings with json: that of the item in a variable, or of the first or last one, in the exchange format."""
    items = _items(rows, bound_to(rows, variable, last))
    about = lambda kind, id: F.concat(F.lit(f'{{"@type":"{kind}","@id":'), includes.quoted(id))
    annotations = _of(items, "ANNOTATION").join(stores.json_annotations(store), "a")
    text = F.when(F.col("filename").isNull(), F.concat(F.lit(',"text":'), includes.quoted(F.coalesce("text", F.lit("")))))
    text = F.coalesce(text, F.concat(F.lit(',"@include":'), includes.quoted(F.col("filename"))))
    res = _of(items, "RESOURCE").join(store.resources, "res").withColumn("json", F.concat(about("TextResource", includes.named(F.col("id"), "R", "res")), text, F.lit("}")))
    sets = _of(items, "DATASET").join(stores.json_sets(store), "set")
    data = _of(items, "DATA").join(stores.json_data(store.named_data()), ["set", "data"]).withColumn("json", F.concat(F.lit('{"@type":"AnnotationData",'), F.expr("substring(json, 2)")))
    keys = _of(items, "KEY").join(store.keys, ["set", "key"]).withColumn("json", F.concat(about("DataKey", F.col("id")), F.lit("}")))
    cursor = lambda c: F.concat(F.lit('{"@type":"BeginAlignedCursor","value":'), F.col(c).cast("string"), F.lit("}"))
    offset = F.concat(F.lit(',"offset":{"@type":"Offset","begin":'), cursor("begin"), F.lit(',"end":'), cursor("end"), F.lit("}}"))
    spans = _of(items, "TEXT").join(store.resources.select("res", "id"), "res")
    spans = spans.withColumn("json", F.concat(F.lit('{"@type":"TextSelector","resource":'), includes.quoted(includes.named(F.col("id"), "R", "res")), offset))
    return _joined(items, [annotations, res, sets, data, keys, spans], "json")


def first_values(store: Store, annotations: DataFrame) -> DataFrame:
    """a, value, shown, text: the first value that annotations have, as a text of any type, and as a string if it is one. Annotations without data have none."""
    used = store.annotation_data.join(annotations.select("a").distinct(), "a", "left_semi")
    first = used.groupBy("a").agg(F.min_by(F.struct("set", "data"), "pos").alias("d")).select("a", "d.set", "d.data")
    found = first.join(store.data.select("set", "data", "value"), ["set", "data"])
    return found.select("a", "value", display(F.col("value")).alias("shown"), F.when(F.col("value.vtype") == "String", F.col("value.s")).alias("text"))
