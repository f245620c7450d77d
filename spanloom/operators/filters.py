"""Filters: semi joins of items with what they are related to. Every function keeps the columns of its input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import find
from spanloom.functions.values import test
from spanloom.model import ROOT, Store
from spanloom.operators import related, traversals


def in_collection(items: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Items whose handles are among wanted."""
    return items.join(wanted.select(*on).distinct(), on, "left_semi")


def all_or_nothing(items: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """items if each of wanted is among them, otherwise none."""
    missing = wanted.select(*on).distinct().join(items, on, "left_anti").agg(F.count("*").alias("_missing"))
    return items.crossJoin(F.broadcast(missing)).filter("_missing = 0").drop("_missing")  # one row on the right


def having(items: DataFrame, pairs: DataFrame, on: list[str], wanted: DataFrame, what: list[str], every: bool = False) -> DataFrame:
    """Items with a pair (on, what) to any of wanted, or to every one."""
    distinct = wanted.select(*what).distinct()
    found = pairs.select(*on, *what).distinct().join(distinct, what, "left_semi")
    if every:
        total = distinct.agg(F.count("*").alias("_total"))
        found = found.groupBy(*on).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(total)).filter("_n = _total")
    return items.join(found.select(*on).distinct(), on, "left_semi")


# Annotations.


def annotations_with_data(store: Store, annotations: DataFrame, data: DataFrame, every: bool = False) -> DataFrame:
    return having(annotations, store.annotation_data, ["a"], data, ["set", "data"], every)


def annotations_with_key(store: Store, annotations: DataFrame, keys: DataFrame) -> DataFrame:
    return in_collection(annotations, traversals.key_annotations(store, keys), ["a"])


def annotations_with_value(store: Store, annotations: DataFrame, op: tuple, keys: DataFrame | None = None) -> DataFrame:
    """Annotations with data whose value passes op, of any key or of keys."""
    data = store.data.filter(test(F.col("value"), op))
    if keys is not None:
        data = in_collection(data, keys, ["set", "key"])
    return annotations_with_data(store, annotations, data)


def annotations_with_set(store: Store, annotations: DataFrame, sets: DataFrame) -> DataFrame:
    return in_collection(annotations, in_collection(store.annotation_data, sets, ["set"]), ["a"])


def annotations_on_resource(store: Store, annotations: DataFrame, resources: DataFrame, metadata: bool = False) -> DataFrame:
    return in_collection(annotations, traversals.resource_annotations(store, resources, metadata), ["a"])


def annotations_on_selections(store: Store, annotations: DataFrame, spans: DataFrame) -> DataFrame:
    return in_collection(annotations, traversals.selection_annotations(store, spans), ["a"])


def annotations_targeting(store: Store, annotations: DataFrame, others: DataFrame, transitive: bool = False) -> DataFrame:
    """Annotations that target any of others."""
    pairs = traversals.annotation_targets(store, annotations, transitive)
    return in_collection(annotations, in_collection(pairs, others.select(F.col("a").alias("target_a")), ["target_a"]), ["a"])


def annotations_targeted_by(store: Store, annotations: DataFrame, others: DataFrame, transitive: bool = False) -> DataFrame:
    """Annotations in the targets of others."""
    pairs = traversals.annotation_targets(store, others, transitive)
    return in_collection(annotations, pairs.select(F.col("target_a").alias("a")), ["a"])


def _overlaps_itself(text: str) -> bool:
    """Whether two occurrences of text can overlap: it ends as it begins."""
    return any(text.startswith(text[-n:]) for n in range(1, len(text)))


def annotations_with_text(store: Store, annotations: DataFrame, text: str, case_sensitive: bool = True, delimiter: str = " ") -> DataFrame:
    """Annotations whose joined text equals text.

    Where the text's occurrences can't overlap they are found once, and annotations with one span are joined to them by place; nothing is cut out of texts for them.
    """
    same = F.col("text") == text if case_sensitive else F.lower("text") == text.lower()
    if not case_sensitive or not text or _overlaps_itself(text):
        texts = traversals.annotation_text(store, annotations, delimiter, len(text) if case_sensitive else None)
        return in_collection(annotations, texts.filter(same), ["a"])
    several = store.spans().filter("pos > 0").select("a").distinct()
    spans = traversals.annotation_selections(store, annotations).filter(F.col("end") - F.col("begin") == len(text))
    places = find(store.resources.select("res", "text"), text).select("res", "begin")
    single = spans.join(several, "a", "left_anti").join(places, ["res", "begin"], "left_semi").select("a")
    joined = traversals.annotation_text(store, annotations.select("a").join(several, "a", "left_semi"), delimiter).filter(same).select("a")
    return in_collection(annotations, single.unionByName(joined), ["a"])


def annotations_matching(store: Store, annotations: DataFrame, regex: str, delimiter: str = " ") -> DataFrame:
    return in_collection(annotations, traversals.annotation_text(store, annotations, delimiter).filter(F.col("text").rlike(regex)), ["a"])


def annotations_related(store: Store, annotations: DataFrame, spans: DataFrame, relation) -> DataFrame:
    """Annotations with a span to which one of spans stands in relation."""
    own = traversals.annotation_selections(store, annotations)
    found = related.join_related(spans.select("res", "begin", "end").distinct(), own.select("res", "begin", "end", "a").distinct(), relation, store.resources)
    return in_collection(annotations, found.select(F.col("r_a").alias("a")), ["a"])


def in_substore(store: Store, items: DataFrame, handle: str, item_type: str, ss: int | None) -> DataFrame:
    """Items (annotation, resource or dataset) of a substore, or (None) of none."""
    found = store.substore_membership.filter((F.col("item_type") == item_type) & (F.col("ss") != ROOT))
    if ss is None:
        return items.join(found.select(F.col("item").alias(handle)), handle, "left_anti")
    return items.join(found.filter(F.col("ss") == ss).select(F.col("item").alias(handle)), handle, "left_semi")


# Selections.


def selections_with_annotations(store: Store, spans: DataFrame, annotations: DataFrame) -> DataFrame:
    """Spans on which one of annotations is."""
    on = ["res", "begin", "end"]
    return spans.join(store.spans().join(annotations.select("a"), "a", "left_semi").select(*on).distinct(), on, "left_semi")


def selections_with_data(store: Store, spans: DataFrame, data: DataFrame, every: bool = False) -> DataFrame:
    on = ["res", "begin", "end"]
    used = store.annotation_data.join(data.select("set", "data").distinct(), ["set", "data"], "left_semi")
    return having(spans, store.spans().join(used, "a"), on, data, ["set", "data"], every)


def selections_with_key(store: Store, spans: DataFrame, keys: DataFrame, op: tuple | None = None) -> DataFrame:
    """Spans annotated with data of any of keys (set, key), whose value passes op."""
    return selections_with_data(store, spans, data_of(store, keys, op))


def selections_with_value(store: Store, spans: DataFrame, op: tuple) -> DataFrame:
    return selections_with_data(store, spans, data_with_value(store.data, op))


def selections_with_set(store: Store, spans: DataFrame, sets: DataFrame) -> DataFrame:
    """Spans annotated with data of any of sets."""
    return selections_with_data(store, spans, in_collection(store.data, sets, ["set"]))


def selections_with_text(store: Store, spans: DataFrame, text: str, case_sensitive: bool = True) -> DataFrame:
    texts = traversals.selection_text(store, spans)
    return texts.filter(F.col("text") == text if case_sensitive else F.lower("text") == text.lower()).drop("text")


def selections_matching(store: Store, spans: DataFrame, regex: str) -> DataFrame:
    return traversals.selection_text(store, spans).filter(F.col("text").rlike(regex)).drop("text")


# Resources, data, keys.


def resources_with_data(store: Store, resources: DataFrame, data: DataFrame, metadata: bool = False, every: bool = False) -> DataFrame:
    """Resources annotated with data on their text, or as a whole."""
    by = store.annotation_data.select("a", "set", "data").join(data.select("set", "data").distinct(), ["set", "data"], "left_semi")
    pairs = by.join(traversals.annotation_resources(store, by, metadata, transitive=False), "a")
    return having(resources, pairs, ["res"], data, ["set", "data"], every)


def resources_with_key(store: Store, resources: DataFrame, keys: DataFrame, op: tuple | None = None, metadata: bool = False) -> DataFrame:
    """Resources annotated, on their text or as a whole, with data of any of keys (set, key), whose value passes op."""
    return resources_with_data(store, resources, data_of(store, keys, op), metadata)


def resources_with_value(store: Store, resources: DataFrame, op: tuple, metadata: bool = False) -> DataFrame:
    return resources_with_data(store, resources, data_with_value(store.data, op), metadata)


def resources_with_set(store: Store, resources: DataFrame, sets: DataFrame, metadata: bool = False) -> DataFrame:
    """Resources annotated with data of any of sets."""
    return resources_with_data(store, resources, in_collection(store.data, sets, ["set"]), metadata)


def resources_with_annotations(store: Store, resources: DataFrame, annotations: DataFrame, metadata: bool = False) -> DataFrame:
    return in_collection(resources, traversals.annotation_resources(store, annotations, metadata, transitive=False), ["res"])


def data_of(store: Store, keys: DataFrame, op: tuple | None = None) -> DataFrame:
    """The data of keys whose value passes op."""
    data = in_collection(store.data, keys, ["set", "key"])
    return data if op is None else data_with_value(data, op)


def data_with_value(data: DataFrame, op: tuple) -> DataFrame:
    return data.filter(test(F.col("value"), op))


def data_of_annotations(store: Store, data: DataFrame, annotations: DataFrame) -> DataFrame:
    return in_collection(data, traversals.annotation_data(store, annotations), ["set", "data"])


def keys_of_annotations(store: Store, keys: DataFrame, annotations: DataFrame) -> DataFrame:
    return in_collection(keys, traversals.annotation_keys(store, annotations), ["set", "key"])


def any_of(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """The handles in any of frames."""
    return reduce(lambda a, b: a.union(b), [f.select(*on) for f in frames]).distinct()
