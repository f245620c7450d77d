"""Set operations, slices, orders and counts of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.model import Store


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that are in b; a keeps its rows, b's columns have to be a's."""
    return a.join(b.distinct(), a.columns, "left_semi")


def contains_all(a: DataFrame, b: DataFrame) -> bool:
    return b.join(a, b.columns, "left_anti").isEmpty()


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def limit(df: DataFrame, begin: int, end: int, order: list[str | Column], within: list[str] | None = None) -> DataFrame:
    """A slice of df in an order, in each group of `within`.

    end 0 means to the end. begin < 0, end 0: the last -begin rows. begin >= 0, end < 0: without the last -end. Both
    negative: without the first -begin and the last -end. begin < 0, end > 0: the first end rows.
    """
    n = F.col("_n")
    if begin >= 0 and end == 0:
        low, high = F.lit(begin), n
    elif begin < 0 and end == 0:
        low, high = n + begin, n
    elif begin >= 0 and end < 0:
        low, high = F.lit(begin), n + end
    elif begin < 0 and end < 0:
        low, high = F.lit(-begin), n + end
    elif begin < 0:
        low, high = F.lit(0), F.lit(end)
    else:
        low, high = F.lit(begin), F.lit(end)
    needs_total = begin < 0 and end == 0 or end < 0
    if not within and not needs_total and not (begin == 0 and end == 0):
        first = df.orderBy(*order)  # the optimizer makes this a top-k
        return first.limit(end).offset(begin) if end > 0 and begin > 0 else first.limit(end) if end > 0 else first.offset(begin)
    if begin == 0 and end == 0:
        return df
    groups = within or []
    numbered = df.withColumn("_row", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1)
    if groups:
        numbered = numbered.withColumn("_n", F.count("*").over(Window.partitionBy(*groups)))
    else:
        numbered = numbered.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    return numbered.filter((F.col("_row") >= low) & (F.col("_row") < high)).drop("_row", "_n")


def textual_order(spans: DataFrame) -> DataFrame:
    return spans.dropDuplicates(["res", "begin", "end"]).orderBy("res", "begin", "end")


def annotations_in_textual_order(store: Store, annotations: DataFrame) -> DataFrame:
    """annotations with first and last, ordered by first begin and last end; those without text come last."""
    borders = store.spans().groupBy("a").agg(F.min("begin").alias("first"), F.max("end").alias("last"))
    return annotations.join(borders, "a", "left").orderBy(F.col("first").asc_nulls_last(), F.col("last").asc_nulls_last(), "a")


def borders(spans: DataFrame, group: list[str]) -> DataFrame:
    """Per group begin and end, and the leftmost and rightmost span."""
    return spans.groupBy(*group).agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min(F.struct("begin", "end")).alias("leftmost"), F.max_by(F.struct("begin", "end"), F.struct("end", "begin")).alias("rightmost"))


def counts(store: Store) -> DataFrame:
    """Number of rows by table: item, n."""
    out = None
    for name, df in store.tables().items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def annotations_per_data(store: Store) -> DataFrame:
    return store.annotation_data.groupBy("set", "data").agg(F.countDistinct("a").alias("n"))


#: So many data are sent to all tasks at most.
FEW = 100_000


def annotations_per_key(store: Store) -> DataFrame:
    """set, key and n, the number of annotations with data of the key.

    An annotation has one first datum (pos 0), so first data are counted where they are read, by datum. Only further data, and the first ones of keys that
    occur in these, can repeat an annotation and are told apart.
    """
    keys, used = store.data.select("set", "data", "key"), store.annotation_data.select("a", "pos", "set", "data")
    first, further = used.filter("pos = 0"), used.filter("pos <> 0")
    counted = first.groupBy("set", "data").agg(F.count("a").alias("n")).join(keys, ["set", "data"]).groupBy("set", "key").agg(F.sum("n").alias("n"))
    again = further.join(keys, ["set", "data"]).select("set", "key", "a").distinct()
    shared = keys.join(again.select("set", "key").distinct(), ["set", "key"], "left_semi")
    few = shared.limit(FEW + 1).count() <= FEW
    known = first.join(F.broadcast(shared) if few else shared, ["set", "data"]).select("set", "key", "a")
    added = again.join(known, ["set", "key", "a"], "left_anti").groupBy("set", "key").agg(F.count("a").alias("n"))
    return counted.unionByName(added).groupBy("set", "key").agg(F.sum("n").alias("n"))


def annotations_per_selection(store: Store) -> DataFrame:
    return store.spans().groupBy("res", "begin", "end").agg(F.countDistinct("a").alias("n"))


def selections_per_resource(store: Store) -> DataFrame:
    return store.textselections.groupBy("res").agg(F.count("*").alias("n"))


def selections_per_annotation(store: Store) -> DataFrame:
    """The number of targets with text; a simple target counts one."""
    return store.spans().groupBy("a").agg(F.count("*").alias("n"))


def index_counts(store: Store) -> DataFrame:
    """Entries of each reverse relation: relation, firsts (different left sides), entries."""
    t = store.targets
    relations = {
        "data_annotations": (store.annotation_data, ["set", "data"]),
        "selection_annotations": (store.spans(), ["res", "ts"]),
        "resource_metadata": (t.filter("kind = 'ResourceSelector'"), ["res"]),
        "dataset_metadata": (t.filter("kind = 'DataSetSelector'"), ["set"]),
        "annotation_annotations": (t.filter("target_a is not null"), ["target_a"]),
        "key_metadata": (t.filter("kind = 'DataKeySelector'"), ["set", "key"]),
        "data_metadata": (t.filter("kind = 'AnnotationDataSelector'"), ["set", "data"]),
        "key_data": (store.data, ["set", "key"]),
    }
    out = None
    for name, (df, on) in relations.items():
        one = df.agg(F.countDistinct(*on).alias("firsts"), F.count("*").alias("entries")).select(F.lit(name).alias("relation"), "firsts", "entries")
        out = one if out is None else out.unionByName(one)
    return out
