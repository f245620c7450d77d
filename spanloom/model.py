"""The tables of stand-off annotation.

A Store is a set of DataFrames; there are no indices to keep, every reverse relation is a join. Ids are long handles that
are unique in their table (in their set for keys and data, in their resource for textselections); public ids are strings
and may be null. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VALUE = "struct<vtype: string, s: string, b: boolean, i: bigint, f: double, t: timestamp, tz: string, j: string>"
SCHEMAS = {
    "resources": "res bigint, id string, text string, textlen int, filename string",
    "textselections": "res bigint, ts bigint, begin int, end int",
    "datasets": "set bigint, id string, filename string",
    "keys": "set bigint, key bigint, id string",
    "data": f"set bigint, data bigint, id string, key bigint, value {VALUE}",
    "annotations": "a bigint, id string, complex string",
    "annotation_data": "a bigint, pos int, set bigint, data bigint",
    "targets": "a bigint, pos int, kind string, res bigint, ts bigint, begin int, end int, mode string, target_a bigint, set bigint, key bigint, data bigint",
    "substores": "ss bigint, id string, filename string, parents array<bigint>",
    "substore_membership": "ss bigint, item_type string, item bigint",
}
#: Kinds of targets. Complex selectors are several rows of targets and a name in annotations.complex.
TEXT, ANNOTATION, RESOURCE, DATASET, KEY, DATA = (f"{k}Selector" for k in ("Text", "Annotation", "Resource", "DataSet", "DataKey", "AnnotationData"))
MULTI, COMPOSITE, DIRECTIONAL = "MultiSelector", "CompositeSelector", "DirectionalSelector"
ROOT = -1


def value(kind: str, x: Column | None = None, tz: Column | None = None) -> Column:
    """A value struct of a kind: Null, String, Bool, Int, Float, Datetime, List or Map (the last two as tagged JSON)."""
    slot = {"String": "s", "Bool": "b", "Int": "i", "Float": "f", "Datetime": "t", "List": "j", "Map": "j"}.get(kind)
    kinds = {"s": "string", "b": "boolean", "i": "bigint", "f": "double", "t": "timestamp", "tz": "string", "j": "string"}
    parts = [F.lit(kind).alias("vtype")]
    for name, sql in kinds.items():
        filled = x if name == slot else tz if name == "tz" and tz is not None else F.lit(None)
        parts.append(filled.cast(sql).alias(name))
    return F.struct(*parts)


@dataclass(frozen=True)
class Store:
    """All tables; each operation that changes something returns a new Store."""

    resources: DataFrame
    textselections: DataFrame
    datasets: DataFrame
    keys: DataFrame
    data: DataFrame
    annotations: DataFrame
    annotation_data: DataFrame
    targets: DataFrame
    substores: DataFrame
    substore_membership: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Store:
        return Store(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})

    @staticmethod
    def names() -> list[str]:
        return [f.name for f in fields(Store)]

    @property
    def spark(self) -> SparkSession:
        return self.resources.sparkSession

    def with_tables(self, **tables: DataFrame) -> Store:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.names()}

    # Joins that nearly every operator needs.

    def named_data(self) -> DataFrame:
        """data with the ids of its set and key: set, data, id, key, value, set_id, key_id."""
        sets = self.datasets.select("set", F.col("id").alias("set_id"))
        keys = self.keys.select("set", "key", F.col("id").alias("key_id"))
        return self.data.join(keys, ["set", "key"]).join(sets, "set")

    def spans(self) -> DataFrame:
        """Text targets: a, pos, res, ts, begin, end."""
        return self.targets.filter(F.col("res").isNotNull() & F.col("begin").isNotNull()).select("a", "pos", "res", "ts", "begin", "end")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage, by checkpoint() in spark.checkpoint.dir; that survives lost executors.

    Where that is unset a folder of this machine does, if all tasks run on it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled_store(store: Store, *names: str) -> Store:
    """store with the tables of these names (all, if none is given) computed once and cut from their lineage."""
    return store.with_tables(**{name: settled(getattr(store, name)) for name in names or store.names()})


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, also set for checkpoints."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.spanloom.folder", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.spanloom.folder", folder)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


#: Rows of a range that is numbered by itself, about.
RANGE_ROWS = 1_000_000


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the row's number from 0 in an order, by ranges: no task takes all rows, also where many or all of them tie in the order, as those without an id do.

    Rows that tie are told apart by all their columns; rows that are equal in all are interchangeable.
    """
    stored = settled(df.withColumn("_tie", F.xxhash64(F.to_json(F.struct(*df.columns)))))
    parts = max(1, -(-stored.count() // RANGE_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    ranges = settled(stored.repartitionByRange(parts, *order, "_tie").withColumn("_p", F.spark_partition_id()))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranges.groupBy("_p").count().select("_p", before.alias("_before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order, "_tie")) - 1
    return ranges.withColumn("_place", place).join(F.broadcast(sizes), "_p").select(*df.columns, (F.col("_place") + F.col("_before")).alias(name))


def intern(spans: DataFrame) -> DataFrame:
    """textselections of spans (res, begin, end): the different ones, numbered in textual order in each resource."""
    ts = (F.row_number().over(Window.partitionBy("res").orderBy("begin", "end")) - 1).cast("long")
    return spans.select("res", "begin", "end").distinct().withColumn("ts", ts).select("res", "ts", "begin", "end")
