"""The index of positions: where known selections begin and end, as stored tables that are read by range.

`points` has a row for each position of a resource that is in use, with how many selections begin and end there and its UTF-8 byte; `postings` has a row for each begin and each
end. Both are sorted by resource and position and written in that order, so that a lookup reads the row groups whose bounds hold it and no others, and a list of positions needs no
shuffle. Bytes come from milestones: a text is cut into pieces, each with the bytes before it, and a position is counted from the beginning of its piece only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.model import Store

#: Code points between two milestones.
MILESTONE = 2048
#: Rows of a range that is sorted by itself, about.
ROWS = 1_000_000
POINTS = "res bigint, at int, begins bigint, ends bigint, byte bigint"
POSTINGS = "res bigint, at int, side string, other int, ts bigint"


@dataclass(frozen=True)
class Positions:
    points: DataFrame
    postings: DataFrame


def milestones(resources: DataFrame, every: int = MILESTONE) -> DataFrame:
    """res, stone (from 0), piece and before: so many code points of a text and the bytes before them; behind a text stands an empty piece where it ends at a milestone."""
    cut = F.concat(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{every}}}"), F.lit(0)), F.array(F.lit("")))
    pieces = resources.select("res", F.posexplode(cut).alias("stone", "piece"))
    before = F.sum(F.octet_length("piece")).over(Window.partitionBy("res").orderBy("stone").rowsBetween(Window.unboundedPreceding, -1))
    return pieces.select("res", "stone", "piece", F.coalesce(before, F.lit(0)).cast("long").alias("before"))


def with_bytes(store: Store, points: DataFrame, every: int = MILESTONE) -> DataFrame:
    """points (res, at) with byte, the UTF-8 offset of each position."""
    stones = milestones(store.resources, every)
    stone = F.call_function("div", F.col("at"), F.lit(every)).cast("int")
    # A text that ends just at a milestone has its empty piece there; otherwise the empty piece is at a stone that no position asks for.
    found = points.withColumn("stone", stone).join(stones, ["res", "stone"])
    byte = F.col("before") + F.octet_length(F.expr(f"left(piece, at - stone * {every})"))
    return found.select(*points.columns, byte.cast("long").alias("byte"))


def index(store: Store, every: int = MILESTONE) -> Positions:
    """The index of all known selections, not stored yet. every: code points between two milestones."""
    side = lambda name, at, other: store.textselections.select("res", F.col(at).alias("at"), F.lit(name).alias("side"), F.col(other).alias("other"), "ts")
    postings = side("begin", "begin", "end").unionByName(side("end", "end", "begin"))
    count = lambda name: F.count_if(F.col("side") == name).alias(f"{name}s")
    points = postings.groupBy("res", "at").agg(count("begin"), count("end"))
    return Positions(with_bytes(store, points, every).select("res", "at", "begins", "ends", "byte"), postings)


def save(positions: Positions, path: str) -> None:
    """Both tables below path, each in the order of resource and position."""
    for name, df, more in (("points", positions.points, []), ("postings", positions.postings, ["side", "other"])):
        parts = max(1, -(-df.count() // ROWS))
        df.repartitionByRange(parts, "res", "at").sortWithinPartitions("res", "at", *more).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Positions:
    return Positions(spark.read.schema(POINTS).parquet(f"{path}/points"), spark.read.schema(POSTINGS).parquet(f"{path}/postings"))


def entry(positions: Positions, at: int, res: int | None = None) -> DataFrame:
    """What begins and ends at a position, of one resource or of each: res, side, other (the selection's other end), ts."""
    found = positions.postings.filter(F.col("at") == at)
    return (found if res is None else found.filter(F.col("res") == res)).select("res", "side", "other", "ts")


def used(positions: Positions, mode: str = "both", begin: int | None = None, end: int | None = None, res: int | None = None) -> DataFrame:
    """res and at: positions from begin up to end where selections begin, end, or either. Nothing is shuffled."""
    out = positions.points
    if mode != "both":
        out = out.filter(F.col(f"{mode}s") > 0)
    for test in ((F.col("at") >= begin) if begin is not None else None, (F.col("at") < end) if end is not None else None, (F.col("res") == res) if res is not None else None):
        out = out if test is None else out.filter(test)
    return out.select("res", "at")


def partial_counts(store: Store) -> DataFrame:
    """data: pairs of set and datum that annotations have; selections: pairs of resource and selection that annotations are on."""
    pairs = lambda df, name, *on: df.select(*on).distinct().agg(F.count("*").alias(name))
    data = pairs(store.annotation_data, "data", "set", "data")
    return data.crossJoin(pairs(store.spans().filter("ts is not null"), "selections", "res", "ts"))  # one row each
