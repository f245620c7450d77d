"""Reading large JSON documents by byte ranges: the items of a document's top-level arrays, whatever their layout in lines.

A document is an object whose fields may be arrays of objects, the items. Objects inside fields that are objects themselves have the field "". Spark's text reader cuts files into ranges and gives each task the stretches
that end in `}` (`lineSep`), so a range begins at a brace; from there nobody knows whether it is inside a string or how deep. A first pass finds for each range
what it does to a reader that starts outside a string, and to one that starts inside: a row per range. Following these rows through each file gives the state at each range's start. The second
pass then cuts out the items; one that runs over a border is put together from its parts. Both passes read from any file system that Spark reads.

A directory of part files is one document, whose parts are read as if they followed each other; parts must end in a brace. Files that are compressed are one range each. No task holds more than a batch of stretches and an item, and a string without braces is one stretch.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.model import settled

#: Ranges whose states are sent to all tasks; larger ranges are needed beyond.
MOST_RANGES = 1 << 20
_ESCAPED = re.compile(r"\\.", re.DOTALL)
_MARK = re.compile(r'[{}\[\]"]')
_STRING = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$')
#: Levels around an item: the document and the array.
_OUTER = 2


@contextmanager
def _ranges_of(spark: SparkSession, size: int | None):
    """Files are cut into ranges of size bytes in what runs inside, if it is given."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        if size:
            for n in names:
                spark.conf.set(n, str(size))
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plain_uri(path: Column) -> Column:
    """A path with one slash behind its scheme, as different parts of Spark give different numbers of them."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def _stretches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value (up to a brace, without it), file (or the directory of part files that make it up) and range (part file and first byte), in order within each range."""
    rows = spark.read.option("lineSep", "}").text(path)
    whole, part = F.col("_metadata.file_path"), F.regexp_extract("_metadata.file_path", r"/(part-[^/]*)$", 1)
    file = F.when(part != "", F.regexp_replace(whole, "/[^/]*$", "")).otherwise(whole)
    return rows.select("value", plain_uri(file).alias("file"), F.concat(part, F.lit(":"), F.lpad(F.hex("_metadata.file_block_start"), 16, "0")).alias("range"))


def _change(stretch: str, inside: bool) -> tuple[bool, int]:
    """Whether a reader is inside a string behind stretch and its brace, and how much deeper."""
    parts = (_ESCAPED.sub("", stretch) if "\\" in stretch else stretch).split('"')
    outside = "".join(parts[1::2] if inside else parts[0::2])
    ends_inside = inside ^ (len(parts) % 2 == 0)
    return ends_inside, outside.count("{") + outside.count("[") - outside.count("]") - outside.count("}") - (not ends_inside)


def _effects(stretches: DataFrame) -> DataFrame:
    """file, range and for a start outside and inside a string: the end (0 outside, 1 inside) and the change of depth."""

    def run(batches):
        at, states = None, None
        for batch in batches:
            for value, file, begin in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (file, begin) != at:
                    if at:
                        yield row(at, states)
                    at, states = (file, begin), [(False, 0), (True, 0)]
                for k, (inside, depth) in enumerate(states):
                    inside, more = _change(value, inside)
                    states[k] = (inside, depth + more)
        if at:
            yield row(at, states)

    def row(at, states):
        columns = {"file": [at[0]], "range": pa.array([at[1]], pa.string())}
        for k, (inside, depth) in enumerate(states):
            columns |= {f"end{k}": pa.array([int(inside)], pa.int32()), f"depth{k}": pa.array([depth], pa.int64())}
        return pa.RecordBatch.from_pydict(columns)

    return stretches.mapInArrow(run, "file string, range string, end0 int, depth0 long, end1 int, depth1 long")


def _starts(effects: DataFrame) -> DataFrame:
    """file, range, inside and depth: the state at each range's start. A row per range, each file in one task."""

    def run(batches):
        at, inside, depth = None, 0, 0
        for batch in batches:
            rows = batch.to_pylist()
            out = {"file": [], "range": [], "inside": [], "depth": []}
            for r in rows:
                if r["file"] != at:
                    at, inside, depth = r["file"], 0, 0
                for name, v in zip(out, (at, r["range"], inside, depth), strict=True):
                    out[name].append(v)
                inside, depth = r[f"end{inside}"], depth + r[f"depth{inside}"]
            yield pa.RecordBatch.from_pydict({"file": pa.array(out["file"], pa.string()), "range": pa.array(out["range"], pa.string()), "inside": pa.array(out["inside"], pa.int32()), "depth": pa.array(out["depth"], pa.int64())})

    return effects.repartition("file").sortWithinPartitions("file", "range").mapInArrow(run, "file string, range string, inside int, depth long")


class _Cutter:
    """Cuts one range into pieces: (kind, field, text). Kinds: item, head and tail (of items over a border), frame (what is around the items)."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth, self.field = inside, depth, None
        self.parts: list[str] = []
        self.kind = "head" if depth > _OUTER else "frame"
        self.frame = ""

    def feed(self, stretch: str):
        if self.kind != "frame":
            self.parts.append(stretch + "}")
            self.inside, more = _change(stretch, self.inside)
            self.depth += more
            if not self.inside and self.depth <= _OUTER:
                yield self._close()
            return
        at, low = self._string(stretch, 0) if self.inside else 0, 0
        while at is not None and (m := _MARK.search(stretch, at)):
            at, c = m.end(), m[0]
            if c == '"':
                at = self._string(stretch, at)
            elif c in "]}":
                self.depth -= 1
            elif self.depth < _OUTER:
                if self.depth == _OUTER - 1:
                    known = _KEY.search(self.frame + stretch[low : m.start()])
                    self.field = known[1] if known and c == "[" else ""
                self.depth += 1
            elif c == "[":
                raise ValueError("an array of arrays is no list of items")
            else:
                self.frame += stretch[low : m.start()].strip(" \t\r\n,")
                self.inside, more = _change(stretch[m.start() :], False)
                self.depth += more
                self.kind, self.parts = "item", [stretch[m.start() :] + "}"]
                if not self.inside and self.depth <= _OUTER:
                    yield self._close()
                return
        if at is None or self.depth > 0:
            self.frame += stretch[low:] + "}"
        if at is not None:
            self.depth -= 1

    def _string(self, stretch: str, at: int) -> int | None:
        """Where the string ends that at is inside of; None behind stretch."""
        end = _STRING.match(stretch, at)
        self.inside = end is None
        return end.end() if end else None

    def _close(self):
        kind, field, text = self.kind, self.field, "".join(self.parts)
        self.kind, self.parts = "frame", []
        return kind, field, text

    def finish(self):
        if self.parts:
            yield ("tail" if self.kind == "item" else "head"), self.field, "".join(self.parts)
        yield "frame", self.field, re.sub(r"(?<=[\[,])[\s,]+|^[\s,]+|[\s,]+(?=\])", "", self.frame)


def _pieces(stretches: DataFrame) -> DataFrame:
    """Of stretches with the state at their range's start: file, range, n, kind, field, text."""

    def run(batches):
        at, cutter, n, out = None, None, 0, []

        def batch_of(rows):
            names = ("file", "range", "n", "kind", "field", "text")
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

        for batch in batches:
            for value, file, begin, inside, depth in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if (file, begin) != at:
                    if cutter:
                        out += [(*at, n + k, *piece) for k, piece in enumerate(cutter.finish())]
                    at, cutter, n = (file, begin), _Cutter(bool(inside), depth), 0
                for piece in cutter.feed(value):
                    out.append((*at, n, *piece))
                    n += 1
            if out:
                yield batch_of(out)
                out = []
        if cutter:
            yield batch_of([(*at, n + k, *piece) for k, piece in enumerate(cutter.finish())])

    return stretches.mapInArrow(run, "file string, range string, n long, kind string, field string, text string")


def read_items(spark: SparkSession, path: str | list[str], range_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items: file, range, n, field and text, an item of the array called field; frames: file and text, each document without its items).

    range_bytes: the size of the ranges, if not the session's; range and n give the items' order in a file.
    """
    with _ranges_of(spark, range_bytes):
        effects = settled(_effects(_stretches(spark, path)))
        ranges = effects.count()
        if ranges > MOST_RANGES:
            raise ValueError(f"{ranges} ranges are too many: read by larger ones")
        starts = F.broadcast(settled(_starts(effects)))
        known = _stretches(spark, path).join(starts, ["file", "range"]).select("value", "file", "range", "inside", "depth")
        pieces = settled(_pieces(known))
    before = Window.partitionBy("file").orderBy("range", "n")  # a few rows per range
    border = pieces.filter(F.col("kind") != "item")
    # The array that a range begins in is the last one opened before it.
    fields = border.filter("kind = 'frame'").withColumn("inherited", F.last("field", True).over(before.rowsBetween(Window.unboundedPreceding, -1))).groupBy("file", "range").agg(F.min_by("inherited", "n").alias("inherited"))
    named = pieces.join(F.broadcast(fields), ["file", "range"]).withColumn("field", F.coalesce("field", "inherited")).drop("inherited")
    whole = named.filter("kind = 'item'").select("file", "range", "n", "field", "text")
    owner = F.last(F.when(F.col("kind") == "tail", F.struct("range", "n", "field")), True).over(before)
    broken = named.filter(F.col("kind").isin("head", "tail")).withColumn("owner", owner).filter("owner is not null")
    joined = broken.groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "n", "text"))), lambda x: x["text"]), "").alias("text"))
    items = whole.unionByName(joined.select("file", "owner.range", "owner.n", "owner.field", "text"))
    frames = named.filter(F.col("kind") == "frame").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "n", "text"))), lambda x: x["text"]), "").alias("text"))
    return items, frames
