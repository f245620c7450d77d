"""Search in texts. Each function takes rows with a key, a text and optionally a begin, and gives spans in code points.

`texts` has the columns res and text, and `base` if the text begins inside its resource. Literal search and splitting are
column expressions: a split at the pattern gives pieces whose lengths, summed up, are positions. Regular expressions with
groups need offsets of groups, which the JVM functions don't give; they run in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.patterns import Patterns, may_match


def quote(s: str) -> str:
    return "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in s)


def _base(texts: DataFrame) -> Column:
    return F.col("base") if "base" in texts.columns else F.lit(0)


def _keys(texts: DataFrame) -> list[str]:
    return [c for c in texts.columns if c not in ("text", "base")]


def _pieces(texts: DataFrame, pattern: str, width: int | None = None) -> DataFrame:
    """Pieces between matches: keys, pos, piece, begin (of the piece, without the matches before), and found, the match behind a piece.

    width: of each match, where all have the same; then texts are gone through once, and there is no column found.
    """
    keys = _keys(texts)
    rows = texts.withColumn("_row", F.struct(*keys, _base(texts).alias("_base")))
    if width is None:
        rows = rows.select("_row", F.split("text", pattern, -1).alias("_pieces"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("_found"))
        both = F.arrays_zip(F.col("_pieces").alias("p"), F.col("_found").alias("m"))
        lengths = F.transform(both, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
        parts = [F.col("_pieces").alias("p"), F.col("_found").alias("m")]
    else:
        rows = rows.select("_row", F.split("text", pattern, -1).alias("_pieces"))
        lengths, parts = F.transform("_pieces", lambda p: F.length(p) + width), [F.col("_pieces").alias("p")]
    rows = rows.withColumn("_lengths", lengths)
    begins = _running(F.col("_lengths"))
    exploded = rows.select("_row", F.posexplode(F.arrays_zip(*parts, begins.alias("b"))).alias("pos", "x"))
    found = [F.col("x.m").alias("found")] if width is None else []
    return exploded.select("_row.*", "pos", F.col("x.p").alias("piece"), *found, (F.col("x.b") + F.col("_row._base")).alias("begin")).drop("_base")


#: Elements that one fold of a running sum takes; a fold copies its result in each step.
CHUNK = 64


def _running(lengths: Column) -> Column:
    """The sums of all elements before each one. Nothing is shuffled; the folds are chunked, so long arrays stay cheap."""

    def fold(part: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    chunks = F.sequence(F.lit(0), F.call_function("div", F.size(lengths) - 1, F.lit(CHUNK)).cast("int"))
    chunk = lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))
    starts = fold(F.transform(chunks, lambda c: F.aggregate(chunk(c), F.lit(0), lambda acc, x: acc + x)), F.lit(0))
    numbered = F.arrays_zip(chunks.alias("c"), starts.alias("s"))
    return F.flatten(F.transform(numbered, lambda x: fold(chunk(x["c"]), x["s"])))


#: Text that is cut at a time, and rows that are given on at a time.
CUT_BYTES, CUT_ROWS = 1 << 20, 1 << 16


def layers(texts: DataFrame, separators: list[str], piece: bool = False, ranks: bool = False) -> DataFrame:
    """The pieces of texts between single ASCII characters, for each set of these: keys, layer (its number), pos (in all pieces), begin, end; empty pieces are left out.

    piece: with the pieces' texts. ranks: with ts, the place of a piece's span among the different ones of its row, of all layers, and again, whether a layer before has the same span. A null text has no pieces.
    Nothing is shuffled; texts are cut in Arrow batches, all of a slice at once.
    """
    keys = _keys(texts)
    schema = texts.select(*keys).schema.add("layer", "integer").add("pos", "integer").add("begin", "integer").add("end", "integer")
    if piece:
        schema = schema.add("piece", "string")
    if ranks:
        schema = schema.add("ts", "long").add("again", "boolean")
    marks = [np.isin(np.arange(256), [ord(c) for c in s]) for s in separators]

    def run(batches):
        for batch in batches:
            texts_of = batch.column("text").cast(pa.large_string())
            texts_of = texts_of.fill_null("") if texts_of.null_count else texts_of
            at = np.frombuffer(texts_of.buffers()[1], np.int64)[texts_of.offset : texts_of.offset + len(texts_of) + 1]
            data = np.frombuffer(texts_of.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(at, at[low] + CUT_BYTES, side="right")) - 1)
                doc, columns = _cut(data[at[low] : at[high]], at[low : high + 1] - at[low], marks, piece, ranks)
                for i in range(0, len(doc), CUT_ROWS):
                    own = pa.array(doc[i : i + CUT_ROWS] + low)
                    yield pa.RecordBatch.from_arrays([*[batch.column(k).take(own) for k in keys], *[c.slice(i, CUT_ROWS) for c in columns]], names=schema.names)
                low = high

    return texts.select(*keys, "text").mapInArrow(run, schema)


def _cut(data: np.ndarray, at: np.ndarray, marks: list[np.ndarray], piece: bool, ranks: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """The pieces of the texts that stand in data (UTF-8), each from one place of at to the next: their texts' numbers, and the columns of layers()."""
    n = len(at) - 1
    points = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    docs, cut, pieces = [], [], []
    for layer, mark in enumerate(marks):
        inside = mark[data]
        found = np.flatnonzero(inside)
        count = np.bincount(np.searchsorted(at, found, side="right") - 1, minlength=n) + 1
        first = np.cumsum(count) - count
        start, end = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.int64)
        inner = np.ones(len(start), bool)
        inner[first] = False
        start[first], start[inner] = at[:-1], found + 1
        inner[:] = True
        inner[first + count - 1] = False
        end[first + count - 1], end[inner] = at[1:], found
        doc = np.repeat(np.arange(n), count)
        pos = np.arange(len(start)) - np.repeat(first, count)
        kept = end > start
        start, end, doc, pos = start[kept], end[kept], doc[kept], pos[kept]
        base = points[at[doc]]
        docs.append(doc)
        cut.append((np.full(len(doc), layer), pos, points[start] - base, points[end] - base))
        if piece:
            ends = np.concatenate([[0], np.cumsum(end - start)])
            pieces.append(pa.LargeStringArray.from_buffers(len(doc), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[~inside]))))
    doc, numbers = np.concatenate(docs), [np.concatenate(c).astype(np.int32) for c in zip(*cut, strict=True)]
    columns = [pa.array(c) for c in numbers]
    if piece:
        columns.append(pa.concat_arrays(pieces).cast(pa.string()))
    if ranks:
        order = np.lexsort((numbers[3], numbers[2], doc))
        d, b, e = doc[order], numbers[2][order], numbers[3][order]
        other = np.ones(len(d), bool)
        other[1:] = (d[1:] != d[:-1]) | (b[1:] != b[:-1]) | (e[1:] != e[:-1])
        total = np.cumsum(other) - 1
        ts = np.empty(len(d), np.int64)
        ts[order] = total - total[np.searchsorted(d, d)]
        again = np.empty(len(d), bool)
        again[order] = ~other
        columns += [pa.array(ts), pa.array(again)]
    return doc, columns


def find(texts: DataFrame, fragment: str, nocase: bool = False) -> DataFrame:
    """All occurrences of fragment, from left to right and without overlap: keys, begin, end."""
    if not fragment:
        raise ValueError("an empty fragment is everywhere")
    pattern = ("(?iu)" if nocase else "") + quote(fragment)
    keys = _keys(texts)
    test = F.lower("text").contains(fragment.lower()) if nocase and fragment.isascii() else texts["text"].contains(fragment) if not nocase else F.lit(True)
    found = _pieces(texts.filter(test), pattern).filter("found is not null")
    begin = F.col("begin") + F.length("piece")
    return found.select(*keys, begin.alias("begin"), (begin + F.length("found")).alias("end"))


def split(texts: DataFrame, delimiter: str) -> DataFrame:
    """The pieces between delimiters, empty ones too: keys, pos, begin, end."""
    if not delimiter:
        raise ValueError("an empty delimiter splits nothing")
    out = _pieces(texts, quote(delimiter), len(delimiter))
    return out.select(*_keys(texts), "pos", "begin", (F.col("begin") + F.length("piece")).alias("end"))


def trim(spans: DataFrame, chars: str) -> DataFrame:
    """Spans (begin, end, text of the span) without chars at both sides; begin = end where nothing else is left."""
    inside = "[" + quote(chars) + "]"
    left = F.length(F.regexp_extract("text", f"^{inside}*", 0))
    right = F.length(F.regexp_extract(F.substr(F.col("text"), left + 1), f"{inside}*$", 0))
    return spans.withColumns({"begin": F.col("begin") + left, "end": F.col("end") - right}).withColumn("text", F.substr("text", left + 1, F.length("text") - left - right))


def trim_with(spans: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
    """Spans (begin, end, text of the span) without the characters at both sides for which test holds; begin = end where nothing else is left."""
    kept = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c: ~F.coalesce(test(c), F.lit(False)))
    places = spans.withColumn("_kept", kept)
    first, last = F.array_position("_kept", F.lit(True)), F.array_position(F.reverse("_kept"), F.lit(True))
    n = F.size("_kept")
    left = F.when(first > 0, first - 1).otherwise(n).cast("int")
    right = F.when(first > 0, last - 1).otherwise(0).cast("int")
    cut = places.withColumns({"begin": F.col("begin") + left, "end": F.col("end") - right, "text": F.substr("text", left + 1, n - left - right)})
    return cut.drop("_kept")


def find_regex(texts: DataFrame, expressions: list[str], overlap: bool = False) -> DataFrame:
    """Matches of expressions: keys, expression (its number), match (its number in the row), grp, begin, end.

    Without groups a match is one row with grp 0; with groups it is a row for each group that took part. Matches of
    several expressions are merged by begin; unless overlap is set, one that begins inside a match chosen before it is left out.
    Look-around and back-references are refused, as they depend on the dialect. An expression runs only where its literals occur, see patterns.
    """
    _check(expressions)
    keys = _keys(texts)
    schema = texts.select(*keys).schema.add("expression", "integer").add("match", "integer").add("grp", "integer").add("begin", "integer").add("end", "integer")

    def run(batches):
        patterns = Patterns(expressions)
        for batch in batches:
            base = batch.column("base").to_pylist() if "base" in batch.schema.names else [0] * batch.num_rows
            rows = {"row": [], "expression": [], "match": [], "grp": [], "begin": [], "end": []}
            for row, text in enumerate(batch.column("text").to_pylist()):
                found = sorted(((m.start(), i, m) for i, m in patterns.matches(text or "")), key=lambda x: x[:2])
                end, n = -1, 0
                for begin, i, m in found:
                    if not overlap and begin < end:
                        continue
                    end = max(end, m.end())
                    for g in [g for g in range(1, m.re.groups + 1) if m.start(g) >= 0] if m.re.groups else [0]:
                        for c, v in zip(rows, (row, i, n, g, m.start(g) + base[row], m.end(g) + base[row]), strict=True):
                            rows[c].append(v)
                    n += 1
            at = pa.array(rows.pop("row"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in keys] + [pa.array(v, pa.int32()) for v in rows.values()], names=[*keys, *rows])

    return _worth(texts, expressions).mapInArrow(run, schema)


def _check(expressions: list[str]) -> None:
    for e in expressions:
        if re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P=", e):
            raise ValueError(f"look-around and back-references are not supported: {e}")


def _worth(texts: DataFrame, expressions: list[str]) -> DataFrame:
    """Without the texts that a test in the JVM tells no expression matches."""
    test = may_match(F.col("text"), expressions)
    return texts if test is None else texts.filter(test)


def select_expressions(texts: DataFrame, expressions: list[str]) -> DataFrame:
    """keys, expression: the numbers of the expressions that match a text at all, each once."""
    _check(expressions)
    keys = _keys(texts)
    schema = texts.select(*keys).schema.add("expression", "integer")

    def run(batches):
        patterns = Patterns(expressions)
        for batch in batches:
            found = [(row, i) for row, text in enumerate(batch.column("text").to_pylist()) for i in patterns.matching(text or "")]
            at = pa.array([row for row, _ in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in keys] + [pa.array([i for _, i in found], pa.int32())], names=[*keys, "expression"])

    return _worth(texts, expressions).mapInArrow(run, schema)


def find_sequence(texts: DataFrame, fragments: list[str], skip: str = r"\s", case_sensitive: bool = True) -> DataFrame:
    """The first place where fragments follow each other with only characters of the class skip between: keys, pos, begin, end."""
    if not fragments or not all(fragments):
        raise ValueError("fragments must not be empty")
    flags = "" if case_sensitive else "(?i)"
    pattern = flags + f"(?:{skip})*".join(f"({re.escape(f)})" for f in fragments)
    found = find_regex(texts, [pattern], overlap=True).filter("match = 0")
    return found.select(*_keys(texts), (F.col("grp") - 1).alias("pos"), "begin", "end")


#: Positions that stand in one row, at most, while segments are made.
WIDE = 1 << 14


def _positions(spans: DataFrame) -> DataFrame:
    """res, bucket, ats: the begins and ends of spans, those of a batch and of WIDE places of a resource in one row, each once."""

    def run(batches):
        for batch in batches:
            res, ats = [], []
            for c in (1, 2):
                known = batch.filter(batch.column(c).is_valid())
                res.append(np.array(known.column(0), np.int64))
                ats.append(np.array(known.column(c), np.int64))
            r, at = np.concatenate(res), np.concatenate(ats)
            order = np.lexsort((at, r))
            r, at = r[order], at[order]
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (at[1:] != at[:-1])
            r, at = r[new], at[new]
            bucket = at // WIDE
            new = np.ones(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (bucket[1:] != bucket[:-1])
            first = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(r)), pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(r[first]), pa.array(bucket[first], pa.int32()), lists], names=["res", "bucket", "ats"])

    rows = spans.filter("res is not null").select(F.col("res").cast("long").alias("res"), "begin", "end")
    return rows.mapInArrow(run, "res long, bucket int, ats array<int>")


def segments(resources: DataFrame, spans: DataFrame, begin: int = 0, end: int | None = None) -> DataFrame:
    """The smallest pieces (res, begin, end) that all begins and ends of spans cut resources (res, textlen) into.

    begin and end: the range to cover; a resource with nothing in it has no segments. Positions are moved in lists, each once for a batch, and not a row for each.
    """
    top = F.col("textlen") if end is None else F.least("textlen", F.lit(end))
    tops = resources.groupBy("res").agg(F.max(top).alias("top"))
    bounds = resources.select("res", F.explode(F.array(F.lit(begin).cast("int"), top.cast("int"))).alias("at")).filter("at is not null")
    bounds = bounds.select("res", F.floor(F.col("at") / WIDE).cast("int").alias("bucket"), F.array("at").alias("ats"))
    lists = _positions(spans).unionByName(bounds).groupBy("res", "bucket").agg(F.flatten(F.collect_list("ats")).alias("ats"))
    inside = F.filter("ats", lambda at: (at >= begin) & (at <= F.col("top")))
    cuts = lists.join(tops, "res").select("res", "bucket", F.array_sort(F.array_distinct(inside)).alias("ats")).filter("size(ats) > 0")
    following = F.lead(F.get("ats", F.lit(0))).over(Window.partitionBy("res").orderBy("bucket"))
    ends = F.concat(F.slice("ats", F.lit(2), F.size("ats")), F.array("_next"))
    pairs = cuts.withColumn("_next", following).select("res", F.inline(F.arrays_zip(F.col("ats").alias("begin"), ends.alias("end"))))
    return pairs.filter("end is not null").select("res", "begin", "end")


def byte_of(text: Column, position: Column) -> Column:
    """The UTF-8 byte offset of a code point position."""
    return F.octet_length(F.substr(text, F.lit(1), position))


def position_of(text: Column, byte: Column) -> Column:
    """The code point position of a UTF-8 byte offset."""
    return F.length(F.decode(F.substr(F.encode(text, "utf-8"), F.lit(1), byte), "utf-8"))
