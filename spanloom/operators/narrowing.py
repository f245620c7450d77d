"""Leaving rows out before they are moved: those whose keys can't be among a few wanted ones.

A join of a large table with few keys moves the whole table. A filter of the keys (a Bloom filter in blocks: a table of chunk and bits, made by grouping and
broadcast) goes ahead of it, so that about as many rows are moved as have partners. It lets every row with a wanted key through, and some others, so the join stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a chunk; the most chunks (32 MB together); bits for each key where there is room.
WORDS, MOST_CHUNKS, KEY_BITS = 1024, 4096, 16


def _hash(on: list[str]) -> Column:
    return F.xxhash64(*[F.col(c).cast("bigint") for c in on])


def _bits(h: Column) -> list[Column]:
    """The two places of a key in its chunk."""
    return [F.shiftrightunsigned(h, n).bitwiseAND(F.lit(WORDS * 64 - 1)) for n in (32, 48)]


def _chunks(count: int) -> int:
    return min(MOST_CHUNKS, max(1, -(-count * KEY_BITS // (WORDS * 64))))


def key_bits(keys: DataFrame, on: list[str], count: int) -> DataFrame:
    """_chunk and _words: the filter of about count keys (numeric columns on)."""
    chunks, div = _chunks(count), lambda c, n: F.call_function("div", c, F.lit(n)).cast("int")
    h = keys.select(_hash(on).alias("h"))
    places = h.select(F.pmod("h", F.lit(chunks)).cast("int").alias("_chunk"), F.explode(F.array(*_bits(F.col("h")))).alias("bit"))
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    # Each chunk has all of its words, so that a word is found by its place.
    every = keys.sparkSession.range(chunks * WORDS).select(div(F.col("id"), WORDS).alias("_chunk"), (F.col("id") % WORDS).cast("int").alias("word"), F.lit(0).cast("bigint").alias("mark"))
    marked = every.unionByName(places.select("_chunk", div(F.col("bit"), 64).alias("word"), mark.alias("mark"))).groupBy("_chunk", "word").agg(F.bit_or("mark").alias("mark"))
    return marked.groupBy("_chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mark"))), lambda x: x["mark"]).alias("_words"))


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str], count: int) -> DataFrame:
    """rows without most of those that a join with keys on these numeric columns drops; none that it keeps is lost.

    keys should be settled, as they are read for the filter and for the join; count: how many there are, about.
    """
    h = _hash(on)
    is_set = lambda bit: F.call_function("shiftrightunsigned", F.get("_words", F.call_function("div", bit, F.lit(64)).cast("int")), (bit % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    one, two = _bits(h)
    here = F.pmod(h, F.lit(_chunks(count))).cast("int") == F.col("_chunk")
    return rows.join(F.broadcast(key_bits(keys, on, count)), here & is_set(one) & is_set(two), "left_semi")


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose numeric columns on are those of keys, a settled table of few rows."""
    return narrowed(rows, keys, on, keys.count()).join(keys.select(*on), on, "left_semi")
