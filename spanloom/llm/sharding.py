"""Sharding: a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

Every row gets a global row number r in 0..n-1. A keyed permutation P of 0..n-1 shuffles the numbers; shard and slot
follow by arithmetic: shard = P(r) mod shards, slot = P(r) div shards. So shard sizes differ by one row at most (the law
`rows`), slots have no gaps, and anyone who knows n and the key computes a row's place, or the row of a place, without
the table.

Row numbers: rows are dealt to buckets by a hash of the id, numbered in each bucket, and shifted by the number of rows in
the buckets before. No step sorts the table as a whole; a bucket has about `rows_per_bucket` rows at any size.

Null ids are one id of their own, and rows may repeat an id, any number of them: buckets are dealt by all ordering columns, so
that a hot id is spread as far as its rows differ. Rows that are equal in all of them are interchangeable. Texts are only
measured, whatever their length. The results take the place of columns of their names (global_row, shard, slot); all other columns are
carried along, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import fresh

ROUNDS = 6


def row_numbers(df: DataFrame, order: list[str], out: str, total: int, group: str | None = None, value: Column | None = None, rows_per_bucket: int = 50_000, counted: DataFrame | None = None) -> DataFrame:
    """df with the column out: how many rows (or how much of value) stand before the row, in all or in its group.

    Rows are dealt to buckets by a hash of the columns `order`; the order in a bucket is that of these columns. The number depends on the rows
    alone, not on how they are partitioned. No group is taken in one task: a hot one is spread over all buckets.
    counted: a smaller frame of the same rows to count from, if it is cheaper; rows are then dealt by the first two columns of order.
    """
    buckets = max(256, math.ceil(total / rows_per_bucket))
    amount = F.lit(1).cast("long") if value is None else value
    names = {k: fresh(df, k) for k in ("bucket", "amount", "b", "start", "key", "sum")}
    bucket, amounts, b, start, key, total_ = names.values()
    dealt_by = order if counted is None else order[:2]
    added = {bucket: F.pmod(F.xxhash64(*dealt_by), F.lit(buckets)), amounts: amount}
    if group:
        added[key] = F.col(group)
    keys = [key] if group else []
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = (df if counted is None else counted).withColumns(added).groupBy(*keys, bucket).agg(F.sum(amounts).alias(total_))
    starts = sums.withColumn(start, F.coalesce(F.sum(total_).over(before), F.lit(0))).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col(bucket).alias(b), start)
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = [c for c in df.columns if c.lower() != out.lower()]
    df = df.withColumns(added).select(*carried, *added, F.coalesce(F.sum(amounts).over(inside), F.lit(0)).alias(total_))
    on = [F.col(bucket) == F.col(b), *[F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]]
    return df.join(starts, on, "left").select(*carried, (F.col(total_) + F.col(start)).alias(out))


def whole(x: Column, y: Column) -> Column:
    """x divided by y, rounded down, in integers."""
    return F.call_function("div", x, y)


def grid(n: int) -> tuple[int, int, int]:
    """a, b and slack with a * b = n + slack, a and b near the root of n and the slack as small as can be found."""
    n = max(n, 1)
    root = math.isqrt(n - 1) + 1
    best = (root, -(-n // root))
    for a in range(root, max(1, root // 2, root - 20_000) - 1, -1):
        b = -(-n // a)
        if a * b < best[0] * best[1]:
            best = (a, b)
        if a * b == n:
            break
    return *best, best[0] * best[1] - n


def permuted(number: Column, n: Column, a: Column, b: Column, slack: int, key: list[Column]) -> Column:
    """P(number), P a permutation of 0..n-1 that key selects.

    The halves of a number are its row and column in an a x b grid; ROUNDS times one half is shifted by a hash of the
    other. The grid has `slack` cells more than n. Who lands on such a cell walks on; a walk meets each of them at most
    once, so slack + 1 applications always suffice. The rounds are a fold, not nested columns, whose expansion would
    double with each round.
    """

    def turn(half: Column, i: Column) -> Column:
        return F.xxhash64(half, i, *key)

    def feistel(x: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            down = F.struct(F.pmod(s["l"] + F.pmod(turn(s["r"], i), a), a).alias("l"), s["r"].alias("r"))
            across = F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(turn(s["l"], i), b), b).alias("r"))
            return F.when(F.pmod(i, F.lit(2)) == 0, down).otherwise(across)

        halves = F.struct(whole(x, b).alias("l"), F.pmod(x, b).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, step, lambda s: s["l"] * b + s["r"])

    if not slack:
        return feistel(number)
    return F.aggregate(F.sequence(F.lit(0), F.lit(slack)), number, lambda x, i: F.when((i > 0) & (x < n), x).otherwise(feistel(x)))


def shard_rows(df: DataFrame, order: list[str], shards: int = 40, key: int = 20_24) -> DataFrame:
    """df with global_row, shard (int) and slot (long)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    n = df.select(order[0]).count()
    a, b, slack = grid(n)
    place, carried = fresh(df, "place"), [c for c in df.columns if c.lower() not in ("global_row", "shard", "slot")]
    df = row_numbers(df.select(*carried), order, "global_row", n)
    n, a, b = (F.lit(x).cast("long") for x in (n, a, b))
    df = df.withColumn(place, permuted(F.col("global_row"), n, a, b, slack, [F.lit(key)]))
    return df.select(*carried, "global_row", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), whole(F.col(place), F.lit(shards)).alias("slot"))


def describe(documents: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16) and text_crc32; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `rows`."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard_rows(describe(documents), ["doc_id", "size", "text_crc32"], 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
