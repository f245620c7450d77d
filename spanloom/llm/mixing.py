"""Mixing sources to target weights, by blocks of tokens.

1. The words of a source, its documents in a fixed pseudorandom order, are one stream that is cut into blocks of
   `block` words; the last one may be shorter. A block has an index in its source.
2. A source's target gives the number of block slots that it gets: full passes over its blocks and one partial pass.
3. Output shards have equally many slots. The counts of sources in a shard are drawn from a multinomial distribution
   with the sources' remaining slots as weights, so that over all shards each source gets its number exactly.
4. The k-th slot of a source is pass k div n and place k mod n of that pass, n its number of blocks; the place is mapped
   to a block by a pseudorandom permutation of 0..n-1 of the source and the pass.
5. Blocks join slots by (source, block). A block is in a pass once at most, and no source has over three passes, so no
   document gives more than three times its words.

What is taken differs from the target by half a block at most, and by what the last block lacks, if the partial pass has it; a source of less than
a block is taken whole or not. Everything is a function of the rows and the seed: a rerun gives the same mix.

Null text has no words; a null source is a source of its own, ordered last. Documents without words are listed with
nothing taken. Equal rows are rows of their own, and so are rows that repeat an id. Long texts are only counted. The results
size, sid, source_size, target and start take the place of columns of those names; all others are carried along. An empty
table gives an empty mix.

Words are counted once for the totals, in a table of ids, sources and sizes. The driver holds a row per source, and counts of
sources for runs of shards, as many as fit in DRAWN numbers; tasks draw the counts of the shards in each run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import lean, materialize
from spanloom.llm.sharding import grid, permuted, row_numbers, whole

WORD = r"[^\x20\x09-\x0D]+"
#: Counts that the driver draws; each is of a source in a run of shards.
DRAWN = 1 << 20


def targets(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Shares of all sizes by weight; none above most times its size, the excess reshared by weight among the others."""
    out = [0.0] * len(sizes)
    open_, rest = set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: rest * weights[i] / total for i in open_}
        above = [i for i in sorted(open_) if share[i] > most * sizes[i]]
        for i in above or open_:
            out[i] = float(most * sizes[i]) if above else share[i]
        if not above:
            break
        rest -= sum(out[i] for i in above)
        open_ -= set(above)
    return out


def slots_of(size: int, target: float, block: int, most: int = 3) -> int:
    """The number of block slots whose words come nearest to target."""
    if not size:
        return 0
    blocks = -(-size // block)
    full = min(most, int(target // size))
    rest = target - full * size if full < most else 0.0
    part = min(blocks, round(rest / min(block, size)))
    return full * blocks + part


def shard_counts(slots: list[int], per_shard: int, seed: int) -> np.ndarray:
    """Multinomial counts of sources per shard; the weights are what remains, and each column sums to its slots."""
    rng, left, rows = np.random.default_rng(seed), np.array(slots, dtype=np.int64), []
    while left.sum():
        m = min(per_shard, int(left.sum()))
        drawn = np.minimum(rng.multinomial(m, left / left.sum()), left)
        for i in np.argsort(drawn - left, kind="stable"):  # what was clipped goes to sources with most left
            more = min(m - int(drawn.sum()), int(left[i] - drawn[i]))
            drawn[i] += more
        rows.append(drawn)
        left = left - drawn
    return np.array(rows, dtype=np.int64).reshape(len(rows), len(slots))


def plan_sources(sized: DataFrame, block: int, most: int) -> list[dict]:
    """Per source in code point order, null last: totals, target, blocks, slots and the permutation's grid."""
    rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets([r["size"] for r in rows], [1 + i % 3 for i in range(len(rows))], most)
    out = []
    for i, (r, t) in enumerate(zip(rows, want, strict=True)):
        blocks = -(-r["size"] // block)
        a, b, slack = grid(blocks)
        out.append({"source": r["source"], "sid": i, "source_size": r["size"], "target": t, "blocks": blocks, "slots": slots_of(r["size"], t, block, most), "a": a, "b": b, "slack": slack, "rows": r["rows"]})
    return out


def words_in(text: str) -> Column:
    """The number of words of a column; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(spark, slots: list[int], per_shard: int, seed: int) -> DataFrame:
    """shard, sid, first and n: how many slots a shard has of a source, and the number of the first of them in its source.

    The driver draws the counts of runs of shards; each run is then drawn shard by shard in a task, from what it got.
    """
    total, sources = sum(slots), max(1, len(slots))
    each = max(1, math.ceil(math.ceil(total / per_shard) * sources / DRAWN))  # shards in a run
    runs = shard_counts(slots, per_shard * each, seed)
    firsts = np.cumsum(runs, axis=0) - runs
    rows = [(r, n.tolist(), f.tolist()) for r, (n, f) in enumerate(zip(runs, firsts, strict=True))]

    def expand(batches):
        for batch in batches:
            for r, n, f in zip(*(batch.column(c).to_pylist() for c in ("run", "n", "first")), strict=True):
                counts = shard_counts(n, per_shard, [seed, r]) if each > 1 else np.array([n], dtype=np.int64)
                begin = np.cumsum(counts, axis=0) - counts + np.array(f, dtype=np.int64)
                m, sid = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(m + r * each), pa.array(sid.astype(np.int32)), pa.array(begin[m, sid]), pa.array(counts[m, sid])], names=["shard", "sid", "first", "n"])

    runs_table = spark.createDataFrame(rows, "run long, n array<long>, first array<long>")
    return runs_table.repartition(max(8, math.ceil(total / 500_000)), "run").mapInArrow(lean(expand), "shard bigint, sid int, first bigint, n bigint")


def mix(documents: DataFrame, order: list[str], block: int = 32, per_shard: int = 4096, seed: int = 7, most: int = 3, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with size, sid, source_size, target and start, their first word in the source's stream;
    slots: shard, sid, k, pass, block).

    order: columns that order the documents; the first one is their id. size: their words, if not those of text.
    """
    spark = documents.sparkSession
    carried = [c for c in documents.columns if c.lower() not in ("size", "sid", "source_size", "target", "start")]
    sized = documents.select(*carried, (words_in("text") if size is None else size).alias("size"))
    slim = materialize(sized.select(order[0], "source", "size"), "sizes")
    sources = plan_sources(slim, block, most)
    schema = "source string, sid int, source_size long, target double, blocks long, slots long, a long, b long"
    table = spark.createDataFrame([tuple(s[c.split()[0]] for c in schema.split(", ")) for s in sources], schema)
    # A row per source, which the driver has anyway. Its size is unknown to Spark, which would else send the documents through the driver.
    known = F.broadcast(table.select(F.col("source").alias("_source"), "sid", "source_size", "target"))
    named = lambda df: df.join(known, df["source"].eqNullSafe(F.col("_source"))).drop("_source")
    placed = row_numbers(named(sized), [order[0], "size", *order[1:]], "start", sum(s["rows"] for s in sources), "sid", F.col("size"), counted=named(slim))
    total = sum(s["slots"] for s in sources)
    drawn = draw(spark, [s["slots"] for s in sources], per_shard, seed)
    # Sources are met before slots are made of the counts: Spark takes slots for as few as the counts, and would send them all through the driver.
    drawn = drawn.join(F.broadcast(table.select(F.col("sid").alias("_sid"), "blocks", "a", "b")), F.col("sid") == F.col("_sid")).drop("_sid")
    dealt = drawn.repartition(max(8, math.ceil(total / 500_000)), "shard", "sid")
    slots = dealt.select("shard", "sid", "blocks", "a", "b", F.explode(F.sequence("first", F.expr("first + n - 1"))).alias("k"))
    slots = slots.withColumns({"pass": whole(F.col("k"), F.col("blocks")).cast("int"), "_place": F.pmod("k", "blocks")})
    slack = max([0, *(s["slack"] for s in sources)])
    slots = slots.withColumn("block", permuted(F.col("_place"), F.col("blocks"), F.col("a"), F.col("b"), slack, [F.lit(seed), F.col("sid"), F.col("pass")]))
    return placed, slots.select("shard", "sid", "k", "pass", "block")


def dealt(parts: DataFrame) -> DataFrame:
    """Rows by block, for a join that deals them out: their table holds a row per document and looks small enough to be sent whole through the driver, whatever they are."""
    return parts.hint("merge")


def taken_words(placed: DataFrame, slots: DataFrame, keys: list[str], block: int = 32) -> DataFrame:
    """keys and taken: the words that the mix takes of each document. keys have to tell the rows of placed apart."""
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    last = F.col("start") + F.col("size") - 1
    parts = placed.filter("size > 0").select(*keys, "sid", "start", "size", F.explode(F.sequence(whole(F.col("start"), F.lit(block)), whole(last, F.lit(block)))).alias("block"))
    joined = dealt(parts).join(times, ["sid", "block"])
    words = F.least(last + 1, (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    return joined.groupBy(*keys).agg(F.sum(words * F.col("times")).alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialize(documents.select("doc_id", "source", words_in("text").alias("words")), "words")
    placed, slots = mix(sized, ["doc_id"], size=F.col("words"))
    # One row per document row; rows that are equal in these columns and have words differ in start.
    rows = materialize(placed.select("doc_id", "size", "sid", "source_size", "target", "start"), "placed")
    taken = taken_words(rows, slots, ["sid", "start", "size"]).withColumnsRenamed({"sid": "_s", "start": "_a", "size": "_n"})
    out = rows.join(taken, (F.col("sid") == F.col("_s")) & (F.col("start") == F.col("_a")) & (F.col("size") == F.col("_n")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
