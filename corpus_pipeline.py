"""The corpus pipeline: quality, near duplicates, benchmark leaks, mixing, sharding.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Extra columns are carried along, whatever their names; the last stage
keeps those that are called like its results, in any case, as input_global_row, input_shard and input_slot.

Null and empty texts are documents like others until the mix, which takes nothing of documents without words. Rows without an id can't be
named: they are no near copy of others and no leak. Of rows that repeat an id one is kept. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import decontamination, jaccard, mixing, quality, sharding
from spanloom.llm.shared import fresh, materialize, scratch

BLOCK = 32
#: Near copies share this percentage of their shingles of five words. (op6 alone is bound to three words and 90.)
SHINGLE, LIKE = 5, 80


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of the n-gram Jaccard join, and one row of it.

    Rows without an id stay; documents without words are in no group.
    """
    with scratch(spark):
        found = jaccard.join_components(docs.select("doc_id", "text"), SHINGLE, LIKE)
        others = materialize(found.filter("component_id != doc_id").select("doc_id").distinct(), "others", lasting=True)
        # Rows that repeat an id: known by their ids alone, so that no text is sorted where there are none.
        repeated = materialize(found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "repeated", lasting=True)
    kept = docs.join(others, "doc_id", "left_anti")
    single = kept.join(repeated, "doc_id", "left_anti")
    number = fresh(docs, "number")
    again = kept.join(repeated, "doc_id", "left_semi").withColumn(number, F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return single.unionByName(again.filter(F.col(number) == 1).drop(number)).select(docs.columns)


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    with scratch(spark):
        pairs = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        leaks = materialize(pairs.select("doc_id").distinct(), "leaks", lasting=True)
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: a row for each pass over the source that takes of it, up to three.

    Who is taken whole keeps its text; otherwise the text is the taken blocks' words. n_chars is that of the new text.
    """
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text", "source")]
    packed = docs.select("doc_id", "text", "source", F.struct(*(others or [F.lit(0).alias("none")])).alias("others"))
    placed, slots = mixing.mix(packed, ["doc_id"], BLOCK)
    placed = materialize(placed, "placed")
    last = F.col("start") + F.col("size") - 1
    whole = lambda c: mixing.whole(c, F.lit(BLOCK))
    parts = placed.filter("size > 0").select("sid", "start", "size", F.explode(F.sequence(whole(F.col("start")), whole(last))).alias("block"))
    taken = mixing.dealt(parts).join(slots.select("sid", "block", "pass"), ["sid", "block"]).groupBy("sid", "start", "size", "pass").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    rows = placed.join(taken, ["sid", "start", "size"])
    first = whole(F.col("start"))
    all_blocks = F.size("blocks") == whole(last) - first + 1
    words = F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0))

    def piece(w, b):
        begin = F.greatest(b * BLOCK - F.col("start"), F.lit(0).cast("long"))
        end = F.least((b + 1) * BLOCK - F.col("start"), F.col("size"))
        return F.slice(w, (begin + 1).cast("int"), (end - begin).cast("int"))

    # The words are a lambda's variable: as a column they would be put into the inner lambda and found again for each block.
    join_blocks = lambda w: F.array_join(F.flatten(F.transform("blocks", lambda b: piece(w, b))), " ")
    text = F.when(all_blocks, F.col("text")).otherwise(F.element_at(F.transform(F.array(words), join_blocks), 1))
    out = rows.withColumn("text", text)
    changed = {c: F.col("others").getField(c).alias(c) for c in others}
    for c in others:
        if c.lower() == "n_chars":
            changed[c] = F.length("text").cast(docs.schema[c].dataType).alias(c)
    return out.select(*[changed.get(c, F.col(c)) for c in docs.columns])


def shard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns with global_row, shard and slot, in 40 shards."""
    results = ("global_row", "shard", "slot")
    taken = {c.lower() for c in docs.columns}
    for c in docs.columns:
        if c.lower() in results:
            name = f"input_{c.lower()}"
            while name in taken:
                name = f"input_{name}"
            taken.add(name)
            docs = docs.withColumnRenamed(c, name)
    crc = fresh(docs, "crc")
    ordered = docs.withColumn(crc, F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    return sharding.shard_rows(ordered, ["doc_id", crc], 40).select(*docs.columns, *results)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: A trained model and alignments are no SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
