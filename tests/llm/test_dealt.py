"""Joins of the mix that must not go through the driver, however small their tables look."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import mixing


def joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [line for line in plan.splitlines() if "Join" in line and "block" in line]


def test_blocks_of_documents_are_dealt_out(spark):
    placed = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(0).alias("sid"), (F.col("id") * 320).alias("start"), F.lit(320).cast("long").alias("size"))
    slots = spark.range(100).select(F.lit(0).alias("sid"), F.col("id").alias("block"))
    taken = mixing.taken_words(placed, slots, ["doc_id"])
    assert joins(taken) and all("SortMergeJoin" in j for j in joins(taken))
    assert {r.taken for r in taken.collect()} == {320}


@pytest.mark.parametrize("texts", [["a b c " * 50, "d e f " * 70]])
def test_the_pipelines_mix(spark, texts):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert joins(mixed) and all("SortMergeJoin" in j for j in joins(mixed))


def test_documents_meet_their_sources_where_they_are(spark, tmp_path):
    spark.range(1000).selectExpr("id as doc_id", "concat('s', id % 3) as source", "id % 50 as words").write.parquet(f"{tmp_path}/words")
    stored = spark.read.parquet(f"{tmp_path}/words")  # files of a known, small size
    placed, slots = mixing.mix(stored, ["doc_id"], size=F.col("words"))
    lines = [line for line in placed._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "source" in line]
    assert lines and all("BroadcastHashJoin" in line and "BuildRight" in line for line in lines)
    assert placed.count() == 1000
    lines = slots._jdf.queryExecution().sparkPlan().toString().splitlines()
    above = lines[: next(i for i, line in enumerate(lines) if "Generate" in line)]
    assert not [line for line in above if "Join" in line]  # slots, whose number Spark doesn't know, meet nothing that could have them broadcast
