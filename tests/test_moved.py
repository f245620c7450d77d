"""What is moved: texts meet spans once and labels never, and annotations are counted where they are read."""

from pyspark.sql import functions as F

from spanloom.model import SCHEMAS, Store
from spanloom.operators import collections, mutations, traversals
from spanloom.plans import graph


def _store(spark, text: str) -> Store:
    res = spark.createDataFrame([(0, "r", text, len(text), None)], SCHEMAS["resources"])
    return Store.empty(spark).with_tables(resources=res)


def test_spans_of_any_length_share_one_shuffle_of_texts(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) for i in range(7000))
    places = [(0, 5), (2040, 2060), (0, 1024), (1000, 2024), (0, 1025), (1023, 2049), (2048, 4096), (2047, 6145), (0, 7000), (5, 5), (6990, 7000)]
    spans = spark.createDataFrame([(0, b, e, "x") for b, e in [*places, (0, 7000)]], "res bigint, begin int, end int, more string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = traversals.selection_text(_store(spark, text), spans)
        rows = sorted((r["begin"], r["end"], r["text"]) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sorted((b, e, text[b:e]) for b, e in [*places, (0, 7000)])
    assert "ReusedExchange" in plan


def test_labels_meet_no_texts(spark, tmp_path):
    spark.createDataFrame([(i, "abc" * i, "en", "src1", 3 * i) for i in range(4)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = graph.documents(spark, str(tmp_path))
    assert "text" not in docs.columns and sorted(r["d"] for r in docs.collect()) == [0, 1, 2, 2, 3]
    assert sorted(r["res"] for r in graph.derive(spark, str(tmp_path)).resources.collect()) == [0, 1, 2, 2, 3]  # as the join of its SQL


def test_equal_ids_and_texts_are_one_resource(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", None), ("d", "")], "id string, text string")
    store = mutations.add_resources(Store.empty(spark), rows)
    assert sorted((r["res"], r["id"], r["text"]) for r in store.resources.collect()) == [(0, "a", "x"), (1, "b", "x"), (2, "c", None), (3, "d", "")]
    again = mutations.add_resources(store, spark.createDataFrame([("a", "x"), ("e", "y")], "id string, text string"))
    assert sorted((r["res"], r["id"]) for r in again.resources.collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]


def test_first_data_are_counted_without_being_moved(spark):
    data = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 2, 1)], "set bigint, data bigint, key bigint").select("set", "data", F.lit(None).cast("string").alias("id"), "key", F.lit(None).cast(Store.empty(spark).data.schema["value"].dataType).alias("value"))
    used = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 1), (2, 0, 0, 2), (2, 1, 0, 0), (2, 2, 0, 1), (3, 0, 0, 1), (4, 2, 0, 2)], SCHEMAS["annotation_data"])
    found = collections.annotations_per_key(Store.empty(spark).with_tables(data=data, annotation_data=used))
    assert sorted((r["key"], r["n"]) for r in found.collect()) == [(0, 3), (1, 2)]
    assert "count(distinct" not in found._jdf.queryExecution().analyzed().toString().lower()
