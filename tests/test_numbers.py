"""Numbering by ranges; stores by the names of files."""

import pytest
from pyspark.sql import functions as F

from spanloom.model import SCHEMAS, Store, row_numbers
from spanloom.operators import mutations
from spanloom.sources import stores


def test_rows_without_an_id_are_numbered_in_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("string").alias("id"), F.col("id").alias("other"))
    out = row_numbers(rows, ["id"], "n").withColumn("p", F.spark_partition_id())
    assert sorted(r.n for r in out.select("n").collect()) == list(range(20_000))
    assert out.select("p").distinct().count() > 1 and out.groupBy("p").count().agg(F.max("count")).first()[0] < 15_000


def test_one_group_with_all_rows(spark):
    rows = spark.range(1000).select(F.expr("id % 100 div 99").alias("set"), F.format_string("k%04d", "id").alias("id"))
    known = spark.createDataFrame([(0, 41), (0, 7)], "set long, key long")
    out = mutations._numbered(rows, known, "key", ["id"], ["set"]).collect()
    by = {s: [r.key for r in sorted(out, key=lambda r: r.id) if r.set == s] for s in (0, 1)}
    assert by[0] == list(range(42, 42 + 990)) and by[1] == list(range(10))


def test_formats_by_name(spark, tmp_path):
    base = mutations.add_resources(Store.empty(spark), spark.createDataFrame([("r", 'some "text", here')], "id string, text string"))
    target = [("TextSelector", "r", None, None, None, None, 0, 4, "BeginBegin")]
    data = [("d", "set", "key", ("String", "a, b", None, None, None, None, None, None))]
    store = mutations.annotate(base, spark.createDataFrame([("x", None, target, data), ("y", None, target, [])], mutations.BUILDERS))
    for name in ("s.store.json", "s.CSV", "s.parquet"):
        stores.save(store, f"{tmp_path}/a/{name}")
        back = stores.load(spark, f"{tmp_path}/a/{name}")
        assert sorted(r.id for r in back.annotations.collect()) == ["x", "y"], name
        assert [r.text for r in back.resources.collect()] == ['some "text", here']
        assert [(r.key_id, r.s) for r in back.named_data().select("key_id", "value.s").collect()] == [("key", "a, b")]
    with pytest.raises(ValueError, match="no format"):
        stores.format_of("x.txt")
    with pytest.raises(ValueError, match="merged"):
        stores.load(spark, f"{tmp_path}/a/s.CSV", store)
    lines = [r.line for r in stores.csv_text(stores.csv_dataset(store, store.datasets.first().set)).collect()]
    assert lines == ['d,key,"a, b"']


def test_stored_stores_follow_their_source(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return Store.empty(spark).with_tables(resources=spark.createDataFrame([(len(made), "r", "", 0, None)], SCHEMAS["resources"]))

    (tmp_path / "f").write_text("1")
    read = lambda: stores.stored_once(spark, "test", str(tmp_path), make).resources.first().res
    assert (read(), read()) == (1, 1)
    (tmp_path / "f").write_text("22")
    assert read() == 2
