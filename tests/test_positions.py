"""The index of positions: bytes by milestones, entries, pruned reads."""

from pyspark.sql import functions as F

from spanloom.model import SCHEMAS, Store
from spanloom.operators import positions

M = positions.MILESTONE


def test_index(spark, tmp_path):
    texts = {1: "aé𝔘 z", 2: "", 3: "é" * M, 4: "🙂" * (2 * M) + "end", 5: "x" * (M + 1)}
    spans = [(1, 0, 2), (1, 2, 3), (1, 0, 5), (2, 0, 0), (3, 0, M), (3, M, M), (4, M - 1, M + 1), (4, 2 * M, 2 * M + 3), (5, 0, M + 1)]
    store = Store.empty(spark).with_tables(
        resources=spark.createDataFrame([(i, str(i), t, len(t), None) for i, t in texts.items()], SCHEMAS["resources"]),
        textselections=spark.createDataFrame([(r, n, b, e) for n, (r, b, e) in enumerate(spans)], SCHEMAS["textselections"]),
    )
    positions.save(positions.index(store), f"{tmp_path}/p")
    found = positions.load(spark, f"{tmp_path}/p")
    expected = {(r, at): (sum(x == (r, at) for x in [(r_, b) for r_, b, _ in spans]), sum(x == (r, at) for x in [(r_, e) for r_, _, e in spans]), len(texts[r][:at].encode())) for r, b, e in spans for at in (b, e)}
    assert {(x.res, x.at): (x.begins, x.ends, x.byte) for x in found.points.collect()} == expected
    assert sorted((x.side, x.other) for x in positions.entry(found, 2, 1).collect()) == [("begin", 3), ("end", 0)]
    assert positions.entry(found, 4, 1).count() == 0
    assert sorted(map(tuple, positions.used(found, "begin", 1, M).collect())) == [(1, 2), (4, M - 1)]
    assert sorted(map(tuple, positions.used(found, "end", res=3).collect())) == [(3, M)]
    assert sorted(map(tuple, positions.used(found).collect())) == sorted(expected)
    plan = positions.entry(found, 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(at,2)" in plan and "EqualTo(res,1)" in plan and "Exchange" not in plan
    assert "Exchange" not in positions.used(found, "end", 1, 9)._jdf.queryExecution().executedPlan().toString()


def test_partial_counts(spark):
    empty = Store.empty(spark)
    assert positions.partial_counts(empty).first().asDict() == {"data": 0, "selections": 0}
    data = spark.createDataFrame([(1, 0, 0, 5), (2, 0, 0, 5), (2, 1, 1, 5)], SCHEMAS["annotation_data"])
    assert positions.partial_counts(empty.with_tables(annotation_data=data)).select(F.col("data")).first()[0] == 2
