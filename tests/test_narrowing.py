"""Large tables meet a filter of the wanted keys before they are moved."""

from pyspark.sql import functions as F

from spanloom.operators import narrowing
from spanloom.plans import catalogue


def test_no_wanted_row_is_lost(spark):
    rows = spark.range(200_000).select(F.col("id").alias("res"), (F.col("id") % 977).cast("int").alias("begin"))
    for n, count in ((0, 0), (1, 1), (5000, 5000), (5000, 20_000_000), (60_000, 6000)):
        keys = rows.filter(F.col("res") % (200_000 // max(n, 1)) == 0).limit(n).select("res", F.col("begin").cast("bigint").alias("begin"))
        left = narrowing.narrowed(rows, keys, ["res", "begin"], count).localCheckpoint()
        assert left.join(keys, ["res", "begin"], "left_semi").count() == keys.count()
        assert left.count() <= keys.count() + (4000 if count >= n else 200_000)
        assert narrowing.among(rows, keys, ["res", "begin"]).count() == keys.count()


def _moved(spark, work) -> int:
    """Rows that the exchanges of some work get, its checkpoints included."""
    sc = spark.sparkContext

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(x := stages.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    work()
    return sum(n for stage, n in written().items() if stage not in before)


def _documents(spark, path, n: int) -> str:
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("w"), i)), " ")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("one\n"), text, F.lit("\nlast line")).alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(9).cast("bigint").alias("n_chars"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_spans_that_begin_elsewhere_are_not_moved(spark, tmp_path):
    sf, known = _documents(spark, tmp_path, 100), catalogue.queries()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = []
        moved = _moved(spark, lambda: rows.extend(known["lang_nested_relation"](spark, sf).collect()))
        words = 100 * 403
        assert (len(rows), moved < words / 2) == (200, True), moved
        rows.clear()
        moved = _moved(spark, lambda: rows.extend(known["ext_web_annotations"](spark, sf).collect()))
        assert (len(rows), moved < words / 2) == (300, True), moved
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
