"""Texts of query rows where spans read the same."""

from collections import Counter

import duckdb

from spanloom.plans import catalogue


def test_spans_that_read_the_same(spark, tmp_path):
    texts = ["abcd  abcd and more", "x" * 20, "", "short", "0123456789", "äöü 語語äöü  more"]
    rows = [(i, t, "de", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    wanted = con.execute(catalogue.oracle_sql()["lang_result_text"]).fetchall()
    found = catalogue.queries()["lang_result_text"](spark, str(tmp_path))
    assert Counter(map(tuple, found.select("a", "type", "text").collect())) == Counter(wanted)
