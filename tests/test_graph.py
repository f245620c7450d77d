"""The graph of documents and labels: queries against DuckDB, long chains, long texts, round trips."""

import ast
import inspect
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.model import SCHEMAS, Store
from spanloom.operators import traversals
from spanloom.plans import catalogue, graph_catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["scan_targets", "join_targets_transitive", "join_text_joined", "filter_annotations_related", "filter_selections_key_value", "filter_resources_key_value_text", "rel_set_equals", "rel_set_not_before", "text_sequence", "text_regex_overlap", "count_index_entries", "lang_data_of", "mut_annotate_targets", "mut_remove_datasets", "mut_reannotate_target"]


@pytest.mark.parametrize("name", NAMES)
def test_queries(spark, name):
    sql = duckdb.connect()
    for t in ("documents", "labels", "events"):
        sql.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    found = sql.sql(catalogue.oracle_sql()[name])
    at = [found.columns.index(c) for c in df.columns]
    rows = sorted(tuple(map(repr, r)) for r in df.collect())
    assert rows == sorted(tuple(repr(r[i]) for i in at) for r in found.fetchall()) and rows


def test_chains_of_any_length(spark):
    edges = [(i, 0, "AnnotationSelector", i - 1) for i in range(1, 200)] + [(500, 0, "AnnotationSelector", 501), (501, 0, "AnnotationSelector", 500)]
    columns = [c.split() for c in SCHEMAS["targets"].split(", ")]
    rows = spark.createDataFrame(edges, "a bigint, pos int, kind string, target_a bigint")
    targets = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])
    found = traversals.closure(Store.empty(spark).with_tables(targets=targets), spark.createDataFrame([(199,), (2,), (500,), (999,)], "a bigint")).collect()
    assert sorted((r.a, r.target_a) for r in found) == sorted([(199, i) for i in range(199)] + [(2, 0), (2, 1), (500, 500), (500, 501)])


def test_spans_over_the_borders_of_pieces(spark):
    text = "".join(chr(0x61 + i % 26) if i % 7 else "😀" for i in range(9000))
    store = Store.empty(spark).with_tables(resources=spark.createDataFrame([(1, "r", text, len(text), None)], SCHEMAS["resources"]))
    spans = [(1, b, min(b + n, len(text))) for b in (0, 1, 2047, 2048, 2049, 4095, 6143, 8190, 8999) for n in (0, 1, 2, 1023, 1024, 1025, 2048, 5000)]
    out = traversals.selection_text(store, spark.createDataFrame(spans, "res bigint, begin int, end int")).collect()
    assert sorted((r.begin, r.end, r.text) for r in out) == sorted((b, e, text[b:e]) for _, b, e in spans)


def test_helpers_are_defined_once():
    """Queries call helpers when they run: a second one of the same name would take the first one's place."""
    names = Counter(x.name for x in ast.parse(inspect.getsource(graph_catalogue)).body if isinstance(x, ast.FunctionDef))
    assert [n for n, c in names.items() if c > 1] == []
