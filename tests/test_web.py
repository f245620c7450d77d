"""JSON-LD: namespaces, contexts, aliases."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.model import Store
from spanloom.operators import extensions, mutations


@pytest.fixture(scope="module")
def store(spark):
    base = mutations.add_resources(Store.empty(spark), spark.createDataFrame([("r", "some text")], "id string, text string"))
    value = lambda v: ("String", v, None, None, None, None, None, None)
    data = [(None, "https://e.org/c.jsonld", "name", value("https://e.org/c.jsonld#one")), (None, "https://e.org/voc", "k1", value("https://else.org/x")), (None, "https://e.org/voc", "k2", value('say "x"')), (None, "plain", "https://e.org/voc/deep/key", value("v")), (None, "plain", "own key", value("urn:x"))]
    target = [("TextSelector", "r", None, None, None, None, 0, 4, "BeginBegin")]
    return mutations.annotate(base, spark.createDataFrame([("a", None, target, data)], mutations.BUILDERS))


def test_without_options(store):
    found = json.loads(extensions.web_annotations(store, store.annotations).first().json)
    assert found["@context"] == extensions.CONTEXT
    body = found["body"]
    assert body["https://e.org/c.jsonld/name"] == {"id": "https://e.org/c.jsonld#one"} and body["https://e.org/voc/k2"] == 'say "x"'
    assert body["https://e.org/voc/deep/key"] == "v" and body["urn:set:plain/own key"] == "urn:x"  # no IRI with a blank


def test_contexts_and_namespaces(store):
    assert extensions.auto_contexts(store) == ["https://e.org/c.jsonld"]
    assert extensions.namespaces_of(store) == {"https://e.org/voc/": "ns0"}
    spaces = {"https://e.org/voc/": "v", "https://e.org/voc/deep/": "d", "https://e.org/": "e"}
    found = json.loads(extensions.web_annotations(store, store.annotations, contexts=["https://e.org/c.jsonld"], namespaces=spaces).first().json)
    assert found["@context"] == [extensions.CONTEXT, "https://e.org/c.jsonld", {"v": "https://e.org/voc/", "d": "https://e.org/voc/deep/", "e": "https://e.org/"}]
    body = found["body"]
    assert (body["name"], body["v:k1"], body["d:key"]) == ("one", {"id": "https://else.org/x"}, "v")
    assert "@context" not in json.loads(extensions.web_annotations(store, store.annotations, skip_context=True).first().json)


def test_too_many_names(store, monkeypatch):
    monkeypatch.setattr(extensions, "MOST_NAMES", 0)
    with pytest.raises(ValueError, match="more than"):
        extensions.namespaces_of(store)


def test_the_longest_namespace_counts(spark):
    rows = spark.createDataFrame([("a/b/c",), ("a/x",), ("q",)], "i string")
    out = rows.select(extensions.compacted(F.col("i"), {"a/": "s", "a/b/": "l"}).alias("o")).collect()
    assert [r.o for r in out] == ["l:c", "s:x", "q"]
