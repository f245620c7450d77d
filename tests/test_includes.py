"""JSON documents by ranges, include graphs, set files, substores."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.model import SCHEMAS, Store, settled_store
from spanloom.operators import mutations
from spanloom.sources import includes, stores
from spanloom.sources.split_json import read_items


def some_value(rng, depth=0):
    k = rng.randint(0, 6 if depth < 3 else 3)
    if k == 0:
        return rng.choice(["x}", '{"a', '\\"}]', 'é"{', "\n}{", "", "\\"]) + str(rng.randint(0, 99))
    if k < 3:
        return (rng.randint(0, 9), None)[k - 1]
    if k == 3:
        return "plain text " * rng.randint(0, 6)
    return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 3))] if k == 4 else {rng.choice("abc}{") + str(i): some_value(rng, depth + 1) for i in range(rng.randint(0, 3))}


@pytest.mark.parametrize(("seed", "indent", "size"), [(1, None, 64), (2, 1, 64), (3, None, 300), (4, 4, 1000), (5, None, None)])
def test_items_by_ranges(spark, tmp_path, seed, indent, size):
    rng = random.Random(seed)
    many = lambda n: [{"@id": f"i{i}", "v": some_value(rng)} for i in range(n)]
    doc = {"@type": "AnnotationStore", "@id": "a}b{", "@include": ["x.json", "y}.json"], "resources": many(rng.choice([0, 1, 7])), "note": 'br}ace " { [', "annotationsets": many(2), "annotations": many(80), "last": {"x": 1}}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=seed % 2 == 0) + "\n")
    items, frames = read_items(spark, f"{tmp_path}/d.json", size)
    found = items.orderBy("range", "n").collect()
    for field in ("resources", "annotationsets", "annotations"):
        assert [json.loads(r.text) for r in found if r.field == field] == doc[field]
    frame = json.loads(frames.first().text)
    assert (frame["@id"], frame["@include"], frame["note"]) == (doc["@id"], doc["@include"], doc["note"])
    if size == 64:
        assert len({r.range for r in found}) > 5


@pytest.fixture(scope="module")
def graph(spark):
    """Two substores below each other, with files for a text, a set and the substores; annotations with and without ids."""
    texts = [("plain", "Inline text.", None), ("a", 'Line\nwith "quotes" and ünïcode }', "texts/a b.txt"), ("empty", "", "empty.txt"), ("own", "Only here {", None), ("nl", "ends in a line\n", "nl.txt")]
    store = mutations.add_resources(Store.empty(spark), spark.createDataFrame(texts, "id string, text string, filename string"))
    leaf = lambda kind, begin=None, end=None, **ids: (kind, ids.get("resource"), ids.get("annotation"), None, None, None, begin, end, "BeginBegin" if begin is not None else None)
    value = lambda v: (None, "filed" if v % 2 else 'set "inline"', f"key{v % 3}", ("Int", None, None, v, None, None, None, None))
    rows = [
        ("first", None, [leaf("TextSelector", 0, 4, resource="a")], [value(1)]),
        (None, None, [leaf("TextSelector", 5, 9, resource="a")], [value(2), value(3)]),
        ('on "first"', None, [leaf("AnnotationSelector", 1, 3, annotation="first")], [value(4)]),
        ("on that", None, [leaf("AnnotationSelector", 0, 1, annotation='on "first"')], []),
        ("about", None, [leaf("ResourceSelector", resource="own")], [value(5)]),
        ("two", "DirectionalSelector", [leaf("TextSelector", 3, 6, resource="plain"), leaf("TextSelector", 0, 2, resource="plain")], []),
    ]
    store = settled_store(mutations.annotate(store, spark.createDataFrame(rows, mutations.BUILDERS)))
    store = store.with_tables(datasets=store.datasets.withColumn("filename", F.when(F.col("id") == "filed", "filed.json")))
    substores = spark.createDataFrame([(0, "outer", "outer.json", [-1]), (1, "inner", "inner.json", [0])], SCHEMAS["substores"])
    ids = lambda table, handle, *names: getattr(store, table).filter(F.col("id").isin(*names)).select(F.col(handle).alias("item"))
    store = store.with_tables(substores=substores)
    store = mutations.associate(store, ids("annotations", "a", "first", "about"), "annotation", 0)
    store = mutations.associate(store, ids("annotations", "a", "two"), "annotation", 1)
    store = mutations.associate(store, ids("resources", "res", "own", "a"), "resource", 0)
    store = mutations.associate(store, ids("resources", "res", "a", "plain"), "resource", 1)
    return settled_store(mutations.associate(store, ids("datasets", "set", "filed"), "dataset", 1))


def content(store):
    """What a store holds, without handles."""
    res = store.resources.select("id", "text", "filename")
    named = store.annotations.select("a", F.coalesce("id", F.lit("?")).alias("name"), "complex")
    target = store.targets.join(store.resources.select("res", F.col("id").alias("r")), "res", "left").join(store.annotations.select(F.col("a").alias("target_a"), F.col("id").alias("t")), "target_a", "left")
    used = store.annotation_data.join(store.named_data().select("set", "data", "set_id", "key_id", "value.i"), ["set", "data"])
    member = store.substore_membership.join(store.substores.select("ss", F.col("id").alias("s")), "ss")
    for table, handle, kind in (("annotations", "a", "annotation"), ("resources", "res", "resource"), ("datasets", "set", "dataset")):
        member = member.join(getattr(store, table).select(F.col(handle).alias("item"), F.lit(kind).alias("item_type"), F.col("id").alias(kind)), ["item", "item_type"], "left")
    parents = store.substores.select("id", "filename", F.explode("parents").alias("ss")).join(store.substores.select("ss", F.col("id").alias("parent")), "ss", "left")
    frames = [
        res, store.datasets.select("id", "filename"), named.select("name", "complex"), named.join(target, "a").select("name", "pos", "kind", "r", "begin", "end", "t"),
        named.join(used, "a").select("name", "pos", "set_id", "key_id", "i"), member.select("s", "annotation", "resource", "dataset"), parents.select("id", "filename", "parent"),
    ]
    return [sorted(map(str, df.collect())) for df in frames]


def test_an_include_graph_comes_back(spark, graph, tmp_path):
    written = includes.save_include(graph, f"{tmp_path}/g", "root.json")
    assert written == sorted(["root.json", "outer.json", "inner.json", "filed.json", "texts/a b.txt", "empty.txt", "nl.txt"])
    assert (tmp_path / "g/texts/a b.txt").read_text() == 'Line\nwith "quotes" and ünïcode }' and (tmp_path / "g/nl.txt").read_text() == "ends in a line\n"
    documents = {n: json.loads((tmp_path / "g" / n).read_text()) for n in written if n.endswith(".json")}
    assert documents["root.json"]["@include"] == ["outer.json"] and documents["outer.json"]["@include"] == ["inner.json"]
    assert sorted(r.get("@include", "text") for r in documents["root.json"]["resources"]) == ["empty.txt", "nl.txt"]
    assert [x["@id"] for x in documents["inner.json"]["annotations"]] == ["two"] and len(documents["filed.json"]["data"]) == 3
    assert documents["inner.json"]["annotationsets"] == [{"@type": "AnnotationDataSet", "@id": "filed", "@include": "filed.json"}]
    for size in (None, 100):
        assert content(stores.load_json(spark, f"{tmp_path}/g/root.json", range_bytes=size)) == content(graph)


def test_only_what_changed_is_written(spark, graph, tmp_path):
    path = f"{tmp_path}/g"
    includes.save_include(graph, path, "root.json")
    assert includes.save_include(graph, path, "root.json") == []
    target = [("TextSelector", "plain", None, None, None, None, 0, 1, "BeginBegin")]
    more = mutations.annotate(graph, spark.createDataFrame([("new", None, target, [])], mutations.BUILDERS))
    assert includes.save_include(more, path, "root.json") == ["root.json"]
    (tmp_path / "g/_manifest").rename(tmp_path / "gone")  # a save that was cut short
    assert len(includes.save_include(more, path, "root.json")) == 7
    assert content(stores.load_json(spark, f"{path}/root.json")) == content(more)
    with pytest.raises(ValueError, match="one filename"):
        includes.save_include(graph.with_tables(resources=graph.resources.withColumn("filename", F.lit("x.txt"))), path)


def test_rings_and_documents_met_twice(spark, tmp_path):
    def write(name, *included):
        (tmp_path / name).write_text(json.dumps({"@type": "AnnotationStore", "@id": name[0], "@include": included[0] if len(included) == 1 else included, "resources": [{"@id": name, "text": name}]}, indent=2))

    write("r.json", "a.json", "b.json")
    write("a.json", "c.json")
    write("b.json", "c.json", "a.json")
    write("c.json", "a.json", "r.json")
    store = stores.load_json(spark, f"{tmp_path}/r.json")
    assert sorted(map(tuple, store.substores.collect())) == [(0, "a", "a.json", [-1, 1, 2]), (1, "b", "b.json", [-1]), (2, "c", "c.json", [0, 1])]
    assert sorted((r.ss, r.item) for r in store.substore_membership.collect()) == sorted((i, store.resources.filter(F.col("id") == f"{n}.json").first().res) for i, n in enumerate("abc"))


def test_sets_and_annotations_of_their_own(spark, graph, tmp_path):
    rows = [{"@id": "d1", "key": "k", "value": {"@type": "Int", "value": 3}}, {"@id": 'd"2', "key": "k", "value": {"@type": "String", "value": "}"}}]
    document = {"@type": "AnnotationDataSet", "@id": "s", "keys": [{"@id": "k"}, {"@id": "bare"}], "data": rows}
    (tmp_path / "s.json").write_text(json.dumps(document, indent=3))
    store = stores.load_dataset(spark, f"{tmp_path}/s.json", graph)
    store = stores.load_dataset_text(spark, json.dumps(document | {"data": [{"@id": "d3", "key": "late", "value": {"@type": "Bool", "value": True}}]}), store)
    own = store.datasets.filter("id = 's'")
    assert [r.filename for r in own.collect()] == ["s.json"]
    assert sorted(r.id for r in store.keys.join(own.select("set"), "set").collect()) == ["bare", "k", "late"]
    assert sorted(r.id for r in store.data.join(own.select("set"), "set").collect()) == ['d"2', "d1", "d3"]
    one = {"@type": "Annotation", "@id": "n1", "target": {"@type": "ResourceSelector", "resource": "own"}, "data": [{"@id": "d1", "set": "s"}]}
    (tmp_path / "n.json").write_text(json.dumps([one | {"@id": "n2"}, one | {"@id": "n3", "data": []}]))
    store = stores.annotate_json(stores.annotate_json_text(store, json.dumps(one)), f"{tmp_path}/n.json")
    new = store.annotations.filter("id like 'n_'")
    assert sorted(r.id for r in new.collect()) == ["n1", "n2", "n3"] and store.annotation_data.join(new, "a").count() == 2


def test_a_directory_of_lines_is_a_document(spark, tmp_path):
    lines = ['{"@type":"AnnotationStore","@id":"store","resources":[', '{"@type":"TextResource","@id":"r","text":"some text"}', '],"annotationsets":[', '{"@type":"AnnotationDataSet","@id":"s","keys":[],"data":[]}', '],"annotations":[', '{"@type":"Annotation","@id":"x","target":{"@type":"ResourceSelector","resource":"r"},"data":[]}', ',{"@type":"Annotation","@id":"y","target":{"@type":"AnnotationSelector","annotation":"x"},"data":[]}', "]}"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/store")
    store = stores.load_json(spark, f"{tmp_path}/store")
    assert sorted(r.id for r in store.annotations.collect()) == ["x", "y"] and [r.text for r in store.resources.collect()] == ["some text"]


def test_a_text_file(graph, tmp_path):
    res = graph.resources.filter("id = 'a'").first()
    stores.write_text(graph, res.res, f"{tmp_path}/t")
    assert [p.read_text() for p in tmp_path.glob("t/*/part-*")] == [res.text]
