"""Options of reading and writing, CSV with files, temporary and generated ids."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.model import Store
from spanloom.operators import extensions, mutations
from spanloom.plans import compiler
from spanloom.plans.query import Constraint, Query, parse, text_of
from spanloom.sources import stores


@pytest.fixture(scope="module")
def store(spark):
    texts = [("r", "some text", None), ("f", "two\nlines", "texts/f.txt"), ("e", "", "empty.txt")]
    base = mutations.add_resources(Store.empty(spark), spark.createDataFrame(texts, "id string, text string, filename string"))
    target = [("TextSelector", "r", None, None, None, None, 0, 4, "BeginBegin")]
    data = [("d", "s", "k", ("String", 'a, "b"\nc', None, None, None, None, None, None))]
    rows = [("!A7", None, target, data), ("x", None, target, [(None, "t", "k", ("Int", None, None, 5, None, None, None, None))])]
    return mutations.annotate(base, spark.createDataFrame(rows, mutations.BUILDERS))


def test_csv_with_files(spark, store, tmp_path):
    named = store.with_tables(datasets=store.datasets.withColumn("filename", F.when(F.col("id") == "s", "sets/s.csv")))
    stores.save(named, f"{tmp_path}/c.csv")
    assert (tmp_path / "c.csv/texts/f.txt").read_text() == "two\nlines" and (tmp_path / "c.csv/empty.txt").read_text() == ""
    back = stores.load(spark, f"{tmp_path}/c.csv")
    assert sorted(map(tuple, back.resources.select("id", "text", "filename").collect())) == sorted([("r", "some text", None), ("f", "two\nlines", "texts/f.txt"), ("e", "", "empty.txt")])
    assert sorted(map(tuple, back.datasets.select("id", "filename").collect())) == [("s", "sets/s.csv"), ("t", None)]
    assert sorted(map(tuple, back.named_data().select("set_id", "key_id", "value.s").collect())) == [("s", "k", 'a, "b"\nc'), ("t", "k", "5")]
    with pytest.raises(ValueError, match="names of files"):
        stores.save_csv(store.with_tables(resources=store.resources.replace("empty.txt", "manifest/x.txt", "filename")), f"{tmp_path}/d.csv")


def test_a_manifest_with_files(spark, tmp_path):
    (tmp_path / "store.csv").write_text("Type,Id,Filename\nAnnotationStore,,a.csv\nAnnotationDataSet,s,s.csv\nTextResource,r,r.txt\n")
    (tmp_path / "a.csv").write_text("Id,AnnotationData,AnnotationDataSet,SelectorType,TargetResource,BeginOffset,EndOffset\nx,d,s,TextSelector,r,0,5\n")
    (tmp_path / "s.csv").write_text("Id,Key,Value\n,bare,\nd,k,v\n")
    (tmp_path / "r.txt").write_text("Hello there\n")
    back = stores.load(spark, f"{tmp_path}/store.csv")
    assert [tuple(r) for r in back.spans().select("begin", "end").collect()] == [(0, 5)]
    assert sorted(r.id for r in back.keys.collect()) == ["bare", "k"] and back.resources.first().text == "Hello there\n"


def test_options(spark, store, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"workdir": str(tmp_path / "w"), "dataformat": {"Json": {"compact": True}}, "use_include": False, "generate_ids": True, "textrelationmap": False, "milestone_interval": 3}))
    config = stores.Config.from_file(spark, f"{tmp_path}/o.json")
    assert config == stores.Config.from_text(config.to_text()) and (config.dataformat, config.use_include, config.strip_temp_ids) == ("json", False, True)
    stores.save(store, "one", config=config)
    assert not (tmp_path / "w/texts").exists()  # one document with all texts
    back = stores.load(spark, "one", config=config)
    ids = sorted(r.id for r in back.annotations.collect())
    assert ids[1] == "x" and len(ids[0]) == 22 and ids[0][0] == "A"
    again = stores.load(spark, "one", config=config)
    assert sorted(r.id for r in again.annotations.collect()) == ids
    kept = stores.load(spark, "one", config=stores.Config(workdir=config.workdir, dataformat="json", strip_temp_ids=False))
    assert sorted(r.id for r in kept.annotations.collect()) == ["!A7", "x"]
    points = config.index(store).points.orderBy("at").collect()
    assert [(p["at"], p.byte) for p in points] == [(0, 0), (4, 4)]


def test_queries_as_values(spark, store):
    inner = Query("SELECT", "TEXT").with_name("t").with_constraint(Constraint("ANNOTATION", "x")).with_optional()
    q = Query("SELECT", "ANNOTATION").with_name("x").with_constraint(Constraint("ID", arg=("x",))).with_constraint(Constraint("LIMIT", arg=(0, 5)), "a", "b=c").with_subquery(inner).with_attributes("top")
    assert text_of(q) == '@top SELECT ANNOTATION ?x WHERE ID "x"; @a @b=c LIMIT 0 5; { SELECT OPTIONAL TEXT ?t WHERE ANNOTATION ?x; }'
    assert parse(text_of(q)) == q and q.names() == ["x", "t"] and q.at((0,)) == inner
    assert [own for _, own in q.constraints_with_attributes()] == [(), ("a", "b=c")]
    assert [own for _, own in parse("SELECT ANNOTATION WHERE @a @b ID x; ").constraints_with_attributes()] == [("a", "b")]
    assert compiler.run(store, q).select("t_begin", "t_end").collect()[0][:] == (0, 4)


@pytest.mark.parametrize("text", ['SELECT DATA WHERE VALUE = "a\\|b";', "SELECT DATA WHERE VALUE = 1|2|x;", 'SELECT DATA WHERE VALUE HAS "a b|\\"|\\\\|c\\|d";', "SELECT DATA WHERE VALUE != 2.5;"])
def test_literals_are_printed_as_they_are_read(text):
    assert parse(text_of(parse(text))) == parse(text)


def test_what_has_no_spelling():
    from spanloom.functions import values

    for op in (values.negate(values.compare("gt", 1)), values.either(values.equals("a b"), values.equals(1)), values.both(values.equals(1), values.equals(2)), values.either(values.compare("lt", 1), values.equals(2))):
        with pytest.raises(ValueError, match="no spelling"):
            text_of(Query("SELECT", "DATA").with_constraint(Constraint("VALUE", op=op)))


def test_variables_have_types(store):
    with pytest.raises(TypeError, match="RESOURCE"):
        compiler.run(store, "SELECT ANNOTATION WHERE ANNOTATION ?r;", compiler.bind("r", "RESOURCE", store.resources))
    with pytest.raises(ValueError, match="have no set"):
        compiler.bind("k", "KEY", store.resources)
    known = compiler.bind("t", "TEXT", store.spans(), compiler.bind("r", "RESOURCE", store.resources))
    assert set(known) == {"r", "t"} and known["t"][1].count() == 1


def test_lists_and_maps_in_plain_json():
    tagged = {"@type": {"@type": "String", "value": "t"}, "n": {"@type": "List", "value": [{"@type": "Float", "value": 1.5}, {"@type": "Null"}, {"@type": "Map", "value": {}}]}}
    assert extensions._bare(tagged) == {"@type": "t", "n": [1.5, None, {}]}
