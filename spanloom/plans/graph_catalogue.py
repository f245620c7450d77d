"""Queries on the graph of documents and labels, where annotations have every kind of target; each with its SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import ids
from spanloom.functions import text as texts
from spanloom.functions import values as v
from spanloom.functions.spans import Offset, Relation, resolve
from spanloom.functions.values import test
from spanloom.model import Store, settled, value
from spanloom.operators import alignment, collections, extensions, filters, mutations, related, scans, traversals
from spanloom.plans import catalogue, compiler, graph

GERMAN, TOXIC, GOOD = ("meta", "lang", v.equals("de")), ("labels", "toxic", v.equals(1)), ("labels", "quality", v.equals(1))
_G, _T = "g_d.\"set\" = 0 AND g_d.\"key\" = 0 AND s = 'de'", "g_d.\"set\" = 1 AND g_d.\"key\" = 1 AND i = 1"
#: Annotations with the data lang = de, and toxic = 1.
_DE = f"SELECT a FROM g_ad JOIN g_d USING (\"set\", data) WHERE {_G}"
_TOX = f"SELECT a FROM g_ad JOIN g_d USING (\"set\", data) WHERE {_T}"
_REACH = "g_reach AS (SELECT a, target_a FROM g_t WHERE target_a IS NOT NULL UNION SELECT x.a, y.target_a FROM g_t x JOIN g_t y ON y.a = x.target_a WHERE y.target_a IS NOT NULL)"


def on_graph(name: str, sql: str, also: str = ""):
    """Register a function of the graph's store."""

    def keep(f):
        catalogue.register(name, sql, also=", ".join(x for x in (graph.SQL, also) if x))(lambda s, d: f(graph.store(s, d)))
        return f

    return keep


def found(g: Store, what: tuple) -> DataFrame:
    return traversals.find_data(g, what[0], what[1], what[2])


def some(g: Store, what: tuple) -> DataFrame:
    """Annotations with data."""
    return traversals.data_annotations(g, found(g, what)).select("a").distinct()


def flag(g: Store, x: bool) -> DataFrame:
    return g.spark.createDataFrame([(x,)], "answer boolean")


def of_kind(g: Store, *kinds: int) -> DataFrame:
    return g.annotations.filter((F.col("a") % 16).isin(*kinds)).select("a")


# --- scans ---------------------------------------------------------------------------------------------------------

on_graph("scan_resources", "SELECT res, id, textlen FROM g_r")(lambda g: scans.scan(g, "resources").select("res", "id", "textlen"))
on_graph("scan_annotations", "SELECT a, id, complex FROM g_a")(lambda g: scans.scan(g, "annotations"))
on_graph("scan_datasets", 'SELECT "set", id FROM g_s')(lambda g: scans.scan(g, "datasets").select("set", "id"))
on_graph("scan_data", 'SELECT "set", data, id, "key", vtype, s, i, f FROM g_d')(lambda g: scans.scan(g, "data").select("set", "data", "id", "key", "value.vtype", "value.s", "value.i", "value.f"))
on_graph("scan_targets", 'SELECT a, pos, kind, res, b AS begin, e AS "end", target_a, "set", "key", data FROM g_t')(lambda g: scans.scan(g, "targets").drop("ts", "mode"))
on_graph("scan_selection_handles", 'SELECT res, ts, b AS begin, e AS "end" FROM g_ts')(lambda g: scans.scan(g, "textselections"))
on_graph("scan_resources_no_substores", "SELECT res FROM g_r WHERE res NOT IN (SELECT item FROM g_sm WHERE item_type = 'resource')")(lambda g: scans.without_substores(g, "resources").select("res"))
on_graph("scan_annotations_no_substores", "SELECT a FROM g_a WHERE a NOT IN (SELECT item FROM g_sm WHERE item_type = 'annotation')")(lambda g: scans.without_substores(g, "annotations").select("a"))
on_graph("scan_datasets_no_substores", 'SELECT "set" FROM g_s WHERE "set" <> 1')(lambda g: scans.without_substores(g, "datasets").select("set"))
on_graph("scan_substores", "SELECT ss, id FROM g_ss WHERE parent = -1")(lambda g: scans.substores(g).select("ss", "id"))
on_graph("scan_substores_nested", "SELECT ss, id FROM g_ss")(lambda g: scans.substores(g, nested=True).select("ss", "id"))
on_graph("scan_substore_by_id", "SELECT ss FROM g_ss WHERE id = 'second'")(lambda g: scans.lookup(g, "substores", "second").select("ss"))
on_graph("scan_data_by_id", 'SELECT "set", "key", i FROM g_d WHERE id = \'toxic=2000001\'')(lambda g: scans.lookup(g, "data", "toxic=2000001", "labels").select("set", "key", "value.i"))
on_graph("scan_selection_by_handle", 'SELECT res, b AS begin, e AS "end" FROM g_ts WHERE ts = 1')(lambda g: scans.lookup(g, "textselections", 1).select("res", "begin", "end"))
on_graph("scan_resolve_ids", "SELECT * FROM (VALUES ('k0/3', 48), ('!A17', 17), ('nothing', NULL)) x(id, a)")(lambda g: scans.resolve_ids(g, "annotations", g.spark.createDataFrame([("k0/3",), ("!A17",), ("nothing",)], "id string")).select("id", "a"))
on_graph("scan_known_or_not", "SELECT d AS res, 0 AS begin, least(10, n) AS \"end\", ts FROM g_doc JOIN g_ts ON g_ts.res = d AND g_ts.b = 0 AND g_ts.e = least(10, n) UNION ALL SELECT d, 1, 3, NULL FROM g_doc")(lambda g: scans.known(g, g.resources.select("res", F.lit(0).alias("begin"), F.least(F.lit(10), "textlen").alias("end")).unionByName(g.resources.select("res", F.lit(1).alias("begin"), F.lit(3).alias("end")))).select("res", "begin", "end", "ts"))
on_graph("scan_positions_in_range", 'SELECT DISTINCT res, p AS "at" FROM (SELECT res, b AS p FROM g_ts UNION ALL SELECT res, e FROM g_ts) WHERE p >= 4 AND p < 11')(lambda g: scans.positions(g, "both", 4, 11))
on_graph("scan_positions_begin", 'SELECT DISTINCT res, b AS "at" FROM g_ts')(lambda g: scans.positions(g, "begin"))
on_graph("scan_positions_end", 'SELECT DISTINCT res, e AS "at" FROM g_ts')(lambda g: scans.positions(g, "end"))
on_graph("scan_ends_in_range", 'SELECT res, ts FROM g_ts WHERE e >= 4 AND e < 11')(lambda g: scans.selections_in_range(g, 4, 11, "end").select("res", "ts"))
on_graph("scan_position_of", "SELECT a, n FROM (SELECT a, row_number() OVER (PARTITION BY a // 16 ORDER BY a DESC) - 1 AS n FROM g_a)")(lambda g: scans.numbered(g.annotations.select("a", F.expr("a div 16").alias("d"), (-F.col("a")).alias("o")), ["o"], "n", ["d"]).select("a", "n"))

# --- traversals ----------------------------------------------------------------------------------------------------

on_graph("join_targets", "SELECT DISTINCT a, target_a FROM g_t WHERE target_a IS NOT NULL")(lambda g: traversals.annotation_targets(g, g.annotations))
on_graph("join_targets_transitive", "SELECT a, target_a FROM g_reach", _REACH)(lambda g: traversals.annotation_targets(g, g.annotations, transitive=True))
on_graph("join_targets_of_some", "SELECT a, target_a FROM g_reach WHERE a % 16 = 3", _REACH)(lambda g: traversals.closure(g, of_kind(g, 3)))
on_graph("join_annotations_on_annotations", "SELECT DISTINCT target_a AS a, a AS \"by\" FROM g_t WHERE target_a % 16 = 0")(lambda g: traversals.annotation_annotations(g, of_kind(g, 0)))
on_graph("join_annotation_resources", "SELECT DISTINCT a, res FROM (SELECT a, res FROM g_t WHERE kind IN ('TextSelector', 'AnnotationSelector') AND res IS NOT NULL UNION ALL SELECT r.a, t.res FROM g_reach r JOIN g_t t ON t.a = r.target_a WHERE t.kind IN ('TextSelector', 'AnnotationSelector') AND t.res IS NOT NULL)", _REACH)(lambda g: traversals.annotation_resources(g, g.annotations))
on_graph("join_annotation_resources_metadata", "SELECT DISTINCT a, res FROM g_t WHERE kind = 'ResourceSelector'")(lambda g: traversals.annotation_resources(g, g.annotations, metadata=True))
on_graph("join_annotation_resources_direct", "SELECT DISTINCT a, res FROM g_sp")(lambda g: traversals.annotation_resources(g, g.annotations, transitive=False))
on_graph("join_annotation_datasets", "SELECT a, \"set\" FROM g_t WHERE kind = 'DataSetSelector'")(lambda g: traversals.annotation_datasets(g, g.annotations))
on_graph("join_annotation_selections", 'SELECT a, pos, res, b AS begin, e AS "end", ts FROM g_sp WHERE a % 16 IN (0, 4)')(lambda g: traversals.annotation_selections(g, of_kind(g, 0, 4)))
on_graph("join_text_of_single", "SELECT a, substr(text, CAST(b AS INT) + 1, CAST(e - b AS INT)) AS text FROM g_sp JOIN g_r USING (res) WHERE a % 16 <> 4")(lambda g: traversals.annotation_text(g, g.annotations))
on_graph("join_text_joined", "SELECT a, string_agg(substr(text, CAST(b AS INT) + 1, CAST(e - b AS INT)), '|' ORDER BY pos) AS text FROM g_sp JOIN g_r USING (res) GROUP BY a")(lambda g: traversals.annotation_text(g, g.annotations, "|"))
on_graph("join_selection_text", 'SELECT res, ts, substr(text, CAST(b AS INT) + 1, CAST(e - b AS INT)) AS text FROM g_ts JOIN g_r USING (res)')(lambda g: traversals.selection_text(g, g.textselections).select("res", "ts", "text"))
on_graph("join_annotation_data", 'SELECT a, "set", data FROM g_ad')(lambda g: traversals.annotation_data(g, g.annotations))
on_graph("join_annotation_data_metadata", "SELECT a, \"set\", data FROM g_t WHERE kind = 'AnnotationDataSelector'")(lambda g: traversals.annotation_data(g, g.annotations, metadata=True))
on_graph("join_annotation_keys_metadata", "SELECT a, \"set\", \"key\" FROM g_t WHERE kind = 'DataKeySelector'")(lambda g: traversals.annotation_keys(g, g.annotations, metadata=True))
on_graph("join_selection_annotations", 'SELECT DISTINCT res, b AS begin, e AS "end", a FROM g_sp WHERE b = 0')(lambda g: traversals.selection_annotations(g, g.textselections.filter("begin = 0")))
on_graph("join_resource_selections", "SELECT res, ts FROM g_ts JOIN g_doc ON d = res WHERE lang = 'es'")(lambda g: traversals.resource_selections(g, filters.resources_with_data(g, g.resources, found(g, ("meta", "lang", v.equals("es"))))).select("res", "ts"))
on_graph("join_whole_resource", 'SELECT res, 0 AS begin, textlen AS "end" FROM g_r')(lambda g: traversals.whole(g, g.resources))
on_graph("join_data_annotations_metadata", "SELECT \"set\", data, a FROM g_t WHERE kind = 'AnnotationDataSelector'")(lambda g: traversals.data_annotations(g, g.data, metadata=True))
on_graph("join_data_resources_text", f'SELECT DISTINCT "set", data, res FROM g_ad JOIN g_sp USING (a) JOIN g_d USING ("set", data) WHERE {_G}')(lambda g: traversals.data_resources(g, found(g, GERMAN)))
on_graph("join_data_datasets", 'SELECT DISTINCT g_ad."set", g_ad.data, t."set" AS about FROM g_ad JOIN g_t t USING (a) WHERE t.kind = \'DataSetSelector\'')(lambda g: traversals.data_datasets(g, g.data))
on_graph("join_data_keys", f'SELECT DISTINCT "set", "key" FROM g_d WHERE {_G} OR {_T}')(lambda g: traversals.data_keys(g, found(g, GERMAN).unionByName(found(g, TOXIC))))
on_graph("join_key_data", "SELECT \"set\", \"key\", data FROM g_d WHERE \"set\" = 0 AND \"key\" = 1")(lambda g: traversals.key_data(g, scans.lookup(g, "keys", "source", "meta")))
on_graph("join_key_annotations_metadata", "SELECT \"set\", \"key\", a FROM g_t WHERE kind = 'DataKeySelector'")(lambda g: traversals.key_annotations(g, g.keys, metadata=True))
on_graph("join_key_resources_text", 'SELECT DISTINCT 0 AS "set", 0 AS "key", res FROM g_ad JOIN g_sp USING (a) JOIN g_d USING ("set", data) WHERE g_d."set" = 0 AND g_d."key" = 0')(lambda g: traversals.key_resources(g, scans.lookup(g, "keys", "lang", "meta")))
on_graph("join_key_datasets", 'SELECT DISTINCT g_d."set", g_d."key", t."set" AS about FROM g_ad JOIN g_d USING ("set", data) JOIN g_t t USING (a) WHERE t.kind = \'DataSetSelector\'')(lambda g: traversals.key_datasets(g, g.keys))
on_graph("join_set_annotations", "SELECT \"set\", a FROM g_t WHERE kind = 'DataSetSelector'")(lambda g: traversals.set_annotations(g, g.datasets))
on_graph("join_set_data", 'SELECT "set", data FROM g_d WHERE "set" = 1')(lambda g: traversals.set_data(g, scans.lookup(g, "datasets", "labels")))
on_graph("join_set_keys", 'SELECT "set", "key" FROM g_k WHERE "set" = 1')(lambda g: traversals.set_keys(g, scans.lookup(g, "datasets", "labels")))
on_graph("join_substore_annotations", "SELECT ss, item FROM g_sm WHERE item_type = 'annotation'")(lambda g: traversals.members(g, g.substores, "annotation"))
on_graph("join_substore_resources", "SELECT ss, item FROM g_sm WHERE item_type = 'resource'")(lambda g: traversals.members(g, g.substores, "resource"))
on_graph("join_substore_datasets", "SELECT ss, item FROM g_sm WHERE item_type = 'dataset'")(lambda g: traversals.members(g, g.substores, "dataset"))
on_graph("join_annotation_substore", "SELECT a AS item, ss FROM g_a LEFT JOIN g_sm ON item_type = 'annotation' AND item = a")(lambda g: traversals.item_substores(g, g.annotations.select(F.col("a").alias("item")), "annotation"))
on_graph("join_resource_substores", "SELECT res AS item, ss FROM g_r LEFT JOIN g_sm ON item_type = 'resource' AND item = res")(lambda g: traversals.item_substores(g, g.resources.select(F.col("res").alias("item")), "resource"))
on_graph("join_dataset_substores", "SELECT g_s.\"set\" AS item, ss FROM g_s LEFT JOIN g_sm ON item_type = 'dataset' AND item = g_s.\"set\"")(lambda g: traversals.item_substores(g, g.datasets.select(F.col("set").alias("item")), "dataset"))
on_graph("join_child_substores", "SELECT ss FROM g_ss WHERE parent = 0")(lambda g: traversals.child_substores(g, 0).select("ss"))
on_graph("join_datasets_by_metadata", 'SELECT t."set" AS about, g_ad."set", g_ad.data FROM g_ad JOIN g_t t USING (a) WHERE t.kind = \'DataSetSelector\'')(lambda g: traversals.datasets_by_metadata(g, g.data))
on_graph("join_find_data_float", "SELECT \"set\", data FROM g_d WHERE vtype = 'Float' AND f >= 100.5")(lambda g: traversals.find_data(g, "labels", "score", v.compare("ge", 100.5)).select("set", "data"))
on_graph("join_test_data", "SELECT count(*) > 0 AS answer FROM g_d WHERE s = 'de'")(lambda g: flag(g, collections.exists(found(g, GERMAN))))
on_graph("join_test_no_data", "SELECT false AS answer")(lambda g: flag(g, collections.exists(traversals.find_data(g, "meta", "lang", v.equals("nowhere")))))

# --- filters -------------------------------------------------------------------------------------------------------

on_graph("filter_by_handle", "SELECT a FROM g_a WHERE a IN (0, 17, 35)")(lambda g: filters.in_collection(g.annotations, g.spark.createDataFrame([(0,), (17,), (35,), (-4,)], "a long"), ["a"]).select("a"))
on_graph("filter_resources_any", "SELECT res FROM g_r WHERE res < 7")(lambda g: filters.in_collection(g.resources, g.spark.range(7).select(F.col("id").alias("res")), ["res"]).select("res"))
on_graph("filter_data_any", f'SELECT "set", data FROM g_d WHERE {_G} OR {_T}')(lambda g: filters.in_collection(g.data, filters.any_of([found(g, GERMAN), found(g, TOXIC)], ["set", "data"]), ["set", "data"]).select("set", "data"))
on_graph("filter_data_key", 'SELECT "set", data FROM g_d WHERE "set" = 1 AND "key" = 0')(lambda g: filters.in_collection(g.data, scans.lookup(g, "keys", "quality", "labels"), ["set", "key"]).select("set", "data"))
on_graph("filter_data_set", 'SELECT "set", data FROM g_d WHERE "set" = 0')(lambda g: filters.in_collection(g.data, scans.lookup(g, "datasets", "meta"), ["set"]).select("set", "data"))
on_graph("filter_keys_set", 'SELECT "set", "key" FROM g_k WHERE "set" = 0')(lambda g: filters.in_collection(g.keys, scans.lookup(g, "datasets", "meta"), ["set"]).select("set", "key"))
on_graph("filter_selections_resource", "SELECT res, ts FROM g_ts WHERE res = 9")(lambda g: filters.in_collection(g.textselections, scans.lookup(g, "resources", "doc9"), ["res"]).select("res", "ts"))
on_graph("filter_annotations_key_value", f'SELECT DISTINCT a FROM g_ad JOIN g_d USING ("set", data) WHERE {_G}')(lambda g: filters.annotations_with_value(g, g.annotations, v.equals("de"), scans.lookup(g, "keys", "lang", "meta")).select("a"))
on_graph("filter_annotations_set", 'SELECT DISTINCT a FROM g_ad WHERE "set" = 1')(lambda g: filters.annotations_with_set(g, g.annotations, scans.lookup(g, "datasets", "labels")).select("a"))
on_graph("filter_annotations_resource_metadata", "SELECT a FROM g_t WHERE kind = 'ResourceSelector' AND res = 6")(lambda g: filters.annotations_on_resource(g, g.annotations, scans.lookup(g, "resources", "doc6"), metadata=True).select("a"))
on_graph("filter_annotations_on_selections", "SELECT DISTINCT a FROM g_sp WHERE b = 6")(lambda g: filters.annotations_on_selections(g, g.annotations, g.textselections.filter("begin = 6")).select("a"))
on_graph("filter_annotations_targeting", f"SELECT DISTINCT a FROM g_t WHERE target_a IN ({_DE})")(lambda g: filters.annotations_targeting(g, g.annotations, some(g, GERMAN)).select("a"))
on_graph("filter_annotations_targeting_transitive", f"SELECT DISTINCT a FROM g_reach WHERE target_a IN ({_DE})", _REACH)(lambda g: filters.annotations_targeting(g, g.annotations, some(g, GERMAN), transitive=True).select("a"))
on_graph("filter_annotations_targeted_by", f"SELECT DISTINCT target_a AS a FROM g_t WHERE target_a IS NOT NULL AND a IN ({_TOX})")(lambda g: filters.annotations_targeted_by(g, g.annotations, some(g, TOXIC)).select("a"))
on_graph("filter_annotations_targeted_by_transitive", "SELECT DISTINCT target_a AS a FROM g_reach WHERE a % 16 = 3 AND a < 1600", _REACH)(lambda g: filters.annotations_targeted_by(g, g.annotations, of_kind(g, 3).filter("a < 1600"), transitive=True).select("a"))
on_graph("filter_annotations_related", "SELECT DISTINCT w.a FROM g_sp w JOIN g_sp l ON l.res = w.res AND l.a % 16 = 0 AND w.b >= l.b AND w.e <= l.e")(lambda g: filters.annotations_related(g, g.annotations, g.spans().filter("a % 16 = 0"), "embeds").select("a"))
on_graph("filter_annotations_in_substore", "SELECT item AS a FROM g_sm WHERE item_type = 'annotation' AND ss = 0")(lambda g: filters.in_substore(g, g.annotations, "a", "annotation", 0).select("a"))
on_graph("filter_annotations_in_no_substore", "SELECT a FROM g_a WHERE a NOT IN (SELECT item FROM g_sm WHERE item_type = 'annotation')")(lambda g: filters.in_substore(g, g.annotations, "a", "annotation", None).select("a"))
on_graph("filter_annotations_text_joined", "SELECT a FROM (SELECT a, string_agg(substr(text, CAST(b AS INT) + 1, CAST(e - b AS INT)), ' ' ORDER BY pos) AS t FROM g_sp JOIN g_r USING (res) GROUP BY a) WHERE regexp_matches(t, '^[A-Z][a-z]+\\.')")(lambda g: filters.annotations_matching(g, g.annotations, r"^[A-Z][a-z]+\.").select("a"))
_SEL = 'SELECT DISTINCT res, b AS begin, e AS "end" FROM g_sp JOIN g_ad USING (a) JOIN g_d USING ("set", data) WHERE '
_spans = lambda g: g.textselections.select("res", "begin", "end")
on_graph("filter_selections_data", _SEL + _G)(lambda g: filters.selections_with_data(g, _spans(g), found(g, GERMAN)))
on_graph("filter_selections_data_every", 'SELECT res, b AS begin, e AS "end" FROM g_sp JOIN g_ad USING (a) JOIN g_d USING ("set", data) WHERE (' + f"{_T}) OR (g_d.\"set\" = 0 AND g_d.\"key\" = 0 AND s = 'en')" + ' GROUP BY ALL HAVING count(DISTINCT (g_d."set", data)) = 2')(lambda g: filters.selections_with_data(g, _spans(g), found(g, TOXIC).unionByName(found(g, ("meta", "lang", v.equals("en")))), every=True))
on_graph("filter_selections_key", _SEL + 'g_d."set" = 1 AND g_d."key" = 1')(lambda g: filters.selections_with_key(g, _spans(g), scans.lookup(g, "keys", "toxic", "labels")))
on_graph("filter_selections_key_value", _SEL + _T)(lambda g: filters.selections_with_key(g, _spans(g), scans.lookup(g, "keys", "toxic", "labels"), v.equals(1)))
on_graph("filter_selections_value", _SEL + "i = 0")(lambda g: filters.selections_with_value(g, _spans(g), v.equals(0)))
on_graph("filter_selections_set", _SEL + 'g_d."set" = 1')(lambda g: filters.selections_with_set(g, _spans(g), scans.lookup(g, "datasets", "labels")))
on_graph("filter_selections_text", "SELECT res, ts FROM g_ts JOIN g_r USING (res) WHERE substr(text, CAST(b AS INT) + 1, CAST(e - b AS INT)) = 'The '")(lambda g: filters.selections_with_text(g, g.textselections, "The ").select("res", "ts"))
on_graph("filter_selections_text_nocase", "SELECT res, ts FROM g_ts JOIN g_r USING (res) WHERE lower(substr(text, CAST(b AS INT) + 1, CAST(e - b AS INT))) = 'the '")(lambda g: filters.selections_with_text(g, g.textselections, "THE ", case_sensitive=False).select("res", "ts"))
on_graph("filter_selections_regex", "SELECT res, ts FROM g_ts JOIN g_r USING (res) WHERE regexp_matches(substr(text, CAST(b AS INT) + 1, CAST(e - b AS INT)), '^[A-Z][a-z]{2,3}')")(lambda g: filters.selections_matching(g, g.textselections, "^[A-Z][a-z]{2,3}").select("res", "ts"))
for _meta, _kinds in ((False, "kind IN ('TextSelector', 'AnnotationSelector')"), (True, "kind = 'ResourceSelector'")):
    _on, _res = ("metadata", f"SELECT DISTINCT res FROM g_t JOIN g_ad USING (a) JOIN g_d ON g_d.\"set\" = g_ad.\"set\" AND g_d.data = g_ad.data WHERE res IS NOT NULL AND {_kinds} AND ") if _meta else ("text", f"SELECT DISTINCT res FROM g_t JOIN g_ad USING (a) JOIN g_d ON g_d.\"set\" = g_ad.\"set\" AND g_d.data = g_ad.data WHERE res IS NOT NULL AND {_kinds} AND ")
    on_graph(f"filter_resources_key_{_on}", _res + ('g_d."set" = 1 AND g_d."key" = 0' if _meta else 'g_d."set" = 1 AND g_d."key" = 1'))(lambda g, m=_meta: filters.resources_with_key(g, g.resources, scans.lookup(g, "keys", "quality" if m else "toxic", "labels"), metadata=m).select("res"))
    on_graph(f"filter_resources_key_value_{_on}", _res + ('g_d."set" = 1 AND g_d."key" = 0 AND i = 1' if _meta else _T))(lambda g, m=_meta: filters.resources_with_key(g, g.resources, scans.lookup(g, "keys", "quality" if m else "toxic", "labels"), v.equals(1), metadata=m).select("res"))
    on_graph(f"filter_resources_value_{_on}", _res + "i >= 1")(lambda g, m=_meta: filters.resources_with_value(g, g.resources, v.compare("ge", 1), metadata=m).select("res"))
    on_graph(f"filter_resources_set_{_on}", _res + 'g_d."set" = 1')(lambda g, m=_meta: filters.resources_with_set(g, g.resources, scans.lookup(g, "datasets", "labels"), metadata=m).select("res"))
    on_graph(f"filter_resources_annotations_{_on}", f"SELECT DISTINCT res FROM g_t WHERE res IS NOT NULL AND {_kinds} AND a IN (" + (f"SELECT a FROM g_ad JOIN g_d USING (\"set\", data) WHERE g_d.\"set\" = 1 AND g_d.\"key\" = 0 AND i = 1" if _meta else _DE) + ")")(lambda g, m=_meta: filters.resources_with_annotations(g, g.resources, some(g, GOOD if m else GERMAN), metadata=m).select("res"))
on_graph("filter_resources_all", "SELECT res FROM g_r WHERE (SELECT count(*) FROM g_r WHERE res IN (1, 2, 5)) = 3")(lambda g: filters.all_or_nothing(g.resources, g.spark.createDataFrame([(1,), (2,), (5,)], "res long"), ["res"]).select("res"))
on_graph("filter_data_of_annotations", 'SELECT DISTINCT "set", data FROM g_ad WHERE a % 16 = 2')(lambda g: filters.data_of_annotations(g, g.data, of_kind(g, 2)).select("set", "data"))
on_graph("filter_keys_of_annotations", 'SELECT DISTINCT "set", "key" FROM g_ad JOIN g_d USING ("set", data) WHERE a % 16 IN (1, 3)')(lambda g: filters.keys_of_annotations(g, g.keys, of_kind(g, 1, 3)).select("set", "key"))
on_graph("filter_resources_in_substore", "SELECT item AS res FROM g_sm WHERE item_type = 'resource'")(lambda g: filters.in_substore(g, g.resources, "res", "resource", 1).select("res"))

# --- values --------------------------------------------------------------------------------------------------------

_real, _time = (lambda: value("Float", F.col("value"))), (lambda: value("Datetime", F.col("ts")))
_FIRST = "(SELECT min(ts) FROM events)"
catalogue._tested("equals_float", v.equals(6.55), _real, "value = 6.55")
catalogue._tested("at_least_float", v.compare("ge", 6.55), _real, "value >= 6.55")
catalogue._tested("less_float", v.compare("lt", 6.55), _real, "value < 6.55")
catalogue._tested("has_float", v.has_element(2.5), lambda: value("List", F.concat(F.lit('[{"@type":"Float","value":'), (F.col("user_id") % 3 + 0.5).cast("string"), F.lit("}]"))), "user_id % 3 = 2")
catalogue._tested("true", ("true",), lambda: value("Bool", F.col("user_id") > 20), "user_id > 20")
catalogue._tested("false", ("false",), lambda: value("Bool", F.col("user_id") > 20), "NOT user_id > 20")
catalogue._tested("null_of_some", v.null(), lambda: F.when(F.col("user_id") % 2 == 0, value("Null")).otherwise(value("Int", F.col("user_id"))), "user_id % 2 = 0")
catalogue._tested("not_any", v.negate(v.both(v.anything(), v.compare("gt", 20))), lambda: value("Int", F.col("user_id")), "NOT user_id > 20")
for _name, _how, _sign in (("exact", "eq", "="), ("before", "lt", "<"), ("at_or_after", "ge", ">="), ("at_or_before", "le", "<=")):

    @catalogue.register(f"data_op_{_name}_datetime", f"SELECT event_id FROM events WHERE ts {_sign} (SELECT max(ts) FROM events WHERE ts <= {_FIRST} + INTERVAL 5 DAY)")
    def _compared(s, d, how=_how):
        events = catalogue._events(s, d)
        first = events.agg(F.min("ts")).first()[0]
        at = events.filter(F.col("ts") <= first + timedelta(days=5)).agg(F.max("ts")).first()[0]
        return events.filter(test(_time(), v.compare(how, at))).select("event_id")


# --- relations -----------------------------------------------------------------------------------------------------


def pairs(g: Store, r: Relation | str) -> DataFrame:
    one, two = g.spans().filter("a % 16 in (0, 9)"), g.spans().filter("a % 16 <> 0")
    return related.join_related(one.select("res", "begin", "end", "a"), two.select("res", "begin", "end", "a"), r).select("a", F.col("r_a").alias("b"))


_PAIR = "SELECT x.a AS a, y.a AS b FROM g_sp x JOIN g_sp y ON x.res = y.res AND x.a % 16 IN (0, 9) AND y.a % 16 <> 0 WHERE "
for _name, _rel, _cond in (
    ("precedes_touching", Relation("precedes", whitespace=False), "y.b = x.e"),
    ("succeeds_touching", Relation("succeeds", whitespace=False), "y.e = x.b"),
    ("inset", "inset", "y.b = x.b AND y.e = x.e"),
    ("samerange", "samerange", "y.b = x.b AND y.e = x.e"),
    ("after", "after", "x.b >= y.e"),
    ("not_overlaps", Relation("overlaps", negate=True), "NOT (y.b < x.e AND y.e > x.b)"),
    ("not_equals", Relation("equals", negate=True), "NOT (y.b = x.b AND y.e = x.e)"),
    ("not_samebegin", Relation("samebegin", negate=True), "y.b <> x.b"),
):
    on_graph(f"rel_{_name}", _PAIR + _cond)(lambda g, r=_rel: pairs(g, r))
on_graph("rel_succeeds", "SELECT x.a AS a, y.a AS b FROM g_sp x JOIN g_sp y ON x.res = y.res AND x.a % 16 IN (4, 9) AND y.a % 16 IN (0, 2, 4) JOIN g_r t ON t.res = x.res WHERE y.e = x.b OR y.e < x.b AND x.b - y.e <= 10 AND trim(substr(t.text, CAST(y.e AS INT) + 1, CAST(x.b - y.e AS INT)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''")(lambda g: related.join_related(g.spans().filter("a % 16 in (4, 9)").select("res", "begin", "end", "a"), g.spans().filter("a % 16 in (0, 2, 4)").select("res", "begin", "end", "a"), "succeeds", g.resources).select("a", F.col("r_a").alias("b")))
on_graph("rel_related_embedded", 'SELECT DISTINCT w.res, w.ts FROM g_sp l JOIN g_ts w ON w.res = l.res AND l.a % 16 = 2 AND l.b >= w.b AND l.e <= w.e AND (l.b <> w.b OR l.e <> w.e)')(lambda g: related.related_text(g, g.spans().filter("a % 16 = 2"), "embedded").select("res", "ts"))

#: Sets of spans, one of each side per document, of different annotations by the document's number.
_MINE = "a % 16 = 4 AND a {0} 16 % 3 = 0 OR a % 16 = 9 AND a {0} 16 % 3 = 1 OR a % 16 = 0 AND a {0} 16 % 3 = 2"
_OTHERS = "a % 16 = 0 AND a {0} 16 % 4 < 3 OR a % 16 = 9 AND a {0} 16 % 2 = 0 OR a % 16 = 8 AND a {0} 16 % 5 = 0 OR a % 16 = 4 AND a {0} 16 % 7 = 0"
_M = f"m AS (SELECT DISTINCT res, b, e FROM g_sp WHERE {_MINE.format('//')}), o AS (SELECT DISTINCT res, b, e FROM g_sp WHERE {_OTHERS.format('//')}), mb AS (SELECT res, min(b) AS b, max(e) AS e, count(*) AS n FROM m GROUP BY res), ob AS (SELECT res, min(b) AS b, max(e) AS e, count(*) AS n FROM o GROUP BY res), both_ AS (SELECT mb.res, mb.b, mb.e, mb.n, ob.b AS ob, ob.e AS oe, ob.n AS o_n FROM mb JOIN ob USING (res))"
_OPS = {"overlaps": "o.b < m.e AND o.e > m.b", "embeds": "o.b >= m.b AND o.e <= m.e", "embedded": "m.b >= o.b AND m.e <= o.e", "before": "m.e <= o.b", "after": "m.b >= o.e", "equals": "m.b = o.b AND m.e = o.e", "inset": "m.b = o.b AND m.e = o.e"}


def _set_related(g: Store, r: Relation) -> DataFrame:
    return related.set_related(g.spans().filter(_MINE.format("div")), g.spans().filter(_OTHERS.format("div")), [], [], r).select("res")


for _op, _cond in _OPS.items():
    _any = f"NOT EXISTS (SELECT 1 FROM m WHERE m.res = both_.res AND NOT EXISTS (SELECT 1 FROM o WHERE o.res = m.res AND {_cond}))" + (" AND n = o_n" if _op == "equals" else "")
    on_graph(f"rel_set_{_op}", f"SELECT res FROM both_ WHERE {_any}", _M)(lambda g, r=_op: _set_related(g, Relation(r)))
    on_graph(f"rel_set_not_{_op}", f"SELECT res FROM both_ WHERE NOT ({_any})", _M)(lambda g, r=_op: _set_related(g, Relation(r, negate=True)))
    if _op not in ("equals", "inset"):
        _every = f"NOT EXISTS (SELECT 1 FROM m JOIN o ON o.res = m.res WHERE m.res = both_.res AND NOT ({_cond}))"
        on_graph(f"rel_set_{_op}_every", f"SELECT res FROM both_ WHERE {_every}", _M)(lambda g, r=_op: _set_related(g, Relation(r, every=True)))
for _op, _cond in {"samebegin": "b = ob", "sameend": "e = oe", "samerange": "b = ob AND e = oe", "precedes": "e = ob"}.items():
    on_graph(f"rel_set_{_op}_every", f"SELECT res FROM both_ WHERE {_cond}", _M)(lambda g, r=_op: _set_related(g, Relation(r, every=True, whitespace=False)))
on_graph("rel_set_members", "SELECT res, n, b AS first, e AS last FROM mb", _M)(lambda g: related.members(g.spans().filter(_MINE.format("div")), []).select("res", "n", "first", "last"))

# --- texts ---------------------------------------------------------------------------------------------------------

on_graph("text_segments_in_range", 'SELECT res, p AS begin, nxt AS "end" FROM (SELECT res, p, lead(p) OVER (PARTITION BY res ORDER BY p) AS nxt FROM (SELECT DISTINCT res, p FROM (SELECT res, b AS p FROM g_ts UNION ALL SELECT res, e FROM g_ts UNION ALL SELECT res, 2 FROM g_r UNION ALL SELECT res, least(textlen, 15) FROM g_r) JOIN g_r USING (res) WHERE p BETWEEN 2 AND least(textlen, 15))) WHERE nxt IS NOT NULL')(lambda g: texts.segments(g.resources, g.textselections, 2, 15))
on_graph("text_position_of_byte", "SELECT a, b AS position FROM g_sp WHERE a % 16 IN (4, 8)")(lambda g: g.spans().filter("a % 16 in (4, 8)").join(g.resources.select("res", "text"), "res").select("a", texts.position_of(F.col("text"), texts.byte_of(F.col("text"), F.col("begin"))).alias("position")))
_SEQUENCE = "q AS (SELECT res, p0, p0 + 3 + length(regexp_extract(substr(text, CAST(p0 AS INT) + 4), '^\\s*')) AS p1 FROM (SELECT res, text, length(regexp_extract(text, '(?s)^(.*?)the\\s*of', 1)) AS p0 FROM g_r WHERE regexp_matches(text, 'the\\s*of')))"
on_graph("text_sequence", 'SELECT res, 0 AS pos, p0 AS begin, p0 + 3 AS "end" FROM q UNION ALL SELECT res, 1, p1, p1 + 2 FROM q', _SEQUENCE)(lambda g: texts.find_sequence(g.resources.select("res", "text"), ["the", "of"]).select("res", "pos", "begin", "end"))
_WORDS = "SELECT res, CAST(length(regexp_extract(text, '(?s)^(.*?)[a-z]+tion', 1)) AS BIGINT) AS begin, length(regexp_extract(text, '[a-z]+tion')) AS n FROM g_r WHERE regexp_matches(text, '[a-z]+tion')"
on_graph("text_regex_whole", f'SELECT res, begin, begin + n AS "end" FROM ({_WORDS})')(lambda g: texts.find_regex(g.resources.select("res", "text"), ["[a-z]+tion"]).filter("match = 0").select("res", "begin", "end"))
on_graph("text_regex_counts", "SELECT res, e - 1 AS expression, n FROM (SELECT res, generate_subscripts(l, 1) AS e, unnest(l) AS n FROM (SELECT res, [len(regexp_extract_all(text, '[0-9]+')), len(regexp_extract_all(text, '[A-Z][a-z]*'))] AS l FROM g_r)) WHERE n > 0")(lambda g: texts.find_regex(g.resources.select("res", "text"), ["[0-9]+", "[A-Z][a-z]*"]).groupBy("res", "expression").agg(F.count("*").alias("n")))
on_graph("text_regex_overlap", "SELECT res, len(regexp_extract_all(text, 'th')) + len(regexp_extract_all(text, 'he')) AS n FROM g_r WHERE regexp_matches(text, 'th|he')")(lambda g: texts.find_regex(g.resources.select("res", "text"), ["th", "he"], overlap=True).groupBy("res").agg(F.count("*").alias("n")))
on_graph("text_offset_absolute", 'SELECT d AS res, n - 6 AS begin, n - 2 AS "end" FROM g_doc WHERE n >= 6')(lambda g: g.resources.select("res", *[c.alias(n) for c, n in zip(Offset.parse("-6:-2").columns(F.col("textlen")), ("begin", "end"), strict=True)]).filter("begin <= end"))
on_graph("text_offset_shifted", 'SELECT d AS res, 5 AS begin, 7 AS "end", 2 AS n FROM g_doc WHERE n >= 7')(lambda g: g.resources.select("res", *[c.alias(n) for c, n in zip(Offset(2, 4).shift(3).columns(F.col("textlen")), ("begin", "end"), strict=True)], F.lit(len(Offset(2, 4))).alias("n")).filter("end is not null"))
on_graph("text_offset_in_annotation", 'SELECT a, b + 1 AS begin, e - 1 AS "end" FROM g_sp WHERE a % 16 = 9 AND e - b >= 2')(lambda g: g.spans().filter("a % 16 = 9").withColumn("o", resolve(F.lit(1), F.lit(-1), F.lit("BeginEnd"), F.col("begin"), F.col("end"))).filter("o is not null").select("a", "o.begin", "o.end"))

# --- sets, orders, counts ------------------------------------------------------------------------------------------

on_graph("set_contains_all", "SELECT true AS answer")(lambda g: flag(g, collections.contains_all(g.annotations.select("a"), some(g, GERMAN))))
on_graph("set_contains_not_all", "SELECT false AS answer")(lambda g: flag(g, collections.contains_all(some(g, GERMAN), g.annotations.select("a"))))
on_graph("order_textual", 'SELECT DISTINCT res, b AS begin, e AS "end" FROM g_sp')(lambda g: collections.textual_order(g.spans().select("res", "begin", "end")))
on_graph("order_annotations", 'SELECT g_a.a, min(b) AS first, max(e) AS last FROM g_a LEFT JOIN g_sp USING (a) GROUP BY g_a.a')(lambda g: collections.annotations_in_textual_order(g, g.annotations).select("a", "first", "last"))
on_graph("order_leftmost", 'SELECT a, min(b) AS begin, max(e) AS "end" FROM g_sp WHERE a % 16 = 4 GROUP BY a')(lambda g: collections.borders(g.spans().filter("a % 16 = 4"), ["a"]).select("a", F.col("leftmost.begin").alias("begin"), F.col("rightmost.end").alias("end")))
on_graph("count_tables", " UNION ALL ".join(f"SELECT '{n}' AS item, (SELECT count(*) FROM {t}) AS n" for n, t in (("resources", "g_r"), ("textselections", "g_ts"), ("datasets", "g_s"), ("keys", "g_k"), ("data", "g_d"), ("annotations", "g_a"), ("annotation_data", "g_ad"), ("targets", "g_t"), ("substores", "g_ss"), ("substore_membership", "g_sm"))))(lambda g: collections.counts(g))
on_graph("count_annotations_per_data", 'SELECT "set", data, count(*) AS n FROM g_ad GROUP BY ALL')(lambda g: collections.annotations_per_data(g))
on_graph("count_selections_per_annotation", "SELECT a, count(*) AS n FROM g_sp GROUP BY a")(lambda g: collections.selections_per_annotation(g))
_IX = lambda name, on, source: f"SELECT '{name}' AS relation, count(DISTINCT ({on})) AS firsts, count(*) AS entries FROM {source}"
on_graph("count_index_entries", " UNION ALL ".join([_IX("data_annotations", '"set", data', "g_ad"), _IX("selection_annotations", "res, ts", "g_sp"), _IX("resource_metadata", "res", "g_t WHERE kind = 'ResourceSelector'"), _IX("dataset_metadata", '"set"', "g_t WHERE kind = 'DataSetSelector'"), _IX("annotation_annotations", "target_a", "g_t WHERE target_a IS NOT NULL"), _IX("key_metadata", '"set", "key"', "g_t WHERE kind = 'DataKeySelector'"), _IX("data_metadata", '"set", data', "g_t WHERE kind = 'AnnotationDataSelector'"), _IX("key_data", '"set", "key"', "g_d")]))(lambda g: collections.index_counts(g))
on_graph("limit_per_group", "SELECT a FROM (SELECT a, row_number() OVER (PARTITION BY a // 16 ORDER BY a) AS r, count(*) OVER (PARTITION BY a // 16) AS n FROM g_a) WHERE r > n - 2")(lambda g: collections.limit(g.annotations.select("a", F.expr("a div 16").alias("d")), -2, 0, ["a"], ["d"]).select("a"))

# --- the query language --------------------------------------------------------------------------------------------


def ask(name: str, text: str, sql: str, columns: dict[str, str], also: str = "") -> None:
    on_graph(f"lang_{name}", sql, also)(lambda g: compiler.run(g, text).select(*[F.col(k).alias(x) for k, x in columns.items()]))


_A = {"x_a": "a"}
ask("annotation_by_id", "SELECT ANNOTATION ?x WHERE ID k4/3;", "SELECT a FROM g_a WHERE id = 'k4/3'", _A)
ask("annotation_of_annotation", "SELECT ANNOTATION ?x WHERE DATA labels toxic = 1; { SELECT ANNOTATION ?y WHERE ANNOTATION AS METADATA ?x; }", f"SELECT target_a AS x, a AS y FROM g_t WHERE target_a IN ({_TOX})", {"x_a": "x", "y_a": "y"})
ask("annotation_as_target", "SELECT ANNOTATION ?x WHERE DATA labels toxic = 1; { SELECT ANNOTATION ?y WHERE ANNOTATION AS TARGET ?x; }", f"SELECT a AS x, target_a AS y FROM g_t WHERE target_a IS NOT NULL AND a IN ({_TOX})", {"x_a": "x", "y_a": "y"})
ask("resource_of_annotation", "SELECT ANNOTATION ?x WHERE DATA meta lang = de; { SELECT RESOURCE ?r WHERE ANNOTATION ?x; }", f"SELECT DISTINCT a, res FROM g_sp WHERE a IN ({_DE})", {"x_a": "a", "r_res": "res"})
ask("text_of_annotation", "SELECT ANNOTATION ?x WHERE DATA meta lang = de; { SELECT TEXT ?t WHERE ANNOTATION ?x; }", f'SELECT DISTINCT a, res, b AS begin, e AS "end" FROM g_sp WHERE a IN ({_DE})', {"x_a": "a", "t_res": "res", "t_begin": "begin", "t_end": "end"})
ask("data_of", "SELECT ANNOTATION ?x WHERE DATA labels toxic = 1; { SELECT DATA ?d WHERE ANNOTATION ?x; }", f'SELECT a, "set", data FROM g_ad WHERE a IN ({_TOX})', {"x_a": "a", "d_set": "set", "d_data": "data"})
ask("key_of_annotation", "SELECT ANNOTATION ?x WHERE DATA labels quality = 1; { SELECT KEY ?k WHERE ANNOTATION ?x; }", 'SELECT DISTINCT y.a, d."set", d."key" FROM g_ad x JOIN g_d q ON q."set" = x."set" AND q.data = x.data AND q."set" = 1 AND q."key" = 0 AND q.i = 1 JOIN g_ad y ON y.a = x.a JOIN g_d d ON d."set" = y."set" AND d.data = y.data', {"x_a": "a", "k_set": "set", "k_key": "key"})
ask("dataset_keys", "SELECT DATASET ?s WHERE ID labels; { SELECT KEY ?k WHERE DATASET ?s; }", 'SELECT "set", "key" FROM g_k WHERE "set" = 1', {"s_set": "set", "k_key": "key"})
ask("dataset_data", "SELECT DATASET ?s WHERE ID meta; { SELECT DATA ?d WHERE DATASET ?s; }", 'SELECT "set", data FROM g_d WHERE "set" = 0', {"s_set": "set", "d_data": "data"})
ask("key_data", "SELECT KEY ?k WHERE DATASET labels; { SELECT DATA ?d WHERE KEY ?k; }", 'SELECT "set", "key", data FROM g_d WHERE "set" = 1', {"k_set": "set", "k_key": "key", "d_data": "data"})
ask("value", "SELECT ANNOTATION ?x WHERE VALUE = de;", "SELECT DISTINCT a FROM g_ad JOIN g_d USING (\"set\", data) WHERE s = 'de'", _A)
ask("data_variable", "SELECT DATA ?d WHERE DATASET labels; { SELECT ANNOTATION ?x WHERE DATA ?d; }", 'SELECT "set", data, a FROM g_ad WHERE "set" = 1', {"d_set": "set", "d_data": "data", "x_a": "a"})
ask("key_variable", "SELECT KEY ?k WHERE DATASET meta; { SELECT ANNOTATION ?x WHERE KEY ?k; }", 'SELECT DISTINCT "set", "key", a FROM g_ad JOIN g_d USING ("set", data) WHERE "set" = 0', {"k_set": "set", "k_key": "key", "x_a": "a"})
ask("resource_text", "SELECT RESOURCE ?r WHERE ID doc5; { SELECT TEXT ?t WHERE RESOURCE ?r; }", 'SELECT res, b AS begin, e AS "end" FROM g_ts WHERE res = 5', {"r_res": "res", "t_begin": "begin", "t_end": "end"})
ask("relation_overlaps", "SELECT ANNOTATION ?x WHERE DATA labels toxic = 1; { SELECT TEXT ?t WHERE RELATION ?x OVERLAPS; }", f'SELECT DISTINCT x.a, t.res, t.b AS begin, t.e AS "end" FROM g_sp x JOIN g_ts t ON t.res = x.res AND t.b < x.e AND t.e > x.b AND (t.b <> x.b OR t.e <> x.e) WHERE x.a IN ({_TOX})', {"x_a": "a", "t_res": "res", "t_begin": "begin", "t_end": "end"})
ask("relation_precedes", "SELECT ANNOTATION ?x WHERE DATA meta lang = de; { SELECT ANNOTATION ?y WHERE RELATION ?x EMBEDS; DATA labels toxic = 0; }", f'SELECT DISTINCT x.a AS x, y.a AS y FROM g_sp x JOIN g_sp y ON y.res = x.res AND y.b >= x.b AND y.e <= x.e AND (y.b <> x.b OR y.e <> x.e) JOIN g_ad q ON q.a = y.a JOIN g_d d ON d."set" = q."set" AND d.data = q.data AND d."set" = 1 AND d."key" = 1 AND d.i = 0 WHERE x.a IN ({_DE})', {"x_a": "x", "y_a": "y"})
ask("substore", "SELECT ANNOTATION ?x WHERE SUBSTORE first;", "SELECT item AS a FROM g_sm WHERE item_type = 'annotation'", _A)
ask("resource_metadata_of", "SELECT RESOURCE ?r WHERE DATA AS METADATA labels quality = 0; { SELECT ANNOTATION ?x WHERE RESOURCE AS METADATA ?r; }", 'SELECT DISTINCT t.res, t.a FROM g_t t JOIN g_t u ON u.res = t.res AND u.kind = \'ResourceSelector\' JOIN g_ad q ON q.a = u.a JOIN g_d d ON d."set" = q."set" AND d.data = q.data AND d."set" = 1 AND d."key" = 0 AND d.i = 0 WHERE t.kind = \'ResourceSelector\'', {"r_res": "res", "x_a": "a"})

# --- changes -------------------------------------------------------------------------------------------------------


def rest(g: Store) -> DataFrame:
    """What is left of annotations and their data: a, and the number of targets and data of each."""
    t = g.targets.groupBy("a").agg(F.count("*").alias("targets"))
    d = g.annotation_data.groupBy("a").agg(F.count("*").alias("used"))
    return g.annotations.select("a").join(t, "a", "left").join(d, "a", "left").select("a", F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("used", F.lit(0)).alias("used"))


def _left(gone: str, data: str = "true") -> str:
    return f"SELECT a, (SELECT count(*) FROM g_t t WHERE t.a = g_a.a) AS targets, (SELECT count(*) FROM g_ad q WHERE q.a = g_a.a AND {data}) AS used FROM g_a WHERE a NOT IN ({gone})"


on_graph("mut_remove_annotations", _left(f"{_TOX} UNION SELECT a FROM g_reach WHERE target_a IN ({_TOX})"), _REACH)(lambda g: rest(mutations.remove_annotations(g, some(g, TOXIC))))
on_graph("mut_remove_resources", _left("SELECT a FROM g_t WHERE res < 3 UNION SELECT r.a FROM g_reach r JOIN g_t t ON t.a = r.target_a WHERE t.res < 3"), _REACH)(lambda g: rest(mutations.remove_resources(g, g.resources.filter("res < 3"))))
on_graph("mut_remove_data", _left("SELECT a FROM g_ad GROUP BY a HAVING bool_and(\"set\" = 1 AND data BETWEEN 2000000 AND 2000001) UNION SELECT a FROM g_reach WHERE target_a IN (SELECT a FROM g_ad GROUP BY a HAVING bool_and(\"set\" = 1 AND data BETWEEN 2000000 AND 2000001))", "NOT (q.\"set\" = 1 AND q.data BETWEEN 2000000 AND 2000001)"), _REACH)(lambda g: rest(mutations.remove_data(g, traversals.find_data(g, "labels", "toxic"))))
on_graph("mut_remove_data_strict", _left('SELECT a FROM g_ad WHERE "set" = 1 AND data BETWEEN 1000000 AND 1000001'))(lambda g: rest(mutations.remove_data(g, traversals.find_data(g, "labels", "quality"), strict=True)))
on_graph("mut_remove_keys", _left("SELECT d * 16 + 6 FROM g_doc WHERE d = 0", 'NOT (q."set" = 1 AND q.data BETWEEN 1000000 AND 1000001)'))(lambda g: rest(mutations.remove_keys(g, scans.lookup(g, "keys", "quality", "labels"))))
on_graph("mut_remove_datasets", _left('SELECT a FROM g_ad WHERE "set" = 1 UNION SELECT a FROM g_t WHERE "set" = 1 UNION SELECT a FROM g_reach WHERE target_a IN (SELECT a FROM g_ad WHERE "set" = 1)'), _REACH)(lambda g: rest(mutations.remove_datasets(g, scans.lookup(g, "datasets", "labels"))))
on_graph("mut_strip_annotation_ids", "SELECT count(*) AS n, 0 AS ids FROM g_a")(lambda g: mutations.strip_ids(g).annotations.agg(F.count("*").alias("n"), F.count("id").alias("ids")))
on_graph("mut_strip_data_ids", "SELECT count(*) AS n, 0 AS ids FROM g_d")(lambda g: mutations.strip_ids(g, "data").data.agg(F.count("*").alias("n"), F.count("id").alias("ids")))
on_graph("mut_renumber", "SELECT row_number() OVER (ORDER BY a) - 1 AS a, id FROM g_a")(lambda g: mutations.reindex(g).annotations.select("a", "id"))
on_graph("mut_renumber_targets", "SELECT n.a, m.a AS target_a FROM g_t t JOIN (SELECT row_number() OVER (ORDER BY a) - 1 AS a, a AS old FROM g_a) n ON n.old = t.a JOIN (SELECT row_number() OVER (ORDER BY a) - 1 AS a, a AS old FROM g_a) m ON m.old = t.target_a")(lambda g: mutations.reindex(g).targets.filter("target_a is not null").select("a", "target_a"))
on_graph("mut_add_resources", "SELECT 'new' || d AS id, text, n AS textlen FROM g_doc WHERE d < 50")(lambda g: mutations.add_resources(g, g.resources.filter("res < 50").select(F.concat(F.lit("new"), F.col("res").cast("string")).alias("id"), "text")).resources.filter("id like 'new%'").select("id", "text", "textlen"))
on_graph("mut_add_substore", "SELECT id, parent FROM g_ss UNION ALL SELECT 'third', 1")(lambda g: mutations.add_substore(g, "third", parent=1).substores.select("id", F.get("parents", F.lit(0)).alias("parent")))
on_graph("mut_reannotate_data", "SELECT a, 1 AS n FROM g_a WHERE a % 16 = 3")(lambda g: (c := mutations.reannotate_all(g, of_kind(g, 3).select("a", F.lit("meta").alias("set_id"), F.lit(None).cast("string").alias("id"), F.lit("lang").alias("key_id"), value("String", F.lit("none")).alias("value")), replace=True)).annotation_data.filter("a % 16 = 3").groupBy("a").agg(F.count("*").alias("n")))
on_graph("mut_reannotate_target", 'SELECT d * 16 + 3 AS a, d AS res, 1 AS begin, 2 AS "end" FROM g_doc WHERE n >= 2')(lambda g: mutations.reannotate_all(g, targets=_new_targets(g)).targets.filter("a % 16 = 3 and begin is not null").select("a", "res", "begin", "end"))


def _new_targets(g: Store) -> DataFrame:
    null = F.lit(None).cast("string")
    leaf = F.struct(F.lit("TextSelector").alias("kind"), F.col("id").alias("resource"), null.alias("annotation"), null.alias("dataset"), null.alias("key"), null.alias("data"), F.lit(1).alias("begin"), F.lit(2).alias("end"), F.lit("BeginBegin").alias("mode"))
    return g.resources.filter("textlen >= 2").select((F.col("res") * 16 + 3).alias("a"), null.alias("complex"), F.array(leaf).alias("targets"))


def _built(g: Store) -> Store:
    """The graph with annotations of all kinds of targets, built from ids."""
    s = lambda x=None: F.lit(x).cast("string")
    n = lambda x=None: F.lit(x).cast("int")

    def leaf(kind, resource=None, annotation=None, dataset=None, key=None, data=None, begin=None, end=None, mode=None):
        return F.struct(s(kind).alias("kind"), (resource if resource is not None else s()).alias("resource"), (annotation if annotation is not None else s()).alias("annotation"), s(dataset).alias("dataset"), s(key).alias("key"), s(data).alias("data"), n(begin).alias("begin"), n(end).alias("end"), s(mode).alias("mode"))

    r, a = F.col("id"), F.concat(F.lit("k0/"), F.col("res").cast("string"))
    kinds = {
        "text": (None, [leaf("TextSelector", r, begin=-4, end=-1, mode="EndEnd")]),
        "note": (None, [leaf("AnnotationSelector", annotation=a, begin=1, end=3, mode="BeginBegin")]),
        "about": (None, [leaf("ResourceSelector", r)]),
        "set": (None, [leaf("DataSetSelector", dataset="meta")]),
        "key": (None, [leaf("DataKeySelector", dataset="labels", key="toxic")]),
        "data": (None, [leaf("AnnotationDataSelector", dataset="labels", data="toxic=2000000")]),
        "multi": ("MultiSelector", [leaf("TextSelector", r, begin=4, end=6, mode="BeginBegin"), leaf("TextSelector", r, begin=0, end=2, mode="BeginBegin")]),
        "directed": ("DirectionalSelector", [leaf("TextSelector", r, begin=4, end=6, mode="BeginBegin"), leaf("TextSelector", r, begin=0, end=2, mode="BeginBegin")]),
        "composite": ("CompositeSelector", [leaf("TextSelector", r, begin=4, end=6, mode="BeginBegin"), leaf("TextSelector", r, begin=0, end=2, mode="BeginBegin")]),
    }
    docs = g.resources.filter("textlen >= 10 and res < 40").select("res", "id")
    data = F.array(F.struct(s().alias("id"), s("made").alias("set"), s("by").alias("key"), value("Int", F.col("res") % 3).alias("value")))
    rows = [docs.select(F.concat(F.lit(f"{k}/"), F.col("res").cast("string")).alias("id"), s(c).alias("complex"), F.array(*leaves).alias("targets"), data.alias("data")) for k, (c, leaves) in kinds.items()]
    return mutations.annotate(g, graph._union(rows))


_BUILT = "made AS (SELECT d, n FROM g_doc WHERE n >= 10 AND d < 40)"
_MADE = " UNION ALL ".join([
    'SELECT \'text/\' || d AS id, NULL AS complex, 0 AS pos, \'TextSelector\' AS kind, d AS res, n - 4 AS begin, n - 1 AS "end", NULL AS target_a, NULL AS "set", NULL AS "key", NULL AS data FROM made',
    "SELECT 'note/' || d, NULL, 0, 'AnnotationSelector', d, 1, 3, d * 16, NULL, NULL, NULL FROM made",
    "SELECT 'about/' || d, NULL, 0, 'ResourceSelector', d, NULL, NULL, NULL, NULL, NULL, NULL FROM made",
    "SELECT 'set/' || d, NULL, 0, 'DataSetSelector', NULL, NULL, NULL, NULL, 0, NULL, NULL FROM made",
    "SELECT 'key/' || d, NULL, 0, 'DataKeySelector', NULL, NULL, NULL, NULL, 1, 1, NULL FROM made",
    "SELECT 'data/' || d, NULL, 0, 'AnnotationDataSelector', NULL, NULL, NULL, NULL, 1, NULL, 2000000 FROM made",
    *(f"SELECT '{k}/' || d, '{c}', {p}, 'TextSelector', d, {b}, {b + 2}, NULL, NULL, NULL, NULL FROM made" for k, c, places in (("multi", "MultiSelector", (0, 4)), ("directed", "DirectionalSelector", (4, 0)), ("composite", "CompositeSelector", (0, 4))) for p, b in enumerate(places)),
])
on_graph("mut_annotate_targets", _MADE, _BUILT)(lambda g: (c := _built(g)).targets.join(c.annotations.filter("not id like 'k%'").select("a", "id", "complex").unionByName(c.annotations.filter("id like 'key/%'").select("a", "id", "complex")), "a").select("id", "complex", "pos", "kind", "res", "begin", "end", "target_a", "set", "key", "data"))
on_graph("mut_annotate_data", "SELECT d % 3 AS i, 9 * count(*) AS n FROM made GROUP BY 1", _BUILT)(lambda g: (c := _built(g)).annotation_data.join(traversals.find_data(c, "made", "by").join(c.data.select("set", "data", F.col("value.i").alias("i")), ["set", "data"]), ["set", "data"]).groupBy("i").agg(F.count("*").alias("n")))
on_graph("mut_annotate_selections", "SELECT count(*) AS n FROM (SELECT DISTINCT res, b, e FROM g_sp UNION SELECT d, n - 4, n - 1 FROM made UNION SELECT d, 1, 3 FROM made UNION SELECT d, 4, 6 FROM made UNION SELECT d, 0, 2 FROM made)", _BUILT)(lambda g: _built(g).textselections.agg(F.count("*").alias("n")))

# --- extensions ----------------------------------------------------------------------------------------------------


def _protected(g: Store, mode: str) -> Store:
    data = extensions.protect(g, of_kind(g, 0, 4), mode, delimiter="|").select("a", "set_id", F.lit(None).cast("string").alias("id"), "key_id", value("String", F.col("value")).alias("value"))
    return mutations.reannotate_all(g, data)


_TEXTS = "x AS (SELECT a, string_agg(substr(text, CAST(b AS INT) + 1, CAST(e - b AS INT)), '|' ORDER BY pos) AS text FROM g_sp JOIN g_r USING (res) WHERE a % 16 IN (0, 4) GROUP BY a)"
on_graph("ext_validate", "SELECT a, CASE WHEN a % 16 IN (0, 4) THEN true END AS valid FROM g_a WHERE a % 16 IN (0, 4, 8)")(lambda g: extensions.validate(_protected(g, "text"), of_kind(g, 0, 4, 8)))
on_graph("ext_validate_changed", "SELECT a, a // 16 % 2 = 0 OR text = upper(text) AS valid FROM x", _TEXTS)(lambda g: extensions.validate((c := _protected(g, "checksum")).with_tables(resources=c.resources.withColumn("text", F.when(F.col("res") % 2 == 1, F.upper("text")).otherwise(F.col("text")))), of_kind(g, 0, 4)))
on_graph("ext_validation_counts", "SELECT (SELECT count(*) FROM x) AS valid, 0 AS invalid, (SELECT count(*) FROM g_a WHERE a % 16 = 8) AS missing", _TEXTS)(lambda g: extensions.validation_counts(_protected(g, "auto"), of_kind(g, 0, 4, 8)))
on_graph("ext_validation_info", "SELECT a, text, sha1(NULL) AS checksum, '|' AS delimiter FROM x", _TEXTS)(lambda g: extensions.validation_info(_protected(g, "text")).select("a", "text", "checksum", "delimiter"))
on_graph("ext_is_iri", "SELECT * FROM (VALUES ('http://x/y', true), ('urn:a:b', true), ('plain', false), ('http://x y', false)) v(id, iri)")(lambda g: g.spark.createDataFrame([("http://x/y",), ("urn:a:b",), ("plain",), ("http://x y",)], "id string").select("id", extensions.is_iri(F.col("id")).alias("iri")))


def _aligned(g: Store) -> Store:
    """The graph with pivots between each document d and the next: s/d from its first ten code points to the next one's [10, 20), and c/d over both annotations of kind 4."""
    s = lambda x=None: F.lit(x).cast("string")
    n = lambda x=None: F.lit(x).cast("int")

    def leaf(kind, resource, annotation, begin, end):
        return F.struct(s(kind).alias("kind"), resource.alias("resource"), annotation.alias("annotation"), s().alias("dataset"), s().alias("key"), s().alias("data"), n(begin).alias("begin"), n(end).alias("end"), s("BeginBegin" if end else None).alias("mode"))

    pairs = g.resources.select("res", "textlen").join(g.resources.select((F.col("res") - 1).alias("res"), F.col("textlen").alias("next")), "res").filter("textlen >= 10 and next >= 20")
    doc, kind4 = (lambda k: F.concat(F.lit("doc"), (F.col("res") + k).cast("string"))), (lambda k: F.concat(F.lit("k4/"), (F.col("res") + k).cast("string")))
    kinds = {"s": [leaf("TextSelector", doc(0), s(), 0, 10), leaf("TextSelector", doc(1), s(), 10, 20)], "c": [leaf("AnnotationSelector", s(), kind4(0), None, None), leaf("AnnotationSelector", s(), kind4(1), None, None)]}
    data = F.array().cast(alignment._DATA)
    rows = [pairs.select(F.concat(F.lit(f"{k}/"), F.col("res").cast("string")).alias("id"), s("DirectionalSelector").alias("complex"), F.array(*leaves).alias("targets"), data.alias("data")) for k, leaves in kinds.items()]
    c = mutations.annotate(g, graph._union(rows))
    return c.with_tables(annotations=settled(c.annotations), targets=settled(c.targets))


def _mapped(g: Store, kind: str, config: alignment.Config, *of: int) -> DataFrame:
    c = _aligned(g)
    out = alignment.map_annotations(c, of_kind(g, *of), c.annotations.filter(F.col("id").startswith(f"{kind}/")).select("a"), config)
    return out.select("id", "complex", F.size("data").alias("n_data"), F.posexplode("targets").alias("pos", "t")).select("id", "complex", "n_data", "pos", "t.resource", "t.annotation", "t.begin", "t.end")


_PIVOTS = "piv AS (SELECT x.d, y.d AS e FROM g_doc x JOIN g_doc y ON y.d = x.d + 1 WHERE x.n >= 10 AND y.n >= 20)"
#: Rows of an annotation on one side, with one span, and of the new pivot over both.
_NEW = """SELECT name || '-' || via || '-' || (1 - side) || '-mapped' AS id, NULL AS complex, n_data, 0 AS pos, 'doc' || doc AS resource, NULL AS annotation, b AS begin, f AS "end" FROM m
UNION ALL SELECT name || '-' || via || '-mapping', 'DirectionalSelector', 1, side, NULL, name, NULL, NULL FROM m
UNION ALL SELECT name || '-' || via || '-mapping', 'DirectionalSelector', 1, 1 - side, NULL, name || '-' || via || '-' || (1 - side) || '-mapped', NULL, NULL FROM m"""
on_graph("ext_transpose", _NEW, f"""{_PIVOTS}, m AS (
SELECT 'k2/' || d AS name, 's/' || d AS via, 0 AS side, e AS doc, 10 AS b, 15 AS f, (SELECT count(*) FROM g_ad WHERE g_ad.a = d * 16 + 2) AS n_data FROM piv
UNION ALL SELECT 'k9/' || e, 's/' || d, 1, d, 0, 10, (SELECT count(*) FROM g_ad WHERE g_ad.a = e * 16 + 9) FROM piv)""")(lambda g: _mapped(g, "s", alignment.TransposeConfig(), 2, 9))
on_graph("ext_transpose_simple", """SELECT name || '-' || via || '-mapping' AS id, 'DirectionalSelector' AS complex, 1 AS n_data, pos, 'doc' || doc AS resource, NULL AS annotation, b AS begin, f AS "end" FROM (
SELECT 'k2/' || d AS name, 's/' || d AS via, 0 AS pos, d AS doc, 0 AS b, 5 AS f FROM piv UNION ALL SELECT 'k2/' || d, 's/' || d, 1, e, 10, 15 FROM piv)""", _PIVOTS)(lambda g: _mapped(g, "s", alignment.TransposeConfig(allow_simple=True), 2))
on_graph("ext_translate", """SELECT name || '-' || via || '-' || (1 - side) || '-mapped' AS id, 'DirectionalSelector' AS complex, n_data, pos, 'doc' || doc AS resource, NULL AS annotation, 6 * pos AS begin, 4 + 6 * pos AS "end" FROM m, (VALUES (0), (1)) v(pos)
UNION ALL SELECT name || '-' || via || '-mapping', 'DirectionalSelector', 1, side, NULL, name, NULL, NULL FROM m
UNION ALL SELECT name || '-' || via || '-mapping', 'DirectionalSelector', 1, 1 - side, NULL, name || '-' || via || '-' || (1 - side) || '-mapped', NULL, NULL FROM m""", f"""{_PIVOTS}, m AS (
SELECT 'k4/' || d AS name, 'c/' || d AS via, 0 AS side, e AS doc, (SELECT count(*) FROM g_ad WHERE g_ad.a = d * 16 + 4) AS n_data FROM piv
UNION ALL SELECT 'k4/' || e, 'c/' || d, 1, d, (SELECT count(*) FROM g_ad WHERE g_ad.a = e * 16 + 4) FROM piv)""")(lambda g: _mapped(g, "c", alignment.TranslateConfig(), 4))

on_graph("ext_validation_ok", "SELECT false AS ok, true AS ok_maybe_incomplete")(lambda g: extensions.validation_ok(_protected(g, "auto"), of_kind(g, 0, 4, 8)))

# --- ids -----------------------------------------------------------------------------------------------------------


def _old():
    """Ids of texts with no version, with a version, and with what looks like one. No column: the catalogue is read without a session."""
    return F.concat(F.col("id"), F.when(F.col("res") % 3 == 0, F.lit("")).when(F.col("res") % 3 == 1, F.concat(F.lit("/v"), F.col("res").cast("string"))).otherwise(F.lit("-vx")))


on_graph("id_regenerate", "SELECT res, id || CASE res % 3 WHEN 0 THEN '/v2' WHEN 1 THEN '/v' || (res + 1) ELSE '-vx/v2' END AS version, 'p-' || id AS prefixed, id || '-s' AS suffixed, 'new' AS replaced FROM g_r")(lambda g: g.resources.select("res", ids.regenerated(_old()).alias("version"), ids.regenerated(F.col("id"), "prefix=p-").alias("prefixed"), ids.regenerated(F.col("id"), "suffix=-s").alias("suffixed"), ids.regenerated(F.col("id"), "replace=new").alias("replaced")))
on_graph("id_generate", "SELECT count(*) AS n, count(*) AS different, 25 AS width FROM g_a")(lambda g: g.annotations.select(ids.generated(F.col("a"), prefix="x-", suffix="-y").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("different"), F.max(F.length("id")).cast("int").alias("width")))
