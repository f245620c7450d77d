"""Queries that write the graph of documents and labels in the exchange formats and read it again. Importing this module registers them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.values import display
from spanloom.model import Store, shared_folder
from spanloom.operators import positions
from spanloom.plans import graph
from spanloom.plans.catalogue import register
from spanloom.sources import includes, stores

#: Small, so that several tasks read one document.
RANGE_BYTES = 1 << 18


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def as_document(spark: SparkSession, sf_dir: str) -> Store:
    """The graph written as one JSON document and read by ranges, once a session."""

    def make() -> Store:
        path = _place(spark, "document")
        stores.save_json(graph.store(spark, sf_dir), path)
        return stores.load_json(spark, path, range_bytes=RANGE_BYTES)

    return stores.stored_once(spark, "document", sf_dir, make)


def filed(store: Store) -> Store:
    """The graph with files: one for each French text, each set and each substore."""
    french = store.substore_membership.filter("item_type = 'resource'").select(F.col("item").alias("res"), F.lit(True).alias("french"))
    res = store.resources.drop("filename").join(french, "res", "left").withColumn("filename", F.when(F.col("french"), F.concat(F.lit("texts/"), "id", F.lit(".txt"))))
    name = lambda df: df.withColumn("filename", F.concat("id", F.lit(".json")))
    return store.with_tables(resources=res.select(store.resources.columns), datasets=name(store.datasets), substores=name(store.substores))


def as_includes(spark: SparkSession, sf_dir: str) -> Store:
    """The graph written as an include graph and read again, once a session."""

    def make() -> Store:
        path = _place(spark, "includes")
        includes.save_include(filed(graph.store(spark, sf_dir)), path, "root.json")
        return stores.load_json(spark, f"{path}/root.json", range_bytes=RANGE_BYTES)

    return stores.stored_once(spark, "includes", sf_dir, make)


def targets(store: Store) -> DataFrame:
    """Targets by public ids, which stay when handles change."""
    own = store.annotations.select("a", F.col("id").alias("name"), "complex")
    about = store.annotations.select(F.col("a").alias("target_a"), F.col("id").alias("on_name"))
    out = store.targets.join(own, "a").join(about, "target_a", "left").join(store.resources.select("res", F.col("id").alias("res_id")), "res", "left").join(store.datasets.select("set", F.col("id").alias("set_id")), "set", "left")
    return out.select("name", "complex", "pos", "kind", "res_id", "begin", F.col("end").alias("stop"), "on_name", "set_id")


_TARGETS = """SELECT a.id AS name, a.complex, t.pos, t.kind, r.id AS res_id, t.b AS begin, t.e AS stop, x.id AS on_name, s.id AS set_id
  FROM g_t t JOIN g_a a ON a.a = t.a LEFT JOIN g_a x ON x.a = t.target_a LEFT JOIN g_r r ON r.res = t.res LEFT JOIN g_s s ON s."set" = t."set\""""
_USED = """SELECT a.id AS name, d.id AS data_id, s.id AS set_id, k.id AS key_id, coalesce(d.s, CAST(d.i AS VARCHAR), CAST(d.f AS VARCHAR)) AS shown
  FROM g_ad u JOIN g_a a ON a.a = u.a JOIN g_d d ON d."set" = u."set" AND d.data = u.data JOIN g_s s ON s."set" = u."set" JOIN g_k k ON k."set" = d."set" AND k."key" = d."key\""""
_MEMBERS = """SELECT s.id AS substore, p.id AS parent, m.item_type, coalesce(a.id, r.id, d.id) AS name
  FROM g_sm m JOIN g_ss s ON s.ss = m.ss LEFT JOIN g_ss p ON p.ss = s.parent LEFT JOIN g_a a ON m.item_type = 'annotation' AND a.a = m.item
  LEFT JOIN g_r r ON m.item_type = 'resource' AND r.res = m.item LEFT JOIN g_s d ON m.item_type = 'dataset' AND d."set" = m.item"""


def used(store: Store) -> DataFrame:
    """Which data annotations have, by public ids."""
    rows = store.annotation_data.join(store.named_data().withColumnRenamed("id", "data_id"), ["set", "data"]).join(store.annotations.select("a", F.col("id").alias("name")), "a")
    return rows.select("name", "data_id", "set_id", "key_id", display(F.col("value")).alias("shown"))


def members(store: Store) -> DataFrame:
    """What is in substores, and what these are in, by public ids."""
    names = None
    for kind, table, handle in (("annotation", store.annotations, "a"), ("resource", store.resources, "res"), ("dataset", store.datasets, "set")):
        rows = table.select(F.lit(kind).alias("item_type"), F.col(handle).alias("item"), F.col("id").alias("name"))
        names = rows if names is None else names.unionByName(rows)
    above = store.substores.select("ss", F.col("id").alias("substore"), F.explode("parents").alias("p")).join(store.substores.select(F.col("ss").alias("p"), F.col("id").alias("parent")), "p", "left")
    return store.substore_membership.join(names, ["item_type", "item"]).join(above, "ss").select("substore", "parent", "item_type", "name")


register("src_json_split", _TARGETS, also=graph.SQL)(lambda s, d: targets(as_document(s, d)))
register("src_json_data", _USED, also=graph.SQL)(lambda s, d: used(as_document(s, d)))
register("src_json_texts", "SELECT id, text, textlen FROM (SELECT id, text, n AS textlen FROM (SELECT id, text, textlen AS n FROM g_r))", also=graph.SQL)(lambda s, d: as_document(s, d).resources.select("id", "text", "textlen"))
register("src_include_round_trip", _TARGETS, also=graph.SQL)(lambda s, d: targets(as_includes(s, d)))
register("src_include_texts", "SELECT g_r.id, text, CASE WHEN lang = 'fr' THEN 'texts/' || g_r.id || '.txt' END AS filename FROM g_r JOIN (SELECT d, lang FROM g_doc) x ON x.d = g_r.res", also=graph.SQL)(
    lambda s, d: as_includes(s, d).resources.select("id", "text", "filename")
)
register("src_substore_round_trip", _MEMBERS, also=graph.SQL)(lambda s, d: members(as_includes(s, d)))


@register("src_dataset", "SELECT d.id AS data_id, k.id AS key_id, coalesce(CAST(d.i AS VARCHAR), CAST(d.f AS VARCHAR)) AS shown FROM g_d d JOIN g_k k ON k.\"set\" = d.\"set\" AND k.\"key\" = d.\"key\" WHERE d.\"set\" = 1", also=graph.SQL)
def dataset(s, d):
    """The file of one set, read on its own."""
    path = _place(s, "sets")
    includes.save_include(filed(graph.store(s, d)), path, "root.json")
    data = stores.load_dataset(s, f"{path}/labels.json").named_data()
    return data.select(F.col("id").alias("data_id"), "key_id", display(F.col("value")).alias("shown"))


# --- the index of positions ----------------------------------------------------------------------------------------------


def index_of(spark: SparkSession, sf_dir: str) -> positions.Positions:
    """The graph's index of positions, written once a session."""
    known = _INDICES.setdefault(spark.sparkContext.applicationId, {})
    if sf_dir not in known:
        path = _place(spark, "positions")
        positions.save(positions.index(graph.store(spark, sf_dir)), path)
        known[sf_dir] = path
    return positions.load(spark, known[sf_dir])


_INDICES: dict[str, dict[str, str]] = {}
_SIDES = "sides AS (SELECT res, b AS \"at\", 'begin' AS side, e AS other, ts FROM g_ts UNION ALL SELECT res, e, 'end', b, ts FROM g_ts)"
_POINTS = 'SELECT res, "at", count(*) FILTER (side = \'begin\') AS begins, count(*) FILTER (side = \'end\') AS ends FROM sides GROUP BY res, "at"'
_also = ", ".join((graph.SQL, _SIDES))
register("scan_position_entry", 'SELECT res, side, other, ts FROM sides WHERE "at" = 10', also=_also)(lambda s, d: positions.entry(index_of(s, d), 10))
register("scan_position_points", f'SELECT p.res, p."at", begins, ends, octet_length(encode(substr(text, 1, p."at"))) AS byte FROM ({_POINTS}) p JOIN g_r ON g_r.res = p.res', also=_also)(lambda s, d: index_of(s, d).points)
register("scan_position_ends", f'SELECT res, "at" FROM ({_POINTS}) WHERE ends > 0 AND "at" >= 5 AND "at" < 500', also=_also)(lambda s, d: positions.used(index_of(s, d), "end", 5, 500))
register("count_index_partial", 'SELECT (SELECT count(*) FROM (SELECT DISTINCT "set", data FROM g_ad)) AS data, (SELECT count(*) FROM (SELECT DISTINCT res, ts FROM g_t WHERE ts IS NOT NULL)) AS selections', also=graph.SQL)(
    lambda s, d: positions.partial_counts(graph.store(s, d))
)


# --- other formats -------------------------------------------------------------------------------------------------------


def _by_name(spark: SparkSession, sf_dir: str, name: str) -> Store:
    """The graph saved under a name and loaded again, once a session."""

    def make() -> Store:
        path = f"{_place(spark, 'named')}/{name}"
        stores.save(graph.store(spark, sf_dir), path)
        return stores.load(spark, path)

    return stores.stored_once(spark, name, sf_dir, make)


register("src_csv", _TARGETS, also=graph.SQL)(lambda s, d: targets(_by_name(s, d, "graph.csv")))
register("src_csv_data", _USED, also=graph.SQL)(lambda s, d: used(_by_name(s, d, "graph.csv")))
register("src_parquet", _TARGETS, also=graph.SQL)(lambda s, d: targets(_by_name(s, d, "graph.parquet")))


def as_filed_csv(spark: SparkSession, sf_dir: str) -> Store:
    """The graph saved as CSV with files for some texts and for all sets, by names relative to a folder, and loaded again, once a session."""

    def make() -> Store:
        config = stores.Config(workdir=_place(spark, "work"), dataformat="csv", generate_ids=True)
        g = filed(graph.store(spark, sf_dir))
        g = g.with_tables(datasets=g.datasets.withColumn("filename", F.concat(F.lit("sets/"), "id", F.lit(".csv"))))
        stores.save(g.with_tables(annotations=g.annotations.withColumn("id", F.when(F.col("a") % 16 < 8, F.col("id")))), "tables", config=config)
        return stores.load(spark, "tables", config=config)

    return stores.stored_once(spark, "filed-csv", sf_dir, make)


register("src_csv_include", f"SELECT name, pos, kind, res_id, begin, stop, on_name FROM ({_TARGETS}) WHERE name IN (SELECT id FROM g_a WHERE a % 16 < 8)", also=graph.SQL)(
    lambda s, d: targets(as_filed_csv(s, d)).filter("name like 'k%'").select("name", "pos", "kind", "res_id", "begin", "stop", "on_name")
)
register("src_csv_texts", "SELECT g_r.id, text, CASE WHEN lang = 'fr' THEN 'texts/' || g_r.id || '.txt' END AS filename FROM g_r JOIN (SELECT d, lang FROM g_doc) x ON x.d = g_r.res", also=graph.SQL)(
    lambda s, d: as_filed_csv(s, d).resources.select("id", "text", "filename")
)
register("src_csv_sets", """SELECT s.id AS set_id, 'sets/' || s.id || '.csv' AS filename, k.id AS key_id, d.id AS data_id FROM g_s s JOIN g_k k ON k."set" = s."set" LEFT JOIN g_d d ON d."set" = k."set" AND d."key" = k."key\"""", also=graph.SQL)(
    lambda s, d: _sets_of(as_filed_csv(s, d))
)
register("src_generated_ids", "SELECT id IS NOT NULL AND length(id) = 22 AND starts_with(id, 'A') AS generated, count(*) AS n FROM (SELECT CASE WHEN a % 16 < 8 THEN id ELSE 'A' || repeat('x', 21) END AS id FROM g_a) GROUP BY ALL", also=graph.SQL)(
    lambda s, d: as_filed_csv(s, d).annotations.select(((F.length("id") == 22) & F.col("id").startswith("A")).alias("generated")).groupBy("generated").agg(F.count("*").alias("n"))
)


def _sets_of(store: Store) -> DataFrame:
    keys = store.keys.select("set", "key", F.col("id").alias("key_id"))
    rows = store.datasets.select("set", F.col("id").alias("set_id"), "filename").join(keys, "set")
    return rows.join(store.data.select("set", "key", F.col("id").alias("data_id")), ["set", "key"], "left").select("set_id", "filename", "key_id", "data_id")
