"""A small annotation graph over the driver's documents and labels, with every kind of target, and the same rules as SQL.

Of each document d (its text has n code points) there are annotations a = 16 d + kind:

0 a span [0, 10), data lang; 1 about the document, data source and quality; 2 on annotation 0, [0, 5) of the text, data toxic;
3 on annotation 2 without a span, data score (n_chars / 2); 4 directional, [6, 10) then [0, 4), data lang, if n >= 10;
5 about set d (d < 2), data lang; 6 about key d of set 1 (d < 3), data source; 7 about the data lang, data source;
8 the last six code points, data lang, if n >= 10; 9 a span [10, 20) right behind annotation 0, data source, if n > 10; 10 as 0, without data.

Handles are computed, so that both engines agree: the data of lang is 1,000,000 and its letters' codes, and so on. Substore 0 has annotations 1 of even
documents and set 1; substore 1, inside 0, has the French documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.model import ANNOTATION, DATA, DATASET, DIRECTIONAL, KEY, RESOURCE, SCHEMAS, TEXT, Store, intern, settled, value
from spanloom.sources.stores import stored_once

SETS = ("meta", "labels")
KEYS = ((0, 0, "lang"), (0, 1, "source"), (1, 0, "quality"), (1, 1, "toxic"), (1, 2, "score"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d, text, n: the whole texts, with no text for null."""
    text = F.coalesce("text", F.lit(""))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("d"), text.alias("text"), F.length(text).alias("n"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("d"), F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What annotations are made of, without the texts: their lengths are found before the join, so that labels meet a few numbers for each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.select(F.col("doc_id").alias("d"), F.length(F.coalesce("text", F.lit(""))).alias("n"), "lang", "source", (F.col("n_chars") / 2).cast("double").alias("score"), F.col("n_chars").cast("long").alias("n_chars"))
    return known.join(labels(spark, sf_dir), "d", "left")


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts, each as often as the document is in documents(): texts meet the labels only where these repeat a document."""
    again = settled(labels(spark, sf_dir).groupBy("d").count().filter("count > 1 and d is not null"))
    rows = texts(spark, sf_dir)
    if again.isEmpty():
        return rows
    times = F.sequence(F.lit(1).cast("long"), F.coalesce("count", F.lit(1).cast("long")))
    return rows.join(again, "d", "left").withColumn("_time", F.explode(times)).select("d", "text", "n")


#: Data by name: set, key, handle, the value's kind and column.
VALUES = {
    "lang": (0, 0, "1000000 + ascii(lang) * 256 + ascii(substring(lang, 2, 1))", "String"),
    "source": (0, 1, "2000000 + cast(substring(source, 4, 9) as bigint)", "String"),
    "quality": (1, 0, "1000000 + quality", "Int"),
    "toxic": (1, 1, "2000000 + toxic", "Int"),
    "score": (1, 2, "3000000 + n_chars", "Float"),
}
#: Annotations by kind: when there are such, complex, targets (kind and the columns it sets), data.
_SPAN = {"res": "d", "mode": "'BeginBegin'"}
KINDS = {
    0: ("true", None, [(TEXT, _SPAN | {"begin": "0", "end": "least(10, n)"})], ["lang"]),
    1: ("true", None, [(RESOURCE, {"res": "d"})], ["source", "quality"]),
    2: ("true", None, [(ANNOTATION, _SPAN | {"target_a": "d * 16", "begin": "0", "end": "least(5, n)"})], ["toxic"]),
    3: ("true", None, [(ANNOTATION, {"target_a": "d * 16 + 2"})], ["score"]),
    4: ("n >= 10", DIRECTIONAL, [(TEXT, _SPAN | {"begin": "6", "end": "10"}), (TEXT, _SPAN | {"begin": "0", "end": "4"})], ["lang"]),
    5: ("d < 2", None, [(DATASET, {"set": "d"})], ["lang"]),
    6: ("d < 3", None, [(KEY, {"set": "1", "key": "d"})], ["source"]),
    7: ("lang is not null", None, [(DATA, {"set": "0", "data": VALUES["lang"][2]})], ["source"]),
    8: ("n >= 10", None, [(TEXT, _SPAN | {"begin": "n - 6", "end": "n"})], ["lang"]),
    9: ("n > 10", None, [(TEXT, _SPAN | {"begin": "10", "end": "least(20, n)"})], ["source"]),
    10: ("true", None, [(TEXT, _SPAN | {"begin": "0", "end": "least(10, n)"})], []),
}
_TARGETS = [c.split() for c in SCHEMAS["targets"].split(", ")]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The store of the documents in sf_dir, written once a session."""
    return stored_once(spark, "graph", sf_dir, lambda: derive(spark, sf_dir))


def derive(spark: SparkSession, sf_dir: str) -> Store:
    docs = settled(documents(spark, sf_dir))  # some twenty tables are made of it
    annotations, targets, used = [], [], []
    for kind, (when, complex_, members, names) in KINDS.items():
        here = docs.filter(when).withColumn("a", F.col("d") * 16 + kind)
        annotations.append(here.select("a", F.concat(F.lit(f"k{kind}/"), F.col("d").cast("string")).alias("id"), F.lit(complex_).cast("string").alias("complex")))
        for pos, (what, filled) in enumerate(members):
            columns = {"a": F.col("a"), "pos": F.lit(pos), "kind": F.lit(what)} | {c: F.expr(x) for c, x in filled.items()}
            targets.append(here.select(*[columns.get(c, F.lit(None)).cast(sql).alias(c) for c, sql in _TARGETS]))
        for pos, name in enumerate(names):
            set_, _, handle, _ = VALUES[name]
            used.append(here.filter(F.col(name).isNotNull()).select("a", F.lit(pos).alias("pos"), F.lit(set_).cast("long").alias("set"), F.expr(handle).cast("long").alias("data")))
    data = [docs.filter(F.col(name).isNotNull()).select(F.lit(set_).cast("long").alias("set"), F.expr(handle).cast("long").alias("data"), F.concat(F.lit(f"{name}="), F.expr(handle).cast("string")).alias("id"), F.lit(key).cast("long").alias("key"), F.col(name).alias("_v")).distinct().select("set", "data", "id", "key", value(kind, F.col("_v")).alias("value")) for name, (set_, key, handle, kind) in VALUES.items()]
    every = _union(targets)
    selections = intern(every.filter("begin is not null"))
    placed = every.drop("ts").join(selections, ["res", "begin", "end"], "left").select(*[c for c, _ in _TARGETS])
    member = lambda ss, kind, df: df.select(F.lit(ss).cast("long").alias("ss"), F.lit(kind).alias("item_type"), "item")
    membership = _union([
        member(0, "annotation", docs.filter("d % 2 = 0").select((F.col("d") * 16 + 1).alias("item"))),
        member(0, "dataset", spark.range(1, 2).select(F.col("id").alias("item"))),
        member(1, "resource", docs.filter("lang = 'fr'").select(F.col("d").alias("item"))),
    ])
    return Store.empty(spark).with_tables(
        resources=labelled_texts(spark, sf_dir).select(F.col("d").alias("res"), F.concat(F.lit("doc"), F.col("d").cast("string")).alias("id"), "text", F.col("n").alias("textlen"), F.lit(None).cast("string").alias("filename")),
        textselections=selections,
        datasets=spark.createDataFrame([(i, n, None) for i, n in enumerate(SETS)], SCHEMAS["datasets"]),
        keys=spark.createDataFrame(KEYS, SCHEMAS["keys"]),
        data=_union(data),
        annotations=_union(annotations),
        annotation_data=_union(used),
        targets=placed,
        substores=spark.createDataFrame([(0, "first", None, [-1]), (1, "second", None, [0])], SCHEMAS["substores"]),
        substore_membership=membership,
    )


def _sql() -> str:
    """The same tables for DuckDB: g_r, g_s, g_k, g_d, g_a, g_ad, g_t (b and e for begin and end), g_ts, g_ss, g_sm."""
    columns = [c for c, _ in _TARGETS if c != "ts"]
    handle = lambda h: "CAST(" + h.replace("cast(substring(source, 4, 9) as bigint)", "CAST(substr(source, 4, 9) AS BIGINT)").replace("substring(", "substr(") + " AS BIGINT)"
    annotations, targets, used, data = [], [], [], []
    for kind, (when, complex_, members, names) in KINDS.items():
        shown = f"'{complex_}'" if complex_ else "NULL"
        annotations.append(f"SELECT d * 16 + {kind} AS a, 'k{kind}/' || d AS id, {shown} AS complex FROM g_doc WHERE {when}")
        for pos, (what, filled) in enumerate(members):
            own = {"a": f"d * 16 + {kind}", "pos": str(pos), "kind": f"'{what}'"} | filled
            targets.append("SELECT " + ", ".join(f"CAST({handle(own[c]) if c == 'data' and c in own else own.get(c, 'NULL')} AS {'VARCHAR' if c in ('kind', 'mode') else 'BIGINT'}) AS \"{c}\"" for c in columns) + f" FROM g_doc WHERE {when}")
        for pos, name in enumerate(names):
            used.append(f"SELECT d * 16 + {kind} AS a, {pos} AS pos, {VALUES[name][0]} AS \"set\", {handle(VALUES[name][2])} AS data FROM g_doc WHERE ({when}) AND {name} IS NOT NULL")
    for name, (set_, key, h, kind) in VALUES.items():
        s, i, f = (name if kind == k else "NULL" for k in ("String", "Int", "Float"))
        data.append(f"SELECT DISTINCT {set_} AS \"set\", {handle(h)} AS data, '{name}=' || {handle(h)} AS id, {key} AS \"key\", '{kind}' AS vtype, CAST({s} AS VARCHAR) AS s, CAST({i} AS BIGINT) AS i, CAST({f} AS DOUBLE) AS f FROM g_doc WHERE {name} IS NOT NULL")
    union = " UNION ALL ".join
    keys = ", ".join(f"({s}, {k}, '{n}')" for s, k, n in KEYS)
    return f"""g_doc AS (SELECT x.doc_id AS d, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, lang, source, quality, toxic, n_chars / 2 AS score, n_chars FROM documents x LEFT JOIN labels l ON l.doc_id = x.doc_id),
g_r AS (SELECT d AS res, 'doc' || d AS id, text, n AS textlen FROM g_doc),
g_s AS (SELECT * FROM (VALUES (0, 'meta'), (1, 'labels')) v("set", id)),
g_k AS (SELECT * FROM (VALUES {keys}) v("set", "key", id)),
g_d AS ({union(data)}),
g_a AS ({union(annotations)}),
g_ad AS ({union(used)}),
g_ti AS ({union(targets)}),
g_ts AS (SELECT res, row_number() OVER (PARTITION BY res ORDER BY b, e) - 1 AS ts, b, e FROM (SELECT DISTINCT res, "begin" AS b, "end" AS e FROM g_ti WHERE "begin" IS NOT NULL)),
g_t AS (SELECT a, pos, kind, g_ti.res, "begin" AS b, "end" AS e, target_a, "set", "key", data, ts FROM g_ti LEFT JOIN g_ts ON g_ts.res = g_ti.res AND g_ts.b = "begin" AND g_ts.e = "end"),
g_sp AS (SELECT a, pos, res, ts, b, e FROM g_t WHERE b IS NOT NULL),
g_ss AS (SELECT * FROM (VALUES (0, 'first', -1), (1, 'second', 0)) v(ss, id, parent)),
g_sm AS (SELECT 0 AS ss, 'annotation' AS item_type, d * 16 + 1 AS item FROM g_doc WHERE d % 2 = 0 UNION ALL SELECT 0, 'dataset', 1 UNION ALL SELECT 1, 'resource', d FROM g_doc WHERE lang = 'fr')"""


SQL = _sql()
