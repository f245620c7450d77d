"""Reading and writing whole stores: JSON, CSV, Parquet, plain text and JSON-LD.

Parquet is the native format: a directory per table, `targets` and `textselections` clustered by resource. JSON and CSV
are exchange formats whose files are read by Spark with fixed schemas; included files are followed on the driver, which only sees their names.
"""

from __future__ import annotations

import atexit
import json
import posixpath
import uuid
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.ids import generated
from spanloom.functions.values import display
from spanloom.model import ROOT, SCHEMAS, VALUE, Store, settled, settled_store, shared_folder, value
from spanloom.operators import mutations, positions
from spanloom.operators.extensions import web_annotations
from spanloom.sources import includes

_CURSOR = "struct<`@type`: string, value: int>"
_LEAF = f"`@type`: string, resource: string, annotation: string, dataset: string, key: string, data: string, offset: struct<begin: {_CURSOR}, end: {_CURSOR}>"
_JSON_VALUE = "struct<`@type`: string, value: string>"
_DATA = f"struct<`@id`: string, key: string, value: {_JSON_VALUE}, set: string>"
JSON = f"`@type` string, `@id` string, `@include` string, resources array<struct<`@id`: string, `@include`: string, text: string>>, annotationsets array<struct<`@id`: string, `@include`: string, keys: array<struct<`@id`: string>>, data: array<{_DATA}>>>, annotations array<struct<`@id`: string, target: struct<{_LEAF}, selectors: array<struct<{_LEAF}>>>, data: array<{_DATA}>>>"
_SET_JSON = f"`@id` string, keys array<struct<`@id`: string>>, data array<{_DATA}>"


# --- Parquet -------------------------------------------------------------------------------------------------------


def save_parquet(store: Store, path: str) -> None:
    for name, df in store.tables().items():
        clustered = df.repartition("res") if name in ("targets", "textselections") else df
        clustered.write.mode("overwrite").parquet(f"{path}/{name}")


def stored_once(spark: SparkSession, name: str, source: str, make) -> Store:
    """The store that make() gives for a source, written as Parquet in the shared folder on first use in a session and read from there, as long as the source's files stay as they are."""
    known, key = _STORED.setdefault(spark.sparkContext.applicationId, {}), (name, source, _stamp(spark, source))
    if key not in known:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        save_parquet(make(), path)
        atexit.register(_remove, spark, path)
        known[key] = path
    return load_parquet(spark, known[key])


_STORED: dict[str, dict[tuple[str, str, int], str]] = {}


def _stamp(spark: SparkSession, source: str) -> int:
    """A number that changes with the files in a folder, and with those in folders in it: their names, lengths and times."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = files.listStatus(at)
    below = [f for s in top if s.isDirectory() for f in files.listStatus(s.getPath())]
    return hash(tuple(sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in (*top, *below))))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def load_parquet(spark: SparkSession, path: str) -> Store:
    return Store(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})


# --- plain text ----------------------------------------------------------------------------------------------------


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row (id, text, filename) per file; the id is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("filename"))
    return files.select(F.element_at(F.split("filename", "/"), -1).alias("id"), "text", "filename")


def write_text(store: Store, res: int, path: str) -> None:
    """The text of a resource, unchanged, as a file below the folder path/doc=<its id>."""
    includes.write_texts(store.resources.filter(F.col("res") == res).select(includes.named(F.col("id"), "R", "res").alias("doc"), "text"), path)


# --- JSON ----------------------------------------------------------------------------------------------------------


def typed_value(v: Column) -> Column:
    """The value struct of a tagged JSON value."""
    kind, raw = v["@type"], v["value"]
    cast = lambda name, sql: F.when(kind == name, raw.try_cast(sql))
    zone = F.regexp_extract(raw, r"(Z|[+-]\d\d:\d\d)$", 1)
    return F.struct(F.coalesce(kind, F.lit("Null")).alias("vtype"), F.when(kind == "String", raw).alias("s"), cast("Bool", "boolean").alias("b"), cast("Int", "bigint").alias("i"), cast("Float", "double").alias("f"), cast("Datetime", "timestamp").alias("t"), F.when(kind == "Datetime", F.when(zone == "Z", "+00:00").otherwise(zone)).alias("tz"), F.when(kind.isin("List", "Map"), raw).alias("j"))


def json_value(v: Column) -> Column:
    """A value struct as tagged JSON text."""
    kind = v["vtype"]
    quoted = F.to_json(F.struct(F.coalesce(v["s"], F.date_format(v["t"], "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("value")))
    bare = F.coalesce(v["j"], v["b"].cast("string"), v["i"].cast("string"), v["f"].cast("string"), F.lit("null"))
    inside = F.when(kind.isin("String", "Datetime"), F.substr(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(F.concat(F.lit('"value":'), bare))
    return F.when(kind == "Null", F.lit('{"@type":"Null"}')).otherwise(F.concat(F.lit('{"@type":"'), kind, F.lit('",'), inside, F.lit("}")))


def load_json(spark: SparkSession, path: str, store: Store | None = None, range_bytes: int | None = None) -> Store:
    """A store from a JSON document and all that it includes, merged into store if that is given. A document is a file, or a directory of part files as save_json writes it.

    Documents are read by ranges, so that any number of tasks reads a large one; included stores become substores.
    """
    items, documents = includes.read_graph(spark, path, range_bytes)
    item = F.concat(F.lit('{"'), F.col("field"), F.lit('":['), F.col("text"), F.lit("]}"))
    kinds = ("resources", "annotationsets", "annotations")
    place = F.concat_ws("/", F.lpad(F.col("ss").cast("string"), 10, "0"), "range", F.lpad(F.col("n").cast("string"), 15, "0"))
    store = store or Store.empty(spark)
    top = store.substores.agg(F.max("ss")).first()[0]
    first = 0 if top is None else top + 1
    handles = {name: first + i - 1 if i else ROOT for i, (name, _, _) in enumerate(documents)}
    rows = [(handles[name], id, name, [handles[p] for p in above]) for name, id, above in documents[1:]]
    store = store.with_tables(substores=store.substores.unionByName(spark.createDataFrame(rows, SCHEMAS["substores"])))
    of = spark.createDataFrame(list(handles.items()), "doc string, ss long")
    rows = items.filter(F.col("field").isin(*kinds)).join(F.broadcast(of), "doc")  # a row per document
    return _from_json(spark, rows.select("ss", place.alias("place"), F.from_json(item, JSON).alias("j")).select("ss", "place", "j.*"), posixpath.dirname(path), store)


def load_json_text(spark: SparkSession, text: str, store: Store | None = None) -> Store:
    rows = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", JSON).alias("j")).select(F.lit(ROOT).cast("long").alias("ss"), F.lit("").alias("place"), "j.*")
    return _from_json(spark, rows, "", store or Store.empty(spark))


#: Before the ids that annotations without one have while they are added.
_UNNAMED = "\x00"


def _from_json(spark: SparkSession, rows: DataFrame, folder: str, store: Store) -> Store:
    """store with the items of rows: ss (their substore), place (their order), resources, annotationsets, annotations."""
    rows = settled(rows)
    res = rows.select("ss", F.explode("resources").alias("r")).select("ss", F.coalesce("r.@id", "r.@include").alias("id"), F.col("r.@include").alias("filename"), F.col("r.text").alias("text"))
    inline = res.filter("text is not null or filename is null").select("ss", "id", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("filename"))
    outside = res.filter("text is null and filename is not null")
    if names := [r[0] for r in outside.select("filename").distinct().collect()]:  # file names only
        texts = includes.read_texts_of(spark, folder, names).withColumnRenamed("doc", "filename")
        inline = inline.unionByName(outside.drop("text").join(texts, "filename"))
    store = mutations.add_resources(store, inline.select("id", "text", "filename").distinct())
    sets = rows.select("ss", F.explode("annotationsets").alias("s")).select("ss", "s.*").withColumnRenamed("@include", "filename")
    own = sets.filter("keys is not null or data is not null or filename is null").select("`@id`", "keys", "data")
    named = sets.filter("keys is null and data is null and filename is not null").select("filename", "`@id`").distinct()
    if names := [r[0] for r in named.select("filename").distinct().collect()]:  # file names only
        read = _set_files(spark, folder, names, named)
        own = own.unionByName(read.drop("filename"))
        files = read.select(F.col("@id").alias("id"), "filename").distinct()
        sets = sets.join(files.withColumnRenamed("id", "_id"), "filename", "left").withColumn("@id", F.coalesce("@id", "_id")).drop("_id")
    store = _add_sets(store, own)
    if names:
        kept = store.datasets.join(files.withColumnRenamed("filename", "_file"), "id", "left").withColumn("filename", F.coalesce("filename", "_file"))
        store = store.with_tables(datasets=kept.select(store.datasets.columns))
    store = settled_store(store, "resources", "datasets", "keys", "data")
    anns = rows.select("ss", "place", F.posexplode("annotations").alias("i", "x")).select("ss", F.concat(F.lit(_UNNAMED), "place", F.lit("/"), F.lpad(F.col("i").cast("string"), 10, "0")).alias("place"), "x.*")
    none = F.lit(None).cast("string")
    cursor_end = lambda c: c["@type"] == "EndAlignedCursor"

    def leaf(t: Column) -> Column:
        b, e = t["offset"]["begin"], t["offset"]["end"]
        mode = F.when(b.isNotNull(), F.concat(F.when(cursor_end(b), "End").otherwise("Begin"), F.when(cursor_end(e), "End").otherwise("Begin")))
        return F.struct(t["@type"].alias("kind"), t["resource"].alias("resource"), t["annotation"].alias("annotation"), t["dataset"].alias("dataset"), t["key"].alias("key"), t["data"].alias("data"), b["value"].alias("begin"), e["value"].alias("end"), mode.alias("mode"))

    many = F.col("target.selectors").isNotNull()
    targets = F.when(many, F.transform("target.selectors", leaf)).otherwise(F.array(leaf(F.col("target"))))
    data = F.transform(F.coalesce("data", F.array()), lambda d: F.struct(d["@id"].alias("id"), d["set"].alias("set"), d["key"].alias("key"), typed_value(d["value"]).alias("value")))
    builders = anns.select(F.coalesce("@id", "place").alias("id"), F.when(many, F.col("target.@type")).otherwise(none).alias("complex"), targets.alias("targets"), data.alias("data"))
    if not builders.isEmpty():
        store = settled_store(mutations.annotate(store, builders))
    placed = anns.filter(F.col("ss") != ROOT).select("ss", F.coalesce("@id", "place").alias("id"))
    members = [(res, store.resources, "res", "resource"), (sets.withColumnRenamed("@id", "id"), store.datasets, "set", "dataset"), (placed, store.annotations, "a", "annotation")]
    membership = store.substore_membership
    for items, table, handle, kind in members:
        inside = items.filter(F.col("ss") != ROOT).select("ss", "id").distinct().join(table.select("id", F.col(handle).alias("item")), "id")
        membership = membership.unionByName(inside.select("ss", F.lit(kind).alias("item_type"), "item"))
    named = F.when(F.col("id").startswith(_UNNAMED), none).otherwise(F.col("id"))
    return settled_store(store.with_tables(annotations=store.annotations.withColumn("id", named), substore_membership=membership.distinct()))


def _set_files(spark: SparkSession, folder: str, names: list[str], known: DataFrame | None = None) -> DataFrame:
    """@id, keys, data and filename of the files of sets, a row per key and per datum. A set without an id has the one it is included by (known: filename, @id) or its file's name."""
    items, frames = includes.read_items(spark, [includes.beside(folder, n) for n in names])
    ids = includes.with_names(frames.select("file", F.from_json("text", "`@id` string").alias("j")), spark, folder, names).select(F.col("doc").alias("filename"), F.col("j.@id").alias("_id"))
    if known is not None:
        ids = ids.join(known.groupBy("filename").agg(F.min("@id").alias("@id")), "filename", "left")
    else:
        ids = ids.withColumn("@id", F.lit(None).cast("string"))
    ids = ids.select("filename", F.coalesce("_id", "@id", "filename").alias("@id"))
    one = F.concat(F.lit('{"'), F.col("field"), F.lit('":['), F.col("text"), F.lit("]}"))
    rows = includes.with_names(items.select("file", F.from_json(one, _SET_JSON).alias("j")), spark, folder, names).select(F.col("doc").alias("filename"), "j.keys", "j.data")
    return ids.join(rows, "filename", "left").select("@id", "keys", "data", "filename")


def load_dataset(spark: SparkSession, path: str, store: Store | None = None, include: bool = True) -> Store:
    """store with the set of a JSON file of its own, merged into the set of that id if there is one. include: the file's name stays with the set, so that save_include writes it there."""
    folder, name = posixpath.split(path)
    rows = settled(_set_files(spark, folder, [name]))
    store = _add_sets(store or Store.empty(spark), rows.drop("filename"))
    if include:
        own = rows.select(F.col("@id").alias("id"), F.col("filename").alias("_file")).distinct()
        kept = store.datasets.join(own, "id", "left").withColumn("filename", F.coalesce("filename", "_file"))
        store = store.with_tables(datasets=kept.select(store.datasets.columns))
    return store


def load_dataset_text(spark: SparkSession, text: str, store: Store | None = None) -> Store:
    """store with a set given as JSON text, as load_dataset."""
    rows = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", _SET_JSON).alias("j")).select("j.*")
    return _add_sets(store or Store.empty(spark), rows)


def annotate_json(store: Store, path: str) -> Store:
    """store with the annotations of a file: a JSON array of annotations, or one of them."""
    return _annotations_of(store, store.spark.read.text(path, wholetext=True).select(F.col("value").alias("t")))


def annotate_json_text(store: Store, text: str) -> Store:
    """As annotate_json, of a text."""
    return _annotations_of(store, store.spark.createDataFrame([(text,)], "t string"))


def _annotations_of(store: Store, rows: DataFrame) -> Store:
    listed = F.when(F.ltrim("t").startswith("["), F.col("t")).otherwise(F.concat(F.lit("["), "t", F.lit("]")))
    parsed = rows.select(F.from_json(F.concat(F.lit('{"annotations":'), listed, F.lit("}")), JSON).alias("j"))
    return _from_json(store.spark, parsed.select(F.lit(ROOT).cast("long").alias("ss"), F.lit("").alias("place"), "j.*"), "", store)


def _add_sets(store: Store, sets: DataFrame) -> Store:
    store = mutations.add_datasets(store, sets.select(F.col("@id").alias("id")))
    keys = sets.select(F.col("@id").alias("set_id"), F.explode("keys").alias("k")).select("set_id", F.col("k.@id").alias("id"))
    data = sets.select(F.col("@id").alias("set_id"), F.explode("data").alias("d")).select("set_id", F.col("d.@id").alias("id"), F.col("d.key").alias("key_id"), typed_value(F.col("d.value")).alias("value"))
    known = store.datasets.select("set", F.col("id").alias("set_id"))
    new = keys.join(known, "set_id").select("set", "id").distinct().join(store.keys, ["set", "id"], "left_anti")
    store = store.with_tables(keys=store.keys.unionByName(mutations._numbered(new, store.keys, "key", ["id"], ["set"]).select("set", "key", "id")))
    return mutations.insert_data(store, data)[0]


def json_annotations(store: Store) -> DataFrame:
    """a, json: annotations in the exchange format."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    data = store.named_data().select("set", "data", F.col("id").alias("did"), "set_id", "key_id", json_value(F.col("value")).alias("v"))
    used = store.annotation_data.join(data, ["set", "data"])
    one = F.concat(F.lit("{"), F.when(F.col("did").isNotNull(), F.concat(F.lit('"@id":'), quoted(F.col("did")), F.lit(","))).otherwise(F.lit("")), F.lit('"key":'), quoted(F.col("key_id")), F.lit(',"set":'), quoted(F.col("set_id")), F.lit(',"value":'), F.col("v"), F.lit("}"))
    datas = used.groupBy("a").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("j")))), lambda x: x["j"]), ",").alias("data"))
    named = lambda df, h, n: df.select(F.coalesce("id", F.concat(F.lit({"a": "!A", "res": "!R", "set": "!S"}[h]), F.col(h).cast("string"))).alias(n), F.col(h).alias(f"_{h}"))
    t = store.targets.join(named(store.resources, "res", "rid"), F.col("res") == F.col("_res"), "left").join(named(store.annotations, "a", "aid"), F.col("target_a") == F.col("_a"), "left").join(named(store.datasets, "set", "sid"), F.col("set") == F.col("_set"), "left")
    t = t.join(store.keys.select(F.col("set").alias("_ks"), F.col("key").alias("_kk"), F.col("id").alias("kid")), (F.col("set") == F.col("_ks")) & (F.col("key") == F.col("_kk")), "left")
    t = t.join(store.data.select(F.col("set").alias("_ds"), F.col("data").alias("_dd"), F.col("id").alias("xid")), (F.col("set") == F.col("_ds")) & (F.col("data") == F.col("_dd")), "left")
    # Spans on annotations are stored absolute; they are written relative to the target's only span, as they are read.
    base = store.spans().groupBy("a").agg(F.count("*").alias("_n"), F.first("begin").alias("_base")).filter("_n = 1").select(F.col("a").alias("_ta"), "_base")
    t = t.join(base, F.col("target_a") == F.col("_ta"), "left").withColumns({c: F.col(c) - F.coalesce("_base", F.lit(0)) for c in ("begin", "end")})
    offset = F.when(F.col("begin").isNotNull(), F.format_string(',"offset":{"@type":"Offset","begin":{"@type":"BeginAlignedCursor","value":%s},"end":{"@type":"BeginAlignedCursor","value":%s}}', F.col("begin").cast("string"), F.col("end").cast("string"))).otherwise(F.lit(""))
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f',"{name}":'), quoted(c))).otherwise(F.lit(""))
    selector = F.concat(F.lit('{"@type":"'), F.col("kind"), F.lit('"'), field("resource", F.when(F.col("kind").isin("TextSelector", "ResourceSelector"), F.col("rid"))), field("annotation", F.col("aid")), field("dataset", F.col("sid")), field("key", F.col("kid")), field("data", F.col("xid")), offset, F.lit("}"))
    targets = t.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", selector.alias("j")))), lambda x: x["j"]).alias("ts"))
    rows = store.annotations.join(targets, "a").join(datas, "a", "left")
    target = F.when(F.col("complex").isNull(), F.get("ts", F.lit(0))).otherwise(F.concat(F.lit('{"@type":"'), F.col("complex"), F.lit('","selectors":['), F.array_join("ts", ","), F.lit("]}")))
    name = F.when(F.col("id").isNotNull(), F.concat(F.lit('"@id":'), quoted(F.col("id")), F.lit(","))).otherwise(F.lit(""))
    return rows.select("a", F.concat(F.lit('{"@type":"Annotation",'), name, F.lit('"target":'), target, F.lit(',"data":['), F.coalesce("data", F.lit("")), F.lit("]}")).alias("json"))


def json_data(rows: DataFrame) -> DataFrame:
    """set, data, json: rows of named_data in the exchange format of a set's data."""
    name = F.when(F.col("id").isNotNull(), F.concat(F.lit('"@id":'), includes.quoted(F.col("id")), F.lit(","))).otherwise(F.lit(""))
    return rows.select("set", "data", F.concat(F.lit("{"), name, F.lit('"key":'), includes.quoted(F.col("key_id")), F.lit(',"value":'), json_value(F.col("value")), F.lit("}")).alias("json"))


def json_sets(store: Store) -> DataFrame:
    """set, json: sets with their keys and data in the exchange format, each in one row."""
    listed = lambda df, n: df.groupBy("set").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, "json"))), lambda x: x["json"]), ",").alias(f"{n}s"))
    keys = store.keys.select("set", "key", F.concat(F.lit('{"@id":'), includes.quoted(F.col("id")), F.lit("}")).alias("json"))
    own = store.datasets.select("set")
    sets = store.datasets.join(listed(keys.join(own, "set"), "key"), "set", "left").join(listed(json_data(store.named_data().join(own, "set")), "data"), "set", "left")
    head = F.concat(F.lit('{"@type":"AnnotationDataSet","@id":'), includes.quoted(includes.named(F.col("id"), "S", "set")))
    return sets.select("set", F.concat(head, F.lit(',"keys":['), F.coalesce("keys", F.lit("")), F.lit('],"data":['), F.coalesce("datas", F.lit("")), F.lit("]}")).alias("json"))


def save_json(store: Store, path: str, id: str = "store") -> None:
    """One JSON document with all that is in the store, as a directory of part files in order; concatenated they are the document, and load_json reads the directory.

    Each item is a row, so that no task holds more than one at a time.
    """
    plain = lambda df: df.withColumn("filename", F.lit(None).cast("string"))
    flat = store.with_tables(resources=plain(store.resources), datasets=plain(store.datasets), substores=plain(store.substores))
    rows = settled(includes.lines(flat, "", id))
    parts = max(1, -(-rows.count() // includes.ROWS), store.spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(parts, "list", "n", "m").sortWithinPartitions("list", "n", "m")
    rows.select("line").write.mode("overwrite").option("lineSep", "}").text(path)


# --- CSV -----------------------------------------------------------------------------------------------------------

ANNOTATION_COLUMNS = ["Id", "AnnotationData", "AnnotationDataSet", "SelectorType", "TargetResource", "TargetAnnotation", "TargetDataSet", "BeginOffset", "EndOffset", "TargetKey", "TargetData"]


def csv_annotations(store: Store) -> DataFrame:
    """The annotations table: members of complex selectors joined by `;` behind an empty first slot."""
    ids = store.data.select("set", "data", F.coalesce("id", F.concat(F.lit("!D"), F.col("data").cast("string"))).alias("did")).join(store.datasets.select("set", F.col("id").alias("sid")), "set")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(c, F.lit("")).alias("v")))), lambda x: x["v"]), ";")
    data = store.annotation_data.join(ids, ["set", "data"]).groupBy("a").agg(joined(F.col("did")).alias("AnnotationData"), joined(F.col("sid")).alias("AnnotationDataSet"))
    t = store.targets.join(store.resources.select("res", F.col("id").alias("rid")), "res", "left").join(store.annotations.select(F.col("a").alias("target_a"), F.coalesce("id", F.concat(F.lit("!A"), F.col("a").cast("string"))).alias("aid")), "target_a", "left")
    t = t.join(store.datasets.select("set", F.col("id").alias("sid")), "set", "left").join(store.keys.select("set", "key", F.col("id").alias("kid")), ["set", "key"], "left").join(store.data.select("set", "data", F.col("id").alias("did")), ["set", "data"], "left")
    t = t.join(store.annotations.select("a", "complex"), "a")
    parts = {"SelectorType": F.col("kind"), "TargetResource": F.col("rid"), "TargetAnnotation": F.col("aid"), "TargetDataSet": F.col("sid"), "BeginOffset": F.col("begin").cast("string"), "EndOffset": F.col("end").cast("string"), "TargetKey": F.col("kid"), "TargetData": F.col("did")}
    rows = t.groupBy("a").agg(F.first("complex").alias("complex"), *[joined(c).alias(n) for n, c in parts.items()])
    lead = lambda n: F.when(F.col("complex").isNotNull(), F.concat(F.when(F.lit(n == "SelectorType"), F.col("complex")).otherwise(F.lit("")), F.lit(";"), F.col(n))).otherwise(F.col(n)).alias(n)
    rows = rows.select("a", *[lead(n) for n in parts])
    return store.annotations.select("a", F.col("id").alias("Id")).join(rows, "a").join(data, "a", "left").orderBy("a").select(*ANNOTATION_COLUMNS)


def csv_dataset(store: Store, set_: int) -> DataFrame:
    """Id, Key, Value of a set; keys without data have a row of their own. All values become text."""
    data = store.named_data().filter(F.col("set") == set_)
    rows = data.select(F.col("id").alias("Id"), F.col("key_id").alias("Key"), display(F.col("value")).alias("Value"))
    bare = store.keys.filter(F.col("set") == set_).select(F.col("id").alias("Key")).join(rows.select("Key"), "Key", "left_anti")
    return bare.select(F.lit(None).cast("string").alias("Id"), "Key", F.lit(None).cast("string").alias("Value")).unionByName(rows)


def csv_datasets(store: Store) -> DataFrame:
    """set and the rows of csv_dataset, of all sets together."""
    keys = store.keys.select("set", "key", F.col("id").alias("key_id"))
    row = lambda df, id, shown: df.select("set", id.cast("string").alias("Id"), F.col("key_id").alias("Key"), shown.cast("string").alias("Value"))
    bare = keys.join(store.data.select("set", "key"), ["set", "key"], "left_anti")
    return row(bare, F.lit(None), F.lit(None)).unionByName(row(store.data.join(keys, ["set", "key"]), F.col("id"), display(F.col("value"))))


#: Names of the tables of texts and sets that have no filename.
_TEXTS, _SET = "inline-texts", "set-"


def save_csv(store: Store, path: str) -> None:
    """A manifest, the annotations, a table for each set and the texts, below path.

    Texts with a filename become files of that name, and sets with one that ends in .csv get their table there; a table is a file, or a directory of part files.
    """
    spark = store.spark
    options = lambda df: df.write.mode("overwrite").option("header", True).option("escape", '"')
    options(csv_annotations(store)).csv(f"{path}/annotations")
    doc = F.when(F.col("filename").endswith(".csv"), F.col("filename")).otherwise(F.concat(F.lit(_SET), F.col("set").cast("string")))
    sets = store.datasets.select("set", F.col("id").alias("Id"), doc.alias("doc"))
    rows = csv_datasets(store).join(sets.select("set", "doc"), "set").drop("set")
    texts = store.resources.filter("filename is not null").select(F.col("filename").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    names = [r[0] for r in sets.select("doc").unionByName(texts.select("doc")).collect()]  # names of files
    if len(names) != len(set(names)):
        raise ValueError("two items have one filename")
    if taken := {n.split("/")[0] for n in names} & {"annotations", "manifest", _TEXTS}:
        raise ValueError(f"{', '.join(taken)} can't be names of files here")
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    options(rows).partitionBy("doc").csv(f"{aside}/sets")
    includes.write_texts(texts, f"{aside}/texts")
    includes.move_documents(spark, [f"{aside}/sets", f"{aside}/texts"], path, names)
    includes.remove(spark, aside)
    store.resources.filter("filename is null").select("res", "id", "text").write.mode("overwrite").parquet(f"{path}/{_TEXTS}")
    manifest = spark.createDataFrame([("AnnotationStore", None, "annotations"), ("TextResource", None, _TEXTS)], "Type string, Id string, Filename string")
    manifest = manifest.unionByName(sets.select(F.lit("AnnotationDataSet").alias("Type"), "Id", F.col("doc").alias("Filename")))
    manifest = manifest.unionByName(store.resources.filter("filename is not null").select(F.lit("TextResource").alias("Type"), F.col("id").alias("Id"), F.col("filename").alias("Filename")))
    options(manifest.coalesce(1)).csv(f"{path}/manifest")


def builders_from_csv(rows: DataFrame) -> DataFrame:
    """Builders of rows of the annotations table. Missing columns are taken for empty ones; the last set is used for further data."""
    for c in ANNOTATION_COLUMNS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    cut = lambda c: F.split(F.coalesce(c, F.lit("")), ";", -1)
    kinds = cut("SelectorType")
    many = F.size(kinds) > 1
    at = lambda c, i: F.when(F.size(cut(c)) == 1, F.nullif(F.get(cut(c), F.lit(0)), F.lit(""))).otherwise(F.nullif(F.get(cut(c), i), F.lit("")))

    def leaf(i: Column) -> Column:
        b, e = at("BeginOffset", i), at("EndOffset", i)
        end = lambda x: x.startswith("-")
        mode = F.when(b.isNotNull(), F.concat(F.when(end(b), "End").otherwise("Begin"), F.when(end(e), "End").otherwise("Begin")))
        return F.struct(F.get(kinds, i).alias("kind"), at("TargetResource", i).alias("resource"), at("TargetAnnotation", i).alias("annotation"), at("TargetDataSet", i).alias("dataset"), at("TargetKey", i).alias("key"), at("TargetData", i).alias("data"), b.cast("int").alias("begin"), e.cast("int").alias("end"), mode.alias("mode"))

    targets = F.transform(F.when(many, F.sequence(F.lit(1), F.size(kinds) - 1)).otherwise(F.array(F.lit(0))), leaf)
    ids, sets = cut("AnnotationData"), cut("AnnotationDataSet")
    null_value = F.lit(None).cast(VALUE)
    data = F.when(F.coalesce("AnnotationData", F.lit("")) == "", F.array()).otherwise(F.transform(ids, lambda d, i: F.struct(d.alias("id"), F.get(sets, F.least(i, F.size(sets) - 1)).alias("set"), F.lit(None).cast("string").alias("key"), null_value.alias("value"))))
    return rows.select(F.col("Id").alias("id"), F.when(many, F.get(kinds, F.lit(0))).alias("complex"), targets.alias("targets"), data.alias("data"))


def load_csv(spark: SparkSession, path: str) -> Store:
    """A store that save_csv has written, or the manifest of one with files: a row for the annotations' table, then sets and texts.

    All tables of sets are read together, and so are all texts. Values are text.
    """
    whole = includes.exists(spark, f"{path}/manifest")
    folder = path if whole else posixpath.dirname(path)
    table = lambda *paths: spark.read.option("header", True).option("escape", '"').csv(list(paths))
    manifest = table(f"{path}/manifest" if whole else path).collect()  # names of files
    store = Store.empty(spark)
    files = [(r["Filename"], r["Id"] or r["Filename"]) for r in manifest if r["Type"] == "TextResource" and (r["Id"] or r["Filename"] != _TEXTS)]
    if whole:
        store = mutations.add_resources(store, spark.read.parquet(f"{path}/{_TEXTS}").select("id", "text"))
    if files:
        known = spark.createDataFrame(files, "doc string, id string")
        store = mutations.add_resources(store, includes.read_texts_of(spark, folder, [n for n, _ in files]).join(known, "doc").select("id", "text", F.col("doc").alias("filename")))
    sets = [(r["Filename"], r["Id"] or r["Filename"]) for r in manifest if r["Type"] == "AnnotationDataSet"]
    if sets:
        known = spark.createDataFrame(sets, "doc string, id string")
        store = mutations.add_datasets(store, known)
        written = [n for n, _ in sets if not includes.is_empty(spark, includes.beside(folder, n))]
        store = _add_sets(store, _set_tables(spark, folder, written, known)) if written else store
        own = known.filter(~F.col("doc").rlike(f"^{_SET}[0-9]+$")).withColumnRenamed("doc", "_file")
        kept = store.datasets.join(own, "id", "left").withColumn("filename", F.coalesce("filename", "_file"))
        store = settled_store(store.with_tables(datasets=kept.select(store.datasets.columns)), "datasets", "keys", "data")
    anns = next(r["Filename"] for r in manifest if r["Type"] == "AnnotationStore")
    read = mutations.annotate(settled_store(store, "resources"), builders_from_csv(table(includes.beside(folder, anns))))
    return settled_store(read, *(n for n in Store.names() if n != "resources"))


def _set_tables(spark: SparkSession, folder: str, names: list[str], known: DataFrame) -> DataFrame:
    """@id, keys and data of the tables of sets, which are files or directories; known: their doc and id."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv([includes.beside(folder, n) for n in names])
    file = includes.plain_uri(F.col("_metadata.file_path"))
    rows = rows.select("Id", "Key", "Value", F.explode(F.array(file, F.regexp_extract(file, "^(.*)/[^/]*$", 1))).alias("file"))
    rows = includes.with_names(rows, spark, folder, names).join(known.select("doc", F.col("id").alias("_set_id")), "doc")
    datum = F.struct(F.col("Id").alias("@id"), F.col("Key").alias("key"), F.struct(F.lit("String").alias("@type"), F.col("Value").alias("value")).alias("value"), F.lit(None).cast("string").alias("set"))
    data = F.when(F.col("Value").isNotNull(), F.array(datum)).otherwise(F.array().cast(f"array<{_DATA}>"))
    return rows.select(F.col("_set_id").alias("@id"), F.array(F.struct(F.col("Key").alias("@id"))).alias("keys"), data.alias("data"))


# --- by name -------------------------------------------------------------------------------------------------------

#: The end of a name, and the format it stands for.
FORMATS = {".json": "json", ".csv": "csv", ".parquet": "parquet"}


@dataclass(frozen=True)
class Config:
    """How stores are read and written.

    workdir: what names are relative to. dataformat: that of names with an end that isn't known; None makes them an error. use_include: JSON has documents of their own for items
    with a filename, or else is one document. generate_ids: items without a public id get one when a store is read, the same one each time. strip_temp_ids: ids that only
    stand for a handle (!A7) are taken for none when a store is read. milestone_interval: code points between two milestones of an index of positions.
    """

    workdir: str | None = None
    dataformat: str | None = None
    use_include: bool = True
    generate_ids: bool = False
    strip_temp_ids: bool = True
    milestone_interval: int = positions.MILESTONE

    @staticmethod
    def from_file(spark: SparkSession, path: str) -> Config:
        """The options of a JSON file. Others in it, such as those of indices in memory, mean nothing here."""
        return Config.from_text(spark.read.text(path, wholetext=True).first()[0])

    @staticmethod
    def from_text(text: str) -> Config:
        given = json.loads(text)
        known = {f.name: given[f.name] for f in fields(Config) if given.get(f.name) is not None}
        if isinstance(form := known.get("dataformat"), dict):  # a format with options of its own
            known["dataformat"] = form = next(iter(form))
        if form:
            known["dataformat"] = {"json": "json", "csv": "csv", "parquet": "parquet", "cbor": "parquet"}[form.lower()]
        return Config(**known)

    def to_text(self) -> str:
        return json.dumps(asdict(self))

    def path(self, name: str) -> str:
        return includes.beside(self.workdir, name) if self.workdir else name

    def index(self, store: Store) -> positions.Positions:
        return positions.index(store, self.milestone_interval)

    def applied(self, store: Store) -> Store:
        """A store that was read, with the ids that are wanted."""
        if self.strip_temp_ids:
            store = without_temporary_ids(store)
        return with_ids(store) if self.generate_ids else store


#: Tables with public ids: the handle columns and the letter of generated and temporary ids.
_IDS = {"resources": (["res"], "R"), "datasets": (["set"], "S"), "annotations": (["a"], "A"), "data": (["set", "data"], "D")}


def without_temporary_ids(store: Store) -> Store:
    """store without ids that only stand for a handle."""
    plain = lambda t, letter: t.withColumn("id", F.when(~F.col("id").rlike(f"^!{letter}[0-9]+$"), F.col("id")))
    return store.with_tables(**{name: plain(getattr(store, name), letter) for name, (_, letter) in _IDS.items()})


def with_ids(store: Store, seed: str = "") -> Store:
    """store with a generated id for each resource, set, annotation and item of data that has none."""
    new = lambda t, handles, letter: t.withColumn("id", F.coalesce("id", generated(*map(F.col, handles), prefix=letter, seed=seed)))
    return store.with_tables(**{name: new(getattr(store, name), *how) for name, how in _IDS.items()})


def format_of(path: str, otherwise: str | None = None) -> str:
    """The format that a name stands for; other names are an error, unless there is a format for them."""
    for end, kind in FORMATS.items():
        if path.rstrip("/").lower().endswith(end):
            return kind
    if otherwise:
        return otherwise
    raise ValueError(f"no format is known for {path}: names end in {', '.join(FORMATS)}")


def load(spark: SparkSession, path: str, store: Store | None = None, config: Config | None = None) -> Store:
    """The store at path, in the format that its name stands for. JSON is merged into store, if that is given; the other formats are whole stores."""
    config = config or Config()
    kind, path = format_of(path, config.dataformat), config.path(path)
    if kind == "json":
        return config.applied(load_json(spark, path, store))
    if store is not None:
        raise ValueError(f"{kind} can't be merged into a store")
    return config.applied(load_csv(spark, path) if kind == "csv" else load_parquet(spark, path))


def save(store: Store, path: str, id: str = "store", config: Config | None = None) -> None:
    """The store in the format that the name stands for. As JSON, resources, sets and substores with a filename get documents of their own beside it, unless that isn't wanted."""
    config = config or Config()
    kind, path = format_of(path, config.dataformat), config.path(path)
    if kind == "json" and config.use_include:
        folder, name = posixpath.split(path)
        includes.save_include(store, folder or ".", name, id)
    elif kind == "json":
        save_json(store, path, id)
    elif kind == "csv":
        save_csv(store, path)
    else:
        save_parquet(store, path)


def csv_text(rows: DataFrame) -> DataFrame:
    """line: the rows of a table (csv_annotations, csv_dataset) as lines of CSV in their order, without a header; quotes are doubled."""
    field = lambda c: F.when(F.col(c).rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))
    return rows.select(F.concat_ws(",", *[field(c) for c in rows.columns]).alias("line"))


# --- JSON-LD -------------------------------------------------------------------------------------------------------


def save_web_annotations(store: Store, path: str, **options) -> None:
    web_annotations(store, store.annotations, **options).orderBy("a").select("json").write.mode("overwrite").text(path)


__all__ = ["annotate_json", "annotate_json_text", "builders_from_csv", "csv_annotations", "csv_dataset", "json_annotations", "json_value", "load_csv", "load_dataset", "load_dataset_text", "load_json", "load_json_text", "load_parquet", "read_texts", "save_csv", "save_json", "save_parquet", "save_web_annotations", "typed_value", "value", "write_text"]
