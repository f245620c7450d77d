"""Include graphs: a store as a root document, with texts, sets and substores in files of their own that it names.

Writing. Every item becomes a row (document, list, place, text), whatever document it belongs to; one job writes all documents, each in as many ordered part files as its rows
need. A document's rows are hashed first and compared with the manifest of the last save: only changed documents are written. They are written aside, then moved to their
names, and the manifest is committed last; a save that was cut short is repaired by the next one, as its documents differ from the manifest. Documents of one part are
plain files, larger ones directories of parts that follow each other. Only names reach the driver.

Reading. The documents of one level of the graph are read together, by ranges; their includes are the next level. A document that was already met is not read again, but gets a
further parent, so rings end. All items are added together and then put in their substores.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.model import ROOT, Store, settled, shared_folder
from spanloom.sources.split_json import plain_uri, read_items

MANIFEST = "_manifest"
#: Rows of a part file, about.
ROWS = 500_000
_LISTS = {"resources": 1, "annotationsets": 2, "annotations": 3, "keys": 1, "data": 2}
_END = 9


def quoted(c: Column) -> Column:
    """A string as JSON."""
    pair = F.to_json(F.struct(c.alias("v")))
    return F.substr(pair, F.lit(6), F.length(pair) - 6)


def named(c: Column, letter: str, handle: str) -> Column:
    """A public id, or the temporary one of a handle."""
    return F.coalesce(c, F.concat(F.lit(f"!{letter}"), F.col(handle).cast("string")))


# --- files ---------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether a file, or all files of a directory together, have no bytes."""
    files, at = _files(spark, path)
    return files.getContentSummary(at).getLength() == 0


def full_name(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as tables of files show it."""
    files, at = _files(spark, path)
    return files.makeQualified(at).toUri().toString()


#: Names that stand in a path as they are.
_PLAIN = re.compile(r"[\w-][\w.-]*(/[\w-][\w.-]*)*", re.ASCII)


def full_names(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """full_name of files named in a folder; the file system is asked once for all plain names."""
    base = full_name(spark, folder).rstrip("/") if folder else None
    return [f"{base}/{n}" if base and _PLAIN.fullmatch(n) else full_name(spark, beside(folder, n)) for n in names]


def beside(folder: str, name: str) -> str:
    """A file that is named in a document of folder."""
    return name if "://" in name or name.startswith("/") else posixpath.join(folder, name)


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, at = _files(spark, source)
    to = _files(spark, target)[1]
    files.delete(to, True)
    files.mkdirs(to.getParent())
    if not files.rename(at, to):
        raise OSError(f"can't move {source} to {target}")


# --- writing -------------------------------------------------------------------------------------------------------


def placed(store: Store, table: str, handle: str, kind: str, root: str) -> DataFrame:
    """doc and handle: the documents that the items of a table belong to, those of substores with a file or else root."""
    stored = store.substores.filter("filename is not null").select("ss", F.col("filename").alias("doc"))
    inside = store.substore_membership.filter(F.col("item_type") == kind).join(stored, "ss").select("doc", F.col("item").alias(handle)).distinct()
    items = getattr(store, table).select(handle)
    return items.join(inside, handle, "left_anti").select(F.lit(root).alias("doc"), handle).unionByName(items.join(inside, handle).select("doc", handle))


def _heads(store: Store, root: str, id: str) -> DataFrame:
    """doc and head: the opening of each document up to its lists. Substores name their children in their order."""
    spark = store.spark
    known = store.substores.filter("filename is not null")
    children = known.select(F.explode("parents").alias("ss"), F.struct(F.col("ss").alias("n"), F.col("filename").alias("f")).alias("child"))
    lists = children.groupBy("ss").agg(F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda x: quoted(x["f"])), ",").alias("included"))
    documents = known.select("ss", F.col("filename").alias("doc"), "id").unionByName(spark.createDataFrame([(ROOT, root, id)], "ss long, doc string, id string"))
    include = F.when(F.col("included").isNotNull(), F.concat(F.lit(',"@include":['), "included", F.lit("]"))).otherwise(F.lit(""))
    name = F.when(F.col("id").isNotNull(), F.concat(F.lit(',"@id":'), quoted(F.col("id")))).otherwise(F.lit(""))
    stores = documents.join(lists, "ss", "left").select("doc", F.concat(F.lit('{"@type":"AnnotationStore"'), name, include).alias("head"))
    sets = store.datasets.filter("filename is not null").select(F.col("filename").alias("doc"), F.concat(F.lit('{"@type":"AnnotationDataSet","@id":'), quoted(named(F.col("id"), "S", "set"))).alias("head"))
    return stores.unionByName(sets)


def _items(store: Store, root: str) -> DataFrame:
    """doc, list, n, m and body: all items of all documents as JSON, in the order of list, n and m."""
    from spanloom.sources import stores

    row = lambda df, doc, kind, n, body, m=F.lit(0): df.select(doc.alias("doc"), F.lit(_LISTS[kind]).alias("list"), n.cast("long").alias("n"), m.cast("long").alias("m"), body.alias("body"))
    doc = F.col("doc")
    about = lambda kind, id: F.concat(F.lit(f'{{"@type":"{kind}","@id":'), quoted(id))
    include = lambda c: F.concat(F.lit(',"@include":'), quoted(c), F.lit("}"))
    res = store.resources.join(placed(store, "resources", "res", "resource", root), "res")
    inline = F.concat(F.lit(',"text":'), quoted(F.coalesce("text", F.lit(""))), F.lit("}"))
    out = row(res, doc, "resources", F.col("res"), F.concat(about("TextResource", named(F.col("id"), "R", "res")), F.when(F.col("filename").isNull(), inline).otherwise(include(F.col("filename")))))
    datum = stores.json_data(store.named_data())
    own = store.datasets.filter("filename is not null").select("set", F.col("filename").alias("doc"))
    keys = F.concat(F.lit('{"@id":'), quoted(F.col("id")), F.lit("}"))
    out = out.unionByName(row(store.keys.join(own, "set"), doc, "keys", F.col("key"), keys)).unionByName(row(datum.join(own, "set"), doc, "data", F.col("data"), F.col("json")))
    whole = stores.json_sets(store.with_tables(datasets=store.datasets.filter("filename is null")))
    sets = store.datasets.join(placed(store, "datasets", "set", "dataset", root), "set").join(whole, "set", "left")
    out = out.unionByName(row(sets, doc, "annotationsets", F.col("set"), F.coalesce("json", F.concat(about("AnnotationDataSet", named(F.col("id"), "S", "set")), include(F.col("filename"))))))
    annotations = stores.json_annotations(store).join(placed(store, "annotations", "a", "annotation", root), "a")
    return out.unionByName(row(annotations, doc, "annotations", F.col("a"), F.col("json")))


def lines(store: Store, root: str, id: str) -> DataFrame:
    """doc, list, n, m and line: what follows each other, with a closing brace behind each, is the document."""
    items, heads = settled(_items(store, root)), _heads(store, root, id)
    firsts = items.groupBy("doc", "list").agg(F.min(F.struct("n", "m")).alias("first"))
    order = firsts.groupBy("doc").agg(F.min("list").alias("opening"))
    head = heads.join(order, "doc", "left")
    is_set = F.col("head").startswith('{"@type":"AnnotationDataSet"')
    title = F.when(is_set, F.element_at(F.array(F.lit("keys"), F.lit("data")), F.col("list"))).otherwise(F.element_at(F.array(*map(F.lit, ("resources", "annotationsets", "annotations"))), F.col("list")))
    opener = F.concat(F.when(F.col("list") == F.col("opening"), F.concat("head", F.lit(","))).otherwise(F.lit("],")), F.lit('"'), title, F.lit('":['))
    openers = firsts.filter("list <= 3").join(head, "doc").select("doc", "list", "first", opener.alias("opener"))
    known = items.join(openers, ["doc", "list"])
    body = F.left("body", F.length("body") - 1)
    starts = F.struct("n", "m") == F.col("first")
    rows = known.select("doc", "list", "n", "m", F.concat(F.when(starts, F.col("opener")).otherwise(F.lit(",\n")), body).alias("line"))
    zero = F.lit(0).cast("long")
    ends = head.select("doc", F.lit(_END).alias("list"), zero.alias("n"), zero.alias("m"), F.when(F.col("opening").isNull(), F.col("head")).otherwise(F.lit("]")).alias("line"))
    return rows.unionByName(ends)


def write_texts(texts: DataFrame, folder: str) -> None:
    """Files with the texts (doc, text), unchanged, below folder/doc=<name>. A job for each last character of a text, as a writer ends its rows with one.

    Texts are first parted by that character, so that each job reads its own ones only. Empty texts give no file.
    """
    spark = texts.sparkSession
    parted = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    last = F.concat(F.lit("c"), F.hex(F.encode(F.right("text", F.lit(1)), "utf-8")))
    rows = texts.filter("text != ''").select("doc", F.expr("left(text, length(text) - 1)").alias("value"), last.alias("last"))
    rows.write.option("compression", "zstd").partitionBy("last").parquet(parted)
    files, at = _files(spark, parted)
    found = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]  # single characters
    for name in sorted(n for n in found if n.startswith("last=c")):
        rows = spark.read.schema("doc string, value string").parquet(f"{parted}/{name}").select("value", "doc")
        rows.write.mode("append").partitionBy("doc").option("lineSep", bytes.fromhex(name[6:]).decode()).text(folder)
    remove(spark, parted)


def _written(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The part files below folder by the document that they were written for, listed at once."""
    files, at = _files(spark, folder)
    if not files.exists(at):
        return {}
    jvm = spark.sparkContext._jvm
    plain = re.sub(r"([\\{}\[\]*?,^])", r"\\\1", folder)
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{plain}/doc=*/part-*")))
    found: dict[str, list[str]] = {}
    for path in (p.toString() for p in paths):
        found.setdefault(unquote(path.rpartition("/")[0].rpartition("/doc=")[2]), []).append(path)
    return found


#: Files that are moved at the same time.
MOVERS = 16


def move_documents(spark: SparkSession, folders: list[str], path: str, names: list[str]) -> None:
    """What was written as folder/doc=<name> gets its name below path: one part as a file, several as a directory. Names of which nothing was written become empty files.

    Folders are listed once, and what is in the way is known from listings of the places, so that a file takes a rename and little else.
    """
    files = _files(spark, path)[0]
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    written = {doc: parts for folder in folders for doc, parts in _written(spark, folder).items()}
    places = {posixpath.dirname(f"{path}/{n}") for n in {*written, *names}}
    taken = set()
    for place in places:
        at = new(place)
        if files.exists(at):
            taken.update(f"{place}/{s.getPath().getName()}" for s in files.listStatus(at))
        else:
            files.mkdirs(at)

    def put(name: str) -> None:
        target = f"{path}/{name}"
        to = new(target)
        if name not in written:  # empty texts
            files.create(to, True).close()
            return
        found = written[name]
        source = found[0] if len(found) == 1 else posixpath.dirname(found[0])
        if target in taken:
            files.delete(to, True)
        if not files.rename(new(source), to):
            raise OSError(f"can't move {source} to {target}")

    with ThreadPoolExecutor(MOVERS) as movers:
        list(movers.map(put, [*written, *(n for n in names if n not in written)]))


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def save_include(store: Store, path: str, root: str = "store.json", id: str | None = "store") -> list[str]:
    """The store as documents below the folder path, root being the name of the first; the names of the documents that were written.

    Resources, sets and substores that have a filename get a document of that name; names are relative to path. Substores without one stay in root.
    """
    spark = store.spark
    rows = settled(lines(store, root, id))
    texts = store.resources.filter("filename is not null").select(F.col("filename").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    digests = rows.groupBy("doc").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("list", "n", "m", "line")).alias("digest")).withColumn("kind", F.lit("json"))
    digests = settled(digests.unionByName(texts.select("doc", F.length("text").cast("long").alias("n"), F.xxhash64("text").alias("digest"), F.lit("text").alias("kind"))))
    if digests.count() != digests.select("doc").distinct().count():
        raise ValueError("two items have one filename")
    changed = digests
    if exists(spark, f"{path}/{MANIFEST}"):
        old = spark.read.schema(digests.schema).json(f"{path}/{MANIFEST}")
        changed = settled(digests.join(old, ["doc", "n", "digest", "kind"], "left_anti"))
    names = [(r["doc"], r["n"]) for r in changed.select("doc", "n").collect()]  # names of files
    if not names:
        return []
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    new = rows.join(changed.filter("kind = 'json'").select("doc"), "doc")
    parts = max(1, -(-sum(n for _, n in names) // ROWS))
    new = new.repartitionByRange(parts, "doc", "list", "n", "m").sortWithinPartitions("doc", "list", "n", "m")
    new.select(F.col("line").alias("value"), "doc").write.partitionBy("doc").option("lineSep", "}").text(f"{aside}/json")
    write_texts(texts.join(changed.filter("kind = 'text'").select("doc"), "doc"), f"{aside}/text")
    move_documents(spark, [f"{aside}/json", f"{aside}/text"], path, [name for name, _ in names])
    digests.coalesce(1).write.json(f"{aside}/{MANIFEST}")
    _move(spark, f"{aside}/{MANIFEST}", f"{path}/{MANIFEST}")
    remove(spark, aside)
    return sorted(name for name, _ in names)


# --- reading -------------------------------------------------------------------------------------------------------


def with_names(df: DataFrame, spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """df with a column file, and doc: the name of it among names of files of folder."""
    table = spark.createDataFrame(list(zip(full_names(spark, folder, names), names, strict=True)), "path string, doc string")
    return df.join(table.select(plain_uri(F.col("path")).alias("file"), "doc"), "file").drop("file")


def read_graph(spark: SparkSession, path: str, range_bytes: int | None = None) -> tuple[DataFrame, list[tuple[str, str | None, list[str]]]]:
    """(items: doc, range, n, field, text of all documents that can be reached; documents: (name, id, names of parents) in the order they are met)."""
    folder, root = posixpath.split(path)
    met: dict[str, tuple[str | None, list[str]]] = {}
    level, parents, all_items = [root], {root: []}, None
    while level:
        items, frames = read_items(spark, [beside(folder, n) for n in level], range_bytes)
        items = with_names(items, spark, folder, level)
        all_items = items if all_items is None else all_items.unionByName(items)
        outer = F.from_json("text", "`@id` string, `@include` string")
        include = F.coalesce(F.from_json(F.col("j.@include"), "array<string>"), F.when(F.col("j.@include").isNotNull(), F.array("j.@include")))
        heads = with_names(frames.withColumn("j", outer), spark, folder, level).select("doc", F.col("j.@id").alias("id"), include.alias("includes"))
        found = {r["doc"]: r for r in heads.collect()}  # names of files
        for name in level:
            met[name] = (found[name]["id"] if name in found else None, parents[name])
        following = []
        for name in level:
            for included in (found[name]["includes"] or []) if name in found else []:
                if included in parents:
                    if name not in parents[included] and included not in (root, name):
                        parents[included].append(name)
                else:
                    parents[included] = [name]
                    following.append(included)
        level = following
    return all_items, [(name, id, above) for name, (id, above) in met.items()]


#: Files whose texts are read together; the driver holds a list of so many, with their sizes and places.
FILES = 20_000


def read_texts_of(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """doc and text of files named in folder, in one scan, or in one for each FILES of them. Files that are empty have an empty text."""
    if len(names) > FILES:
        return reduce(DataFrame.unionByName, [settled(read_texts_of(spark, folder, names[i : i + FILES])) for i in range(0, len(names), FILES)])
    rows = spark.read.text([beside(folder, n) for n in names], wholetext=True).select(F.col("value").alias("text"), plain_uri(F.col("_metadata.file_path")).alias("file"))
    every = spark.createDataFrame([(n,) for n in names], "doc string")
    return every.join(with_names(rows, spark, folder, names), "doc", "left").select("doc", F.coalesce("text", F.lit("")).alias("text"))
