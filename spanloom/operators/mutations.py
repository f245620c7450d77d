"""Building, changing and deleting. Every function returns a new Store; tables are derived, none is written in place.

Builders are rows of one DataFrame, `BUILDERS`, so that a million annotations are added by the same few joins as one:
ids are resolved by joins, offsets by arithmetic, data are looked up or made, and handles follow the largest ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import resolve
from spanloom.model import ANNOTATION, COMPOSITE, DATA, DATASET, KEY, MULTI, RESOURCE, SCHEMAS, TEXT, VALUE, Store, intern, row_numbers, settled

TARGET = "kind string, resource string, annotation string, dataset string, key string, data string, begin int, end int, mode string"
BUILDERS = f"id string, complex string, targets array<struct<{TARGET.replace(' ', ': ').replace(',:', ',')}>>, data array<struct<id: string, set: string, key: string, value: {VALUE}>>"
_TARGETS = f"targets array<struct<{TARGET.replace(' ', ': ').replace(',:', ',')}>>"
DEFAULT_SET = "default-annotationset"


def _numbered(rows: DataFrame, existing: DataFrame, handle: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """rows with handles that follow the largest of existing (in each group), in an order made total by all columns of a row.

    All groups are numbered together by ranges, and each group's first number is taken off, so that one group with all rows is no task of its own.
    """
    groups = within or []
    top = existing.groupBy(*groups).agg(F.max(handle).alias("_top"))
    if not groups:
        numbered = row_numbers(rows, order, "_n")
        return numbered.crossJoin(F.broadcast(top)).withColumn(handle, (F.coalesce("_top", F.lit(-1)) + 1 + F.col("_n")).cast("long")).drop("_top", "_n")  # one row
    numbered = settled(row_numbers(rows, [*groups, *order], "_n"))
    firsts = numbered.groupBy(*groups).agg(F.min("_n").alias("_first"))
    placed = numbered.join(firsts, groups).join(top, groups, "left")
    return placed.withColumn(handle, (F.coalesce("_top", F.lit(-1)) + 1 + F.col("_n") - F.col("_first")).cast("long")).drop("_top", "_n", "_first")


def add_resources(store: Store, rows: DataFrame) -> Store:
    """rows: id, text and optionally filename. Ids that exist with the same text are left out, with another text an error.

    Ids are compared and numbered with the texts' SHA-256, so that the texts themselves are moved once.
    """
    rows = rows.select("id", "text", *(["filename"] if "filename" in rows.columns else [F.lit(None).cast("string").alias("filename")]))
    print_of = F.sha2(F.encode("text", "utf-8"), 256)
    key = F.to_json(F.struct("id", "_print"))
    rows = rows.withColumn("_print", print_of).withColumn("_key", key)
    prints = settled(rows.select("id", "_print", "_key").distinct())
    clash = prints.join(store.resources.select("id", print_of.alias("_old")), "id").filter("_print <> _old")
    if not clash.isEmpty():
        raise ValueError("a resource with that id and another text exists")
    new = _numbered(prints.join(store.resources, "id", "left_anti").select("id", "_key"), store.resources, "res", ["id"]).select("_key", "res")
    placed = rows.dropDuplicates(["_key"]).join(new, "_key")
    return store.with_tables(resources=store.resources.unionByName(placed.select("res", "id", "text", F.length("text").alias("textlen"), "filename")))


def add_datasets(store: Store, ids: DataFrame) -> Store:
    """ids: a column id."""
    new = ids.select("id").dropna().distinct().join(store.datasets, "id", "left_anti")
    new = _numbered(new, store.datasets, "set", ["id"]).select("set", "id", F.lit(None).cast("string").alias("filename"))
    return store.with_tables(datasets=store.datasets.unionByName(new))


def insert_data(store: Store, rows: DataFrame) -> tuple[Store, DataFrame]:
    """Upsert of rows (set_id, id, key_id, value): the Store, and rows with set and data.

    Sets and keys are made where they are missing. Equal set, key and value is one item, unless an id says otherwise.
    """
    rows = rows.withColumn("set_id", F.coalesce("set_id", F.lit(DEFAULT_SET)))
    store = add_datasets(store, rows.select(F.col("set_id").alias("id")))
    sets = store.datasets.select("set", F.col("id").alias("set_id"))
    wanted = rows.join(sets, "set_id").select("set", F.col("key_id").alias("id")).dropna().distinct().join(store.keys, ["set", "id"], "left_anti")
    keys = _numbered(wanted, store.keys, "key", ["id"], ["set"]).select("set", "key", "id")
    store = store.with_tables(keys=store.keys.unionByName(keys))
    placed = rows.join(sets, "set_id").join(store.keys.select("set", "key", F.col("id").alias("key_id")), ["set", "key_id"], "left")
    by_id = placed.filter("id is not null").select("set", "id", "key", "value").dropDuplicates(["set", "id"])
    by_id = by_id.filter("key is not null").join(store.data, ["set", "id"], "left_anti")
    print_of = F.to_json("value")
    known = store.data.withColumn("_print", print_of).select("set", "key", "_print").unionByName(by_id.withColumn("_print", print_of).select("set", "key", "_print"))
    by_value = placed.filter("id is null").withColumn("_print", print_of).select("set", F.col("id"), "key", "value", "_print").dropDuplicates(["set", "key", "_print"]).join(known, ["set", "key", "_print"], "left_anti")
    new = _numbered(by_id.unionByName(by_value.drop("_print")).withColumn("_print", print_of), store.data, "data", ["key", "_print", "id"], ["set"])
    store = store.with_tables(data=store.data.unionByName(new.select("set", "data", "id", "key", "value")))
    made = store.data.withColumn("_print", print_of)
    one = made.groupBy("set", "key", "_print").agg(F.min("data").alias("data"))
    with_id = placed.filter("id is not null").join(made.select("set", F.col("id"), "data"), ["set", "id"])
    without = placed.filter("id is null").withColumn("_print", print_of).join(one, ["set", "key", "_print"]).drop("_print")
    return store, with_id.unionByName(without.select(with_id.columns))


def annotate(store: Store, builders: DataFrame) -> Store:
    """Add the annotations of builders (BUILDERS). Offsets on an annotation are relative to its only span and stored absolute.

    Members of multi and composite selectors get textual order, those of directional ones keep theirs. An annotation needs a target.
    """
    if not builders.filter("targets is null or size(targets) = 0").isEmpty():
        raise ValueError("an annotation needs a target")
    rows = _numbered(builders, store.annotations, "a", ["id"]).withColumn("complex", F.when(F.size("targets") > 1, F.coalesce("complex", F.lit(COMPOSITE))))
    rows = settled(rows)  # handles are given once
    if rows.count() != rows.select(F.coalesce("id", F.col("a").cast("string"))).distinct().count() or not rows.join(store.annotations, "id", "left_semi").isEmpty():
        raise ValueError("an annotation with that id exists")
    annotations = store.annotations.unionByName(rows.select("a", "id", "complex"))

    store = _with_targets(store, _resolved_in_turn(store, annotations, rows))
    d = rows.select("a", F.posexplode("data").alias("pos", "d")).select("a", "pos", F.col("d.id").alias("id"), F.col("d.set").alias("set_id"), F.col("d.key").alias("key_id"), F.col("d.value").alias("value"))
    store, placed = insert_data(store, d)
    data = store.annotation_data.unionByName(placed.select("a", "pos", "set", "data"))
    return store.with_tables(annotations=annotations, annotation_data=data)


def _resolved_in_turn(store: Store, annotations: DataFrame, rows: DataFrame) -> DataFrame:
    """The targets of rows. Rows with offsets on others of the rows wait until those have their spans: a job for each level of them."""
    offsets = rows.select("a", F.explode("targets").alias("t")).filter((F.col("t.kind") == ANNOTATION) & F.col("t.begin").isNotNull())
    own = rows.select(F.explode(F.array_compact(F.array("id", F.concat(F.lit("!A"), F.col("a").cast("string"))))).alias("name"), F.col("a").alias("on"))
    waits = settled(offsets.select("a", F.col("t.annotation").alias("name")).join(own, "name").select("a", "on").distinct())
    done = None
    while True:
        held = waits.select("a").distinct()
        ready = rows.join(held, "a", "left_anti") if done is None else rows.join(last, "a", "left_semi")  # noqa: F821
        t = settled(_resolved(store, annotations, ready))
        done = t if done is None else done.unionByName(t)
        if waits.isEmpty():
            return done
        store = store.with_tables(targets=store.targets.unionByName(t.withColumn("ts", F.lit(None).cast("long")).select(store.targets.columns)))
        left = settled(waits.join(waits.select(F.col("a").alias("on")).distinct(), "on", "left_semi").select("a", "on"))
        last = settled(held.join(left.select("a"), "a", "left_anti"))
        if last.isEmpty():
            raise ValueError("annotations have offsets on each other in a ring")
        waits = left


def _resolved(store: Store, annotations: DataFrame, rows: DataFrame) -> DataFrame:
    """Targets of rows (a, complex, targets) with handles and absolute offsets, without those of selections."""
    t = rows.select("a", "complex", F.posexplode("targets").alias("pos", "t")).select("a", "complex", "pos", "t.*")
    def named(df: DataFrame, handle: str, name: str) -> DataFrame:
        """Handles by public and by temporary ids."""
        temporary = F.concat(F.lit({"a": "!A", "res": "!R", "set": "!S"}[handle]), F.col(handle).cast("string"))
        return df.select(F.explode(F.array_compact(F.array("id", temporary))).alias(name), F.col(handle).alias(f"_{handle}"))

    t = t.join(named(store.resources, "res", "resource"), "resource", "left").join(store.resources.select(F.col("res").alias("_res"), "textlen"), "_res", "left")
    t = t.join(named(annotations, "a", "annotation"), "annotation", "left").join(named(store.datasets, "set", "dataset"), "dataset", "left")
    t = t.join(store.keys.select(F.col("set").alias("_set"), F.col("id").alias("key"), F.col("key").alias("_key")), ["_set", "key"], "left")
    t = t.join(store.data.select(F.col("set").alias("_set"), F.col("id").alias("data"), F.col("data").alias("_data")), ["_set", "data"], "left")
    single = store.spans().groupBy("a").agg(F.count("*").alias("_n"), F.first("res").alias("_ares"), F.first("begin").alias("_ab"), F.first("end").alias("_ae")).filter("_n = 1").drop("_n")
    t = t.join(single.withColumnRenamed("a", "_a"), "_a", "left")
    mode = F.coalesce("mode", F.lit("BeginBegin"))
    whole = F.col("begin").isNull()
    low, high = F.coalesce("_ab", F.lit(0)), F.coalesce("_ae", F.col("textlen"))
    spanned = F.col("kind").isin(TEXT) | (F.col("kind") == ANNOTATION) & ~whole & F.col("_ares").isNotNull()
    span = F.when(spanned, F.when(whole, F.struct(low.alias("begin"), high.alias("end"))).otherwise(resolve(F.col("begin"), F.col("end"), mode, low, high)))
    t = settled(t.withColumns({"_span": span, "_spanned": spanned}))
    bad = t.filter((F.col("_spanned") & F.col("_span").isNull()) | (F.col("kind").isin(TEXT, RESOURCE) & F.col("_res").isNull()) | ((F.col("kind") == ANNOTATION) & F.col("_a").isNull()) | (F.col("kind").isin(DATASET, KEY, DATA) & F.col("_set").isNull()) | ((F.col("kind") == KEY) & F.col("_key").isNull()) | ((F.col("kind") == DATA) & F.col("_data").isNull()))
    if not bad.isEmpty():
        raise ValueError("a target has an unknown id or an offset outside its text")
    res = F.when(F.col("_spanned"), F.coalesce("_ares", "_res")).when(F.col("kind") == RESOURCE, F.col("_res"))
    t = t.select("a", "complex", "pos", "kind", res.alias("res"), F.col("_span.begin").alias("begin"), F.col("_span.end").alias("end"), F.when(F.col("_spanned"), mode).alias("mode"), F.col("_a").alias("target_a"), F.col("_set").alias("set"), F.col("_key").alias("key"), F.col("_data").alias("data"))
    order = [F.when(F.col("complex").isin(MULTI, COMPOSITE), F.col("res")), F.when(F.col("complex").isin(MULTI, COMPOSITE), F.col("begin")), F.when(F.col("complex").isin(MULTI, COMPOSITE), F.col("end")), F.col("pos")]
    t = t.withColumn("pos", F.row_number().over(Window.partitionBy("a").orderBy(*order)) - 1).drop("complex")
    return t


def _with_targets(store: Store, t: DataFrame) -> Store:
    """store with targets t, and their selections interned."""
    old = store.targets.drop("ts")
    every = old.unionByName(t)
    known = store.textselections
    fresh = t.filter("begin is not null").select("res", "begin", "end").distinct().join(known, ["res", "begin", "end"], "left_anti")
    selections = known.unionByName(_numbered(fresh, known, "ts", ["begin", "end"], ["res"]).select("res", "ts", "begin", "end"))
    targets = every.join(selections, ["res", "begin", "end"], "left").select(*[c.split()[0] for c in SCHEMAS["targets"].split(", ")])
    return store.with_tables(targets=targets, textselections=selections)


def remove_annotations(store: Store, annotations: DataFrame) -> Store:
    """Without annotations (a) and all that target them, directly or not."""
    from spanloom.operators.traversals import reachable

    edges = store.targets.filter("target_a is not null").select(F.col("target_a").alias("src"), F.col("a").alias("dst"))
    asked = settled(annotations.select("a").distinct())
    above = reachable(edges, asked.select(F.lit(0).alias("seed"), F.col("a").alias("at"))).select(F.col("at").alias("a"))
    gone = asked.unionByName(above).distinct()
    keep = lambda df: df.join(gone, "a", "left_anti")
    targets = keep(store.targets).select(store.targets.columns)
    used = targets.filter("ts is not null").select("res", "ts").distinct()
    membership = store.substore_membership.join(gone.select(F.col("a").alias("item"), F.lit("annotation").alias("item_type")), ["item", "item_type"], "left_anti").select(store.substore_membership.columns)
    return store.with_tables(annotations=keep(store.annotations), targets=targets, annotation_data=keep(store.annotation_data), textselections=store.textselections.join(used, ["res", "ts"], "left_semi"), substore_membership=membership)


def remove_resources(store: Store, resources: DataFrame) -> Store:
    """Without resources (res) and the annotations on or about them."""
    store = remove_annotations(store, store.targets.join(resources.select("res"), "res", "left_semi"))
    return store.with_tables(resources=store.resources.join(resources.select("res"), "res", "left_anti"))


def remove_data(store: Store, data: DataFrame, strict: bool = False) -> Store:
    """Without data (set, data). strict: annotations that use it go too; otherwise only those left without any data."""
    on = ["set", "data"]
    about = store.targets.filter(F.col("kind") == DATA).join(data.select(*on), on, "left_semi").select("a")
    using = store.annotation_data.join(data.select(*on), on, "left_semi").select("a").distinct()
    rest = store.annotation_data.join(data.select(*on), on, "left_anti")
    gone = using if strict else using.join(rest, "a", "left_anti")
    store = store.with_tables(annotation_data=rest.select(store.annotation_data.columns), data=store.data.join(data.select(*on), on, "left_anti").select(store.data.columns))
    return remove_annotations(store, gone.union(about))


def remove_keys(store: Store, keys: DataFrame, strict: bool = False) -> Store:
    """Without keys (set, key), their data, and the annotations about them."""
    on = ["set", "key"]
    about = store.targets.filter(F.col("kind") == KEY).join(keys.select(*on), on, "left_semi").select("a")
    store = remove_data(store, store.data.join(keys.select(*on), on, "left_semi"), strict)
    store = remove_annotations(store, about)
    return store.with_tables(keys=store.keys.join(keys.select(*on), on, "left_anti").select(store.keys.columns))


def remove_datasets(store: Store, sets: DataFrame) -> Store:
    """Without sets (set) and all annotations that use or target them or what is in them."""
    own = sets.select("set").distinct()
    gone = store.annotation_data.join(own, "set", "left_semi").select("a").union(store.targets.join(own, "set", "left_semi").select("a"))
    store = remove_annotations(store, gone)
    keep = lambda df: df.join(own, "set", "left_anti").select(df.columns)
    return store.with_tables(datasets=keep(store.datasets), keys=keep(store.keys), data=keep(store.data))


def reannotate(store: Store, a: int, data: DataFrame | None = None, replace: bool = False, targets: list[tuple] | None = None, complex: str | None = None) -> Store:
    """Add data (set_id, id, key_id, value) to annotation a, or put it in place of what it has; targets (as in BUILDERS) replace its target."""
    rows = store.spark.createDataFrame([(a, complex, targets)], f"a bigint, complex string, {_TARGETS}") if targets is not None else None
    return reannotate_all(store, data.withColumn("a", F.lit(a).cast("long")) if data is not None else None, replace, rows)


def reannotate_all(store: Store, data: DataFrame | None = None, replace: bool = False, targets: DataFrame | None = None) -> Store:
    """Many annotations at once. data: a, set_id, id, key_id, value; targets: a, complex, targets (as in BUILDERS).

    replace: data takes the place of what the annotations in it have; otherwise what they don't have yet is added.
    """
    if data is not None:
        store, placed = insert_data(store, settled(data))  # read often below; data may stand for texts
        new = placed.select("a", "set", "data").distinct()
        have = store.annotation_data.join(new.select("a").distinct(), "a", "left_semi")
        if not replace:
            new = new.join(have, ["a", "set", "data"], "left_anti")
        top = have.groupBy("a").agg((F.max("pos") + 1).alias("_top"))
        pos = F.row_number().over(Window.partitionBy("a").orderBy("set", "data")) - 1
        rows = new.join(top, "a", "left").select("a", (pos + (F.lit(0) if replace else F.coalesce("_top", F.lit(0)))).cast("int").alias("pos"), "set", "data")
        kept = store.annotation_data.join(new.select("a").distinct(), "a", "left_anti").select(store.annotation_data.columns) if replace else store.annotation_data
        store = store.with_tables(annotation_data=kept.unionByName(rows))
    if targets is not None:
        rows = settled(targets.select("a", F.when(F.size("targets") > 1, F.coalesce("complex", F.lit(COMPOSITE))).alias("complex"), "targets"))
        own = rows.select("a")
        kept = store.with_tables(targets=store.targets.join(own, "a", "left_anti").select(store.targets.columns))
        changed = _resolved(kept, store.annotations, rows)
        about = rows.select("a", F.col("complex").alias("_complex"))
        annotations = store.annotations.join(about.withColumn("_changed", F.lit(True)), "a", "left").select("a", "id", F.when(F.col("_changed"), F.col("_complex")).otherwise(F.col("complex")).alias("complex"))
        store = _with_targets(kept, changed).with_tables(annotations=annotations)
    return store


def strip_ids(store: Store, table: str = "annotations") -> Store:
    """Without public ids of annotations or data."""
    df = getattr(store, table)
    return store.with_tables(**{table: df.withColumn("id", F.lit(None).cast("string"))})


def reindex(store: Store) -> Store:
    """Annotation handles without gaps, in their order. Numbers are given by ranges of handles, not in one task."""
    new = settled(row_numbers(store.annotations.select("a"), ["a"], "_new").withColumn("_new", F.col("_new").cast("long")))
    move = lambda df, c="a": df.join(new.withColumnRenamed("a", c), c, "left").withColumn(c, F.col("_new")).drop("_new").select(df.columns)
    return store.with_tables(annotations=move(store.annotations), targets=move(move(store.targets), "target_a"), annotation_data=move(store.annotation_data))


def associate(store: Store, items: DataFrame, item_type: str, ss: int) -> Store:
    """Put items (a column item) into a substore. Annotations are in one substore only, resources and datasets in several."""
    rows = items.select(F.lit(ss).cast("long").alias("ss"), F.lit(item_type).alias("item_type"), "item").distinct()
    on = ["item_type", "item"] + ([] if item_type == "annotation" else ["ss"])
    kept = store.substore_membership.join(rows, on, "left_anti").select(rows.columns)
    return store.with_tables(substore_membership=kept.unionByName(rows))


def add_substore(store: Store, id: str, filename: str | None = None, parent: int = -1) -> Store:
    row = store.spark.createDataFrame([(id, filename, [parent])], "id string, filename string, parents array<bigint>")
    return store.with_tables(substores=store.substores.unionByName(_numbered(row, store.substores, "ss", ["id"]).select("ss", "id", "filename", "parents")))


def rebuild_selections(store: Store) -> Store:
    """textselections and the handles in targets anew, from the offsets of targets."""
    selections = intern(store.targets.filter("begin is not null"))
    return store.with_tables(textselections=selections, targets=store.targets.drop("ts").join(selections, ["res", "begin", "end"], "left").select(store.targets.columns))
