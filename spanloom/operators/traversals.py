"""Traversals from one kind of item to another. All are joins on handles; `items` has the handle columns of its kind.

The functions take many items at once and keep the source's handle, so one join serves what would be a loop over items;
`.drop(...).distinct()` gives the iterator forms. Names are source_target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import text_of
from spanloom.functions.values import test
from spanloom.model import ANNOTATION, DATA, DATASET, KEY, RESOURCE, ROOT, TEXT, Store, settled


#: Steps that are taken one by one before they double.
STEPS = 4


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, at): what can be reached from seeds (seed, at) over edges (src, dst) in one step or more. The seeds' own places are there if a ring leads back.

    The frontier of new pairs is joined to the edges, and pairs that are known are left out, so that nothing is read but what the seeds reach. What is deeper than
    STEPS is then reached in strides that double: in each round what is known takes a stride, and strides are joined to strides of twice the length. A chain thus takes as many rounds as
    its length has binary digits; a round's strides are at most pairs of places just that far apart. It ends when nothing is new.
    """
    edges = settled(edges.select("src", "dst").distinct())
    stride = lambda pairs, steps: pairs.join(steps, pairs["at"] == steps["src"]).select("seed", F.col("dst").alias("at")).distinct()
    known = new = settled(stride(seeds.select("seed", "at").distinct(), edges))
    for _ in range(STEPS - 1):
        new = settled(stride(new, edges).join(known, ["seed", "at"], "left_anti"))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    doubled = lambda steps: settled(steps.join(steps.select(F.col("src").alias("dst"), F.col("dst").alias("_far")), "dst").select("src", F.col("_far").alias("dst")).distinct())
    steps, length = edges, 1
    while length < STEPS:
        steps, length = doubled(steps), 2 * length
    while True:
        new = settled(stride(known, steps).join(known, ["seed", "at"], "left_anti"))
        if new.isEmpty():
            return known
        known, steps = settled(known.unionByName(new)), doubled(steps)


def closure(store: Store, annotations: DataFrame) -> DataFrame:
    """(a, target_a): annotations and those that they target, directly or through others, without themselves unless in a ring. Only what the asked ones reach is followed."""
    edges = store.targets.filter(F.col("target_a").isNotNull()).select(F.col("a").alias("src"), F.col("target_a").alias("dst"))
    return reachable(edges, annotations.select(F.col("a").alias("seed"), F.col("a").alias("at"))).select(F.col("seed").alias("a"), F.col("at").alias("target_a"))


def annotation_targets(store: Store, annotations: DataFrame, transitive: bool = False) -> DataFrame:
    """a, target_a: the annotations that annotations target."""
    if transitive:
        return closure(store, annotations)
    return store.targets.filter(F.col("target_a").isNotNull()).select("a", "target_a").distinct().join(annotations.select("a").distinct(), "a", "left_semi")


def annotation_annotations(store: Store, annotations: DataFrame) -> DataFrame:
    """a, by: the annotations that target annotations."""
    return store.targets.filter(F.col("target_a").isNotNull()).select(F.col("a").alias("by"), F.col("target_a").alias("a")).distinct().join(annotations.select("a").distinct(), "a", "left_semi")


def _reached(store: Store, annotations: DataFrame, transitive: bool) -> DataFrame:
    own = annotations.select("a").distinct()
    base = own.select("a", F.col("a").alias("at"))
    return base.unionByName(closure(store, own).select("a", F.col("target_a").alias("at"))) if transitive else base


def annotation_resources(store: Store, annotations: DataFrame, metadata: bool = False, transitive: bool = True) -> DataFrame:
    """a, res: resources by text, or as a whole, also through the annotations targeted."""
    kinds = F.col("kind") == RESOURCE if metadata else F.col("kind").isin(TEXT, ANNOTATION)
    t = store.targets.filter(kinds & F.col("res").isNotNull()).select(F.col("a").alias("at"), "res")
    return _reached(store, annotations, transitive).join(t, "at").select("a", "res").distinct()


def annotation_datasets(store: Store, annotations: DataFrame) -> DataFrame:
    """a, set: datasets that annotations are about."""
    return store.targets.filter(F.col("kind") == DATASET).select("a", "set").distinct().join(annotations.select("a"), "a", "left_semi")


def annotation_selections(store: Store, annotations: DataFrame) -> DataFrame:
    """a, pos, res, ts, begin, end: the spans of annotations; pos keeps the order of directional ones."""
    return store.spans().join(annotations.select("a").distinct(), "a", "left_semi")


#: Texts are cut to pieces of so many code points, each with the beginning of the next one. Before a piece stand MARK code points that tell its text from others.
PIECE, OVERLAP, MARK = 2048, 1024, 16


def text_pieces(store: Store) -> DataFrame:
    """res, _piece (from 0) and _text: a mark of the text, PIECE code points of it and OVERLAP more.

    All in one column, so that all that need pieces need the same and share their shuffle.
    """
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    pieces = store.resources.select("res", F.lpad(F.hex(F.xxhash64("text")), MARK, "0").alias("_of"), cut.alias("_all")).select("res", "_of", F.posexplode(F.transform("_all", lambda p, i: F.concat(p, F.coalesce(F.left(F.get("_all", i + 1), F.lit(OVERLAP)), F.lit("")))).alias("_texts")))
    return pieces.select("res", F.col("pos").alias("_piece"), F.concat("_of", "col").alias("_text"))


def selection_text(store: Store, spans: DataFrame) -> DataFrame:
    """spans with text. Spans meet the pieces of the text that they are in, so that their cost does not grow with the text, and a text is moved once.

    Spans up to the overlap are in one piece; longer ones are put together from all pieces that they reach.
    """
    begin, end, width = F.col("begin"), F.col("end"), F.col("end") - F.col("begin")
    piece = lambda c: F.call_function("div", c, F.lit(PIECE)).cast("int")
    pieces, at = text_pieces(store), F.col("_piece") * PIECE
    columns = [*spans.columns, "text"]
    short = spans.filter((width <= OVERLAP) & (width > 0)).withColumn("_piece", piece(begin))
    cut = short.join(pieces, ["res", "_piece"]).withColumn("text", text_of(F.col("_text"), begin - at + MARK, end - at + MARK)).select(columns)
    long = spans.filter(width > OVERLAP).withColumn("_piece", F.explode(F.sequence(piece(begin), piece(end - 1))))
    part = text_of(F.col("_text"), F.greatest(begin - at, F.lit(0)) + MARK, F.least(end - at, F.lit(PIECE)) + MARK)
    # Rows that are equal in all columns have each piece as often.
    gathered = long.join(pieces, ["res", "_piece"]).groupBy(*spans.columns, F.left("_text", F.lit(MARK)).alias("_of")).agg(F.array_sort(F.collect_set(F.struct("_piece", part.alias("part")))).alias("_parts"), F.count("*").alias("_n"))
    copies = F.call_function("div", F.col("_n"), F.size("_parts"))
    whole = gathered.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).withColumn("text", F.array_join(F.transform("_parts", lambda x: x["part"]), ""))
    empty = spans.filter(end <= begin).withColumn("text", F.lit(""))
    return cut.unionByName(whole.select(columns)).unionByName(empty.select(columns))


def annotation_text(store: Store, annotations: DataFrame, delimiter: str | None = None, length: int | None = None) -> DataFrame:
    """a, text: of annotations with text. With a delimiter all spans' texts joined in order; without, of those with one span only.

    length: only texts of so many code points are wanted.
    """
    spans = annotation_selections(store, annotations)
    # Nearly all annotations have one span; only those with further ones are gathered.
    several = store.spans().filter("pos > 0").select("a").distinct()
    single = spans.join(several, "a", "left_anti")
    if length is not None:
        single = single.filter(F.col("end") - F.col("begin") == length)
    one = selection_text(store, single).select("a", "text")
    texts = selection_text(store, spans.join(several, "a", "left_semi"))
    parts = texts.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    if delimiter is None:
        parts = parts.filter(F.size("parts") == 1)
    return one.unionByName(parts.select("a", F.array_join(F.transform("parts", lambda x: x["text"]), delimiter or "").alias("text")))


def annotation_data(store: Store, annotations: DataFrame, metadata: bool = False) -> DataFrame:
    """a, set, data: the data of annotations, or the data that they are about."""
    if metadata:
        pairs = store.targets.filter(F.col("kind") == DATA).select("a", "set", "data")
    else:
        pairs = store.annotation_data.select("a", "set", "data")
    return pairs.distinct().join(annotations.select("a").distinct(), "a", "left_semi")


def annotation_keys(store: Store, annotations: DataFrame, metadata: bool = False) -> DataFrame:
    """a, set, key."""
    if metadata:
        return store.targets.filter(F.col("kind") == KEY).select("a", "set", "key").distinct().join(annotations.select("a"), "a", "left_semi")
    return annotation_data(store, annotations).join(store.data.select("set", "data", "key"), ["set", "data"]).select("a", "set", "key").distinct()


def selection_annotations(store: Store, spans: DataFrame) -> DataFrame:
    """res, begin, end, a: annotations on exactly these spans, known or not."""
    return spans.select("res", "begin", "end").distinct().join(store.spans().select("res", "begin", "end", "a"), ["res", "begin", "end"]).distinct()


def resource_annotations(store: Store, resources: DataFrame, metadata: bool = False) -> DataFrame:
    """res, a: annotations on the text of resources, or about them as a whole. Only annotations with several targets can repeat."""
    pairs = store.targets.filter(F.col("kind") == RESOURCE).select("res", "a", "pos") if metadata else store.spans().select("res", "a", "pos")
    pairs = pairs.join(resources.select("res").distinct(), "res", "left_semi")
    several = store.targets.filter("pos > 0").select("a").distinct()
    once, again = pairs.join(several, "a", "left_anti"), pairs.join(several, "a", "left_semi")
    return once.select("res", "a").unionByName(again.select("res", "a").distinct())


def resource_selections(store: Store, resources: DataFrame) -> DataFrame:
    return store.textselections.join(resources.select("res").distinct(), "res", "left_semi")


def whole(store: Store, resources: DataFrame) -> DataFrame:
    """res, begin, end of whole resources."""
    return store.resources.join(resources.select("res"), "res", "left_semi").select("res", F.lit(0).alias("begin"), F.col("textlen").alias("end"))


def data_annotations(store: Store, data: DataFrame, metadata: bool = False) -> DataFrame:
    """set, data, a: annotations that use data, or are about it."""
    pairs = store.targets.filter(F.col("kind") == DATA).select("set", "data", "a") if metadata else store.annotation_data.select("set", "data", "a")
    return pairs.distinct().join(data.select("set", "data").distinct(), ["set", "data"], "left_semi")


def data_resources(store: Store, data: DataFrame, metadata: bool = False) -> DataFrame:
    """set, data, res: resources with text annotated with data, or annotated as a whole."""
    by = data_annotations(store, data)
    return by.join(annotation_resources(store, by, metadata, transitive=False), "a").select("set", "data", "res").distinct()


def data_datasets(store: Store, data: DataFrame) -> DataFrame:
    """set, data, about: datasets annotated with data."""
    by = data_annotations(store, data)
    return by.join(annotation_datasets(store, by).withColumnRenamed("set", "about"), "a").select("set", "data", "about").distinct()


def data_keys(store: Store, data: DataFrame) -> DataFrame:
    return store.data.join(data.select("set", "data"), ["set", "data"], "left_semi").select("set", "key").distinct()


def key_data(store: Store, keys: DataFrame) -> DataFrame:
    return store.data.join(keys.select("set", "key").distinct(), ["set", "key"], "left_semi").select("set", "key", "data")


def key_annotations(store: Store, keys: DataFrame, metadata: bool = False) -> DataFrame:
    """set, key, a."""
    if metadata:
        return store.targets.filter(F.col("kind") == KEY).select("set", "key", "a").distinct().join(keys.select("set", "key"), ["set", "key"], "left_semi")
    return store.annotation_data.select("set", "data", "a").join(key_data(store, keys), ["set", "data"]).select("set", "key", "a").distinct()


def key_resources(store: Store, keys: DataFrame, metadata: bool = False) -> DataFrame:
    by = key_annotations(store, keys)
    return by.join(annotation_resources(store, by, metadata, transitive=False), "a").select("set", "key", "res").distinct()


def key_datasets(store: Store, keys: DataFrame) -> DataFrame:
    by = key_annotations(store, keys)
    return by.join(annotation_datasets(store, by).withColumnRenamed("set", "about"), "a").select("set", "key", "about").distinct()


def set_annotations(store: Store, sets: DataFrame) -> DataFrame:
    """set, a: annotations about sets as a whole."""
    return store.targets.filter(F.col("kind") == DATASET).select("set", "a").distinct().join(sets.select("set"), "set", "left_semi")


def set_data(store: Store, sets: DataFrame) -> DataFrame:
    return store.data.join(sets.select("set").distinct(), "set", "left_semi").select("set", "data")


def set_keys(store: Store, sets: DataFrame) -> DataFrame:
    return store.keys.join(sets.select("set").distinct(), "set", "left_semi").select("set", "key")


def members(store: Store, substores: DataFrame, item_type: str) -> DataFrame:
    """ss, item: annotations, resources or datasets of substores."""
    return store.substore_membership.filter(F.col("item_type") == item_type).select("ss", "item").join(substores.select("ss").distinct(), "ss", "left_semi")


def substores_below(store: Store, substores: DataFrame) -> DataFrame:
    """ss, below: substores and those in them at any depth; in rings of includes also themselves, each once."""
    edges = store.substores.select(F.explode("parents").alias("src"), F.col("ss").alias("dst"))
    own = settled(substores.select(F.col("ss").alias("seed"), F.col("ss").alias("at")).distinct())
    return own.unionByName(reachable(edges, own)).distinct().select(F.col("seed").alias("ss"), F.col("at").alias("below"))


def nested_members(store: Store, substores: DataFrame, item_type: str) -> DataFrame:
    """ss, item: as members, with those of the substores in them at any depth, each once."""
    own = store.substore_membership.filter(F.col("item_type") == item_type).select(F.col("ss").alias("below"), "item")
    return substores_below(store, substores).join(own, "below").select("ss", "item").distinct()


def item_substores(store: Store, items: DataFrame, item_type: str) -> DataFrame:
    """item, ss: the substores of items (a column item), null for those of the root only."""
    found = store.substore_membership.filter((F.col("item_type") == item_type) & (F.col("ss") != ROOT)).select("item", "ss")
    return items.select("item").distinct().join(found, "item", "left")


def child_substores(store: Store, ss: int) -> DataFrame:
    return store.substores.filter(F.array_contains("parents", F.lit(ss)))


def find_data(store: Store, set_id: str | None = None, key_id: str | None = None, op: tuple | None = None) -> DataFrame:
    """Data by set, key and value operator, each optional: set, data, key. Unknown names give nothing; a key needs a set."""
    if key_id is not None and set_id is None:
        raise ValueError("a key is looked up in a set")
    df = store.named_data()
    if set_id is not None:
        df = df.filter(F.col("set_id") == set_id)
    if key_id is not None:
        df = df.filter(F.col("key_id") == key_id)
    if op is not None:
        df = df.filter(test(F.col("value"), op))
    return df.select("set", "data", "key")


def resources_by_metadata(store: Store, data: DataFrame) -> DataFrame:
    """res, set, data: a row for each annotation, so that duplicates are possible."""
    used = store.annotation_data.join(data.select("set", "data"), ["set", "data"], "left_semi")
    return used.join(store.targets.filter(F.col("kind") == RESOURCE).select("a", "res"), "a").select("res", "set", "data")


def datasets_by_metadata(store: Store, data: DataFrame) -> DataFrame:
    """about, set, data, as resources_by_metadata."""
    used = store.annotation_data.join(data.select("set", "data"), ["set", "data"], "left_semi")
    return used.join(store.targets.filter(F.col("kind") == DATASET).select("a", F.col("set").alias("about")), "a").select("about", "set", "data")
