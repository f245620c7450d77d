"""Transposition and translation of annotations: new annotations on the other sides of pivots, as rows of `mutations.BUILDERS`.

Many annotations go through many pivots at once. Per pair of pivot and annotation (a pair whose spans no side covers gives no
rows) there are: an annotation for each other side, with the data of the one that is mapped; a copy of the source's spans, cut as
the pivot's segments are, where a span was cut or the source has no id; a resegmentation that links the two; and the new
pivot over all sides. Ids follow templates with {source}, {pivot} and {side}, so that reruns agree; there are no random ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.model import ANNOTATION, DIRECTIONAL, TEXT, VALUE, Store, settled, value
from spanloom.operators import mutations
from spanloom.operators.extensions import sides
from spanloom.operators.related import join_related


@dataclass(frozen=True)
class Config:
    """Options of a mapping. side: the pivot's side that has the source (None: the first that covers it).

    allow_simple: a source of one part gives one annotation over all spans in place of one for each side. no_pivot: no new pivot.
    no_resegmentation: a cut source isn't linked to its parts (transposition), or its adjacent parts are joined (translation).
    target_ids: templates in the order of the sides without the source.
    """

    vocabulary: str
    pivot_key: str
    side: int | None = None
    allow_simple: bool = False
    no_pivot: bool = False
    no_resegmentation: bool = False
    pivot_id: str = "{source}-{pivot}-mapping"
    resegmentation_id: str = "{source}-{pivot}-resegmentation"
    source_id: str = "{source}-{pivot}-source"
    target_ids: tuple[str, ...] = ()
    target_id: str = "{source}-{pivot}-{side}-mapped"


@dataclass(frozen=True)
class TransposeConfig(Config):
    """Sides with equal texts: spans are cut where segments end, and offsets in segments stay."""

    vocabulary: str = "text-transposition"
    pivot_key: str = "Transposition"


@dataclass(frozen=True)
class TranslateConfig(Config):
    """Sides with other texts: spans are tiled by whole segments of complex pivots."""

    vocabulary: str = "text-translation"
    pivot_key: str = "Translation"


def valid_pivots(store: Store, annotations: DataFrame) -> DataFrame:
    """a, valid: annotations can be pivots if their target is complex."""
    return store.annotations.join(annotations.select("a"), "a", "left_semi").select("a", F.col("complex").isNotNull().alias("valid"))


def _cut(spans: DataFrame, seg: DataFrame) -> DataFrame:
    """Spans where segments cut them: low and high are relative to the segment."""
    c = join_related(spans, seg.select("res", "begin", "end", "pivot", "side", "seq"), "overlaps")
    begin, end = F.greatest("begin", "r_begin"), F.least("end", "r_end")
    return c.select("key", "pos", "res", F.col("r_pivot").alias("pivot"), F.col("r_side").alias("side"), F.col("r_seq").alias("seq"), F.col("begin").alias("span_begin"), F.col("end").alias("span_end"), begin.alias("begin"), end.alias("end"), (begin - F.col("r_begin")).alias("low"), (end - F.col("r_begin")).alias("high"), F.lit("part").alias("match"))


def _whole(spans: DataFrame, seg: DataFrame) -> DataFrame:
    """Segments inside spans; a span of no width takes the first segment that begins or ends there."""
    c = join_related(spans.filter("begin < end"), seg.select("res", "begin", "end", "pivot", "side", "seq"), "embeds")
    shown = [F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high")]
    inside = c.select("key", "pos", "res", F.col("r_pivot").alias("pivot"), F.col("r_side").alias("side"), F.col("r_seq").alias("seq"), F.col("begin").alias("span_begin"), F.col("end").alias("span_end"), F.col("r_begin").alias("begin"), F.col("r_end").alias("end"), *shown, F.lit("whole").alias("match"))
    edges = seg.select("res", "pivot", "side", "seq", F.col("begin").alias("r_begin"), F.col("end").alias("r_end"), F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit("begin").alias("match")), F.struct(F.col("end").alias("at"), F.lit("end").alias("match")))).alias("x")).select("*", F.col("x.at").alias("begin"), "x.match")
    points = spans.filter("begin = end").join(edges, ["res", "begin"])
    first = F.row_number().over(Window.partitionBy("key", "pos", "pivot", "side").orderBy("seq", "match"))
    points = points.withColumn("_first", first).filter("_first = 1").select("key", "pos", "res", "pivot", "side", "seq", F.col("begin").alias("span_begin"), F.col("end").alias("span_end"), F.col("r_begin").alias("begin"), F.col("r_end").alias("end"), *shown, "match")
    return inside.unionByName(points)


def _pieces(store: Store, spans: DataFrame, pivots: DataFrame, config: Config) -> DataFrame:
    """pivot, key, side, source (is it the source's side), n (order), res, begin, end, cut (did a span have several parts).

    Only pairs whose spans are all tiled by one side, and whose parts all have a counterpart on every side.
    """
    translating = isinstance(config, TranslateConfig)
    seg = sides(store, pivots)
    seg = settled((seg.filter("complex") if translating else seg).drop("complex"))  # read four times
    parts = (_whole if translating else _cut)(spans.select("res", "begin", "end", "key", "pos"), seg)
    if config.side is not None:
        parts = parts.filter(F.col("side") == config.side)
    # Tiled: each part begins where the one before ends, from the span's begin to its end.
    span = Window.partitionBy("pivot", "side", "key", "pos").orderBy("seq")
    point = F.col("span_begin") == F.col("span_end")
    follows = F.col("begin") == F.coalesce(F.lag("end").over(span), F.col("span_begin"))
    closed = F.lead("end").over(span).isNotNull() | (F.col("end") == F.col("span_end"))
    parts = settled(parts).withColumns({"ok": (point & F.lit(translating)) | (follows & closed), "several": F.lag("end").over(span).isNotNull()})
    covered = parts.groupBy("pivot", "key", "side").agg(F.bool_and("ok").alias("ok"), F.count_distinct("pos").alias("n_spans"), F.bool_or("several").alias("cut"), F.count("*").alias("n_parts"))
    wanted = spans.groupBy("key").agg(F.count("*").alias("n_spans"))
    fit = covered.filter("ok").join(wanted, ["key", "n_spans"])
    chosen = fit.groupBy("pivot", "key").agg(F.min_by(F.struct("side", "cut", "n_parts"), "side").alias("c")).select("pivot", "key", "c.*")
    n = F.row_number().over(Window.partitionBy("pivot", "key").orderBy("pos", "seq")) - 1
    own = parts.join(chosen, ["pivot", "key", "side"]).withColumn("n", n).withColumnRenamed("side", "source_side")
    other = seg.select("pivot", "seq", "side", F.col("res").alias("o_res"), F.col("begin").alias("o_begin"), F.col("end").alias("o_end"))
    both = own.join(other, ["pivot", "seq"])
    source = F.col("side") == F.col("source_side")
    low = F.when(F.col("match") == "part", F.col("o_begin") + F.col("low")).when(F.col("match") == "end", F.col("o_end")).otherwise(F.col("o_begin"))
    high = F.when(F.col("match") == "part", F.col("o_begin") + F.col("high")).when(F.col("match") == "begin", F.col("o_begin")).otherwise(F.col("o_end"))
    both = both.filter(source | (high <= F.col("o_end")))
    rows = both.select("pivot", "key", "side", source.alias("source"), "n", F.when(source, F.col("res")).otherwise(F.col("o_res")).alias("res"), F.when(source, F.col("begin")).otherwise(low).alias("begin"), F.when(source, F.col("end")).otherwise(high).alias("end"), "cut", "n_parts")
    n_sides = seg.select("pivot", "side").distinct().groupBy("pivot").agg(F.count("*").alias("n_sides"))
    whole = rows.groupBy("pivot", "key").agg(F.count("*").alias("_n"), F.first("n_parts").alias("_parts")).join(n_sides, "pivot").filter("_n = _parts * n_sides and n_sides > 1").select("pivot", "key")
    return rows.join(whole, ["pivot", "key"], "left_semi").drop("n_parts")


def _joined(pieces: DataFrame) -> DataFrame:
    """Parts that are adjacent on the source's side joined to one on every side; nothing counts as cut any more."""
    w = Window.partitionBy("pivot", "key").orderBy("n")
    own = pieces.filter("source and cut")
    new = (F.col("begin") != F.coalesce(F.lag("end").over(w), F.lit(-1))).cast("int")
    runs = own.withColumn("_new", new).withColumn("run", F.sum("_new").over(w)).select("pivot", "key", "n", "run")
    placed = pieces.join(runs, ["pivot", "key", "n"], "left").withColumn("run", F.coalesce("run", "n"))
    ends = [F.min_by("begin", "n").alias("first"), F.max_by("end", "n").alias("last")]
    out = placed.groupBy("pivot", "key", "side", "source", "res", "run").agg(F.min("n").alias("n"), *ends)
    return out.select("pivot", "key", "side", "source", "n", "res", F.least("first", "last").alias("begin"), F.greatest("first", "last").alias("end"), F.lit(False).alias("cut"))


def _leaf(kind: str, resource: Column | None = None, annotation: Column | None = None, begin: str | None = None, end: str | None = None) -> Column:
    none = F.lit(None)
    text = lambda c: (none if c is None else c).cast("string")
    number = lambda c: (none if c is None else F.col(c)).cast("int")
    return F.struct(F.lit(kind).alias("kind"), text(resource).alias("resource"), text(annotation).alias("annotation"), none.cast("string").alias("dataset"), none.cast("string").alias("key"), none.cast("string").alias("data"), number(begin).alias("begin"), number(end).alias("end"), F.lit("BeginBegin" if begin else None).cast("string").alias("mode"))


def _pairs(store: Store, spans: DataFrame, names: DataFrame, pivots: DataFrame, config: Config, joining: bool) -> DataFrame:
    """pivot, key, its names and data, cut, n_parts and sides: an array of side, source and targets, in order."""
    pieces = _pieces(store, spans, pivots, config)
    if joining:
        pieces = _joined(settled(pieces))
    text = store.resources.select("res", F.coalesce("id", F.concat(F.lit("!R"), F.col("res").cast("string"))).alias("_rid"))
    leaf = _leaf(TEXT, F.col("_rid"), begin="begin", end="end")
    ordered = lambda fields: F.array_sort(F.collect_list(F.struct(*fields)))
    per_side = pieces.join(text, "res").withColumn("leaf", leaf).groupBy("pivot", "key", "side", "source").agg(ordered(["n", "leaf"]).alias("leaves"), F.bool_or("cut").alias("cut"))
    per_side = per_side.withColumn("leaves", F.col("leaves.leaf"))
    pairs = per_side.groupBy("pivot", "key").agg(ordered(["side", "source", "leaves"]).alias("sides"), F.bool_or("cut").alias("cut"))
    pid = store.annotations.select(F.col("a").alias("pivot"), F.coalesce("id", F.concat(F.lit("!A"), F.col("a").cast("string"))).alias("pid"))
    return pairs.join(names, "key").join(pid, "pivot").withColumn("n_parts", F.size(F.expr("filter(sides, x -> x.source)[0].leaves")))


def _named(template: str, side: Column | None = None) -> Column:
    out = F.replace(F.replace(F.lit(template), F.lit("{source}"), F.col("name")), F.lit("{pivot}"), F.col("pid"))
    return out if side is None else F.replace(out, F.lit("{side}"), side.cast("string"))


_DATA = f"array<struct<id: string, set: string, key: string, value: {VALUE}>>"


def _mark(config: Config, key: str) -> Column:
    return F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit(config.vocabulary).alias("set"), F.lit(key).alias("key"), value("Null").alias("value"))).cast(_DATA)


def _built(pairs: DataFrame, config: Config) -> DataFrame:
    """The builders of pairs, with pivot and key."""
    simple = F.lit(config.allow_simple and not config.no_pivot) & (F.col("n_parts") == 1)
    pivot_id = _named(config.pivot_id)
    directional = lambda ts: F.when(F.size(ts) > 1, F.lit(DIRECTIONAL)).cast("string")

    def row(df: DataFrame, id: Column, targets: Column, data: Column) -> DataFrame:
        return df.select("pivot", "key", id.alias("id"), directional(targets).alias("complex"), targets.alias("targets"), data.alias("data"))

    out = row(pairs.filter(simple), pivot_id, F.flatten("sides.leaves"), _mark(config, config.pivot_key))
    rest = pairs.filter(~simple)
    # The source is referred to by its own id, or by that of a copy.
    copied = F.col("cut") | ~F.col("existing")
    source_name = F.when(copied, _named(config.source_id)).otherwise(F.col("name"))
    target_name = _named(config.target_id, F.col("side"))
    for i, given in reversed(list(enumerate(config.target_ids))):
        target_name = F.when(F.col("nth") == i, _named(given, F.col("side"))).otherwise(target_name)
    sided = rest.select("*", F.posexplode("sides").alias("at", "s")).select("*", F.col("s.side").alias("side"), F.col("s.source").alias("source"), F.col("s.leaves").alias("leaves"))
    # A place among the sides without the source.
    before = F.exists("sides", lambda x: x["source"] & (x["side"] < F.col("side")))
    sided = sided.withColumn("nth", F.col("at") - before.cast("int"))
    sided = sided.withColumn("sid", F.when(F.col("source"), source_name).otherwise(target_name))
    out = out.unionByName(row(sided.filter(~F.col("source") | copied), F.col("sid"), F.col("leaves"), F.col("own").cast(_DATA)))
    if not config.no_resegmentation:
        linked = rest.filter(F.col("cut") & F.col("existing"))
        two = F.array(_leaf(ANNOTATION, annotation=F.col("name")), _leaf(ANNOTATION, annotation=_named(config.source_id)))
        out = out.unionByName(row(linked, _named(config.resegmentation_id), two, _mark(config, "Resegmentation")))
    if not config.no_pivot:
        members = sided.withColumn("leaf", _leaf(ANNOTATION, annotation=F.col("sid"))).groupBy("pivot", "key", "name", "pid").agg(F.array_sort(F.collect_list(F.struct("side", "leaf"))).alias("m"))
        out = out.unionByName(row(members, pivot_id, F.col("m.leaf"), _mark(config, config.pivot_key)))
    return out


def _sources(store: Store, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of annotations with text in one resource, in textual order, and the annotations' names and data."""
    spans = store.spans().join(annotations.select("a").distinct(), "a", "left_semi").select(F.col("a").alias("key"), "res", "begin", "end").distinct()
    one = spans.groupBy("key").agg(F.count_distinct("res").alias("_n")).filter("_n = 1")
    pos = F.row_number().over(Window.partitionBy("key").orderBy("begin", "end")) - 1
    data = store.annotation_data.join(annotations.select("a").distinct(), "a", "left_semi").join(store.named_data(), ["set", "data"])
    item = F.struct("pos", F.struct("id", F.col("set_id").alias("set"), F.col("key_id").alias("key"), "value").alias("d"))
    own = data.groupBy("a").agg(F.sort_array(F.collect_list(item)).alias("own")).select("a", F.col("own.d").alias("own"))
    names = store.annotations.join(annotations.select("a").distinct(), "a", "left_semi").join(own, "a", "left")
    names = names.select(F.col("a").alias("key"), F.coalesce("id", F.concat(F.lit("A"), F.col("a").cast("string"))).alias("name"), F.col("id").isNotNull().alias("existing"), F.coalesce(F.col("own"), F.array().cast(_DATA)).alias("own"))
    return spans.join(one, "key", "left_semi").withColumn("pos", pos), names


def _mapped(store: Store, spans: DataFrame, names: DataFrame, pivots: DataFrame, config: Config) -> DataFrame:
    joining = isinstance(config, TranslateConfig) and (config.allow_simple or config.no_resegmentation)
    return _built(settled(_pairs(store, spans, names, pivots, config, joining)), config)  # every kind of builder reads the pairs


def map_annotations(store: Store, annotations: DataFrame, pivots: DataFrame, config: Config) -> DataFrame:
    """Builders, with pivot and key (the mapped annotation), of annotations (a) mapped through pivots (a).

    For `mutations.annotate` take the columns id, complex, targets, data. Annotations on several resources are not mapped.
    """
    return _mapped(store, *_sources(store, annotations), pivots, config)


def map_spans(store: Store, spans: DataFrame, pivots: DataFrame, config: Config) -> DataFrame:
    """The same for sets of spans: key, pos, res, begin, end. They have no id and no data, so the source gets an annotation too."""
    names = spans.select("key").distinct().select("key", F.concat(F.lit("set"), F.col("key").cast("string")).alias("name"), F.lit(False).alias("existing"), F.array().cast(_DATA).alias("own"))
    return _mapped(store, spans, names, pivots, config)


def translate_in_place(store: Store, annotations: DataFrame, pivots: DataFrame, config: TranslateConfig | None = None) -> Store:
    """Annotations turned into simple translations: their target gets the other sides' spans, and they get the translation's data.

    Those with more than one span on the source's side stay as they are; of several pivots that map one, the first is taken.
    """
    config = config or TranslateConfig()
    pairs = _pairs(store, *_sources(store, annotations), pivots, config, True).filter("n_parts = 1")
    first = pairs.groupBy("key").agg(F.min_by("sides", "pivot").alias("sides"))
    rows = settled(first.select(F.col("key").alias("a"), F.lit(DIRECTIONAL).alias("complex"), F.flatten("sides.leaves").alias("targets")))
    mark = rows.select("a", F.explode(_mark(config, config.pivot_key)).alias("d")).select("a", F.col("d.set").alias("set_id"), F.col("d.id").alias("id"), F.col("d.key").alias("key_id"), F.col("d.value").alias("value"))
    return mutations.reannotate_all(store, mark, False, rows)
