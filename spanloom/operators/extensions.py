"""Transposition, translation and text validation.

A pivot is an annotation that aligns sides: directional targets are text spans (a simple pivot, each a side of one
segment) or annotations (a complex one, each a side whose spans are its segments in order). `sides` gives the segments of
all pivots as one table; mapping many selections through many pivots is then a join on resource and overlap, a join on
pivot and segment number to the other sides, and arithmetic.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanloom.functions.values import display
from spanloom.model import Store, settled
from spanloom.operators import traversals
from spanloom.operators.narrowing import narrowed
from spanloom.operators.related import join_related

#: Texts shorter than this are stored as they are by protect(..., "auto"), others by their checksum.
SHORT = 40
VALIDATION = "text-validation"


def sides(store: Store, pivots: DataFrame) -> DataFrame:
    """pivot, side, seq, res, begin, end of pivots (a), and whether the side is an annotation (complex)."""
    own = store.targets.join(pivots.select("a").distinct(), "a", "left_semi")
    simple = own.filter("target_a is null and begin is not null").select(F.col("a").alias("pivot"), F.col("pos").alias("side"), F.lit(0).alias("seq"), "res", "begin", "end", F.lit(False).alias("complex"))
    members = own.filter("target_a is not null").select(F.col("a").alias("pivot"), F.col("pos").alias("side"), F.col("target_a").alias("a"))
    complex_ = members.join(store.spans(), "a").select("pivot", "side", F.col("pos").alias("seq"), "res", "begin", "end", F.lit(True).alias("complex"))
    return simple.unionByName(complex_)


def transpose(store: Store, spans: DataFrame, pivots: DataFrame) -> DataFrame:
    """Spans (key, pos, res, begin, end) mapped to the other sides of pivots.

    Gives pivot, key, side (of the result), source_side, pos, seq, res, begin, end. A span is cut where segments end. A key is only
    mapped by a side that covers all of its spans.
    """
    seg = sides(store, pivots).select("res", "begin", "end", "pivot", "side", "seq")
    cut = join_related(spans.select("res", "begin", "end", "key", "pos"), seg, "overlaps")
    begin, end = F.greatest("begin", "r_begin"), F.least("end", "r_end")
    parts = cut.select("key", "pos", F.col("r_pivot").alias("pivot"), F.col("r_side").alias("source_side"), F.col("r_seq").alias("seq"), (begin - F.col("r_begin")).alias("low"), (end - F.col("r_begin")).alias("high"))
    wanted = spans.groupBy("key").agg(F.sum(F.col("end") - F.col("begin")).alias("wanted"))
    covered = parts.groupBy("pivot", "source_side", "key").agg(F.sum(F.col("high") - F.col("low")).alias("covered"))
    whole = covered.join(wanted, "key").filter("covered = wanted").select("pivot", "source_side", "key")
    other = seg.select("pivot", "side", "seq", "res", F.col("begin").alias("base"), F.col("end").alias("top"))
    mapped = parts.join(whole, ["pivot", "source_side", "key"], "left_semi").join(other, ["pivot", "seq"]).filter("side <> source_side")
    out = mapped.select("pivot", "key", "side", "source_side", "pos", "seq", "res", (F.col("base") + F.col("low")).alias("begin"), (F.col("base") + F.col("high")).alias("end"), "top")
    return out.filter("end <= top").drop("top")


def translate(store: Store, spans: DataFrame, pivots: DataFrame, merge: bool = False) -> DataFrame:
    """Spans mapped segment-wise to the other sides of complex pivots: pivot, key, side, source_side, pos, seq, res, begin, end.

    A span has to be tiled by whole segments of one side; segments of no width count at its begin or end. merge: adjacent
    segments of the result are joined to one.
    """
    seg = sides(store, pivots).filter("complex").drop("complex")
    inside = join_related(spans.select("res", "begin", "end", "key", "pos"), seg.select("res", "begin", "end", "pivot", "side", "seq"), "embeds")
    parts = inside.select("key", "pos", F.col("r_pivot").alias("pivot"), F.col("r_side").alias("source_side"), F.col("r_seq").alias("seq"), (F.col("r_end") - F.col("r_begin")).alias("width"))
    wanted = spans.groupBy("key").agg(F.sum(F.col("end") - F.col("begin")).alias("wanted"))
    covered = parts.groupBy("pivot", "source_side", "key").agg(F.sum("width").alias("covered"))
    whole = covered.join(wanted, "key").filter("covered = wanted")
    mapped = parts.join(whole.select("pivot", "source_side", "key"), ["pivot", "source_side", "key"], "left_semi").join(seg, ["pivot", "seq"]).filter("side <> source_side")
    out = mapped.select("pivot", "key", "side", "source_side", "pos", "seq", "res", "begin", "end")
    return merged(out, ["pivot", "key", "side", "source_side", "pos", "res"]) if merge else out


def merged(spans: DataFrame, group: list[str]) -> DataFrame:
    """Adjacent spans of a group joined to one: gaps and islands. seq is the first one's, if there is one."""
    w = Window.partitionBy(*group).orderBy("begin", "end")
    # A new island begins where a span doesn't touch what is before it.
    new = F.col("begin") > F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    marked = spans.withColumn("_new", new.cast("int")).withColumn("_island", F.sum("_new").over(w))
    more = [F.min("seq").alias("seq")] if "seq" in spans.columns else []
    out = marked.groupBy(*group, "_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), *more)
    return out.select([c for c in spans.columns])


def checksums(store: Store, annotations: DataFrame, delimiter: str = "") -> DataFrame:
    """a, text, checksum: SHA-1 of the joined text of annotations."""
    return traversals.annotation_text(store, annotations, delimiter).withColumn("checksum", F.sha1(F.encode("text", "utf-8")))


def protect(store: Store, annotations: DataFrame, mode: str = "auto", vocabulary: str = VALIDATION, delimiter: str = "") -> DataFrame:
    """Data to add to annotations so that their text can be validated: a, set_id, key_id, value (a string).

    mode: text, checksum or auto (short texts as text).
    """
    found = checksums(store, annotations, delimiter)
    as_text = {"text": F.lit(True), "checksum": F.lit(False), "auto": F.length("text") < SHORT}[mode]
    out = found.select("a", F.lit(vocabulary).alias("set_id"), F.when(as_text, F.lit("text")).otherwise(F.lit("checksum")).alias("key_id"), F.when(as_text, F.col("text")).otherwise(F.col("checksum")).alias("value"))
    if delimiter:
        out = out.unionByName(found.select("a", F.lit(vocabulary).alias("set_id"), F.lit("delimiter").alias("key_id"), F.lit(delimiter).alias("value")))
    return out


def validation_info(store: Store, vocabulary: str = VALIDATION) -> DataFrame:
    """a, text, checksum, delimiter as stored on annotations."""
    data = store.named_data().filter(F.col("set_id") == vocabulary).select("set", "data", "key_id", F.col("value.s").alias("s"))
    rows = store.annotation_data.join(data, ["set", "data"])
    one = lambda k: F.max(F.when(F.col("key_id") == k, F.col("s"))).alias(k)
    return rows.groupBy("a").agg(one("text"), one("checksum"), one("delimiter"))


def validate(store: Store, annotations: DataFrame, vocabulary: str = VALIDATION) -> DataFrame:
    """a, valid: true, false, or null for annotations without validation data."""
    info = validation_info(store, vocabulary).withColumnsRenamed({"text": "_text", "checksum": "_sum"})
    spans = traversals.selection_text(store, traversals.annotation_selections(store, annotations)).select("a", "pos", "text")
    parts = spans.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("parts"))
    joined = annotations.select("a").distinct().join(parts, "a", "left").join(info, "a", "left")
    text = F.call_function("array_join", F.col("parts"), F.coalesce("delimiter", F.lit("")))
    valid = F.when(F.col("_text").isNotNull(), text == F.col("_text")).when(F.col("_sum").isNotNull(), F.sha1(F.encode(text, "utf-8")) == F.col("_sum"))
    return joined.select("a", valid.alias("valid"))


def validation_counts(store: Store, annotations: DataFrame, vocabulary: str = VALIDATION) -> DataFrame:
    """valid, invalid, missing."""
    v = F.col("valid")
    return validate(store, annotations, vocabulary).agg(F.count_if(v).alias("valid"), F.count_if(~v).alias("invalid"), F.count_if(v.isNull()).alias("missing"))


def validation_ok(store: Store, annotations: DataFrame, vocabulary: str = VALIDATION) -> DataFrame:
    """ok: nothing is invalid and nothing is missing; ok_maybe_incomplete: nothing is invalid."""
    return validation_counts(store, annotations, vocabulary).select(((F.col("invalid") == 0) & (F.col("missing") == 0)).alias("ok"), (F.col("invalid") == 0).alias("ok_maybe_incomplete"))


def is_iri(c: Column) -> Column:
    return c.rlike(r"^(?:https?|file|urn|_):") & ~c.rlike(r"[\s<>\"{}|\\^`]")


def into_iri(c: Column, prefix: str) -> Column:
    clean = F.regexp_replace(c, r"[\s<>\"{}|\\^`]", "-")
    joiner = "" if prefix.endswith(("/", "#", ":", "?")) else "/"
    return F.when(is_iri(c), c).otherwise(F.concat(F.lit(prefix + joiner), clean))


# Keys of the Web Annotation vocabulary that belong to the annotation itself and not to its body.
ANNO = "http://www.w3.org/ns/anno/"
ON_ANNOTATION = ("generated", "generator", "motivation", "created", "creator")
CONTEXT = "http://www.w3.org/ns/anno.jsonld"


#: Namespaces and contexts that one output takes; all of them stand in each annotation's context.
MOST_NAMES = 1000


def auto_contexts(store: Store) -> list[str]:
    """The ids of sets that are IRIs of JSON-LD contexts, in their order: names of sets only."""
    named = F.col("id").endswith(".jsonld") | F.col("id").endswith(".json")
    return _few(store.datasets.filter(named & is_iri(F.col("id"))).select("id").distinct().orderBy("id"))


def namespaces_of(store: Store, least: int = 2, set_prefix: str = "urn:set:") -> dict[str, str]:
    """By URI a short name for each namespace of keys: what stands before the last / or # of at least `least` of their IRIs. Found in one pass over the keys."""
    keys = store.keys.join(store.datasets.select("set", F.col("id").alias("set_id")), "set").select(_predicate(F.col("set_id"), F.col("id"), set_prefix).alias("iri")).distinct()
    uri = F.regexp_extract("iri", "^(.*[/#])[^/#]+$", 1)
    found = keys.select(uri.alias("uri")).filter("uri != ''").groupBy("uri").count().filter(F.col("count") >= least).select("uri").orderBy("uri")
    return {u: f"ns{i}" for i, u in enumerate(_few(found))}


def _few(names: DataFrame) -> list[str]:
    rows = names.limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} contexts or namespaces: pass those that are wanted")
    return [r[0] for r in rows]


def _predicate(set_id: Column, key_id: Column, set_prefix: str) -> Column:
    """The IRI of a key: its own, or what it is called in its set."""
    return F.when(is_iri(key_id), key_id).otherwise(F.concat(into_iri(set_id, set_prefix), F.lit("/"), key_id))


def compacted(iri: Column, namespaces: dict[str, str]) -> Column:
    """iri with the short name of the longest namespace that it begins with; as it is, if there is none."""
    out = iri
    for uri, name in sorted(namespaces.items(), key=lambda x: len(x[0])):
        out = F.when(iri.startswith(uri), F.concat(F.lit(f"{name}:"), F.substr(iri, F.lit(len(uri) + 1)))).otherwise(out)
    return out


def value_alias(shown: Column, contexts: list[str]) -> Column:
    """What stands behind the first of contexts, and / or #, that an IRI begins with; null if there is none."""
    hits = [F.when(shown.startswith(f"{c}/") | shown.startswith(f"{c}#"), F.substr(shown, F.lit(len(c) + 2))) for c in contexts]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def context_json(contexts: list[str], namespaces: dict[str, str]) -> str:
    """The value of @context: one IRI, or a list of IRIs with a table of namespaces behind them."""
    if not contexts and not namespaces:
        return json.dumps(CONTEXT)
    extra = [c for c in contexts if c != CONTEXT]
    table = [{name: uri for uri, name in namespaces.items()}] if namespaces else []
    return json.dumps([CONTEXT, *extra, *table], separators=(",", ":"), ensure_ascii=False)


def untagged(c: str) -> Column:
    """A column of lists and maps in tagged JSON as plain JSON, at any depth."""

    def plain(tagged: pd.Series) -> pd.Series:
        return tagged.map(lambda t: None if t is None else json.dumps(_bare(json.loads(t)), separators=(",", ":"), ensure_ascii=False))

    return F.pandas_udf(plain, StringType())(c)


def _bare(x):
    if isinstance(x, list):
        return [_bare(y) for y in x]
    if not isinstance(x, dict):
        return x
    if isinstance(x.get("@type"), str):  # an item; a map's entries are items
        return _bare(x.get("value"))
    return {k: _bare(y) for k, y in x.items()}


def web_annotations(store: Store, annotations: DataFrame, prefix: str = "urn:annotation:", resource_prefix: str = "urn:resource:", set_prefix: str = "urn:set:", contexts: list[str] | None = None, namespaces: dict[str, str] | None = None, skip_context: bool = False) -> DataFrame:
    """a, json: one line of JSON-LD per annotation. Annotations that are about keys or data only have none.

    contexts: further JSON-LD contexts; keys of sets with such an id are written as they are, and values that are IRIs below one by what follows it. namespaces: short names by URI,
    for the IRIs of keys. Both see auto_contexts and namespaces_of. Keys are compacted once each, not for each annotation.
    Of the store's tables only rows of the asked annotations, and few others, are moved.
    """
    annotations = settled(annotations)
    count, own_a = annotations.count(), annotations.select("a")
    contexts, namespaces = contexts or [], namespaces or {}
    keys = store.keys.join(store.datasets.select("set", F.col("id").alias("set_id")), "set").select("set", "key", "set_id", F.col("id").alias("key_id"))
    own = (F.col("set_id") == ANNO) & F.col("key_id").isin(*ON_ANNOTATION)
    bare = own | F.col("set_id").isin(*contexts) & ~is_iri(F.col("key_id")) if contexts else own
    full = _predicate(F.col("set_id"), F.col("key_id"), set_prefix)
    keys = keys.select("set", "key", F.coalesce(own, F.lit(False)).alias("top"), F.when(bare, F.lit(False)).otherwise(is_iri(full)).alias("global"), F.when(bare, F.col("key_id")).otherwise(compacted(full, namespaces)).alias("predicate"))
    data = store.data.join(keys, ["set", "key"]).select("set", "data", "top", "global", "predicate", display(F.col("value")).alias("shown"), "value")
    inside = F.col("value.vtype").isin("List", "Map")  # each different one is rewritten once; other data see no Python
    nested = data.filter(inside).withColumn("nested", untagged("value.j"))
    data = data.filter(~inside).withColumn("nested", F.lit(None).cast("string")).unionByName(nested)
    rows = narrowed(store.annotation_data, own_a, ["a"], count).join(own_a, "a", "left_semi").join(data, ["set", "data"])
    top, shown = F.col("top"), F.col("shown")
    alias = F.when(F.col("value.vtype") == "String", value_alias(shown, contexts))
    linked = (F.col("value.vtype") == "String") & is_iri(shown) & F.col("global")
    plain = F.when(F.col("value.vtype").isin("Int", "Float", "Bool", "Null"), shown).otherwise(_json_string(shown))
    raw = F.when(F.col("nested").isNotNull(), F.col("nested")).when(alias.isNotNull() & is_iri(shown), _json_string(alias)).when(linked, F.concat(F.lit('{"id":'), _json_string(shown), F.lit("}"))).otherwise(plain)
    member = F.concat(_json_string(F.col("predicate")), F.lit(":"), raw)
    ordered = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", member.alias("m"))))), lambda x: x["m"]), ",")
    parts = rows.groupBy("a").agg(ordered(top).alias("tops"), ordered(~top).alias("bodies"))
    t = settled(narrowed(store.targets, own_a, ["a"], count).join(own_a, "a", "left_semi"))
    about = t.filter(F.col("target_a").isNotNull()).select(F.col("target_a").alias("a"))
    t = t.join(store.resources.select("res", F.col("id").alias("rid")), "res", "left")
    t = t.join(narrowed(store.annotations, about, ["a"], about.count()).select(F.col("a").alias("target_a"), F.coalesce("id", F.concat(F.lit("!A"), F.col("a").cast("string"))).alias("tid")), "target_a", "left")
    t = t.join(store.datasets.select("set", F.col("id").alias("sid")), "set", "left")
    source = _json_string(into_iri(F.col("rid"), resource_prefix))
    position = F.format_string('{"source":%s,"selector":{"type":"TextPositionSelector","start":%s,"end":%s}}', source, F.col("begin").cast("string"), F.col("end").cast("string"))
    target = F.when(F.col("begin").isNotNull(), position).when(F.col("target_a").isNotNull(), F.format_string('{"id":%s,"type":"Annotation"}', _json_string(into_iri(F.col("tid"), prefix)))).when(F.col("kind") == "ResourceSelector", F.format_string('{"id":%s,"type":"Text"}', source)).when(F.col("kind") == "DataSetSelector", F.format_string('{"id":%s,"type":"Dataset"}', _json_string(into_iri(F.col("sid"), set_prefix))))
    targets = t.withColumn("_t", target).filter("_t is not null").groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]).alias("ts"))
    joined = annotations.join(targets, "a").join(parts, "a", "left").join(narrowed(store.annotations, own_a, ["a"], count).select("a", F.col("complex").alias("_complex")), "a")
    kind = F.when(F.col("_complex") == "DirectionalSelector", F.lit("List")).when(F.col("_complex") == "CompositeSelector", F.lit("Composite")).otherwise(F.lit("Independents"))
    shown = F.when(F.size("ts") == 1, F.get("ts", F.lit(0))).when(F.col("_complex") == "MultiSelector", F.concat(F.lit("["), F.array_join("ts", ","), F.lit("]"))).otherwise(F.concat(F.format_string('{"type":"%s","items":[', kind), F.array_join("ts", ","), F.lit("]}")))
    name = F.coalesce("id", F.concat(F.lit("!A"), F.col("a").cast("string")))
    opening = "{" if skip_context else '{"@context":' + context_json(contexts, namespaces) + ","
    line = F.concat(F.lit(opening + '"id":'), _json_string(into_iri(name, prefix)), F.lit(',"type":"Annotation"'), F.when(F.col("tops") != "", F.concat(F.lit(","), F.col("tops"))).otherwise(F.lit("")), F.when(F.col("bodies") != "", F.concat(F.lit(',"body":{"type":"Dataset",'), F.col("bodies"), F.lit("}"))).otherwise(F.lit("")), F.lit(',"target":'), shown, F.lit("}"))
    return joined.select("a", line.alias("json"))


def _json_string(c: Column) -> Column:
    """c as a JSON string."""
    whole = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v")))  # {"v":"..."}
    return F.substr(whole, F.lit(6), F.length(whole) - 6)
