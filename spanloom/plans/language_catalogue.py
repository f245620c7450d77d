"""Queries of the language with siblings, unions on several variables and variables from outside, and of relations without pairs. Importing this module registers them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from spanloom.functions import text as texts
from spanloom.functions import values
from spanloom.functions.spans import Relation
from spanloom.model import value
from spanloom.operators import alignment, extensions, related, scans, traversals
from spanloom.plans import compiler, derive, results
from spanloom.plans.catalogue import register
from spanloom.plans.graph_catalogue import on_graph
from spanloom.plans.query import Constraint, Query, parse, text_of

_TOXIC = "(SELECT a FROM g_ad WHERE \"set\" = 1 AND data = 2000001)"
_GERMAN = "(SELECT a FROM g_ad WHERE \"set\" = 0 AND data = 1000000 + 100 * 256 + 101)"

_SIBLINGS = """SELECT ANNOTATION ?x WHERE DATA labels toxic = 1; {
  SELECT ANNOTATION ?y WHERE ANNOTATION AS TARGET ?x; | SELECT ANNOTATION ?z WHERE ANNOTATION AS METADATA ?x; | SELECT RESOURCE ?r WHERE ANNOTATION ?x; { SELECT ANNOTATION ?m WHERE RESOURCE AS METADATA ?r; } }"""


@on_graph("lang_siblings", f"""SELECT a AS x, target_a AS y, NULL AS z, NULL AS r, NULL AS m FROM g_t WHERE target_a IS NOT NULL AND a IN {_TOXIC}
  UNION ALL SELECT target_a, NULL, a, NULL, NULL FROM g_t WHERE target_a IN {_TOXIC}
  UNION ALL SELECT DISTINCT s.a, NULL, NULL, s.res, m.a FROM g_sp s JOIN g_t m ON m.res = s.res AND m.kind = 'ResourceSelector' WHERE s.a IN {_TOXIC}""")  # fmt: skip
def siblings(g):
    """Each sibling's rows have values in the columns of its own variables."""
    return compiler.run(g, _SIBLINGS).select(*[F.col(f"{v}_{h}").alias(v) for v, h in (("x", "a"), ("y", "a"), ("z", "a"), ("r", "res"), ("m", "a"))])


_BOTH = "SELECT ANNOTATION ?x WHERE DATA meta lang = de; { SELECT RESOURCE ?r WHERE ANNOTATION ?x; { SELECT ANNOTATION ?y WHERE [ ANNOTATION AS METADATA ?x OR RESOURCE AS METADATA ?r ]; } }"


@on_graph("lang_union_variables", f"""SELECT DISTINCT x.a AS x, x.res AS r, y.a AS y FROM g_sp x JOIN g_t y ON y.target_a = x.a OR y.kind = 'ResourceSelector' AND y.res = x.res WHERE x.a IN {_GERMAN}""")
def union_variables(g):
    """A union whose parts are on different variables."""
    return compiler.run(g, _BOTH).select(F.col("x_a").alias("x"), F.col("r_res").alias("r"), F.col("y_a").alias("y"))


@on_graph("lang_key_value_variable", """SELECT DISTINCT d."set", d."key", u.a FROM g_d d JOIN g_ad u ON u."set" = d."set" AND u.data = d.data WHERE d."set" = 1 AND d.i >= 1""")
def key_value_variable(g):
    """Annotations by a key that is a variable and a test of the value."""
    rows = compiler.run(g, "SELECT KEY ?k WHERE DATASET labels; { SELECT ANNOTATION ?x WHERE DATA ?k >= 1; }")
    return rows.select(F.col("k_set").alias("set"), F.col("k_key").alias("key"), F.col("x_a").alias("a"))


@on_graph("lang_substore_variable", "SELECT item AS res, a FROM g_sm JOIN g_t ON g_t.res = item AND kind = 'ResourceSelector' WHERE ss = 1")
def substore_variable(g):
    """Resources of a substore that comes from outside, with their metadata."""
    outside = {"s": ("SUBSTORE", scans.lookup(g, "substores", "second").select("ss"))}
    rows = compiler.run(g, "SELECT RESOURCE ?r WHERE SUBSTORE ?s; { SELECT ANNOTATION ?m WHERE RESOURCE AS METADATA ?r; }", outside)
    return rows.select(F.col("r_res").alias("res"), F.col("m_a").alias("a"))


@on_graph("lang_bindings", f"""SELECT a AS x, 'ANNOTATION' AS type, target_a AS item FROM g_t WHERE target_a IS NOT NULL AND a IN {_TOXIC}
  UNION ALL SELECT target_a, 'ANNOTATION', a FROM g_t WHERE target_a IN {_TOXIC}
  UNION ALL SELECT DISTINCT s.a, 'ANNOTATION', m.a FROM g_sp s JOIN g_t m ON m.res = s.res AND m.kind = 'ResourceSelector' WHERE s.a IN {_TOXIC}""")  # fmt: skip
def bindings(g):
    """The last item of each row with its type, whatever sibling it is of."""
    rows = compiler.bindings(g, _SIBLINGS)
    last = compiler.bound_to(rows, last=True)
    return rows.select(F.col("x.a").alias("x"), last["type"].alias("type"), last["a"].alias("item"))


@on_graph("lang_bound_context", f"""SELECT DISTINCT s.res FROM g_sp s WHERE s.a IN (SELECT target_a FROM g_t WHERE target_a IS NOT NULL AND a IN {_TOXIC})""")
def bound_context(g):
    """Items of one query as a variable of the next."""
    known = compiler.from_bindings(compiler.bindings(g, _SIBLINGS), "y", "ANNOTATION")
    return compiler.run(g, "SELECT RESOURCE ?r WHERE ANNOTATION ?y;", known).select(F.col("r_res").alias("res"))


@on_graph("lang_precedes", f"""SELECT DISTINCT x.a AS x, y.a AS y FROM g_sp x JOIN g_sp y ON y.res = x.res JOIN g_r r ON r.res = x.res
  WHERE x.a IN {_GERMAN} AND x.a % 16 = 0 AND (x.b <> y.b OR x.e <> y.e) AND (y.b = x.e OR y.b > x.e AND y.b - x.e <= 10 AND trim(substr(r.text, x.e + 1, y.b - x.e), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '')
  AND y.a IN (SELECT a FROM g_ad WHERE "set" = 0)""")  # fmt: skip
def precedes(g):
    """Annotations that follow others, but for blanks."""
    rows = compiler.run(g, "SELECT ANNOTATION ?x WHERE DATA meta lang = de; { SELECT ANNOTATION ?y WHERE RELATION ?x PRECEDES; DATASET meta; }")
    return rows.filter("x_a % 16 = 0").select(F.col("x_a").alias("x"), F.col("y_a").alias("y"))


# --- related spans of a whole side, without pairs ----------------------------------------------------------------------

_SIDES = {
    "before": ("l.e <= w.b", Relation("before")),
    "after": ("l.b >= w.e", Relation("after")),
    "not_overlaps": ("NOT (w.b < l.e AND w.e > l.b)", Relation("overlaps", negate=True)),
    "not_embeds": ("NOT (w.b >= l.b AND w.e <= l.e)", Relation("embeds", negate=True)),
    "not_embedded": ("NOT (l.b >= w.b AND l.e <= w.e)", Relation("embedded", negate=True)),
    "not_before": ("NOT (l.e <= w.b AND w.b - l.e <= 5)", Relation("before", negate=True, limit=5)),
    "not_after": ("NOT (l.b >= w.e)", Relation("after", negate=True)),
    "not_precedes": ("w.b <> l.e", Relation("precedes", negate=True, whitespace=False)),
    "not_samebegin": ("w.b <> l.b", Relation("samebegin", negate=True)),
}
for _name, (_condition, _relation) in _SIDES.items():
    on_graph(f"rel_any_{_name}", f"SELECT DISTINCT w.res, w.ts FROM g_sp l JOIN g_ts w ON w.res = l.res AND l.a % 16 IN (2, 8) AND {_condition} AND (l.b <> w.b OR l.e <> w.e)")(
        lambda g, r=_relation: related.related_text(g, g.spans().filter("a % 16 in (2, 8)"), r).select("res", "ts")
    )


# --- JSON-LD with contexts and namespaces -------------------------------------------------------------------------------

_SITE = "https://example.org"


def _on_the_web(g):
    """The graph with sets and sources that are IRIs: one set is a context, sources are names in it."""
    ids = {"meta": f"{_SITE}/meta.jsonld", "labels": f"{_SITE}/labels"}
    sets = g.datasets.replace(ids, subset=["id"])
    names = F.when((F.col("set") == 0) & (F.col("key") == 1), F.concat(F.lit(f"{_SITE}/meta.jsonld#"), F.col("value.s"))).otherwise(F.col("value.s"))
    return g.with_tables(datasets=sets, data=g.data.withColumn("value", F.col("value").withField("s", names)))


def _shown(g, **options):
    rows = extensions.web_annotations(g, g.annotations.filter("a % 16 = 1"), **options)
    return rows.select("a", F.get_json_object("json", "$['@context']").alias("context"), F.get_json_object("json", "$.body").alias("body"))


@on_graph("ext_web_context", f"""SELECT d * 16 + 1 AS a, '["http://www.w3.org/ns/anno.jsonld",{{"ns0":"{_SITE}/labels/","ns1":"{_SITE}/meta.jsonld/"}}]' AS context,
  '{{"type":"Dataset","ns1:source":{{"id":"{_SITE}/meta.jsonld#' || source || '"}}' || CASE WHEN quality IS NOT NULL THEN ',"ns0:quality":' || quality ELSE '' END || '}}' AS body FROM g_doc WHERE source IS NOT NULL""")  # fmt: skip
def web_context(g):
    """Annotations with the namespaces that their keys have in common."""
    g = _on_the_web(g)
    return _shown(g, namespaces=extensions.namespaces_of(g))


@on_graph("ext_web_alias", f"""SELECT d * 16 + 1 AS a, '["http://www.w3.org/ns/anno.jsonld","{_SITE}/meta.jsonld"]' AS context,
  '{{"type":"Dataset","source":"' || source || '"' || CASE WHEN quality IS NOT NULL THEN ',"{_SITE}/labels/quality":' || quality ELSE '' END || '}}' AS body FROM g_doc WHERE source IS NOT NULL""")  # fmt: skip
def web_alias(g):
    """Keys of a set that is a context are names in it, and so are values below it."""
    g = _on_the_web(g)
    return _shown(g, contexts=extensions.auto_contexts(g))


# --- what items say ------------------------------------------------------------------------------------------------------


@on_graph("lang_result_json", """SELECT '{"@type":"DataKey","@id":"' || id || '"}' AS json FROM g_k WHERE "set" = 1
  UNION ALL SELECT '{"@type":"AnnotationData","@id":"' || d.id || '","key":"' || k.id || '","value":{"@type":"Int","value":' || i || '}}' FROM g_d d JOIN g_k k ON k."set" = d."set" AND k."key" = d."key" WHERE d."set" = 1 AND d.i IS NOT NULL""")  # fmt: skip
def result_json(g):
    """Keys and whole numbers of a set as JSON."""
    text = "SELECT DATASET ?s WHERE ID labels; { SELECT KEY ?k WHERE DATASET ?s; | SELECT DATA ?d WHERE DATASET ?s; VALUE >= 0; }"
    return results.with_json(g, compiler.bindings(g, text), last=True).select("json")


@on_graph("lang_result_text", f"""SELECT DISTINCT s.a, 'RESOURCE' AS type, r.text FROM g_sp s JOIN g_r r ON r.res = s.res WHERE s.a IN {_GERMAN}
  UNION ALL SELECT DISTINCT s.a, 'TEXT', substr(r.text, s.b + 1, s.e - s.b) FROM g_sp s JOIN g_r r ON r.res = s.res WHERE s.a IN {_GERMAN}""")  # fmt: skip
def result_text(g):
    """The different texts of whole resources and of spans, side by side; spans of an annotation that read the same count once."""
    rows = compiler.bindings(g, "SELECT ANNOTATION ?x WHERE DATA meta lang = de; { SELECT RESOURCE ?r WHERE ANNOTATION ?x; | SELECT TEXT ?t WHERE ANNOTATION ?x; }")
    last = compiler.bound_to(rows, last=True)["type"]
    return results.with_text(g, rows, last=True).select(F.col("x.a").alias("a"), last.alias("type"), "text").distinct()


@on_graph("join_first_value", """SELECT u.a, coalesce(s, CAST(i AS VARCHAR), CAST(f AS VARCHAR)) AS shown, s AS text FROM g_ad u JOIN g_d d ON d."set" = u."set" AND d.data = u.data WHERE u.pos = (SELECT min(pos) FROM g_ad v WHERE v.a = u.a)""")
def first_value(g):
    return results.first_values(g, g.annotations).select("a", "shown", "text")


@on_graph("ext_valid_pivots", "SELECT a, complex IS NOT NULL AS valid FROM g_a")
def valid_pivots(g):
    return alignment.valid_pivots(g, g.annotations)


register("text_trim_with", "SELECT a, CAST(b + length(regexp_extract(piece, '^[^a-z]*')) AS BIGINT) AS begin, CAST(CASE WHEN regexp_matches(piece, '[a-z]') THEN e - length(regexp_extract(piece, '[^a-z]*$')) ELSE e END AS BIGINT) AS stop FROM word", word=True)(
    lambda s, d: texts.trim_with(derive.words(s, d).withColumnRenamed("piece", "text"), lambda c: ~c.between("a", "z")).select("a", "begin", F.col("end").alias("stop"))
)


@on_graph("join_substore_nested_members", "SELECT 0 AS ss, item FROM g_sm WHERE item_type = 'resource' UNION ALL SELECT 1, item FROM g_sm WHERE item_type = 'resource' AND ss = 1")
def nested_members(g):
    """Resources of substores and of those in them."""
    return traversals.nested_members(g, g.substores, "resource")


# --- queries as values, variables for collections -----------------------------------------------------------------------


def _built() -> Query:
    """Made by methods, printed and parsed again."""
    inner = Query("SELECT", "ANNOTATION").with_name("y").with_constraint(Constraint("ANNOTATION", "x", qualifier="METADATA"), "role=about")
    toxic = Constraint("DATA", arg=("labels", "toxic"), op=values.either(values.equals(1), values.equals(7)))
    outer = Query("SELECT", "ANNOTATION").with_name("x").with_constraint(toxic).with_subquery(inner).with_attributes("shown")
    return parse(text_of(outer))


@on_graph("lang_built", f"SELECT target_a AS x, a AS y, 'role=about' AS attribute FROM g_t WHERE target_a IN {_TOXIC}")
def built(g):
    """A query that was built and not written, with what its inner constraint is marked with."""
    q = _built()
    marks = [a for path in q.paths() for _, own in q.at(path).constraints_with_attributes() for a in own]
    return compiler.run(g, q).select(F.col("x_a").alias("x"), F.col("y_a").alias("y"), F.lit(marks[0]).alias("attribute"))


def bound(name: str, kind: str, items, text: str, columns: dict[str, str], sql: str) -> None:
    """A query with the variable ?c for many items of a type."""
    on_graph(f"lang_bound_{name}", sql)(lambda g: compiler.run(g, text, compiler.bind("c", kind, items(g))).select(*[F.col(k).alias(x) for k, x in columns.items()]))


def _kind(k: int):
    return lambda g: g.spans().filter(f"a % 16 = {k}").select("a", "res", "begin", "end")


bound("annotations", "ANNOTATION", _kind(0), "SELECT ANNOTATION ?x WHERE ANNOTATION AS METADATA ?c;", {"x_a": "a"}, "SELECT DISTINCT a FROM g_t WHERE target_a % 16 = 0")
bound("data", "DATA", lambda g: g.data.filter("set = 0 and key = 0"), "SELECT ANNOTATION ?x WHERE DATA ?c;", {"x_a": "a"}, "SELECT DISTINCT a FROM g_ad JOIN g_d USING (\"set\", data) WHERE \"set\" = 0 AND \"key\" = 0")
bound("keys", "KEY", lambda g: g.keys.filter("id <> 'score'"), "SELECT DATA ?d WHERE KEY ?c;", {"d_set": "set", "d_data": "data"}, "SELECT \"set\", data FROM g_d WHERE NOT (\"set\" = 1 AND \"key\" = 2)")
bound("resources", "RESOURCE", lambda g: g.resources.filter("textlen >= 10"), "SELECT ANNOTATION ?x WHERE RESOURCE AS METADATA ?c;", {"x_a": "a"}, "SELECT a FROM g_t JOIN g_r USING (res) WHERE kind = 'ResourceSelector' AND textlen >= 10")
bound("texts", "TEXT", _kind(9), "SELECT ANNOTATION ?x WHERE TEXT ?c;", {"x_a": "a"}, "SELECT DISTINCT x.a FROM g_sp x JOIN g_sp c ON c.a % 16 = 9 AND c.res = x.res AND c.b = x.b AND c.e = x.e")
bound("datasets", "DATASET", lambda g: g.datasets, "SELECT KEY ?k WHERE DATASET ?c;", {"k_set": "set", "k_key": "key"}, 'SELECT "set", "key" FROM g_k')
bound("related", "TEXT", _kind(4), "SELECT TEXT ?t WHERE RELATION ?c EMBEDDED;", {"t_res": "res", "t_begin": "begin", "t_end": "end"}, """SELECT DISTINCT t.res, t.b AS begin, t.e AS "end" FROM g_ts t JOIN g_sp c ON c.a % 16 = 4 AND c.res = t.res AND c.b >= t.b AND c.e <= t.e AND (c.b <> t.b OR c.e <> t.e)""")


@on_graph("lang_text_regex", "SELECT DISTINCT a FROM g_sp JOIN g_r USING (res) WHERE regexp_matches(substr(text, CAST(b AS INT) + 1, CAST(e - b AS INT)), '^[A-Z]')")
def text_regex(g):
    return compiler.run(g, 'SELECT ANNOTATION ?x WHERE TEXT AS REGEX "^[A-Z]";').select(F.col("x_a").alias("a"))


@on_graph("lang_text_variable", f"""SELECT DISTINCT x.a AS x, x.res, x.b AS begin, x.e AS "end", y.a AS y FROM g_sp x JOIN g_sp y ON y.res = x.res AND y.b = x.b AND y.e = x.e WHERE x.a IN {_GERMAN}""")
def text_variable(g):
    """Annotations on the same spans as others."""
    rows = compiler.run(g, "SELECT ANNOTATION ?x WHERE DATA meta lang = de; { SELECT TEXT ?t WHERE ANNOTATION ?x; { SELECT ANNOTATION ?y WHERE TEXT ?t; } }")
    return rows.select(F.col("x_a").alias("x"), F.col("t_res").alias("res"), F.col("t_begin").alias("begin"), F.col("t_end").alias("end"), F.col("y_a").alias("y"))


@on_graph("lang_literal_items", """SELECT 'annotation' AS by, a FROM g_t WHERE target_a = 2 * 16 + 2 UNION ALL SELECT DISTINCT 'resource', a FROM g_sp WHERE res = 5
  UNION ALL SELECT DISTINCT 'key', a FROM g_ad JOIN g_d USING ("set", data) WHERE "set" = 1 AND "key" = 1""")  # fmt: skip
def literal_items(g):
    """Annotations by an annotation, a text and a key that are named."""
    asked = {"annotation": "ANNOTATION AS METADATA k2/2", "resource": "RESOURCE doc5", "key": "DATA labels toxic"}
    found = [compiler.run(g, f"SELECT ANNOTATION ?x WHERE {c};").select(F.lit(by).alias("by"), F.col("x_a").alias("a")) for by, c in asked.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


# --- lists and maps in JSON-LD -------------------------------------------------------------------------------------------


@on_graph("ext_web_values", """SELECT d * 16 + 1 AS a, '{"name":"' || source || '","letters":["' || substr(source, 1, 1) || '",[null,true]]}' AS shown FROM g_doc WHERE source IS NOT NULL""")
def web_values(g):
    """Sources as maps with lists in them."""
    tagged = F.format_string('{"name":{"@type":"String","value":"%s"},"letters":{"@type":"List","value":[{"@type":"String","value":"%s"},{"@type":"List","value":[{"@type":"Null"},{"@type":"Bool","value":true}]}]}}', "value.s", F.left("value.s", F.lit(1)))
    is_source = (F.col("set") == 0) & (F.col("key") == 1)
    g = g.with_tables(data=g.data.withColumn("value", F.when(is_source, value("Map", tagged)).otherwise(F.col("value"))))
    rows = extensions.web_annotations(g, g.annotations.filter("a % 16 = 1"))
    return rows.select("a", F.get_json_object("json", "$.body['urn:set:meta/source']").alias("shown")).filter("shown is not null")
