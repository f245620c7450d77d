"""Registry of the engine's queries on the driver's tables, each with the SQL that DuckDB runs beside it.

Names are <section>_<operator>. All run over whole tables and whole texts. Those without SQL say why in NO_SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as texts
from spanloom.functions import values as v
from spanloom.functions.spans import Offset, Relation, intersection, relative
from spanloom.functions.values import display, test
from spanloom.model import settled, value
from spanloom.operators import collections, extensions, filters, mutations, narrowing, related, scans, traversals
from spanloom.plans import compiler, derive
from spanloom.plans.derive import BASE, KIND, LABEL, ORIGIN

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
NO_SQL = {
    "mut_reindex": "handles are numbered by the engine",
}


def register(name: str, sql: str | None = None, line: bool = False, word: bool = False, also: str = ""):
    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            parts = [p for p, on in ((derive.SQL_LINE, line), (derive.SQL_WORD, word), (also, also)) if on]
            _SQL[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql
        return f

    return keep


def _all() -> None:
    """Have the other modules' queries registered too."""
    from spanloom.plans import graph_catalogue, language_catalogue, pattern_catalogue, source_catalogue  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


# --- scans ---------------------------------------------------------------------------------------------------------

register("scan_lines", "SELECT a, res, b AS begin, e AS \"end\" FROM line", line=True)(lambda s, d: derive.lines(s, d).select("a", "res", "begin", "end"))
register("scan_words", "SELECT a, res, b AS begin, e AS \"end\" FROM word", word=True)(lambda s, d: derive.words(s, d).select("a", "res", "begin", "end"))
register("scan_resource_by_id", "SELECT doc_id AS res, length(text) AS textlen FROM documents WHERE 'doc' || doc_id = 'doc7'")(lambda s, d: scans.lookup(derive.metadata(s, d), "resources", "doc7").select("res", "textlen"))
register("scan_annotation_by_temporary_id", f"SELECT a, res, b AS begin, e AS \"end\" FROM line WHERE a = {3 * BASE}", line=True)(lambda s, d: traversals.annotation_selections(c := derive.corpus(s, d), scans.lookup(c, "annotations", f"!A{3 * BASE}")).select("a", "res", "begin", "end"))
_KNOWN = "known AS (SELECT DISTINCT res, b, e FROM (SELECT res, b, e FROM line UNION ALL SELECT res, b, e FROM word))"
register("scan_known_selections", "SELECT res, b AS begin, e AS \"end\" FROM known", True, True, _KNOWN)(lambda s, d: derive.corpus(s, d).textselections.select("res", "begin", "end"))
register("scan_selections_in_range", "SELECT res, b AS begin, e AS \"end\" FROM known WHERE b >= 100 AND b < 200", True, True, _KNOWN)(lambda s, d: scans.selections_in_range(derive.corpus(s, d), 100, 200).select("res", "begin", "end"))
register("scan_positions", "SELECT DISTINCT res, \"at\" FROM (SELECT res, b AS \"at\" FROM known UNION ALL SELECT res, e FROM known)", True, True, _KNOWN)(lambda s, d: scans.positions(derive.corpus(s, d)))
register("scan_selection_by_offset", "SELECT doc_id AS res, length(text) - 9 AS begin, length(text) AS \"end\" FROM documents WHERE doc_id = 5 AND length(text) >= 9")(lambda s, d: scans.selection(derive.metadata(s, d), 5, Offset.parse("-9:-0")).select("res", "begin", "end"))

# --- traversals ----------------------------------------------------------------------------------------------------


@register("flagship_words_in_lines", "SELECT l.a AS line, w.a AS word, w.b AS begin, w.e AS \"end\" FROM line l JOIN word w ON w.res = l.res AND w.b >= l.b AND w.e <= l.e", True, True)
def words_in_lines(s, d):
    """Every line with the words that it embeds: a range join of two annotation layers."""
    lines, words = derive.lines(s, d).drop("piece"), derive.words(s, d).drop("piece")
    return related.join_related(lines, words, "embeds").select(F.col("a").alias("line"), F.col("r_a").alias("word"), F.col("r_begin").alias("begin"), F.col("r_end").alias("end"))


register("join_annotation_text", "SELECT a, piece AS text FROM line", line=True)(lambda s, d: traversals.annotation_text(c := derive.corpus(s, d), derive.lines(s, d)).select("a", "text"))
register("join_resource_annotations", "SELECT res, count(*) AS n FROM (SELECT res FROM line UNION ALL SELECT res FROM word) GROUP BY res", True, True)(lambda s, d: traversals.resource_annotations(c := derive.corpus(s, d), c.resources).groupBy("res").agg(F.count("*").alias("n")))
register("join_resource_metadata", f"SELECT doc_id AS res, doc_id * {BASE} + {LABEL * KIND} AS a FROM labels UNION ALL SELECT doc_id, doc_id * {BASE} + {ORIGIN * KIND} FROM documents")(lambda s, d: traversals.resource_annotations(c := derive.metadata(s, d), c.resources, metadata=True))
register("join_data_annotations", f"SELECT doc_id * {BASE} + {LABEL * KIND} AS a FROM labels WHERE toxic = 1")(lambda s, d: traversals.data_annotations(c := derive.metadata(s, d), traversals.find_data(c, "corpus", "toxic", v.equals(1))).select("a"))
register("join_data_resources", "SELECT doc_id AS res FROM labels WHERE quality = 0")(lambda s, d: traversals.data_resources(c := derive.metadata(s, d), traversals.find_data(c, "corpus", "quality", v.equals(0)), metadata=True).select("res"))
register("join_key_annotations", f"SELECT doc_id * {BASE} + {ORIGIN * KIND} AS a FROM documents WHERE lang IS NOT NULL")(lambda s, d: traversals.key_annotations(c := derive.metadata(s, d), scans.lookup(c, "keys", "lang", "corpus")).select("a"))
register("join_key_resources", "SELECT doc_id AS res FROM labels")(lambda s, d: traversals.key_resources(c := derive.metadata(s, d), scans.lookup(c, "keys", "toxic", "corpus"), metadata=True).select("res"))
register("join_annotation_keys", f"SELECT doc_id * {BASE} + {LABEL * KIND} AS a, k AS key_id FROM labels, (VALUES ('quality'), ('toxic')) t(k)")(lambda s, d: traversals.annotation_keys(c := derive.metadata(s, d), c.targets.filter(F.col("kind") == "ResourceSelector").join(derive.read(s, d, "labels").select(F.col("doc_id").alias("res")), "res", "left_semi").filter(F.col("a") % BASE == LABEL * KIND)).join(c.keys, ["set", "key"]).select("a", F.col("id").alias("key_id")))
register("join_find_data", "SELECT DISTINCT 'lang=' || lang AS id FROM documents WHERE lang <> 'en'")(lambda s, d: derive.metadata(s, d).data.join(traversals.find_data(derive.metadata(s, d), "corpus", "lang", v.negate(v.equals("en"))).select("data"), "data", "left_semi").select("id"))
register("join_resources_by_metadata", "SELECT doc_id AS res FROM documents WHERE source = 'src3'")(lambda s, d: traversals.resources_by_metadata(c := derive.metadata(s, d), traversals.find_data(c, "corpus", "source", v.equals("src3"))).select("res"))

# --- values: events as typed values --------------------------------------------------------------------------------

_ITEM = "element_at(props, '{k}')"


def _events(s, d) -> DataFrame:
    return derive.read(s, d, "events")


def _tested(name: str, op, column, sql: str) -> None:
    register(f"data_op_{name}", f"SELECT event_id FROM events WHERE {sql}")(lambda s, d: _events(s, d).filter(test(column(), op)).select("event_id"))


_text, _real, _time, _int = (lambda: value("String", F.col("event_type"))), (lambda: value("Float", F.col("value"))), (lambda: value("Datetime", F.col("ts"))), (lambda: value("Int", F.col("user_id")))
_tested("equals_text", v.equals("click"), _text, "event_type = 'click'")
_tested("not_equals_text", v.negate(v.equals("click")), _text, "event_type <> 'click' OR event_type IS NULL")
_tested("equals_int", v.equals(7), _int, "user_id = 7")
_tested("equals_numeric_text", v.equals("7"), _int, "user_id = 7")
_tested("int_is_no_float", v.equals(7.0), _int, "false")
_tested("greater_int", v.compare("gt", 50), _int, "user_id > 50")
_tested("at_least_int", v.compare("ge", 50), _int, "user_id >= 50")
_tested("less_int", v.compare("lt", 50), _int, "user_id < 50")
_tested("at_most_int", v.compare("le", 50), _int, "user_id <= 50")
_tested("greater_float", v.compare("gt", 50.0), _real, "value > 50")
_tested("at_most_float", v.compare("le", 10.5), _real, "value <= 10.5")
_tested("and_or", v.either(v.both(v.compare("ge", 10), v.compare("lt", 20)), v.equals(77)), _int, "user_id >= 10 AND user_id < 20 OR user_id = 77")
_tested("any", v.anything(), _int, "true")
_tested("null", v.null(), lambda: value("Null"), "true")
_tested("bool", v.equals("yes"), lambda: value("Bool", F.col("user_id") % 2 == 0), "user_id % 2 = 0")
_tested("list_has", v.has_element(3), lambda: value("List", F.concat(F.lit('[{"@type":"Int","value":'), (F.col("user_id") % 5).cast("string"), F.lit('},{"@type":"String","value":"x"}]'))), "user_id % 5 = 3")
_tested("list_index", v.get_index(0, v.compare("lt", 2)), lambda: value("List", F.concat(F.lit('[{"@type":"Int","value":'), (F.col("user_id") % 5).cast("string"), F.lit("}]"))), "user_id % 5 < 2")
_tested("map_key", v.get_key("k", v.equals(4)), lambda: value("Map", F.concat(F.lit('{"k":{"@type":"Int","value":'), (F.col("user_id") % 5).cast("string"), F.lit("}}"))), "user_id % 5 = 4")
_tested("map_has", v.has_element("k"), lambda: value("Map", F.concat(F.lit('{"'), F.when(F.col("user_id") % 3 == 0, "k").otherwise("other"), F.lit('":{"@type":"Int","value":1}}'))), "user_id % 3 = 0")


@register("data_op_after_datetime", "SELECT event_id FROM events WHERE ts > (SELECT min(ts) FROM events) + INTERVAL 5 DAY")
def after_datetime(s, d):
    events = _events(s, d)
    start = events.agg(F.min("ts")).first()[0]
    from datetime import timedelta

    return events.filter(test(_time(), v.compare("gt", start + timedelta(days=5)))).select("event_id")


register("data_display", "SELECT event_id, CAST(user_id AS VARCHAR) AS shown FROM events")(lambda s, d: _events(s, d).select("event_id", display(value("Int", F.col("user_id"))).alias("shown")))

# --- filters -------------------------------------------------------------------------------------------------------

_META = f"SELECT doc_id * {BASE} + {LABEL * KIND} AS a FROM labels WHERE "
register("filter_annotations_data", _META + "quality = 1 OR toxic = 1")(lambda s, d: filters.annotations_with_data(c := derive.metadata(s, d), c.annotations, traversals.find_data(c, "corpus", "quality", v.equals(1)).union(traversals.find_data(c, "corpus", "toxic", v.equals(1)))).select("a"))
register("filter_annotations_data_all", _META + "quality = 1 AND toxic = 1")(lambda s, d: filters.annotations_with_data(c := derive.metadata(s, d), c.annotations, traversals.find_data(c, "corpus", "quality", v.equals(1)).union(traversals.find_data(c, "corpus", "toxic", v.equals(1))), every=True).select("a"))
register("filter_annotations_key", _META + "true")(lambda s, d: filters.annotations_with_key(c := derive.metadata(s, d), c.annotations, scans.lookup(c, "keys", "quality", "corpus")).select("a"))
register("filter_annotations_value", _META + "quality >= 1 OR toxic >= 1")(lambda s, d: filters.annotations_with_value(c := derive.metadata(s, d), c.annotations, v.compare("ge", 1)).select("a"))
register("filter_annotations_text", "SELECT a FROM word WHERE piece = 'the'", word=True)(lambda s, d: filters.annotations_with_text(c := derive.corpus(s, d), derive.words(s, d), "the").select("a"))
register("filter_annotations_text_nocase", "SELECT a FROM word WHERE lower(piece) = 'the'", word=True)(lambda s, d: filters.annotations_with_text(c := derive.corpus(s, d), derive.words(s, d), "THE", case_sensitive=False).select("a"))
register("filter_annotations_regex", "SELECT a FROM word WHERE regexp_matches(piece, '^th[a-z]+on$')", word=True)(lambda s, d: filters.annotations_matching(c := derive.corpus(s, d), derive.words(s, d), "^th[a-z]+on$").select("a"))
register("filter_annotations_resource", "SELECT a FROM line WHERE res = 11", line=True)(lambda s, d: filters.annotations_on_resource(c := derive.corpus(s, d), derive.lines(s, d), scans.lookup(c, "resources", "doc11")).select("a"))
register("filter_resources_metadata", "SELECT doc_id AS res FROM documents WHERE lang = 'de'")(lambda s, d: filters.resources_with_data(c := derive.metadata(s, d), c.resources, traversals.find_data(c, "corpus", "lang", v.equals("de")), metadata=True).select("res"))
register("filter_resources_data_on_text", "SELECT DISTINCT res FROM line", line=True)(lambda s, d: filters.resources_with_data(c := derive.corpus(s, d), c.resources, traversals.find_data(c, "corpus", "type", v.equals("line"))).select("res"))
register("filter_selections_annotation", "SELECT DISTINCT w.res, w.b AS begin, w.e AS \"end\" FROM word w JOIN line l ON l.res = w.res AND l.b = w.b AND l.e = w.e", True, True)(lambda s, d: filters.selections_with_annotations(c := derive.corpus(s, d), derive.words(s, d).select("res", "begin", "end").distinct(), derive.lines(s, d)))
register("filter_data_value", "SELECT DISTINCT 'source=' || source AS id FROM documents WHERE source IN ('src1', 'src2')")(lambda s, d: filters.data_with_value(derive.metadata(s, d).data, v.either(v.equals("src1"), v.equals("src2"))).select("id"))
register("filter_all_or_nothing", "SELECT doc_id AS res FROM documents WHERE (SELECT count(*) FROM documents WHERE doc_id IN (1, 2)) = 2")(lambda s, d: filters.all_or_nothing((c := derive.metadata(s, d)).resources.select("res"), c.resources.filter(F.col("res").isin(1, 2)), ["res"]))
register("filter_no_substore", "SELECT doc_id AS res FROM documents WHERE lang <> 'fr'")(lambda s, d: filters.in_substore(mutations.associate(mutations.add_substore(c := derive.metadata(s, d), "french"), derive.read(s, d, "documents").filter("lang = 'fr'").select(F.col("doc_id").alias("item")), "resource", 0), c.resources, "res", "resource", None).select("res"))

# --- span relations ------------------------------------------------------------------------------------------------

_PAIRS = 'SELECT l.a AS a, w.a AS b FROM line l JOIN word w ON w.res = l.res AND '
_CONDITIONS = {
    "equals": ("w.b = l.b AND w.e = l.e", None),
    "overlaps": ("w.b < l.e AND w.e > l.b", None),
    "embeds": ("w.b >= l.b AND w.e <= l.e", None),
    "before_near": ("l.e <= w.b AND w.b - l.e <= 20", Relation("before", limit=20)),
    "after_near": ("l.b >= w.e AND l.b - w.e <= 20", Relation("after", limit=20)),
    "precedes_exact": ("w.b = l.e", Relation("precedes", whitespace=False)),
    "succeeds_exact": ("w.e = l.b", Relation("succeeds", whitespace=False)),
    "samebegin": ("w.b = l.b", None),
    "sameend": ("w.e = l.e", None),
}
for _name, (_cond, _rel) in _CONDITIONS.items():
    register(f"rel_{_name}", _PAIRS + _cond, True, True)(lambda s, d, r=_rel or _name: related.join_related(derive.lines(s, d), derive.words(s, d), r).select("a", F.col("r_a").alias("b")))
_GAP = "JOIN documents t ON t.doc_id = l.res AND (w.b = l.e OR w.b > l.e AND w.b - l.e <= 10 AND trim(substr(t.text, l.e + 1, w.b - l.e), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '')"
register("rel_precedes", f"SELECT l.a AS a, w.a AS b FROM line l JOIN line w ON w.res = l.res AND w.b >= l.e AND w.b - l.e <= 10 {_GAP}", line=True)(lambda s, d: related.join_related(derive.lines(s, d), derive.lines(s, d), "precedes", derive.resources(s, d)).select("a", F.col("r_a").alias("b")))
register("rel_embedded", "SELECT w.a AS a, l.a AS b FROM word w JOIN line l ON l.res = w.res AND w.b >= l.b AND w.e <= l.e AND w.b - l.b <= 30 AND l.e - w.e <= 30", True, True)(lambda s, d: related.join_related(derive.words(s, d), derive.lines(s, d), Relation("embedded", limit=30)).select("a", F.col("r_a").alias("b")))
register("rel_before", "SELECT l.a AS a, count(*) AS n FROM line l JOIN line w ON w.res = l.res AND l.e <= w.b GROUP BY l.a", line=True)(lambda s, d: related.join_related(derive.lines(s, d), derive.lines(s, d), "before").groupBy("a").agg(F.count("*").alias("n")))
register("rel_related_text", "SELECT DISTINCT w.res, w.b AS begin, w.e AS \"end\" FROM line l JOIN known w ON w.res = l.res AND w.b < l.e AND w.e > l.b AND (w.b <> l.b OR w.e <> l.e)", True, True, _KNOWN)(lambda s, d: related.related_text(derive.corpus(s, d), derive.lines(s, d), "overlaps").select("res", "begin", "end"))
_SETS = "sets AS (SELECT res, min(b) AS b, max(e) AS e, count(*) AS n FROM (SELECT DISTINCT res, b, e FROM word) GROUP BY res)"
register("rel_set_samerange", "SELECT s.res FROM sets s JOIN (SELECT res, min(b) AS b, max(e) AS e FROM line GROUP BY res) l ON l.res = s.res AND l.b = s.b AND l.e = s.e", True, True, _SETS)(lambda s, d: related.set_related(derive.words(s, d), derive.lines(s, d), [], [], Relation("samerange", every=True)).select("res"))
register("rel_intersection", "SELECT l.a AS a, w.a AS b, greatest(l.b, w.b) AS begin, least(l.e, w.e) AS \"end\" FROM line l JOIN word w ON w.res = l.res AND w.b < l.e AND w.e > l.b", True, True)(lambda s, d: related.join_related(derive.lines(s, d), derive.words(s, d), "overlaps").withColumn("i", intersection(F.col("begin"), F.col("end"), F.col("r_begin"), F.col("r_end"))).select("a", F.col("r_a").alias("b"), F.col("i.begin").alias("begin"), F.col("i.end").alias("end")))

# --- texts ---------------------------------------------------------------------------------------------------------

_FIND = "FROM (SELECT doc_id, text, p, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, {t} AS text, string_split({t}, '{f}') AS p FROM documents)) WHERE k < len(p)"


def _find_sql(fragment: str, column: str) -> str:
    return f"SELECT res, b + n AS begin, b + n + {len(fragment)} AS \"end\" FROM (SELECT res, n, CAST(coalesce(sum(n + {len(fragment)}) OVER (PARTITION BY res ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b, k, last FROM (SELECT doc_id AS res, length(unnest(p)) AS n, generate_subscripts(p, 1) AS k, len(p) AS last FROM (SELECT doc_id, string_split({column}, '{fragment}') AS p FROM documents))) WHERE k < last"


register("text_find", _find_sql("the ", "text"))(lambda s, d: texts.find(derive.resources(s, d).select("res", "text"), "the "))
register("text_find_nocase", _find_sql("the", "lower(text)"))(lambda s, d: texts.find(derive.resources(s, d).select("res", "text"), "THE", nocase=True))
register("text_split", "SELECT res, k - 1 AS pos, b AS begin, b + n AS \"end\" FROM (SELECT res, n, k, CAST(coalesce(sum(n + 2) OVER (PARTITION BY res ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM (SELECT doc_id AS res, length(unnest(p)) AS n, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents)))")(lambda s, d: texts.split(derive.resources(s, d).select("res", "text"), ". "))
register("text_trim", "SELECT a, CAST(b + length(piece) - length(ltrim(piece, '.,!?')) AS BIGINT) AS begin, CAST(CASE WHEN trim(piece, '.,!?') = '' THEN e ELSE e - length(piece) + length(rtrim(piece, '.,!?')) END AS BIGINT) AS \"end\" FROM word", word=True)(lambda s, d: texts.trim(derive.words(s, d).withColumnRenamed("piece", "text"), ".,!?").select("a", "begin", "end"))
register("text_regex", "SELECT a, regexp_extract(piece, '([a-z]+)tion', 1) AS stem FROM word WHERE regexp_matches(piece, '^[a-z]+tion$')", word=True)(lambda s, d: texts.find_regex(derive.words(s, d).filter(F.col("piece").rlike("^[a-z]+tion$")).select("a", "piece", F.col("piece").alias("text")), ["([a-z]+)tion"]).filter("match = 0").select("a", F.expr("substring(piece, begin + 1, end - begin)").alias("stem")))
register("text_segmentation", "SELECT res, p AS begin, nxt AS \"end\" FROM (SELECT res, p, lead(p) OVER (PARTITION BY res ORDER BY p) AS nxt FROM (SELECT DISTINCT res, p FROM (SELECT res, b AS p FROM known UNION ALL SELECT res, e FROM known UNION ALL SELECT doc_id, 0 FROM documents UNION ALL SELECT doc_id, length(text) FROM documents))) WHERE nxt IS NOT NULL", True, True, _KNOWN)(lambda s, d: texts.segments((c := derive.corpus(s, d)).resources, c.textselections))
register("text_bytes", "SELECT a, octet_length(encode(substr(t.text, 1, l.b))) AS byte FROM line l JOIN documents t ON t.doc_id = l.res", line=True)(lambda s, d: derive.lines(s, d).join(derive.resources(s, d).select("res", "text"), "res").select("a", texts.byte_of(F.col("text"), F.col("begin")).alias("byte")))
register("text_relative_offset", "SELECT l.a AS a, w.a AS b, w.b - l.b AS begin, w.e - l.e AS \"end\" FROM line l JOIN word w ON w.res = l.res AND w.b >= l.b AND w.e <= l.e", True, True)(lambda s, d: related.join_related(derive.lines(s, d), derive.words(s, d), "embeds").withColumn("o", relative(F.col("r_begin"), F.col("r_end"), F.col("begin"), F.col("end"), "BeginEnd")).select("a", F.col("r_a").alias("b"), F.col("o.begin").alias("begin"), F.col("o.end").alias("end")))

# --- sets, slices, counts ------------------------------------------------------------------------------------------

_ids = lambda s, d, lang: derive.read(s, d, "documents").filter(F.col("lang") == lang).select("doc_id")
register("set_union", "SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM labels WHERE toxic = 1")(lambda s, d: collections.union(_ids(s, d, "de"), derive.read(s, d, "labels").filter("toxic = 1").select("doc_id")))
register("set_intersection", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")(lambda s, d: collections.intersection(_ids(s, d, "en"), derive.read(s, d, "labels").filter("toxic = 1").select("doc_id")))
_COUNT = "(SELECT count(*) FROM documents)"
for _n, (_b, _e, _cond) in {"first": (0, 5, "r < 5"), "middle": (3, 9, "r >= 3 AND r < 9"), "last": (-4, 0, f"r >= {_COUNT} - 4"), "drop_tail": (2, -3, f"r >= 2 AND r < {_COUNT} - 3"), "both_negative": (-2, -3, f"r >= 2 AND r < {_COUNT} - 3"), "negative_begin": (-7, 4, "r < 4"), "all": (0, 0, "true")}.items():
    register(f"limit_{_n}", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE {_cond}")(lambda s, d, b=_b, e=_e: collections.limit(derive.read(s, d, "documents").select("doc_id"), b, e, ["doc_id"]))
register("count_annotations_per_key", f"SELECT 'type' AS key_id, (SELECT count(*) FROM line) + (SELECT count(*) FROM word) AS n UNION ALL SELECT 'quality', count(quality) FROM labels UNION ALL SELECT 'toxic', count(toxic) FROM labels UNION ALL SELECT 'lang', count(lang) FROM documents UNION ALL SELECT 'source', count(source) FROM documents", True, True)(lambda s, d: collections.annotations_per_key(c := derive.corpus(s, d)).join(c.keys, ["set", "key"]).select(F.col("id").alias("key_id"), "n"))
register("count_annotations_per_selection", "SELECT res, b AS begin, e AS \"end\", count(*) AS n FROM (SELECT res, b, e FROM line UNION ALL SELECT res, b, e FROM word) GROUP BY ALL", True, True)(lambda s, d: collections.annotations_per_selection(derive.corpus(s, d)))
register("count_selections_per_resource", "SELECT res, count(*) AS n FROM known GROUP BY res", True, True, _KNOWN)(lambda s, d: collections.selections_per_resource(derive.corpus(s, d)))
register("order_borders", "SELECT res, min(b) AS begin, max(e) AS \"end\" FROM line GROUP BY res", line=True)(lambda s, d: collections.borders(derive.lines(s, d), ["res"]).select("res", "begin", "end"))

# --- the query language --------------------------------------------------------------------------------------------


def _language(name: str, text: str, sql: str, columns: dict[str, str], **parts) -> None:
    """Queries whose SQL needs no lines or words are about metadata alone."""
    store = derive.corpus if parts else derive.metadata
    register(f"lang_{name}", sql, **parts)(lambda s, d: compiler.run(store(s, d), text).select(*[F.col(k).alias(x) for k, x in columns.items()]))


_language("data", 'SELECT ANNOTATION ?x WHERE DATA corpus toxic = 1;', _META.replace("AS a", "AS a") + "toxic = 1", {"x_a": "a"})
_language("data_operators", 'SELECT ANNOTATION ?x WHERE DATA corpus quality >= 1; DATA corpus toxic != 1;', _META + "quality >= 1 AND toxic <> 1", {"x_a": "a"})
_language("or_literals", 'SELECT ANNOTATION ?x WHERE DATA corpus source = src1|src2;', f"SELECT doc_id * {BASE} + {ORIGIN * KIND} AS a FROM documents WHERE source IN ('src1', 'src2')", {"x_a": "a"})
_language("resource_metadata", 'SELECT RESOURCE ?r WHERE DATA AS METADATA corpus lang = es;', "SELECT doc_id AS res FROM documents WHERE lang = 'es'", {"r_res": "res"})
_language("nested_relation", 'SELECT ANNOTATION ?l WHERE DATA corpus type = line; { SELECT ANNOTATION ?w WHERE RELATION ?l SAMEBEGIN; DATA corpus type = word; }', "SELECT l.a AS line, w.a AS word FROM line l JOIN word w ON w.res = l.res AND w.b = l.b AND w.e <> l.e", {"l_a": "line", "w_a": "word"}, line=True, word=True)
_language("optional", 'SELECT RESOURCE ?r { SELECT OPTIONAL ANNOTATION ?m WHERE RESOURCE AS METADATA ?r; DATA corpus toxic = 1; }', f"SELECT d.doc_id AS res, CASE WHEN toxic = 1 THEN d.doc_id * {BASE} + {LABEL * KIND} END AS a FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1", {"r_res": "res", "m_a": "a"})
_language("text", 'SELECT TEXT ?t WHERE TEXT "the that";', _find_sql("the that", "text"), {"t_res": "res", "t_begin": "begin", "t_end": "end"})
_language("union", 'SELECT ANNOTATION ?x WHERE [ DATA corpus quality = 0 OR DATA corpus toxic = 1 ];', _META + "quality = 0 OR toxic = 1", {"x_a": "a"})
_language("limit", 'SELECT RESOURCE ?r WHERE DATA AS METADATA corpus lang = fr; LIMIT 3;', "SELECT doc_id AS res FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 3", {"r_res": "res"})
_language("keys", 'SELECT KEY ?k WHERE DATASET corpus;', "SELECT unnest([0, 1, 2, 3, 4]) AS key", {"k_key": "key"})
_language("data_of_annotation", f'SELECT RESOURCE ?r WHERE ID doc4; {{ SELECT ANNOTATION ?m WHERE RESOURCE AS METADATA ?r; DATA corpus lang = any; }}', f"SELECT doc_id AS res, doc_id * {BASE} + {ORIGIN * KIND} AS a FROM documents WHERE doc_id = 4 AND lang IS NOT NULL", {"r_res": "res", "m_a": "a"})

# --- changes -------------------------------------------------------------------------------------------------------

register("mut_delete", f"SELECT count(*) AS n FROM labels WHERE NOT coalesce(toxic = 1, false)")(lambda s, d: compiler.change(derive.metadata(s, d), "DELETE ANNOTATION ?x { SELECT ANNOTATION ?x WHERE DATA corpus toxic = 1; }").annotations.filter(F.col("a") % BASE == LABEL * KIND).agg(F.count("*").alias("n")))
register("mut_add", "SELECT count(*) AS n FROM documents WHERE lang = 'de'")(lambda s, d: traversals.data_annotations(c := compiler.change(derive.metadata(s, d), 'ADD ANNOTATION ?x WITH DATA mine flag "german"; TARGET ?r; { SELECT RESOURCE ?r WHERE DATA AS METADATA corpus lang = de; }'), traversals.find_data(c, "mine", "flag", v.equals("german"))).agg(F.count("*").alias("n")))
register("mut_remove_key", "SELECT 0 AS left_over, count(*) AS n FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL")(lambda s, d: (c := mutations.remove_keys(b := derive.metadata(s, d), scans.lookup(b, "keys", "toxic", "corpus"))).annotations.filter(F.col("a") % BASE == LABEL * KIND).agg(F.count("*").alias("n")).select(F.lit(0).alias("left_over"), "n"))
register("mut_reindex")(lambda s, d: mutations.reindex(derive.metadata(s, d)).annotations.agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count("*").alias("n")))

# --- extensions ----------------------------------------------------------------------------------------------------

register("ext_checksum", "SELECT a, sha1(piece) AS checksum FROM line", line=True)(lambda s, d: extensions.checksums(derive.corpus(s, d), derive.lines(s, d)).select("a", "checksum"))
register("ext_protect", "SELECT a, CASE WHEN length(piece) < 40 THEN 'text' ELSE 'checksum' END AS key_id, CASE WHEN length(piece) < 40 THEN piece ELSE sha1(piece) END AS value FROM line", line=True)(lambda s, d: extensions.protect(derive.corpus(s, d), derive.lines(s, d)).select("a", "key_id", "value"))
register("ext_merge_adjacent", "SELECT res, min(b) AS begin, max(e) AS \"end\" FROM (SELECT *, sum(n) OVER (PARTITION BY res ORDER BY b) AS g FROM (SELECT res, b, e, CASE WHEN b > coalesce(lag(e) OVER (PARTITION BY res ORDER BY b), -1) + 1 THEN 1 ELSE 0 END AS n FROM word)) GROUP BY res, g", word=True)(lambda s, d: extensions.merged(derive.words(s, d).select("res", "begin", (F.col("end") + 1).alias("end")), ["res"]).select("res", "begin", (F.col("end") - 1).alias("end")))
register("ext_web_annotations", "SELECT a, '{\"@context\":\"http://www.w3.org/ns/anno.jsonld\",\"id\":\"urn:annotation:!A' || a || '\",\"type\":\"Annotation\",\"body\":{\"type\":\"Dataset\",\"urn:set:corpus/type\":\"line\"},\"target\":{\"source\":\"urn:resource:doc' || res || '\",\"selector\":{\"type\":\"TextPositionSelector\",\"start\":' || b || ',\"end\":' || e || '}}}' AS json FROM line", line=True)(lambda s, d: extensions.web_annotations(c := derive.corpus(s, d), narrowing.among(c.annotations, settled(derive.lines(s, d).select("a")), ["a"])))
