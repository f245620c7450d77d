"""Queries with many regular expressions over whole texts. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as texts
from spanloom.plans import derive
from spanloom.plans.catalogue import register

#: 200 expressions by a rule: syllables with what may follow, alternatives, repeats, and four without any literal that a match needs.
STEMS = ("th", "in", "ou", "an", "er", "ver", "que", "ent", "sch", "con", "mai", "pro", "ung", "ado")
ENDS = ("ing", "tion", "heit", "lich", "ment", "eux", "elle", "ión", "keit", "ity", "and", "est", "ia", "ous")
EXPRESSIONS = [f"{a}[a-z]{{0,4}}{b}" if i % 3 == 0 else f"(?:{a}|{b})[a-z]{{2}}{b}" if i % 3 == 1 else f"[a-z]+{a}{b}" for i, (a, b) in enumerate((a, b) for a in STEMS for b in ENDS)]
EXPRESSIONS += ["[0-9]{4,}", "[A-Z]{5,}", "[.,;:!?]{2,}", "[0-9]+[.,][0-9]+"]

_LIST = ", ".join(f"({i}, '{e}')" for i, e in enumerate(EXPRESSIONS))
_FOUND = f"""found AS (SELECT doc_id AS res, i AS expression, regexp_extract_all(text, e) AS m, strpos(regexp_replace(text, e, chr(1)), chr(1)) - 1 AS first
  FROM documents, (VALUES {_LIST}) v(i, e))"""

register("text_regex_many", "SELECT res, expression, len(m) AS n, list_sum(list_transform(m, lambda x: length(x)))::BIGINT AS covered, first FROM found WHERE len(m) > 0", also=_FOUND)(
    lambda s, d: texts.find_regex(derive.resources(s, d).select("res", "text"), EXPRESSIONS, overlap=True)
    .groupBy("res", "expression").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("begin")).alias("covered"), F.min("begin").alias("first"))
)
register("text_regex_select", "SELECT res, expression FROM found WHERE len(m) > 0", also=_FOUND)(
    lambda s, d: texts.select_expressions(derive.resources(s, d).select("res", "text"), EXPRESSIONS)
)
