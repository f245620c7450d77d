"""Annotation stores derived from the driver's tables, and the same rules as SQL.

Resources are documents. Lines are split at line feeds, words at blanks and line feeds; empty pieces are dropped. Handles
are computed from the document and the place, so that both engines agree and nothing has to be numbered globally:
a = doc_id * 2**34 + kind * 2**32 + place, kind 0 lines, 1 words, 2 labels (metadata: quality, toxic), 3 lang and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as texts
from spanloom.model import RESOURCE, SCHEMAS, TEXT, Store, value

BASE, KIND = 1 << 34, 1 << 32
LINE, WORD, LABEL, ORIGIN = range(4)
KEYS = ("type", "quality", "toxic", "lang", "source")
#: What separates the pieces of lines and of words.
SEPARATORS = ("\n", " \n")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("res"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), "text", F.length("text").alias("textlen"), F.lit(None).cast("string").alias("filename"))


def _handle(kind: Column | int) -> Column:
    return F.col("res") * BASE + kind * F.lit(KIND) + F.col("pos")


def pieces(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """a, res, begin, end, piece of the non-empty pieces of a layer."""
    found = texts.layers(resources(spark, sf_dir).select("res", "text"), [SEPARATORS[kind]], piece=True)
    return found.select(_handle(F.lit(kind)).alias("a"), "res", "begin", "end", "piece")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir, LINE)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir, WORD)


def _spans(res: DataFrame, ranks: bool = False) -> DataFrame:
    """kind, a, res, begin, end and, if wanted, ts and again of lines and words."""
    found = texts.layers(res.select("res", "text"), list(SEPARATORS), ranks=ranks)
    return found.select(F.col("layer").alias("kind"), _handle(F.col("layer").cast("long")).alias("a"), "res", "begin", "end", *["ts", "again"] * ranks)


def _targets(spans: DataFrame) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    ts = "ts" if "ts" in spans.columns else null("bigint").alias("ts")
    return spans.select("a", F.lit(0).alias("pos"), F.lit(TEXT).alias("kind"), "res", ts, "begin", "end", F.lit("BeginBegin").alias("mode"), null("bigint").alias("target_a"), null("bigint").alias("set"), null("bigint").alias("key"), null("bigint").alias("data"))


def metadata(spark: SparkSession, sf_dir: str) -> Store:
    """The store of documents with labels and origins as metadata and no annotations on texts."""
    return corpus(spark, sf_dir, layers=False)


def corpus(spark: SparkSession, sf_dir: str, layers: bool = True) -> Store:
    """The store of documents: lines and words (key type), labels and origins as metadata.

    All that is known of a text stands in its row, so the tables are made of the documents where they are read; nothing is shuffled or stored for them.
    """
    res = resources(spark, sf_dir)
    labels = read(spark, sf_dir, "labels").select((F.col("doc_id") * BASE + LABEL * KIND).alias("a"), F.col("doc_id").alias("res"), F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    origin = read(spark, sf_dir, "documents").select((F.col("doc_id") * BASE + ORIGIN * KIND).alias("a"), F.col("doc_id").alias("res"), "lang", "source")
    code = lambda key, col: F.when(col.isNotNull(), F.concat(F.lit(f"{key}="), col.cast("string")))
    # Data handles are hashes of key and value, so that annotations refer to them without a join.
    handle = lambda key, col: F.pmod(F.xxhash64(code(key, col)), F.lit(1 << 62))
    spans = _spans(res) if layers else None
    kinds = F.when(F.col("kind") == LINE, handle("type", F.lit("line"))).otherwise(handle("type", F.lit("word")))
    used = [spans.select("a", F.lit(0).alias("pos"), kinds.alias("data"))] if layers else []
    pairs = [(labels, ["quality", "toxic"], "Int"), (origin, ["lang", "source"], "String")]
    data = [(spark.range(1).select(F.lit(name).alias("v")), "type", "String") for name in ("line", "word")]
    for df, names, kind in pairs:
        for pos, key in enumerate(names):
            used.append(df.filter(F.col(key).isNotNull()).select("a", F.lit(pos).alias("pos"), handle(key, F.col(key)).alias("data")))
            data.append((df.filter(F.col(key).isNotNull()).select(F.col(key).alias("v")).distinct(), key, kind))
    table = None
    for df, key, kind in data:
        rows = df.select(F.lit(0).cast("long").alias("set"), handle(key, F.col("v")).alias("data"), code(key, F.col("v")).alias("id"), F.lit(KEYS.index(key)).cast("long").alias("key"), value(kind, F.col("v")).alias("value"))
        table = rows if table is None else table.unionByName(rows)
    annotation_data = used[0]
    for u in used[1:]:
        annotation_data = annotation_data.unionByName(u)
    empty = Store.empty(spark)
    meta = labels.select("a", "res").unionByName(origin.select("a", "res"))
    about = _targets(meta.select("a", "res", F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"))).withColumns({"kind": F.lit(RESOURCE), "mode": F.lit(None).cast("string")})
    # A selection's handle is its rank in its resource. Where a line is a word, both layers have the span.
    ranked = _spans(res, ranks=True) if layers else None
    selections = ranked.filter("not again").select("res", "ts", "begin", "end") if layers else empty.textselections
    targets = _targets(ranked).unionByName(about) if layers else about
    every = spans.select("a").unionByName(meta.select("a")) if layers else meta.select("a")
    return empty.with_tables(
        resources=res,
        textselections=selections,
        datasets=spark.createDataFrame([(0, "corpus", None)], SCHEMAS["datasets"]),
        keys=spark.createDataFrame([(0, i, k) for i, k in enumerate(KEYS)], SCHEMAS["keys"]),
        data=table,
        annotations=every.select("a", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("complex")),
        annotation_data=annotation_data.select("a", "pos", F.lit(0).cast("long").alias("set"), "data"),
        targets=targets,
    )


def _pieces_sql(name: str, pieces: str, kind: int) -> str:
    return f"""{name} AS (SELECT res * {BASE} + {kind * KIND} + pos - 1 AS a, res, b, b + length(piece) AS e, piece FROM (
  SELECT *, CAST(coalesce(sum(length(piece) + 1) OVER (PARTITION BY res ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM (
  SELECT doc_id AS res, generate_subscripts(p, 1) AS pos, unnest(p) AS piece FROM (SELECT doc_id, {pieces} AS p FROM documents))) WHERE length(piece) > 0)"""


#: Common table expressions for DuckDB: lines and words with a, res, b, e and piece.
SQL_LINE = _pieces_sql("line", "string_split(text, chr(10))", LINE)
SQL_WORD = _pieces_sql("word", "string_split(replace(text, chr(10), ' '), ' ')", WORD)
