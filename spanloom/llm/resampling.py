"""Target-distribution importance resampling: draw the documents that look most like a target corpus, with Gumbel noise.

Features are runs of one and of two consecutive words; each falls in the bucket of its crc32. The buckets are counted over all
documents and over the target; a bucket's gain is the floored log ratio of the two smoothed shares, in thousandths. A document's
weight is the floored mean of its features' gains, read from one array by bucket; with a Gumbel variate drawn from its id it is
its score, an integer.

The draw sorts nothing: the scores of the eligible documents are counted in an exact histogram, and what stands in higher scores, the
suffix sum, is each score's first rank. That gives the cutoff, the last score with room. Only rows at or above it are numbered, by id
within their score.

The histogram has a row per score; scores are bounded by the logarithms of the totals, not by the number of documents. What goes to all tasks is the
array of gains. Words of whole texts are found twice, once to count and once to score, so that nothing is stored per word.

A null text has no words; documents without words have weight 0 and a score. Null ids are drawn like an empty id and stand last in a
tie. Rows that repeat an id are judged each on its own; equal scores of one id stand in the order of a hash of their other columns, and are numbered without
bringing them together; rows that are equal in all columns are interchangeable. Empty tables give an empty result, an empty target gains by the smoothing alone. The results take the place of columns of
their names in any case; other columns are carried along as `keep` says.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.shared import Words, fresh, lean, materialize, slices, text_bytes, words_of

RESULTS = ("n_features", "weight", "score", "rank")
#: Bytes of a word that are taken for all words at a time; zlib takes longer words.
_TOGETHER = 64


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


_CRC, _FULL = _crc_table(), np.uint32(0xFFFFFFFF)


def _zeros_tables() -> np.ndarray:
    """Of 1, 2, 4, ... zero bytes: what each of a crc's four bytes becomes. A crc is linear, so their sum is the whole."""
    bytes_at = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    tables = [np.stack([_CRC[v & 255] ^ (v >> np.uint32(8)) for v in bytes_at])]
    for _ in range(31):
        tables.append(_through(tables[-1], tables[-1]))
    return np.stack(tables)


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> np.uint32(8)) & 255] ^ table[2][(crc >> np.uint32(16)) & 255] ^ table[3][crc >> np.uint32(24)]


_ZEROS = _zeros_tables()


def word_crcs(chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of words that stand in chars one after the other."""
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, size = first[order], lengths[order]
    crc = np.full(len(lengths), _FULL)
    for place in range(min(_TOGETHER, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -place, side="left"))  # so many are longer than place
        crc[:n] = _CRC[(crc[:n] ^ chars[begin[:n] + place]) & 255] ^ (crc[:n] >> np.uint32(8))
    crc ^= _FULL
    for i in range(int(np.searchsorted(-size, -_TOGETHER, side="left"))):
        crc[i] = zlib.crc32(chars[begin[i] : begin[i] + size[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def joined_crcs(left: np.ndarray, right: np.ndarray, right_lengths: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings one after the other, from those of the two and the length of the second."""
    out = left.copy()
    for bit in range(int(right_lengths.max()).bit_length() if len(right_lengths) else 0):
        at = np.flatnonzero(right_lengths >> bit & 1)
        out[at] = _through(_ZEROS[bit], out[at])
    return out ^ right


def features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, words that start a pair, bucket of each pair)."""
    lengths = words.end - words.start
    one = word_crcs(words.chars, lengths)
    at = np.flatnonzero(words.doc[1:] == words.doc[:-1]) if len(one) else np.zeros(0, np.int64)
    spaced = one[at] ^ _FULL
    spaced = _CRC[(spaced ^ np.uint32(0x20)) & 255] ^ (spaced >> np.uint32(8)) ^ _FULL
    two = joined_crcs(spaced, one[at + 1], lengths[at + 1])
    return one % np.uint32(buckets), at, two % np.uint32(buckets)


def _words(part: pa.RecordBatch, column: str) -> Words:
    """Lower-case words of ASCII letters, digits and all that is not ASCII."""
    return words_of(*text_bytes(part.column(column)), lower=True, plain=True)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts fall in each bucket; a row per bucket and task is summed, a row per bucket comes back."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                one, _, two = features(_words(part, "text"), buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(buckets, np.int64)
    for row in texts.select(F.col("text").alias("text")).mapInArrow(lean(count), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the floored log ratio of the target's smoothed share to that of all documents, in thousandths."""
    n = len(raw)
    s_all, t_all = float(int(raw.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000 * math.log((int(t) + 1) * s_all / ((int(s) + 1) * t_all))) for s, t in zip(raw, target, strict=True)], dtype=np.int64)


def weighed(documents: DataFrame, gain: np.ndarray, keep: list[str], counted: str = "n_words") -> DataFrame:
    """The columns `keep` with counted (the number of words), n_features and weight of the column text."""
    source = fresh(documents, "source")
    schema = documents.select(*keep).schema.add(counted, "long").add("n_features", "long").add("weight", "long")

    def run(batches):
        for batch in batches:
            for part in slices(batch, source):
                words = _words(part, source)
                one, at, two = features(words, len(gain))
                each = gain[one]
                each[at] += gain[two]
                total = np.concatenate([[0], np.cumsum(each)])
                n_words = np.diff(words.first).astype(np.int64)
                n = n_words + np.maximum(n_words - 1, 0)
                weight = (total[words.first[1:]] - total[words.first[:-1]]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(n_words), pa.array(n), pa.array(weight)], names=schema.names)

    return documents.select(*keep, F.col("text").alias(source)).mapInArrow(lean(run), schema)


def gumbel(key: str, seed: int):
    """Thousandths of a Gumbel variate, floored, that the id and the seed decide."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "utf-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, key: str, eligible, percent: int) -> DataFrame:
    """scored, a stored table, with rank: 1, 2, 3, ... of the floored percentage of eligible rows with the highest scores, in the order of score and key; null for others.

    Also of rows that share score and key no task takes all: the number of rows before them is known by score, key and file, and only those of one file are numbered.
    """
    file, other, count, above, before, place = (fresh(scored, c) for c in ("file", "other", "count", "above", "before", "place"))
    histogram = scored.filter(eligible).groupBy("score").agg(F.count("*").alias(count))
    n = int(histogram.agg(F.sum(count)).first()[0] or 0)
    drawn = n * percent // 100
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)  # a row per score
    offsets = histogram.select("score", F.coalesce(F.sum(count).over(higher), F.lit(0)).alias(above)).filter(F.col(above) < drawn)
    cutoff = offsets.agg(F.min("score")).first()[0]
    chosen = F.coalesce(eligible & (F.col("score") >= F.lit(cutoff)), F.lit(False)) if cutoff is not None else F.lit(False)
    rest = scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    filed = scored.filter(chosen).withColumns({other: F.xxhash64(F.to_json(F.struct(*scored.columns))), file: F.col("_metadata.file_path")})
    same = ["score", key, other, file]
    in_score = Window.partitionBy("score").orderBy(F.asc_nulls_last(key), other, file).rowsBetween(Window.unboundedPreceding, -1)
    keys = filed.groupBy(*same).agg(F.count("*").alias(count)).join(offsets, "score")
    keys = keys.select(*[F.col(c).alias(f"{c}_") for c in same], (F.col(above) + F.coalesce(F.sum(count).over(in_score), F.lit(0))).alias(before))
    placed = filed.withColumn(place, F.row_number().over(Window.partitionBy(*same).orderBy("weight")))
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in same]
    rank = (F.col(before) + F.col(place)).cast("long")
    top = placed.join(keys, on).select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return top.unionByName(rest)


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of documents (all of them, if None) with n_features, weight, score and rank; of rows with fewer words than least_words none is drawn.

    Both frames need a column text. What is kept is stored once between scoring and drawing.
    """
    keep = [c for c in (documents.columns if keep is None else keep) if c.lower() not in RESULTS]
    counted = fresh(documents, "n_words")
    gain = gains(bucket_counts(documents, buckets), bucket_counts(target, buckets))
    scored = weighed(documents, gain, keep, counted).withColumn("score", F.col("weight") + gumbel(key, seed))
    scored = materialize(scored, "scores")
    return ranked(scored, key, F.col(counted) >= least_words, percent).drop(counted)


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    """Score and rank of every document against all of benchmark."""
    documents, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(documents, target, keep=["doc_id"]).select("doc_id", *RESULTS)


#: The remainders of the 16 half bytes by which a crc32 can be computed.
_HALF = ", ".join(f"{int(_ZEROS[0][0][i << 4])}" for i in range(16))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11_SQL = rf"""
WITH words AS (
  SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS kind, doc_id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)),
runs AS (SELECT kind, doc_id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
every AS (SELECT kind, doc_id, unnest(f) AS feature FROM runs),
hexes AS (SELECT feature, hex(feature) AS h FROM (SELECT DISTINCT feature FROM every)),
halves AS (SELECT feature, list_transform(range(0, length(h)), lambda p: strpos('0123456789ABCDEF', h[CASE WHEN p % 2 = 0 THEN p + 2 ELSE p END]) - 1) AS x FROM hexes),
numbered AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, x::BIGINT[]), lambda c, y: xor(([{_HALF}]::BIGINT[])[(xor(c, y) & 15) + 1], c >> 4)), 4294967295::BIGINT) % 10000 AS bucket
  FROM halves),
dealt AS (SELECT kind, doc_id, bucket FROM every JOIN numbered USING (feature)),
counts AS (SELECT bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM dealt GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM counts, totals),
sums AS (SELECT doc_id, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dealt JOIN gain USING (bucket) WHERE kind = 's' GROUP BY doc_id),
noise AS (
  SELECT doc_id, n_words, len(f)::BIGINT AS n_features, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM runs WHERE kind = 's'),
scored AS (
  SELECT doc_id, n_words, n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM noise LEFT JOIN sums USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= floor(25 * n / 100) THEN place END AS rank FROM placed
"""
