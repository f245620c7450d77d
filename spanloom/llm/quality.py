"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

fit: class means and covariances come from exact sums over all labelled training rows (fixed-point integers, so that
the order of summation doesn't matter and reruns agree). A class covariance is shrunk towards the pooled one and towards
a multiple of the identity; its Cholesky factor is computed once and cached in the model. score: each document's
statistics are whitened with the two factors, and the score is the logistic of the difference of the log densities
(Mahalanobis distance and log determinant) plus the log ratio of the classes.

The statistics are of the whole text: words and their lengths, case, symbols, digits, punctuation, lines, repetition.
Language, source, ids and labels are no inputs. A null text counts as empty; an empty text has the statistics of zero
words and gets a score like any other. Labels: rows without id or quality are left out; an id with several labels counts
with the smallest. An id with several texts counts with each. Without two labelled classes, every score is the share of
good labels (1 where there are none). An empty table gives an empty result. Columns other than doc_id and text are not looked at by classify,
and carried along by accepted. Long texts are taken whole, one at a time. Different words and trigrams are counted by 40 bits of their hashes.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.shared import lean, materialize, slices, text_bytes, words_of

#: A text's rates are taken as if so many bytes and words of ordinary prose stood beside it: rates of short texts say little.
PRIOR_BYTES, PRIOR_WORDS = 200, 30
#: Rates of ordinary prose: per byte, then per word; mean and spread of word lengths, share of different trigrams.
PROSE = {"upper": 0.02, "symbols": 0.001, "exclamations": 0.0005, "bars": 0.0005, "digits": 0.002, "stops": 0.025, "lines": 0.003, "repeats": 0.005, "capitalised": 0.12, "length": 5.5, "spread": 3.0, "trigrams": 0.99, "variety": 0.96}
#: Fixed-point scale of the statistics: sums are exact in integers.
SCALE = 1 << 12
FEATURES = ("words", "word_length", "upper", "symbols", "exclamations", "bars", "digits", "stops", "repeats", "variety", "trigram_variety", "lines", "capitalised", "length_spread")


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[[ord(c) for c in chars]] = True
    return m


_UPPER, _SYMBOL, _BANG, _BAR, _DIGIT, _STOP, _LINE = (_mask(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*@^~<>=+\\{}[]_", "!", "|", "0123456789", ".,;:?", "\n"))


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of different h per doc."""
    key = np.sort((h & ~np.uint64(0xFFFFFF)) | doc.astype(np.uint64))  # a slice has less than 2**24 documents
    order = key & np.uint64(0xFFFFFF)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount(order[new].astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document, as fixed-point integers."""
    n = len(offsets) - 1
    w = words_of(data, offsets)
    size = np.diff(offsets).astype(float)
    count = np.diff(w.first).astype(float)

    def bytes_in(mask: np.ndarray, name: str) -> np.ndarray:
        at = np.flatnonzero(mask[data])
        return (np.diff(np.searchsorted(at, offsets)) + PRIOR_BYTES * PROSE[name]) / (size + PRIOR_BYTES)

    def per_word(number: np.ndarray, name: str) -> np.ndarray:
        return (number + PRIOR_WORDS * PROSE[name]) / (count + PRIOR_WORDS)

    length = (w.end - w.start).astype(float)
    mean = per_word(np.bincount(w.doc, length, n), "length")
    square = (np.bincount(w.doc, length**2, n) + PRIOR_WORDS * (PROSE["length"] ** 2 + PROSE["spread"] ** 2)) / (count + PRIOR_WORDS)
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    same = np.zeros(n)
    if len(w.hash) > 1:
        twice = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
        same = np.bincount(w.doc[twice], minlength=n)
    at, three = w.windows(3)
    trigrams = np.bincount(w.doc[at], minlength=n)
    capital = np.bincount(w.doc[np.flatnonzero(_UPPER[data[w.start]])], minlength=n)
    rare = lambda x: np.log(x + 0.003)
    columns = [
        np.log1p(count + PRIOR_WORDS),
        np.log1p(mean),
        rare(bytes_in(_UPPER, "upper")),
        rare(bytes_in(_SYMBOL, "symbols")),
        rare(bytes_in(_BANG, "exclamations")),
        rare(bytes_in(_BAR, "bars")),
        rare(bytes_in(_DIGIT, "digits")),
        rare(bytes_in(_STOP, "stops")),
        rare(per_word(same, "repeats")),
        np.log1p(_distinct(w.doc, w.hash, n) + PRIOR_WORDS * PROSE["variety"]) / np.log1p(count + PRIOR_WORDS),
        (_distinct(w.doc[at], three, n) + PRIOR_WORDS * PROSE["trigrams"]) / (trigrams + PRIOR_WORDS),
        rare(bytes_in(_LINE, "lines")),
        rare(per_word(capital, "capitalised")),
        np.log1p(spread),
    ]
    return np.rint(np.stack(columns, axis=1) * SCALE).astype(np.int64)


def with_statistics(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and stats, an array of the fixed-point statistics of the text."""
    schema = documents.select(*keep).schema.add("stats", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = statistics(*text_bytes(part.column("text")))
                stats = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), rows.ravel())
                yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [stats], names=[*keep, "stats"])

    return documents.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(lean(run), schema)


@dataclass
class Discriminant:
    """log prior ratio; per class the mean, the inverse Cholesky factor and its log determinant; without two classes only share."""

    share: float
    prior: float = 0.0
    means: tuple = ()
    factors: tuple = ()
    logdets: tuple = ()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        logs = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - mean) @ factor.T
            logs.append(-0.5 * (z * z).sum(axis=1) - logdet)
        return 1.0 / (1.0 + np.exp(-np.clip(logs[1] - logs[0] + self.prior, -500, 500)))


def fit(labelled: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.05) -> Discriminant:
    """The discriminant of all rows of labelled (stats, quality 0/1). Only sums reach the driver, a row per class and task."""
    d = len(FEATURES)

    def sums(batches):
        n, first, second = [0, 0], np.zeros((2, d), dtype=object), np.zeros((2, d * d), dtype=object)
        for batch in batches:
            x = np.array(batch.column("stats").flatten(), dtype=np.int64).reshape(-1, d)
            y = np.array(batch.column("quality"), dtype=np.int64)
            for c in (0, 1):
                rows = x[y == c]
                n[c] += len(rows)
                first[c] += rows.sum(axis=0).astype(object)
                second[c] += (rows[:, :, None] * rows[:, None, :]).sum(axis=0).ravel().astype(object)
        for c in (0, 1):
            yield pa.RecordBatch.from_pydict({"c": [c], "n": pa.array([n[c]], pa.int64()), "first": [[str(v) for v in first[c]]], "second": [[str(v) for v in second[c]]]})

    parts = labelled.select("stats", F.col("quality").cast("int").alias("quality")).mapInArrow(lean(sums), "c bigint, n bigint, first array<string>, second array<string>")
    # Sums of the tasks' rows, in exact decimals; one row per class comes back.
    def total(column):
        return F.array(*[F.sum(F.col(column)[i].cast("decimal(38,0)")) for i in range(d if column == "first" else d * d)]).cast("array<string>")

    rows = {r["c"]: r for r in parts.groupBy("c").agg(F.sum("n").alias("n"), total("first").alias("first"), total("second").alias("second")).collect() if r["n"]}
    n = [rows[c]["n"] if c in rows else 0 for c in (0, 1)]
    if min(n) < 2:
        return Discriminant(1.0 if not sum(n) else n[1] / sum(n))
    means, covs = [], []
    for c in (0, 1):
        s = np.array([int(v) for v in rows[c]["first"]], dtype=object)
        q = np.array([int(v) for v in rows[c]["second"]], dtype=object).reshape(d, d)
        exact = q * n[c] - s[:, None] * s[None, :]
        covs.append(np.array(exact / (n[c] * n[c]) / SCALE**2, dtype=float))
        means.append(np.array(s / n[c] / SCALE, dtype=float))
    pooled = sum(k * v for k, v in zip(n, covs, strict=True)) / sum(n)
    factors, logdets = [], []
    for cov in covs:
        mixed = (1 - to_pooled) * cov + to_pooled * pooled
        mixed = (1 - to_identity) * mixed + to_identity * max(np.trace(mixed) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        logdets.append(float(np.log(np.diag(lower)).sum()))
    return Discriminant(n[1] / sum(n), math.log(n[1] / n[0]), tuple(means), tuple(factors), tuple(logdets))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """stats without the column stats, with score."""
    keep = [c for c in stats.columns if c != "stats"]

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("stats").flatten(), dtype=np.int64).reshape(batch.num_rows, -1) / SCALE if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(model.score(x))], names=[*keep, "score"])

    return stats.mapInArrow(lean(run), stats.select(*keep).schema.add("score", "double"))


def held_out(column: str = "doc_id"):
    """crc32 of the id as text modulo 5 is 0."""
    return F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "utf-8")), F.lit(5)) == 0


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of all labelled rows that aren't held out."""
    known = labels.select("doc_id", "quality").dropna().filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return fit(stats.select("doc_id", "stats").join(known, "doc_id"))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents. One pass over the texts; the rest reads their statistics."""
    stats = materialize(with_statistics(documents, ["doc_id"]), "quality")
    out = scored(stats, train(stats, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of documents whose score is at least threshold. The texts stay where they are read; nothing is shuffled by text."""
    model = train(materialize(with_statistics(documents, ["doc_id"]), "quality"), labels)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = statistics(*text_bytes(part.column("text"))) / SCALE
                yield part.filter(pa.array(model.score(x) >= threshold))

    return documents.mapInArrow(lean(run), documents.schema)


def is_held_out(doc_id: int) -> bool:
    """held_out() of one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Score and prediction for every document."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
