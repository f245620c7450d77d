"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

1. Texts and items are cut to words: A-Z in lower case, white space and ASCII punctuation between words.
2. The n-grams are pairs of words, next to each other or with one word between them: (w[i], w[i+1]) and (w[i], w[i+2]) start
   at i. A pair agrees whatever stands between, so words that were put in, left out or replaced don't hide it.
3. One pass over the texts counts in how many documents each n-gram of the benchmark stands. An item's seeds are the n-grams of
   its rare starts: all starts without the need - m most common ones, m being SEEDS, or need if that is less.
4. A second pass finds the seeds in the texts, and a join on the seed gives pairs of documents and items with the places
   where they meet. Each pair with the seeds of m starts as near each other as an alignment reaches is a candidate, whatever else it shares.
5. Passages around these places that hold enough of the item's words are aligned with it word by word (match 2, mismatch -1,
   gap -1, local); a score of at least `threshold` of a full match is contamination.

No such passage is missed. If m words match and edits cost e, 2 m - e is at least 2 t L (t the threshold, L the item's words). Of
the m - 1 neighbours among the matches, those that are no n-gram on one side or the other cost 2 or more each: at most e / 2 <= m - t L.
So at least need = ceil(t L) - 1 of the item's starts are in the passage, and without the need - m most common ones m are left. An
item that many documents copy keeps its seeds, because they are chosen by rank and not by a cut-off. Where one word is
enough (t L <= 1), single words are the seeds. An alignment reaches over (3 - 2 t) L words at most, which bounds the passage.

The texts are scanned twice, and a third time for documents with candidates, whatever the size of the benchmark. Tasks
hold filters of n-grams and ids of at most `block_bytes`; what they let through is joined with the exact tables.

Null or empty texts and items match nothing. Repeated rows of an item count once, and an item_id with several texts gives its
best score. Rows that repeat a doc_id give one result per id and item, the best of them; rows without one can't be named and give none. Long
texts are taken whole, one at a time. doc_id and item_id have any type; other columns play no part, whatever their names.
Empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from spanloom.llm.shared import FILTER_BYTES, holds, join_hashes, key_filter, lean, materialize, mix, parts_for, slices, text_bytes, words_of
from spanloom.llm.sharding import row_numbers

MATCH, MISMATCH, GAP = 2, -1, -1
#: Rare starts that a candidate shares with its item.
SEEDS = 3
#: Alignments that one task makes.
ALIGNMENTS = 2000


def pairs_of(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the n-grams: each word with the next one and with the one after that, in one document."""
    at, h = [], []
    for gap in (1, 2):
        start = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else np.zeros(0, np.int64)
        at.append(start)
        h.append(mix(join_hashes(words[start], words[start + gap]), 51))
    return np.concatenate(at), np.concatenate(h)


def grams_of(words: np.ndarray, doc: np.ndarray, singles: bool) -> tuple[np.ndarray, np.ndarray]:
    """pairs_of and, with singles, all words as n-grams of one word."""
    at, h = pairs_of(words, doc)
    return (np.concatenate([at, np.arange(len(words))]), np.concatenate([h, mix(words, 52)])) if singles else (at, h)


def needed(length: int, threshold: float) -> int:
    """Starts of an item of so many words that a passage of the threshold's score holds at least; 0: one word is enough."""
    return max(0, math.ceil(threshold * length - 1e-9) - 1)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """The best local alignment score of a in b, and where in b it ends."""
    steps = -GAP * np.arange(len(b) + 1, dtype=np.int64)
    above, best, end = np.zeros(len(b) + 1, np.int64), 0, 0
    for x in a:
        row = np.zeros(len(b) + 1, np.int64)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(b == x, MATCH, MISMATCH), above[1:] + GAP))
        above = np.maximum.accumulate(row + steps) - steps
        if (m := int(above.max())) > best:
            best, end = m, int(above.argmax())
    return best, end


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many words of a can be matched with different words of b."""
    words, count = np.unique(a, return_counts=True)
    at = np.searchsorted(words, b)
    at[at == len(words)] = 0
    return int(np.minimum(count, np.bincount(at[words[at] == b], minlength=len(words))).sum())


def span_of(length: int, threshold: float) -> int:
    """The most words of a text that an alignment of the threshold's score with an item of so many words reaches over."""
    return math.ceil((3 - 2 * threshold) * length) + 2


def passages_of(at: np.ndarray, start: np.ndarray, span: int, least: int) -> tuple[list[int], list[int]]:
    """(first words, ends) of the passages around places at which least different starts meet the item within a span."""
    order = np.argsort(at, kind="stable")
    at, start = at[order], start[order]
    low, high = [], []
    for i, j in enumerate(np.searchsorted(at, at + span, side="right")):
        if len(np.unique(start[i:j])) >= least:
            a, b = max(0, int(at[i]) - span), int(at[i]) + 2 * span + 1
            if high and a <= high[-1]:
                high[-1] = b
            else:
                low.append(a)
                high.append(b)
    return low, high


def best_score(test: np.ndarray, words: np.ndarray, threshold: float) -> tuple[float, int]:
    """The best score in words as a share of a full match, and where it begins; (0, 0) below threshold."""
    if common_words(test, words) < threshold * len(test) - 1e-9:
        return 0.0, 0
    score, end = align(test, words)
    full = MATCH * len(test)
    return (score / full, max(0, end - len(test))) if score >= threshold * full - 1e-9 else (0.0, 0)


def item_table(benchmark: DataFrame) -> DataFrame:
    """no, item_id and words (packed hashes) of the different items that have words."""
    tests = benchmark.select("item_id", "text").filter("text is not null").distinct()
    numbered = materialize(row_numbers(tests, ["text", "item_id"], "no", tests.count()).select("no", "item_id", "text"), "items")

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                w = words_of(*text_bytes(part.column("text")), lower=True, plain=True)
                bodies = [w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                out = pa.RecordBatch.from_arrays([part.column("no"), part.column("item_id"), pa.array(bodies, pa.binary())], names=["no", "item_id", "words"])
                yield out.filter(pa.array(np.diff(w.first) > 0))

    return materialize(numbered.mapInArrow(lean(cut), numbered.select("no", "item_id").schema.add("words", "binary")), "words")


def item_grams(items: DataFrame, threshold: float) -> DataFrame:
    """no, start, gram, keep (how many starts are seeds), least (how many of them a candidate shares) and span of all n-grams of all items."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for no, body in zip(batch.column("no").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words = np.frombuffer(body, np.uint64)
                need = needed(len(words), threshold)
                at, h = pairs_of(words, np.zeros(len(words), np.int64)) if need else (np.arange(len(words)), mix(words, 52))
                least = max(1, min(need, SEEDS))
                keep = len(words) - 1 - (need - least) if need else len(words)
                for column, v in zip(out, (np.full(len(at), no), at, h.view(np.int64), np.full(len(at), keep), np.full(len(at), least), np.full(len(at), span_of(len(words), threshold))), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c or [np.zeros(0, np.int64)]).astype(np.int64)) for c in out], names=["no", "start", "gram", "keep", "least", "span"])

    return items.select("no", "words").mapInArrow(lean(run), "no bigint, start bigint, gram bigint, keep bigint, least bigint, span bigint")


def _schema(documents: DataFrame, *columns: str) -> StructType:
    schema = StructType([documents.schema["doc_id"]])
    for c in columns:
        schema = schema.add(*c.split())
    return schema


def frequencies(documents: DataFrame, marks: list[np.ndarray], singles: bool) -> DataFrame:
    """gram and n: in how many documents the n-grams that the filter lets through stand."""

    def run(batches):
        for batch in batches:
            found = []
            for part in slices(batch):
                w = words_of(*text_bytes(part.column("text")), lower=True, plain=True)
                at, h = grams_of(w.hash, w.doc, singles)
                ok = holds(marks, h)
                both = np.unique(np.stack([w.doc[at[ok]].astype(np.uint64), h[ok]]), axis=1)
                found.append(both[1])
            grams, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return documents.select("text").mapInArrow(lean(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def rare_seeds(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, no, start, least and span of the n-grams of each item's rare starts."""
    known = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = known.groupBy("no", "start", "keep", "least", "span").agg(F.max("n").alias("n"), F.collect_list("gram").alias("grams"))
    rank = F.row_number().over(Window.partitionBy("no").orderBy("n", "start"))
    return starts.withColumn("rank", rank).filter("rank <= keep").select("no", "start", "least", "span", F.explode("grams").alias("gram")).distinct()


def seed_hits(documents: DataFrame, marks: list[np.ndarray], singles: bool) -> DataFrame:
    """doc_id, gram and at (word) of the n-grams that the filter lets through."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = words_of(*text_bytes(part.column("text")), lower=True, plain=True)
                at, h = grams_of(w.hash, w.doc, singles)
                ok = holds(marks, h)
                doc = w.doc[at[ok]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(h[ok].view(np.int64)), pa.array((at[ok] - w.first[doc]).astype(np.int32))], names=["doc_id", "gram", "at"])

    return documents.select("doc_id", "text").mapInArrow(lean(run), _schema(documents, "gram long", "at integer"))


def words_by_document(documents: DataFrame, marks: list[np.ndarray]) -> DataFrame:
    """doc_id and words (packed hashes) of the documents whose ids the filter lets through."""

    def run(batches):
        for batch in batches:
            chosen = batch.take(pa.array(holds(marks, np.array(batch.column("_key"), np.int64).view(np.uint64))))
            for part in slices(chosen):
                w = words_of(*text_bytes(part.column("text")), lower=True, plain=True)
                bodies = [w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bodies, pa.binary())], names=["doc_id", "words"])

    return documents.select("doc_id", "text", F.xxhash64("doc_id").alias("_key")).mapInArrow(lean(run), _schema(documents, "words binary"))


def near_seeds(shared: DataFrame) -> DataFrame:
    """doc_id, no, lows, highs (passages) and seeds (hits) of pairs with enough starts near each other."""

    def run(batches):
        for batch in batches:
            lows, highs, seeds = [], [], []
            for hits, span, least in zip(*(batch.column(c).to_pylist() for c in ("hits", "span", "least")), strict=True):
                low, high = passages_of(np.array([h["at"] for h in hits], np.int64), np.array([h["start"] for h in hits], np.int64), span, least)
                lows.append(low)
                highs.append(high)
                seeds.append(len(hits))
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("no"), pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64())), pa.array(seeds, pa.int32())], names=["doc_id", "no", "lows", "highs", "seeds"])
            yield out.filter(pa.array([bool(x) for x in lows], pa.bool_()))

    schema = shared.select("doc_id", "no").schema.add("lows", ArrayType(LongType())).add("highs", ArrayType(LongType())).add("seeds", "integer")
    return shared.select("doc_id", "no", "hits", "span", "least").mapInArrow(lean(run), schema)


def cut_passages(found: DataFrame) -> DataFrame:
    """doc_id, no, seeds, low and words: the passages of documents' words, without the rest of the text."""

    def run(batches):
        for batch in batches:
            row, low, words = [], [], []
            for i, (body, lows, highs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("words", "lows", "highs")), strict=True)):
                for a, b in zip(lows, highs, strict=True):
                    if part := body[8 * a : 8 * b]:
                        row.append(i)
                        low.append(a)
                        words.append(part)
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "no", "seeds")), pa.array(low, pa.int64()), pa.array(words, pa.binary())], names=["doc_id", "no", "seeds", "low", "words"])

    return found.select("doc_id", "no", "seeds", "lows", "highs", "words").mapInArrow(lean(run), found.select("doc_id", "no", "seeds").schema.add("low", "long").add("words", "binary"))


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, item_id, score (share of a full match), start_word and shared_seeds of the best passage; a row per pair."""
    documents = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    items = item_table(benchmark)
    grams = materialize(item_grams(items, threshold), "grams")
    singles = bool(items.filter(F.octet_length("words") / 8 * threshold <= 1).count())
    counts = materialize(frequencies(documents, key_filter(grams.select("gram").distinct(), most_bytes=block_bytes), singles), "frequencies")
    seeds = materialize(rare_seeds(grams, counts), "seeds")
    hits = seed_hits(documents, key_filter(seeds.select("gram").distinct(), most_bytes=block_bytes), singles).join(seeds, "gram")
    shared = hits.groupBy("doc_id", "no", "least", "span").agg(F.collect_set("start").alias("starts"), F.collect_list(F.struct("at", "start")).alias("hits"))
    places = materialize(near_seeds(shared.filter(F.size("starts") >= F.col("least"))), "places")
    chosen = places.select(F.xxhash64("doc_id").alias("key")).distinct()
    texts = words_by_document(documents, key_filter(chosen, 16, 1, block_bytes))
    passages = materialize(cut_passages(texts.join(places, "doc_id")), "passages")
    pairs = passages.join(items.select("no", F.col("words").alias("test")), "no")

    def run(batches):
        for batch in batches:
            score, start = [], []
            for body, test, low in zip(*(batch.column(c).to_pylist() for c in ("words", "test", "low")), strict=True):
                s, a = best_score(np.frombuffer(test, np.uint64), np.frombuffer(body, np.uint64), threshold)
                score.append(s)
                start.append(low + a)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("no"), pa.array(score, pa.float64()), pa.array(start, pa.int64()), batch.column("seeds")], names=["doc_id", "no", "score", "start_word", "shared_seeds"])
            yield out.filter(pa.array(np.array(score) > 0, pa.bool_()))

    dealt = pairs.select("doc_id", "no", "low", "seeds", "words", "test").repartition(parts_for(passages.count(), ALIGNMENTS, 8), "doc_id", "no", "low")
    scored = dealt.mapInArrow(lean(run), _schema(documents, "no long", "score double", "start_word long", "shared_seeds integer"))
    best = scored.join(items.select("no", "item_id"), "no").groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("start_word")).alias("start"), "shared_seeds")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.start")).alias("start_word"), "b.shared_seeds")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items that they hold, exactly or edited."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
