"""Substring dedup by level-wise doubling.

Windows of few words are tested first; only what is repeated at one length is extended to twice that length (or to the
window's length, where twice would pass it), until the wanted length is reached or no candidates survive.

* The lengths are `window` halved, rounding up, while at least SHORTEST words are left (13: 7, 13), and above the window
  its doubles (26, 52, ...) as far as `longest` asks for.
* On the first level not every short window has to be tested: of the short windows in one full window, the one with the
  smallest hash is. Equal full windows hold equal short windows and so test the same one. A full window is a candidate
  on the next level if the one that it stands on survived; above that, if both of its halves did.
* A level deals hashes to partitions by value. A batch of documents asks once for each of its different windows, for its smallest
  document that has it. Other documents of the batch follow it, which decides about them there and then: their places go
  straight to the documents. So a passage that a third of all documents share sends one question per batch to its partition.
  A partition finds windows of two or more documents, and returns the places of survivors.

The removal: each word that is covered by a window of `window` words whose words also start in a document with a smaller
id goes. Windows are judged on the input. Longer repeats are covered by windows of this length, so levels above it
remove nothing more; they tell how long repeats are.

Null text has no words. Rows without an id are kept as they are and make nobody repeat. Rows that repeat an id are judged
each by its own text, none of them smaller than another: their places come back with their window's hash, and a row takes one only if its own window
there has that hash. A filter of at most FILTER_BYTES tells which ids are repeated; others that it lets through are only checked in vain. Windows are hashed with 64 bits on the levels that only choose candidates and with 128 on those that
decide, by functions without the structure of sums of powers. Long texts are taken whole, one at a time. Columns other than doc_id and text,
whatever their names, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import Words, holds, key_filter, materialize, mix, pack, parts_for, slices, stored_bytes, text_bytes, unpack, window_hashes, words_of

SHORTEST = 6
_ENTRIES = "part int, direct boolean, hashes binary, seconds binary, ids binary, places binary, many binary, again binary"
_SURVIVORS = "home int, ids binary, places binary, checks binary, later binary"
_PLACES = "doc_id bigint, alive binary, later binary, checks binary, later_checks binary"


def levels(window: int, longest: int | None = None) -> list[int]:
    """The lengths of the levels in rising order."""
    out = [window]
    while (half := -(-out[0] // 2)) >= SHORTEST:
        out.insert(0, half)
    while longest and out[-1] * 2 <= longest:
        out.append(out[-1] * 2)
    return out


def sampled(w: Words, short: int, window: int) -> np.ndarray:
    """First words of the short windows that full windows stand on: the smallest hash in each, the leftmost of equal ones."""
    at, _ = w.windows(window)
    return np.unique(anchors(w, short, window)[1]) if len(at) else at


def anchors(w: Words, short: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each full window the first word, and the first word of the short window that it stands on."""
    at, _ = w.windows(window)
    h = window_hashes(w.hash, short)
    if not len(at):
        return at, at
    n = len(h) - (window - short)
    best, where = h[:n].copy(), np.arange(n)
    for k in range(1, window - short + 1):
        less = h[k : k + n] < best
        best[less] = h[k : k + n][less]
        where[less] = np.flatnonzero(less) + k
    return at, where[at]


def true_places(w: Words, places: list[np.ndarray], checks: list[np.ndarray], length: int) -> np.ndarray:
    """Of each word whether a window of length starts there that is among places, a list by document, with its check: its hash or 0."""
    h, flag = window_hashes(w.hash, length), np.zeros(len(w.hash) + 1, dtype=bool)
    for i, (p, c) in enumerate(zip(places, checks, strict=True)):
        at = p + w.first[i]
        ok = at + length <= w.first[i + 1]
        at, c = at[ok], c[ok]
        flag[at[(c == 0) | (h[at] == c)]] = True
    return flag


def candidates(w: Words, alive: np.ndarray | None, before: int, length: int, window: int) -> np.ndarray:
    """First words of the windows to test at a length, from the survivors (a flag by word) of the level before."""
    if alive is None:
        return sampled(w, length, window) if length < window else w.windows(length)[0]
    if before < window:
        if length >= window:
            at, on = anchors(w, before, window)
            return at[alive[on]]
        at = w.windows(length)[0]  # between the first level and the window, short windows near a survivor
        near = np.convolve(alive.astype(np.int64), np.ones(2 * window, np.int64))
        return at[near[np.minimum(at + window - 1, len(near) - 1)] > 0]
    at = w.windows(length)[0]
    return at[alive[at] & alive[at + (length - before)]]


def _lists(batch, column: str, dtype) -> list[np.ndarray]:
    return [unpack(b, dtype) if b else np.zeros(0, dtype) for b in batch.column(column).to_pylist()]


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _homes(d: np.ndarray, homes: int) -> np.ndarray:
    return (mix(d.view(np.uint64), 10) % np.uint64(homes)).astype(np.int64)


def _send(documents: DataFrame, length: int, before: int, window: int, parts: int, repeated) -> DataFrame:
    """Entries of one level: of each batch its different windows with their smallest document, by partition of the hash.

    repeated: a filter of the ids that several rows have.
    """
    given, decides = "alive" in documents.columns, length >= window

    def run(batches):
        names = ["part", "direct", "hashes", "seconds", "ids", "places", "many", "again"]
        schema = pa.schema([("part", pa.int32()), ("direct", pa.bool_()), *((n, pa.binary()) for n in names[2:])])
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            h, h2, d, p = [], [], [], []
            for part in slices(batch):
                w = words_of(*text_bytes(part.column("text")))
                alive = true_places(w, _lists(part, "alive", np.int32), _lists(part, "checks", np.uint64), before) if given else None
                at = candidates(w, alive, before, length, window)
                if len(at):
                    h.append(window_hashes(w.hash, length)[at])
                    h2.append(window_hashes(w.second(), length)[at] if decides else np.zeros(len(at), np.uint64))
                    d.append(np.array(part.column("doc_id"), np.int64)[w.doc[at]])
                    p.append((at - w.first[w.doc[at]]).astype(np.int32))
            if not h:
                continue
            h, h2, d, p = (np.concatenate(x) for x in (h, h2, d, p))
            order = np.lexsort((p, d, h2, h))
            h, h2, d, p = (x[order] for x in (h, h2, d, p))
            new = np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))
            head, group = np.flatnonzero(new), np.cumsum(new) - 1
            follows = d > d[head][group]
            many = np.logical_or.reduceat(follows, head)[group]
            again = np.zeros(len(d), dtype=bool)
            again[holds(repeated, d.view(np.uint64))] = True
            out = {n: [] for n in names}
            # Questions go to the partition of their hash; those that follow need no answer and are spread by document.
            for direct, chosen in ((False, np.flatnonzero(~follows)), (True, np.flatnonzero(follows))):
                where = (mix(h[chosen], 9) % np.uint64(parts)).astype(np.int64) if not direct else _homes(d[chosen], parts)
                by = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[by], np.arange(parts + 1))
                for k in np.flatnonzero(np.diff(cuts)):
                    i = chosen[by[cuts[k] : cuts[k + 1]]]
                    first = pack(np.where(again[i], h[i], np.uint64(0))) if direct else h[i].tobytes()
                    second = h2[i].tobytes() if decides and not direct else b""
                    for n, v in zip(names, (int(k), direct, first, second, pack(d[i]), pack(p[i]), np.packbits(many[i]).tobytes(), np.packbits(again[i]).tobytes()), strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    return documents.select("doc_id", "text", *(["alive", "checks"] if given else [])).mapInArrow(run, _ENTRIES)


def _repeated(entries: DataFrame, parts: int, homes: int, only_later: bool) -> DataFrame:
    """Rows (doc_id, places and hashes of survivors): windows that two or more documents hold; later: not the first of them."""

    def survivors(d, p, c, later):
        home = _homes(d, homes)
        by = np.lexsort((p, d, home))
        cuts = np.searchsorted(home[by], np.arange(homes + 1))
        for x in np.flatnonzero(np.diff(cuts)):
            i = by[cuts[x] : cuts[x + 1]]
            yield pa.RecordBatch.from_pydict({"home": pa.array([x], pa.int32()), "ids": [pack(d[i])], "places": [pack(p[i])], "checks": [pack(c[i])], "later": [np.packbits(later[i]).tobytes()]})

    def run(batches):
        asked = []
        for batch in batches:
            for direct, h, h2, d, p, *flags in zip(*(batch.column(c).to_pylist() for c in ("direct", "hashes", "seconds", "ids", "places", "many", "again")), strict=True):
                d, p = unpack(d, np.int64), unpack(p, np.int32)
                if direct:
                    yield from survivors(d, p, unpack(h, np.uint64), np.ones(len(d), dtype=bool))
                else:
                    second = np.frombuffer(h2, np.uint64) if h2 else np.zeros(len(d), np.uint64)
                    asked.append((np.frombuffer(h, np.uint64), second, d, p, *(_bits(f, len(d)) for f in flags)))
        if not asked:
            return
        h, h2, d, p, many, again = (np.concatenate(x) for x in zip(*asked, strict=True))
        del asked
        order = np.lexsort((h2, h))
        h, h2, d, p, many, again = (x[order] for x in (h, h2, d, p, many, again))
        new = np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.minimum.reduceat(d, head)
        shared = (np.maximum.reduceat(d, head) > least) | np.logical_or.reduceat(many, head)
        later = d > least[group]
        keep = later if only_later else shared[group]
        yield from survivors(d[keep], p[keep], np.where(again, h, np.uint64(0))[keep], later[keep])

    def gather(batches):
        got = []
        for batch in batches:
            for d, p, c, later in zip(*(batch.column(n).to_pylist() for n in ("ids", "places", "checks", "later")), strict=True):
                d = unpack(d, np.int64)
                got.append((d, unpack(p, np.int32), unpack(c, np.uint64), _bits(later, len(d))))
        if not got:
            return
        d, p, c, later = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((p, d))
        d, p, c, later = (x[order] for x in (d, p, c, later))
        ids, first = np.unique(d, return_index=True)
        first = np.append(first, len(d))
        for i in range(0, len(ids), 4096):
            cut = list(zip(first[i : i + 4096], first[i + 1 : i + 4097], strict=False))
            body = lambda f: pa.array([pack(f(a, b)) for a, b in cut], pa.binary())  # noqa: E731, B023
            all_ = [body(lambda a, b: p[a:b]), body(lambda a, b: p[a:b][later[a:b]]), body(lambda a, b: c[a:b]), body(lambda a, b: c[a:b][later[a:b]])]
            if only_later:
                all_[0] = all_[2] = pa.nulls(len(cut), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 4096]), *all_], names=["doc_id", "alive", "later", "checks", "later_checks"])

    sent = entries.repartitionById(parts, F.col("part")).mapInArrow(run, _SURVIVORS)
    return sent.repartitionById(homes, F.col("home")).mapInArrow(gather, _PLACES)


def repeats(documents: DataFrame, window: int = 13, longest: int | None = None) -> DataFrame:
    """Rows of documents (doc_id, text) with later: packed first words of the windows that an earlier document has too.

    longest: go on above the window; then the column length tells the longest level at which a window of the document survived.
    """
    size = stored_bytes(documents)
    parts, homes = parts_for(size, 4 << 20, 16), parts_for(size, 8 << 20, 16)
    ids = documents.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    repeated = key_filter(materialize(ids.filter("count > 1").select("doc_id"), "repeated"))
    rows, before, out, reached = documents, 0, None, []
    steps = levels(window, longest)
    for length in steps:
        last = length == steps[-1]
        found = _repeated(_send(rows, length, before, window, parts, repeated), parts, homes, only_later=last and not longest)
        if length == window:
            out = found
        if length >= window and longest:
            found = materialize(found, "level")
            reached.append((length, found.select("doc_id", "alive", "checks")))
        if last or length >= window and found.filter("length(alive) > 0").isEmpty():
            break
        rows, before = documents.join(found.select("doc_id", "alive", "checks"), "doc_id", "inner" if length >= window else "left"), length
    result = documents.join(out.select("doc_id", "later", "later_checks"), "doc_id", "left")
    if longest:
        levels_of = reached[0][1].select("doc_id", F.lit(reached[0][0]).alias("length"))
        for length, found in reached[1:]:
            levels_of = levels_of.unionByName(found.select("doc_id", F.lit(length).alias("length")))
        result = result.join(levels_of.groupBy("doc_id").agg(F.max("length").alias("length")), "doc_id", "left")
    return result


def without(w: Words, later: list[np.ndarray], checks: list[np.ndarray], window: int) -> np.ndarray:
    """Of each word whether it stays: words that a window of later covers go."""
    begins = true_places(w, later, checks, window).astype(np.int64)
    cover = begins.copy()
    cover[window:] -= begins[:-window]
    return np.cumsum(cover)[:-1] == 0


def deduplicate(documents: DataFrame, window: int = 13, longest: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a blank) of each row."""
    found = repeats(documents.select("doc_id", "text"), window, longest)
    more = ["length"] if longest else []

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = words_of(*text_bytes(part.column("text")))
                stays = without(w, _lists(part, "later", np.int32), _lists(part, "later_checks", np.uint64), window)
                kept, raw = [], w.data.tobytes()
                for i in range(part.num_rows):
                    a, b = w.first[i], w.first[i + 1]
                    at = np.flatnonzero(stays[a:b]) + a
                    kept.append(b" ".join(raw[s:e] for s, e in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)).decode())
                n = np.diff(w.first)
                removed = n - (np.bincount(w.doc[stays], minlength=part.num_rows) if len(w.doc) else 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *[part.column(c) for c in more]], names=["doc_id", "n_words", "n_removed", "kept", *more])

    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string" + ", length int" * bool(longest))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    """All documents without words that earlier documents have in a passage of 13 words."""
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM h),
c AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE first < doc_id) GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
"""
