"""N-gram Jaccard join with set-relation skipping, and the components of its links.

A document's set holds its different word shingles. Two documents link when the Jaccard similarity of their sets is at
least `percent` / 100. The join is exact up to collisions of shingle hashes (58 bits to find candidates, 64 to verify
them; not sums of powers, so texts in an unlucky order don't agree): no link between components is lost.

1. Documents with equal sets are one class and join as one set, whose answers hold for all members.
2. Each set is ordered by one global order, rare shingles first; rarity is an array of counters, in number by the size of the data,
   that counts every shingle of every document. The order affects speed only. The first |x| - ceil(t |x|) + 1 shingles are indexed.
3. Answers of highly similar sets first: sets that agree on the two smallest hashes of a hash range are compared with
   the smallest id among them. Links found so give components, which are known when the index is read.
4. The index lists (set, size, position) by shingle and, in a list, in blocks by position. A pair whose first common
   shingle stands at positions i and j has at least i + j elements that are not shared, and must have at most
   (|x| + |y|) (1 - t) / (1 + t): so later blocks are skipped whole. Sets of one component are skipped too, a list of one
   component as a whole: their answers are derived from the similar sets' computed ones and could add no component.
5. A set that was compared with such a smallest set X is in X's family, and its differences from X are its edits. For two
   sets w and y of one family without a common edit, J(w, y) is at most J(X, w) and J(X, y): all of X is in w or y, and
   nothing else in both. So if they link, both link with X, which is known; only pairs of a family that share an edit
   are compared, and the index skips pairs of one family. Two sets differ by the symmetric difference of their edits, so
   edits are indexed like shingles, rare ones first, and the bound on positions i + j holds for them too.
   In both indices the two rests behind i and j differ in number, and as many more elements are not shared: near copies that
   each changed the same place of X to something of their own share a frequent edit behind their rare ones, and are no pair.
6. Pairs that remain are bounded by their indexed shingles (whatever is in one's part of the order and not in the other's is not
   shared) and then verified with the whole sets.

So a group of near copies gives a link per member and not per pair. The list of a hot shingle is split: its sets are dealt to groups,
and each two groups meet in a list of their own.

Each row is a document of its own, also where rows repeat an id: equal texts are one class, different ones have their own
links, and a component's id is the smallest id of its rows. Null and empty texts have no shingles and link with nothing.
Texts with fewer words than a shingle have one, their whole sequence. Rows without an id keep their class's component, or
null, and link nobody. Long texts are taken whole, one at a time. Columns other than doc_id and text play no part, whatever
their names. An empty table gives an empty result.

Only two filters of bounded size pass through the driver: the shingle counters (4 bytes for each of at most 2**MOST_COUNTERS)
and the ids that take part in a verification (at most FILTER_BYTES; more ids only let more sets through).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.sharding import row_numbers
from spanloom.llm.shared import discard, holds, key_filter, lean, materialize, merge_pieces, mix, pack, parts_for, pieces_of, scratch, slices, stored_bytes, text_bytes, unpack, window_hashes, words_of

#: Numbers of counters, as powers of two, and the bytes of stored data for each.
LEAST_COUNTERS, MOST_COUNTERS, COUNTED_BYTES = 20, 24, 4096
#: Lists of shingles of a higher level (twice as many documents for each) are split.
HOT_LEVEL = 14
SIGNATURES = 8


# --- sets ----------------------------------------------------------------------------------------------------------


def shingle_sets(part: pa.RecordBatch, k: int):
    """The hashes of the shingles of each row, not yet made different."""
    w = words_of(*text_bytes(part.column("text")), lower=True)
    at, h = w.windows(k)
    bounds = np.searchsorted(at, w.first)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            yield h[a:b]
        else:
            own = w.hash[w.first[i] : w.first[i + 1]]
            yield window_hashes(own, len(own)) if len(own) else h[:0]


def ranked(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order: tokens of 6 bits of rarity and 58 bits of hash."""
    level = levels[h & np.uint64(len(levels) - 1)].astype(np.uint64)
    return np.unique((level << np.uint64(58)) | (h >> np.uint64(6)))


def fingerprint(h: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that tell sets of different hashes apart."""
    return mix(h, 3).sum(dtype=np.uint64), mix(h, 4).sum(dtype=np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def counters_for(size: int) -> int:
    """The number of counters for so many bytes of stored data."""
    return 1 << min(MOST_COUNTERS, max(LEAST_COUNTERS, math.ceil(math.log2(max(1, size) / COUNTED_BYTES))))


def rarity(frame: DataFrame, hashes, counters: int) -> np.ndarray:
    """A level 0..40 by counter: the bit length of its count over all hashes that hashes(batch) gives in runs."""

    def run(batches):
        counts = np.zeros(counters, np.int64)
        for batch in batches:
            for h in hashes(batch):
                counts += np.bincount(h & np.uint64(counters - 1), minlength=counters)
        yield pieces_of(np.minimum(counts, 2**31 - 1).astype(np.int32))

    counts = merge_pieces(frame.mapInArrow(lean(run), "piece int, body binary"), counters, lambda a, b: np.minimum(a.astype(np.int64) + b, 2**31 - 1).astype(np.int32))
    return np.ceil(np.log2(counts.astype(float) + 1)).astype(np.uint8)


def shingle_rarity(documents: DataFrame, k: int, counters: int) -> np.ndarray:
    """The levels of all shingles of all documents."""

    def hashes(batch):
        for part in slices(batch):
            yield words_of(*text_bytes(part.column("text")), lower=True).windows(k)[1]

    return rarity(documents.select("text"), hashes, counters)


def edit_rarity(family: DataFrame, counters: int) -> np.ndarray:
    """The levels of all edits (column prefix)."""

    def hashes(batch):
        yield np.concatenate([np.frombuffer(b, np.uint64) for b in batch.column("prefix").to_pylist()] or [np.zeros(0, np.uint64)])

    return rarity(family.select("prefix"), hashes, counters)


def describe_sets(documents: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n, f1 and f2 (fingerprint of the set), prefix, signatures; n 0 for documents without shingles."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, f1, f2, prefix, keys = [], [], [], [], []
                for h in shingle_sets(part, k):
                    h = np.unique(h)
                    s = ranked(h, levels)
                    n.append(len(h))
                    one, two = fingerprint(h)
                    f1.append(one)
                    f2.append(two)
                    m = np.sort(mix(h, 7))
                    prefix.append(s[: prefix_length(len(s), percent)].tobytes() if len(s) else b"")
                    cut = np.searchsorted(m, (np.arange(SIGNATURES, dtype=np.uint64) << np.uint64(61)))
                    at = cut[np.diff(np.append(cut, len(m))) > 1]
                    keys.append((m[at] + mix(m[at + 1], 5)).view(np.int64) if len(at) else m[:0].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int32()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(prefix, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "f1", "f2", "prefix", "keys"],
                )

    return documents.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, n int, f1 bigint, f2 bigint, prefix binary, keys array<bigint>")


# --- candidates ----------------------------------------------------------------------------------------------------


def similar_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a the smallest id of those that share a signature with b, a's size possible for b."""
    keyed = sets.select("id", "n", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("members")).filter("members > 1").select("key", F.col("head.id").alias("a"), F.col("head.n").alias("na"))
    fits = (F.least("n", "na") * 100 >= F.greatest("n", "na") * percent) & (F.col("a") != F.col("id"))
    return keyed.join(heads, "key").filter(fits).select("a", F.col("id").alias("b")).distinct()


def index_pairs(sets: DataFrame, parts: int, percent: int, levels: np.ndarray | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of different components and families (id, comp, fam, n, prefix) that share an indexed element early enough.

    levels: puts the elements of prefix, which are all that there are, in their global order here; otherwise they are in it, the first ones of n.
    """
    names = ["part", "token", "ids", "comps", "fams", "sizes", "places", "totals", "sides"]

    def post(batches):
        for batch in batches:
            n = np.array(batch.column("n"), np.int64)
            body = [np.frombuffer(b, np.uint64) for b in batch.column("prefix").to_pylist()]
            body = body if levels is None else [ranked(b, levels) for b in body]
            count = np.array([len(b) for b in body], np.int64)
            if not count.sum():
                continue
            token = np.concatenate(body)
            row = np.repeat(np.arange(len(body)), count)
            place = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
            ids, comps, fams = (np.array(batch.column(c), np.int64) for c in ("id", "comp", "fam"))
            token, row, place, side = spread(token, row, place, ids)
            part = (mix(token, 6) % np.uint64(parts)).astype(np.int64)
            total = n if levels is None else count
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = {c: [] for c in names}
            for p in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[p] : cuts[p + 1]]
                r = row[at]
                for c, v in zip(names, (int(p), token[at].tobytes(), pack(ids[r]), pack(comps[r]), pack(fams[r]), pack(n[r].astype(np.int32)), pack(place[at].astype(np.int32)), pack(total[r].astype(np.int32)), side[at].tobytes()), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in names[1:])]))

    def read(batches):
        got = [[] for _ in names[1:]]
        for batch in batches:
            for g, c, kind in zip(got, names[1:], (np.uint64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8), strict=True):
                for b in batch.column(c).to_pylist():
                    g.append(np.frombuffer(b, kind) if c in ("token", "sides") else unpack(b, kind))
        if not got[0]:
            return
        token, ids, comps, fams, sizes, places, totals, sides = (np.concatenate(g) for g in got)
        seen = np.zeros(0, dtype=[("a", np.int64), ("b", np.int64)])
        waiting: list[np.ndarray] = []
        for a, b in skipping_pairs(token, ids, comps, fams, sizes.astype(np.int64), places.astype(np.int64), percent, sides, totals.astype(np.int64)):
            found = np.zeros(len(a), dtype=seen.dtype)
            found["a"], found["b"] = np.minimum(a, b), np.maximum(a, b)
            waiting.append(np.unique(found))
            if sum(map(len, waiting)) > 500_000:
                seen = np.unique(np.concatenate([seen, *waiting]))
                waiting = []
        seen = np.unique(np.concatenate([seen, *waiting])) if waiting else seen
        for i in range(0, len(seen), 50_000):
            yield pa.RecordBatch.from_pydict({"a": seen["a"][i : i + 50_000].copy(), "b": seen["b"][i : i + 50_000].copy()})

    posted = sets.select("id", "comp", "fam", "n", "prefix").mapInArrow(lean(post), "part int, token binary, ids binary, comps binary, fams binary, sizes binary, places binary, totals binary, sides binary")
    return posted.repartitionById(parts, F.col("part")).mapInArrow(lean(read), "a bigint, b bigint").distinct()


def spread(token, row, place, ids):
    """Postings with those of hot elements dealt anew: (token, row, place, side).

    The sets of a hot element are in groups, twice as many for each level above HOT_LEVEL. A posting goes to the list of
    its group, where side is 0, and to one for each other group, where the sides 1 and 2 of the two groups meet.
    """
    hot = np.flatnonzero((token >> np.uint64(58)) > HOT_LEVEL)
    side = np.zeros(len(token), np.uint8)
    if not len(hot):
        return token, row, place, side
    groups = np.left_shift(1, (token[hot] >> np.uint64(58)).astype(np.int64) - HOT_LEVEL)
    again = np.repeat(hot, groups)
    other = np.arange(len(again)) - np.repeat(np.cumsum(groups) - groups, groups)
    own = (mix(ids[row[again]].view(np.uint64), 13) % np.repeat(groups, groups).astype(np.uint64)).astype(np.int64)
    name = mix(token[again] ^ mix((np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64), 14), 15)
    cold = np.ones(len(token), dtype=bool)
    cold[hot] = False
    sides = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8)
    return (np.concatenate([x[cold], y]) for x, y in ((token, name), (row, row[again]), (place, place[again]), (side, sides)))


def skipping_pairs(token, ids, comps, fams, sizes, places, percent: int, sides=None, totals=None):
    """Arrays of pairs (a, b) of different components and families from index lists, by blocks of positions.

    sides: where they are not 0, only pairs of different sides are wanted. totals: how many elements each one's order has, if not its size; what
    follows the places can't have more in common than the shorter rest.
    """
    sides = np.zeros(len(token), np.uint8) if sides is None else sides
    totals = sizes if totals is None else totals
    order = np.lexsort((sizes, places, token))
    token, ids, comps, fams, sizes, places, sides, totals = (v[order] for v in (token, ids, comps, fams, sizes, places, sides, totals))
    rests = totals - places
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    if not len(starts):
        return
    length = np.diff(np.append(starts, len(token)))
    one = (np.minimum.reduceat(comps, starts) == np.maximum.reduceat(comps, starts)) | (np.minimum.reduceat(fams, starts) == np.maximum.reduceat(fams, starts))
    left = 100 - percent

    def fits(x, y):
        small, large = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
        return (comps[x] != comps[y]) & (fams[x] != fams[y]) & ((sides[x] != sides[y]) | (sides[x] == 0)) & (small * 100 >= large * percent) & ((places[x] + places[y] + np.abs(rests[x] - rests[y])) * (100 + percent) <= left * (small + large))

    # The last block of positions that an element can pair with: the other set has at most 100 / percent its size.
    reach = left * (sizes + sizes * 100 // percent) // (100 + percent) - places
    short = np.repeat(~one & (length <= 64), length)
    lists = np.repeat(np.arange(len(starts)), length)
    x = np.flatnonzero(short)
    shift = 1
    while len(x):
        x = x[x + shift < len(token)]
        x = x[(lists[x + shift] == lists[x]) & (places[x + shift] <= reach[x])]
        ok = x[fits(x, x + shift)]
        if len(ok):
            yield ids[ok], ids[ok + shift]
        shift += 1
    for k in np.flatnonzero(~one & (length > 64)):
        a, b = starts[k], starts[k] + length[k]
        # The largest component or family of the list makes no pairs of its own; only the others are compared with all.
        groups = [(v[a:b], *np.unique(v[a:b], return_counts=True)) for v in (comps, fams)]
        of, known, number = max(groups, key=lambda g: g[2].max())
        inside = of == known[number.argmax()]
        rest, other = a + np.flatnonzero(inside), a + np.flatnonzero(~inside)
        for i, x in enumerate(other):
            y = np.concatenate([rest, other[i + 1 :]])
            y = y[places[y] <= reach[x]]
            y = y[fits(np.full(len(y), x), y)]
            if len(y):
                yield np.full(len(y), ids[x]), ids[y]


def differ(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that only one of two sets has, as far as their prefixes tell."""
    if not len(x) or not len(y):
        return 0
    last = min(x[-1], y[-1])
    x, y = x[x <= last], y[y <= last]
    return len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs, a stored table, whose prefixes don't exclude a link. Only the prefixes of sets that are in pairs are moved, and few others."""
    marks = key_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), per_key=16, probes=1)

    def taking_part(batches):
        for batch in batches:
            yield batch.take(pa.array(holds(marks, np.array(batch.column("id"), np.int64).view(np.uint64))))

    sets = sets.select("id", "n", "prefix").mapInArrow(lean(taking_part), "id bigint, n int, prefix binary")
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))

    def run(batches):
        for batch in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(c).to_pylist()] for c in ("pa", "pb"))
            total = np.array(batch.column("na"), np.int64) + np.array(batch.column("nb"), np.int64)
            ok = np.array([differ(p, q) * (100 + percent) for p, q in zip(x, y, strict=True)], np.int64) <= (100 - percent) * total
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(lean(run), "a bigint, b bigint")


def edits_of(a: int, x: np.ndarray, y: np.ndarray) -> bytes:
    """Keys of what y has more and less than the set x of a."""
    salt = np.uint64(a & (2**64 - 1))
    more, less = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
    return np.unique(np.concatenate([mix(mix(np.full(len(v), salt), seed) ^ v, seed) for v, seed in ((more, 11), (less, 12))])).tobytes()


def compared(pairs: DataFrame, documents: DataFrame, classes: DataFrame, k: int, percent: int, edits: bool = False) -> DataFrame:
    """The pairs (a, b) with linked, by their whole sets, and if wanted b's edits of a. Only sets of documents that take part are made.

    classes: id, and doc, f1 and f2, the document and the fingerprint that tell which text is meant.
    """
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", "doc", "f1", "f2"), "id"), "ids")
    marks = key_filter(ids.select("doc"), per_key=16, probes=1)

    def sets(batches):
        for batch in batches:
            known = batch.filter(batch.column("doc_id").is_valid())
            known = known.take(pa.array(holds(marks, np.array(known.column("doc_id"), np.int64).view(np.uint64))))
            for part in slices(known):
                body = [np.unique(s) for s in shingle_sets(part, k)]
                prints = np.array([fingerprint(b) for b in body], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), pa.array([b.tobytes() for b in body], pa.binary())], names=["doc", "f1", "f2", "body"])

    of_texts = documents.select("doc_id", "text").mapInArrow(lean(sets), "doc bigint, f1 bigint, f2 bigint, body binary")
    whole = materialize(of_texts.join(ids, ["doc", "f1", "f2"]).dropDuplicates(["doc", "f1", "f2"]).select("id", "body"), "sets")

    def compare(batches):
        for batch in batches:
            ok, changes = [], []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "x", "y")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(bool(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
                changes.append(edits_of(a, x, y) if edits else None)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_()), pa.array(changes, pa.binary())], names=["a", "b", "linked", "edits"])

    both = pairs.join(whole.select(F.col("id").alias("a"), F.col("body").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(compare), "a bigint, b bigint, linked boolean, edits binary")


# --- components ----------------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of all ids in links (a, b): the smallest id that can be reached.

    Each round gives every id the smallest label among its neighbours' and then its label's label, so that long
    chains shrink as powers of two. Labels are tables in the shared folder; only the number of changes reaches the driver.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        better = labels.join(near, labels["id"] == near["a"]).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("to"))
        jumped = better.join(labels.select(F.col("id").alias("to"), F.col("comp").alias("further")), "to")
        after = materialize(jumped.select("id", F.least("to", "further").alias("comp"), (F.col("old") != F.least("to", "further")).cast("int").alias("changed")), "labels")
        changed = after.agg(F.sum("changed")).first()[0] or 0
        if not changed:
            discard(after)
            discard(edges)
            return labels
        discard(labels)
        labels = after


def identified(classes: DataFrame) -> tuple[DataFrame, bool]:
    """classes (doc, f1, f2, n and more) with id: doc, or a number outside of all docs for a further class of the same doc; and if there are such."""
    firsts = classes.groupBy("doc").agg(F.min(F.struct("f1", "f2", "n")).alias("_m"), F.count("*").alias("_c"))
    several = materialize(firsts.filter("_c > 1").select("doc", "_m"), "several")
    bounds = several.agg(F.count("*").alias("c")).first()
    if not bounds["c"]:
        return classes.withColumn("id", F.col("doc")), False
    ends = classes.agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("c")).first()
    base = ends["most"] + 1 if ends["most"] + ends["c"] < 1 << 63 else ends["least"] - ends["c"]
    if base < -(1 << 63):
        raise ValueError("ids leave no room for numbers of further classes")
    marked = classes.join(several, "doc", "left")
    further = F.col("_m").isNotNull() & (F.struct("f1", "f2", "n") != F.col("_m"))
    numbered = row_numbers(marked.filter(further).select("f1", "f2", "n"), ["f1", "f2", "n"], "_number", ends["c"])
    numbers = materialize(numbered, "numbers")
    return marked.drop("_m").join(numbers, ["f1", "f2", "n"], "left").withColumn("id", F.coalesce(F.col("_number") + F.lit(base), "doc")).drop("_number"), True


def join_components(documents: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of all rows of documents (doc_id, text)."""
    size, spark = stored_bytes(documents), documents.sparkSession
    parts, counters = parts_for(size, 2 << 20, 32), counters_for(size)
    # Prefixes and whole sets are large: they are stored once at a time, and go as soon as the next table is there.
    with scratch(spark):
        described = materialize(describe_sets(documents, k, percent, shingle_rarity(documents, k, counters)), "described")
        members = materialize(described.select("doc_id", "n", "f1", "f2"), "members", lasting=True)
        classes = materialize(described.filter("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("doc"), F.first("prefix").alias("prefix"), F.first("keys").alias("keys")), "classes", lasting=True)
    with scratch(spark):
        sets, further = identified(classes)
        if further:
            sets = materialize(sets, "sets", lasting=True)
            discard(classes)
    stored = sets if further else classes
    names = materialize(sets.select("id", "doc", "f1", "f2", "n"), "names")
    index = sets.select("id", "n", "prefix")
    with scratch(spark):
        near = materialize(possible(materialize(similar_pairs(sets, percent), "pairs"), index, percent), "near")
        first = materialize(compared(near, documents, names, k, percent, edits=True), "links", lasting=True)
    comps = components(first.filter("linked"))
    # A set is in the family of the smallest one that it was compared with; others are families of their own.
    family = first.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "edits")).alias("f")).select("id", F.col("f.a").alias("fam"), F.col("f.edits").alias("edits"))
    known = index.join(comps, "id", "left").join(family, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"), F.coalesce("fam", "id").alias("fam"), "n", "prefix", "edits")
    known = materialize(known, "known")
    discard(stored)
    discard(first)
    changed = known.filter("edits is not null").select("id", "comp", F.col("id").alias("fam"), "n", F.col("edits").alias("prefix"))
    with scratch(spark):
        # Each index is written and gone before the next one is, and before prefixes are moved.
        of_sets = materialize(index_pairs(known, parts, percent), "pairs")
        of_edits = materialize(index_pairs(changed, parts, percent, edit_rarity(changed, counters)), "pairs")
        pairs = materialize(of_sets.union(of_edits).distinct(), "pairs")
        rest = materialize(possible(pairs, known, percent), "rest")
        second = materialize(compared(rest, documents, names, k, percent).filter("linked").select("a", "b"), "second", lasting=True)
    named = lambda df, c: df.join(comps.select(F.col("id").alias(c), F.col("comp").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    tops = components(named(named(second, "a"), "b").select("a", "b"))
    final = known.join(tops.select(F.col("id").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("id", F.coalesce("top", "comp").alias("component"))
    by_class = names.select("f1", "f2", F.col("n").alias("_n"), "id", "doc").join(final, "id")
    if further:  # labels are numbers of classes then, and the smallest document of a component is looked up
        least = materialize(by_class.groupBy("component").agg(F.min("doc").alias("least")), "least")
        by_class = by_class.join(least, "component").withColumn("component", F.col("least")).drop("least")
    by_class = by_class.drop("id", "doc").withColumnsRenamed({"f1": "_f1", "f2": "_f2"})
    on = (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")) & (F.col("n") == F.col("_n"))
    return members.join(by_class, on, "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents at 90 %, three words a shingle."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS to_id FROM w UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(to_id) FROM r WHERE r.id = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
