"""Substring dedup, Jaccard join and decontamination against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from spanloom.llm import decontamination, jaccard, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, part int, item string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def corpus(seed, families=6, loners=20, members=5):
    """Random texts, near copies of some, shared passages, and the odd cases."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = text(20)
    out = []
    for _ in range(loners):
        t = text(rng.randint(0, 60))
        if rng.random() < 0.4:
            t[5:5] = shared
        out.append(t)
    for _ in range(families):
        base = text(rng.randint(40, 120))
        for _ in range(members):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(t)
    rng.shuffle(out)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(out)]
    n = len(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "one two"), (n + 5, "ONE two"), rows[0], (n + 6, "a " * 3000), (n + 7, "a " * 2000)]


def removed(rows, window=13):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [13, 5, 26])
def test_substrings(spark, window):
    rows = corpus(window)
    out = substrings.deduplicate(frame(spark, rows), window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, substrings.digest(r.kept)) for r in out) == removed(rows, window)


def test_substrings_tell_the_longest_level(spark):
    rows = [(1, " ".join(map(str, range(60)))), (2, " ".join(map(str, range(30)))), (3, " ".join(map(str, range(14)))), (4, "nothing here")]
    out = {r.doc_id: r.length for r in substrings.deduplicate(frame(spark, rows), 13, longest=1000).collect()}
    assert out == {1: 26, 2: 26, 3: 13, 4: None}
    assert substrings.levels(13) == [7, 13] and substrings.levels(26, 110) == [7, 13, 26, 52, 104]


def test_substrings_of_nothing(spark):
    assert substrings.deduplicate(frame(spark, [])).count() == 0
    out = substrings.deduplicate(frame(spark, [(None, "a " * 40), (None, "a " * 40), (1, "a " * 40)])).collect()
    assert {r.n_removed for r in out} == {0}


def components_of(rows, k=3, percent=90):
    sets, ids = {}, {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets[i] = s
        ids[i] = i
    find = lambda x: x if ids[x] == x else find(ids[x])
    order = sorted(sets)
    for n, x in enumerate(order):
        for y in order[n + 1 :]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(x), find(y)))
                ids[q] = p
    return sorted((i, len(sets[i]), find(i)) for i, _ in rows)


@pytest.mark.parametrize("seed", range(3))
def test_jaccard(spark, seed):
    rows = corpus(seed)
    out = jaccard.join_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == components_of(rows)


def test_jaccard_of_five_words(spark):
    rows = corpus(3)
    out = jaccard.join_components(frame(spark, rows), 5, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == components_of(rows, 5, 80)


def test_jaccard_of_a_large_family_with_far_members(spark):
    """Members, some too far from the first one, and sub-families that share edits."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(160):
        t = list(base)
        for k in range(rng.choice([1, 1, 2, 3, 5])):
            t[rng.randrange(100)] = f"e{i}.{k}"
        if i % 3 == 0:
            t[10], t[50] = "shared", "edits"
        rows.append((i, " ".join(t)))
    out = jaccard.join_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == components_of(rows)


def test_jaccard_of_nothing(spark):
    assert jaccard.join_components(frame(spark, [])).count() == 0
    out = jaccard.join_components(frame(spark, [(None, "a b c d"), (3, "a b c d"), (None, None)])).collect()
    assert sorted((r.n_shingles, r.component_id) for r in out if r.n_shingles) == [(2, 3), (2, 3)]


def test_families_lose_no_component():
    """skipping_pairs gives each pair that could link: against all pairs of random sets, in lists over and under 64 entries."""
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(300, rng.integers(15, 60), replace=False)) for _ in range(40)]
    core = sets[0]
    sets += [np.sort(np.unique(np.append(np.delete(core, rng.integers(0, len(core), 2)), rng.integers(300, 9000, 2)))) for _ in range(90)]
    token, ids, size, place = [], [], [], []
    for i, s in enumerate(sets):
        p = s[::-1][: jaccard.prefix_length(len(s), 90)]  # one global order: larger numbers first
        token += (9000 - p).tolist()
        ids += [i] * len(p)
        size += [len(s)] * len(p)
        place += range(len(p))
    a = np.array
    found = set()
    args = a(token, np.uint64), a(ids), a(ids), a(ids), a(size), a(place)
    for x, y in jaccard.skipping_pairs(*args, 90):
        found |= {(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            y = sets[j]
            common = len(np.intersect1d(x, y))
            if 100 * common >= 90 * (len(x) + len(y) - common):
                assert (i, j) in found


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = random.Random(2)
    for _ in range(30):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        assert decontamination.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == smith_waterman(a, b)


def test_contaminated(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(12, 40))]) for i in range(12)]
    rows = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]) for i in range(60)]
    for i in range(0, 60, 3):
        item = list(items[i % 12][1])
        if i % 2:
            for _ in range(len(item) // 8):  # an edited copy
                k = rng.randrange(len(item))
                item[k : k + 1] = rng.choice([[], ["new"], [item[k], "more"]])
        rows[i][1][3:3] = item
    docs = [(i, " ".join(w).title() + ".") for i, w in rows] + [(100, None), (101, ""), (102, "v1"), (0, " ".join(rows[0][1]))]
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in items] + [(50, None), (51, ""), (52, "solo"), items[0][:1] + (", ".join(items[0][1]),)], "item_id long, text string")
    out = decontamination.contaminated(frame(spark, docs), bench).collect()
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    expected = defaultdict(float)
    for i, t in docs:
        for k, w in items:
            score = smith_waterman(w, split(t)) / (2 * len(w))
            grams = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
            d = split(t)
            if score >= 0.5 and sum(tuple(d[j : j + 3]) in grams for j in range(len(d) - 2)) >= max(1, -(-len(grams) // 10)):
                expected[i, k] = max(expected[i, k], score)
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in out} == {k: round(v, 9) for k, v in expected.items()}
    assert len(expected) >= 20
    blocks = decontamination.contaminated(frame(spark, docs), bench, block_bytes=500).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == set(expected)
    assert decontamination.contaminated(frame(spark, []), bench).count() == 0
    assert decontamination.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def thue_morse(n, a="a", b="b"):
    """2**n letters a and b; with a and b changed over, sums of powers modulo 2**64 are the same for long ones."""
    out = [a]
    for _ in range(n):
        out += [b if x == a else a for x in out]
    return out


def test_words_that_agree_in_sums_of_powers_differ(spark):
    one, two = "".join(thue_morse(11)), "".join(thue_morse(11, "b", "a"))
    rows = [(i, " ".join(t + str(k) for k in range(13))) for i, t in enumerate([one, two])]
    sequences = [(2, " ".join(thue_morse(11, "x", "y"))), (3, " ".join(thue_morse(11, "y", "x")))]
    assert {r.n_removed for r in substrings.deduplicate(frame(spark, rows), 13).collect()} == {0}
    assert {r.n_removed for r in substrings.deduplicate(frame(spark, sequences), 2048).collect()} == {0}
    assert [r.component_id for r in sorted(jaccard.join_components(frame(spark, rows)).collect())] == [0, 1]


def test_substrings_of_rows_that_repeat_an_id(spark):
    text = lambda c, n=20: " ".join(f"{c}{i}" for i in range(n))
    rows = [(0, text("x")), (5, text("x")), (5, text("y")), (5, text("y", 15)), (7, text("z") + " " + text("y")), (7, text("x"))]
    out = substrings.deduplicate(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in out) == [(0, 20, 0), (5, 15, 0), (5, 20, 0), (5, 20, 20), (7, 20, 20), (7, 40, 20)]
    # Far more copies than one batch holds, of one passage.
    hot = [(i, f"own{i} " + text("h") + f" end{i}") for i in range(400)]
    out = substrings.deduplicate(frame(spark, hot).repartition(7)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(i, 20 if i else 0) for i in range(400)]


def rows_components(rows, k=3, percent=90):
    """As components_of, with each row a document of its own."""
    numbered = components_of([(i, t) for i, (_, t) in enumerate(rows)], k, percent)
    least = {}
    for i, n, c in numbered:
        least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], n, least[c]) for i, n, c in numbered)


def test_jaccard_of_rows_that_repeat_an_id(spark):
    out = jaccard.join_components(frame(spark, [(5, "a b c d"), (5, "e f g h"), (7, "q r s t")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(5, 2, 5), (5, 2, 5), (7, 2, 7)]
    rows = [(i % 9, t) for i, t in corpus(5)]
    out = jaccard.join_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == rows_components(rows)


def test_hot_lists_are_split_and_lose_no_pair():
    hot = np.uint64(jaccard.HOT_LEVEL + 3) << np.uint64(58)
    token = np.array([hot | np.uint64(5)] * 60 + [hot | np.uint64(6)] * 30 + [np.uint64(7)] * 4, np.uint64)
    ids = np.concatenate([np.arange(60), np.arange(20, 50), np.array([0, 70, 71, 72])])
    t, row, place, side = jaccard.spread(token, np.arange(len(ids)), np.zeros(len(ids), np.int64), ids)
    found, size = [], np.full(len(t), 100)
    for x, y in jaccard.skipping_pairs(t, ids[row], ids[row], ids[row], size, place, 90, side):
        found += [(min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)]
    lists = [range(60), range(20, 50), [0, 70, 71, 72]]
    want = [(min(a, b), max(a, b)) for m in lists for i, a in enumerate(m) for b in list(m)[i + 1 :]]
    assert sorted(found) == sorted(want)
    assert np.unique(t, return_counts=True)[1].max() < 40


def test_contaminated_finds_all_that_align(spark):
    """Against alignments of all texts with all items: words put in after every second, every third replaced, every third cut; common words."""
    rng = random.Random(14)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(3000)]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else rng.choice(rare)
    lengths = [1, 2, 3, 4, 5, 7, 9, 12, 20, 33, 60, 61]
    items = [(f"item{i}", [f"solo{i}"] if n == 1 else [word() for _ in range(n)]) for i, n in enumerate(lengths)]

    def inserted(w, step):
        return [x for i, v in enumerate(w) for x in ([v, word()] if i % step == step - 1 else [v])]

    edits = [lambda w: inserted(w, 2), lambda w: inserted(w, 1), lambda w: [word() if i % 3 == 2 else v for i, v in enumerate(w)], lambda w: [v for i, v in enumerate(w) if i % 3], lambda w: w[: len(w) // 2 + 1], lambda w: w]
    rows = []
    for i in range(90):
        body = [word() for _ in range(rng.randint(0, 150))]
        at = rng.randint(0, len(body))
        rows.append((i, " ".join(body[:at] + edits[i % 6](items[i % len(items)][1]) + body[at:])))
    bench = spark.createDataFrame([(i, " ".join(w), 3.5) for i, w in items] + [("none", None, 1.0)], "item_id string, text string, score double")
    docs = spark.createDataFrame([(str(i), t, 1, "x") for i, t in rows] + [(None, rows[0][1], 1, "x")], "doc_id string, text string, no int, places string")
    out = decontamination.contaminated(docs, bench).collect()
    expected = {(str(i), k): round(s, 9) for i, t in rows for k, w in items if (s := smith_waterman(w, t.split()) / (2 * len(w))) >= 0.5}
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in out} == expected
    assert len(expected) > 90 and len(out) == len(expected)
