"""Near copies that changed the same place of a text to something of their own are not compared with each other."""

import numpy as np

from spanloom.llm import jaccard
from spanloom.llm.shared import mix


def _family(spark, n: int, percent: int = 80):
    """Pairs of n sets of 146 with 10 edits and n with 40 in one family; half of the edits of each are frequent. And two that share their rare ones."""
    rare = lambda i, k: mix(np.arange(k, dtype=np.uint64) + np.uint64(1000 * i + 10**6), 1)
    often = mix(np.arange(20, dtype=np.uint64), 2)
    rows = [(i, i, np.concatenate([rare(i, k), np.roll(often, i)[:k]])) for i in range(2 * n) for k in [5 if i < n else 20]]
    rows += [(2 * n, 2 * n, np.concatenate([rare(2 * n, 20), often])), (2 * n + 1, 2 * n + 1, np.concatenate([rare(2 * n, 16), often]))]
    sets = spark.createDataFrame([(i, comp, i, 146, bytearray(e.tobytes())) for i, comp, e in rows], "id bigint, comp bigint, fam bigint, n int, prefix binary")
    levels = jaccard.edit_rarity(sets, 1 << 16)
    return sorted(map(tuple, jaccard.index_pairs(sets, 4, percent, levels).collect()))


def test_pairs_of_unlike_edits_are_left_out(spark):
    assert _family(spark, 20)[-1] == (40, 41)
    few, many = (len([p for p in _family(spark, n) if p[0] < n <= p[1]]) for n in (20, 80))
    assert few == many == 0


def test_the_bound_loses_no_pair():
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        base = np.arange(60)
        own = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 61), replace=False), rng.integers(60, 75, rng.integers(0, 12))])) for _ in range(60)]
        token, ids, places, sizes = (np.concatenate(x) for x in zip(*[(s.astype(np.uint64), np.full(len(s), i), np.arange(len(s)), np.full(len(s), len(s))) for i, s in enumerate(own)], strict=True))
        found = {(min(p), max(p)) for a, b in jaccard.skipping_pairs(token, ids, ids, ids, sizes, places, percent) for p in zip(a.tolist(), b.tolist(), strict=True)}
        wanted = {(i, j) for i in range(60) for j in range(i) if jaccard.linked(len(np.intersect1d(own[i], own[j])), len(own[i]), len(own[j]), percent)}
        assert {(j, i) for i, j in wanted} <= found and wanted
