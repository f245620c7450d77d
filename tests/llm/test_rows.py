"""Sharding, mixing, quality: laws and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing, quality, sharding

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, shard string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], DOCS)


@pytest.mark.parametrize("n", [1, 2, 5, 13, 64, 101, 997])
def test_permutation_is_a_bijection(spark, n):
    a, b, slack = sharding.grid(n)
    assert a * b == n + slack
    lit = lambda x: F.lit(x).cast("long")
    out = spark.range(n).select(sharding.permuted(F.col("id"), lit(n), lit(a), lit(b), slack, [F.lit(3)]).alias("p")).collect()
    assert sorted(r.p for r in out) == list(range(n))


def test_shards_follow_the_law_of_rows(spark):
    rows = [(i, "x" * (i % 7), "en", "s") for i in range(203)] + [(5, None, None, None), (None, "", "en", "s"), (7, "dup", "en", "s"), (7, "dup", "en", "s")]
    out = sharding.shard_rows(sharding.describe(docs(spark, rows)), ["doc_id", "size", "text_crc32"], 40).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {r.size for r in out if r.doc_id is None} == {16}
    again = sharding.shard_rows(sharding.describe(docs(spark, rows[::-1]).repartition(5)), ["doc_id", "size", "text_crc32"], 40).collect()
    key = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.size, r.shard, r.slot) for r in rs)
    assert key(out) == key(again)
    assert sharding.shard_rows(sharding.describe(docs(spark, [])), ["doc_id"], 40).count() == 0


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    out = mixing.targets([10, 1000, 1], [1, 2, 3])
    assert out[2] == 3.0 and out[0] == 30.0 and math.isclose(sum(out), 1011)
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]
    assert mixing.targets([], []) == []


def test_mix_is_near_its_targets_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" for _ in range(int(rng.integers(0, 400)))), "en", [None, "a", "b", "z"][int(rng.integers(0, 4))]) for i in range(300)]
    rows += [(1, None, "en", "a"), (2, "", "en", "b"), (3, "same text here", "en", "a"), (3, "same text here", "en", "a"), (9, "w " * 20_000, "en", "z")]
    df = docs(spark, rows)

    def run(d):
        placed, slots = mixing.mix(d, ["doc_id"])
        taken = mixing.taken_words(placed, slots, ["sid", "start", "size"])
        return placed.join(taken, ["sid", "start", "size"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")).collect()

    out = run(df)
    assert len(out) == len(rows)
    assert all(r.taken <= 3 * r.size for r in out)
    for s in (None, "a", "b", "z"):
        own = [r for r in out if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 32
    assert math.isclose(sum({r.source: r.target for r in out}.values()), sum(r.size for r in out))
    assert sorted(map(str, out)) == sorted(map(str, run(df.repartition(7))))
    placed, slots = mixing.mix(docs(spark, []), ["doc_id"])
    assert placed.count() == 0 and slots.count() == 0


def test_shard_counts_sum_to_the_slots():
    counts = mixing.shard_counts([1000, 3, 0, 50], 64, 5)
    assert counts.sum(axis=0).tolist() == [1000, 3, 0, 50]
    assert set(counts.sum(axis=1)[:-1].tolist()) == {64} and (counts >= 0).all()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert out and all(quality.is_held_out(r.doc_id) for r in out)
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_quality_against_a_plain_discriminant(spark):
    """Means and covariances of all training rows in floats, inverses and determinants instead of factors."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = {r.doc_id: np.array(r.stats) / quality.SCALE for r in quality.with_statistics(docs, ["doc_id"]).collect()}
    known = {r.doc_id: int(r.quality) for r in labels.collect() if r.quality is not None and not quality.is_held_out(r.doc_id)}
    x = {c: np.array([stats[d] for d, q in known.items() if q == c and d in stats]) for c in (0, 1)}
    covs = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = sum(len(x[c]) * covs[c] for c in x) / sum(map(len, x.values()))

    def density(c, v):
        cov = 0.9 * covs[c] + 0.1 * pooled
        cov = 0.95 * cov + 0.05 * np.trace(cov) / len(cov) * np.eye(len(cov))
        away = v - x[c].mean(axis=0)
        return np.log(len(x[c])) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * away @ np.linalg.inv(cov) @ away

    for r in quality.classify(docs.withColumns({"SCORE": F.lit("x"), "stats": F.lit(1)}), labels).collect():
        gap = density(1, stats[r.doc_id]) - density(0, stats[r.doc_id])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(gap, -500, 500)))) < 1e-6, r.doc_id


def test_quality_edge_cases(spark):
    texts = docs(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (None, "plain words", "en", "s"), (4, "a " * 50_000, "en", "s"), (4, "a " * 50_000, "en", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(texts, none).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and {r.predicted for r in out} == {1}
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(texts, one).count() == 5
    assert quality.classify(docs(spark, []), one).count() == 0
    assert quality.accepted(docs(spark, []), one).count() == 0


def test_statistics_see_the_text_alone():
    from spanloom.llm.shared import text_bytes
    import pyarrow as pa

    both = quality.statistics(*text_bytes(pa.array(["One two. Three", "", "ÄÖ !! ## ||", "One two. Three"])))
    alone = quality.statistics(*text_bytes(pa.array(["One two. Three"])))
    assert (both[0] == alone[0]).all() and (both[3] == alone[0]).all()


def test_shards_of_a_hot_id_and_clashing_columns(spark):
    rows = [(7, f"text {i}", "en", "s") for i in range(500)]
    df = docs(spark, rows).withColumns({c: F.lit(c) for c in ("_bucket", "_amount", "_place", "_b", "_start", "_sum")})
    out = sharding.shard_rows(df, ["doc_id", "text"], 40)
    assert {"_bucket", "_amount", "_place", "_b", "_start", "_sum"} <= set(out.columns)
    got = out.collect()
    assert all(r[c] == c for r in got for c in ("_bucket", "_amount", "_place", "_b", "_start", "_sum"))
    assert sorted(r.global_row for r in got) == list(range(500)) and {r.shard for r in got} == set(range(40))


def plain_feistel(number, n, a, b, slack, key, xxhash):
    """The permutation by its definition, with Spark's hash as a function."""
    for _ in range(slack + 1):
        left, right = divmod(number, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + xxhash(right, i, key) % a) % a
            else:
                right = (right + xxhash(left, i, key) % b) % b
        number = left * b + right
        if number < n:
            return number


def test_shards_against_a_plain_version(spark):
    n = 300
    out = sharding.op5_sharding(spark, "/root/testdata/sf0.001").collect()
    n = len(out)
    a, b, slack = sharding.grid(n)
    keys = spark.range(max(a, b)).crossJoin(spark.range(sharding.ROUNDS).select(F.col("id").cast("int").alias("i")))
    table = {(r.id, r.i): r.h for r in keys.select("id", "i", F.xxhash64("id", "i", F.lit(20_24)).alias("h")).collect()}
    place = {plain_feistel(x, n, a, b, slack, 20_24, lambda half, i, _: table[half, i]) for x in range(n)}
    assert place == set(range(n))
    assert {(r.shard, r.slot) for r in out} == {(p % 40, p // 40) for p in place}
    rows = sharding.shard_rows(sharding.describe(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), ["doc_id", "size", "text_crc32"], 40).collect()
    for r in rows:
        p = plain_feistel(r.global_row, n, a, b, slack, 20_24, lambda half, i, _: table[half, i])
        assert (r.shard, r.slot) == (p % 40, p // 40)
    assert sorted(r.global_row for r in rows) == list(range(n))


def test_draws_of_many_shards(spark, monkeypatch):
    """Runs of shards are drawn in tasks where there are many; sums and sizes stay exact."""
    monkeypatch.setattr(mixing, "DRAWN", 8)
    slots = [1000, 3, 0, 52]
    rows = mixing.draw(spark, slots, 10, 5).collect()
    for sid, n in enumerate(slots):
        own = sorted((r["first"], r["n"]) for r in rows if r.sid == sid)
        assert sum(x for _, x in own) == n
        assert all(f == sum(x for _, x in own[:i]) for i, (f, _) in enumerate(own))
    by = {}
    for r in rows:
        by[r.shard] = by.get(r.shard, 0) + r["n"]
    assert sorted(by) == list(range(106)) and sorted(by.values())[1:] == [10] * 105


def test_mixing_against_a_plain_version(spark):
    """Targets and what is taken of each document, from the slots' blocks, word by word."""
    sf = "/root/testdata/sf0.001"
    out = mixing.op7_mixing(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/documents.parquet")
    words = {r.doc_id: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r.text or "")]) for r in table.collect()}
    assert {r.doc_id: r["size"] for r in out} == words
    placed, slots = mixing.mix(table.select("doc_id", "text", "source"), ["doc_id"])
    times = {}
    for s in slots.collect():
        times[s.sid, s.block] = times.get((s.sid, s.block), 0) + 1
    rows = placed.collect()
    taken = {r.doc_id: sum(times.get((r.sid, k // 32), 0) for k in range(r.start, r.start + r["size"])) for r in rows}
    assert {r.doc_id: r.taken for r in out} == taken
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in rows if r.source == s) for s in names]
    weights, want, rest, open_ = [1 + i % 3 for i in range(len(names))], {}, sum(sizes), set(range(len(names)))
    while True:
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        above = {i for i in open_ if share[i] > 3 * sizes[i]}
        if not above:
            want |= share
            break
        want |= {i: 3.0 * sizes[i] for i in above}
        rest -= sum(3 * sizes[i] for i in above)
        open_ -= above
    for i, s in enumerate(names):
        own = [r for r in out if r.doc_id in {x.doc_id for x in rows if x.source == s}]
        assert own[0].source_size == sizes[i] and math.isclose(own[0].target, want[i])
        assert abs(sum(r.taken for r in own) - want[i]) <= 48  # half a block, and what the last block lacks
        starts = sorted((r.start, r["size"]) for r in rows if r.source == s)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
