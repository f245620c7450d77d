"""Closures from asked items, relations without pairs, limits of any size."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.spans import RELATIONS, Relation
from spanloom.model import SCHEMAS, Store
from spanloom.operators import mutations, related, traversals


def plain_reach(edges, seeds):
    out = set()
    for s in seeds:
        todo = [s]
        seen = set()
        while todo:
            x = todo.pop()
            for y in edges.get(x, ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        out |= {(s, y) for y in seen}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(40)] + [(50, 51), (51, 52), (52, 50)] + [(rng.randint(60, 90), rng.randint(60, 90)) for _ in range(40)]
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, set()).add(b)
    asked = [0, 35, 50, 61, 70, 99]
    found = traversals.reachable(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(a, a) for a in asked], "seed long, at long")).collect()
    assert len(found) == len(set(found)) and {(r.seed, r.at) for r in found} == plain_reach(edges, asked)


def test_one_annotation_on_a_long_chain(spark):
    n = 20_000
    t = spark.range(n).select(*[{"a": F.col("id"), "target_a": F.when(F.col("id") > 0, F.col("id") - 1), "pos": F.lit(0), "kind": F.lit("AnnotationSelector")}.get(c.split()[0], F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMAS["targets"].split(", ")])
    store = Store.empty(spark).with_tables(targets=t, annotations=spark.range(n).select(F.col("id").alias("a"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("complex")))
    assert traversals.closure(store, spark.createDataFrame([(n - 1,)], "a long")).count() == n - 1
    assert traversals.closure(store, spark.createDataFrame([(2,)], "a long")).count() == 2
    left = mutations.remove_annotations(store, spark.createDataFrame([(n - 3,)], "a long"))
    assert left.annotations.count() == n - 3


TEXT = "ab cd  ef\n\ngh" + "x" * 20 + " ij kl"


@pytest.mark.parametrize("op", RELATIONS)
def test_related_spans_without_pairs(spark, op):
    rng = random.Random(op)
    span = lambda: tuple(sorted((rng.randint(0, len(TEXT)), rng.randint(0, len(TEXT)))))
    for negate, limit, whitespace in itertools.product((True, False), (None, 3), (True, False)):
        r = Relation(op, negate=negate, limit=limit, whitespace=whitespace)
        if related.reach(r) is not None:
            continue
        known = [(res, *s) for res in range(8) for s in {span() for _ in range(rng.randint(1, 12))}]
        asked = [k for k in known if rng.random() < 0.3] + [(res, *span()) for res in range(4)]
        texts = spark.createDataFrame([(i, TEXT) for i in range(8)], "res long, text string")
        frame = lambda rows: spark.createDataFrame(rows, "res long, begin int, end int").distinct()
        pairs = related.join_related(frame(asked), frame(known), r, texts)
        if op not in ("equals", "inset", "samerange"):
            pairs = pairs.filter("begin != r_begin or end != r_end")
        expected = {(x.res, x.r_begin, x.r_end) for x in pairs.collect()}
        found = related.any_related(frame(asked), frame(known), r, texts).collect()
        assert {tuple(x) for x in found} == expected and len(found) == len(expected), (negate, limit, whitespace)


def test_a_limit_of_any_size(spark):
    spans = spark.createDataFrame([(1, i * 10, i * 10 + 3, i) for i in range(30)], "res long, begin int, end int, n int")
    for limit in (0, 7, 250, 255, 10_000, 2_000_000_000):
        found = related.join_related(spans, spans, Relation("before", limit=limit))
        assert {(x.n, x.r_n) for x in found.collect()} == {(i, j) for i in range(30) for j in range(30) if 0 <= j * 10 - i * 10 - 3 <= limit}


@pytest.mark.parametrize("text", ["ab", "aa", "aba", "a", "b a", "é"])
def test_annotations_with_text(spark, text):
    from spanloom.operators import filters

    whole = "abaab aaa baéba ab"
    base = mutations.add_resources(Store.empty(spark), spark.createDataFrame([("r", whole), ("e", "")], "id string, text string"))
    leaf = lambda b, e: ("TextSelector", "r", None, None, None, None, b, e, "BeginBegin")
    spans = [(b, b + n) for n in (0, 1, 2, 3) for b in range(len(whole) - n + 1)]
    rows = [(f"{b}-{e}", None, [leaf(b, e)], []) for b, e in spans] + [("two", "CompositeSelector", [leaf(0, 1), leaf(1, 2)], []), ("apart", "CompositeSelector", [leaf(1, 2), leaf(2, 3)], [])]
    store = mutations.annotate(base, spark.createDataFrame(rows, mutations.BUILDERS))
    found = filters.annotations_with_text(store, store.annotations, text).select("id").collect()
    expected = {f"{b}-{e}" for b, e in spans if whole[b:e] == text} | ({"apart"} if text == "b a" else set())
    assert {r.id for r in found} == expected


def test_members_of_substores_in_substores(spark):
    substores = spark.createDataFrame([(0, "a", None, [-1, 2]), (1, "b", None, [0]), (2, "c", None, [1]), (3, "d", None, [-1])], SCHEMAS["substores"])
    member = spark.createDataFrame([(i, "resource", 10 + i) for i in range(4)] + [(1, "resource", 10), (3, "dataset", 5)], SCHEMAS["substore_membership"])
    store = Store.empty(spark).with_tables(substores=substores, substore_membership=member)
    found = sorted(map(tuple, traversals.nested_members(store, substores, "resource").collect()))
    assert found == [(s, 10 + i) for s in (0, 1, 2) for i in (0, 1, 2)] + [(3, 13)]  # a, b and c are a ring
