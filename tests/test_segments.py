"""Segments: positions are moved in lists, and give the same pieces as a row for each."""

import random

from spanloom.functions import text as texts


def plain(resources, spans, begin, end):
    out = set()
    for res, n in resources:
        if n is None and end is None:
            continue
        top = min(x for x in (n, end) if x is not None)
        cuts = sorted({at for at in (begin, top, *(p for r, b, e in spans if r == res for p in (b, e) if p is not None)) if begin <= at <= top})
        out |= {(res, b, e) for b, e in zip(cuts, cuts[1:], strict=False)}
    return out


def test_segments_are_those_of_all_positions(spark, monkeypatch):
    monkeypatch.setattr(texts, "WIDE", 16)
    draw = random.Random(3)
    resources = [(i, n) for i, n in enumerate((0, 1, 15, 16, 17, 100, 300, None))]
    spans = [(draw.randrange(9), b, b + draw.randrange(40)) for b in (draw.randrange(320) for _ in range(300))] + [(None, 1, 2), (5, None, 33), (5, -4, 1), (6, 3, None)]
    res, rows = spark.createDataFrame(resources, "res long, textlen int"), spark.createDataFrame(spans, "res long, begin int, end int")
    for begin, end in ((0, None), (10, 50), (32, 32), (120, None)):
        found = [tuple(r) for r in texts.segments(res, rows, begin, end).collect()]
        assert len(found) == len(set(found)) and set(found) == plain(resources, spans, begin, end)


def test_positions_of_a_resource_share_rows(spark):
    spans = spark.range(0, 20_000, 1, 1).selectExpr("id % 2 as res", "cast(id as int) as begin", "cast(id + 2 as int) as end")
    assert texts._positions(spans).count() < 50
    plan = texts.segments(spark.createDataFrame([(0, 30_000), (1, 30_000)], "res long, textlen int"), spans)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(begin" not in plan
