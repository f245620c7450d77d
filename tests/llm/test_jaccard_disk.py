"""Candidate pairs are stored, and their index gone, before prefixes are moved; only prefixes of sets in pairs are."""

import numpy as np

from spanloom.llm import jaccard


def test_pairs_are_stored_before_prefixes_are_moved(spark, monkeypatch):
    stored, seen, own, possible = [], [], jaccard.materialize, jaccard.possible
    monkeypatch.setattr(jaccard, "materialize", lambda df, name, lasting=False: stored.append(own(df, name, lasting)) or stored[-1])
    monkeypatch.setattr(jaccard, "possible", lambda pairs, sets, percent: seen.append(any(pairs is t for t in stored)) or possible(pairs, sets, percent))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:59], "other"]), "another text of few words", " ".join(words)]
    found = jaccard.join_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(0, 0), (1, 0), (2, 2), (3, 0)]
    assert seen == [True, True]


def test_only_prefixes_in_pairs_are_moved(spark):
    prefix = np.arange(3, dtype=np.uint64).tobytes()
    sets = spark.createDataFrame([(i, 30, bytearray(prefix)) for i in range(2000)], "id bigint, n int, prefix binary")
    pairs = spark.createDataFrame([(5, 7)], "a bigint, b bigint")
    found = jaccard.possible(pairs, sets, 90)
    assert [tuple(r) for r in found.collect()] == [(5, 7)]
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 3
