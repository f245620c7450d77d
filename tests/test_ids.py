"""Ids that are generated and derived."""

import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import ids

CASES = {"a": "a/v2", "a/v2": "a/v3", "a-v009": "a-v10", "a/vx": "a/vx/v2", "v3": "v3/v2", "a/v": "a/v/v2", "a/v1/b": "a/v1/b/v2", "a\n/v9": "a\n/v10", "": "/v2", "a/v9999999999999999999": "a/v10000000000000000000", None: None}


def test_derived(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "id string")
    rows = df.select("id", *[ids.regenerated(F.col("id"), s).alias(f"c{i}") for i, s in enumerate(("updateversion", "prefix=p", "suffix=s", "replace=r", "replacerandom=x;y", "randomsuffix"))]).collect()
    for r in rows:
        assert r.c0 == CASES[r.id]
        if r.id is None:
            assert tuple(r)[1:] == (None,) * 6
            continue
        assert (r.c1, r.c2, r.c3) == ("p" + r.id, r.id + "s", "r")
        assert re.fullmatch("x[A-Za-z0-9_-]{21}y", r.c4) and re.fullmatch(re.escape(r.id) + "[A-Za-z0-9_-]{21}", r.c5)
    assert len({r.c4 for r in rows}) == len(rows)


@pytest.mark.parametrize("strategy", ["suffix=", "prefix", "unknown=x", "other"])
def test_faults(strategy):
    with pytest.raises(ValueError):
        ids.regenerated(None, strategy)
