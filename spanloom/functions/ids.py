"""Public ids: generated ones and derived ones.

Generated parts are hashes of columns that tell rows apart and of a seed, so that a task that runs again gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 21
_VERSIONED = r"(?s)^(.*[!-/:-@\[-`{-~])v([0-9]{1,19})$"


def generated(*of: Column, prefix: str = "", suffix: str = "", seed: str = "") -> Column:
    """prefix, 21 characters of A-Z a-z 0-9 - _ that depend on the columns and the seed, suffix."""
    known = F.to_json(F.struct(F.lit(seed).alias("seed"), *[c.cast("string").alias(f"c{i}") for i, c in enumerate(of)]))
    part = F.translate(F.base64(F.unhex(F.sha2(known, 256))), "+/", "-_")
    return F.concat(F.lit(prefix), F.substring(part, 1, LENGTH), F.lit(suffix))


def regenerated(id: Column, strategy: str = "updateversion", seed: str = "") -> Column:
    """A new id for a row's old one; null stays null.

    strategy: suffix=x, prefix=x, replace=x, replacerandom=prefix;suffix, randomsuffix, or updateversion: a last part v1, v2, ... behind
    a punctuation mark counts on, other ids get /v2.
    """
    name, equals, x = strategy.partition("=")
    if equals and not x:
        raise ValueError(f"{name} needs a value")
    if name in ("suffix", "addsuffix") and x:
        return F.concat(id, F.lit(x))
    if name in ("prefix", "addprefix") and x:
        return F.concat(F.lit(x), id)
    if name == "replace" and x:
        return F.when(id.isNotNull(), F.lit(x))
    if name == "replacerandom" and x:
        prefix, _, suffix = x.partition(";")
        return F.when(id.isNotNull(), generated(id, prefix=prefix, suffix=suffix, seed=seed))
    if strategy in ("randomsuffix", "addrandomsuffix"):
        return F.concat(id, generated(id, seed=seed))
    if strategy != "updateversion":
        raise ValueError(f"no such strategy: {strategy}")
    version = F.regexp_extract(id, _VERSIONED, 2)
    counted = F.concat(F.regexp_extract(id, _VERSIONED, 1), F.lit("v"), (version.try_cast("decimal(19,0)") + 1).cast("decimal(20,0)").cast("string"))
    return F.when(version != "", counted).otherwise(F.concat(id, F.lit("/v2")))
