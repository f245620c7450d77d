"""The corpus pipeline stage by stage against plain versions, on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline as pipeline
from spanloom.llm import decontamination, mixing, quality
from spanloom.llm.shared import materialize
from tests.llm.test_copies import components_of, smith_waterman

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    inputs = [docs]
    for name, stage in pipeline.STAGES:
        inputs.append(materialize(stage(spark, inputs[-1], SF), name.replace(" ", "-")))
    assert all(x.columns == columns for x in inputs[:-1])
    rows = [x.collect() for x in inputs]
    ids = [Counter(r.doc_id for r in x) for x in rows]

    judged = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert ids[1] == Counter(r.doc_id for r in judged if r.predicted)

    groups = components_of([(r.doc_id, r.text) for r in rows[1]], 5, 80)  # what the task sets for near-duplicate stages
    assert sorted(ids[2]) == sorted({c for _, _, c in groups})

    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in rows[2]:
        words = split(r.text)
        near = [w for w in items if len(set(w) & set(words)) >= len(set(w)) // 2]
        leak = any(smith_waterman(w, words) >= 0.5 * 2 * len(w) for w in near)
        assert leak == (r.doc_id not in ids[3]), r.doc_id
    assert decontamination.contaminated(inputs[3], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0

    size = {r.doc_id: len(WORD.findall(r.text)) for r in rows[3]}
    taken = Counter()
    for r in rows[4]:
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    placed, slots = mixing.mix(inputs[3], ["doc_id"], pipeline.BLOCK)
    plan = {r.doc_id: r.taken for r in mixing.taken_words(placed, slots, ["doc_id"]).collect()}
    assert {k: v for k, v in taken.items() if v} == plan
    assert all(taken[i] <= 3 * size[i] for i in taken)

    shards = Counter(r.shard for r in rows[5])
    assert len(rows[5]) == len(rows[4]) and max(shards.values()) - min(shards.values()) <= 1


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go(spark):
    """Copies with two words changed, 20 words appended or 15 cut; a copy with a tenth of its words changed stays."""
    text = [f"w{i}" for i in range(100)]
    changed = lambda at: [f"new{i}" if i in at else w for i, w in enumerate(text)]
    rows = [text, changed({30, 60}), text + [f"more{i}" for i in range(20)], text[:85], changed(set(range(5, 100, 10)))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.keep_one_of_each_group(spark, docs, SF).collect()) == [0, 4]


def test_columns_of_any_name_are_carried(spark, tmp_path):
    """Columns called like the stages' own keep their values."""
    from pyspark.sql import functions as F

    extra = ["size", "sid", "start", "target", "shard", "slot", "_row", "_crc", "_number", "blocks", "row", "others", "pass", "keys", "id", "_"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}/"), F.col("doc_id")).alias(c) for c in extra])
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), "stage")
        assert name == "sharding" or docs.columns == before.columns
    kept = {c: f"input_{c}" if c in ("shard", "slot") else c for c in extra}
    out = docs.select("doc_id", *kept.values()).collect()
    assert out and all(r[k] == f"{c}/{r.doc_id}" for r in out for c, k in kept.items())


def test_mix_of_rows_that_repeat_an_id(spark):
    docs = spark.createDataFrame([(1, f"text number {i} " + "w " * i, None if i % 3 else "s") for i in range(60)] + [(None, "no id", "s"), (2, None, "s")], "doc_id long, text string, source string")
    out = pipeline.mix_sources(spark, docs, SF)
    assert out.columns == docs.columns and out.count() >= 60
    assert pipeline.shard(spark, docs, SF).select("slot").distinct().count() == 2


def test_names_in_another_case_are_kept(spark):
    rows = [(i, f"some words of text {i}", "a", 9, 8, 7, 6) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Shard int, SLOT int, input_shard int, N_Chars long")
    out = pipeline.shard(spark, docs, "")
    assert out.columns == ["doc_id", "text", "source", "input_input_shard", "input_slot", "input_shard", "N_Chars", "global_row", "shard", "slot"]
    assert {(r.input_input_shard, r.input_slot, r.input_shard) for r in out.collect()} == {(9, 8, 7)}
    mixed = pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and all(r.N_Chars == len(r.text) for r in mixed.collect())
