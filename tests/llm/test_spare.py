"""What the operators leave on disk, and how much reaches Python at once."""

import glob
import os
import subprocess
import sys
import threading
import time

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from spanloom.llm.shared import materialize, scratch, shared_dir, sparing

SF = "/root/testdata/sf0.001"


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


def shuffled(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def test_stages_leave_ids_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage, left in ((pipeline.keep_one_of_each_group, {"others", "repeated"}), (pipeline.drop_leaks, {"leaks"})):
        before = tables(spark)
        out = stage(spark, docs, SF)
        assert {t.split("-")[0] for t in tables(spark) - before} == left
        assert out.count()


def test_tables_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    materialize(spark.range(1000).repartition(4, "id"), "dealt")
    until = time.time() + 10  # files go in the background
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled(spark) - before


def test_scratch(spark):
    before = tables(spark)
    with scratch(spark):
        materialize(spark.range(1), "outer")
        with scratch(spark):
            materialize(spark.range(1), "inner")
            materialize(spark.range(1), "handed", lasting=True)
        assert sorted(t.split("-")[0] for t in tables(spark) - before) == ["handed", "outer"]
        stays = materialize(spark.range(3), "stays", lasting=True)
    assert stays.count() == 3 and [t.split("-")[0] for t in tables(spark) - before] == ["stays"]


def test_threads_keep_their_own_tables_and_settings(spark):
    before, setting = tables(spark), "spark.sql.execution.arrow.maxBytesPerBatch"
    was, inside, done, found = spark.conf.get(setting), threading.Event(), threading.Event(), {}

    def other():
        with sparing(spark), scratch(spark):
            inside.set()
            done.wait(60)
            found["inside"] = spark.conf.get(setting)
        found["left"] = [t.split("-")[0] for t in tables(spark) - before]

    thread = threading.Thread(target=other)
    with sparing(spark), scratch(spark):
        thread.start()
        inside.wait(60)
        materialize(spark.range(1), "mine")
        with sparing(spark):
            pass
        done.set()
        thread.join()
        assert found["left"] == ["mine"] and found["inside"] == spark.conf.get(setting) != was
    assert tables(spark) == before and spark.conf.get(setting) == was


def test_batches_end_at_bytes(spark):
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"b": [b.nbytes]}) for b in batches)
    long = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    assert max(r.b for r in materialize(long.mapInArrow(sizes, "b long"), "sizes").collect()) < 10 << 20


def test_workers_give_memory_back():
    """A pass over texts leaves little in a worker, which stays idle beside those of later stages."""
    out = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True, timeout=120).stdout
    before, after = map(int, out.split())
    assert after - before < 45_000, (before, after)


#: Prints the kB of a process without mapped files before and after a task of the Jaccard join over short and long texts.
_WORKER = r"""
import re
import numpy as np
import pyarrow as pa
from spanloom.llm import jaccard

class Frame:
    def select(self, *columns):
        return self
    def mapInArrow(self, run, schema):
        return run

def own():
    return int(re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1])

def batches():
    draw = np.random.default_rng(1)
    for i in range(8):
        texts = [" ".join(map(str, draw.integers(0, 10**6, 300 if j % 50 else 60_000))) for j in range(1000)]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000), pa.int64()), "text": texts})

run = jaccard.describe_sets(Frame(), 5, 80, np.zeros(1 << 20, np.uint8))
before = own()
for out in run(batches()):
    pass
del out
print(before, own())
"""
