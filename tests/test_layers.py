"""Layers of pieces cut in the texts' rows, and the store that is made of them where it is read."""

import os
import random

from pyspark.sql import functions as F

from spanloom.functions import text as texts
from spanloom.plans import catalogue, derive

ROWS = [(0, "the cat\nsat  \n"), (1, None), (2, ""), (3, "alone"), (4, " \n\n"), (5, "é ü\nñandú 語\n語"), (6, "a\nb\na b")]


def plain(rows, separators):
    out, known = [], {}
    for res, text in rows:
        for layer, marks in enumerate(separators):
            begin = 0
            cut = "".join("\0" if c in marks else c for c in text or "").split("\0")
            for pos, piece in enumerate(cut):
                if piece:
                    out.append((res, layer, pos, begin, begin + len(piece), piece))
                    known.setdefault(res, set()).add((begin, begin + len(piece)))
                begin += len(piece) + 1
    ranks = {res: {s: i for i, s in enumerate(sorted(spans))} for res, spans in known.items()}
    return sorted((*row, ranks[row[0]][row[3:5]]) for row in out), known


def test_layers(spark):
    rng = random.Random(3)
    rows = ROWS + [(7 + i, "".join(rng.choices("ab é語 \n", k=rng.randrange(60)))) for i in range(80)] + [(90, "long wörd\n" * 40_000)]
    wanted, known = plain(rows, derive.SEPARATORS)
    df = texts.layers(spark.createDataFrame(rows, "res long, text string"), list(derive.SEPARATORS), piece=True, ranks=True)
    found = df.collect()
    assert sorted((r.res, r.layer, r.pos, r.begin, r.end, r.piece, r.ts) for r in found) == wanted
    fresh = [(r.res, r.begin, r.end) for r in found if not r.again]
    assert len(fresh) == len(set(fresh)) and set(fresh) == {(res, *s) for res, spans in known.items() for s in spans}


def test_the_corpus_is_not_stored(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "de", "src1", 0) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    count = lambda: sum(len(files) for _, _, files in os.walk(folder))
    before = count()
    store = derive.corpus(spark, str(tmp_path))
    known = plain(ROWS, derive.SEPARATORS)[1]
    rows = store.textselections.collect()
    assert sorted((r.res, r.begin, r.end) for r in rows) == sorted((res, *s) for res, spans in known.items() for s in spans)
    assert "Exchange" not in store.textselections._jdf.queryExecution().toString()
    assert store.spans().join(store.textselections, ["res", "ts", "begin", "end"]).count() == store.spans().count() == sum(1 for _ in plain(ROWS, derive.SEPARATORS)[0])
    found = catalogue.queries()["count_annotations_per_key"](spark, str(tmp_path)).filter("key_id = 'type'").select(F.col("n")).first().n
    assert found == store.spans().count()
    assert count() == before
