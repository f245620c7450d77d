"""Resampling, infilling and fingerprints: plain versions, edge cases, SQL."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import fingerprints, infilling, resampling

SF = "/root/testdata/sf0.001"
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
LONG = "Größe und 長い文 with 𝔘nicode " * 4_000
TEXTS = [None, "", "one", "two words", "Ein Satz, mit über-langen Wörtern!\n\tUND Zahlen 42.", "長い文 abc 𝔘", "a<P>b", "a < S > b", "x" * 300, "same text " * 30, "same text " * 30, LONG, "é" * 50 + " 🙂🙂 " + "z" * 70]
IDS = [None, 3, 5, 5, 8, 9, 10, 11, 12, 13, 13, 20, 21]


def frame(spark, rows=None):
    """Rows with clashing names in other cases and another column."""
    rows = list(zip(IDS, TEXTS, strict=True)) if rows is None else rows
    return spark.createDataFrame([(i, t, 1, "mine", "x") for i, t in rows], "doc_id long, text string, SCORE int, Output string, other string")


def against_sql(rows, sql):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    there = con.sql(sql)
    assert sorted(there.columns) == sorted(rows.columns)
    order = ", ".join(f'"{c}"' for c in sorted(there.columns))
    none = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(none, con.sql(f"SELECT {order} FROM there").fetchall())) == sorted(none(r) for r in rows.select(*sorted(there.columns)).collect())


# --- resampling ------------------------------------------------------------------------------------------------------


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_features(text):
    w = plain_words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain_resample(rows, target, percent, least, buckets, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in xs for f in plain_features(x)) for xs in ([r[1] for r in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in rows:
        g = [gain(bucket(f)) for f in plain_features(text)]
        weight = sum(g) // len(g) if g else 0
        h = int(SHA(f"{seed}:{'' if i is None else i}")[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted(((r[0] is None, r[0] or 0, *r[1:4], r[4] is None, r[4]) for r in out), key=str)


@pytest.mark.parametrize("percent", [0, 1, 40, 100])
def test_resampling_equals_a_plain_version(spark, percent):
    rows = [*zip(IDS, TEXTS, strict=True), *((100 + i, f"common words {i % 7} and number {i}") for i in range(60)), *[(100, "common words again")] * 40]
    target = ["common words", "number 42", None, ""]
    found = resampling.resample(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), percent, 2, 97, 3)
    assert found.columns == ["doc_id", "text", "Output", "other", "n_features", "weight", "score", "rank"]
    here = [(r.doc_id is None, r.doc_id or 0, r.n_features, r.weight, r.score, r["rank"] is None, r["rank"]) for r in found.collect()]
    assert sorted(here, key=str) == plain_resample(rows, target, percent, 2, 97, 3)


def test_resampling_of_empty_tables(spark):
    none, some = frame(spark, []), frame(spark)
    assert resampling.resample(none, some).count() == 0
    found = resampling.resample(some, none, 100, 0, keep=["doc_id"]).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, len(IDS) + 1))


def test_crcs_of_long_words_and_of_words_one_after_the_other():
    import numpy as np

    words = [b"a", b"x" * 63, b"x" * 64, b"y" * 65, "übergroß".encode(), b"z" * 5_000]
    chars, lengths = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    crc = resampling.word_crcs(chars, lengths)
    assert crc.tolist() == [zlib.crc32(w) for w in words]
    assert resampling.joined_crcs(crc, crc[::-1], lengths[::-1]).tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[::-1], strict=True)]


def test_resampling_equals_sql(spark):
    against_sql(resampling.op11_resampling(spark, SF), resampling.OP11_SQL)


# --- infilling -------------------------------------------------------------------------------------------------------


def plain_infill(i, text, plain, spm, seed):
    text = text or ""
    n, digits = len(text), SHA(f"{seed}:{'' if i is None else i}")
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("plain", "spm", "seed"), [(10, 20, 1), (0, 100, 2), (0, 0, 3), (0, 50, 4), (100, 50, 5)])
def test_infilling_equals_a_plain_version_and_is_restored(spark, plain, spm, seed):
    found = infilling.infill(frame(spark), plain, spm, seed).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
    assert found.columns == ["doc_id", "text", "SCORE", "other", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    rows = found.collect()
    assert len(rows) == len(IDS)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(r.doc_id, r.text, plain, spm, seed)
        assert r.back == (r.text or "")
    assert infilling.infill(frame(spark, [])).count() == 0


def test_runs_hold_the_text(spark):
    for r in infilling.runs(frame(spark)).collect():
        text, byte, unit = r.text or "", 0, 0
        assert bool(r.runs) == bool(text)
        ends = [(x.unit, x.byte) for x in r.runs[1:]] + [(len(text), len(text.encode()))]
        widths = [x.width for x in r.runs]
        assert all(a != b for a, b in zip(widths, widths[1:], strict=False))
        for x, (next_unit, next_byte) in zip(r.runs, ends, strict=bool(text)):
            assert (x.unit, x.byte) == (unit, byte) and next_byte - x.byte == (next_unit - x.unit) * x.width
            assert all(len(c.encode()) == x.width for c in text[unit:next_unit])
            unit, byte = next_unit, next_byte


def test_infilling_equals_sql(spark):
    against_sql(infilling.op12_infilling(spark, SF), infilling.OP12_SQL)


# --- fingerprints ----------------------------------------------------------------------------------------------------


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chain(parts):
    seed = 42
    for b in parts:
        seed = xxhash.xxh64(b, seed=seed).intdigest()
    return signed(seed)


def plain_fingerprint(text):
    units = [chain([u.encode()]) for u in re.findall("[\x21-\x7E\xa1-\u0dff]{1,16}|[^\x20\x09-\x0D]", text)]
    kmers = [chain([struct.pack("<q", u) for u in units[i : i + 3]]) for i in range(max(len(units) - 2, min(1, len(units))))]
    seen, items = Counter(), []
    for place, h in enumerate(kmers):
        items.append((chain([struct.pack("<q", h >> 31), struct.pack("<i", seen[h >> 31])]) >> 31, place))
        seen[h >> 31] += 1
    out = []
    for slot in range(-16, 16):
        places = sorted(p for _, p in sorted(x for x in items if x[0] >> 28 == slot)[:2])
        value = chain([struct.pack("<q", kmers[p]) for p in places]) >> 32 if places else 0
        out.append(value or 1 if places else 0)
    return out


def plain_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_fingerprints_equal_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in frame(spark).select("doc_id", "text").collect()] + [(8, TEXTS[4])] * 5
    found = fingerprints.next_edited(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), chain([r[1].encode()])))
    expected = {}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own, changed, then = map(plain_fingerprint, (text, edited, following))
        expected[(i, len(text), SHA(edited))] = (own, changed, plain_likeness(own, changed), plain_likeness(own, then))
    counts = Counter((i, t or "") for i, t in rows)
    assert Counter((r.doc_id, r.n_chars) for r in found) == Counter({k: v for k, v in Counter((i, len(t)) for (i, t), n in counts.items() for _ in range(n)).items()})
    for r in found:
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == expected[(r.doc_id, r.n_chars, r.edited_sha256)]


def test_fingerprints_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ORDERED", 3)
    rows = [(i * 37 % 101, f"text number {i} of some words") for i in range(40)]
    found = {r.doc_id: r.edited_sha256 for r in fingerprints.next_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text) // 3
        assert found[i] == SHA(text[: len(text) - cut] + following[:cut])


def test_fingerprints_feel_order_and_edits(spark):
    words = [f"w{i}" for i in range(400)]
    near, turned, far = words[:200] + ["new"] + words[200:], words[200:] + words[:200], [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(t)) for i, t in enumerate((words, near, turned, far))]
    out = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    like = lambda i: plain_likeness(out[0], out[i])
    assert like(1) > 0.8 > like(2) > like(3) == 0
    carried = fingerprints.fingerprint(frame(spark).withColumnRenamed("other", "FINGERPRINT"))
    assert carried.columns == ["doc_id", "text", "SCORE", "Output", "fingerprint"]
    assert fingerprints.next_edited(frame(spark, [])).count() == 0
    single = fingerprints.next_edited(frame(spark, [(1, "abc def ghi")])).first()
    assert single.edited_sha256 == SHA("abc def abc") and single.near_next == 1.0


def test_a_text_column_in_another_case(spark):
    docs = spark.createDataFrame([(1, "one two three", 7), (2, None, 8)], "doc_id long, Text string, N_WORDS int")
    found = resampling.resample(docs, docs, 100, 2).orderBy("doc_id")
    assert found.columns == ["doc_id", "Text", "N_WORDS", "n_features", "weight", "score", "rank"]
    assert [(r.N_WORDS, r.n_features, r["rank"]) for r in found.collect()] == [(7, 5, 1), (8, 0, None)]
    made = infilling.infill(docs, 0).orderBy("doc_id")
    assert made.columns == ["doc_id", "Text", "N_WORDS", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert [r.n for r in made.collect()] == [13, 0] and [len(r.runs) for r in infilling.runs(docs).orderBy("doc_id").collect()] == [1, 0]
    assert [len(r.fingerprint) for r in fingerprints.fingerprint(docs).collect()] == [32, 32]
