"""Many documents of their own: they are moved and named with few calls for each."""

from spanloom.sources import includes


def test_names_are_qualified_at_once(spark, tmp_path, monkeypatch):
    names = [f"texts/d{i}.txt" for i in range(50)] + ["a b.txt", "../x.txt", "é.txt", "50%.txt", "./y"]
    each = [includes.full_name(spark, includes.beside(str(tmp_path), n)) for n in names]
    asked, plain = [], includes.full_name
    monkeypatch.setattr(includes, "full_name", lambda s, p: asked.append(p) or plain(s, p))
    assert includes.full_names(spark, str(tmp_path), names) == each
    assert len(asked) == 6


def test_documents_replace_what_is_there(spark, tmp_path):
    rows = [(f"t/d{i}.txt", f"text {i % 3}") for i in range(40)] + [("odd name%.txt", "é\n")]
    (tmp_path / "out/t/d1.txt").mkdir(parents=True)
    (tmp_path / "out/t/d2.txt").write_text("old")
    (tmp_path / "out/t/none.txt").write_text("old")
    includes.write_texts(spark.createDataFrame(rows, "doc string, text string"), f"{tmp_path}/aside")
    includes.move_documents(spark, [f"{tmp_path}/aside", f"{tmp_path}/missing"], f"{tmp_path}/out", [n for n, _ in rows] + ["t/none.txt", "new/none.txt"])
    for name, text in rows:
        assert (tmp_path / "out" / name).read_text() == text
    assert (tmp_path / "out/t/none.txt").read_text() == (tmp_path / "out/new/none.txt").read_text() == ""
    found = includes.read_texts_of(spark, f"{tmp_path}/out", [n for n, _ in rows]).collect()
    assert sorted(map(tuple, found)) == sorted(rows)


def test_each_job_of_texts_reads_its_own(spark, tmp_path):
    rows = [(f"d{i}, x=y.txt", f"text {i}" + ".!?é\n"[i % 5]) for i in range(50)] + [("none.txt", "")]
    texts = spark.createDataFrame(rows, "doc string, text string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    includes.write_texts(texts.mapInArrow(counted, texts.schema), f"{tmp_path}/[a]/aside")
    assert seen.value == len(rows)  # read once, and not for each last character
    found = includes._written(spark, f"{tmp_path}/[a]/aside")
    assert sorted(found) == sorted(doc for doc, text in rows if text) and all(len(parts) == 1 for parts in found.values())
    includes.move_documents(spark, [f"{tmp_path}/[a]/aside"], f"{tmp_path}/out", [doc for doc, _ in rows])
    assert {doc: (tmp_path / "out" / doc).read_bytes().decode() for doc, _ in rows} == dict(rows)


def test_many_texts_are_read_in_several_scans(spark, tmp_path, monkeypatch):
    rows = [(f"d{i}.txt", f"text {i}" * (i % 7)) for i in range(25)]
    for doc, text in rows:
        (tmp_path / doc).write_text(text)
    monkeypatch.setattr(includes, "FILES", 10)
    listed, plain = [], type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, paths, **o: listed.append(len(paths)) or plain(self, paths, **o))
    assert sorted(map(tuple, includes.read_texts_of(spark, str(tmp_path), [doc for doc, _ in rows]).collect())) == sorted(rows)
    assert listed == [10, 10, 5]
