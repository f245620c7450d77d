"""Annotations mapped through pivots, on a small store where every result is known."""

import pytest

from spanloom.model import Store, settled
from spanloom.operators import alignment, mutations
from tests.test_core import datum, leaf


def text(r, b, e):
    return leaf("TextSelector", r, begin=b, end=e)


def fixed(s):
    """s without its lineage, in one partition a table."""
    return s.with_tables(**{n: settled(t.coalesce(1)) for n, t in s.tables().items()})


def side(a):
    return ("AnnotationSelector", None, a, None, None, None, None, None, None)


D = "DirectionalSelector"


@pytest.fixture(scope="module")
def store(spark):
    base = mutations.add_resources(Store.empty(spark), spark.createDataFrame([("r", "one two three four"), ("s", "three four one two"), ("u", "uno dos tres cuatro")], "id string, text string"))
    first = [
        ("r.side", D, [text("r", 0, 7), text("r", 8, 18)], [datum("side", "r")]),
        ("s.side", D, [text("s", 11, 18), text("s", 0, 10)], [datum("side", "s")]),
        ("r.words", D, [text("r", 0, 4), text("r", 4, 8), text("r", 8, 14), text("r", 14, 18)], [datum("side", "r")]),
        ("u.words", D, [text("u", 0, 4), text("u", 4, 8), text("u", 8, 13), text("u", 13, 19)], [datum("side", "u")]),
        ("r.one", None, [text("r", 14, 18)], [datum("side", "r1")]),
        ("u.one", None, [text("u", 13, 19)], [datum("side", "u1")]),
        ("simple", D, [text("r", 0, 7), text("s", 11, 18)], [datum("pivot", "t")]),
        ("two", None, [text("r", 4, 7)], [datum("word", "two")]),
        ("three", None, [text("s", 0, 5)], [datum("word", "three")]),
        ("gap", None, [text("r", 4, 14)], [datum("word", "gap")]),
        ("pair", D, [text("r", 12, 14), text("r", 0, 3)], [datum("word", "pair")]),
        ("tiled", None, [text("r", 0, 8)], [datum("word", "tiled")]),
        ("half", None, [text("r", 0, 6)], [datum("word", "half")]),
        ("point", None, [text("r", 8, 8)], [datum("word", "point")]),
        ("last", None, [text("r", 14, 18)], [datum("word", "last")]),
        (None, None, [text("r", 0, 3)], [datum("word", "nameless")]),
        ("joined", None, [text("r", 0, 18)], [datum("word", "joined")]),
    ]
    then = [("complex", D, [side("r.side"), side("s.side")], [datum("pivot", "t")]), ("words", D, [side("r.words"), side("u.words")], [datum("pivot", "w")]), ("single", D, [side("r.one"), side("u.one")], [datum("pivot", "w")])]
    return fixed(mutations.annotate(base, spark.createDataFrame(first + then, mutations.BUILDERS)))


def named(store, *ids):
    return store.annotations.filter(store.annotations.id.isin(*ids)).select("a")


def found(store, ids, pivot, config):
    rows = alignment.map_annotations(store, named(store, *ids), named(store, pivot), config).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.complex, [(t.resource, t.begin, t.end) if t.resource else t.annotation for t in r.targets], [(d.key, d.value.s) for d in r.data]) for r in rows}


TR, TL = alignment.TransposeConfig, alignment.TranslateConfig


def test_transposed(store):
    for pivot, names in (("simple", {"two": [("s", 15, 18)]}), ("complex", {"two": [("s", 15, 18)], "three": [("r", 8, 13)]})):
        out, want = found(store, [*names], pivot, TR()), {}
        for name, target in names.items():
            at = 1 if name == "two" else 0
            new = f"{name}-{pivot}-{at}-mapped"
            want |= {new: (None, target, [("word", name)]), f"{name}-{pivot}-mapping": (D, [name, new] if at else [new, name], [("Transposition", None)])}
        assert out == want


def test_cut_and_uncovered(store):
    # 'two three' has the blank between the segments: no side covers it. 'half' is inside one segment.
    out = found(store, ["pair", "half", "gap"], "complex", TR())
    assert not [k for k in out if k.startswith("gap")]
    assert out["pair-complex-1-mapped"][:2] == (D, [("s", 11, 14), ("s", 4, 6)])
    assert out["half-complex-1-mapped"][:2] == (None, [("s", 11, 17)])
    cut = found(store, ["half"], "words", TR())
    assert cut["half-words-source"] == (D, [("r", 0, 4), ("r", 4, 6)], [("word", "half")])
    assert cut["half-words-1-mapped"][1] == [("u", 0, 4), ("u", 4, 6)]
    assert cut["half-words-resegmentation"] == (D, ["half", "half-words-source"], [("Resegmentation", None)])
    assert cut["half-words-mapping"][1] == ["half-words-source", "half-words-1-mapped"]
    assert set(found(store, ["half"], "words", TR(no_resegmentation=True))) == set(cut) - {"half-words-resegmentation"}
    assert set(found(store, ["two"], "complex", TR(no_pivot=True))) == {"two-complex-1-mapped"}


def test_options(store):
    assert found(store, ["two"], "complex", TR(allow_simple=True, pivot_id="new")) == {"new": (D, [("r", 4, 7), ("s", 15, 18)], [("Transposition", None)])}
    assert found(store, ["two"], "complex", TR(side=1)) == {}
    assert set(found(store, ["two"], "complex", TR(pivot_id="p", target_ids=("t",)))) == {"t", "p"}


def test_sources_without_ids(store, spark):
    nameless = store.annotations.filter("id is null").select("a")
    rows = {r.id: [t.annotation or (t.resource, t.begin, t.end) for t in r.targets] for r in alignment.map_annotations(store, nameless, named(store, "simple"), TR(source_id="src", target_ids=("t",), pivot_id="p")).collect()}
    assert rows == {"src": [("r", 0, 3)], "t": [("s", 11, 14)], "p": ["src", "t"]}
    res = {r.id: r.res for r in store.resources.collect()}
    spans = spark.createDataFrame([(5, 0, res["s"], 11, 14)], "key long, pos int, res long, begin int, end int")
    rows = {r.id: [t.annotation or (t.resource, t.begin, t.end) for t in r.targets] for r in alignment.map_spans(store, spans, named(store, "simple"), TR()).collect()}
    assert rows == {"set5-simple-0-mapped": [("r", 0, 3)], "set5-simple-source": [("s", 11, 14)], "set5-simple-mapping": ["set5-simple-0-mapped", "set5-simple-source"]}


def test_translated(store):
    out = found(store, ["tiled", "half", "last"], "words", TL())
    assert out["last-words-1-mapped"] == (None, [("u", 13, 19)], [("word", "last")])
    assert out["tiled-words-source"][1] == [("r", 0, 4), ("r", 4, 8)] and out["tiled-words-1-mapped"][1] == [("u", 0, 4), ("u", 4, 8)]
    assert out["tiled-words-resegmentation"][2] == [("Resegmentation", None)]
    assert not [k for k in out if k.startswith("half")]
    # Only pivots of annotations translate, also those with one segment a side.
    assert found(store, ["two"], "simple", TL()) == {}
    assert found(store, ["last"], "single", TL())["last-single-1-mapped"][1] == [("u", 13, 19)]


def test_joined_and_points(store):
    out = found(store, ["joined"], "words", TL(no_resegmentation=True))
    assert out == {"joined-words-1-mapped": (None, [("u", 0, 19)], [("word", "joined")]), "joined-words-mapping": (D, ["joined", "joined-words-1-mapped"], [("Translation", None)])}
    assert found(store, ["tiled"], "words", TL(allow_simple=True, pivot_id="p")) == {"p": (D, [("r", 0, 8), ("u", 0, 8)], [("Translation", None)])}
    # The point at 8 ends segment 1, before it begins segment 2.
    assert found(store, ["point"], "words", TL())["point-words-1-mapped"][1] == [("u", 8, 8)]


def test_stored(store):
    new = alignment.map_annotations(store, named(store, "two", "tiled"), named(store, "words"), TL())
    more = mutations.annotate(store, new.select("id", "complex", "targets", "data"))
    assert more.annotations.count() == store.annotations.count() + new.count()
    changed = alignment.translate_in_place(store, named(store, "tiled", "pair"), named(store, "words"))
    tiled = named(changed, "tiled")
    assert [(r.begin, r.end) for r in changed.spans().join(tiled, "a").orderBy("pos").collect()] == [(0, 8), (0, 8)]
    assert changed.annotation_data.join(tiled, "a").count() == 2 and changed.annotation_data.join(named(changed, "pair"), "a").count() == 1
    assert sorted(r.valid for r in alignment.valid_pivots(store, named(store, "words", "two")).collect()) == [False, True]
