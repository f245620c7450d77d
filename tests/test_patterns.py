"""Many expressions: what a match needs, windows, and the same matches as each expression alone."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.functions import text as texts
from spanloom.functions.patterns import Patterns, may_match, need, reach_of


@pytest.mark.parametrize(
    ("expression", "literals", "nocase", "reach"),
    [
        ("abc", ("abc",), False, 3),
        ("a(bc)d", ("abcd",), False, 4),
        ("(?:ab|cd)+x*", ("ab", "cd"), False, None),
        ("[a-z]+tion", ("tion",), False, None),
        ("(?i)Hello World", ("hello world",), True, 11),
        ("(?i)mouse", ("mou",), True, 5),
        (r"\bfoo\b", ("foo",), False, None),
        ("[xy]z", ("z",), False, 2),
        ("(?i:abc)def", ("def",), False, 6),
        ("(foo|ba[rz])\\d{1,3}", ("ba", "foo"), False, 6),
    ],
)
def test_what_a_match_needs(expression, literals, nocase, reach):
    found = need(expression)
    assert (found.literals, found.nocase, reach_of(expression)) == (literals, nocase, reach)


@pytest.mark.parametrize("expression", ["x?y?", "a|b*", "[a-z]+", "(a|)", "(?i)kiss", ".", "\\d+"])
def test_nothing_is_sure(expression):
    assert need(expression) is None


EXPRESSIONS = ["ab", "a[bc]+d", "(ab|cd){1,2}a", "b.?c", "(?i)AB", "a{2,3}", "(a)(b)?c", r"\bab", "d$", "[ab]c", "(?i)da?", "c*", "bb|cc|d", "(?:a|bc)(?:b|cd)", "(?s)a.{2}", "ſ|K"]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdABkKsſK \n", max_size=60), st.lists(st.sampled_from(EXPRESSIONS), min_size=1, max_size=8, unique=True))
def test_the_same_matches_as_each_alone(text, expressions):
    patterns = Patterns(expressions)
    found = [(i, m.span(), m.groups()) for i, m in patterns.matches(text)]
    assert found == [(i, m.span(), m.groups()) for i, e in enumerate(expressions) for m in re.finditer(e, text)]
    assert patterns.matching(text) == [i for i, e in enumerate(expressions) if re.search(e, text)]


def test_rows(spark):
    df = spark.createDataFrame([(1, "xx abcd ab"), (2, None), (3, ""), (4, "nothing"), (5, "ABCD " * 20_000 + "abcd")], "res long, text string")
    found = texts.find_regex(df, ["ab", "cd", "abcd"], overlap=True).collect()
    assert sorted((r.res, r.expression, r.begin, r.end) for r in found) == [(1, 0, 3, 5), (1, 0, 8, 10), (1, 1, 5, 7), (1, 2, 3, 7), (5, 0, 100_000, 100_002), (5, 1, 100_002, 100_004), (5, 2, 100_000, 100_004)]
    assert sorted(map(tuple, texts.select_expressions(df, ["ab", "(?i)CD", "z", "h"]).collect())) == [(1, 0), (1, 1), (4, 3), (5, 0), (5, 1)]
    kept = df.filter(may_match(df.text, ["ab", "z"])).collect()
    assert [r.res for r in kept] == [1, 5]
    assert may_match(df.text, ["ab", "."]) is None and may_match(df.text, ["(?i)ab"]) is None
    with pytest.raises(ValueError):
        texts.select_expressions(df, ["(?=a)b"])
