import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from tripleloom.functions import parsers, strict_json
from tripleloom.functions.text import listed, listed_lists, strip, words
from pyspark.sql import functions as F

RAW = [
    ("[['a','r','b'],['c','r','d']]", [["a", "r", "b"], ["c", "r", "d"]]),
    ("Triplets: [['a','r','b']] done", [["a", "r", "b"]]),
    ("[[8,'r','b']]", [[8, "r", "b"]]),
    ("[['a',['b','c'],'d']]", [["a", "b, c", "d"]]),
    ("[['a',['x','y','z'],'b']]", [["x", "y", "z"], ["a", "x, y, z", "b"]]),
    ("[['a','','b']]", []),
    ("[['a',' ','b']]", [["a", " ", "b"]]),
    ("[['a','_','b']]", []),
    ("[['a',None,'b']]", [["a", None, "b"]]),
    ("[['a','b']]", []),
    ("[['a',1]]", [["a", 1]]),
    ("[['a',[1],'b']]", []),
    ("[['a]','b','c']]", []),
    ("[['a [x]','b','c']]", [["a [x]", "b", "c"]]),
    ("[]", []),
    ("[['a','b','c']", [["a", "b", "c"]]),
    ("['a','b','c'], ['d','e']]", [["a", "b", "c"]]),
    ("none", []),
    ("[1,2,3]", []),
    ("[['it's','r','b'],['c','r','d']]", [["c", "r", "d"]]),
    (None, []),
]


@pytest.mark.parametrize("text,want", RAW)
def test_raw_triples(text, want):
    assert parsers.raw_triples(text) == want


def test_policy_sets_apart_what_is_no_triple():
    assert parsers.split_triples("[[8,'r','b']]") == ([["8", "r", "b"]], [])
    assert parsers.split_triples("[['a',None,'b']]") == ([], ["['a', None, 'b']"])
    assert parsers.split_triples("[['a',1]]") == ([], ["['a', 1]"])
    assert parsers.split_triples("[['a',1]]", strict_arity=False) == ([["a", "1"]], [])


@given(st.text(alphabet="[]'\",ab1 _\\\n", max_size=60))
@settings(max_examples=300, deadline=None)
def test_bracket_soup_never_raises(text):
    parsers.raw_triples(text)
    parsers.entities(text)


@given(st.lists(st.lists(st.text(alphabet=st.characters(blacklist_characters="[]", blacklist_categories=["Cs"]), min_size=1).filter(lambda x: x != "_"), min_size=3, max_size=3), max_size=4))
@settings(max_examples=200, deadline=None)
def test_written_triples_are_read_again(triples):
    assert parsers.raw_triples(repr(triples)) == triples


@given(st.text(alphabet="[]'\", ab\\\n", max_size=40))
@settings(max_examples=500, deadline=None)
def test_short_cuts_agree_with_literals(text):
    for part in (text, f"[{text}]", f"['{text}', 'b', 'c']", f"[['a', '{text}'], [\"b\"]]"):
        value = parsers.literal(part)
        if parsers._MANY(part):
            assert isinstance(value, list) and value and all(isinstance(x, list) for x in value)
        elif parsers._ONE(part):
            assert value == [x[1:-1] for x in parsers._ITEMS(part)]


def test_deep_brackets_end_quickly():
    assert parsers.raw_triples("[" * 50_000 + "]" * 50_000) == []


@pytest.mark.parametrize("text,want", [("['a','b']", ["a", "b"]), ("Entities: ['a']\n", ["a"]), ("['a'].", ["a"]), ("['a'],", ["a"]), ("x] [y", []), ("no", []), (None, []), ("['a', 1, None]", ["a", "1"])])
def test_entities(text, want):
    assert parsers.entities(text) == want


def test_definitions(spark):
    cases = [(1, "Answer:\nr: The s: o."), (2, "Answer: r: x"), (3, "  a : b \nnote\na: c"), (4, "1. r: x"), (5, "r:"), (6, ": y"), (7, None), (8, ""), (9, " k　:\tv ")]
    df = spark.createDataFrame(cases, "doc_ord int, c string")
    got = {(r.doc_ord, r.relation): r.definition for r in parsers.definitions(df, "c", ["doc_ord"]).collect()}
    assert got == {(1, "r"): "The s: o.", (3, "a"): "c", (4, "1. r"): "x", (5, "r"): "", (6, ""): "y", (9, "k"): "v"}


def test_python_literals(spark):
    values = [["a", "it's", 'say "x"', "it's \"x\"", "b\\c", "t\tn\n", None], [], ["é"]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<string>")
    assert {r[0]: r[1] for r in df.select("i", listed(F.col("v"))).collect()} == {i: repr(v) for i, v in enumerate(values)}
    df = spark.createDataFrame([([["a", "b"], None],)], "v array<array<string>>")
    assert df.select(listed_lists(F.col("v"))).first()[0] == "[['a', 'b'], None]"


def test_strip_and_words(spark):
    df = spark.createDataFrame([(" 　 a b\t ",), ("",), (None,), ("Éa-1² x'Y 漢字",)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["a b", "", None, "Éa-1² x'Y 漢字"]
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["a", "b"], [], None, ["éa", "1²", "x", "y", "漢字"]]


@pytest.mark.parametrize(
    "text,ok",
    [("{}", True), (" [1, 2.5e3, -0] ", True), ('"\\ud800"', True), ("[1,]", False), ("NaN", False), ("01", False), ("", False), ("{} x", False), ('"a\tb"', False), ("﻿{}", False), ("[" * 100_000 + "]" * 100_000, True), ("[" * 100_000 + "]" * 99_999, False), ('{"a":' * 50_000 + "1" + "}" * 50_000, True), ("9" * 10_000, True)],
)
def test_strict_json(text, ok):
    assert strict_json.parse(text)[0] is ok


def test_deep_json_agrees_with_the_decoder():
    random.seed(5)
    alphabet = ["{", "}", "[", "]", ",", ":", '"a"', "1", "true", " "]
    for _ in range(20_000):
        text = "".join(random.choices(alphabet, k=random.randint(1, 7)))
        assert strict_json._deep(text) is strict_json.parse(text)[0], text


def test_parsed_columns(spark):
    df = spark.createDataFrame([(1, "[['a','r','b'],['x',None,'y']]"), (2, None)], "i int, c string")
    got = rows(df.select("i", parsers.parsed_triples(F.col("c")).alias("p")).select("i", "p.triples", "p.rejects"))
    assert got == [(1, [["a", "r", "b"]], ["['x', None, 'y']"]), (2, [], [])]
