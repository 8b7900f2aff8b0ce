"""Scalar functions against the values fixed for them."""

import pytest
from pyspark.sql import functions as F

from tomelattice.functions import parsing
from tomelattice.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def s(v):
    return F.lit(v).cast("string")


def test_md5_and_keys(spark):
    assert one(spark, F.md5(s("hello"))) == "5d41402abc4b2a76b9719d911017c592"
    assert one(spark, F.md5(s(""))) == "d41d8cd98f00b204e9800998ecf8427e"
    assert one(spark, X.cache_key(F.lit("EXTRACT_KEYWORDS"), s("hello"))) == "extract_keywords:5d41402abc4b2a76b9719d911017c592"
    assert one(spark, X.cache_key(F.lit("a"), s(None))) == "a:null"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("hello world", "hello xorld", True), ("aaaaa", "bbbbb", False), (None, "a", False), ("Hello  World ", "hello world", True), ("", "", True), ("hello", "", False), ("a" * 600, "a" * 600, True), ("a" * 600, "a" * 599 + "b", False)],
)
def test_similar(spark, a, b, same):
    assert one(spark, X.similar(s(a), s(b))) is same
    assert one(spark, X.similar(s(a), s(b), enabled=False)) is False


def test_thresholds_out_of_range():
    assert [X.threshold_or_default(t) for t in (1.5, -0.5, float("nan"), 0.5)] == [0.85, 0.85, 0.85, 0.5]


def test_strings(spark):
    assert one(spark, X.normalized(s("\x01 Java\t"))) == "java"
    assert one(spark, X.normalized(s(" \x1f"))) is None
    assert one(spark, X.truncated(s("a😀b"), 2)) == "a😀"
    assert one(spark, X.truncated(s("a"), 0)) == ""
    assert one(spark, X.truncated(s(None), 3)) is None
    assert one(spark, X.tokens(s(" Alpha  beta alpha "))) == ["alpha", "beta", "alpha"]
    assert one(spark, X.safe_name(s('a/b:c*"x"'))) == "a_b_c__x_"
    assert one(spark, X.safe_name(s(" "))) == "document"
    assert one(spark, X.file_name(s("/a/b/c.txt"))) == "c.txt"
    assert one(spark, X.valid_base_name(s("a-b_1"))) and not one(spark, X.valid_base_name(s("a b"))) and not one(spark, X.valid_base_name(s("a" * 51)))
    assert one(spark, X.summary_budget(s("a" * 20_000))) == "a" * 20_000
    assert len(one(spark, X.summary_budget(s("a" * 20_001)))) == 20_005
    assert one(spark, X.leaf_name(s(" "), s(None), s("t"), s("id"))) == "t"
    assert one(spark, X.numbered(F.array(s("a "), s("b")))) == "[1] a\n\n[2] b"
    assert one(spark, X.described(F.array(s("a"), s("b")), F.array(s("x"), s(None)))) == "[0] a - x\n[1] b - "
    assert one(spark, X.similarity(s("kitten"), s("sitting"))) == pytest.approx(1 - 3 / 7)


@pytest.mark.parametrize(
    ("answer", "json"),
    [('```json\n{"a": 1}\n```', '{"a": 1}'), ('so {"a": {"b": 2}} then', '{"a": {"b": 2}}'), ("no", "no"), ("[1, 2] x", "[1, 2] x"), ("x [1] {", "[1]"), ("```\n[1]\n``` and ```", "[1]\n``` and"), ("a } {", "a } {")],
)
def test_unfenced(spark, answer, json):
    assert one(spark, parsing.unfenced(s(answer))) == json


def test_parsed(spark):
    assert one(spark, parsing.parsed(s('{"a": 1, "z": 2}'), "a int")).a == 1
    assert one(spark, parsing.parsed(s("no"), "a int")) is None
    assert one(spark, parsing.parsed(s(None), "a int")) is None
    assert one(spark, parsing.string_list(s('["a", " ", null, " b "]'))) == ["a", "b"]
    assert one(spark, parsing.string_list(s("no"))) == []
    with pytest.raises(Exception, match="PROMPT_002"):
        one(spark, parsing.parsed(s("no"), "a int", strict=True))


def test_keyword_lines(spark):
    assert one(spark, parsing.keyword_lines(s("- Java\n2. 'Spring', Boot；云\n关键词：测试\n\n"))) == ["java", "spring", "boot", "云", "测试"]
    assert one(spark, parsing.keyword_lines(s(None))) == []
    assert one(spark, parsing.keyword_lines(s("a,b,c,d,e,f,g\nh,i\nj"))) == list("abcdefghi")


@pytest.mark.parametrize(
    ("answer", "move", "picks", "error"),
    [
        ('{"action": "select_child", "selectedIndex": 1, "confidence": 0.95}', "select", [1], None),
        ('{"action": "select_child", "selectedIndex": 1, "confidence": 0.2}', "fallback", [], None),
        ('{"action": "select_child", "selectedIndex": 9}', "stop", [], None),
        ('{"action": "expand_multiple", "selectedIndexes": [1, 0, 1, 99, null]}', "expand", [1, 0], None),
        ('{"action": "expand_multiple", "selectedIndexes": [99]}', "stop", [], None),
        ('{"action": "what", "selectedIndex": 0}', "select", [0], None),
        ('{"action": "what"}', "stop", [], None),
        ("not JSON", None, [], "NAV_004"),
    ],
)
def test_decisions(spark, answer, move, picks, error):
    d = one(spark, parsing.decision(s(answer), F.lit(3)))
    assert (d.move, d.picks, d.error) == (move, picks, error)
