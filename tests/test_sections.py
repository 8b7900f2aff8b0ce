"""Section splitting, in SQL form and as a fold."""

import random

import pytest

from tomelattice.operators import sections as S


@pytest.mark.parametrize(
    ("text", "titles"),
    [
        ("# 仓库须知\n先清点\n\n## 2.3 货位\n再贴签\n", ["仓库须知", "2.3 货位"]),
        ("# a\n```bash\n# comment\n```\n", ["a"]),
        ("第三节 值班\n早晚各一\n\n二、交接\n当面点清\n", ["第三节 值班", "二、交接"]),
        ("随手记下\n# 雨季\n查排水\n## 屋面\n补瓦片\n", ["前言", "雨季", "屋面"]),
        ("x", ["正文"]),
        (" \n\t\n", []),
        ("", []),
        ("# A #\n~~~\n```\n# no\n~~~\n# B\n", ["A #", "B"]),
        ("﻿# BOM\nx", ["BOM"]),
        ("```\n# open to the end", ["正文"]),
    ],
)
def test_titles(spark, text, titles):
    assert [p.title for p in S.line_sections(text, 100_000)] == titles
    df = spark.createDataFrame([(1, text, "clash")], "id int, t string, section string")
    assert [r.title for r in S.sections(df, "id", "t").orderBy("section").collect()] == titles


def test_long_lines():
    parts = S.line_sections("nine words\n" * 100, 200)
    assert [p.title for p in parts[:3]] == ["正文", "正文 (2)", "正文 (3)"] and all(p.end - p.start <= 200 for p in parts)
    assert [p.end - p.start for p in S.line_sections("a" * 500, 200)] == [200, 200, 100]
    assert all(b - a <= 200 for a, b in S.window_sections("nine words\n" * 100, 200))


@pytest.mark.parametrize("charset", ["utf-8", "utf-16-le", "gbk"])
def test_offsets_cover_text(charset):
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["a", "中", " ", "\n", "# h\n", "```\n", "x" * 150, "。"], k=rng.randint(0, 300)))
        data = text.encode(charset)
        at = 0
        for p in S.line_sections(text, 200, charset):
            assert p.start >= at and not text[at : p.start].strip()
            assert data[p.byte_offset : p.byte_offset + p.byte_length].decode(charset) == text[p.start : p.end]
            at = p.end
        assert not text[at:].strip()


def test_sql_form_agrees_with_fold(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a\n", "中\n", "\n", "# h1\n", "## h 2 \n", "```\n", "~~~\n", "第二节\n", "三、x\n", " b"], k=rng.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got: dict = {}
    for r in S.sections(df, "id", "t").orderBy("doc", "section").collect():
        got.setdefault(r.doc, []).append((r.title, r.level, r.start))
    for i, t in enumerate(texts):
        assert got.get(i, []) == [(p.title, p.level, p.start) for p in S.line_sections(t, 10**6)], t


def test_chunks(spark):
    rows = [("a", "A", "# x\none\n# y\n" + "two\n" * 400), ("b", " ", "short"), ("c", "C", None), ("d", "D", " ")]
    df = spark.createDataFrame(rows, "id string, title string, content string")
    auto = {r.chunk_id: r for r in S.chunks(df, threshold=1000).collect()}
    assert auto["b#0"].section_title == "文档" and auto["a#1"].section_title == "y" and "c#0" not in auto and "d#0" not in auto
    assert {r.chunk_id for r in S.chunks(df, policy="WHOLE").collect()} == {"a#0", "b#0"}
    assert len([c for c in auto if c.startswith("a")]) >= 3
    with pytest.raises(ValueError):
        S.by_chapter("X", "content")


def test_byte_range(spark):
    df = spark.createDataFrame([("ä中x",)], "t string")
    got = lambda a, n: df.select(S.byte_range("t", S.F.lit(a), S.F.lit(n)).alias("x")).first().x
    assert got(2, 3) == "中" and got(0, 0) == "" and got(0, -1) == ""
    with pytest.raises(Exception, match="STORAGE_003"):
        got(0, 99)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id int, t string")
    for f in (lambda: S.lines(df, "id", "t"), lambda: S.sections(df, "id", "t"), lambda: S.cut_texts(df, "id", "t", 200)):
        assert f().count() == 0
