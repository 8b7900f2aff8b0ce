"""What language models answer, parsed: JSON in fences, keyword lines, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomelattice.functions.text import col, let

#: Fixed values of the decision protocol.
DECISION = "action string, selectedIndex int, selectedIndexes array<int>, reasoning string, confidence double"
LOW_CONFIDENCE, UNSAID_CONFIDENCE = 0.3, 0.7
KEYWORDS_ENOUGH = 8


def unfenced(c: Column | str) -> Column:
    """JSON cut out of a model's answer.

    An answer that opens with three backticks loses that line and what follows the last fence; text
    before the first bracket and behind the last one of its kind goes as well.
    """

    def opened(t: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(t, r"(?s)\A[^\n]*\n(.*)\z", 1), r"(?s)```(?!.*```).*\z", "")
        return F.when(t.startswith("```") & t.contains("\n"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(t)

    def cut(body: Column) -> Column:
        kind = F.regexp_extract(body, r"[\{\[]", 0)
        part = F.when(kind == "{", F.regexp_extract(body, r"(?s)\{.*\}", 0)).when(kind == "[", F.regexp_extract(body, r"(?s)\[.*\]", 0))
        return F.when(body.rlike(r"\A[\{\[]") | (kind == ""), body).otherwise(F.coalesce(F.nullif(part, F.lit("")), body))

    return let(let(F.regexp_replace(col(c), r"^\s+|\s+$", ""), opened), cut)


def parsed(c: Column | str, schema: str, strict: bool = False) -> Column:
    """JSON as a value of the schema; unknown fields don't matter.

    What can't be parsed is null, or raises if strict.
    """
    text = unfenced(c)
    kind = T._parse_datatype_string(schema)
    if isinstance(kind, T.StructType):
        if "_bad" in kind.fieldNames():
            raise ValueError("_bad is taken")
        value = F.from_json(text, T.StructType([*kind.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})
        out = let(value, lambda v: F.when(v.isNotNull() & v["_bad"].isNull(), F.struct(*(v[f].alias(f) for f in kind.fieldNames()))))
    else:
        out = F.from_json(text, kind)
    return F.coalesce(out, F.raise_error(F.lit("PROMPT_002: not the JSON asked for")).cast(kind)) if strict else out


def string_list(c: Column | str) -> Column:
    """A JSON array of strings, trimmed, without blank and null entries; an empty array if it can't be parsed."""
    entries = F.coalesce(parsed(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(entries, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def json_text(c: Column | str) -> Column:
    """A value of a struct, array or map as JSON, one of another type as a JSON scalar; null for a null.  Fields that are null stay."""
    x = col(c)
    wrapped = F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})
    return F.when(x.isNotNull(), F.regexp_extract(wrapped, r"(?s)\A\{\"v\":(.*)\}\z", 1))


def keyword_lines(c: Column | str) -> Column:
    """Keywords from an answer of one or several to a line, in lower case.

    Bullets, numbers, a label and quotation marks go; the line on which the eighth keyword is
    reached is the last.
    """
    lines = F.split(F.coalesce(col(c), F.lit("")), r"\R")

    def words(line: Column) -> Column:
        bare = F.regexp_replace(F.trim(line), r"^(?:[-*•]|\d+[.)、])\s*", "")
        bare = F.regexp_replace(bare, r"(?i)^(?:关键词|keywords?)\s*[:：]\s*", "")
        bare = F.trim(F.translate(bare, "\"'", ""))
        return F.filter(F.transform(F.split(bare, "[,，;；]"), lambda x: F.lower(F.trim(x))), lambda x: x != "")

    none = F.array().cast("array<string>")
    return F.aggregate(lines, none, lambda got, line: F.when(F.size(got) >= KEYWORDS_ENOUGH, got).otherwise(F.concat(got, words(line))))


def decision(c: Column | str, children: Column | str) -> Column:
    """A navigation decision on a node with so many children: (move, picks, reasoning, error).

    move is 'select' with one pick, 'expand' with at least one, 'fallback' or 'stop'.  A selection with
    confidence below LOW_CONFIDENCE, UNSAID_CONFIDENCE if not given, falls back; picks outside the children go,
    repeated ones count once, and with none left the walk stops.  An unknown action with an index
    selects, without one stops.  An answer that is no decision has error NAV_004.
    """
    none = F.array().cast("array<int>")

    def choices(d: Column) -> Column:
        action = F.lower(F.trim(F.coalesce(d["action"], F.lit(""))))
        wants = F.when(action == "expand_multiple", "expand").when(action == "fallback_search", "fallback").when(action == "stop", "stop").when((action == "select_child") | d["selectedIndex"].isNotNull(), "select").otherwise("stop")
        given = F.when(wants == "select", F.array(d["selectedIndex"])).when(wants == "expand", d["selectedIndexes"])
        picks = F.array_distinct(F.filter(F.coalesce(given, none), lambda i: i.isNotNull() & (i >= 0) & (i < col(children))))
        sure = F.coalesce(d["confidence"], F.lit(UNSAID_CONFIDENCE)) >= LOW_CONFIDENCE
        return F.struct(wants.alias("wants"), picks.alias("picks"), sure.alias("sure"), d["reasoning"].alias("reasoning"), d.isNull().alias("bad"))

    def judged(x: Column) -> Column:
        move = F.when(x["bad"], F.lit(None)).when((x["wants"] == "select") & ~x["sure"], "fallback").when(x["wants"].isin("select", "expand") & (F.size(x["picks"]) == 0), "stop").otherwise(x["wants"])
        return F.struct(move.alias("move"), F.when(move.isin("select", "expand"), x["picks"]).otherwise(none).alias("picks"), x["reasoning"].alias("reasoning"), F.when(x["bad"], F.lit("NAV_004")).alias("error"))

    return let(let(parsed(c, DECISION), choices), judged)
