"""Documents cut into sections along their headings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomelattice.functions.text import col, is_blank, trimmed

#: Names of sections without a heading, numerals of chapters, sizes.
BODY, PREFACE, WHOLE = "正文", "前言", "文档"
NUMERALS = "一二三四五六七八九十百千"
LEAST_SECTION, LEAST_THRESHOLD, THRESHOLD, PROMPT_CHARS = 200, 1000, 100_000, 4000

# A heading has no line end of any kind within it.
_ANY = r"[^\n\r\u0085\u2028\u2029]*"
_ATX = rf"^(#{{1,6}})[ \t]+({_ANY}?)[ \t]*$"
_CHAPTER = rf"^第[{NUMERALS}0-9]+[章节篇部](?:[ \t]{_ANY})?$"
_ITEM = rf"^[{NUMERALS[:10]}]+、{_ANY}$"
_FENCE = r"^\s*(`{3,}|~{3,})"


def heading(line: Column | str) -> Column:
    """(level, title) of a heading line, null for another; a byte order mark before it doesn't matter."""
    x = F.regexp_replace(col(line), "^﻿|\r$", "")
    full = lambda p: p.removesuffix("$") + r"\z"
    atx = trimmed(F.regexp_extract(x, full(_ATX), 2))
    bare = trimmed(x)
    level = F.when(atx != "", F.length(F.regexp_extract(x, full(_ATX), 1))).when(bare.rlike(full(_CHAPTER)), 1).when(bare.rlike(full(_ITEM)), 2)
    return F.when(level.isNotNull(), F.struct(level.cast("int").alias("level"), F.when(atx != "", atx).otherwise(bare).alias("title")))


def _fenced(lines: Column) -> Column:
    """(first, last) line numbers of the code fences; one left open reaches to the end.

    A fence is closed by a line of the same character, at least as often as in the opening one.
    """
    mark = lambda x: F.regexp_extract(x, _FENCE, 1)
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), mark(x).alias("mark"))), lambda m: m["mark"] != "")
    start = F.struct(F.array().cast("array<struct<first: int, last: int>>").alias("done"), F.lit(None).cast("struct<i: int, mark: string>").alias("open"))

    def step(s: Column, m: Column) -> Column:
        closes = s["open"].isNotNull() & (F.left(m["mark"], F.lit(1)) == F.left(s["open"]["mark"], F.lit(1))) & (F.length(m["mark"]) >= F.length(s["open"]["mark"]))
        done = F.when(closes, F.concat(s["done"], F.array(F.struct(s["open"]["i"].alias("first"), m["i"].alias("last"))))).otherwise(s["done"])
        left = F.when(closes, F.lit(None)).when(s["open"].isNull(), m).otherwise(s["open"])
        return F.struct(done.alias("done"), left.cast("struct<i: int, mark: string>").alias("open"))

    return F.aggregate(marks, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["open"]["i"].alias("first"), F.size(lines).alias("last"))))))


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no, start, chars, level, title): every line, numbered from 0, with its offset and heading.

    chars doesn't count the line's end; headings in code fences are none.  A null text has no lines,
    an empty one a single empty line.  Only numbers and titles are shuffled, not the text.
    """
    cut = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.split(F.col(text), "\n").alias("_lines"))
    cut = cut.withColumn("_fences", _fenced(F.col("_lines")))
    marked = F.transform("_lines", lambda x, i: F.struct(x.alias("line"), F.exists("_fences", lambda f: (i >= f["first"]) & (i <= f["last"])).alias("inside")))
    each = cut.select("doc", F.posexplode(marked).alias("line_no", "_x"))
    flat = each.select("doc", "line_no", F.length("_x.line").alias("chars"), (~is_blank(F.col("_x.line"))).alias("written"), F.when(~F.col("_x.inside"), heading(F.col("_x.line"))).alias("_h"))
    start = F.coalesce(F.sum(F.col("chars").cast("long") + 1).over(Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one document's lines
    return flat.select("doc", "line_no", start.alias("start"), "chars", "written", F.col("_h.level").alias("level"), F.col("_h.title").alias("title"))


def headings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no, start, level, title) of the headings alone."""
    return lines(docs, doc, text).where("level is not null").select("doc", "line_no", "start", "level", "title")


def sections(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, section, title, level, start, end): a document cut at its headings, in characters.

    Text before the first heading is a preface, text without any heading one section; blank sections
    and blank documents have no row, and sections are numbered from 0 without gaps.
    """
    each = lines(docs, doc, text)
    order = Window.partitionBy("doc").orderBy("line_no")
    part = F.count("level").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = each.withColumn("part", part)
    grouped = whole.groupBy("doc", "part").agg(
        F.max("level").alias("level"), F.max("title").alias("title"), F.min("start").alias("start"), F.max(F.col("start") + F.col("chars")).alias("stop"), F.max("line_no").alias("last"), F.max("written").alias("written")
    )
    by = Window.partitionBy("doc")
    ended = grouped.withColumn("end", F.coalesce(F.lead("start").over(by.orderBy("part")), "stop")).withColumn("parts", F.max("part").over(by))
    title = F.coalesce("title", F.when(F.col("parts") == 0, BODY).otherwise(PREFACE))
    kept = ended.where("written")
    number = F.row_number().over(by.orderBy("part")) - 1
    return kept.select("doc", number.alias("section"), title.alias("title"), F.coalesce("level", F.lit(0)).alias("level"), "start", "end")


def by_chapter(policy: str, text: Column | str, threshold: int = THRESHOLD) -> Column:
    """Whether a document is cut into chapters: always, never, or above a number of characters."""
    if policy not in ("AUTO", "WHOLE", "CHAPTER"):
        raise ValueError(policy)
    long = F.coalesce(F.length(col(text)) > max(threshold, LEAST_THRESHOLD), F.lit(False))
    return {"CHAPTER": F.lit(True), "WHOLE": F.lit(False), "AUTO": long}[policy]


def section_limit(prompt_chars: int = PROMPT_CHARS, threshold: int = THRESHOLD) -> int:
    return max(LEAST_SECTION, min(prompt_chars, threshold))


# Cuts whose place depends on the cut before are folds over one text, in plain Python, run by Arrow batches.


class Part(NamedTuple):
    title: str
    level: int
    start: int  # characters
    end: int
    byte_offset: int
    byte_length: int


def _heading_of(line: str) -> tuple[int, str] | None:
    x = line.removeprefix("﻿")
    strip = lambda s: s.strip("".join(map(chr, range(33))))
    m = re.fullmatch(_ATX, x)
    if m and strip(m.group(2)):
        return len(m.group(1)), strip(m.group(2))
    bare = strip(x)
    return (1, bare) if re.fullmatch(_CHAPTER, bare) else (2, bare) if re.fullmatch(_ITEM, bare) else None


def _units(text: str, limit: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, complete): lines with their ends; of a line of limit characters or more, pieces of the limit and what is left."""
    start = 0
    while start < len(text):
        end = text.find("\n", start)
        body = len(text) if end < 0 else end
        stop = body if end < 0 else end + 1
        if body - start < limit:
            yield start, stop, True
        else:
            while body - start >= limit:
                yield start, start + limit, False
                start += limit
            if start < stop:
                yield start, stop, False
        start = stop


def line_sections(text: str, limit: int, charset: str = "utf-8") -> list[Part]:
    """Sections by headings and, inside them, by length: a line that would exceed the limit opens the next part.

    Parts after a section's first are named "title (2)" and on.  Offsets in bytes are those of the
    charset.  A heading itself never opens a part by its length; parts without a letter go.
    """
    limit = max(limit, LEAST_SECTION)
    cuts: list[tuple[int, str, int]] = [(0, BODY, 0)]  # start, title, level
    base, number, fence, seen = BODY, 1, "", False
    for start, end, complete in _units(text, limit):
        line = text[start:end].rstrip("\n").removesuffix("\r")
        found = None
        if complete:
            bare = line.lstrip()
            mark = bare[: len(bare) - len(bare.lstrip(bare[:1]))] if bare[:3] in ("```", "~~~") else ""
            if not mark:
                found = _heading_of(line) if not fence else None
            elif not fence:
                fence = mark
            elif mark[0] == fence[0] and len(mark) >= len(fence):
                fence = ""
        if found:
            if not seen:
                seen = True
                cuts[-1] = (cuts[-1][0], PREFACE, 0)
            base, number = found[1], 1
            cuts.append((start, base, found[0]))
        elif start > cuts[-1][0] and end - cuts[-1][0] > limit:
            number += 1
            cuts.append((start, f"{base} ({number})", cuts[-1][2]))
    out, offset = [], 0
    for (start, title, level), stop in zip(cuts, [*(c[0] for c in cuts[1:]), len(text)]):
        part = text[start:stop]
        size = len(part.encode(charset, "replace"))
        if part and not part.isspace():
            out.append(Part(title, level, start, stop, offset, size))
        offset += size
    return out


def window_sections(text: str, limit: int, at_spaces: bool = True) -> list[tuple[int, int]]:
    """(start, end) of windows of at most limit characters, ending after a line or, if allowed, a space in their second half."""
    out, start = [], 0
    while start < len(text):
        end = min(start + limit, len(text))
        if end < len(text):
            for mark in ("\n", " ") if at_spaces else ("\n",):
                at = text.rfind(mark, start + limit // 2 + 1, end)
                if at >= 0:
                    end = at + 1
                    break
        if not text[start:end].isspace():
            out.append((start, end))
        start = end
    return out


_PARTS = pa.list_(pa.struct([("title", pa.string()), ("level", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("byte_offset", pa.int64()), ("byte_length", pa.int64())]))
PARTS = "array<struct<title: string, level: int, start: long, end: long, byte_offset: long, byte_length: long>>"


def _cutter(limit: int, style: str):
    def cut(batches):
        for batch in batches:
            found = []
            for text in batch.column("_text").to_pylist():
                if style == "lines":
                    parts = line_sections(text or "", limit)
                else:
                    spans = window_sections(text or "", limit, style == "windows")
                    parts, offset, last = [], 0, 0
                    for i, (a, b) in enumerate(spans):
                        offset += len(text[last:a].encode("utf-8", "replace"))
                        size = len(text[a:b].encode("utf-8", "replace"))
                        parts.append(Part(BODY if len(spans) == 1 else f"{BODY} ({i + 1}/{len(spans)})", 0, a, b, offset, size))
                        offset, last = offset + size, b
                found.append([p._asdict() for p in parts])
            keep = [n for n in batch.schema.names if n != "_text"]
            yield pa.record_batch([*(batch.column(n) for n in keep), pa.array(found, _PARTS)], [*keep, "parts"])

    return cut


def cut_texts(docs: DataFrame, doc: str, text: str, limit: int, style: str = "lines") -> DataFrame:
    """(doc, part_no, title, level, start, end, byte_offset, byte_length) of every part of every document.

    style: 'lines' as line_sections; 'windows' and 'prompts' as window_sections with and without
    spaces.  Null and blank texts have no parts.
    """
    kind = docs.schema[doc].dataType.simpleString()
    parts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("_text")).mapInArrow(_cutter(limit, style), f"doc {kind}, parts {PARTS}")
    return parts.select("doc", F.posexplode("parts").alias("part_no", "_p")).select("doc", "part_no", "_p.*")


def chunks(docs: DataFrame, doc: str = "id", title: str = "title", text: str = "content", policy: str = "AUTO", threshold: int = THRESHOLD, prompt_chars: int = PROMPT_CHARS) -> DataFrame:
    """Chunk rows (chunk_id, document_id, document_title, section_index, section_title, heading_level, source_offset, source_length).

    A document is one chunk of level 0, or its sections if the policy says so; chunk ids are the
    document's id, '#' and the number.  Blank documents have no chunks.
    """
    chapter = by_chapter(policy, text, threshold)
    given = docs.where(~is_blank(text))
    name = F.when(is_blank(title), WHOLE).otherwise(F.col(title))
    whole = given.where(~chapter).select(F.col(doc).alias("document_id"), F.lit(0).alias("section_index"), name.alias("section_title"), F.lit(0).alias("heading_level"), F.lit(0).cast("long").alias("source_offset"), F.octet_length(text).cast("long").alias("source_length"))
    cut = cut_texts(given.where(chapter), doc, text, section_limit(prompt_chars, threshold)).select(F.col("doc").alias("document_id"), F.col("part_no").alias("section_index"), F.col("title").alias("section_title"), F.col("level").alias("heading_level"), F.col("byte_offset").alias("source_offset"), F.col("byte_length").alias("source_length"))
    both = whole.unionByName(cut).join(docs.select(F.col(doc).alias("document_id"), F.col(title).alias("document_title")), "document_id")
    return both.withColumn("chunk_id", F.concat_ws("#", "document_id", F.col("section_index").cast("string")))


def byte_range(text: Column | str, offset: Column | str, length: Column | str) -> Column:
    """The text's bytes from an offset, decoded; '' for a length of 0 or less, an error (STORAGE_003) outside the text, null for a null."""
    raw = F.encode(col(text), "utf-8")
    a, n = col(offset), col(length)
    outside = (a < 0) | (a + n > F.octet_length(raw))
    part = F.decode(F.substring(raw, a.cast("int") + 1, n.cast("int")), "utf-8")
    return F.when(n <= 0, "").when(outside, F.raise_error(F.lit("STORAGE_003: range outside the source")).cast("string")).otherwise(part)
