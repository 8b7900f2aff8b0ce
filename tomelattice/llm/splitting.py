"""Oversized texts cut into pieces at natural boundaries.

Cuts are chosen by dynamic programming over the boundaries of a text: headings, paragraphs, lines,
sentences, words and, where these are too far apart, characters.  The cost of a division is the sum
of its cuts' penalties and of the squared deviations of its pieces from an even size; every piece
after the first begins with the end of the one before and none is longer than the limit.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tomelattice.llm.arrow import text_batches
from tomelattice.session import stage

#: Bytes of a piece at most, and of the overlap of two pieces at least and at most.
LIMIT, LEAST, MOST = 2000, 100, 200
#: What a cut costs, by kind of boundary; an even size missed by all of itself costs EVEN.
HEADING, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = 0.0, 0.5, 1.0, 1.5, 4.0, 8.0
EVEN = 2.0

_FENCE = re.compile(rb"^[ \t]*(`{3,}|~{3,})", re.M)
_NUMERAL = "(?:[0-9]|" + "|".join("一二三四五六七八九十百千零〇两") + ")+"
_HEADING = re.compile(f"^(?:#{{1,6}}[ \t]|第{_NUMERAL}(?:章|节|篇|部)|{_NUMERAL}、)".encode(), re.M)
_PARAGRAPH = re.compile(rb"\n[ \t\r]*\n+")
_SENTENCE = re.compile("(?:(?:。|！|？|；|…)+(?:”|’|」|』|）)*|[.!?;]+[\"')]*(?=[ \n]))[ ]*".encode())
_WORD = re.compile("[ \t]+|，|、|,".encode())


def boundaries(text: bytes, limit: int = LIMIT, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Places where UTF-8 text may be cut, ascending, and what a cut there costs.

    No two neighbours are farther apart than limit - 2 * most bytes, so that a division exists.
    """
    cost = np.full(len(text) + 1, np.inf)

    def offer(places: list[int], penalty: float) -> None:
        if places:
            cost[places] = np.minimum(cost[places], penalty)

    offer([m.end() for m in re.finditer(rb"\n", text)], LINE)
    offer([m.end() for m in _PARAGRAPH.finditer(text)], PARAGRAPH)
    offer([m.end() for m in _SENTENCE.finditer(text)], SENTENCE)
    headings = [m.start() for m in _HEADING.finditer(text)]
    fences = [(m.start(), m.group(1)) for m in _FENCE.finditer(text)]
    if fences and headings:  # within a fence a line that looks like a heading is none
        inside, opened = [], None
        for at, mark in fences:
            if opened is None:
                opened = (at, mark)
            elif mark[:1] == opened[1][:1] and len(mark) >= len(opened[1]):
                inside.append((opened[0], at))
                opened = None
        if opened:
            inside.append((opened[0], len(text)))
        headings = [h for h in headings if not any(a < h < b for a, b in inside)]
    offer(headings, HEADING)
    gap = limit - 2 * most
    for finer, penalty in ((_WORD, WORD), (None, CHARACTER)):
        places = np.concatenate([[0], np.flatnonzero(np.isfinite(cost[1:-1])) + 1, [len(text)]])
        for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
            if b - a <= gap:
                continue
            if finer:
                offer([m.end() for m in finer.finditer(text, a, b) if a < m.end() < b], penalty)
            else:  # characters, not every one of them
                step = max(1, min(gap // 8, 64))
                near = []
                for p in range(a + step, b, step):
                    while p > a and text[p] & 0xC0 == 0x80:
                        p -= 1
                    near.append(p)
                offer([p for p in near if a < p < b], penalty)
    places = np.flatnonzero(np.isfinite(cost[1:-1])) + 1
    return places, cost[places]


def overlap_start(text: bytes, cut: int, cost: dict[int, float], least: int = LEAST, most: int = MOST) -> int:
    """Where the piece after a cut begins: from least to most bytes before it, at the best boundary there."""
    best, at = np.inf, -1
    for p in range(max(0, cut - most), cut - least + 1):
        if text[p] & 0xC0 != 0x80:
            c = cost.get(p, CHARACTER)
            if c < best:
                best, at = c, p
    return at


def split(text: bytes, limit: int = LIMIT, least: int = LEAST, most: int = MOST) -> list[tuple[int, int, int]]:
    """(begin, cut, end) of each piece of UTF-8 text: text[begin:cut] is the overlap, nothing in the first piece.

    A text within the limit is one piece, an empty one none.  limit has to be 4 * most at least and
    most - least 3 at least, so that a character begins in between.
    """
    n = len(text)
    if n <= limit:
        return [(0, 0, n)] if n else []
    places, costs = boundaries(text, limit, most)
    good = places >= most
    places, costs = places[good], costs[good]
    cost = dict(zip(places.tolist(), costs.tolist()))
    starts = np.array([overlap_start(text, c, cost, least, most) for c in places.tolist()], np.int64)
    pieces = -(-(n - most) // (limit - most))
    even = (n + (pieces - 1) * most) / pieces
    # Node 0 is the beginning, then the cuts, then the end; a piece leads from one to a later one.
    at = np.concatenate([[0], places, [n]])
    begin = np.concatenate([[0], starts, [n]])
    penalty = np.concatenate([[0], costs, [0]])
    total = np.full(len(at), np.inf)
    total[0] = 0
    back = np.zeros(len(at), np.int64)
    low = 0
    for i in range(1, len(at)):
        while begin[low] + limit < at[i]:
            low += 1
        high = int(np.searchsorted(at, at[i] - most, "right")) if i < len(at) - 1 else i
        if high > low:
            size = at[i] - begin[low:high]
            price = total[low:high] + EVEN * ((size - even) / even) ** 2
            k = int(price.argmin())
            total[i], back[i] = price[k] + penalty[i], low + k
    path, i = [], len(at) - 1
    while i:
        path.append((int(begin[back[i]]), int(at[back[i]]), int(at[i])))
        i = int(back[i])
    return path[::-1]


def _splitter(limit: int, least: int, most: int, section_type: pa.DataType):
    def work(batches):
        for batch, texts in text_batches(batches, "text"):
            rows = {k: [] for k in ("row", "section", "piece", "byte_begin", "byte_cut", "byte_end", "text")}
            for r, (text, sections) in enumerate(zip(texts, batch.column("sections").to_pylist())):
                data = text.encode("utf-8", "replace")
                for s in sections:
                    base, part = s["begin"], data[s["begin"] : s["end"]]
                    for k, (a, c, b) in enumerate(split(part, limit, least, most)):
                        for name, v in zip(rows, (r, s["section"], k, base + a, base + c, base + b, part[a:b].decode("utf-8", "replace"))):
                            rows[name].append(v)
            if rows["row"]:
                of = batch.column("doc").take(pa.array(rows.pop("row")))
                kinds = (section_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([of, *(pa.array(v, k) for v, k in zip(rows.values(), kinds))], ["doc", *rows])

    return work


#: Sections of a document that one window sorts at most, when their numbers are consecutive.
_RUN = 1024


def section_ends(sections: DataFrame) -> DataFrame:
    """(doc, section, begin, end): end is where the document's next section begins, null for the last.

    sections has doc, section and begin; of repeated sections the smallest begin holds, rows with a
    null are left out.
    """
    rows = sections.where("doc is not null and section is not null and begin is not null").groupBy("doc", "section").agg(F.min("begin").alias("begin")).withColumn("run", F.floor(F.col("section") / _RUN))
    inside = rows.withColumn("end", F.lead("begin").over(Window.partitionBy("doc", "run").orderBy("section")))
    firsts = rows.groupBy("doc", "run").agg(F.min_by("begin", "section").alias("first"))
    following = firsts.select("doc", "run", F.lead("first").over(Window.partitionBy("doc").orderBy("run")).alias("after"))
    return inside.join(following, ["doc", "run"]).select("doc", "section", "begin", F.coalesce("end", "after").alias("end"))


def oversized(docs: DataFrame, sections: DataFrame, limit: int = LIMIT, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Pieces (doc, section, piece, byte_begin, byte_cut, byte_end, text) of the sections longer than limit bytes.

    docs has doc, unique, and text; sections has doc, section and begin, a byte offset in the text.
    A section runs to the next section's begin or the end of the text; parts outside the text don't
    count, neither do sections that end where they begin or before, nor documents without a text.
    A piece is the text's bytes from byte_begin to byte_end; up to byte_cut they repeat the end of
    the piece before.
    """
    texts = docs.where("doc is not null and text is not null").select("doc", "text")
    sizes = texts.select("doc", F.octet_length("text").alias("size"))
    placed = section_ends(sections).join(sizes, "doc").select("doc", "section", F.greatest("begin", F.lit(0)).alias("begin"), F.least(F.coalesce("end", "size"), "size").alias("end"))
    long = stage(placed.where(F.col("end") - F.col("begin") > limit).groupBy("doc").agg(F.collect_list(F.struct("section", "begin", "end")).alias("sections")))  # of one text, so no more than it has bytes
    kind = {c: sections.schema[c].dataType for c in ("doc", "section")}
    schema = f"doc {kind['doc'].simpleString()}, section {kind['section'].simpleString()}, piece int, byte_begin long, byte_cut long, byte_end long, text string"
    return texts.join(long, "doc").select("doc", "text", "sections").mapInArrow(_splitter(limit, least, most, to_arrow_type(kind["section"])), schema)
