"""Near-duplicate texts by an exact set-similarity join over inverted lists.

Texts are sets of five-token shingles.  All sets are ordered by one global order, rare shingles
first, and only the prefix of a set that must hold a common element with any partner is indexed.
Index lists are joined with two kinds of skipping:

* index level: a list is sorted by set size, so that partners of a set are one run of the list; the
  run ends where the set's size, or its position in its set, allows no larger partner, and what lies
  beyond is skipped without being looked at;
* answer level: overlaps are counted per block of sets, and a set's counts are derived from those of
  a highly similar set by looking up only the elements in which they differ (setsim.BlockIndex).

Copies with equal sets are one class, so their number does not multiply any work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomelattice.llm.arrow import text_batches
from tomelattice.llm.setsim import BITS, BLANK, levels_of, overlaps, pack, set_hash, sets_of, survey, text_sets, unpack
from tomelattice.llm.tokens import mix64
from tomelattice.session import Stage, stage

#: Index entries to a task, pairs expanded at once, and pairs a task holds, about; rows of a class to a run.
ENTRIES, PAIRS, HELD, RUN = 1_000_000, 2_000_000, 4_000_000, 1000
#: Of the elements that two similar sets have in common the share whose entries are counted.
EXTRA = 0.08


def _rows(part: np.ndarray, element: np.ndarray, rest: np.ndarray, doc: np.ndarray, cls: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """A row for every part that occurs: its entries, grouped by document."""
    order = np.lexsort((doc, part))
    begins = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
    rows: dict[str, list] = {k: [] for k in ("part", "elements", "rests", "counts", "classes", "sizes")}
    for at in np.split(order, begins[1:]):
        docs, counts = np.unique(doc[at], return_counts=True)
        values = (part[at[0]], pack(element[at]), rest[at].astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes(), cls[docs].tobytes(), size[docs].astype(np.uint32).tobytes())
        for k, v in zip(rows, values):
            rows[k].append(v)
    return pa.record_batch([pa.array(rows["part"], pa.int64()), *(pa.array(rows[k], pa.binary()) for k in list(rows)[1:])], list(rows))


def prefixes(n: np.ndarray, values: np.ndarray, at: np.ndarray, level: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (element, rest, set) of the prefixes, in the global order of frequency and hash, of the sets with BLANK tokens or more.

    rest is the number of elements from the entry's on, by that order; prefixes reach as far as a
    common element can be the first with any set of the threshold.
    """
    owner = np.repeat(np.arange(len(n)), np.diff(at))
    good = (n >= BLANK)[owner]
    owner, values = owner[good], values[good]
    order = np.lexsort((levels_of(values, level).astype(np.uint64) << np.uint64(BITS) | values, owner))
    size = np.diff(at) * (n >= BLANK)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    rest = size[owner] - (np.arange(len(owner)) - begin[owner])
    keep = rest >= np.ceil(threshold * size - 1e-9)[owner]
    return values[order][keep], rest[keep], owner[keep]


def _indexer(level, threshold: float, parts: int):
    """Entries of the prefixes by part.

    The list of an element of more than ENTRIES / 2 sets is cut into k runs of sets by hash, and an
    entry goes to each of the k parts for its run and another, so that every two meet somewhere.
    """

    def index(batches):
        held: list[tuple] = []
        entries = docs = 0
        for _, texts in text_batches(batches, "text"):
            n, values, at = text_sets(texts)
            cls, size = set_hash(values, at), np.diff(at)
            element, rest, doc = prefixes(n, values, at, level.value, threshold)
            runs = np.ceil(np.exp2(levels_of(element, level.value) / 8) / (ENTRIES / 2)).astype(np.int64)
            each = np.repeat(np.arange(len(element)), runs)
            other = np.arange(len(each)) - np.repeat(np.cumsum(runs) - runs, runs)
            element, rest, doc, runs = element[each], rest[each], doc[each], runs[each]
            own = (mix64(cls.view(np.uint64) + np.uint64(0x1F83D9AB)) >> np.uint64(8)).astype(np.int64)[doc] % runs
            cell = np.minimum(own, other) * runs + np.maximum(own, other)
            part = (mix64(element ^ mix64(cell.astype(np.uint64) + np.uint64(0x5BE0CD19))) % np.uint64(parts)).astype(np.int64)
            held.append((part, element, rest, doc + docs, cls, size))
            entries, docs = entries + len(element), docs + len(texts)
            if entries > ENTRIES:
                yield _rows(*map(np.concatenate, zip(*held)))
                held, entries, docs = [], 0, 0
        if entries:
            yield _rows(*map(np.concatenate, zip(*held)))

    return index


def needed(a: np.ndarray, b: np.ndarray, t: np.ndarray | float, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rest, hits) for sets of sizes a and b: how much of both sets has to be left at an entry that counts, and how many such entries are common.

    Sets of the threshold have alpha = t / (1 + t) * (a + b) elements in common, in one global order.
    The first EXTRA of those lie where both have at least alpha - EXTRA + 1 elements left; where
    that is beyond what is indexed (own and other), accordingly fewer.
    """
    alpha = np.ceil(t / (1 + t) * (a + b) - 1e-9).astype(np.int64)
    rest = np.maximum(np.maximum(alpha - np.maximum((EXTRA * alpha).astype(np.int64), 1) + 1, own), other)
    return rest, alpha - rest + 1


def indexed(size: np.ndarray, t: np.ndarray | float) -> np.ndarray:
    """Elements left at the last entry of a prefix."""
    return np.ceil(t * size - 1e-9).astype(np.int64)


def join_lists(element: np.ndarray, owner: np.ndarray, rest: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of owners, as low * len(sizes) + high, and how many elements they have in common where both have enough left.

    Entries are parallel arrays; owners number the sets, whose sizes are given.  Lists are in the
    order of size: an entry's partners that are no smaller end where its size, or its place in its
    set, forbids more, and only those are visited.  A pair may come several times, its numbers to be
    added; no more than about HELD are held at once.
    """
    n, size = len(sizes), sizes[owner]
    order = np.lexsort((owner, size, element))
    element, owner, rest, size = element[order], owner[order], rest[order], size[order]
    keep = np.ones(len(element), bool)  # equal sets count once in a list
    keep[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
    element, owner, rest, size = element[keep], owner[keep], rest[keep], size[keep]
    fresh = np.ones(len(element), bool)
    fresh[1:] = element[1:] != element[:-1]
    lists = np.cumsum(fresh).astype(np.int64) - 1
    key = lists << 32 | size
    largest = np.floor(np.minimum(size / threshold, rest * (1 + threshold) / threshold / (1 - EXTRA) - size) + 1e-9).astype(np.int64)
    end = np.searchsorted(key, lists << 32 | np.maximum(largest, 0), "right")
    count = np.maximum(end - np.arange(len(key)) - 1, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    edge = indexed(size, threshold)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    begin = held = 0
    while begin < len(key):
        stop = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, "right")) - 1)
        c = count[begin:stop]
        left = np.repeat(np.arange(begin, stop), c)
        right = left + 1 + np.arange(c.sum()) - np.repeat(total[begin:stop] - total[begin], c)
        ok = np.minimum(rest[left], rest[right]) >= needed(size[left], size[right], threshold, edge[left], edge[right])[0]
        a, b = owner[left[ok]], owner[right[ok]]
        found.append(np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_counts=True))
        held += len(found[-1][0])
        if held > HELD:
            found = [_add(found)]
            held = len(found[0][0])
            if held > HELD / 2:
                yield found.pop()
                held = 0
        begin = stop
    if found:
        yield _add(found)


def _add(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)


def _joiner(threshold: float):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = {k: [] for k in ("elements", "rests", "counts", "classes", "sizes")}
        for batch in batches:
            for k, c in cols.items():
                c += batch.column(k).to_pylist()
        rest, counts = (np.concatenate([np.frombuffer(x, np.uint32) for x in cols[k]]).astype(np.int64) for k in ("rests", "counts"))
        classes, back = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in cols["classes"]]), return_inverse=True)
        sizes = np.zeros(len(classes), np.int64)
        sizes[back] = np.concatenate([np.frombuffer(x, np.uint32) for x in cols["sizes"]])
        edge = indexed(sizes, threshold)
        for keys, hits in join_lists(unpack(b"".join(cols["elements"])), np.repeat(back, counts), rest, sizes, threshold):
            a, b = keys // len(classes), keys % len(classes)
            need = needed(sizes[a], sizes[b], threshold, edge[a], edge[b])[1]
            yield pa.record_batch([pa.array(x) for x in (classes[a], classes[b], need, hits)], ["a", "b", "need", "hits"])

    return join


def near_duplicates(docs: DataFrame, ref: str, text: str, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Classes of texts with equal shingle sets, and all pairs of classes whose similarity is at least threshold.

    docs has a unique ref and a text.  The first result has a row (ref, cls, size) for every text
    that is neither null nor blank; the second has (cls_a, cls_b, common, size_a, size_b,
    similarity), cls_a < cls_b.  Null and blank texts have no row; rows whose ref is null are left
    out; other columns of docs are not looked at; an empty table gives empty results.
    """
    spark = docs.sparkSession
    kind = docs.schema[ref].dataType.simpleString()
    texts = docs.select(F.col(ref).alias("ref"), F.col(text).alias("text")).where("ref is not null and text is not null")
    classes, level = survey(texts, kind)
    entries = classes.agg(F.sum("size")).first()[0] or 0
    parts = int(entries * (1 - threshold) / ENTRIES) + 1
    index = texts.mapInArrow(_indexer(spark.sparkContext.broadcast(level), threshold, parts), "part long, elements binary, rests binary, counts binary, classes binary, sizes binary")
    hits = index.groupBy("part").applyInArrow(_joiner(threshold), "a long, b long, need long, hits long")
    candidates = stage(hits.groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("hits").alias("hits")).where("hits >= need").select("a", "b"))
    shown = classes.groupBy("cls").agg(F.min("ref").alias("shown"))
    used = candidates.select(F.col("a").alias("cls")).union(candidates.select("b")).distinct()
    shown = stage(shown.join(used, "cls", "left_semi"))
    written = Stage(candidates.join(shown.select(F.col("cls").alias("a"), F.col("shown").alias("ra")), "a").join(shown.select(F.col("cls").alias("b"), F.col("shown").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")), n=F.count(F.lit(1)))
    sets = stage(sets_of(texts.join(shown.select(F.col("shown").alias("ref")), "ref", "left_semi"), kind))
    exact = overlaps(written.df, sets, kind, written.seen["n"]).withColumn("similarity", F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))).where(F.col("similarity") >= threshold - 1e-12)
    found = (
        exact.join(shown.select(F.col("shown").alias("a"), F.col("cls").alias("x")), "a")
        .join(shown.select(F.col("shown").alias("b"), F.col("cls").alias("y")), "b")
        .select(F.least("x", "y").alias("cls_a"), F.greatest("x", "y").alias("cls_b"), "common", F.when(F.col("x") < F.col("y"), F.col("size_a")).otherwise(F.col("size_b")).alias("size_a"), F.when(F.col("x") < F.col("y"), F.col("size_b")).otherwise(F.col("size_a")).alias("size_b"), "similarity")
    )
    return classes, stage(found)


def expand(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b) of different refs, id_a < id_b, from classes and pairs of classes."""
    a = classes.select(F.col("ref").alias("u"), F.col("cls").alias("cls_a"))
    b = classes.select(F.col("ref").alias("v"), F.col("cls").alias("cls_b"))
    across = pairs.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b").select("u", "v")
    # Pairs inside a class: the class's rows are cut into runs by hash, each of which meets all rows.
    runs = classes.groupBy("cls").agg(F.ceil(F.count("*") / RUN).alias("runs")).withColumnRenamed("cls", "cls_a")
    one = a.join(runs, "cls_a").withColumn("run", F.pmod(F.xxhash64("u"), "runs"))
    each = b.join(runs.withColumnRenamed("cls_a", "cls_b"), "cls_b").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)))
    within = one.join(each.select("cls_b", "v", F.col("run").alias("run_b")), (F.col("cls_a") == F.col("cls_b")) & (F.col("run") == F.col("run_b"))).where("u < v").select("u", "v")
    return across.union(within).select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b"))
