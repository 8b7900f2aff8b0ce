"""Exact similarity of texts as sets of word shingles.

A shingle is a 48-bit hash of five tokens, a set the sorted hashes of a text.  Candidate pairs are
grouped by pairs of blocks; a task loads each set of its two blocks once and counts overlaps through
an inverted index of the block.  Sets are visited so that similar ones follow each other, and the
counts of a set are derived from those of its predecessor by looking up only the elements in which
the two differ.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomelattice.llm.arrow import text_batches
from tomelattice.llm.tokens import distinct_sorted, mix64, shingles, tokenize
from tomelattice.session import stage

#: Tokens in a shingle, and the fewest tokens of a text that isn't blank.
SHINGLE, BLANK = 5, 20
#: Sets to a block of the verification, and pairs to a task's group, about.
BLOCK, GROUP = 256, 2000
#: Cells of the sketch of shingle frequencies, and the slices it is merged in.
CELLS, SLICES = 1 << 22, 16
#: Bits and bytes of a shingle's hash; rows of keys that may be broadcast.
BITS, WORD, FEW = 48, 6, 500_000


def few(keys: DataFrame, rows: int) -> DataFrame:
    """Keys (two or three numbers or names a row) to be joined with a large table: broadcast if there are at most FEW, else shuffled."""
    return F.broadcast(keys) if rows <= FEW else keys


def pack(values: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WORD, 8), np.uint8)
    out[:, :WORD] = np.frombuffer(data, np.uint8).reshape(-1, WORD)
    return out.view("<u8").ravel()


def set_hash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each set of distinct values; independent of their order."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(values + np.uint64(0x51ED270B)))])
    with np.errstate(over="ignore"):
        total = sums[offsets[1:]] - sums[offsets[:-1]]
    return mix64(total ^ np.diff(offsets).astype(np.uint64)).view(np.int64)


def text_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token counts, and each text's distinct shingles with offsets."""
    tokens, offsets = tokenize(texts)
    values, at = shingles(tokens, offsets, SHINGLE)
    values, at = distinct_sorted(values >> np.uint64(64 - BITS), at)
    return np.diff(offsets), values, at


def leasts(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of every set the least of its elements' second hashes; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = (np.minimum.reduceat(mix64(values + np.uint64(0x632BE5AB)), offsets[:-1][full]) >> np.uint64(1)).astype(np.int64)
    return out


class Sketch:
    """Counts of shingles by cell, made in tasks and merged by slices; a fixed number of cells, whatever the data."""

    def __init__(self) -> None:
        self.counts = np.zeros(CELLS, np.uint32)

    def add(self, values: np.ndarray) -> None:
        self.counts += np.bincount((values & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)

    def slices(self) -> list[bytes]:
        return [zlib.compress(x.tobytes(), 1) for x in np.split(self.counts, SLICES)] if self.counts.any() else []


def _merge_slices(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            x = np.frombuffer(zlib.decompress(c), np.uint32)
            total[k] = total[k] + x if k in total else x.copy()
    for k, x in total.items():
        level = np.floor(8 * np.log2(x + 1.0)).clip(0, 255).astype(np.uint8)  # a cell's count in eighths of octaves
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())], ["slice", "levels"])


def levels(slices: DataFrame) -> np.ndarray:
    """Of each cell the number of its shingles in eighths of octaves, from tasks' slices (slice, counts)."""
    merged = slices.repartition(SLICES, "slice").mapInArrow(_merge_slices, "slice int, levels binary").collect()  # CELLS bytes at most
    level = np.zeros(CELLS, np.uint8)
    for k, x in merged:
        level[k * (CELLS // SLICES) : (k + 1) * (CELLS // SLICES)] = np.frombuffer(zlib.decompress(x), np.uint8)
    return level


def levels_of(values: np.ndarray, level: np.ndarray) -> np.ndarray:
    return level[(values & np.uint64(CELLS - 1)).astype(np.int64)]


def _survey(batches):
    """Rows of the texts' classes, then this task's sketch of shingle counts."""
    sketch, kind = Sketch(), None
    for batch, texts in text_batches(batches, "text"):
        kind = batch.column("ref").type
        n, values, at = text_sets(texts)
        sketch.add(values[np.repeat(n >= BLANK, np.diff(at))])
        rows = np.flatnonzero(n >= BLANK)
        yield pa.record_batch([batch.column("ref").take(pa.array(rows)), pa.array(set_hash(values, at)[rows]), pa.array(np.diff(at)[rows]), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], ["ref", "cls", "size", "slice", "counts"])
    if parts := sketch.slices():
        yield pa.record_batch([pa.nulls(SLICES, kind), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["ref", "cls", "size", "slice", "counts"])


def survey(texts: DataFrame, ref_type: str) -> tuple[DataFrame, np.ndarray]:
    """Of all texts (ref, text): a written table (ref, cls, size) of those not blank, and the levels of shingle frequencies.

    cls is a hash of the set of shingles.
    """
    rows = stage(texts.mapInArrow(_survey, f"ref {ref_type}, cls long, size long, slice int, counts binary"))
    return rows.where("ref is not null").select("ref", "cls", "size"), levels(rows.where("slice is not null").select("slice", "counts"))


def _sets(batches):
    for batch, texts in text_batches(batches, "text"):
        _, values, at = text_sets(texts)
        yield pa.record_batch([batch.column("ref"), pa.array(leasts(values, at)), pa.array([pack(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], ["ref", "least", "elements"])


def sets_of(texts: DataFrame, ref_type: str) -> DataFrame:
    """(ref, least, elements) of texts (ref, text): the set, and the least of its elements' second hashes."""
    return texts.select("ref", "text").mapInArrow(_sets, f"ref {ref_type}, least long, elements binary")


class BlockIndex:
    """Inverted index of some sets, with overlap counts of one query set kept for the next, similar one."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = len(sets)
        owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.query: np.ndarray | None = None
        self.counts = np.zeros(self.n, np.int64)

    def _count(self, elements: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.values, elements), np.searchsorted(self.values, elements, "right")
        n = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.bincount(self.owner[at], minlength=self.n)

    def overlaps(self, query: np.ndarray) -> np.ndarray:
        """Common elements of query, sorted and distinct, with every set of the index."""
        if self.query is not None:
            gone = np.setdiff1d(self.query, query, assume_unique=True)
            come = np.setdiff1d(query, self.query, assume_unique=True)
            if len(gone) + len(come) < len(query):
                self.counts = self.counts - self._count(gone) + self._count(come)
                self.query = query
                return self.counts
        self.query, self.counts = query, self._count(query)
        return self.counts


def _verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    ref = sets["ref"].combine_chunks()
    a, b = pc.index_in(pairs["a"], value_set=ref), pc.index_in(pairs["b"], value_set=ref)
    known = pc.and_(a.is_valid(), b.is_valid())
    pairs, a, b = pairs.filter(known), a.filter(known).to_numpy(), b.filter(known).to_numpy()
    of = [unpack(x) for x in sets["elements"].to_pylist()]
    size = np.array([len(s) for s in of], np.int64)
    common = np.zeros(len(a), np.int64)
    if len(a):
        right, place = np.unique(b, return_inverse=True)
        index = BlockIndex([of[i] for i in right.tolist()])
        # Near-equal sets mostly share their least hash, so that they follow each other.
        order = np.lexsort((a, size[a], sets["least"].to_numpy()[a]))
        begins = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]]))
        for rows in np.split(order, begins[1:]):
            common[rows] = index.overlaps(of[a[rows[0]]])[place[rows]]
    return pa.table({"a": pairs["a"], "b": pairs["b"], "common": common, "size_a": size[a], "size_b": size[b]})


def overlaps(pairs: DataFrame, sets: DataFrame, ref_type: str, count: int) -> DataFrame:
    """Exact overlaps of candidate pairs.

    pairs (a, b), a written table of count rows, refer to sets (ref, least, elements) with unique
    ref, of no others than the pairs' refs, which are read twice; the result has a, b, common, size_a and size_b, in shingles.  Pairs whose
    ref has no set are left out.
    """
    cells = max(1, count // GROUP)
    if cells == 1:
        placed, shipped = pairs.select("a", "b", F.lit(0).cast("long").alias("cell")), sets.select(F.lit(0).cast("long").alias("at"), "ref", "least", "elements")
    else:
        # Similar sets mostly have the same least hash; a block is some of those, a large group is spread over several blocks.
        groups = sets.groupBy("least").agg(F.count("*").alias("n"))
        block = F.when(F.col("n") <= BLOCK, F.xxhash64("least")).otherwise(F.xxhash64("least", F.pmod(F.xxhash64("ref"), F.ceil(F.col("n") / BLOCK))))
        blocks = stage(sets.select("ref", "least").join(groups, "least").select("ref", block.alias("block")))
        placed = stage(
            pairs.select("a", "b")
            .join(few(blocks.select(F.col("ref").alias("a"), F.col("block").alias("x")), 2 * count), "a")
            .join(few(blocks.select(F.col("ref").alias("b"), F.col("block").alias("y")), 2 * count), "b")
            .select("a", "b", F.pmod(F.xxhash64("x", "y"), F.lit(cells)).alias("cell"))
        )
        needed = placed.select("cell", F.col("a").alias("ref")).union(placed.select("cell", "b")).distinct()
        shipped = sets.join(few(needed, 2 * count), "ref").select(F.col("cell").alias("at"), "ref", "least", "elements")
    return placed.groupBy("cell").cogroup(shipped.groupBy("at")).applyInArrow(_verify, f"a {ref_type}, b {ref_type}, common long, size_a long, size_b long")
