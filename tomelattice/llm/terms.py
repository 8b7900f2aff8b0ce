"""Frequency of every term, from a vertical layout of record bitmaps.

Records get dense numbers, in blocks of at most 65 536.  Every term has, in every block in which it
occurs, the compressed set of its records (a sorted array while that is smaller, else a bitmap) and,
in the same order, a counter of occurrences for each.  Tasks build such containers for their own
rows; containers of one term and block are merged by union, where the counters of a record found
twice keep the larger.  Record frequencies are cardinalities, totals are sums of counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomelattice.session import stage

#: Records numbered in a block, about, and the most that its 16-bit numbers allow; ids above which a bitmap is smaller.
BLOCK, DENSE = 1 << 15, 4096
#: Numbers of a block.
MOST = 1 << 16
#: Rows of which a task builds containers at once.
GATHERED = 1 << 18
#: Terms in more than this share of records are common; terms in at most so many with at most such a total are rare.
COMMON, RARE_RECORDS, RARE_TOTAL = 0.05, 2, 5


def normalized(term: Column) -> Column:
    """The term in lower case, without characters up to U+0020 at its ends."""
    return F.lower(F.regexp_replace(term, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))


def pack(ids: np.ndarray) -> bytes:
    """Sorted distinct 16-bit numbers as a container: an array of them, or a bitmap of 8192 bytes."""
    if len(ids) <= DENSE:
        return ids.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, np.uint8)
    bits[ids] = 1
    return np.packbits(bits, bitorder="little").tobytes() + b"\0"


def unpack(container: bytes) -> np.ndarray:
    if len(container) % 2:  # a bitmap has one byte more
        return np.flatnonzero(np.unpackbits(np.frombuffer(container[:-1], np.uint8), bitorder="little"))
    return np.frombuffer(container, "<u2").astype(np.int64)


def unite(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted ids and, of each, the largest counter."""
    order = np.lexsort((counts, ids))
    ids, counts = ids[order], counts[order]
    last = np.ones(len(ids), bool)
    last[:-1] = ids[1:] != ids[:-1]
    return ids[last], counts[last]


_KEYS = ["src", "term", "block"]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to GATHERED rows, so that a term's records of many batches share a container."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _gathered(batches):
        rows = batch.to_pandas()
        group = rows.groupby(_KEYS, sort=False).ngroup().to_numpy()
        key = group.astype(np.int64) << 16 | rows["local"].to_numpy()
        key, counts = unite(key, rows["n"].to_numpy())
        begins = np.flatnonzero(np.concatenate([[True], key[1:] >> 16 != key[:-1] >> 16]))
        ends = np.append(begins[1:], len(key))
        first = pd.Series(np.arange(len(rows))).groupby(group).first().to_numpy()
        of = batch.take(pa.array(first)).select(_KEYS)
        ids = key & 0xFFFF
        yield pa.record_batch([*of.columns, pa.array([pack(ids[a:b]) for a, b in zip(begins, ends)], pa.binary()), pa.array([counts[a:b].astype("<i4").tobytes() for a, b in zip(begins, ends)], pa.binary())], [*_KEYS, "records", "counters"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers arrive sorted by key; one key's are held at a time."""
    now, ids, counts = None, [], []
    rows: list[tuple] = []

    def close() -> None:
        i, c = unite(np.concatenate(ids), np.concatenate(counts))
        rows.append((*now, pack(i), c.astype("<i4").tobytes(), len(i), int(c.sum())))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [*_KEYS, "records", "counters", "cardinality", "total"])

    for batch in batches:
        for *key, records, counters in zip(*(batch.column(c).to_pylist() for c in (*_KEYS, "records", "counters"))):
            if key != now and now is not None:
                close()
                ids, counts = [], []
            now = key
            ids.append(unpack(records))
            counts.append(np.frombuffer(counters, "<i4").astype(np.int64))
        if len(rows) > 5000:
            yield flush()
            rows.clear()
    if now is not None:
        close()
    if rows:
        yield flush()


def vertical(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The containers (src, term, block, records, counters, cardinality, total), and record numbers (src, record, block, local).

    rows has src, term, record and n, none of them null.
    """
    rows = stage(rows)
    records = rows.select("src", "record").distinct()
    blocks = records.groupBy("src").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = records.join(blocks, "src").withColumn("block", F.pmod(F.xxhash64("record"), F.col("blocks")))
    at = placed.withColumn("at", (F.row_number().over(Window.partitionBy("src", "block").orderBy("record")) - 1).cast("long"))
    # Should hashing ever fill a block beyond its 16-bit numbers, the rest forms further blocks.
    numbers = stage(at.select("src", "record", (F.col("block") + F.col("blocks") * F.floor(F.col("at") / MOST)).alias("block"), (F.col("at") % MOST).alias("local")))
    numbered = rows.join(numbers, ["src", "record"]).select("src", "term", "block", "local", F.col("n").cast("long").alias("n"))
    kinds = "src string, term string, block long, records binary, counters binary"
    merged = numbered.mapInArrow(_build, kinds).repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_merge, f"{kinds}, cardinality long, total long")
    return merged, numbers


def frequencies(rows: DataFrame) -> DataFrame:
    """(src, term, records, total, share, mark) for every term of rows (src, term, record, n).

    Terms are trimmed and in lower case.  Records are the distinct ones of a src that are neither
    null nor empty; a term found in no such record has 0.  n counts the term in a row's record, null
    or less than 1 as 1, and the largest of a record holds; total is the sum over records.  share is
    the part of the src's records; mark is 'common', 'rare' or null.  Null terms are left out;
    repeated rows count once; an empty table gives an empty result.
    """
    clean = rows.where("src is not null and term is not null").select("src", normalized(F.col("term")).alias("term"), "record", F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)).alias("n"))
    containers, numbers = vertical(clean.where("record is not null and record <> ''"))
    counted = containers.groupBy("src", "term").agg(F.sum("cardinality").alias("records"), F.sum("total").alias("total"))
    sizes = numbers.groupBy("src").agg(F.count("*").alias("size"))
    every = clean.select("src", "term").distinct()
    out = every.join(counted, ["src", "term"], "left").join(sizes, "src", "left").fillna(0, ["records", "total"])
    rare = (F.col("records") > 0) & (F.col("records") <= RARE_RECORDS) & (F.col("total") <= RARE_TOTAL)
    mark = F.when(F.col("records") > COMMON * F.col("size"), "common").when(rare, "rare")
    return out.select("src", "term", "records", "total", F.coalesce(F.col("records") / F.col("size"), F.lit(0.0)).alias("share"), mark.alias("mark"))
