"""Passages of held-out items inside long documents.

Containment search with MinHash over domains partitioned by size.  The queries are all windows of
`run` tokens of an item, as sets of five-token shingles; the domains are passages of the documents,
short enough that a contained window makes up a known share of the passage.  Passages are
partitioned by size, and the number of hash functions of a partition follows from that share, so
that a contained window is missed with probability `miss` at most.  Documents with a hit are then
verified by their exact sets of `run`-token shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tomelattice.llm.arrow import text_batches
from tomelattice.llm.setsim import SHINGLE
from tomelattice.llm.tokens import shingles, tokenize

#: Characters of items searched for in one pass over the documents; more items take more passes.
ITEM_CHARS = 4_000_000
_FILTER = 1 << 18


def functions_needed(query: int, domain: int, miss: float) -> int:
    """Hash functions for which one at least has equal minima in a domain and a contained query, but for `miss`."""
    share = query / domain
    return 1 if share >= 1 else math.ceil(math.log(miss) / math.log(1 - share))


class ItemIndex:
    """Minima of the items' windows, by hash function, and the items' exact windows."""

    def __init__(self, ids: list, texts: list[str | None], run: int = 20, miss: float = 1e-6) -> None:
        self.run, self.ids = run, ids
        self.window = run - SHINGLE + 1  # shingles in a window, and in half a passage
        tokens, offsets = tokenize(texts)
        exact, at = shingles(tokens, offsets, run)
        item = np.repeat(np.arange(len(texts)), np.diff(at))
        both = np.unique(np.stack([exact, item.astype(np.uint64)], 1), axis=0) if len(exact) else np.zeros((0, 2), np.uint64)
        self.exact, self.item = both[:, 0].copy(), both[:, 1].astype(np.int64)
        self.windows = np.bincount(self.item, minlength=len(texts))
        small, to = shingles(tokens, offsets, SHINGLE)
        starts = np.repeat(to[:-1], np.maximum(np.diff(to) - self.window + 1, 0)) if len(small) else np.zeros(0, np.int64)
        per = np.maximum(np.diff(to) - self.window + 1, 0)
        starts = starts + np.arange(len(starts)) - np.repeat(np.cumsum(per) - per, per)
        rows = np.sort(small[starts[:, None] + np.arange(self.window)], axis=1) if len(starts) else np.zeros((0, self.window), np.uint64)
        different = 1 + (rows[:, 1:] != rows[:, :-1]).sum(axis=1) if len(rows) else np.zeros(0, np.int64)
        # Windows that repeat themselves are a small share of a passage: they are looked up by every shingle.
        few = different < self.window * 3 // 4
        self.direct = np.unique(rows[few])
        rows = rows[~few]
        # Partitions of passages by size: up to one window's shingles, up to one and a half, up to two.
        least = self.window * 3 // 4
        self.sizes = [self.window, self.window * 3 // 2, self.window * 2]
        self.functions = [functions_needed(min(least, u) if u > self.window else least, u, miss) for u in self.sizes]
        state = np.random.default_rng(20).integers(1, 1 << 63, (2, max(self.functions)), dtype=np.uint64)
        self.seeds = [(s, a | np.uint64(1)) for s, a in state.T]
        self.minima, self.filters = [], []
        for s, a in self.seeds:
            m = np.unique(((rows ^ s) * a).min(axis=1)) if len(rows) else np.zeros(0, np.uint64)
            f = np.zeros(_FILTER, bool)
            f[(m >> np.uint64(20) & np.uint64(_FILTER - 1)).astype(np.int64)] = True
            self.minima.append(m)
            self.filters.append(f)

    def _among(self, values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_values, values)
        at[at == len(sorted_values)] = 0
        return sorted_values[at] == values if len(sorted_values) else np.zeros(len(values), bool)

    def candidates(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the texts, with five-token shingles values[at[i]:at[i + 1]], that have a passage with a hit."""
        w = self.window
        n = -(-len(values) // w)
        if not n:
            return np.zeros(0, np.int64)
        # Halves of passages side by side over all texts; what is missing at the end repeats the last shingle.
        padded = np.concatenate([values, np.full(n * w - len(values), values[-1])])
        halves = np.ascontiguousarray(padded.reshape(n, w).T)
        hit = np.zeros(n, bool)
        columns = np.sort(padded.reshape(n, w), axis=1)
        distinct = 1 + (columns[:, 1:] != columns[:, :-1]).sum(axis=1)
        size = distinct + np.append(distinct[1:], 0)
        need = np.array(self.functions)[np.searchsorted(self.sizes, size)]
        for j, (s, a) in enumerate(self.seeds):
            low = ((halves ^ s) * a).min(axis=0)
            low[:-1] = np.minimum(low[:-1], low[1:])
            maybe = np.flatnonzero(self.filters[j][(low >> np.uint64(20) & np.uint64(_FILTER - 1)).astype(np.int64)] & (need > j))
            hit[maybe] |= self._among(low[maybe], self.minima[j])
        places = np.flatnonzero(hit)
        passages = [places * w, np.minimum((places + 2) * w, len(values)) - 1]
        if len(self.direct):
            single = np.flatnonzero(self._among(values, self.direct))
            passages = [np.concatenate([p, single]) for p in passages]
        # A passage may cover the end of one text, whole short ones and the beginning of another.
        first, last = (np.searchsorted(at, p, "right") - 1 for p in passages)
        span = last - first + 1
        texts = np.repeat(first, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        return np.unique(texts)

    def verified(self, tokens: np.ndarray, offsets: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of candidate texts: (text, item, distinct common windows) by exact windows."""
        if not len(texts):
            return (np.zeros(0, np.int64),) * 3
        length = np.diff(offsets)[texts]
        own = np.concatenate([tokens[offsets[i] : offsets[i + 1]] for i in texts.tolist()])
        exact, at = shingles(own, np.concatenate([[0], np.cumsum(length)]), self.run)
        of = np.repeat(texts, np.diff(at))
        known = self._among(exact, np.unique(self.exact))
        both = np.unique(np.stack([exact[known], of[known].astype(np.uint64)], 1), axis=0)
        a, b = (np.searchsorted(self.exact, both[:, 0], side) for side in ("left", "right"))
        n = b - a
        item = self.item[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pairs, common = np.unique(np.repeat(both[:, 1].astype(np.int64), n) * len(self.ids) + item, return_counts=True)
        return pairs // len(self.ids), pairs % len(self.ids), common


def _searcher(shared, item_type: pa.DataType):
    def search(batches):
        index = shared.value
        for batch, texts in text_batches(batches, "text"):
            tokens, offsets = tokenize(texts)
            text, item, common = index.verified(tokens, offsets, index.candidates(*shingles(tokens, offsets, SHINGLE)))
            if len(text):
                yield pa.record_batch([batch.column("doc").take(pa.array(text)), pa.array([index.ids[i] for i in item.tolist()], item_type), pa.array(common), pa.array(common / index.windows[item])], ["doc", "item", "common", "share"])

    return search


def leaked(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 20, miss: float = 1e-6) -> DataFrame:
    """Documents that hold `run` or more consecutive tokens of an item: (doc, item, common, share).

    common counts the item's distinct windows of `run` tokens found in the document, share is their
    part of the item's windows.  Null, empty and shorter texts hold nothing; items with equal texts
    are each reported; rows with a null id are left out; if an id occurs in several rows, so may a
    pair.  Items are read in blocks of ITEM_CHARS characters, each searched in one pass.
    """
    spark = docs.sparkSession
    kinds = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc {kinds[0]}, item {kinds[1]}, common long, share double"
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    out = spark.createDataFrame([], schema)
    ids: list = []
    block: list[str] = []

    def search() -> DataFrame:
        index = ItemIndex(list(ids), list(block), run, miss)
        return texts.mapInArrow(_searcher(spark.sparkContext.broadcast(index), to_arrow_type(items.schema[item_id].dataType)), schema)

    first, size = True, 0
    for i, t in items.select(item_id, item_text).where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).toLocalIterator():
        ids.append(i)
        block.append(t)
        size += len(t)
        if size >= ITEM_CHARS:
            out, first = (search() if first else out.union(search())), False
            ids, block, size = [], [], 0
    if block:
        out = search() if first else out.union(search())
    return out
