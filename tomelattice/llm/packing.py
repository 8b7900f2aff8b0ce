"""Texts put whole into containers of a fixed number of tokens.

Only the histogram of lengths reaches the driver.  Patterns, multisets of a few lengths that fill a
container, are fitted to it by non-negative least squares: the active-set method takes in, step by
step, the pattern that best explains what is left of the histogram; that pattern is found among all
of them by a knapsack recurrence.  Repeat counts are rounded down, and what remains of the histogram
is packed by best fit, longest first, by counts.  Texts then find their containers by their rank
among texts of their length, so no text is moved to be packed.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomelattice.llm.arrow import text_batches
from tomelattice.session import stage

CAPACITY = 2048
#: Tokens that lengths are rounded up to for patterns; texts in a fitted pattern, and patterns fitted, at most.
GRAIN, FEW, PATTERNS = 8, 8, 600
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How text is split before the vocabulary's merges (the public pattern these vocabularies were made with).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def tokenizer(vocabulary: str):
    """A worker's tokenizer for a file of ranks."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def best_pattern(worth: np.ndarray, size: int, few: int = FEW) -> tuple[float, np.ndarray]:
    """The multiset of at most `few` lengths 1 ... size with the highest total worth among those that sum to size.

    worth[i] belongs to length i + 1; -inf forbids it.  Returns the total and how often each length
    is taken; nothing fits: -inf and zeros.
    """
    best = np.full((few + 1, size + 1), -np.inf)
    taken = np.zeros((few + 1, size + 1), np.int64)
    best[0, 0] = 0
    steps = np.arange(size + 1)[:, None] - np.arange(1, size + 1)[None, :]
    ok = steps >= 0
    at = np.where(ok, steps, 0)
    for k in range(1, few + 1):
        total = np.where(ok, best[k - 1][at], -np.inf) + worth[None, :]
        taken[k] = total.argmax(axis=1)
        best[k] = total[np.arange(size + 1), taken[k]]
    k = int(best[:, size].argmax())
    counts = np.zeros(size, np.int64)
    if not np.isfinite(best[k, size]):
        return -np.inf, counts
    value, left = float(best[k, size]), size
    while k:
        counts[taken[k, left]] += 1
        left -= taken[k, left] + 1
        k -= 1
    return value, counts


def fit(histogram: np.ndarray, most: int = PATTERNS, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts of lengths) and their non-negative least-squares repeat counts."""
    h = histogram.astype(float)
    size = len(h)
    weight = np.sqrt(np.arange(1, size + 1))  # a long text left over takes more room
    columns = np.zeros((0, size))
    x = np.zeros(0)
    tried: set[bytes] = set()
    for _ in range(most):
        rest = (h - x @ columns) * weight**2
        value, counts = best_pattern(np.where(h > 0, rest, -np.inf), size, few)
        if value <= 1e-6 * max(h.sum(), 1) or counts.tobytes() in tried:
            break
        tried.add(counts.tobytes())
        columns, x = np.vstack([columns, counts]), np.append(x, 0.0)
        while True:
            scaled = columns * weight
            s = np.linalg.solve(scaled @ scaled.T + 1e-9 * np.eye(len(columns)), scaled @ (h * weight))
            if (s > 0).all():
                x = s
                break
            low = s <= 0
            step = (x[low] / np.maximum(x[low] - s[low], 1e-12)).min()
            x = x + min(step, 1.0) * (s - x)
            keep = x > 1e-9
            if keep.all():
                keep[int(np.argmin(x))] = False
            columns, x = columns[keep], x[keep]
            if not len(x):
                break
    return columns.astype(np.int64), x


def most_together(histogram: np.ndarray) -> int:
    """Texts that a pattern may have: FEW, or where texts are short half as many again as fill a container on average."""
    n = int(histogram.sum())
    mean = float((histogram * np.arange(1, len(histogram) + 1)).sum() / n) if n else 1.0
    return min(len(histogram), max(FEW, int(np.ceil(1.5 * len(histogram) / mean))))


def plan(histogram: np.ndarray, few: int | None = None) -> list[tuple[np.ndarray, int]]:
    """(counts of lengths, repeats) of all containers; counts add up to the histogram, lengths in a container to its size at most."""
    size = len(histogram)
    few = few or most_together(histogram)
    left = histogram.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    patterns, x = fit(left, few=few)
    for i in np.argsort(-x):
        used = patterns[i] > 0
        n = int(min(x[i] + 1e-6, (left[used] // patterns[i][used]).min()))
        if n > 0:
            out.append((patterns[i], n))
            left -= n * patterns[i]
    # Best fit for the rest: open[room] are containers with that much room, as (counts, how many).
    open_: dict[int, list[tuple[np.ndarray, int]]] = {}
    for length in range(size, 0, -1):
        n = int(left[length - 1])
        for room in range(length, size):
            while n and open_.get(room):
                counts, many = open_[room].pop()
                put = min(n, many)
                if many > put:
                    open_[room].append((counts, many - put))
                more = counts.copy()
                more[length - 1] += 1
                open_.setdefault(room - length, []).append((more, put))
                n -= put
        per = size // length
        for each, many in ((per, n // per), (n % per, 1)):
            if each and many:
                counts = np.zeros(size, np.int64)
                counts[length - 1] = each
                open_.setdefault(size - each * length, []).append((counts, many))
    return out + [g for groups in open_.values() for g in groups]


class Places:
    """Containers by length and rank among the texts of that length."""

    def __init__(self, containers: list[tuple[np.ndarray, int]]) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        filled: dict[int, int] = {}
        base = 0
        for counts, many in containers:
            for i in np.flatnonzero(counts).tolist():
                rows.setdefault(i, []).append((filled.get(i, 0), base, int(counts[i])))
                filled[i] = filled.get(i, 0) + many * int(counts[i])
            base += many
        self.count = base
        self.rows = {i: tuple(np.array(c, np.int64) for c in zip(*r)) for i, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.full(len(length), -1, np.int64)
        for i in np.unique(length).tolist():
            of = length == i
            begins, base, each = self.rows[i - 1]
            k = np.searchsorted(begins, rank[of], "right") - 1
            out[of] = base[k] + (rank[of] - begins[k]) // each[k]
        return out


def _measurer(vocabulary: str, capacity: int, grain: int):
    def measure(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity // grain + 2, np.int64)
        encode = tokenizer(SparkFiles.get(vocabulary))
        for batch, texts in text_batches(batches, "text"):
            n = np.array([len(x) for x in encode.encode_ordinary_batch([t.encode("utf-8", "replace").decode() if t else "" for t in texts], num_threads=1)], np.int64)
            parts = np.maximum(-(-n // capacity), 1)
            row = np.repeat(np.arange(len(n)), parts)
            part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = part * capacity
            length = np.minimum(n[row] - begin, capacity)
            room = -(-length // grain)  # 0 for a text without tokens, which needs no container
            local = np.zeros(len(row), np.int64)
            for g in np.unique(room).tolist():
                at = np.flatnonzero(room == g)
                local[at] = seen[g] + np.arange(len(at))
                seen[g] += len(at)
            yield pa.record_batch([batch.column("doc").take(pa.array(row)), pa.array(part), pa.array(begin), pa.array(length), pa.array(room), pa.array(np.full(len(row), task, np.int64)), pa.array(local)], ["doc", "part", "token_begin", "tokens", "room", "task", "local"])

    return measure


def _placer(shared):
    def place(batches):
        for batch in batches:
            room = batch.column("room").to_numpy()
            rank = batch.column("local").to_numpy() + batch.column("before").to_numpy()
            found = np.full(len(room), -1, np.int64)
            some = room > 0
            found[some] = shared.value.find(room[some], rank[some])
            yield pa.record_batch([pa.array(found, mask=~some), *(batch.column(c) for c in ("doc", "part", "token_begin", "tokens"))], ["container", "doc", "part", "token_begin", "tokens"])

    return place


def pack(docs: DataFrame, doc: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, grain: int = GRAIN, few: int | None = None) -> DataFrame:
    """(container, doc, part, token_begin, tokens): every text, or part of a text above the capacity, in its container.

    A longer text is divided after every `capacity` tokens; its parts are numbered from 0, those of
    full length fill a container each.  Null and empty texts have no tokens and a null container.
    Repeated rows are packed each; a null doc is kept; other columns are not looked at; an empty
    table gives an empty result.  capacity has to be a multiple of grain; patterns have `few` texts at
    most, by default as the lengths suggest.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc].dataType.simpleString()
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    spark.sparkContext.addFile(vocabulary)  # to every worker
    items = stage(texts.mapInArrow(_measurer(os.path.basename(vocabulary), capacity, grain), f"doc {kind}, part long, token_begin long, tokens long, room long, task long, local long"))
    counts = stage(items.groupBy("task", "room").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity // grain, np.int64)
    for room, n in counts.where("room > 0").groupBy("room").agg(F.sum("n")).collect():  # capacity / grain rows at most
        histogram[room - 1] = n
    places = Places(plan(histogram, few))
    before = counts.select("task", "room", F.coalesce(F.sum("n").over(Window.partitionBy("room").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = items.join(before, ["task", "room"])
    return ranked.mapInArrow(_placer(spark.sparkContext.broadcast(places)), f"container long, doc {kind}, part long, token_begin long, tokens long")
