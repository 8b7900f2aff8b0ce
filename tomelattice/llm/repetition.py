"""Repetition inside single documents.

Every document gets rule statistics (shares of repeated token sequences, lines and sentences).  An
isolation forest is fitted on a bounded sample of them; short average path lengths over its random
splits mark anomalous documents, with a threshold calibrated on the sample's rows, labelled by the
exact share of repeated sequences.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomelattice.llm.arrow import text_batches
from tomelattice.llm.tokens import distinct_sorted, shingles, tokenize

#: Rows the forest is fitted and calibrated on, about; trees; rows of a tree.
SAMPLE, TREES, ROWS = 4096, 100, 256
#: Most repeated rows in the sample that trees are grown from, as a share: anomalies have to be few there.
ANOMALIES = 0.05
#: Tokens of a sequence whose repetition is measured, fewest tokens of a text, and the share that counts as repeated.
SEQUENCE, FEWEST, REPEATED = 8, 40, 0.3

NAMES = ("share", "share_short", "share_long", "share_lines", "share_sentences")
_SENTENCE = re.compile(r"[。！？!?.;；\n]+")


def _repeated(parts: list[str]) -> float:
    """Share of the characters that lie in repetitions of earlier parts."""
    parts = [p for p in parts if len(p) > 1]
    total = sum(map(len, parts))
    return 1 - sum(map(len, set(parts))) / total if total else 0.0


def statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token counts, and a row of the rule statistics (NAMES) for each text; 0 where a text is too short for one."""
    tokens, offsets = tokenize(texts)
    out = np.zeros((len(texts), len(NAMES)))
    for c, k in enumerate((SEQUENCE, SEQUENCE // 2, SEQUENCE * 2)):
        values, at = shingles(tokens, offsets, k)
        _, to = distinct_sorted(values, at)
        n = np.diff(at)
        out[:, c] = 1 - np.diff(to) / np.maximum(n, 1)
        out[n == 0, c] = 0
    for i, t in enumerate(texts):
        if t:
            out[i, 3] = _repeated(t.split("\n"))
            out[i, 4] = _repeated(_SENTENCE.split(t))
    return np.diff(offsets), out


def _average_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits; each node is a row of parallel arrays."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, per_tree: int = ROWS, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        self.per_tree = min(per_tree, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.per_tree, 2)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.per_tree, replace=False)], rng) for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, child, length = [], [], [], []

        def node(x: np.ndarray, depth: int) -> int:
            at = len(feature)
            feature.append(0), cut.append(np.inf), child.append((at, at)), length.append(0.0)
            spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
            if depth >= self.depth or not len(spread):
                length[at] = depth + float(_average_path(len(x)))
                return at
            f = int(rng.choice(spread))
            feature[at], cut[at] = f, float(rng.uniform(x[:, f].min(), x[:, f].max()))
            low = x[:, f] < cut[at]
            child[at] = node(x[low], depth + 1), node(x[~low], depth + 1)
            return at

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(child), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher for rows that few splits isolate."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, child, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = child[at, (rows[every, feature[at]] >= cut[at]).astype(np.int64)]
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_average_path(self.per_tree)), 1e-9))


def fit(rows: np.ndarray, labels: np.ndarray) -> tuple[IsolationForest | None, float]:
    """A forest and the score from which a row is anomalous.

    The threshold lies half way from the labelled anomalies' lowest score to the other rows' mean,
    so that all labelled anomalies and rows near them pass.  Without a labelled anomaly, or a row
    that is none, there is nothing to calibrate on, and every row passes.
    """
    if labels.all() or not labels.any():
        return None, 0.0
    few = np.flatnonzero(labels)[: max(1, int(ANOMALIES * (~labels).sum()))]
    forest = IsolationForest(np.concatenate([rows[~labels], rows[few]]))
    scores = forest.score(rows)
    return forest, float(scores[labels].min() + min(scores[~labels].mean(), scores[labels].min())) / 2


def _measure(batches):
    for batch, texts in text_batches(batches, "text"):
        n, rows = statistics(texts)
        yield pa.record_batch([batch.column("ref"), pa.array(n), *(pa.array(rows[:, c]) for c in range(len(NAMES)))], ["ref", "tokens", *NAMES])


def _scorer(model):
    def score(batches):
        forest, threshold = model.value
        for batch in _measure(batches):
            rows = np.stack([batch.column(c).to_numpy() for c in NAMES], 1)
            scores = forest.score(rows) if forest else np.zeros(len(rows))
            long = batch.column("tokens").to_numpy() >= FEWEST
            yield pa.record_batch([*batch.columns, pa.array(scores), pa.array((scores >= threshold) & long)], [*batch.schema.names, "score", "anomalous"])

    return score


def repetition(docs: DataFrame, ref: str, text: str) -> DataFrame:
    """One row per row of docs: ref, tokens, the shares of repeated content, score and anomalous.

    `share` is 1 - distinct / all sequences of eight consecutive tokens.  A null text is as an empty
    one: no tokens, all shares 0; texts of fewer than FEWEST tokens are never anomalous.  Rows with a
    null ref or repeated rows are kept; other columns are not looked at; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[ref].dataType.simpleString()
    texts = docs.select(F.col(ref).alias("ref"), F.col(text).alias("text"))
    schema = f"ref {kind}, tokens long, " + ", ".join(f"{c} double" for c in NAMES)
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("ref", "text"), F.lit(every)) == 0).mapInArrow(_measure, schema).where(F.col("tokens") >= FEWEST).select(*NAMES).limit(2 * SAMPLE).collect()
    rows = np.array(sample, float).reshape(-1, len(NAMES))
    model = fit(rows, rows[:, 0] >= REPEATED)
    return texts.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), f"{schema}, score double, anomalous boolean")
