"""Batches of text inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Characters handled at once; bounds a worker's memory whatever the row lengths.
BATCH_CHARS = 1_500_000


def text_batches(batches: Iterator[pa.RecordBatch], column: str, chars: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cuts batches so that each part's texts have about `chars` characters at most (one longer text stays whole)."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        begin = size = 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if i > begin and size + n > chars:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += n
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]
