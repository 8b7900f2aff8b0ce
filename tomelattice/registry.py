"""Where chunks and dictionaries are kept: contracts of stores, and stores found by kind and priority.

A store is found by its kind; of several the one with the lowest priority value is taken, of equals
the one registered first, and every call makes a new one.  The stores here keep tables in folders of
versions; others, over any Spark data source, are registered beside or before them.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelattice import schema
from tomelattice.errors import StorageError
from tomelattice.functions.text import normalized
from tomelattice.store import Store

#: Kinds of stores, and the priority of those of this package.
CHUNK_STORE, DICTIONARY_STORE, OWN_PRIORITY = "chunks", "dictionary", 100


class ChunkStore(Protocol):
    """Chunks and their contents, by chunk_id."""

    def open(self) -> None: ...
    def save(self, chunks: DataFrame, contents: DataFrame) -> None: ...
    def chunks(self, ids: list[str] | None = None) -> DataFrame: ...
    def contents(self, ids: list[str] | None = None) -> DataFrame: ...
    def exists(self, id: str) -> bool: ...
    def ids(self) -> DataFrame: ...
    def delete(self, ids: list[str]) -> None: ...
    def clear(self) -> None: ...
    def usage(self) -> str: ...
    def healthy(self) -> bool: ...
    def flush(self) -> None: ...
    def close(self) -> None: ...


class DictionaryStore(Protocol):
    """Keyword definitions and postings."""

    def open(self) -> None: ...
    def save(self, definitions: DataFrame, postings: DataFrame) -> None: ...
    def definitions(self) -> DataFrame: ...
    def postings(self, keywords: list[str] | None = None) -> DataFrame: ...
    def clear(self) -> None: ...
    def healthy(self) -> bool: ...
    def close(self) -> None: ...


class _Folder:
    """What the stores in folders have in common: opening twice does nothing, use before or after is an error."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._store: Store | None = None

    @property
    def store(self) -> Store:
        if self._store is None:
            raise StorageError("STORAGE_008", f"{self.root} isn't open")
        return self._store

    def open(self) -> None:
        if self._store is None:
            self._store = Store(self.spark, self.root)
            self._store.pointer()

    def healthy(self) -> bool:
        """Whether it is open and its tables can be found."""
        try:
            self.store.pointer()
            return True
        except StorageError:
            return False

    def clear(self) -> None:
        self.store.clear()

    def flush(self) -> None:
        """Nothing is held back: what was saved is committed."""

    def close(self) -> None:
        self._store = None


class FolderChunks(_Folder):
    """A chunk store of two tables; saving a chunk again replaces it."""

    def save(self, chunks: DataFrame, contents: DataFrame) -> None:
        self.store.append({"chunks": (chunks, ["chunk_id"]), "contents": (contents, ["chunk_id"])})

    def chunks(self, ids: list[str] | None = None) -> DataFrame:
        return self._rows("chunks", schema.CHUNKS, ids)

    def contents(self, ids: list[str] | None = None) -> DataFrame:
        return self._rows("contents", schema.CHUNK_CONTENT, ids)

    def _rows(self, name: str, kind: str, ids: list[str] | None) -> DataFrame:
        return self.store.latest(name, kind, ["chunk_id"], None if ids is None else F.col("chunk_id").isin(ids))

    def exists(self, id: str) -> bool:
        return bool(self.chunks([id]).take(1))

    def ids(self) -> DataFrame:
        return self.chunks().select("chunk_id")

    def delete(self, ids: list[str]) -> None:
        self.store.commit({n: t.where(~F.col("chunk_id").isin(ids)) for n, t in (("chunks", self.chunks()), ("contents", self.contents()))})

    def usage(self) -> str:
        """Rows, and bytes of their contents, in words."""
        rows, size = self.contents().agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()
        return f"{rows} chunks, {size} bytes"


class FolderDictionary(_Folder):
    """A dictionary store of two tables."""

    def save(self, definitions: DataFrame, postings: DataFrame) -> None:
        self.store.append({"definitions": (definitions, None), "postings": (postings, None)})

    def definitions(self) -> DataFrame:
        return self.store.table("definitions", schema.DEFINITIONS)

    def postings(self, keywords: list[str] | None = None) -> DataFrame:
        every = self.store.table("postings", schema.POSTINGS)
        return every if keywords is None else every.where(normalized("keyword").isin([k.strip().lower() for k in keywords]))


@dataclass
class Entry:
    name: str
    make: Callable
    priority: int


class Registry:
    """Stores by kind and name."""

    def __init__(self, own: bool = True) -> None:
        self._of: dict[str, list[Entry]] = {}
        if own:
            self.register(CHUNK_STORE, "folder", FolderChunks, OWN_PRIORITY)
            self.register(DICTIONARY_STORE, "folder", FolderDictionary, OWN_PRIORITY)

    def register(self, kind: str, name: str, make: Callable | str, priority: int = 0) -> None:
        """make: what makes a store, or 'module:name' of that; the same kind and name again replaces it."""
        if isinstance(make, str):
            module, _, attribute = make.partition(":")
            make = getattr(importlib.import_module(module), attribute)
        entries = self._of.setdefault(kind, [])
        entries[:] = [e for e in entries if e.name != name] + [Entry(name, make, priority)]

    def names(self, kind: str) -> list[str]:
        """By priority, equals as registered."""
        return [e.name for e in sorted(self._of.get(kind, []), key=lambda e: e.priority)]

    def find(self, kind: str, *args, name: str | None = None, **options):
        """A new store of the kind: the named one, else that of the lowest priority value."""
        entries = [e for e in sorted(self._of.get(kind, []), key=lambda e: e.priority) if name in (None, e.name)]
        if not entries:
            raise StorageError("STORAGE_009", f"no store of the kind {kind}" + (f" is named {name}" if name else ""))
        return entries[0].make(*args, **options)
