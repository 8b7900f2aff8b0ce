"""Versioned tables of a knowledge base.

A version is a folder of Parquet tables that nothing changes once written.  A small pointer file
names the committed one; it is replaced in a single rename, after everything else.  Readers keep the
version they began with; what the pointer never named is invisible and goes with the next cleaning.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelattice.errors import StorageError

POINTER = "current.json"
#: Folders of a table beyond which appending puts them together, and the column that says when a row was written.
FOLDERS, AT = 32, "_at"


class Files:
    """The few file operations needed, on whatever file system a path is."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self._fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        at = self.path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def is_folder(self, *parts: str) -> bool:
        return self._fs.exists(self.path(*parts)) and self._fs.getFileStatus(self.path(*parts)).isDirectory()

    def read(self, *parts: str) -> str:
        stream = self._fs.open(self.path(*parts))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def replace(self, text: str, name: str) -> None:
        """Writes a file next to the place and moves it there."""
        temporary = self.path(f".{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self._fs.getConf())
        array = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        array[0] = options.OVERWRITE
        context.rename(temporary, self.path(name), array)

    def size(self, *parts: str) -> int:
        return self._fs.getContentSummary(self.path(*parts)).getLength()

    def delete(self, *parts: str) -> None:
        self._fs.delete(self.path(*parts), True)


class Store:
    """The tables of one knowledge base below a folder.  A table is one or several folders of files."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.files = spark, Files(spark, root)

    def pointer(self) -> dict | None:
        """What the committed version is, or None if there is none yet; a broken pointer is an error."""
        if not self.files.exists(POINTER):
            return None
        try:
            state = json.loads(self.files.read(POINTER))
            folders = [f for t in state["tables"].values() for f in t]
        except (ValueError, KeyError, TypeError, AttributeError, Py4JJavaError) as e:
            raise StorageError("STORAGE_004", f"the pointer can't be read: {e}") from e
        missing = [f for f in folders if not self.files.exists(f)]
        if missing:
            raise StorageError("STORAGE_005", f"tables are gone: {missing}")
        return state

    def commit(self, replaced: dict[str, DataFrame], appended: dict[str, DataFrame] | None = None, rows_per_file: int = 0, **facts) -> str:
        """Writes tables as a new version, then moves the pointer to it.

        Replaced tables are written whole, and may be read from the old version; appended rows are
        written beside what is there, which isn't read.
        """
        now = self.pointer() or {"number": 0, "tables": {}}
        number = now["number"] + 1
        version = f"v{number:06d}-{uuid.uuid4().hex[:8]}"
        tables = dict(now["tables"])
        for name, df, kept in [*((n, d, []) for n, d in replaced.items()), *((n, d, tables.get(n, [])) for n, d in (appended or {}).items())]:
            df.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.files.root}/{version}/{name}")
            tables[name] = [*kept, f"{version}/{name}"]
        self.files.replace(json.dumps({"version": version, "number": number, "tables": tables, "facts": facts}), POINTER)
        return version

    def append(self, rows: dict[str, tuple[DataFrame, list[str] | None]], **facts) -> str:
        """Adds rows as a new version, which with keys replace older ones of the same keys; work follows the rows, not the tables.

        Tables of more than FOLDERS folders are put together first.
        """
        now = self.pointer() or {"number": 0, "tables": {}, "facts": {}}
        many = {n: keys for n, (_, keys) in rows.items() if len(now["tables"].get(n, [])) >= FOLDERS}
        if many:
            self.compact(many)
        number = F.lit(now["number"] + 1 + bool(many)).cast("long")
        return self.commit({}, {n: df.withColumn(AT, number) if keys else df for n, (df, keys) in rows.items()}, **(now["facts"] | facts))

    def latest(self, name: str, schema: str, keys: list[str], chosen=None) -> DataFrame:
        """The newest row of every key of a table that is appended to; chosen, a condition on the keys, reaches the files."""
        folders = (self.pointer() or {"tables": {}})["tables"].get(name, [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        every = self.spark.read.schema(f"{schema}, {AT} long").parquet(*(f"{self.files.root}/{f}" for f in folders)).withColumn(AT, F.coalesce(AT, F.lit(0)))
        if chosen is not None:
            every = every.where(chosen)
        columns = [c for c in every.columns if c != AT]
        if len(folders) == 1:  # written at once, with every key once
            return every.select(*columns)
        return every.groupBy(*keys).agg(F.max_by(F.struct(*columns), AT).alias("_row")).select("_row.*")

    def compact(self, keys: dict[str, list[str] | None] | None = None) -> dict[str, int]:
        """Writes tables of several folders as one, of keyed ones the newest rows; the number of folders each had.  keys None: all tables, unkeyed."""
        now = self.pointer()
        held = {n: f for n, f in (now["tables"] if now else {}).items() if len(f) > 1 and (keys is None or n in keys)}
        if held:
            frames = {}
            for n in held:
                every = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.files.root}/{f}" for f in held[n]))
                every = every.withColumn(AT, F.coalesce(AT, F.lit(0))) if AT in every.columns else every
                by = (keys or {}).get(n)
                kept = every.groupBy(*by).agg(F.max_by(F.struct(*every.columns), AT).alias("_row")).select("_row.*") if by and AT in every.columns else every
                frames[n] = kept
            self.commit(frames, **now["facts"])
            self.clean()
        return {n: len(f) for n, f in held.items()}

    def clear(self) -> None:
        """Forgets all tables."""
        now = self.pointer() or {"number": 0}
        self.files.replace(json.dumps({"version": None, "number": now["number"] + 1, "tables": {}, "facts": {}}), POINTER)
        self.clean()

    def usage(self) -> dict[str, int]:
        """Bytes of the files of every table."""
        now = self.pointer()
        return {n: sum(self.files.size(f) for f in folders) for n, folders in (now["tables"] if now else {}).items()}

    def table(self, name: str, schema: str) -> DataFrame:
        """A table of the committed version; an empty one of the schema if there is none."""
        now = self.pointer()
        if now is None or name not in now["tables"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*(f"{self.files.root}/{f}" for f in now["tables"][name]))

    def facts(self) -> dict:
        now = self.pointer()
        return now["facts"] if now else {}

    def clean(self) -> list[str]:
        """Deletes the folders of versions of which the pointer names none; readers of those fail afterwards."""
        now = self.pointer()
        used = {f.split("/")[0] for t in (now["tables"].values() if now else []) for f in t}
        old = [n for n in self.files.names() if n.startswith("v") and self.files.is_folder(n) and n not in used]
        for n in old:
            self.files.delete(n)
        return old


def found(table: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of some keys; unknown ones have none.  The filter reaches the files."""
    return table.where(F.col(key).isin(values))


def used_bytes(table: DataFrame, column: str, by: str) -> DataFrame:
    """(by, rows, bytes): the UTF-8 bytes of a text column."""
    return table.groupBy(by).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).cast("long").alias("bytes"))
