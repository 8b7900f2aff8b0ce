"""Knowledge bases as objects: documents in, questions answered."""

from __future__ import annotations

import re
import time
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelattice import schema
from tomelattice.errors import DocumentError, NavigationError, StorageError
from tomelattice.functions.text import NAME_LENGTH, NAME_PATTERN, is_blank, normalized, safe_name
from tomelattice.hooks import Hooks
from tomelattice.model.cache import ResponseCache, StoredProvider
from tomelattice.model.provider import OfflineProvider, Provider
from tomelattice.operators import tree as trees
from tomelattice.operators.comprehend import comprehended, rolled_up
from tomelattice.operators.dedupe import first_of_copies
from tomelattice.operators.navigate import answer_context, answered, navigate
from tomelattice.operators.ranking import ranked
from tomelattice.operators.sections import byte_range, chunks
from tomelattice.session import ship, stage
from tomelattice.sources.files import read_documents
from tomelattice.store import Store, Files

MARKER = "knowledge-base"


@dataclass(frozen=True)
class Settings:
    """Limits of a knowledge base; out of range is an error, too small a size is raised to the least."""

    concurrent: int = 5
    max_steps: int = 20
    prompt_chars: int = 4000
    threshold: int = 100_000
    cached: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.concurrent <= 100:
            raise ValueError("concurrent has to be 1 to 100")
        if not 5 <= self.max_steps <= 100:
            raise ValueError("max_steps has to be 5 to 100")
        object.__setattr__(self, "prompt_chars", max(200, self.prompt_chars))
        object.__setattr__(self, "threshold", max(1000, self.threshold))


_DOCUMENTS = "doc_id string, title string, md5 string, file_path string, mode string, ordinal long"
_TEXTS = "doc_id string, content string"
_CHUNKS = "chunk_id string, document_id string, document_title string, section_index int, section_title string, heading_level int, summary string, source_offset long, source_length long"
_NODES = "node_id string, name string, description string, type string, key_entities array<string>, keywords array<string>, example_questions array<string>"
_LINKS = "parent string, child string, pos long"
_HELD = "node_id string, chunk_id string, pos long"
#: Tables that grow by newer rows of the same keys.
_KEYED = {"nodes": ["node_id"], "links": ["parent", "child"], "held": ["node_id", "chunk_id"], "postings": ["keyword", "node_id"]}


class KnowledgeBase:
    """One knowledge base in a folder.  Writers take turns; a reader sees one committed version throughout a call."""

    def __init__(self, spark: SparkSession, root: str, provider: Provider | None = None, settings: Settings | None = None, hooks: Hooks | None = None) -> None:
        ship(spark)
        self.spark, self.store = spark, Store(spark, root)
        self.settings, self.hooks = settings or Settings(), hooks or Hooks()
        self.cache = ResponseCache(spark, f"{root}/llm-cache") if self.settings.cached else None
        self.provider = StoredProvider(provider or OfflineProvider(), self.cache)
        self._writer = ThreadPoolExecutor(1)

    # Reading

    def table(self, name: str) -> DataFrame:
        kinds = {"documents": _DOCUMENTS, "texts": _TEXTS, "chunks": _CHUNKS, "nodes": _NODES, "links": _LINKS, "held": _HELD, "postings": schema.POSTINGS, "definitions": schema.DEFINITIONS}
        if name in _KEYED:
            return self.store.latest(name, kinds[name], _KEYED[name])
        return self.store.table(name, kinds[name])

    def tree(self) -> trees.Tree:
        return trees.Tree(self.table("nodes"), self.table("links"), self.table("held"), self.store.facts().get("root"))

    # Writing

    def ingest_files(self, *paths: str, mode: str = "COPY", policy: str = "AUTO") -> DataFrame:
        """Takes in files; see ingest.  REFERENCE keeps no text and reads the file again when asked."""
        files = read_documents(self.spark, *paths)
        docs = files.select(F.col("file_path").alias("id"), F.col("name").alias("title"), "content", "file_path", "md5", "error")
        return self.ingest(docs, mode, policy)

    def ingest(self, docs: DataFrame, mode: str = "INLINE", policy: str = "AUTO") -> DataFrame:
        """Takes in documents (id, title, content, file_path, md5, and perhaps error), in the order of their ids.

        The report has (id, title, doc_id, success, skipped, message) for each: a copy, by md5, of a
        stored document or of one before it in the batch is skipped, which counts as success; one
        that can't be read, breaks the rules or isn't understood by the model has a message and
        keeps no copy of it from being taken.
        """
        return self._writer.submit(self._ingest, docs, mode, policy, False).result()

    def ingest_async(self, docs: DataFrame, mode: str = "INLINE", policy: str = "AUTO") -> Future:
        return self._writer.submit(self._ingest, docs, mode, policy, False)

    def rebuild(self, docs: DataFrame, mode: str = "INLINE", policy: str = "AUTO") -> DataFrame:
        """Replaces everything by these documents; ids have to be unique, copies are taken as well."""
        if docs.groupBy("id").count().where("count > 1").take(1):
            raise DocumentError("STORAGE_001", "ids are not unique")
        return self._writer.submit(self._ingest, docs, mode, policy, True).result()

    def _ingest(self, docs: DataFrame, mode: str, policy: str, fresh: bool) -> DataFrame:
        try:
            return self._taken_in(docs, mode, policy, fresh)
        except Exception as e:
            self.hooks.fire("FAILED", error=e, step="ingest")
            raise

    def _taken_in(self, docs: DataFrame, mode: str, policy: str, fresh: bool) -> DataFrame:
        if mode not in schema.SOURCE_MODES:
            raise ValueError(mode)
        begun = time.monotonic()
        for c in ("content", "file_path", "md5", "error"):
            if c not in docs.columns:
                docs = docs.withColumn(c, F.lit(None).cast("string"))
        rows = docs.select("id", "title", "content", "file_path", F.coalesce("md5", F.md5("content")).alias("md5"), F.coalesce("error", schema.document_fault(), F.when(is_blank("content"), "no text")).alias("message"))
        rows = stage(ranked(rows, [], ["id"], "ordinal"))
        self.hooks.fire("DOCUMENT_RECEIVED", mode=mode, policy=policy)
        good = rows.where("message is null")
        before = None if fresh else self.table("documents")
        if fresh:
            taken, copies = good, good.limit(0)
        else:
            marked = first_of_copies(good, "md5", ["ordinal"]).join(before.select("md5", F.lit(True).alias("known")).distinct(), "md5", "left")
            marked = stage(marked.withColumn("copy", F.col("copy") | F.coalesce("known", F.lit(False))))
            taken, copies = marked.where("not copy"), marked.where("copy")
            if skipped := copies.count():
                self.hooks.fire("DOCUMENT_SKIPPED", documents=skipped)
        base = 0 if fresh else (before.agg(F.max("ordinal")).first()[0] or 0)
        doc_id = F.concat(F.lit("d-"), F.substring(F.sha2(F.concat_ws("\n", "id", "md5"), 256), 1, 16), F.lit("_"), safe_name("title"))
        taken = stage(taken.select(doc_id.alias("doc_id"), "id", "title", "content", "file_path", "md5", (F.col("ordinal") + base).cast("long").alias("ordinal")))
        cut = stage(chunks(taken, "doc_id", "title", "content", policy, self.settings.threshold, self.settings.prompt_chars))
        self.hooks.fire("DOCUMENT_CHUNKED")
        texts = cut.join(taken.select(F.col("doc_id").alias("document_id"), "content"), "document_id").select("chunk_id", byte_range("content", "source_offset", "source_length").alias("text"))
        self.hooks.fire("COMPREHEND_STARTED")
        started = time.monotonic()
        told = comprehended(texts, "chunk_id", "text", self.provider, self.settings.prompt_chars, self.settings.concurrent)
        known = stage(cut.join(told.withColumnRenamed("chunk", "chunk_id"), "chunk_id"))
        failed = stage(known.where("error is not null").groupBy(F.col("document_id").alias("doc_id")).agg(F.min("error").alias("message")))
        lost_docs = failed.count()
        self.hooks.fire("COMPREHEND_FINISHED", millis=int((time.monotonic() - started) * 1000), failed=lost_docs)
        if lost_docs:
            self.hooks.fire("FAILED", error=DocumentError("DOC_001", f"{lost_docs} documents weren't understood"), step="comprehend", documents=lost_docs)
        known = known.join(failed.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
        taken = stage(taken.join(failed.select("doc_id"), "doc_id", "left_anti"))
        words = F.transform("definitions", lambda d: F.lower(d["keyword"]))
        up = rolled_up(known)
        summed = stage(taken.join(up.withColumnRenamed("document_id", "doc_id"), "doc_id").select("doc_id", "ordinal", "title", "summary", words.alias("keywords"), "entities", "questions", "definitions"))
        chapters = known.select(F.col("document_id").alias("doc_id"), "section_index", "chunk_id", F.col("section_title").alias("title"), "summary", words.alias("keywords"), "entities", "questions")
        new_docs = taken.select("doc_id", "title", "md5", "file_path", F.lit(mode).alias("mode"), "ordinal")
        if not summed.isEmpty() or fresh:
            old = self.tree()
            grown = trees.build(summed, chapters, self.provider) if fresh or old.root is None else trees.attach(old, summed, chapters)
            given = summed.select("doc_id", F.explode("definitions").alias("d")).select("d.*", F.col("doc_id").alias("document_id"), F.lit(1).alias("frequency"))
            added = {
                "documents": new_docs,
                "texts": taken.where(F.lit(mode != "REFERENCE")).select("doc_id", "content"),
                "chunks": known.select(*(c.split()[0] for c in _CHUNKS.split(", "))),
                "definitions": given.select(*(c.split()[0] for c in schema.DEFINITIONS.split(", "))),
            }
            whole = fresh or old.root is None
            part = grown if whole else grown.delta
            tables = {"nodes": part.nodes, "links": part.links, "held": part.chunks, "postings": part.postings().withColumn("pos", F.col("pos").cast("int"))}
            if whole:
                self.store.commit(tables | (added if fresh else {}), {} if fresh else added, root=grown.root)
            else:  # what is written follows the batch, not the base
                self.store.append({n: (t, _KEYED[n]) for n, t in tables.items()} | {n: (t, None) for n, t in added.items()}, root=grown.root)
            self.hooks.fire("TREE_BUILT" if fresh or old.root is None else "TREE_UPDATED")
            self.hooks.fire("COMMITTED", millis=int((time.monotonic() - begun) * 1000))
        ok, none = F.lit(True), F.lit(None).cast("string")
        report = [
            taken.select("id", "title", "doc_id", ok.alias("success"), F.lit(False).alias("skipped"), none.alias("message")),
            copies.select("id", "title", none.alias("doc_id"), ok.alias("success"), ok.alias("skipped"), F.lit("a copy").alias("message")),
            rows.where("message is not null").select("id", "title", none.alias("doc_id"), F.lit(False).alias("success"), F.lit(False).alias("skipped"), "message"),
        ]
        spoiled = marked if not fresh else good
        lost = spoiled.select(doc_id.alias("doc_id"), "id", "title").join(failed, "doc_id").select("id", "title", none.alias("doc_id"), F.lit(False).alias("success"), F.lit(False).alias("skipped"), "message")
        out = report[0]
        for r in (*report[1:], lost):
            out = out.unionByName(r)
        return stage(out)

    # Asking

    def search(self, queries: DataFrame | str) -> DataFrame:
        """(query_id, node_id, chunk_id, document_id, section_title, summary): what is found for each query, without texts.

        queries has query_id and query, or is one query; a blank single query is an error.
        """
        if isinstance(queries, str):
            if not queries.strip():
                raise NavigationError("NAV_007", "a blank query")
            queries = self.spark.createDataFrame([("q", queries)], "query_id string, query string")
        tree = self.tree()
        if tree.root is None:
            raise NavigationError("NAV_001", "there is no tree yet")
        self.hooks.fire("NAVIGATION_STARTED")
        try:
            found, log = navigate(queries, stage(tree.with_lists()), tree.root, self.table("postings"), None, self.provider, self.settings.max_steps, lambda n: self.hooks.fire("NAVIGATION_STEP", step=n))
        except Exception as e:
            self.hooks.fire("FAILED", error=e, step="navigate")
            raise
        self.log = log
        self.hooks.fire("NAVIGATION_FINISHED")
        about = self.table("chunks").select("chunk_id", "document_id", "section_index", "section_title", "summary")
        return found.join(about, "chunk_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))

    def read(self, found: DataFrame) -> DataFrame:
        """found (with chunk_id) and each chunk's text, read only now, from the stored text or from the file referred to.

        A file that is gone leaves a null text.
        """
        self.hooks.fire("CONTENT_READ")
        place = self.table("chunks").select("chunk_id", F.col("document_id").alias("doc_id"), "source_offset", "source_length").join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
        kept = place.join(self.table("texts"), "doc_id")
        loose = place.join(self.table("documents").where("mode = 'REFERENCE'").select("doc_id", "file_path"), "doc_id")
        paths = [r[0] for r in loose.select("file_path").distinct().collect()]  # of what was found, few
        there = [p for p in paths if Files(self.spark, p.rpartition("/")[0]).exists(p.rpartition("/")[2])]
        parts = kept.select("chunk_id", byte_range("content", "source_offset", "source_length").alias("text"))
        if there:
            again = loose.join(read_documents(self.spark, *there).select("file_path", "content"), "file_path")
            parts = parts.unionByName(again.select("chunk_id", byte_range("content", "source_offset", "source_length").alias("text")))
        return found.join(parts, "chunk_id", "left")

    def ask(self, queries: DataFrame) -> DataFrame:
        """(query_id, answer, error, sources): the model's answer from the texts found; without any, an error."""
        found = stage(self.read(self.search(queries)))
        context = answer_context(found.select("query_id", "chunk_id", F.coalesce("document_id", F.lit("")).alias("document_id"), F.coalesce("section_index", F.lit(0)).alias("section_index")), found.select("chunk_id", "text", "summary").dropDuplicates(["chunk_id"]), ["document_id", "section_index"])
        said = answered(queries.join(context, "query_id"), self.provider)
        sources = found.groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("sources"))
        out = queries.select("query_id").join(said.select("query_id", "answer", "error"), "query_id", "left").join(sources, "query_id", "left")
        return out.withColumn("error", F.when(F.col("sources").isNull(), "nothing found").otherwise(F.col("error")))

    def delete_documents(self, ids: list[str]) -> None:
        """Removes the stored copies of documents' texts; files they came from stay, and so do their chunks, whose text is then null."""
        self.store.commit({"texts": self.table("texts").where(~F.col("doc_id").isin(ids))}, **self.store.facts())

    def clear(self) -> None:
        """Forgets all documents and answers."""
        self._writer.submit(self.store.clear).result()
        if self.cache:
            self.cache.store.clear()

    def healthy(self) -> bool:
        """Whether the committed tables can be found."""
        try:
            self.store.pointer()
            return True
        except StorageError:
            return False

    def usage(self) -> dict[str, int]:
        """Bytes of the files of every table."""
        return self.store.usage()

    def chunk_exists(self, chunk_id: str) -> bool:
        return bool(self.table("chunks").where(F.col("chunk_id") == chunk_id).take(1))

    def chunk_ids(self) -> DataFrame:
        return self.table("chunks").select("chunk_id").distinct()

    def contains_value(self, name: str, column: str, value) -> bool:
        """Whether any row of a table has the value; it is searched whole."""
        return bool(self.table(name).where(F.col(column).eqNullSafe(F.lit(value))).take(1))

    def copy_sources(self, folder: str) -> DataFrame:
        """Writes every stored text to a file of its document's name below a folder, byte by byte as it was read; (doc_id, path, bytes)."""
        kept = self.table("texts").join(self.table("documents").select("doc_id", "title"), "doc_id").select("doc_id", "content")
        return stage(kept.mapInArrow(_copier(folder), "doc_id string, path string, bytes long"))

    def remove_orphans(self) -> list[str]:
        return self.store.clean()

    def statistics(self) -> dict[str, int]:
        """Rows of the tables, and distinct keywords."""
        counts = {t: self.table(t).count() for t in ("documents", "chunks", "nodes")}
        words = self.table("postings").select("keyword").union(self.table("definitions").select(normalized("keyword"))).where("keyword is not null")
        return counts | {"keywords": words.distinct().count()}

    def close(self) -> None:
        """Waits for what is being written; later writes fail."""
        self._writer.shutdown(wait=True)


def _copier(folder: str):
    """A sink for copies, on a file system that workers reach by a path."""
    local = folder.removeprefix("file://")

    def copy(batches):
        import os

        import pyarrow as pa

        os.makedirs(local, exist_ok=True)
        for batch in batches:
            paths, sizes = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist()):
                data, path = (text or "").encode("utf-8", "replace"), os.path.join(local, doc)
                with open(f"{path}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.part", path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.record_batch([batch.column("doc_id"), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "path", "bytes"])

    return copy


class Engine:
    """Named knowledge bases below a folder; one is current, 'default' is made at need."""

    def __init__(self, spark: SparkSession, root: str, provider: Provider | None = None, settings: Settings | None = None, hooks: Hooks | None = None) -> None:
        self.spark, self._files, self._make = spark, Files(spark, root), (provider, settings, hooks)
        self._open: dict[str, KnowledgeBase] = {}
        if not self.exists("default"):
            self.create("default")
        self.current = "default"

    @staticmethod
    def _checked(name: str) -> str:
        if not re.match(NAME_PATTERN, name or "") or len(name) > NAME_LENGTH:
            raise StorageError("STORAGE_002", f"no name for a knowledge base: {name!r}")
        return name

    def names(self) -> list[str]:
        """Folders with a proper name that are marked as knowledge bases, by name."""
        return [n for n in self._files.names() if re.match(NAME_PATTERN, n) and len(n) <= NAME_LENGTH and self.exists(n)]

    def exists(self, name: str) -> bool:
        return self._files.exists(self._checked(name), MARKER)

    def create(self, name: str) -> KnowledgeBase:
        if self.exists(name):
            raise StorageError("STORAGE_003", f"{name} is there already")
        Files(self.spark, f"{self._files.root}/{name}").replace("", MARKER)
        return self.get(name)

    def get(self, name: str | None = None) -> KnowledgeBase:
        name = self._checked(name or self.current)
        if not self.exists(name):
            raise StorageError("STORAGE_006", f"there is no {name}")
        if name not in self._open:
            self._open[name] = KnowledgeBase(self.spark, f"{self._files.root}/{name}", *self._make)
        return self._open[name]

    def switch(self, name: str) -> KnowledgeBase:
        base = self.get(name)
        self.current = name
        return base

    def delete(self, name: str) -> None:
        """Deletes a knowledge base with all its data; 'default' can't be deleted."""
        if name == "default":
            raise StorageError("STORAGE_007", "default can't be deleted")
        self.get(name).close()
        del self._open[name]
        self._files.delete(name)
        if self.current == name:
            self.current = "default"

    def search(self, queries: DataFrame | str, base: str | None = None) -> DataFrame:
        return self.get(base).search(queries)

    def cache(self, base: str | None = None) -> ResponseCache | None:
        """The answers kept for a base: statistics, sizes, clear, warm, reconfigure, log."""
        return self.get(base).cache

    def close(self) -> None:
        for base in self._open.values():
            base.close()
