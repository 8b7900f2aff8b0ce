"""Tables of a knowledge base, and the rules that rows must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomelattice.functions.text import trimmed

DOCUMENTS = "id string, title string, content string, file_path string, md5 string, created_at timestamp, metadata map<string,string>"
CHUNKS = "chunk_id string, document_id string, document_title string, section_index int, section_title string, heading_level int, summary string, md5 string, source struct<type: string, id: string>, source_offset long, source_length long, source_charset string, source_mode string, original_file string, metadata map<string,string>"
CHUNK_CONTENT = "chunk_id string, content string"
NODES = "node_id string, name string, description string, type string, children_ids array<string>, chunk_ids array<string>, key_entities array<string>, keywords array<string>, example_questions array<string>"
POSTINGS = "keyword string, node_id string, pos int"
WEIGHTS = "keyword string, weight double"
DEFINITIONS = "keyword string, definition string, context string, document_id string, frequency int"
LLM_CACHE = "cache_key string, request_type string, prompt string, response string, input_tokens int, output_tokens int"

#: Fixed values.
NODE_TYPES = ("ROOT", "CATEGORY", "DOCUMENT", "LEAF")
SOURCE_MODES = ("COPY", "REFERENCE", "INLINE")
CHUNKING = ("AUTO", "WHOLE", "CHAPTER")


def _given(c: str) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def document_fault(id: str = "id", title: str = "title", content: str = "content", file_path: str = "file_path") -> Column:
    """What is wrong with a document, or null: id and title are needed, and a content or a path."""
    return F.when(~_given(id), "no id").when(~_given(title), "no title").when(~_given(content) & ~_given(file_path), "neither content nor file_path")


def valid_documents(docs: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The rows that meet the rules, with empty metadata and the present time where none is given; and the others with their fault."""
    marked = docs.withColumn("fault", document_fault(**columns))
    good = marked.where("fault is null").drop("fault")
    if "created_at" in docs.columns:
        good = good.withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    if "metadata" in docs.columns:
        good = good.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    return good, marked.where("fault is not null")


def valid_definitions(rows: DataFrame) -> DataFrame:
    """Keyword definitions trimmed, null texts as '', frequencies below 1 as 1; one row for a keyword, in whatever case, and document.

    Of several rows the one with the smallest texts holds, with the largest frequency.  Blank keywords go.
    """
    text = {c: F.coalesce(trimmed(c), F.lit("")) for c in ("keyword", "definition", "context", "document_id")}
    clean = rows.select(*(x.alias(c) for c, x in text.items()), F.greatest(F.coalesce("frequency", F.lit(1)), F.lit(1)).alias("frequency")).where("keyword <> ''")
    first = F.min(F.struct("keyword", "definition", "context")).alias("first")
    return clean.groupBy(F.lower("keyword").alias("normalized"), "document_id").agg(first, F.max("frequency").alias("frequency")).select("normalized", "first.*", "document_id", "frequency")


def chunk_predicates() -> dict[str, Column]:
    """Boolean columns of chunk rows."""
    return {
        "has_content": _given("content"),
        "has_source": F.coalesce(F.col("source").isNotNull() & (F.col("source_length") > 0), F.lit(False)),
    }


def node_predicates() -> dict[str, Column]:
    """Boolean columns of node rows; a leaf is one by its type."""
    return {
        "is_leaf": F.col("type") == "LEAF",
        "has_children": F.coalesce(F.size("children_ids"), F.lit(0)) > 0,
        "has_chunks": F.coalesce(F.size("chunk_ids"), F.lit(0)) > 0,
    }
