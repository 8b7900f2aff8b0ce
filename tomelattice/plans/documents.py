"""Queries over documents, their lines and sections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelattice import schema
from tomelattice.functions import text as X
from tomelattice.operators import dedupe, prompts, ranking, sections
from tomelattice.sources import charset
from tomelattice.store import used_bytes


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_md5_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the first one of the same text."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))
    return dedupe.first_of_copies(docs, "md5", ["doc_id"]).select("doc_id", "md5", F.col("first.doc_id").alias("first_id"), F.col("copy").alias("skipped"))


DOC_MD5_DEDUP = """
SELECT doc_id, md5(text) AS md5, CASE WHEN text IS NOT NULL THEN min(doc_id) OVER (PARTITION BY md5(text)) END AS first_id,
  text IS NOT NULL AND min(doc_id) OVER (PARTITION BY md5(text)) < doc_id AS skipped
FROM documents
"""


def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken, skipped and failed, by source."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text", F.md5("text").alias("md5"))
    return dedupe.ingest_report(dedupe.first_of_copies(docs, "md5", ["doc_id"]), "source", F.col("copy"), X.is_blank("text"))


INGEST_REPORT = rf"""
WITH x AS (SELECT coalesce(source, '') AS source, coalesce(skipped, false) AS copy, text IS NULL OR NOT regexp_matches(text, '[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]') AS failed
  FROM documents JOIN ({DOC_MD5_DEDUP}) USING (doc_id))
SELECT source, count(*) FILTER (NOT failed AND NOT copy) AS succeeded, count(*) FILTER (NOT failed AND copy) AS skipped, count(*) FILTER (failed) AS failed, count(*) AS documents
FROM x GROUP BY source
"""


def document_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with documents, by rule, where their title and text are null or empty."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "title", F.col("text").alias("content"), F.lit(None).cast("string").alias("file_path"))
    return schema.valid_documents(docs)[1].select("id", "fault")


DOCUMENT_FAULTS = """
SELECT * FROM (SELECT doc_id::VARCHAR AS id, CASE WHEN coalesce(title, '') = '' THEN 'no title' WHEN coalesce(text, '') = '' THEN 'neither content nor file_path' END AS fault FROM documents) WHERE fault IS NOT NULL
"""


def lines_with_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Every line of documents with its offset."""
    return sections.lines(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id"), "line_no", "start", "chars")


_LINES = """
SELECT {id} AS doc_id, (i - 1)::INT AS line_no, line, length(line)::INT AS chars,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY {id} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM (SELECT {id}, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS i FROM {table} WHERE {text} IS NOT NULL)
"""
LINES_WITH_OFFSETS = f"SELECT doc_id, line_no, start, chars FROM ({_LINES.format(id='doc_id', text='text', table='documents')})"


def headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of kb_documents outside of code fences."""
    return sections.headings(table(spark, d, "kb_documents"), "id", "content").withColumnRenamed("doc", "doc_id")


# In these tables no fence is closed by another mark than its own, so that the parity of fence lines tells.
_HEADED = rf"""
WITH marked AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence FROM ({_LINES.format(id="id", text="content", table="kb_documents")})),
inside AS (SELECT *, fence OR (count(*) FILTER (fence) OVER (PARTITION BY doc_id ORDER BY line_no)) % 2 = 1 AS fenced FROM marked),
bare AS (SELECT *, regexp_replace(regexp_replace(line, '^\x{{FEFF}}', ''), '\r$', '') AS x, regexp_matches(line, '[^\s\x{{A0}}\x{{3000}}]') AS written FROM inside),
parts AS (SELECT *, trim(regexp_extract(x, '^(#{{1,6}})[ \t]+([^\r\x{{85}}\x{{2028}}\x{{2029}}]*?)[ \t]*$', 2)) AS atx, trim(x, chr(32) || chr(9) || chr(13)) AS t FROM bare),
headed AS (SELECT *, CASE WHEN fenced THEN NULL WHEN atx <> '' THEN length(regexp_extract(x, '^(#{{1,6}})', 1))
  WHEN regexp_matches(t, '^第[一二三四五六七八九十百千0-9]+[章节篇部]([ \t][^\r\x{{85}}\x{{2028}}\x{{2029}}]*)?$') THEN 1 WHEN regexp_matches(t, '^[一二三四五六七八九十]+、[^\r\x{{85}}\x{{2028}}\x{{2029}}]*$') THEN 2 END::INT AS level,
  CASE WHEN atx <> '' THEN atx ELSE t END AS title FROM parts)
"""
HEADINGS = f"{_HEADED} SELECT doc_id, line_no, start, level, title FROM headed WHERE level IS NOT NULL"


def sections_by_heading(spark: SparkSession, d: str) -> DataFrame:
    """kb_documents cut at their headings."""
    return sections.sections(table(spark, d, "kb_documents"), "id", "content").withColumnsRenamed({"doc": "doc_id", "end": "stop"})


SECTIONS_BY_HEADING = f"""
{_HEADED}, numbered AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM headed),
grouped AS (SELECT doc_id, part, max(level) AS level, max(title) FILTER (level IS NOT NULL) AS title, min(start) AS start, max(start + chars) AS last, bool_or(written) AS written FROM numbered GROUP BY ALL),
ended AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY part), last) AS stop, max(part) OVER (PARTITION BY doc_id) AS parts FROM grouped)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS section, coalesce(title, CASE WHEN parts = 0 THEN '正文' ELSE '前言' END) AS title, coalesce(level, 0) AS level, start, stop
FROM ended WHERE written
"""


def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    """documents cut into windows of 4000 characters."""
    docs = table(spark, d, "documents").where("text <> ''")
    at = docs.select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(4000))).alias("window_no", "start"))
    return at.select("doc_id", "window_no", "start", F.length(F.substring("text", F.col("start") + 1, F.lit(4000))).alias("chars"), F.md5(F.substring("text", F.col("start") + 1, F.lit(4000))).alias("md5"))


FIXED_WINDOWS = """
SELECT doc_id, (start // 4000)::INT AS window_no, start::INT AS start, length(substr(text, start + 1, 4000))::INT AS chars, md5(substr(text, start + 1, 4000)) AS md5
FROM (SELECT doc_id, text, unnest(range(0, length(text), 4000)) AS start FROM documents WHERE text <> '')
"""


def line_sections(spark: SparkSession, d: str) -> DataFrame:
    """kb_documents cut by headings and, inside sections, by 1000 characters; offsets in bytes."""
    return sections.cut_texts(table(spark, d, "kb_documents"), "id", "content", 1000).withColumnRenamed("doc", "doc_id")


# The next cut of a section is before the first line that ends beyond the limit, counted from the cut before.
_LINE_SECTIONS = f"""
{_HEADED.replace("WITH marked", "WITH RECURSIVE marked", 1)},
whole AS (SELECT doc_id, line_no, start, least(start + chars + 1, length(content)) AS stop, chars < {{limit}} AS short, CASE WHEN chars < {{limit}} THEN level END AS level, headed.title FROM headed JOIN kb_documents ON id = doc_id),
pieces AS (SELECT * FROM whole WHERE short UNION ALL SELECT doc_id, line_no, x, least(x + {{limit}}, stop), short, level, title FROM (SELECT *, unnest(range(start, stop, {{limit}})) AS x FROM whole WHERE NOT short)),
units AS MATERIALIZED (SELECT doc_id, start, stop, level, title, count(level) OVER (PARTITION BY doc_id ORDER BY start, stop) AS sec FROM pieces),
cuts AS (
  SELECT doc_id, sec, min(start) AS cut_at, 1 AS n FROM units GROUP BY doc_id, sec
  UNION ALL SELECT c.doc_id, c.sec, min(u.start), c.n + 1 FROM cuts c JOIN units u ON u.doc_id = c.doc_id AND u.sec = c.sec AND u.start > c.cut_at AND u.stop - c.cut_at > {{limit}} GROUP BY c.doc_id, c.sec, c.n
),
named AS (SELECT doc_id, sec, max(level) AS level, max(title) FILTER (level IS NOT NULL) AS title, max(max(sec)) OVER (PARTITION BY doc_id) AS secs FROM units GROUP BY doc_id, sec),
spans AS (
  SELECT doc_id, CASE WHEN sec = 0 AND secs > 0 AND n = max(n) OVER (PARTITION BY doc_id, sec) THEN '前言' ELSE coalesce(named.title, '正文') || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END END AS title, coalesce(level, 0) AS level, cut_at AS start,
    coalesce(lead(cut_at) OVER (PARTITION BY doc_id ORDER BY cut_at, n), length(content)) AS stop, content
  FROM cuts JOIN named USING (doc_id, sec) JOIN kb_documents ON id = doc_id
),
found AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS part_no, title, level, start, stop, strlen(substr(content, 1, start)) AS byte_offset, strlen(substr(content, start + 1, stop - start)) AS byte_length
  FROM spans WHERE regexp_matches(substr(content, start + 1, stop - start), '[^\\s\\x0B\\x1C-\\x1F\\x{{{{85}}}}\\x{{{{A0}}}}\\x{{{{1680}}}}\\x{{{{2000}}}}-\\x{{{{200A}}}}\\x{{{{2028}}}}\\x{{{{2029}}}}\\x{{{{202F}}}}\\x{{{{205F}}}}\\x{{{{3000}}}}]')
)
"""
LINE_SECTIONS = _LINE_SECTIONS.replace("{limit}", "1000").replace("{{", "{").replace("}}", "}") + 'SELECT doc_id, part_no, title, level, start, stop AS "end", byte_offset, byte_length FROM found'


def prompt_windows(spark: SparkSession, d: str) -> DataFrame:
    """documents cut into windows of 4000 characters, after a line where possible."""
    return sections.cut_texts(table(spark, d, "documents"), "doc_id", "text", sections.PROMPT_CHARS, "prompts").select(F.col("doc").alias("doc_id"), "part_no", "start", "end")


PROMPT_WINDOWS = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, 0 AS start, CAST(0 AS BIGINT) AS "end" FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, "end", CASE WHEN "end" + 4000 >= length(text) THEN length(text) WHEN nl > 0 THEN "end" + 4000 - nl + 1 ELSE "end" + 4000 END
  FROM (SELECT c.doc_id, c."end", text, strpos(reverse(substr(text, c."end" + 2002, 1999)), chr(10)) AS nl FROM cut c JOIN documents d ON d.doc_id = c.doc_id WHERE c."end" < length(text))
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS part_no, start::BIGINT AS start, "end" FROM cut JOIN documents USING (doc_id)
WHERE "end" > 0 AND regexp_matches(substr(text, start + 1, "end" - start), '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')
"""


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of kb_documents: whole, or sections above 2000 characters."""
    return sections.chunks(table(spark, d, "kb_documents"), threshold=2000).drop("document_title")


DOCUMENT_CHUNKS = _LINE_SECTIONS.replace("{limit}", "2000").replace("{{", "{").replace("}}", "}") + r"""
SELECT doc_id || '#' || part_no AS chunk_id, doc_id AS document_id, part_no AS section_index, title AS section_title, level AS heading_level, byte_offset AS source_offset, byte_length AS source_length
FROM found WHERE doc_id IN (SELECT id FROM kb_documents WHERE length(content) > 2000)
UNION ALL
SELECT id || '#0', id, 0, CASE WHEN regexp_matches(coalesce(title, ''), '[^\s\x0B\x{85}\x{A0}\x{3000}]') THEN title ELSE '文档' END, 0, 0, strlen(content)
FROM kb_documents WHERE length(content) <= 2000 AND regexp_matches(content, '[^\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')
"""


def section_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of every section of section_refs, read by offset."""
    refs = table(spark, d, "section_refs").where("byte_length > 0").select("doc_id", "section_index", "byte_offset", "byte_length").distinct()
    docs = table(spark, d, "kb_documents").where("content is not null").select(F.col("id").alias("doc_id"), "content")
    raw = F.encode("content", "utf-8")
    part = F.substring(raw, F.col("byte_offset").cast("int") + 1, F.col("byte_length"))
    return refs.join(docs, "doc_id").select("doc_id", "section_index", "byte_offset", "byte_length", F.md5(F.hex(part)).alias("md5"))


SECTION_BYTES = """
SELECT DISTINCT doc_id, section_index, byte_offset, byte_length, md5(substr(hex(encode(content)), 2 * byte_offset + 1, 2 * byte_length)) AS md5
FROM section_refs JOIN kb_documents ON id = doc_id WHERE byte_length > 0 AND content IS NOT NULL
"""


def orphan_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sums stored with kb_documents that no content has any more."""
    kb = table(spark, d, "kb_documents")
    return dedupe.orphaned_sources(kb.select("id", F.col("md5").alias("source")), kb.select("id", F.md5("content").alias("source")), "id")


ORPHAN_SOURCES = "SELECT DISTINCT md5 AS source FROM kb_documents WHERE md5 IS NOT NULL AND md5 NOT IN (SELECT md5(content) FROM kb_documents WHERE content IS NOT NULL)"


def chunk_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Which sections have a content, and which a source with a length."""
    refs, kb = table(spark, d, "section_refs"), table(spark, d, "kb_documents").select(F.col("id").alias("doc_id"), "content", "file_path")
    rows = refs.join(kb, "doc_id").withColumn("source", F.when(F.col("file_path").isNotNull(), F.struct("file_path"))).withColumnRenamed("byte_length", "source_length")
    return rows.select("doc_id", "section_index", "byte_offset", *(c.alias(n) for n, c in schema.chunk_predicates().items())).distinct()


CHUNK_PREDICATES = """
SELECT DISTINCT doc_id, section_index, byte_offset, coalesce(content <> '', false) AS has_content, file_path IS NOT NULL AND coalesce(byte_length > 0, false) AS has_source
FROM section_refs JOIN kb_documents ON id = doc_id
"""


def node_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Which rows of nodes are leaves, have children and have chunks."""
    rows = table(spark, d, "nodes").withColumnRenamed("node_type", "type")
    return rows.select("node_id", *(c.alias(n) for n, c in schema.node_predicates().items()))


NODE_PREDICATES = "SELECT node_id, node_type = 'LEAF' AS is_leaf, coalesce(len(children_ids), 0) > 0 AS has_children, coalesce(len(chunk_ids), 0) > 0 AS has_chunks FROM nodes"


def edit_similarities(spark: SparkSession, d: str) -> DataFrame:
    """How alike every part's name and kind are as prompts."""
    rows = table(spark, d, "part")
    return rows.select("p_partkey", F.round(X.similarity(X.prompt_normalized("p_name"), X.prompt_normalized("p_type")), 9).alias("similarity"))


EDIT_SIMILARITIES = "SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)), 9) AS similarity FROM part"


def charsets(spark: SparkSession, d: str) -> DataFrame:
    """text_files as bytes, half of them UTF-8 and half UTF-16 with a mark, and what is found and read from them."""
    rows = table(spark, d, "text_files").where("content is not null")
    raw = F.when(F.length("content") % 2 == 0, F.encode("content", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode("content", "UTF-16BE")))
    each = rows.select("file_path", charset.decoded(raw).alias("x"), charset.detected(raw).alias("detected"))
    return each.select("file_path", "detected", F.col("x.charset").alias("charset"), F.md5("x.text").alias("md5"))


CHARSETS = """
SELECT file_path, name AS detected, name AS charset, md5(CASE WHEN name = 'UTF-8' THEN content ELSE chr(65279) || content END) AS md5
FROM (SELECT *, CASE WHEN length(content) % 2 = 0 THEN 'UTF-8' ELSE 'UTF-16BE' END AS name FROM text_files WHERE content IS NOT NULL)
"""


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Base names, safe names and budgets of kb_documents."""
    rows = table(spark, d, "kb_documents")
    return rows.select("id", X.file_name("file_path").alias("base"), X.safe_name("title").alias("safe"), X.truncated("title", 20).alias("short"), X.valid_base_name("kb_name").alias("valid"), F.length(X.summary_budget("content")).alias("budget"), X.leaf_name(F.lit(None).cast("string"), F.lit(" "), "title", "id").alias("leaf"))


FILE_NAMES = r"""
SELECT id, string_split(file_path, '/')[-1] AS base, CASE WHEN trim(title) = '' THEN 'document' ELSE left(regexp_replace(title, '[\\/:*?"<>|]', '_', 'g'), 80) END AS safe, left(title, 20) AS short,
  regexp_matches(kb_name, '^[a-zA-Z0-9_-]+$') AND length(kb_name) <= 50 AS valid, (CASE WHEN length(content) > 20000 THEN 20005 ELSE length(content) END)::INT AS budget,
  CASE WHEN trim(title) = '' THEN id ELSE left(title, 50) END AS leaf
FROM kb_documents
"""


def rollup_doc_summary(spark: SparkSession, d: str) -> DataFrame:
    """Section titles of every document put together, as summaries are."""
    from tomelattice.operators.comprehend import DEFINITION, rolled_up

    refs = table(spark, d, "section_refs").groupBy("doc_id", "section_index").agg(F.min(F.coalesce("title", F.lit(""))).alias("title"))
    rows = refs.select(F.col("doc_id").alias("document_id"), "section_index", F.col("title").alias("section_title"), F.col("title").alias("summary"), F.lit(None).cast(f"array<{DEFINITION}>").alias("definitions"), F.array(F.left("title", F.lit(2))).alias("entities"), F.lit(None).cast("array<string>").alias("questions"))
    return rolled_up(rows).select(F.col("document_id").alias("doc_id"), "sections", "summary", F.size("entities").alias("entities"))


ROLLUP_DOC_SUMMARY = """
WITH s AS (SELECT doc_id, section_index, min(coalesce(title, '')) AS title FROM section_refs GROUP BY ALL)
SELECT doc_id, count(*)::INT AS sections, CASE WHEN count(*) = 1 THEN min(title) ELSE left(string_agg(title || '：' || title || '；', '' ORDER BY section_index), 1000) END AS summary, count(DISTINCT left(title, 2))::INT AS entities
FROM s GROUP BY doc_id
"""


def default_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every source in three contiguous parts."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"))
    return ranking.equal_parts(docs, ["source"], ["doc_id"], 3).select("doc_id", "source", "part")


DEFAULT_CLUSTERS = "SELECT doc_id, coalesce(source, '') AS source, ntile(3) OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id)::INT AS part FROM documents"


def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Documents in shards of 100 consecutive ids."""
    return ranking.sharded(table(spark, d, "documents").select("doc_id"), ["doc_id"], 100)


SHARD_ASSIGNMENT = "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS shard FROM documents"


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that nodes list but no section is, and sections that no node lists."""
    nodes, refs = table(spark, d, "nodes"), table(spark, d, "section_refs")
    listed = nodes.select(F.explode("chunk_ids").alias("chunk_id")).where("chunk_id <> ''").distinct()
    there = refs.select(F.concat_ws("#", "doc_id", F.col("section_index").cast("string")).alias("chunk_id")).distinct()
    return dedupe.orphans(listed, there, "chunk_id").select("chunk_id", F.lit("no section").alias("kind")).union(dedupe.orphans(there, listed, "chunk_id").select("chunk_id", F.lit("no node")))


ORPHANS = """
WITH listed AS (SELECT DISTINCT chunk_id FROM (SELECT unnest(chunk_ids) AS chunk_id FROM nodes) WHERE chunk_id <> ''),
there AS (SELECT DISTINCT doc_id || '#' || section_index AS chunk_id FROM section_refs)
SELECT chunk_id, 'no section' AS kind FROM listed WHERE chunk_id NOT IN (SELECT chunk_id FROM there)
UNION ALL SELECT chunk_id, 'no node' FROM there WHERE chunk_id NOT IN (SELECT chunk_id FROM listed)
"""


def overlay(spark: SparkSession, d: str) -> DataFrame:
    """Titles by path: those of pending documents over those of text files already known by the same path."""
    files = table(spark, d, "text_files").select("file_path", F.lit("file").alias("origin"))
    pending = table(spark, d, "pending_documents").groupBy(F.col("original_path").alias("file_path")).agg(F.lit("pending").alias("origin"))
    return dedupe.overlaid(files, pending, "file_path")


OVERLAY = """
SELECT file_path, 'file' AS origin FROM text_files WHERE file_path NOT IN (SELECT original_path FROM pending_documents)
UNION ALL SELECT DISTINCT original_path, 'pending' FROM pending_documents
"""


def storage_usage(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of text by knowledge base."""
    return used_bytes(table(spark, d, "kb_documents"), "content", "kb_name")


STORAGE_USAGE = "SELECT kb_name, count(*) AS rows, coalesce(sum(strlen(content)), 0)::BIGINT AS bytes FROM kb_documents GROUP BY kb_name"


def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    """Calls and tokens by language, a call for every document."""
    docs = table(spark, d, "documents")
    calls = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.length("text") / 4).alias("input_tokens"), F.floor(F.length("title") / 4).alias("output_tokens"), F.length("title").alias("duration_ms"))
    return prompts.usage(calls, "lang").withColumn("average_ms", F.round("average_ms", 6))


USAGE_STATS = """
SELECT lang, count(*) AS calls, coalesce(sum(i), 0)::BIGINT AS input_tokens, coalesce(sum(o), 0)::BIGINT AS output_tokens, (coalesce(sum(i), 0) + coalesce(sum(o), 0))::BIGINT AS total_tokens, round(coalesce(avg(t), 0), 6) AS average_ms
FROM (SELECT coalesce(lang, '') AS lang, length(text) // 4 AS i, length(title) // 4 AS o, length(title) AS t FROM documents) GROUP BY lang
"""


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys of documents' titles as prompts."""
    return table(spark, d, "documents").select("doc_id", X.cache_key(F.lit("EXTRACT_KEYWORDS"), "title").alias("cache_key"), X.prompt_normalized("title").alias("prompt"))


CACHE_KEYS = r"SELECT doc_id, 'extract_keywords:' || coalesce(md5(title), 'null') AS cache_key, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS prompt FROM documents"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("doc_id") % 3 == 0, "EXTRACT_KEYWORDS").when(F.col("doc_id") % 3 == 1, "GENERATE_SUMMARY").otherwise("ANSWER_QUESTION")
    return table(spark, d, "documents").select("doc_id", kinds.alias("request_type"), F.col("text").alias("prompt"), (F.col("doc_id") % 7 != 0).alias("success"))


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """Hits and misses when documents' texts are asked about in the order of ids."""
    return prompts.cache_statistics(prompts.replayed(_requests(spark, d), "doc_id")).withColumn("hit_rate", F.round("hit_rate", 9))


CACHE_STATS = """
WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'EXTRACT_KEYWORDS' WHEN 1 THEN 'GENERATE_SUMMARY' ELSE 'ANSWER_QUESTION' END AS request_type, coalesce(md5(text), 'null') AS k, doc_id % 7 <> 0 AS success FROM documents),
f AS (SELECT request_type, k, min(doc_id) AS first FROM r WHERE success GROUP BY ALL),
h AS (SELECT r.*, coalesce(r.doc_id > f.first, false) AND request_type <> 'ANSWER_QUESTION' AS hit FROM r LEFT JOIN f USING (request_type, k))
SELECT request_type, count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 9) AS hit_rate, count(DISTINCT k) FILTER (success) AS entries FROM h GROUP BY request_type
"""


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that a cache of the accepted documents' contents has no answer for."""
    asked = table(spark, d, "text_files").select(F.lit("EXTRACT_KEYWORDS").alias("request_type"), F.col("content").alias("prompt"))
    known = prompts.with_keys(table(spark, d, "kb_documents").where("content is not null").select(F.lit("EXTRACT_KEYWORDS").alias("request_type"), F.col("content").alias("prompt")))
    return prompts.misses(asked, known).select("cache_key", "request_type")


CACHE_MISSES = """
SELECT DISTINCT 'extract_keywords:' || md5(content) AS cache_key, 'EXTRACT_KEYWORDS' AS request_type FROM text_files WHERE md5(content) NOT IN (SELECT md5(content) FROM kb_documents WHERE content IS NOT NULL)
"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    kb, pending = table(spark, d, "kb_documents"), table(spark, d, "pending_documents")
    return kb.select("id", "title").union(pending.select("doc_id", "title"))


def prompt_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of parts that count as the same prompt, one row of each description."""
    names = table(spark, d, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("prompt")).agg(F.min("p_partkey").alias("id"))
    return prompts.alike(names).select("id_a", "id_b", F.round("similarity", 9).alias("similarity"))


# Edit distances of bytes, as SQL has them, are those of characters in ASCII texts.
_ALIKE = r"""
SELECT id, trim(regexp_replace(lower(prompt), '\s+', ' ', 'g')) AS p FROM prompts WHERE prompt IS NOT NULL AND id IS NOT NULL),
texts AS MATERIALIZED (SELECT p, length(p) AS n, min(id) AS first FROM rows GROUP BY p),
near AS (SELECT a.p, b.p AS q, 1 - levenshtein(a.p, b.p) / greatest(a.n, b.n) AS similarity FROM texts a JOIN texts b ON a.p < b.p AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) - 1e-9 AND a.n BETWEEN 1 AND 500 AND b.n BETWEEN 1 AND 500),
pairs AS (SELECT x.id AS u, y.id AS v, similarity FROM near JOIN rows x ON x.p = near.p JOIN rows y ON y.p = near.q WHERE similarity >= 0.85 - 1e-12 UNION ALL SELECT first, id, 1.0 FROM rows JOIN texts USING (p) WHERE id <> first)
SELECT least(u, v) AS id_a, greatest(u, v) AS id_b, round(similarity, 9) AS similarity FROM pairs
"""
PROMPT_SIMILARITY = f"WITH prompts AS (SELECT p_name || ' ' || p_brand || ' ' || p_type AS prompt, min(p_partkey) AS id FROM part GROUP BY ALL), rows AS MATERIALIZED ({_ALIKE}"


def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Titles of accepted and pending documents alike enough to share an answer."""
    return prompts.alike(_titles(spark, d).withColumnRenamed("title", "prompt")).select("id_a", "id_b", F.round("similarity", 9).alias("similarity"))


def rate_limit_replay(spark: SparkSession, d: str) -> DataFrame:
    """Events admitted with five an hour for each kind."""
    return prompts.rate_limited(table(spark, d, "events"), "event_type", "ts", "event_id", 5, 3600.0)


RATE_LIMIT_REPLAY = """
WITH RECURSIVE ev AS MATERIALIZED (SELECT event_type, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
fold AS (
  SELECT event_type, event_id, i, true AS admitted, [t] AS held FROM ev WHERE i = 1
  UNION ALL
  SELECT event_type, event_id, i, len(kept) < 5, CASE WHEN len(kept) < 5 THEN list_append(kept, t) ELSE kept END
  FROM (SELECT e.event_type, e.event_id, e.i, e.t, list_filter(f.held, lambda x: x > e.t - 3600) AS kept FROM fold f JOIN ev e ON e.event_type IS NOT DISTINCT FROM f.event_type AND e.i = f.i + 1)
)
SELECT event_type, event_id, admitted FROM fold
"""


def latest_events(spark: SparkSession, d: str) -> DataFrame:
    """Every user's last event: the last write wins."""
    return dedupe.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


LATEST_EVENTS = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"


QUERIES = {
    f: globals().get(f.__name__.upper())
    for f in (
        doc_md5_dedup, ingest_report, document_faults, lines_with_offsets, headings, sections_by_heading, fixed_windows, line_sections, prompt_windows, document_chunks, section_bytes, orphan_sources, chunk_predicates, node_predicates, edit_similarities, charsets, file_names, rollup_doc_summary, default_clusters,
        shard_assignment, orphans, overlay, storage_usage, usage_stats, cache_keys, cache_stats, cache_misses, prompt_similarity, title_similarity, rate_limit_replay, latest_events,
    )
}
