"""Queries of the training-text operators, over whole tables, with SQL where SQL is quick enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelattice.llm import history, leakage, mojibake, neardup, packing, repetition, splitting, terms
from tomelattice.llm.setsim import few


def _records(spark: SparkSession, d: str) -> DataFrame:
    kb, files, pending = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("kb_documents", "text_files", "pending_documents"))
    parts = (("kb_documents", kb, "id", "content"), ("text_files", files, "file_path", "content"), ("pending_documents", pending, "doc_id", "title"))
    a, b, c = (t.select(F.lit(src).alias("src"), F.col(i).alias("ref"), F.col(x).alias("text")) for src, t, i, x in parts)
    return a.unionByName(b).unionByName(c)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that were decoded with a wrong charset, at least in part."""
    return mojibake.garbled(_records(spark, d)).select("src", F.col("ref").alias("rec_id")).distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """The same records with the pairs of charsets found in them and the text restored as far as it can be."""
    return mojibake.garbled(_records(spark, d)).select("src", F.col("ref").alias("rec_id"), F.array_distinct("spans.pair").alias("pairs"), "restored", "whole")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all sections longer than 2000 bytes."""
    docs, refs = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("kb_documents", "section_refs"))
    pieces = splitting.oversized(docs.select(F.col("id").alias("doc"), F.col("content").alias("text")), refs.select(F.col("doc_id").alias("doc"), F.col("section_index").alias("section"), F.col("byte_offset").alias("begin")))
    return pieces.withColumnsRenamed({"doc": "doc_id", "section": "section_index"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Sections that had to be cut."""
    return p3_pieces(spark, d).where("piece > 0").select("doc_id", "section_index").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pending documents that repeat an earlier document, with the earliest such; every batch is checked when it comes."""
    kb, pending, files = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("kb_documents", "pending_documents", "text_files"))
    last = F.lit(2**31 - 1)
    accepted = history.History(spark, 0.6)
    accepted.accept(
        kb.select(F.col("id").alias("ref"), F.struct(F.coalesce("batch_no", last).alias("batch"), F.col("id").alias("id")).alias("ord"), "md5", F.concat(F.lit("kb:"), "id").alias("loc")),
        kb.select(F.concat(F.lit("kb:"), "id").alias("loc"), F.col("content").alias("text")),
        probing=False,
    )
    docs = pending.select(F.coalesce("batch_no", last).alias("batch"), F.col("doc_id").alias("ref"), F.struct(F.coalesce("ordinal", last).alias("batch"), F.lit("").alias("id")).alias("ord"), "md5", F.concat(F.lit("file:"), "batch", F.lit(":"), "original_path").alias("loc"), "original_path")
    found = None
    for number, rows in docs.groupBy("batch").count().sort("batch").collect():  # a row for each batch
        batch = docs.where(F.col("batch") == number)
        # The batch's names are sent to the files: to shuffle all contents anew for every batch would be the largest of its shuffles.
        named = files.join(few(batch.select(F.col("original_path").alias("file_path")), rows), "file_path", "left_semi")
        texts = named.select(F.concat(F.lit(f"file:{number}:"), "file_path").alias("loc"), F.col("content").alias("text"))
        accepted.accept(batch.select("ref", "ord", "md5", "loc"), texts)
        matches = accepted.check()
        found = matches if found is None else found.unionByName(matches)
    if found is None:
        found = spark.createDataFrame([], "ref string, match string")
    return found.select(F.col("ref").alias("doc_id"), F.col("match").alias("match_id"))


def _occurrences(spark: SparkSession, d: str) -> DataFrame:
    words, postings = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("keyword_definitions", "postings"))
    return words.select(F.lit("keyword_definitions").alias("src"), F.col("keyword").alias("term"), F.col("document_id").alias("record"), F.col("frequency").alias("n")).unionByName(
        postings.select(F.lit("postings").alias("src"), F.col("keyword").alias("term"), F.col("node_id").alias("record"), F.lit(1).alias("n"))
    )


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every keyword with its number of records, total and mark."""
    return terms.frequencies(_occurrences(spark, d)).select("src", F.col("term").alias("keyword"), "records", "total", "mark")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Keywords that are too common or too rare."""
    return p5_frequencies(spark, d).where("mark is not null").select("src", "keyword", "mark")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of kb_documents whose contents have similarity 0.6 or more."""
    classes, pairs = neardup.near_duplicates(spark.read.parquet(f"{d}/kb_documents.parquet"), "id", "content", 0.6)
    return neardup.expand(classes, pairs)


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of equal texts and the number of similar classes, at the default threshold."""
    classes, pairs = neardup.near_duplicates(spark.read.parquet(f"{d}/kb_documents.parquet"), "id", "content")
    links = pairs.select(F.col("cls_a").alias("cls")).union(pairs.select("cls_b")).groupBy("cls").agg(F.count("*").alias("links"))
    return classes.join(links, "cls", "left").select(F.col("ref").alias("id"), F.col("cls").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or part of one above 2048 tokens, with its container of 2048 tokens."""
    return packing.pack(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a run of 20 or more tokens of an evaluation item."""
    return p8_report(spark, d).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items by document, with how much of the item is there."""
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "eval_items"))
    return leakage.leaked(docs, "doc_id", "text", items, "item_id", "item_text").withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat themselves: anomalous for the forest, then checked by the exact share."""
    rows = repetition.repetition(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
    return rows.where(F.col("anomalous") & (F.col("share") >= repetition.REPEATED)).select(F.col("ref").alias("doc_id")).distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every document's statistics of repetition and its score."""
    return repetition.repetition(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").withColumnRenamed("ref", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_restored, p3_found, p3_pieces, p4_found, p5_found, p5_frequencies, p6_found, p6_groups, p7_containers, p8_found, p8_report, p9_found, p9_shares)}


_P3 = """
WITH refs AS (SELECT doc_id, section_index, min(byte_offset) AS a FROM section_refs GROUP BY ALL),
ends AS (
  SELECT doc_id, section_index, a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY section_index), strlen(content)) AS b
  FROM refs JOIN kb_documents ON id = doc_id WHERE content IS NOT NULL
)
SELECT doc_id, section_index FROM ends WHERE b - a > 2000
"""
_P5 = r"""
WITH rows AS (
  SELECT 'keyword_definitions' AS src, keyword, document_id AS record, frequency AS n FROM keyword_definitions
  UNION ALL SELECT 'postings', keyword, node_id, 1 FROM postings
), clean AS (
  SELECT src, lower(regexp_replace(keyword, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS keyword, nullif(record, '') AS record, greatest(coalesce(n, 1), 1) AS n
  FROM rows WHERE keyword IS NOT NULL
), best AS (SELECT src, keyword, record, max(n) AS n FROM clean GROUP BY ALL),
counted AS (SELECT src, keyword, count(record) AS records, cast(coalesce(sum(n) FILTER (record IS NOT NULL), 0) AS BIGINT) AS total FROM best GROUP BY ALL),
sizes AS (SELECT src, count(DISTINCT record) AS size FROM clean GROUP BY ALL)
SELECT src, keyword, records, total, CASE WHEN records > 0.05 * size THEN 'common' WHEN records BETWEEN 1 AND 2 AND total <= 5 THEN 'rare' END AS mark
FROM counted JOIN sizes USING (src)
"""


# Token lists.  The tables' letters are composed, so that NFC and the ASCII forms of full-width characters are all that NFKC does to them.
_WIDE = "".join(chr(c) for c in range(0xFF10, 0xFF1A)) + "".join(chr(c) for c in range(0xFF21, 0xFF3B)) + "".join(chr(c) for c in range(0xFF41, 0xFF5B))
_TOKENS = r"regexp_extract_all(regexp_replace(lower(translate(nfc_normalize({}), '" + _WIDE + r"', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"
_SHINGLES = """
runs AS (SELECT ref, i, n, list(t) OVER (PARTITION BY ref ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS r FROM (SELECT ref, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM tokens WHERE len(w) >= 20)),
shingles AS MATERIALIZED (SELECT DISTINCT ref, hash(r) AS s FROM runs WHERE i <= n - 4),
sizes AS MATERIALIZED (SELECT ref, count(*) AS n FROM shingles GROUP BY ref)
"""
_P4 = f"""
WITH docs AS MATERIALIZED (
  SELECT ref, md5, text, row_number() OVER (ORDER BY kind, batch_no NULLS LAST, ordinal NULLS LAST, tie) AS place, kind FROM (
    SELECT id AS ref, 0 AS kind, batch_no, 0 AS ordinal, id AS tie, md5, content AS text FROM kb_documents
    UNION ALL SELECT doc_id, 1, batch_no, ordinal, '', md5, content FROM pending_documents LEFT JOIN text_files ON file_path = original_path)
),
tokens AS MATERIALIZED (SELECT ref, {_TOKENS.format("text")} AS w FROM docs WHERE text IS NOT NULL),
{_SHINGLES},
sums AS MATERIALIZED (SELECT ref, place, kind, lower(regexp_replace(md5, '^\\s+|\\s+$', '', 'g')) AS md5 FROM docs LEFT JOIN tokens USING (ref) WHERE text IS NULL OR len(w) >= 20),
by_md5 AS (SELECT b.ref, a.ref AS other, a.place FROM sums b JOIN sums a USING (md5) WHERE b.kind = 1 AND a.place < b.place AND regexp_full_match(md5, '[0-9a-f]{{32}}')),
common AS (SELECT x.ref AS ref, y.ref AS other, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.ref IN (SELECT ref FROM docs WHERE kind = 1) AND x.ref <> y.ref GROUP BY ALL),
by_text AS (SELECT c.ref, other, b.place FROM common c JOIN sizes p ON p.ref = c.ref JOIN sizes q ON q.ref = other JOIN docs a ON a.ref = c.ref JOIN docs b ON b.ref = other WHERE b.place < a.place AND c.c >= 0.6 * (p.n + q.n - c.c) - 1e-9)
SELECT ref AS doc_id, arg_min(other, place) AS match_id FROM (FROM by_md5 UNION ALL FROM by_text) GROUP BY ref
"""
_P6 = f"""
WITH tokens AS MATERIALIZED (SELECT id AS ref, {_TOKENS.format("content")} AS w FROM kb_documents WHERE content IS NOT NULL),
{_SHINGLES},
common AS (SELECT x.ref AS a, y.ref AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.ref < y.ref GROUP BY ALL)
SELECT a AS id_a, b AS id_b FROM common JOIN sizes p ON p.ref = a JOIN sizes q ON q.ref = b WHERE c >= 0.6 * (p.n + q.n - c) - 1e-9
"""
_RUNS = "SELECT {0}, hash(r) AS h FROM (SELECT {0}, i, n, list(t) OVER (PARTITION BY {0} ORDER BY i ROWS BETWEEN CURRENT ROW AND {2} FOLLOWING) AS r FROM (SELECT {0}, unnest(w) AS t, generate_subscripts(w, 1) AS i, len(w) AS n FROM {1})) WHERE i <= n - {2}"
_P8 = f"""
WITH items AS (SELECT item_id, {_TOKENS.format("item_text")} AS w FROM eval_items), docs AS (SELECT doc_id, {_TOKENS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
windows AS MATERIALIZED (SELECT DISTINCT item_id, h FROM ({_RUNS.format("item_id", "items", 19)})),
parts AS ({_RUNS.format("doc_id", "docs", 19)})
SELECT DISTINCT doc_id, item_id FROM parts JOIN windows USING (h)
"""
_P9 = f"""
WITH docs AS (SELECT doc_id, {_TOKENS.format("text")} AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id FROM ({_RUNS.format("doc_id", "docs", 7)}) GROUP BY doc_id HAVING count(*) >= 33 AND 1 - count(DISTINCT h) / count(*) >= 0.3 - 1e-9
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _P4,
        "p6_found": _P6,
        "p8_found": _P8,
        "p9_found": _P9,
        "p3_found": _P3,
        "p5_frequencies": _P5,
        "p5_found": f"SELECT src, keyword, mark FROM ({_P5}) WHERE mark IS NOT NULL",
    }
