"""Queries over keywords, nodes and questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelattice import schema
from tomelattice.functions import parsing
from tomelattice.model.provider import OfflineProvider
from tomelattice.operators import index, navigate as nav
from tomelattice.operators import tree as trees
from tomelattice.operators.ranking import ranked
from tomelattice.plans.documents import table
from tomelattice.session import shared_dir, stage
from tomelattice.streaming.ingest import distinct_stream, table_stream

_TERM = r"[a-zà-ÿ][a-zà-ÿ0-9]+|[\x{4e00}-\x{9fff}]{2}"


def keyword_definitions_clean(spark: SparkSession, d: str) -> DataFrame:
    """Keyword definitions trimmed and defaulted, one for a keyword and document."""
    return schema.valid_definitions(table(spark, d, "keyword_definitions"))


_TRIM = r"regexp_replace({}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
KEYWORD_DEFINITIONS_CLEAN = f"""
WITH c AS (SELECT coalesce({_TRIM.format("keyword")}, '') AS keyword, coalesce({_TRIM.format("definition")}, '') AS definition, coalesce({_TRIM.format("context")}, '') AS context, coalesce({_TRIM.format("document_id")}, '') AS document_id, greatest(coalesce(frequency, 1), 1) AS frequency FROM keyword_definitions)
, f AS (SELECT lower(keyword) AS normalized, document_id, min(row(keyword, definition, context)) AS first, max(frequency)::INT AS frequency FROM c WHERE keyword <> '' GROUP BY ALL)
SELECT normalized, first[1] AS keyword, first[2] AS definition, first[3] AS context, document_id, frequency FROM f
"""


def doc_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The eight most frequent terms of every document."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").where("text is not null")
    terms = docs.select("doc_id", F.explode(F.expr(rf"regexp_extract_all(lower(text), r'({_TERM})', 1)")).alias("term"))
    counts = terms.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where("rank <= 8")


DOC_KEYWORDS = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '({_TERM})', 1)) AS term FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, term, n, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(term)))::INT AS rank FROM c QUALIFY rank <= 8
"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(table(spark, d, "postings"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return index.weights(table(spark, d, "keyword_definitions").select("keyword", F.greatest(F.coalesce("frequency", F.lit(1)), F.lit(1)).alias("weight")))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """nodes with one row for each, its lists those of all its rows; the first row by text gives the rest."""
    rows = table(spark, d, "nodes").where("node_id is not null")
    some = F.min(F.struct("node_type", F.coalesce("node_name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description"))).alias("s")
    flat = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))), lambda x: x != ""))).alias(c)
    grouped = rows.groupBy("node_id").agg(some, *(flat(c) for c in ("children_ids", "chunk_ids", "key_entities", "keywords")))
    return grouped.select("node_id", "s.name", "s.description", F.col("s.node_type").alias("type"), "children_ids", "chunk_ids", "key_entities", "keywords")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))


def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Every keyword's distinct nodes with their first place and the keyword's weight."""
    return index.weighted(_entries(spark, d), _weights(spark, d))


_BASE = rf"""
entries AS (SELECT lower({_TRIM.format("keyword")}) AS keyword, node_id, min(pos) AS pos FROM postings WHERE node_id IS NOT NULL GROUP BY ALL HAVING keyword <> ''),
weights AS (SELECT lower({_TRIM.format("keyword")}) AS keyword, max(greatest(coalesce(frequency, 1), 1))::DOUBLE AS weight FROM keyword_definitions GROUP BY ALL)
"""
INVERTED_INDEX = f"WITH {_BASE} SELECT keyword, node_id, pos, coalesce(weight, 1.0) AS weight FROM entries LEFT JOIN weights USING (keyword)"


def total_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Distinct keywords of postings and definitions."""
    return index.keyword_union(table(spark, d, "postings"), table(spark, d, "keyword_definitions")).agg(F.count("*").alias("keywords"))


TOTAL_KEYWORDS = f"SELECT count(DISTINCT k) AS keywords FROM (SELECT lower({_TRIM.format('keyword')}) AS k FROM postings UNION ALL SELECT lower({_TRIM.format('keyword')}) FROM keyword_definitions) WHERE k <> ''"


def candidates_exact(spark: SparkSession, d: str) -> DataFrame:
    """Scores of nodes for the words of every question."""
    entries = _entries(spark, d)
    return index.scores(index.matches_exact(_questions(spark, d), entries), entries, _weights(spark, d))


_WORDS = rf"""{_BASE}, words AS (SELECT query_id, keyword, count(*) AS times FROM (
  SELECT item_id AS query_id, unnest(regexp_split_to_array(lower({_TRIM.format("question")}), '\s+')) AS keyword FROM eval_items) WHERE keyword <> '' GROUP BY ALL),
exact AS (SELECT query_id, keyword, times FROM words WHERE keyword IN (SELECT keyword FROM entries))"""
_SCORE = "SELECT query_id, node_id, sum(times * coalesce(weight, 1.0)) AS score FROM {} JOIN entries USING (keyword) LEFT JOIN weights USING (keyword) GROUP BY ALL"
CANDIDATES_EXACT = f"WITH {_WORDS} {_SCORE.format('exact')}"


def containment_only(spark: SparkSession, d: str) -> DataFrame:
    """Keywords found anywhere in a question."""
    return index.matches_contained(_questions(spark, d), _entries(spark, d)).select("query_id", "keyword")


_CONTAINED = f"""{_WORDS}, keys AS (SELECT DISTINCT keyword FROM entries WHERE length(keyword) >= 2),
contained AS (SELECT item_id AS query_id, keyword, 1 AS times FROM eval_items JOIN keys ON contains(lower({_TRIM.format("question")}), keyword))"""
CONTAINMENT_ONLY = f"WITH {_CONTAINED} SELECT query_id, keyword FROM contained"


def search_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three best nodes of every question: by its words or, failing those, by keywords it contains."""
    entries = _entries(spark, d)
    scored = index.scores(index.matches(_questions(spark, d), entries), entries, _weights(spark, d))
    return index.best_nodes(scored, _nodes(spark, d), 3)


_MATCHED = f"{_CONTAINED}, matched AS (SELECT * FROM exact UNION ALL SELECT * FROM contained WHERE query_id NOT IN (SELECT query_id FROM exact)), scored AS ({_SCORE.format('matched')}), kinds AS (SELECT node_id, min(node_type) AS type FROM nodes GROUP BY node_id)"
_TOP = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(type = 'LEAF', false) DESC, node_id)::INT AS rank, node_id, score FROM scored LEFT JOIN kinds USING (node_id) QUALIFY rank <= 3"
SEARCH_TOPK = f"WITH {_MATCHED} {_TOP}"


def start_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Where a walk for every question begins."""
    entries = _entries(spark, d)
    return index.start_nodes(index.scores(index.matches(_questions(spark, d), entries), entries, _weights(spark, d)), _nodes(spark, d))


START_NODES = f"WITH {_MATCHED} SELECT query_id, node_id FROM scored JOIN kinds USING (node_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, type = 'LEAF' DESC, node_id) = 1"


def fallback_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The node that keyword search alone ends at, for every question."""
    entries = _entries(spark, d)
    return index.fallback_nodes(index.scores(index.matches(_questions(spark, d), entries), entries, _weights(spark, d)), _nodes(spark, d))


FALLBACK_NODES = f"""
WITH {_MATCHED}, full_ AS (SELECT DISTINCT node_id FROM (SELECT node_id, unnest(chunk_ids) AS c FROM nodes) WHERE c <> '')
SELECT query_id, arg_min(node_id, rank) AS node_id FROM ({_TOP}) WHERE node_id IN (SELECT node_id FROM full_) GROUP BY query_id
"""


def children(spark: SparkSession, d: str) -> DataFrame:
    """Every node's children that exist, with their first place in its lists."""
    rows = table(spark, d, "nodes").select("node_id", "children_ids")
    return nav.child_links(rows).withColumnsRenamed({"parent": "node_id", "child": "child_id"})


CHILDREN = "SELECT node_id, child_id, min(i - 1)::INT AS pos FROM (SELECT node_id, unnest(children_ids) AS child_id, generate_subscripts(children_ids, 1) AS i FROM nodes) WHERE child_id IN (SELECT node_id FROM nodes) GROUP BY ALL"


def node_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every node's chunks with their section's title; an unknown chunk has an empty one."""
    refs = table(spark, d, "section_refs").groupBy(F.concat_ws("#", "doc_id", F.col("section_index").cast("string")).alias("chunk_id")).agg(F.min("title").alias("summary"))
    return nav.with_chunks(nav.chunk_links(table(spark, d, "nodes")), refs)


NODE_CHUNKS = """
WITH refs AS (SELECT doc_id || '#' || section_index AS chunk_id, min(title) AS summary FROM section_refs GROUP BY ALL),
held AS (SELECT node_id, chunk_id, min(i - 1)::INT AS pos FROM (SELECT node_id, unnest(chunk_ids) AS chunk_id, generate_subscripts(chunk_ids, 1) AS i FROM nodes) WHERE chunk_id <> '' GROUP BY ALL)
SELECT chunk_id, node_id, pos, coalesce(summary, '') AS summary FROM held LEFT JOIN refs USING (chunk_id)
"""


def tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the leaves below every root, or its own if there are none."""
    nodes = _nodes(spark, d)
    starts = nodes.where("type = 'ROOT'").select(F.col("node_id").alias("query_id"), "node_id")
    return nav.leaf_chunks(starts, nodes).select(F.col("query_id").alias("root_id"), "node_id", "chunk_id")


TREE_LEAVES = """
WITH RECURSIVE edges AS (SELECT DISTINCT node_id AS a, b FROM (SELECT node_id, unnest(children_ids) AS b FROM nodes) WHERE b IN (SELECT node_id FROM nodes)),
walk AS (SELECT DISTINCT node_id AS root_id, node_id FROM nodes WHERE node_type = 'ROOT' UNION SELECT root_id, b FROM walk JOIN edges ON a = node_id),
held AS (SELECT DISTINCT node_id, chunk_id FROM (SELECT node_id, unnest(chunk_ids) AS chunk_id FROM nodes) WHERE chunk_id <> ''),
found AS (SELECT DISTINCT root_id, node_id, chunk_id FROM walk JOIN held USING (node_id) WHERE node_id IN (SELECT node_id FROM nodes WHERE node_type = 'LEAF'))
SELECT * FROM found UNION ALL SELECT node_id, node_id, chunk_id FROM held WHERE node_id IN (SELECT node_id FROM nodes WHERE node_type = 'ROOT') AND node_id NOT IN (SELECT root_id FROM found)
"""


def answer_context(spark: SparkSession, d: str) -> DataFrame:
    """For every question the numbered titles of its three best nodes' chunks."""
    nodes = _nodes(spark, d)
    top = search_topk(spark, d)
    refs = table(spark, d, "section_refs").groupBy(F.concat_ws("#", "doc_id", F.col("section_index").cast("string")).alias("chunk_id")).agg(F.min("title").alias("text"))
    found = top.join(nav.chunk_links(nodes), "node_id").select("query_id", "rank", "pos", "chunk_id")
    return nav.answer_context(found, refs.withColumn("summary", F.lit("")), ["rank", "pos", "chunk_id"])


ANSWER_CONTEXT = f"""
WITH {_MATCHED}, top AS ({_TOP}),
held AS (SELECT node_id, chunk_id, row_number() OVER (PARTITION BY node_id ORDER BY chunk_id) AS pos FROM (SELECT DISTINCT node_id, chunk_id FROM (SELECT node_id, unnest(chunk_ids) AS chunk_id FROM nodes) WHERE chunk_id <> '')),
refs AS (SELECT doc_id || '#' || section_index AS chunk_id, min(title) AS text FROM section_refs GROUP BY ALL),
rows AS (SELECT query_id, rank, pos, chunk_id, coalesce(text, '') AS body, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos, chunk_id) AS i FROM top JOIN held USING (node_id) LEFT JOIN refs USING (chunk_id))
SELECT query_id, string_agg('[' || i || '] ' || trim(body), chr(10) || chr(10) ORDER BY i) AS context FROM rows GROUP BY query_id
"""


def best_category(spark: SparkSession, d: str) -> DataFrame:
    """Where every document of keyword_definitions goes, from the first root down, by keywords and entities in common."""
    nodes = _nodes(spark, d)
    words = schema.valid_definitions(table(spark, d, "keyword_definitions")).where("document_id <> ''").groupBy(F.col("document_id").alias("doc_id")).agg(F.collect_set("normalized").alias("keywords"))
    root = nodes.where("type = 'ROOT'").agg(F.min("node_id")).first()[0]
    links = nav.child_links(nodes.select("node_id", "children_ids"))
    return trees.best_categories(words, trees.Tree(nodes, links, links.limit(0), root)).select("doc_id", "node_id")


BEST_CATEGORY = rf"""
WITH RECURSIVE words AS MATERIALIZED (SELECT DISTINCT {_TRIM.format("document_id")} AS doc_id, lower({_TRIM.format("keyword")}) AS k FROM keyword_definitions WHERE {_TRIM.format("document_id")} <> '' AND {_TRIM.format("keyword")} <> ''),
kinds AS (SELECT node_id, min(node_type) AS type FROM nodes GROUP BY node_id),
inner_ AS MATERIALIZED (SELECT node_id FROM kinds WHERE type IN ('CATEGORY', 'ROOT')),
lists AS MATERIALIZED (SELECT node_id, list_sort(list_distinct(flatten(list(coalesce(children_ids, []))))) AS children FROM nodes GROUP BY node_id),
links AS MATERIALIZED (SELECT node_id AS parent, child, pos FROM (SELECT node_id, unnest(list_filter(children, lambda x: x <> '')) AS child, generate_subscripts(list_filter(children, lambda x: x <> ''), 1) AS pos FROM lists) WHERE child IN (FROM inner_)),
kw AS (SELECT DISTINCT node_id, x FROM (SELECT node_id, unnest(keywords) AS x FROM nodes WHERE node_id IN (FROM inner_)) WHERE x <> ''),
en AS (SELECT DISTINCT node_id, x FROM (SELECT node_id, unnest(key_entities) AS x FROM nodes WHERE node_id IN (FROM inner_)) WHERE x <> ''),
each AS MATERIALIZED (SELECT DISTINCT k FROM words),
met AS MATERIALIZED (SELECT x, k FROM (SELECT DISTINCT lower(x) AS x FROM en) JOIN each ON contains(x, k) OR contains(k, x)),
hits AS (SELECT doc_id, node_id, x FROM kw JOIN words ON lower(x) = k UNION ALL SELECT DISTINCT doc_id, node_id, en.x FROM en JOIN met ON met.x = lower(en.x) JOIN words USING (k)),
total AS MATERIALIZED (SELECT doc_id, node_id, count(*) AS score FROM hits GROUP BY ALL),
walk AS (
  SELECT DISTINCT doc_id, (SELECT min(node_id) FROM kinds WHERE type = 'ROOT') AS node_id, 0 AS n FROM words
  UNION ALL
  SELECT doc_id, child, n + 1 FROM (SELECT w.doc_id, l.child, w.n, row_number() OVER (PARTITION BY w.doc_id ORDER BY t.score DESC, l.pos) AS r FROM walk w JOIN links l ON l.parent = w.node_id JOIN total t ON t.doc_id = w.doc_id AND t.node_id = l.child) WHERE r = 1 AND n < 50
)
SELECT doc_id, arg_max(node_id, n) AS node_id FROM walk GROUP BY doc_id
"""


def decision_parse(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of a model, some of them broken, on nodes of five children, one for every event."""
    e = table(spark, d, "events")
    n = F.col("event_id") % 6
    body = (
        F.when(n == 0, F.concat(F.lit('{"action": "select_child", "selectedIndex": '), F.expr("event_id % 7"), F.lit(', "confidence": '), F.when(F.col("value") < 5, "0.2").otherwise("0.9"), F.lit("}")))
        .when(n == 1, F.concat(F.lit('```json\n{"action": "expand_multiple", "selectedIndexes": [1, '), F.expr("event_id % 9"), F.lit(', 1, null], "more": {}}\n```')))
        .when(n == 2, F.lit('I think {"action": "fallback_search"} fits'))
        .when(n == 3, F.lit('{"action": "stop", "reasoning": "enough"}'))
        .when(n == 4, F.concat(F.lit('{"action": "other", "selectedIndex": '), F.expr("event_id % 7"), F.lit("}")))
        .otherwise(F.lit("not JSON"))
    )
    got = e.select("event_id", parsing.decision(body, F.lit(5)).alias("d"))
    return got.select("event_id", "d.move", F.array_join(F.col("d.picks").cast("array<string>"), ",").alias("picks"), "d.error")


DECISION_PARSE = """
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN CASE WHEN value < 5 THEN 'fallback' WHEN event_id % 7 < 5 THEN 'select' ELSE 'stop' END WHEN 1 THEN 'expand' WHEN 2 THEN 'fallback' WHEN 3 THEN 'stop' WHEN 4 THEN CASE WHEN event_id % 7 < 5 THEN 'select' ELSE 'stop' END END AS move,
  CASE event_id % 6 WHEN 0 THEN CASE WHEN value < 5 OR event_id % 7 >= 5 THEN '' ELSE (event_id % 7)::VARCHAR END WHEN 1 THEN CASE WHEN event_id % 9 = 1 OR event_id % 9 >= 5 THEN '1' ELSE '1,' || event_id % 9 END WHEN 4 THEN CASE WHEN event_id % 7 < 5 THEN (event_id % 7)::VARCHAR ELSE '' END ELSE '' END AS picks,
  CASE event_id % 6 WHEN 5 THEN 'NAV_004' END AS error
FROM events
"""


def keyword_lines(spark: SparkSession, d: str) -> DataFrame:
    """Keywords read from the lines of answers, here of evaluation items."""
    return table(spark, d, "eval_items").select("item_id", F.posexplode(parsing.keyword_lines(F.concat(F.lit("- Keywords: A,"), F.translate("question", "，,；;\"'", ""), F.lit("\n\n2. '"), F.translate("answer", "，,；;\"'", "；；；；  "), F.lit("'")))).alias("pos", "keyword"))


KEYWORD_LINES = r"""
WITH given AS (SELECT item_id, '- Keywords: A,' || translate(question, '，,；;"''', '') || chr(10) || chr(10) || '2. ''' || translate(answer, '，,；;"''', '；；；；  ') || '''' AS t FROM eval_items),
lines AS (SELECT item_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT item_id, regexp_split_to_array(t, '\r\n|[\n\x0B\x0C\r\x{85}\x{2028}\x{2029}]') AS l FROM given)),
bare AS (SELECT item_id, i, trim(translate(regexp_replace(regexp_replace(trim(line), '^([-*•]|\d+[.)、])\s*', ''), '^(关键词|keywords?)\s*[:：]\s*', '', 'i'), '"''', '')) AS b FROM lines),
words AS (SELECT item_id, i, list_filter(list_transform(regexp_split_to_array(b, '[,，;；]'), lambda x: lower(trim(x))), lambda x: x <> '') AS w FROM bare),
taken AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM words),
flat AS (SELECT item_id, flatten(list(w ORDER BY i)) AS w FROM taken WHERE before < 8 GROUP BY item_id)
SELECT item_id, unnest(w) AS keyword, generate_subscripts(w, 1)::INT - 1 AS pos FROM flat
"""


def navigate_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every question walked down the tree with the offline model, and how many chunks it finds."""
    nodes = stage(_nodes(spark, d))
    root = nodes.where("type = 'ROOT'").agg(F.min("node_id")).first()[0]
    found, log = nav.navigate(_questions(spark, d), nodes, root or "", _entries(spark, d), _weights(spark, d), OfflineProvider())
    return log.join(found.groupBy("query_id").agg(F.count("*").alias("chunks")), "query_id", "left").fillna(0, ["chunks"])


def walks_by_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Every question walked without a model: where its keywords lead, or the keyword search where that is no end; and how many chunks it finds."""
    nodes = stage(_nodes(spark, d))
    root = nodes.where("type = 'ROOT'").agg(F.min("node_id")).first()[0]
    found, log = nav.navigate(_questions(spark, d), nodes, root or "", _entries(spark, d), _weights(spark, d))
    return log.join(found.groupBy("query_id").agg(F.count("*").alias("chunks")), "query_id", "left").fillna(0, ["chunks"])


WALKS_BY_KEYWORDS = f"""
WITH RECURSIVE {_MATCHED},
edges AS MATERIALIZED (SELECT DISTINCT node_id AS a, b FROM (SELECT node_id, unnest(children_ids) AS b FROM nodes) WHERE b IN (SELECT node_id FROM nodes)),
best AS (SELECT query_id, node_id FROM scored JOIN kinds USING (node_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, type = 'LEAF' DESC, node_id) = 1),
starts AS MATERIALIZED (SELECT item_id AS query_id, coalesce(best.node_id, (SELECT min(node_id) FROM kinds WHERE type = 'ROOT')) AS node_id FROM eval_items LEFT JOIN best ON query_id = item_id),
walks AS MATERIALIZED (SELECT query_id, node_id, node_id IN (SELECT a FROM edges JOIN kinds ON a = node_id WHERE type <> 'LEAF') AS inner_ FROM starts),
full_ AS (SELECT DISTINCT node_id FROM (SELECT node_id, unnest(chunk_ids) AS c FROM nodes) WHERE c <> ''),
back AS (SELECT query_id, arg_min(node_id, rank) AS node_id FROM ({_TOP}) WHERE node_id IN (FROM full_) GROUP BY query_id),
ends AS MATERIALIZED (SELECT query_id, node_id FROM walks WHERE NOT inner_ UNION ALL SELECT query_id, back.node_id FROM walks JOIN back USING (query_id) WHERE inner_),
below AS (SELECT DISTINCT node_id AS top, node_id FROM ends UNION SELECT top, b FROM below JOIN edges ON a = node_id),
held AS MATERIALIZED (SELECT DISTINCT node_id, chunk_id FROM (SELECT node_id, unnest(chunk_ids) AS chunk_id FROM nodes) WHERE chunk_id <> ''),
leaves AS (SELECT top, count(*) AS n FROM below JOIN held USING (node_id) WHERE node_id IN (SELECT node_id FROM nodes WHERE node_type = 'LEAF') GROUP BY top),
own AS (SELECT node_id AS top, count(*) AS n FROM held GROUP BY ALL)
SELECT query_id, CASE WHEN inner_ THEN 'fallback' ELSE 'arrived' END AS outcome, w.node_id AS path, CASE WHEN inner_ THEN 1 ELSE 0 END AS steps, NULL::VARCHAR AS error, coalesce(leaves.n, own.n, 0) AS chunks
FROM walks w LEFT JOIN ends USING (query_id) LEFT JOIN leaves ON leaves.top = ends.node_id LEFT JOIN own ON own.top = ends.node_id
"""


def _inputs(rows: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chapters of a tree: one chapter each, keywords from definitions."""
    kw = schema.valid_definitions(words).groupBy(F.col("document_id").alias("doc_id")).agg(F.sort_array(F.collect_set("normalized")).alias("keywords"))
    none = F.array().cast("array<string>")
    docs = rows.join(kw, "doc_id", "left").select("doc_id", "ordinal", "title", F.col("title").alias("summary"), F.coalesce("keywords", none).alias("keywords"), none.alias("entities"), none.alias("questions"))
    return docs, docs.select("doc_id", F.lit(0).alias("section_index"), F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "title", "summary", "keywords", "entities", "questions")


def tree_build(spark: SparkSession, d: str) -> DataFrame:
    """A tree over kb_documents with the offline model: its nodes with parent and place."""
    kb = table(spark, d, "kb_documents").select(F.col("id").alias("doc_id"), F.col("id").alias("ordinal_text"), "title")
    docs, chapters = _inputs(ranked(kb, [], ["ordinal_text"], "ordinal"), table(spark, d, "keyword_definitions"))
    t = trees.build(docs, chapters, OfflineProvider())
    return t.nodes.join(t.links.select(F.col("child").alias("node_id"), F.col("parent").alias("parent_id"), "pos"), "node_id", "left").select("node_id", "name", "type", "parent_id", "pos")


def tree_default(spark: SparkSession, d: str) -> DataFrame:
    """A tree over kb_documents without a model, groups cut in three until they are documents: its nodes with parent and place."""
    kb = table(spark, d, "kb_documents").select(F.col("id").alias("doc_id"), F.col("id").alias("ordinal_text"), "title")
    docs, chapters = _inputs(ranked(kb, [], ["ordinal_text"], "ordinal"), table(spark, d, "keyword_definitions"))
    t = trees.build(docs, chapters)
    return t.nodes.join(t.links.select(F.col("child").alias("node_id"), F.col("parent").alias("parent_id"), "pos"), "node_id", "left").select("node_id", "name", "type", "parent_id", "pos")


TREE_DEFAULT = r"""
WITH RECURSIVE base AS (SELECT id, row_number() OVER (ORDER BY id) AS ordinal FROM kb_documents),
levels AS (
  SELECT id, ordinal, 0 AS depth, 'root' AS path, 'Root' AS name, NULL::VARCHAR AS above, 0::BIGINT AS pos, ordinal AS r, count(*) OVER () AS n FROM base
  UNION ALL
  SELECT id, ordinal, depth + 1, path || '/' || c, CASE WHEN n <= 3 THEN '文档 ' || r ELSE '类别 ' || (c + 1) END, path, c, row_number() OVER (PARTITION BY path, c ORDER BY ordinal), count(*) OVER (PARTITION BY path, c)
  FROM (SELECT *, CASE WHEN n <= 3 THEN r - 1 WHEN r - 1 < (n % 3) * (n // 3 + 1) THEN (r - 1) // (n // 3 + 1) ELSE n % 3 + (r - 1 - (n % 3) * (n // 3 + 1)) // greatest(n // 3, 1) END AS c FROM levels WHERE n > 1 AND depth < 8)
),
rows AS (
  SELECT DISTINCT 'group' || chr(10) || path AS key, name, 'CATEGORY' AS type, above, pos FROM levels WHERE n > 1
  UNION ALL
  SELECT 'doc' || chr(10) || id, CASE WHEN trim(title) = '' THEN id ELSE left(title, 50) END, 'LEAF', CASE WHEN n = 1 THEN above ELSE path END, CASE WHEN n = 1 THEN pos ELSE ordinal END FROM levels JOIN kb_documents USING (id) WHERE n = 1 OR depth = 8
)
SELECT 'n-' || substr(sha256(key), 1, 24) AS node_id, name, type, CASE WHEN above IS NOT NULL THEN 'n-' || substr(sha256('group' || chr(10) || above), 1, 24) END AS parent_id, CASE WHEN above IS NOT NULL THEN pos END AS pos FROM rows
"""


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The distinct texts of documents, taken from a stream of the table's files."""
    import uuid

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = table_stream(spark, f"{d}/documents.parquet").select(F.md5("text").alias("md5"))
    distinct_stream(rows, "md5").writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema("md5 string").parquet(f"{at}/rows")


STREAM_DEDUP = "SELECT DISTINCT md5(text) AS md5 FROM documents WHERE text IS NOT NULL"


QUERIES = {
    f: globals().get(f.__name__.upper())
    for f in (
        keyword_definitions_clean, doc_keywords, inverted_index, total_keywords, candidates_exact, containment_only, search_topk, start_nodes, fallback_nodes, children, node_chunks, tree_leaves, answer_context, best_category, decision_parse,
        keyword_lines, navigate_batch, walks_by_keywords, tree_build, tree_default, stream_dedup,
    )
}
