"""The keyword index: postings, weights, and queries scored against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomelattice.functions.text import normalized, tokens, trimmed

#: Keywords shorter than this are not looked for inside a query.
LEAST_CONTAINED = 2


def postings(rows: DataFrame, keyword: str = "keyword", node: str = "node_id", pos: str = "pos") -> DataFrame:
    """(keyword, node_id, pos): distinct entries by normalized keyword, with the first place of each.

    Blank keywords and null nodes go.  An entry list is kept as rows, so that a keyword may have any
    number of nodes.
    """
    clean = rows.select(normalized(keyword).alias("keyword"), F.col(node).alias("node_id"), F.col(pos).alias("pos"))
    return clean.where("keyword is not null and node_id is not null").groupBy("keyword", "node_id").agg(F.min("pos").alias("pos"))


def weights(rows: DataFrame, keyword: str = "keyword", weight: str = "weight") -> DataFrame:
    """(keyword, weight): the largest weight ever given to a normalized keyword."""
    return rows.select(normalized(keyword).alias("keyword"), F.col(weight).cast("double").alias("weight")).where("keyword is not null").groupBy("keyword").agg(F.max("weight").alias("weight"))


def weighted(entries: DataFrame, weighting: DataFrame | None) -> DataFrame:
    """Entries with their keyword's weight, 1 where none was given."""
    if weighting is None:
        return entries.withColumn("weight", F.lit(1.0))
    return entries.join(weighting, "keyword", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def matches_exact(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, keyword, times): keywords that are words of a query between white space, and how often.

    queries has query_id, unique, and query.  Words are counted before they meet the index.
    """
    words = queries.select("query_id", F.explode(tokens("query")).alias("keyword")).groupBy("query_id", "keyword").agg(F.count("*").alias("times"))
    return words.join(entries.select("keyword").distinct(), "keyword", "left_semi").select("query_id", "keyword", "times")


def matches_contained(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, keyword, times = 1): keywords of two characters or more anywhere in a query.

    Instead of comparing every query with every keyword, a query's substrings of the lengths that
    keywords have are joined with the keywords.
    """
    q = queries.select("query_id", F.lower(trimmed("query")).alias("q")).where("q is not null")
    words = entries.select("keyword").distinct().where(F.length("keyword") >= LEAST_CONTAINED)
    longest = q.agg(F.max(F.length("q"))).first()[0] or 0
    lengths = [r[0] for r in words.where(F.length("keyword") <= longest).select(F.length("keyword").alias("n")).distinct().collect()]  # at most the longest query's length
    if not lengths:
        return queries.sparkSession.createDataFrame([], queries.select("query_id").schema.add("keyword", "string").add("times", "long"))
    at = q.select("query_id", "q", F.explode(F.array(*(F.lit(n) for n in sorted(lengths)))).alias("n")).where(F.length("q") >= F.col("n"))
    parts = at.select("query_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("q") - F.col("n") + 1), lambda i: F.substring(F.col("q"), i, F.col("n")))).alias("keyword"))
    return parts.distinct().join(words, "keyword").select("query_id", "keyword", F.lit(1).cast("long").alias("times"))


def matches(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Exact matches; for queries that have none, contained ones."""
    exact = matches_exact(queries, entries)
    rest = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    return exact.unionByName(matches_contained(rest, entries))


def scores(matched: DataFrame, entries: DataFrame, weighting: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, score): the summed weights of a query's matches, by node."""
    hits = weighted(matched, weighting).select("query_id", "keyword", (F.col("times") * F.col("weight")).alias("part"))
    return hits.join(entries.select("keyword", "node_id"), "keyword").groupBy("query_id", "node_id").agg(F.sum("part").alias("score"))


def best_nodes(scored: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, node_id, score): each query's k best nodes; leaves before others, then by id.

    nodes has node_id and type; scored nodes that aren't there come last among equals.  Each task
    keeps k rows a query before they are shuffled.
    """
    typed = scored.join(nodes.select("node_id", (F.col("type") == "LEAF").alias("leaf")), "node_id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("leaf"), "node_id")
    return typed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "node_id", "score")


def start_nodes(scored: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id): the best node that exists."""
    return best_nodes(scored.join(nodes.select("node_id"), "node_id", "left_semi"), nodes, 1).select("query_id", "node_id")


def fallback_nodes(scored: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id): of the three best nodes the first with chunks; nodes that don't exist use up places."""
    top = best_nodes(scored, nodes, 3)
    full = nodes.where(F.size("chunk_ids") > 0).select("node_id")
    return top.join(full, "node_id", "left_semi").groupBy("query_id").agg(F.min_by("node_id", "rank").alias("node_id"))


def keyword_union(*frames: DataFrame) -> DataFrame:
    """The distinct normalized keywords of several tables."""
    out = None
    for f in frames:
        k = f.select(normalized("keyword").alias("keyword")).where("keyword is not null")
        out = k if out is None else out.union(k)
    return out.distinct()


class Dictionary:
    """Postings, weights and definitions together; every change gives a new one."""

    def __init__(self, entries: DataFrame, weighting: DataFrame, definitions: DataFrame) -> None:
        self.entries, self.weighting, self.definitions = entries, weighting, definitions

    def add(self, rows: DataFrame) -> Dictionary:
        """rows (keyword, node_id, weight): entries go behind those there; a weight only rises."""
        last = self.entries.groupBy("keyword").agg((F.max("pos") + 1).alias("base"))
        new = rows.select(normalized("keyword").alias("keyword"), "node_id", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")).where("keyword is not null and node_id is not null")
        placed = new.join(last, "keyword", "left").select("keyword", "node_id", F.coalesce("base", F.lit(0)).alias("pos"))
        return Dictionary(postings(self.entries.unionByName(placed)), weights(self.weighting.unionByName(new.select("keyword", "weight"))), self.definitions)

    def remove(self, keyword: str) -> Dictionary:
        gone = normalized(F.lit(keyword))
        keep = lambda t, c: t.where(~F.coalesce(c == gone, F.lit(False)))
        return Dictionary(keep(self.entries, F.col("keyword")), keep(self.weighting, F.col("keyword")), keep(self.definitions, normalized("keyword")))

    def remove_node(self, node_id: str) -> Dictionary:
        return Dictionary(self.entries.where(F.col("node_id") != node_id), self.weighting, self.definitions)

    def clear(self) -> Dictionary:
        return Dictionary(*(t.limit(0) for t in (self.entries, self.weighting, self.definitions)))

    def lookup(self, keyword: str) -> list[str]:
        """A keyword's nodes in their order, and those of one place by id."""
        return [r[0] for r in self.entries.where(F.col("keyword") == normalized(F.lit(keyword))).orderBy("pos", "node_id").select("node_id").toLocalIterator()]

    def contains(self, keyword: str) -> bool:
        return not self.entries.where(F.col("keyword") == normalized(F.lit(keyword))).isEmpty()

    def weight(self, keyword: str) -> float:
        row = self.weighting.where(F.col("keyword") == normalized(F.lit(keyword))).first()
        return row["weight"] if row else 1.0

    def size(self) -> int:
        """Distinct keywords with entries or definitions."""
        return keyword_union(self.entries, self.definitions).count()
