"""Queries over the tree of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelattice.operators.hierarchy import Hierarchy


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Depth, root and place on a cycle of every node."""
    return Hierarchy(spark.read.parquet(f"{d}/nodes.parquet")).found()


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its path from the root, and its range in the preorder of the root's tree."""
    return Hierarchy(spark.read.parquet(f"{d}/nodes.parquet")).table(paths=True).withColumn("path", F.array_join("path", "/"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a node and one below it."""
    return Hierarchy(spark.read.parquet(f"{d}/nodes.parquet")).descendants().select(F.col("node").alias("node_id"), F.col("descendant").alias("descendant_id"))


def p2_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The distinct chunks of every node and of those below it."""
    nodes = spark.read.parquet(f"{d}/nodes.parquet")
    own = nodes.select(F.col("node_id").alias("descendant"), F.explode("chunk_ids").alias("chunk_id")).where("chunk_id <> ''").distinct()
    below = Hierarchy(nodes).descendants()
    return below.join(own, "descendant").select(F.col("node").alias("node_id"), "chunk_id").union(own).distinct()


_LINKS = """
WITH RECURSIVE ids AS MATERIALIZED (SELECT DISTINCT node_id AS node FROM nodes WHERE node_id IS NOT NULL),
listed AS (SELECT node_id AS parent, unnest(children_ids) AS child, generate_subscripts(children_ids, 1) - 1 AS pos FROM nodes WHERE node_id IS NOT NULL),
links AS MATERIALIZED (SELECT parent, child, min(pos) AS pos FROM listed WHERE child IN (FROM ids) GROUP BY ALL),
below AS MATERIALIZED (SELECT parent AS node, child AS descendant FROM links UNION SELECT node, child FROM below JOIN links ON descendant = parent),
reached AS MATERIALIZED (
  SELECT node, node AS root, 0 AS depth FROM ids WHERE node NOT IN (SELECT child FROM links)
  UNION SELECT child, root, depth + 1 FROM reached JOIN links ON node = parent WHERE depth < (SELECT count(*) FROM ids)
),
nearest AS MATERIALIZED (SELECT node, min({'depth': depth, 'root': root}) AS best FROM reached GROUP BY node),
found AS (
  SELECT node AS node_id, coalesce(best.root, '') AS root_id, CAST(coalesce(best.depth, -1) AS INTEGER) AS node_depth,
    CAST(node IN (SELECT node FROM below WHERE node = descendant) AS INTEGER) AS on_cycle
  FROM ids LEFT JOIN nearest USING (node)
)
"""
_HIERARCHY = """,
tree AS MATERIALIZED (
  SELECT l.child AS node, arg_min({'parent': l.parent, 'pos': l.pos}, l.parent) AS b
  FROM links l JOIN nearest c ON c.node = l.child JOIN nearest p ON p.node = l.parent
  WHERE c.best.root = p.best.root AND c.best.depth = p.best.depth + 1 GROUP BY l.child
),
ways AS MATERIALIZED (
  SELECT node, node AS path, CAST([] AS STRUCT(pos BIGINT, node VARCHAR)[]) AS place FROM nearest WHERE best.depth = 0
  UNION ALL SELECT t.node, path || '/' || t.node, list_append(place, {'pos': t.b.pos, 'node': t.node}) FROM ways w JOIN tree t ON t.b.parent = w.node
),
steps AS (SELECT node AS top, node FROM nearest UNION ALL SELECT s.top, t.node FROM steps s JOIN tree t ON t.b.parent = s.node),
sizes AS (SELECT top, count(*) AS size FROM steps GROUP BY top)
SELECT node_id, root_id, node_depth, b.parent AS parent_id, CASE WHEN path IS NOT NULL THEN row_number() OVER (PARTITION BY path IS NULL, root_id ORDER BY place) - 1 END AS pre, size, on_cycle, path
FROM found LEFT JOIN tree ON tree.node = node_id LEFT JOIN ways ON ways.node = node_id LEFT JOIN sizes ON top = node_id
"""
_CHUNKS = """,
own AS MATERIALIZED (SELECT DISTINCT node_id, unnest(chunk_ids) AS chunk_id FROM nodes)
SELECT node_id, chunk_id FROM own WHERE chunk_id <> ''
UNION SELECT node, chunk_id FROM below JOIN own ON node_id = descendant WHERE chunk_id <> ''
"""

QUERIES = {
    p2_found: f"{_LINKS} SELECT * FROM found",
    p2_hierarchy: _LINKS + _HIERARCHY,
    p2_descendants: f"{_LINKS} SELECT node AS node_id, descendant AS descendant_id FROM below",
    p2_chunks: _LINKS + _CHUNKS,
}
