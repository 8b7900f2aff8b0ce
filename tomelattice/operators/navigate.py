"""Questions walked down the tree, all questions of a batch one level at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomelattice.functions.parsing import decision, keyword_lines
from tomelattice.functions.text import is_blank, numbered
from tomelattice.model.calls import asked, prompt
from tomelattice.model.provider import Provider
from tomelattice.operators.index import fallback_nodes, matches, scores, start_nodes
from tomelattice.session import Stage, stage

MAX_STEPS = 20


def child_links(nodes: DataFrame) -> DataFrame:
    """(parent, child, pos) of the lists of nodes; entries that are no node go, of repeated ones the first place holds."""
    each = nodes.select(F.col("node_id").alias("parent"), F.posexplode("children_ids").alias("pos", "child")).where("child is not null")
    there = nodes.select(F.col("node_id").alias("child")).distinct()
    return each.join(there, "child", "left_semi").groupBy("parent", "child").agg(F.min("pos").alias("pos"))


def chunk_links(nodes: DataFrame) -> DataFrame:
    """(node_id, chunk_id, pos) of the lists of nodes, in which null and empty entries don't count."""
    each = nodes.select("node_id", F.posexplode("chunk_ids").alias("pos", "chunk_id")).where("chunk_id <> ''")
    return each.groupBy("node_id", "chunk_id").agg(F.min("pos").alias("pos"))


def with_chunks(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links to chunks with the chunks' other columns; an unknown chunk has an empty summary and no other."""
    return links.join(chunks, "chunk_id", "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def leaf_chunks(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id, chunk_id): the chunks of the leaves below each start, itself included, by the leaf that has them.

    starts has query_id and node_id.  A start without a chunk of a leaf below it gives its own
    chunks.  Every node is visited once a query, so cycles do no harm.
    """
    edges = stage(child_links(nodes))
    step = Stage(starts.select("query_id", "node_id").distinct(), n=F.count(F.lit(1)))
    seen = step.df
    while step.seen["n"]:
        below = step.df.join(edges, step.df["node_id"] == edges["parent"]).select("query_id", F.col("child").alias("node_id")).distinct()
        step = Stage(below.join(seen, ["query_id", "node_id"], "left_anti"), n=F.count(F.lit(1)))
        seen = seen.unionByName(step.df)
    held = chunk_links(nodes).drop("pos")
    leaves = nodes.where("type = 'LEAF'").select("node_id").distinct()
    found = stage(seen.join(leaves, "node_id", "left_semi").join(held, "node_id").select("query_id", "node_id", "chunk_id"))
    rest = starts.join(found.select("query_id").distinct(), "query_id", "left_anti").join(held, "node_id").select("query_id", "node_id", "chunk_id")
    return found.unionByName(rest).distinct()


def query_keywords(queries: DataFrame, provider: Provider | None) -> DataFrame:
    """queries with the text that the index is asked with: the model's keywords, the query itself without a model or if it fails."""
    if provider is None:
        return queries.withColumn("asked", F.col("query"))
    answers = asked(queries.withColumn("prompt", prompt("EXTRACT_QUERY_KEYWORDS", "query")), "EXTRACT_QUERY_KEYWORDS", provider)
    said = keyword_lines("answer.content")
    return answers.withColumn("asked", F.when(F.col("answer.success") & (F.size(said) > 0), F.array_join(said, " ")).otherwise(F.col("query"))).drop("prompt", "answer")


def navigate(queries: DataFrame, nodes: DataFrame, root: str, entries: DataFrame, weighting: DataFrame | None = None, provider: Provider | None = None, max_steps: int = MAX_STEPS, on_step: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """The chunks found for each query, and how it went.

    queries has query_id, unique, and query.  A walk begins at the best node that a query's keywords
    lead to, those of the model or, if they lead nowhere, the query's own words, else at the root.
    At every node with children that is no leaf, a model picks a child, several of them, the
    keyword search, or to stop; so does a low confidence, a node seen before, more than max_steps
    steps or a failed call lead to keyword search, whose best node with chunks of three ends the
    walk.  Stopping finds nothing.  The first result is (query_id, node_id, chunk_id); the
    second (query_id, outcome, path, steps, error): a blank query has error NAV_007, an answer that
    is no decision NAV_004, and both find nothing.  on_step is called with the number of every step.
    """
    blank = queries.where(is_blank("query")).select("query_id")
    live = stage(query_keywords(queries.where(~is_blank("query")).select("query_id", "query"), provider))
    hits = scores(matches(live.select("query_id", F.col("asked").alias("query")), entries), entries, weighting)
    starts = start_nodes(hits, nodes)
    if provider is not None:
        missed = live.join(starts.select("query_id"), "query_id", "left_anti").where("asked <> query")
        again = scores(matches(missed.select("query_id", "query"), entries), entries, weighting)
        starts = starts.unionByName(start_nodes(again, nodes))
    state = live.join(starts, "query_id", "left").select("query_id", "query", F.coalesce("node_id", F.lit(root)).alias("node_id")).withColumn("path", F.array("node_id")).withColumn("steps", F.lit(0))
    state = stage(state)
    edges = stage(child_links(nodes))
    about = nodes.select("node_id", "name", "description").dropDuplicates(["node_id"])
    lists = edges.join(about.withColumnRenamed("node_id", "child"), "child").groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("pos", "child", "name", "description"))).alias("below"))  # a node's children, which one prompt has to hold
    lists = stage(lists.join(nodes.where("type <> 'LEAF'").select(F.col("node_id").alias("parent")).distinct(), "parent", "left_semi"))
    ended = [state.where("false").select("query_id", "query", "path", "steps", F.array("node_id").alias("picked"), F.lit("").alias("outcome"), F.lit(None).cast("string").alias("error"))]
    keep = ["query_id", "query", "path", "steps", "picked", "outcome", "error"]
    none = F.lit(None).cast("string")
    for taken in range(max_steps + 1):
        if state.isEmpty():
            break
        if on_step:
            on_step(taken + 1)
        here = stage(state.join(lists.withColumnRenamed("parent", "node_id"), "node_id", "left"))
        ended.append(here.where("below is null").select("query_id", "query", "path", "steps", F.array("node_id").alias("picked"), F.lit("arrived").alias("outcome"), none.alias("error")))
        walking = here.where("below is not null").withColumn("steps", F.col("steps") + 1)
        ended.append(walking.where(F.col("steps") > max_steps).select("query_id", "query", "path", "steps", F.array().cast("array<string>").alias("picked"), F.lit("fallback").alias("outcome"), none.alias("error")))
        walking = walking.where(F.col("steps") <= max_steps)
        if provider is None:
            moved = walking.withColumn("d", F.lit(None).cast("struct<move: string, picks: array<int>, reasoning: string, error: string>")).withColumn("ok", F.lit(False))
        else:
            told = F.array_join(F.transform("below", lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(x["name"], F.lit("")), F.lit(" - "), F.coalesce(x["description"], F.lit("")))), "\n")
            answers = asked(walking.withColumn("prompt", prompt("DECIDE_NAVIGATION", F.regexp_replace("query", r"\s+", " "), told)), "DECIDE_NAVIGATION", provider)
            moved = answers.withColumn("d", decision("answer.content", F.size("below"))).withColumn("ok", F.coalesce("answer.success", F.lit(False))).drop("prompt", "answer")
        picked = F.transform(F.col("d.picks"), lambda i: F.element_at(F.col("below.child"), i + 1))
        moved = stage(moved.withColumn("picked", F.coalesce(picked, F.array().cast("array<string>"))).withColumn("error", F.when(F.col("ok"), F.col("d.error"))).withColumn("move", F.when(~F.col("ok"), "fallback").when(F.col("d.error").isNotNull(), "error").otherwise(F.col("d.move"))))
        step = (F.col("move") == "select") & ~F.array_contains("path", F.col("picked")[0])
        outcome = F.when(F.col("move") == "select", "fallback").when(F.col("move") == "expand", "expanded").when(F.col("move") == "stop", "stopped").otherwise(F.col("move"))
        ended.append(moved.where(~F.coalesce(step, F.lit(False))).withColumn("outcome", outcome).withColumn("picked", F.when(F.col("outcome") == "expanded", F.col("picked")).otherwise(F.array().cast("array<string>"))).select(*keep))
        state = stage(moved.where(F.coalesce(step, F.lit(False))).select("query_id", "query", F.col("picked")[0].alias("node_id"), F.concat("path", F.slice("picked", 1, 1)).alias("path"), "steps"))
    walked = ended[0]
    for e in ended[1:]:
        walked = walked.unionByName(e)
    walked = stage(walked)
    back = walked.where("outcome = 'fallback'").select("query_id", "query")
    safe = fallback_nodes(scores(matches(back, entries), entries, weighting), nodes)
    ends = walked.select("query_id", F.explode("picked").alias("node_id")).unionByName(safe.select("query_id", "node_id"))
    found = leaf_chunks(stage(ends), nodes)
    log = walked.select("query_id", "outcome", F.array_join("path", "/").alias("path"), "steps", "error")
    refused = blank.select("query_id", F.lit("error").alias("outcome"), F.lit("").alias("path"), F.lit(0).alias("steps"), F.lit("NAV_007").alias("error"))
    return found, log.unionByName(refused)


def answer_context(found: DataFrame, texts: DataFrame, order: list[str]) -> DataFrame:
    """(query_id, context): the found chunks' texts as numbered blocks, in order; without a text, the summary.

    found has query_id, chunk_id and the order's columns, few rows a query; texts has chunk_id, text
    and summary and is read only where it was found.
    """
    body = F.coalesce("text", "summary", F.lit(""))
    got = found.join(texts, "chunk_id", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*order, body.alias("body")))).alias("l"))
    return got.select("query_id", numbered("l.body").alias("context"))


def answered(questions: DataFrame, provider: Provider) -> DataFrame:
    """questions (query_id, query, context) with the model's answer; a failed call has its error instead."""
    out = asked(questions.withColumn("prompt", prompt("ANSWER_QUESTION", F.regexp_replace("query", r"\s+", " "), "context")), "ANSWER_QUESTION", provider)
    return out.select("query_id", F.when(F.col("answer.success"), F.col("answer.content")).alias("answer"), F.col("answer.error").alias("error"), F.col("answer.input_tokens").alias("input_tokens"), F.col("answer.output_tokens").alias("output_tokens"))
