"""Model calls over DataFrames."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomelattice.model.cache import looked_up
from tomelattice.model.provider import MARK, Provider, Response
from tomelattice.session import Stage, stage

ANSWER = "struct<content: string, input_tokens: int, output_tokens: int, duration_ms: int, success: boolean, error: string>"

#: What a model is asked, before MARK and the variable part.
INSTRUCTIONS = {
    "COMPREHEND_CHUNK": 'Describe the text as JSON {"summary", "keywordDefinitions": [{"keyword", "definition", "context"}], "entities", "exampleQuestions"}.',
    "GENERATE_SUMMARY": "Sum up the text, given as summaries of its parts.",
    "CLUSTER_DOCUMENTS": 'Sort the numbered documents into groups, as JSON {"clusters": [{"name", "chunkIndices"}]}.',
    "DECIDE_NAVIGATION": 'A question, then the numbered children of a node of a tree.  Decide as JSON {"action": "select_child" | "expand_multiple" | "fallback_search" | "stop", "selectedIndex", "selectedIndexes", "reasoning", "confidence"}.',
    "EXTRACT_KEYWORDS": "Name the keywords of the text as a JSON array of strings.",
    "EXTRACT_ENTITIES": "Name the entities in the text as a JSON array of strings.",
    "GENERATE_EXAMPLE_QUESTIONS": "Write questions that the text answers as a JSON array of strings.",
    "EXTRACT_QUERY_KEYWORDS": "Name the keywords of the question, one to a line.",
    "ANSWER_QUESTION": "A question, then numbered texts.  Answer the question from the texts.",
}


def prompt(request_type: str, *parts) -> F.Column:
    """A prompt column: instructions, MARK, and the parts on lines of their own."""
    return F.concat(F.lit(INSTRUCTIONS[request_type] + MARK), F.concat_ws("\n", *(F.col(p) if isinstance(p, str) else p for p in parts)))


def _caller(provider: Provider, request_type: str):
    def call(batches):
        for batch in batches:
            rows = []
            for p in batch.column("prompt").to_pylist():
                begun = time.monotonic()
                try:
                    r = provider.chat(p, request_type)
                except Exception as e:
                    r = Response.failure(str(e))
                spent = r.duration_ms or int((time.monotonic() - begun) * 1000)
                rows.append({"content": r.content, "input_tokens": r.input_tokens, "output_tokens": r.output_tokens, "duration_ms": spent, "success": r.success, "error": r.error})
            yield pa.record_batch([batch.column("prompt"), pa.array(rows, pa.struct([("content", pa.string()), ("input_tokens", pa.int32()), ("output_tokens", pa.int32()), ("duration_ms", pa.int32()), ("success", pa.bool_()), ("error", pa.string())]))], ["prompt", "answer"])

    return call


def asked(rows: DataFrame, request_type: str, provider: Provider, column: str = "answer", concurrent: int | None = None) -> DataFrame:
    """rows (with a prompt) and the answer to each; equal prompts are asked once.

    Where the provider has a table of answers, only prompts without one are asked.  A failed call is an answer without success; null prompts have no answer.  The calls are made
    once and written, so that later steps don't repeat them; `concurrent` is how many run at a time.
    """
    prompts = rows.where("prompt is not null").select("prompt").distinct()
    kinds = f"prompt string, answer {ANSWER}"
    spread = lambda t: t.repartition(concurrent) if concurrent else t
    cache = getattr(provider, "cache", None)
    if cache is None or not cache.keeps(request_type):
        answers = stage(spread(prompts).mapInArrow(_caller(provider, request_type), kinds))
        return rows.join(answers.withColumnRenamed("answer", column), "prompt", "left")
    known = Stage(looked_up(prompts, request_type, F.col("prompt"), cache), hits=F.count("_kept"), all=F.count(F.lit(1)))
    cache.counted(request_type, known.seen["hits"], known.seen["all"] - known.seen["hits"])
    kept = F.struct(F.col("_kept.response").alias("content"), F.col("_kept.input_tokens").alias("input_tokens"), F.col("_kept.output_tokens").alias("output_tokens"), F.lit(0).alias("duration_ms"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))
    answers = known.df.where("_kept is not null").select("prompt", kept.cast(ANSWER).alias("answer"))
    if known.seen["hits"] < known.seen["all"]:
        new = stage(spread(known.df.where("_kept is null").select("prompt")).mapInArrow(_caller(provider, request_type), kinds))
        cache.add(request_type, new.where("answer.success").select("prompt", F.col("answer.content").alias("response"), "answer.input_tokens", "answer.output_tokens"))
        answers = answers.unionByName(new)
    return rows.join(answers.withColumnRenamed("answer", column), "prompt", "left")
