"""Sections understood by a model, and their results rolled up to documents."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomelattice.functions.text import trimmed
from tomelattice.model.cache import looked_up
from tomelattice.model.calls import INSTRUCTIONS
from tomelattice.model.provider import MARK, Provider
from tomelattice.operators.sections import PROMPT_CHARS, window_sections
from tomelattice.session import Stage, stage

DEFINITION = "struct<keyword: string, definition: string, context: string>"
UNDERSTOOD = f"summary string, definitions array<{DEFINITION}>, entities array<string>, questions array<string>, calls int, input_tokens long, output_tokens long, error string"

#: Characters of context carried on and of a document's summary, keywords carried on.
CONTEXT_CHARS, CONTEXT_KEYWORDS, ROLLUP_CHARS = 1000, 5, 1000


def _json(text: str) -> dict:
    """The object in a model's answer, or an empty one; as functions.parsing.unfenced cuts it out."""
    a, b = text.find("{"), text.rfind("}")
    try:
        value = json.loads(text[a : b + 1]) if 0 <= a < b else {}
    except ValueError:
        value = {}
    return value if isinstance(value, dict) else {}


def _strings(value) -> list[str]:
    return [x.strip() for x in value if isinstance(x, str) and x.strip()] if isinstance(value, list) else []


def understand(provider: Provider, text: str | None, most: int = PROMPT_CHARS) -> dict:
    """A text's summary, keyword definitions, entities and questions.

    A text longer than a prompt is read part by part; each part's prompt has the summaries so far
    and the first keywords.  A failed part is an error of the whole; a failed summary of summaries
    leaves these as they are.  Of keywords equal but for case the first holds.
    """
    out = {"summary": "", "definitions": [], "entities": [], "questions": [], "calls": 0, "input_tokens": 0, "output_tokens": 0, "error": None}

    def ask(prompt: str, kind: str):
        r = provider.chat(f"{INSTRUCTIONS[kind]}{MARK}{prompt}", kind)
        out["calls"] += 1
        out["input_tokens"] += r.input_tokens
        out["output_tokens"] += r.output_tokens
        return r

    if not text or text.isspace():
        return out
    spans = window_sections(text, most, at_spaces=False)
    told: list[str] = []
    words: dict[str, dict] = {}
    for a, b in spans:
        context = ""
        if told:
            context = f"{' '.join(told)[-CONTEXT_CHARS:]}\n{', '.join(d['keyword'] for d in list(words.values())[:CONTEXT_KEYWORDS])}\n"
        r = ask(context + text[a:b], "COMPREHEND_CHUNK")
        if not r.success:
            out["error"] = r.error or "the model failed"
            return out
        answer = _json(r.content)
        if isinstance(answer.get("summary"), str) and answer["summary"].strip():
            told.append(answer["summary"].strip())
        for d in answer.get("keywordDefinitions") or []:
            k = str(d.get("keyword") or "").strip() if isinstance(d, dict) else ""
            if k:
                words.setdefault(k.lower(), {"keyword": k, "definition": str(d.get("definition") or "").strip(), "context": str(d.get("context") or "").strip()})
        for name, key in (("entities", "entities"), ("questions", "exampleQuestions")):
            out[name] += [x for x in _strings(answer.get(key)) if x not in out[name]]
    out["definitions"] = list(words.values())
    out["summary"] = " ".join(told)
    if len(spans) > 1:
        whole = out["summary"]
        cut = whole if len(whole) <= 20_000 else f"{whole[:10_000]} ... {whole[-10_000:]}"
        r = ask(cut, "GENERATE_SUMMARY")
        if r.success and r.content.strip():
            out["summary"] = r.content.strip()
    return out


_ARROW = {
    "summary": pa.string(), "definitions": pa.list_(pa.struct([(c, pa.string()) for c in ("keyword", "definition", "context")])), "entities": pa.list_(pa.string()), "questions": pa.list_(pa.string()),
    "calls": pa.int32(), "input_tokens": pa.int64(), "output_tokens": pa.int64(), "error": pa.string(),
}


def comprehended(chunks: DataFrame, chunk: str, text: str, provider: Provider, most: int = PROMPT_CHARS, concurrent: int | None = None) -> DataFrame:
    """(chunk, summary, definitions, entities, questions, calls, tokens, error) for every row; written, so that no call is made twice, and kept where the provider has a table of answers."""
    kind = chunks.schema[chunk].dataType.simpleString()
    rows = chunks.select(F.col(chunk).alias("chunk"), F.col(text).alias("_text"))

    def work(batches):
        for batch in batches:
            found = [understand(provider, t, most) for t in batch.column("_text").to_pylist()]
            yield pa.record_batch([batch.column("chunk"), *(pa.array([f[c] for f in found], t) for c, t in _ARROW.items())], ["chunk", *_ARROW])

    kinds = f"chunk {kind}, {UNDERSTOOD}"
    spread = lambda t: t.repartition(concurrent) if concurrent else t
    cache = getattr(provider, "cache", None)
    if cache is None or not cache.keeps("COMPREHEND_CHUNK"):
        return stage(spread(rows).mapInArrow(work, kinds))
    # What was understood of a text is kept whole, under the text and the size of the prompts it was read in.
    asked = F.concat(F.lit(f"{most}{MARK}"), F.coalesce("_text", F.lit("")))
    known = Stage(looked_up(rows, "COMPREHEND_CHUNK", asked, cache), hits=F.count("_kept"), all=F.count(F.lit(1)))
    cache.counted("COMPREHEND_CHUNK", known.seen["hits"], known.seen["all"] - known.seen["hits"])
    columns = [F.col(f"_u.{c}").alias(c) for c in _ARROW]
    out = known.df.where("_kept is not null").withColumn("_u", F.from_json("_kept.response", UNDERSTOOD)).select("chunk", *columns)
    if known.seen["hits"] < known.seen["all"]:
        missed = known.df.where("_kept is null").select("chunk", "_text")
        new = stage(spread(missed).mapInArrow(work, kinds))
        told = missed.join(new.where("error is null"), "chunk").select(asked.alias("prompt"), F.to_json(F.struct(*_ARROW)).alias("response"), "input_tokens", "output_tokens").dropDuplicates(["prompt"])
        cache.add("COMPREHEND_CHUNK", told)
        out = out.unionByName(new)
    return stage(out)


def first_by(array: Column, key) -> Column:
    """The entries of an array of which none before has the same key, in order."""
    return F.filter(array, lambda x, i: ~F.exists(F.slice(array, 1, i), lambda y: key(y).eqNullSafe(key(x))))


def rolled_up(sections: DataFrame, doc: str = "document_id", index: str = "section_index", title: str = "section_title") -> DataFrame:
    """One row a document: the only section's result, or the sections' results together.

    The summary is then each section's title and summary, cut at 1000 characters; of keywords equal
    but for case and of equal entities and questions the first holds.
    """
    fields = [F.col(index).alias("i"), F.col(title).alias("title"), *(F.col(c) for c in ("summary", "definitions", "entities", "questions"))]
    grouped = sections.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("s"))  # one document's sections
    told = F.array_join(F.transform("s", lambda x: F.concat(F.coalesce(x["title"], F.lit("")), F.lit("："), F.coalesce(x["summary"], F.lit("")), F.lit("；"))), "")
    flat = lambda c: F.flatten(F.transform("s", lambda x: F.coalesce(x[c], F.array().cast(sections.schema[c].dataType))))
    return grouped.select(
        doc,
        F.size("s").alias("sections"),
        F.when(F.size("s") == 1, F.coalesce(F.col("s")[0]["summary"], F.lit(""))).otherwise(F.substring(told, 1, ROLLUP_CHARS)).alias("summary"),
        first_by(flat("definitions"), lambda d: F.lower(trimmed(d["keyword"]))).alias("definitions"),
        F.array_distinct(flat("entities")).alias("entities"),
        F.array_distinct(flat("questions")).alias("questions"),
    )


