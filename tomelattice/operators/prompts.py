"""Model calls as tables: cached answers, prompts alike, usage, and admission by rate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomelattice.functions.text import SIMILAR_AT, SIMILAR_LENGTH, cache_key, prompt_normalized, similarity, threshold_or_default

#: Entries and idle hours of a cache, by request type; None is never cached.
CACHE_LIMITS: dict[str, tuple[int, int] | None] = {
    "COMPREHEND_CHUNK": (5000, 12),
    "GENERATE_SUMMARY": (2000, 12),
    "CLUSTER_DOCUMENTS": (1000, 6),
    "DECIDE_NAVIGATION": (5000, 1),
    "EXTRACT_KEYWORDS": (2000, 12),
    "EXTRACT_ENTITIES": (2000, 12),
    "GENERATE_EXAMPLE_QUESTIONS": (2000, 12),
    "EXTRACT_QUERY_KEYWORDS": (5000, 6),
    "ANSWER_QUESTION": None,
}


def with_keys(requests: DataFrame) -> DataFrame:
    return requests.withColumn("cache_key", cache_key("request_type", "prompt"))


def replayed(requests: DataFrame, order: str) -> DataFrame:
    """Requests (request_type, prompt, success) with `hit`: whether an earlier one with the same key was answered.

    Only success is kept, so all requests up to the first successful one are misses; types that are
    not cached always miss.
    """
    keyed = with_keys(requests)
    first = keyed.where("success").groupBy("cache_key").agg(F.min(order).alias("_first"))
    uncached = [k for k, v in CACHE_LIMITS.items() if v is None]
    hit = F.coalesce(F.col(order) > F.col("_first"), F.lit(False)) & ~F.upper("request_type").isin(uncached)
    return keyed.join(first, "cache_key", "left").withColumn("hit", hit).drop("_first")


def cache_statistics(requests: DataFrame) -> DataFrame:
    """(request_type, requests, hits, misses, hit_rate, entries): one outcome a request."""
    return requests.groupBy("request_type").agg(
        F.count("*").alias("requests"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.try_divide(F.count_if("hit"), F.count("*")), F.lit(0.0)).alias("hit_rate"), F.countDistinct(F.when(F.col("success"), F.col("cache_key"))).alias("entries")
    )


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct (cache_key, request_type, prompt) that the cache has no answer for: what a model has to be asked."""
    return with_keys(requests).select("cache_key", "request_type", "prompt").dropDuplicates(["cache_key"]).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")


def usage(calls: DataFrame, group: str) -> DataFrame:
    """(group, calls, input_tokens, output_tokens, total_tokens, average_ms): sums, and 0 where there is nothing to average."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return calls.groupBy(group).agg(F.count("*").alias("calls"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), (total("input_tokens") + total("output_tokens")).alias("total_tokens"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("average_ms"))


def alike(prompts: DataFrame, threshold: float = SIMILAR_AT, max_length: int = SIMILAR_LENGTH) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b: prompts of an id and a text that count as the same.

    A similarity of t leaves floor((1 - t) * n) edits in a text of n characters; cut into one piece
    more, it has a piece that the other text holds unchanged.  Of these there is one with as many
    edits before it as pieces at most, and behind it likewise, which limits how far it is shifted.
    So texts meet by equal pieces, not each with each; texts that are equal once normalized have
    similarity 1 at any length and meet through one of them.
    """
    t = threshold_or_default(threshold)
    rows = prompts.select("id", prompt_normalized("prompt").alias("p")).where("id is not null and p is not null")
    texts = rows.groupBy("p").agg(F.min("id").alias("of"))
    short = texts.where((F.length("p") <= (max_length if max_length > 0 else SIMILAR_LENGTH)) & (F.length("p") > 0)).withColumn("n", F.length("p"))
    # The longer text, of n characters, is cut; the shorter one, of m, offers its substrings.
    edits = F.floor(F.lit(1 - t) * F.col("n") + 1e-9).cast("int")
    cut = short.select("p", "n", edits.alias("k"), F.explode(F.sequence(F.lit(0), edits)).alias("i"))
    begin = F.floor(F.col("i") * F.col("n") / (F.col("k") + 1)).cast("int")
    end = F.floor((F.col("i") + 1) * F.col("n") / (F.col("k") + 1)).cast("int")
    pieces = cut.select("p", "n", "k", begin.alias("at"), F.substring("p", begin + 1, end - begin).alias("piece"), (end - begin).alias("size")).where("size > 0")
    # A shorter text meets cut texts of its length up to 1 / t of it.
    lengths = short.select(F.col("p").alias("q"), F.col("n").alias("m"), F.explode(F.sequence(F.col("n"), F.floor(F.col("n") / F.lit(max(t, 0.01)) + 1e-9).cast("int"))).alias("n"))
    offered = lengths.withColumn("k", F.floor(F.lit(1 - t) * F.col("n") + 1e-9).cast("int")).select("q", "m", "n", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    offered = offered.select("q", "m", "n", "k", "i", begin.alias("at"), (end - begin).alias("size")).where("size > 0")
    offered = offered.withColumn("low", F.expr("greatest(0, at + greatest(-i, m - n - (k - i)))")).withColumn("high", F.expr("least(m - size, at + least(i, m - n + (k - i)))"))
    shifts = F.sequence("low", "high")
    offered = offered.where("low <= high").select("q", "n", "at", F.explode(F.array_distinct(F.transform(shifts, lambda s: F.substring(F.col("q"), s + 1, F.col("size"))))).alias("piece"))
    met = pieces.select("p", "n", "at", "piece").join(offered, ["n", "at", "piece"]).where((F.length("q") < F.col("n")) | (F.col("q") < F.col("p"))).select("p", "q").distinct()
    near = met.where(F.expr(f"levenshtein(p, q, cast(floor({1 - t!r} * length(p) + 1e-9) as int)) >= 0"))  # gives up early
    close = near.withColumn("similarity", similarity("p", "q")).where(F.col("similarity") >= t - 1e-12)
    a, b = (rows.select(F.col("id").alias(i), F.col("p").alias(c)) for i, c in (("u", "p"), ("v", "q")))
    across = close.join(a, "p").join(b, "q").select("u", "v", "similarity")
    same = rows.join(texts, "p").where(F.col("id") != F.col("of")).select(F.col("of").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("similarity"))
    return across.union(same).select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b"), "similarity")


def _admission(most: int, window: float):
    """A fold over rows sorted by key, run and time; it holds the admitted times of one run's last window."""

    def fold(frames):
        run, admitted = None, []
        for rows in frames:
            out = []
            for now, t in zip(zip(rows["_key"], rows["_run"]), rows["_t"]):
                if run is None or now[1] != run[1] or not (now[0] == run[0] or (pd.isna(now[0]) and pd.isna(run[0]))):
                    run, admitted = now, []
                while admitted and admitted[0] <= t - window:
                    admitted.pop(0)
                out.append(len(admitted) < most)
                if out[-1]:
                    admitted.append(t)
            yield rows[["_key", "_id"]].assign(admitted=out)

    return fold


def rate_limited(events: DataFrame, key: str, time: str, id: str, most: int = 5, seconds: float = 60.0) -> DataFrame:
    """(key, id, admitted): whether an event comes with fewer than `most` admitted ones of its key in the last `seconds`.

    Rejected events don't count, so this is a fold.  Time is cut into steps of `seconds`; a step in
    which a key has no event forgets all before it, so each run of steps with events is folded on
    its own, as a stream with the few admitted times as state, and a busy key is spread over its
    runs.  Events at one time are taken by id; null keys are a key, null times are left out.
    """
    at = F.col(time).cast("timestamp") if events.schema[time].dataType.typeName().startswith("timestamp") else F.col(time)
    step = F.floor(F.col("_t") / seconds)
    rows = events.where(F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(id).alias("_id"), at.cast("double").alias("_t")).withColumn("_step", step)
    by = Window.partitionBy("_k").orderBy("_s")  # a key's steps, of which there are as many as time has, not as events
    steps = rows.select(F.col("_key").alias("_k"), F.col("_step").alias("_s")).distinct()
    runs = steps.select("_k", "_s", (F.col("_s") - F.row_number().over(by)).alias("_run"))
    placed = rows.join(runs, rows["_key"].eqNullSafe(runs["_k"]) & (rows["_step"] == runs["_s"])).select("_key", "_run", "_t", "_id")
    sort = ["_key", "_run"]
    kinds = f"_key {events.schema[key].dataType.simpleString()}, _id {events.schema[id].dataType.simpleString()}, admitted boolean"
    folded = placed.repartition(*sort).sortWithinPartitions(*sort, "_t", "_id").mapInPandas(_admission(most, seconds), kinds)
    return folded.select(F.col("_key").alias(key), F.col("_id").alias(id), "admitted")
