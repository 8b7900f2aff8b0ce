"""Answers of models kept in a table, looked up before any call is made.

Rows are appended by batch; a request's newest answer of its type's idle hours counts.  Lookups are
joins on the key, so that what is asked are the prompts that have no answer; nothing is held in
memory, and workers need no cache of their own.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelattice import schema
from tomelattice.functions.text import cache_key
from tomelattice.model.provider import Provider, Response
from tomelattice.operators.prompts import CACHE_LIMITS
from tomelattice.store import Store

log = logging.getLogger("tomelattice")

_ROWS = f"{schema.LLM_CACHE}, at timestamp"
#: Folders of answers beyond which they are put together.
FOLDERS = 16


class ResponseCache:
    """Answers by request type and prompt, within entries and idle hours of each type; None is never kept."""

    def __init__(self, spark: SparkSession, root: str, limits: dict[str, tuple[int, int] | None] | None = None) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.limits: dict[str, tuple[int, int] | None] | None = dict(CACHE_LIMITS if limits is None else limits)
        self.counts: dict[str, list[int]] = {}  # by type: hits, misses

    def keeps(self, request_type: str) -> bool:
        return self.limits is not None and self.limits.get(request_type) is not None

    def rows(self) -> DataFrame:
        return self.store.table("answers", _ROWS)

    def answers(self, request_type: str) -> DataFrame:
        """(cache_key, response, input_tokens, output_tokens): the newest answer of each request that isn't too old."""
        hours = self.limits[request_type][1]
        fresh = self.rows().where((F.col("request_type") == request_type) & (F.col("at") > F.current_timestamp() - F.make_interval(hours=F.lit(hours))))
        newest = fresh.groupBy("cache_key").agg(F.max_by(F.struct("response", "input_tokens", "output_tokens"), "at").alias("a"))
        return newest.select("cache_key", "a.*")

    def add(self, request_type: str, rows: DataFrame) -> None:
        """Keeps answers (prompt, response, input_tokens, output_tokens), without looking for what is there."""
        kept = rows.select(cache_key(F.lit(request_type), "prompt").alias("cache_key"), F.lit(request_type).alias("request_type"), "prompt", "response", F.col("input_tokens").cast("int"), F.col("output_tokens").cast("int"), F.current_timestamp().alias("at"))
        self.store.commit({}, {"answers": kept})
        if len(self.store.pointer()["tables"]["answers"]) > FOLDERS:
            self.trim()

    def counted(self, request_type: str, hits: int, misses: int) -> None:
        c = self.counts.setdefault(request_type, [0, 0])
        c[0] += hits
        c[1] += misses

    # Administration

    def trim(self) -> None:
        """Writes the answers anew: one for a request, the newest of each type's number of entries, none too old."""
        kept = None
        for t, limit in (self.limits or {}).items():
            if limit is None:
                continue
            newest = self.rows().where(F.col("request_type") == t).groupBy("cache_key").agg(F.max_by(F.struct(*(c.split()[0] for c in _ROWS.split(", "))), "at").alias("a")).select("a.*")
            part = newest.where(F.col("at") > F.current_timestamp() - F.make_interval(hours=F.lit(limit[1]))).orderBy(F.desc("at"), "cache_key").limit(limit[0])
            kept = part if kept is None else kept.unionByName(part)
        self.store.commit({"answers": self.rows().limit(0) if kept is None else kept})
        self.store.clean()

    def clear(self, request_type: str | None = None) -> None:
        """Forgets the answers of a type, or all."""
        self.store.commit({"answers": self.rows().where(F.lit(False) if request_type is None else F.col("request_type") != request_type)})
        self.store.clean()

    def warm(self, request_type: str, answers: dict[str, str] | DataFrame) -> None:
        """Keeps given answers (prompt, response); what is there already isn't looked at."""
        rows = answers if isinstance(answers, DataFrame) else self.spark.createDataFrame(list(answers.items()), "prompt string, response string")
        self.add(request_type, rows.select("prompt", "response", F.lit(0).alias("input_tokens"), F.lit(0).alias("output_tokens")))

    def reconfigure(self, limits: dict[str, tuple[int, int] | None] | None) -> None:
        """Other entries and idle hours; None turns the cache off and keeps what is stored."""
        self.limits = None if limits is None else dict(limits)

    def sizes(self) -> dict[str, int]:
        """Requests with an answer, by type."""
        return {r["request_type"]: r["n"] for r in self.rows().groupBy("request_type").agg(F.countDistinct("cache_key").alias("n")).collect()}

    def statistics(self) -> dict[str, dict[str, float]]:
        """By type, of this object's lookups: requests, hits, misses and hit rate."""
        return {t: {"requests": h + m, "hits": h, "misses": m, "hit_rate": h / (h + m) if h + m else 0.0} for t, (h, m) in sorted(self.counts.items())}

    def reset(self) -> None:
        self.counts.clear()

    def text(self) -> str:
        """The statistics as lines."""
        return "\n".join(f"{t}: {s['hits']:.0f} of {s['requests']:.0f} requests ({s['hit_rate']:.1%})" for t, s in self.statistics().items())

    def log(self) -> None:
        log.info("answers kept\n%s", self.text())


class StoredProvider:
    """A provider with a table of answers.  Calls over DataFrames look there first; in workers it is the provider alone."""

    def __init__(self, inner: Provider, cache: ResponseCache | None) -> None:
        self.inner, self.cache = inner, cache

    def __getstate__(self) -> dict:
        return {"inner": self.inner, "cache": None}

    def chat(self, prompt: str, request_type: str) -> Response:
        return self.inner.chat(prompt, request_type)


def looked_up(rows: DataFrame, request_type: str, prompt: Column, cache: ResponseCache) -> DataFrame:
    """rows with `_kept`, the answer that is stored for the prompt, or null."""
    kept = cache.answers(request_type).select(F.col("cache_key").alias("_key"), F.struct("response", "input_tokens", "output_tokens").alias("_kept"))
    return rows.withColumn("_key", cache_key(F.lit(request_type), prompt)).join(kept, "_key", "left").drop("_key")
