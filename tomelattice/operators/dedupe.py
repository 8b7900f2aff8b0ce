"""Exact duplicates, ingest reports, and rows that nothing refers to any more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of_copies(docs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """docs with `first`, the order columns of the first row with the same key, and `copy`, whether that is another row.

    Rows whose key is null are never copies and have no first.  Only one row a key is shuffled from
    each task, so a key may have any number of rows.
    """
    at = F.struct(*order)
    first = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias("first"))
    return docs.join(first, key, "left").withColumn("copy", F.coalesce(F.col("first") < at, F.lit(False)))


def new_documents(batch: DataFrame, known: DataFrame, key: str = "md5", order: list[str] | None = None) -> DataFrame:
    """The batch's rows whose key is neither known nor that of an earlier row of the batch."""
    fresh = first_of_copies(batch, key, order or ["ordinal"]).where("not copy").drop("first", "copy")
    return fresh.join(known.select(key).distinct(), key, "left_anti")


def ingest_report(docs: DataFrame, group: str, copy: Column, failed: Column) -> DataFrame:
    """Documents taken, skipped as copies and failed, by group; a failed one isn't skipped."""
    failed = F.coalesce(failed, F.lit(False))
    copy = F.coalesce(copy, F.lit(False)) & ~failed
    return docs.groupBy(group).agg(
        F.count_if(~failed & ~copy).alias("succeeded"), F.count_if(copy).alias("skipped"), F.count_if(failed).alias("failed"), F.count("*").alias("documents")
    )


def orphans(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows of an earlier version whose key is in the present one no more."""
    return previous.join(current.select(key).distinct(), key, "left_anti")


def orphaned_sources(previous: DataFrame, current: DataFrame, key: str = "chunk_id", source: str = "source") -> DataFrame:
    """Sources that rows still there have given up and that no row uses: the chunk stays, the copy goes."""
    kept = previous.join(current.select(key).distinct(), key, "left_semi").where(F.col(source).isNotNull())
    return kept.select(source).distinct().join(current.where(F.col(source).isNotNull()).select(source).distinct(), source, "left_anti")


def overlaid(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows, those of a new key replaced by the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Of every key the row of the highest version; any of several."""
    others = [c for c in rows.columns if c not in (key, version)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others) if others else F.lit(0), version).alias("_row"), F.max(version).alias(version))
    return best.select(key, version, *(F.col(f"_row.{c}").alias(c) for c in others)).select(*rows.columns)


def in_order(rows: DataFrame, group: str, item: str, pos: str) -> DataFrame:
    """Distinct (group, item) with the first place, for lists whose order counts."""
    return rows.groupBy(group, item).agg(F.min(pos).alias(pos))
