"""Ranks, shards and equal parts of groups of any size.

A window over one hot group would sort it in a single task.  Here rows are range-partitioned by
group and order together, so that a hot group is spread over many tasks; a row's rank is its place
in its task's part of the group plus the sizes of the parts before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomelattice.session import stage

_TASK = 33  # monotonically_increasing_id has the task above this many bits


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str = "rank", size: str | None = None) -> DataFrame:
    """df with each row's rank, from 1, in its group by the order; rows equal in both are ranked in any order.

    With size, the group's number of rows as well.  Nulls come first and are a group like any other.
    """
    taken = {"_at", "_task", "_part", "_first", "_before", "_rows", "_size", rank, size} & set(df.columns)
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")
    key = [*group, *order]
    laid = stage(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_task", F.shiftright("_at", _TASK))
    # Null-safe keys, so that rows with nulls find their parts again.
    names = {g: f"_g{i}" for i, g in enumerate(group)}
    parts = laid.groupBy(*(F.col(g).alias(names[g]) for g in group), F.col("_task").alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    by = Window.partitionBy(*names.values()) if group else Window.partitionBy(F.lit(0))  # a row for each task that has part of the group
    before = F.coalesce(F.sum("_rows").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).withColumn("_size", F.sum("_rows").over(by))
    met = laid["_task"] == parts["_part"]
    for g in group:
        met = met & laid[g].eqNullSafe(parts[names[g]])
    out = laid.join(parts, met)
    extra = [F.col("_size").alias(size)] if size else []
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(rank), *extra)


def sharded(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """df with `shard`: consecutive rows of the order, `rows` to a shard."""
    return ranked(df, [], order, "_rank").withColumn("shard", F.floor((F.col("_rank") - 1) / rows)).drop("_rank")


def part_of(rank: Column, size: Column, n: int) -> Column:
    """The part, from 1 to n, of a rank when so many rows are cut into n contiguous parts; the first parts have a row more if need be."""
    small, more, at = F.floor(size / n), F.pmod(size, F.lit(n)), rank - 1
    return (F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1)))) + 1).cast("int")


def equal_parts(df: DataFrame, group: list[str], order: list[str], n: int, part: str = "part") -> DataFrame:
    """df with `part`: each group in order, cut into n parts."""
    return ranked(df, group, order, "_rank", "_count").withColumn(part, part_of(F.col("_rank"), F.col("_count"), n)).drop("_rank", "_count")


def hash_sharded(df: DataFrame, key: str, shards: int) -> DataFrame:
    """df with `shard` by the key's hash, the same for equal keys; null keys are in shard 0."""
    return df.withColumn("shard", F.when(F.col(key).isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.lit(shards))).cast("int"))
