"""Ranks and prefix sums inside groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Staging

_ROWS = (1 << 33) - 1  # monotonically_increasing_id: partition above, row within it below


def ranged(df: DataFrame, staging: Staging, group: str, order: list[Column], coarse: list[Column] | None = None) -> DataFrame:
    """``df`` sorted by group and ``order`` over range partitions, staged, with its position in ``_at``.

    A group may span many partitions and a partition may hold many groups, so a hot group is dealt like any other.
    ``group`` must not be null. ``coarse`` is a shorter form of the order, by which rows are dealt where the order itself has
    long values: Spark samples what rows are dealt by.
    """
    keys = [F.col(group).asc(), *order]
    dealt = df.repartitionByRange(F.col(group).asc(), *(coarse or order)).sortWithinPartitions(*keys)
    return staging.write(dealt.withColumn("_at", F.monotonically_increasing_id()), f"ranged-{group}")


def with_rank(dealt: DataFrame, group: str, rank: str = "_rank") -> DataFrame:
    """Adds the 0-based rank inside the group to a table from ``ranged``.

    One row for each partition and group in it (at most partitions plus groups) carries the counts of what precedes.
    """
    pid = F.shiftright("_at", 33)
    pieces = dealt.groupBy(pid.alias("_pid"), F.col(group)).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_pid", group, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = dealt.withColumn("_pid", pid).join(pieces, ["_pid", group])
    return joined.withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_pid", "_first", "_before", "_at")


def with_prefix(dealt: DataFrame, group: str, amount: str, prefix: str = "_prefix") -> DataFrame:
    """Adds the sum of ``amount`` over the rows before this one in its group to a table from ``ranged``.

    The running sum is taken inside each partition's piece of a group, so the largest window is one partition.
    """
    cut = dealt.withColumn("_pid", F.shiftright("_at", 33))
    pieces = cut.groupBy("_pid", group).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_pid", group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_pid", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    run = cut.withColumn("_run", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return run.join(pieces, ["_pid", group]).withColumn(prefix, F.col("_before") + F.col("_run")).drop("_pid", "_run", "_before")
