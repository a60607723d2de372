"""Time: unions of intervals, ranges of ranks, as-of existence, sliding counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """key, start, end of the unions of touching intervals within each key; start and end are numbers."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    numbered = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def union_length(df: DataFrame, key: list[str], start: str, end: str, chunk: int) -> DataFrame:
    """key, islands, covered: the length of the union of each key's intervals (WIN-11); start and end are numbers.

    Unions of intervals merge: those that begin in one chunk of time (`chunk` units long) are united first, so that a key's
    intervals spread over tasks; what remains of a chunk are its islands, and these are united over all chunks. A chunk's intervals
    that overlap in one are one row from then on."""
    rows = df.where(F.col(end) >= F.col(start)).select(*key, start, end).withColumn("_chunk", F.floor(F.col(start) / chunk))
    parts = islands(rows, [*key, "_chunk"], start, end)
    whole = islands(parts.drop("_chunk"), key, start, end)
    return whole.groupBy(*key).agg(F.count("*").alias("islands"), F.sum(F.col(end) - F.col(start)).alias("covered"))


def cursor(df: DataFrame, order: str, n: str) -> DataFrame:
    """df (a row per chunk of work) with the first and the last rank that the chunk covers (WIN-07)."""
    upto = F.sum(n).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("last_rank", upto).withColumn("first_rank", upto - F.col(n) + 1)


def bucketed(df: DataFrame, rank: str, size: int) -> DataFrame:
    """df with window_no, from 1, of `size` ranks each (WIN-14); a range join of ranks becomes an equi-join (JOIN-19)."""
    return df.withColumn("window_no", F.floor((F.col(rank) - 1) / size) + 1)


def overlapping(runs: DataFrame, windows: DataFrame, start: str, end: str, low: str, high: str, width: int) -> DataFrame:
    """runs joined to the windows that they touch (JOIN-18).

    Both sides are laid on a grid of `width`; cells meet in an equi-join, and a pair counts in the cell
    where its overlap begins, so none is met twice and no pair is tried that shares no cell."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    left, right = runs.withColumn("_cell", cells(start, end)), windows.withColumn("_cell", cells(low, high))
    met = left.join(right, "_cell").where((F.col(start) <= F.col(high)) & (F.col(end) >= F.col(low)))
    return met.where(F.col("_cell") == F.floor(F.greatest(start, low) / width)).drop("_cell")


def followed_by(df: DataFrame, key: str, at: str, first: Column, then: Column) -> DataFrame:
    """Keys whose latest `first` row is followed, at the same time or later, by a `then` row (JOIN-16), without a self-join."""
    both = df.groupBy(key).agg(F.max(F.when(first, F.col(at))).alias("first_at"), F.max(F.when(then, F.col(at))).alias("then_at"))
    return both.where(F.col("then_at") >= F.col("first_at"))


def sliding_count(df: DataFrame, key: list[str], seconds: str, width: int, cell: int = 3600) -> DataFrame:
    """df with n_recent: rows of the key in the `width` seconds up to each row's own (WIN-15); seconds is a long column.

    Rows are counted by second first. Time is laid out in cells of `cell` seconds, no shorter than width: a second stands in its own
    cell and, if a window of the next cell reaches it, there as well, without being asked. So a key's counts spread over its
    cells, and each row of df meets one count."""
    cell = max(cell, width)
    counts = df.groupBy(*key, seconds).agg(F.count("*").alias("_n"))
    own = F.floor(F.col(seconds) / cell).cast("long")
    later = F.floor((F.col(seconds) + width) / cell).cast("long")
    laid = counts.withColumn("_cell", F.explode(F.when(later > own, F.array(own, later)).otherwise(F.array(own)))).withColumn("_asked", F.col("_cell") == F.floor(F.col(seconds) / cell))
    recent = F.sum("_n").over(Window.partitionBy(*key, "_cell").orderBy(seconds).rangeBetween(-width, 0))
    seen = laid.withColumn("n_recent", recent).where("_asked").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col(seconds).alias("_s"), "n_recent")
    met = F.col(seconds).eqNullSafe(F.col("_s"))
    for i, k in enumerate(key):
        met &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(seen, met).select(*df.columns, "n_recent")
