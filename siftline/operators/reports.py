"""Aggregations that make reports: distributions, reasons, yields, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked


def distribution(df: DataFrame, group: str, category: str) -> DataFrame:
    """group, category, n, total, basis_points: shares within each group and within all rows, in one rollup-like pass (AGG-06)."""
    counts = df.cube(group, category).agg(F.count("*").alias("n"), F.grouping(group).alias("_g"), F.grouping(category).alias("_c"))
    rows = counts.where("_c = 0").select(F.when(F.col("_g") == 1, "All").otherwise(F.col(group)).alias(group), category, "n")
    total = F.sum("n").over(Window.partitionBy(group))
    return rows.select(group, category, "n", total.alias("total"), F.floor(F.col("n") * 10000 / total).alias("basis_points"))


def reason_counts(df: DataFrame, reasons: Column) -> DataFrame:
    """reason, n: each row counts for every reason that it has (AGG-13)."""
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def reason_sets(df: DataFrame, reasons: Column, top: int) -> DataFrame:
    """reason_set, n: the most frequent combinations (AGG-14)."""
    return df.groupBy(F.array_join(reasons, "|").alias("reason_set")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason_set").limit(top)


def rule_yield(df: DataFrame, rules: dict[str, Column], good: Column) -> DataFrame:
    """rule, retained, removed, good_retained of every rule, from one scan (AGG-24)."""
    sums = [F.struct(F.lit(name).alias("rule"), F.count_if(cond).alias("retained"), F.count_if(~cond).alias("removed"), F.count_if(cond & good).alias("good_retained")) for name, cond in rules.items()]
    return df.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def window_yield(df: DataFrame, window: str, flags: dict[str, Column]) -> DataFrame:
    """window, attempted, each flag's count and its rate in basis points; null where nothing was attempted (AGG-21, AGG-23)."""
    counts = df.groupBy(window).agg(F.count("*").alias("attempted"), *(F.count_if(c).alias(n) for n, c in flags.items()))
    return counts.select("*", *(F.floor(F.col(n) * 10000 / F.nullif("attempted", F.lit(0))).alias(f"{n}_bp") for n in flags))


def memberships(df: DataFrame, group: str, member: str) -> DataFrame:
    """group, n: distinct members; a member counts once in each group that it is in (AGG-05)."""
    return df.groupBy(group).agg(F.count_distinct(member).alias("n"))


def nearest_rank(df: DataFrame, key: str, value: str, share: float = 0.95) -> DataFrame:
    """key, n, p: the nearest-rank percentile (AGG-20), exact, for all keys at once.

    Values are numbered within their key over ranges of the order (`ranking.ranked`), so no task holds a key's values, and the one of
    rank ceil(share * n) is p. Null values aren't counted; a key of nothing but nulls has a null p."""
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count(value).alias("n"))
    numbered = ranked(df.where(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("p")), [F.col("p")], ["_k"], rank="_rank")
    found = sizes.join(numbered, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_rank") == F.ceil(F.col("n") * F.lit(share))), "left")
    return found.select(F.col("_key").alias(key), "n", "p")


def digest(df: DataFrame, order: str) -> DataFrame:
    """rows, digest of a table: rows are hashed each, hashes summed in any order, so no task sees all rows (AGG-27)."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(order).alias("rows"), F.sum(h).cast("string").alias("digest"))
