"""Entities from many records: owners, duplicates, merges and upserts, all by aggregation on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import blank


def first_per_key(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """A row for each key: the first value in order, and how many rows have the key (WIN-09, AGG-08)."""
    return df.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(f"first_{value}"), F.count("*").alias("members"))


def latest_per_key(df: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last row; ties in time go by the later order columns (WIN-01, JOIN-14)."""
    last = F.max(F.struct(*order, *(v for v in values if v not in order))).alias("last")
    return df.groupBy(*key).agg(last).select(*key, *(F.col(f"last.{v}").alias(v) for v in dict.fromkeys([*order, *values])))


def owners(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """id, owner (the first id of the key; null for the owner itself) and group_size (WIN-08, WIN-12).

    The key is aggregated and joined back rather than windowed: a key that many rows share is summed
    up in each task, and its join is one that Spark can split."""
    groups = df.groupBy(key).agg(F.min(id_col).alias("_owner"), F.count("*").alias("group_size")).withColumnRenamed(key, "_key")
    joined = df.select(id_col, key).join(groups, F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(id_col, F.when(F.col(id_col) != F.col("_owner"), F.col("_owner")).alias("owner"), "group_size")


def collisions(df: DataFrame, key: list[Column], id_col: str, distinct: Column) -> DataFrame:
    """id, n (distinct values under the row's key), collides; same-name rows are flagged, never merged (WIN-13)."""
    named = df.select(id_col, F.concat_ws("|", *key).alias("_k"), distinct.alias("_d"))
    sizes = named.groupBy("_k").agg(F.count_distinct("_d").alias("n"))
    return named.join(sizes, "_k").select(id_col, "n", (F.col("n") > 1).alias("collides"))


def ingest(df: DataFrame, key: list[str], order: list[str], firsts: list[str], lasts: list[str]) -> DataFrame:
    """Upserts folded into one row a key: identity columns from its first row, attributes from the last row that has them (ST-09)."""
    at = F.struct(*order)
    return df.groupBy(*key).agg(
        *(F.min_by(c, at).alias(c) for c in firsts),
        *(F.max_by(c, F.when(~blank(F.col(c).cast("string")), at)).alias(c) for c in lasts),
        F.count("*").alias("records"),
    )


def upgrade(df: DataFrame, key: list[str], order: list[str], rank: str, by_rank: list[str], fill: list[str]) -> DataFrame:
    """Channels folded into one row a key: by_rank columns from the first row of the highest rank, the others from the first row that has them (ST-10)."""
    at = F.struct(*order)
    return df.groupBy(*key).agg(
        *(F.min_by(c, F.struct((-F.col(rank)).alias("r"), *order)).alias(c) for c in [rank, *by_rank]),
        *(F.min_by(c, F.when(~blank(F.col(c).cast("string")), at)).alias(c) for c in fill),
    )


def idempotent(df: DataFrame, key: list[str], content: Column, order: list[str]) -> DataFrame:
    """Appends by key: the first row counts, repeats of its content are skipped, other contents conflict (ST-07, ST-08)."""
    rows = df.withColumn("_c", content)
    firsts = rows.groupBy(*key).agg(F.min_by("_c", F.struct(*order)).alias("content"), F.count("*").alias("rows"), F.count_distinct("_c").alias("contents"))
    return firsts.select(*key, "content", "rows", "contents", F.when(F.col("contents") > 1, "CONFLICT").when(F.col("rows") > 1, "SKIPPED_REPEATS").otherwise("APPENDED").alias("outcome"))


def preferred(legs: list[tuple[int, DataFrame]], key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The union of legs with one row a key, from the leg with the lowest preference number (SET-02, WIN-21)."""
    out = None
    for preference, leg in legs:
        leg = leg.withColumn("preference", F.lit(preference))
        out = leg if out is None else out.unionByName(leg, allowMissingColumns=True)
    best = F.min(F.struct("preference", *dict.fromkeys([*order, *values]))).alias("best")
    return out.groupBy(*key).agg(best, F.count("*").alias("rows")).select(*key, "best.preference", *(F.col(f"best.{v}").alias(v) for v in values), "rows")


def consensus(df: DataFrame, key: list[str], value: str, default: str = "UNKNOWN") -> DataFrame:
    """The one value that all rows of a key agree on, CONFLICT, or the default where none has any (AGG-25)."""
    told = F.when(~blank(F.col(value)), F.col(value))
    agreed = F.when(F.min(told) == F.max(told), F.min(told)).when(F.min(told).isNotNull(), "CONFLICT").otherwise(default)
    return df.groupBy(*key).agg(agreed.alias("label"), F.count_distinct(told).alias("n_values"))


def overlay(df: DataFrame, over: DataFrame, key: list[str], columns: dict[str, object]) -> DataFrame:
    """df with columns replaced where over has a row and a value, else their own, else the default (JOIN-08, JOIN-20, JOIN-21)."""
    o = over.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = df.join(o, key, "left")
    values = {c: F.coalesce(F.col(f"_{c}"), *([F.col(c)] if c in df.columns else []), F.lit(default)) for c, default in columns.items()}
    return joined.withColumns(values).drop(*(f"_{c}" for c in columns))


def valid_history(history: DataFrame, key: list[str], order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """history with `valid`: whether each step from the state before is the same state or in allowed (source, target) (ST-12)."""
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(*order))
    steps = history.withColumn("_before", before)
    ok = allowed.select(F.col("source").alias("_before"), F.col("target").alias(state), F.lit(True).alias("_ok")).distinct()
    joined = steps.join(ok, ["_before", state], "left")
    return joined.select(*history.columns, (F.col("_before").isNull() | (F.col("_before") == F.col(state)) | F.coalesce("_ok", F.lit(False))).alias("valid"))
