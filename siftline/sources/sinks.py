"""Exports: escaped, ordered CSV and JSON lines, written by Spark (SNK-01..SNK-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import formula_safe

# Column layouts of named exports.
LAYOUTS = {
    "company": ["company_id", "company_name", "website", "industry", "location", "tier", "eligibility", "review_status"],
    "channel": ["candidate_id", "channel_type", "email", "channel_url", "source_url", "review_status"],
}


def export_csv(df: DataFrame, path: str, columns: list[str], order: list[Column], one_file: bool = False) -> None:
    """Cells as strings that no spreadsheet runs, rows in order over the files (or in one, for small reports)."""
    rows = df.select(*(formula_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns), *(o.alias(f"_o{k}") for k, o in enumerate(order)))
    keys = [f"_o{k}" for k in range(len(order))]
    placed = rows.coalesce(1).sortWithinPartitions(*keys) if one_file else rows.orderBy(*keys)
    placed.drop(*keys).write.mode("errorifexists").option("header", True).option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def export_views(df: DataFrame, path: str, views: dict[str, Column], columns: list[str], order: list[Column]) -> None:
    """A CSV folder for each named predicate."""
    for name, keep in views.items():
        export_csv(df.where(keep), f"{path}/{name}", columns, order)


def export_profiles(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with their keys in order."""
    rows = df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)))
    rows.orderBy(*(f"_o{k}" for k in range(len(order)))).select("value").write.text(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> int:
    """Appends the rows whose key the table at path doesn't have, and says how many; with no table there, all (SNK-13, SNK-14)."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = df.dropDuplicates(key)
    fresh = fresh.join(spark.read.parquet(path).select(*key), key, "left_anti") if exists else fresh
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n


def imported_decisions(current: DataFrame, edited: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """current with the allow-listed columns of an edited export taken over where they say something (SNK-16)."""
    over = edited.select(key, *(F.nullif(F.trim(c), F.lit("")).alias(f"_{c}") for c in allowed if c in edited.columns))
    joined = current.join(over, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in joined.columns else F.col(c) for c in current.columns))


def markdown(title: str, df: DataFrame, order: list[str], most: int = 200) -> str:
    """A report table of at most `most` rows of an aggregate (SNK-18)."""
    rows = df.orderBy(*order).limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows), ""])
