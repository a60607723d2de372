"""Orders, samples and quotas.

Numbers over all rows come from ranges: rows are dealt into ranges of the order by sampled splitters, numbered inside their range,
and a range begins where the counts of those before it end. So work is spread by rows, whatever the keys; what one task sees of
the whole is a count for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


#: Rows of a sorted range, about.
RANGE_ROWS = 1 << 17


def ranked(df: DataFrame, order: list[Column], group: list[str] | None = None, rank: str = "rank", rows: int | None = None) -> DataFrame:
    """df with rank 1..n in a total order, over all rows or within each group (WIN-02, WIN-19).

    A group may hold any share of the rows: its rows lie in as many ranges as they need. Rows that agree in all of `order` are
    numbered in any way. df is read twice (once for the splitters) and its ranges are written once."""
    group, n = group or [], df.count() if rows is None else rows
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    dealt = df.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *keys, F.rand(7)).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt, "ranges")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(group))).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(*(f"_g{k}" for k in range(len(group)))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(of_group), F.lit(0)) - F.col("_first") + 1)
    met = part == F.col("_part")
    for k, g in enumerate(group):
        met &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return dealt.join(starts, met).withColumn(rank, F.col("_at") + F.col("_before")).select(*df.columns, rank)


def hash_sample(df: DataFrame, strata: list[str], id_col: str, version: str, k: int) -> DataFrame:
    """The first k rows of each stratum in the order of a versioned hash of their id (WIN-05)."""
    digest = F.sha2(F.concat(F.lit(version), F.col(id_col).cast("string")), 256)
    return df.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(digest, id_col))).where(F.col("sample_rank") <= k)


def quotas(sizes: DataFrame, group: str, n: str, total: int) -> DataFrame:
    """group, n, quota: total dealt in proportion by largest remainders, ties by name (WIN-06). sizes: a row per group."""
    one = Window.partitionBy()
    exact = F.least(F.col(n).cast("double"), F.lit(total) * F.col(n) / F.sum(n).over(one))
    floors = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.least(F.lit(total), F.sum(n).over(one)) - F.sum("_floor").over(one)
    more = F.row_number().over(one.orderBy((F.col("_exact") - F.col("_floor")).desc(), group)) <= left
    return floors.select(group, n, (F.col("_floor") + F.when(more, 1).otherwise(0)).cast("long").alias("quota"))


def quota_sample(df: DataFrame, group: str, order: list[Column], total: int) -> DataFrame:
    """The first rows of each group, as many as its quota. The quotas are one row a group.

    No quota is above total, and a rank up to a fixed number is cut in every task before rows move: at most total rows of a group
    leave a task, and so few reach the one that ranks the group."""
    sized = quotas(df.groupBy(group).agg(F.count("*").alias("n")), group, "n", total)
    numbered = df.withColumn("group_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("group_rank") <= total)
    return numbered.join(sized.select(group, "quota"), group).where(F.col("group_rank") <= F.col("quota"))


def first_accepted(df: DataFrame, key: list[str], order: list[str], reason: str, duplicate: str) -> DataFrame:
    """reason filled with `duplicate` for unblocked rows that come after another unblocked row of their key (WIN-17).

    Only accepted rows shut others out: blocked ones are set aside before rows are numbered."""
    blocked = F.col(reason).isNotNull()
    n = F.row_number().over(Window.partitionBy(*key, blocked).orderBy(*order))
    return df.withColumn("_n", n).withColumn(reason, F.when(blocked, F.col(reason)).when(F.col("_n") > 1, duplicate)).drop("_n")


def round_robin(df: DataFrame, bucket: str, key: str, order: list[str], weights: dict[str, int], limit: int) -> DataFrame:
    """At most limit rows, drawn from buckets in turn by weight, one row a key over all buckets (WIN-18).

    The draw looks at what was drawn before, so it is sequential; but a bucket never uses more than
    its first `limit` keys, so that many rows a bucket reach the one task, however long the table."""
    own = Window.partitionBy(bucket, key).orderBy(*order)
    firsts = df.where(F.col(key).isNotNull() & F.col(bucket).isin(list(weights))).withColumn("_k", F.row_number().over(own)).where("_k = 1").drop("_k")
    head = firsts.withColumn("_place", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("_place") <= limit)
    columns = df.columns

    def draw(rows):
        queues = {b: rows[rows[bucket] == b].sort_values("_place").index.tolist() for b in weights}
        taken, seen = [], set()
        while len(taken) < limit and any(queues.values()):
            for b, w in weights.items():
                for _ in range(w):
                    while queues[b] and rows.at[queues[b][0], key] in seen:
                        queues[b].pop(0)
                    if queues[b] and len(taken) < limit:
                        seen.add(rows.at[queues[b][0], key])
                        taken.append(queues[b].pop(0))
        out = rows.loc[taken, columns].copy()
        out["pick"] = range(1, len(out) + 1)
        return out

    schema = df.select("*", F.lit(0).cast("long").alias("pick")).schema
    return head.groupBy(F.lit(1).alias("_all")).applyInPandas(draw, schema)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of df; size within 1..100 (TOP-06)."""
    size = min(100, max(1, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
