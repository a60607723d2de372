"""Row numbers over a whole table, in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, own, small, stored

#: Rows of a sorted task, about.
TASK_ROWS = 1 << 16


def numbered(rows: DataFrame, order: list[str], number: str, total: str, group: str | None = None) -> DataFrame:
    """rows (a stored table) with `number`, from 0 in the given order (nulls first), and `total`, how many there are.

    Both count within `group`, or over all rows. Rows are dealt into ranges of the order, and a number is a row's
    place in its range behind the sums of the ranges before it: a row for each range and group. Rows that agree in
    all of `order` are told apart by their place in the stored table, so that they split over ranges as others do."""
    tie, at, part, g, first, before, n = own([*rows.columns, number, total], "n_tie", "n_at", "n_part", "n_group", "n_first", "n_before", "n_rows")
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order] + [F.col(tie)]
    marked = rows.withColumn(tie, F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(blocks_for(rows.count(), TASK_ROWS), *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()), "ranges")
    label = F.col(group) if group else F.lit(0)
    counts = dealt.groupBy(label.alias(g), F.shiftright(at, 33).alias(part)).agg(F.min(at).alias(first), F.count("*").alias(n))
    own_group = Window.partitionBy(g)
    sums = F.coalesce(F.sum(n).over(own_group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(counts.select(g, part, first, sums.alias(before), F.sum(n).over(own_group).alias(total)), "starts")
    met = label.eqNullSafe(F.col(g)) & (F.shiftright(F.col(at), 33) == F.col(part))
    return dealt.join(small(starts), met).select(*rows.columns, (F.col(at) - F.col(first) + F.col(before)).alias(number), total)
