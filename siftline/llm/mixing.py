"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A mix takes `budget` words in all. Every source is to get its weight's share of it, but no more
than `max_epochs` times its own size: sources above that are clamped there, and what they leave is
dealt again by weight among the others, until none is above. A source of size s and target t then
runs floor(t / s) whole epochs over its documents; the rest, t - floor(t / s) * s words, comes from
a seeded order of its documents: whole ones as long as they fit, and from the one that crosses the
line its first words. So the words taken from a source are its target, rounded to whole words, and
reruns agree.

The seeded order is by md5 of seed, doc_id and text. Rows that agree in both are one place in it:
if the line falls among them, the words left go to whole copies first, then a part to one more.

Only DataFrame functions. A source may hold any share of all rows: its documents are first summed
by slices of the seeded order (a partial sum in each task), and only the one slice of a source in
which the line falls is put in order, a row for each place. The number of slices follows the number
of rows. Copies at the line are numbered by their task's counts, never in one task.

Defined results: a null source is a source of its own, last in order; a null text has size 0 and
is never taken; sources of size 0 have target 0; rows that repeat a doc_id are separate rows, and
which of the copies of one doc_id and text is taken in part is not defined, only how many words
they give together; a null doc_id takes part; texts of any length are read whole; an empty table
gives an empty result; other columns are passed through, but one with the name of a result column is
replaced by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own, small, stored

WORD = r"[^\x20\x09-\x0D]+"


def words(col: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def by_rank(sizes: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """sizes (a row per source) with weight: the cycle's numbers dealt to the sources in order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, summed before
    numbers = F.array(*(F.lit(float(x)) for x in cycle))
    return sizes.withColumn("weight", F.element_at(numbers, (F.row_number().over(order) - 1) % len(cycle) + 1))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size, weight) with target. Each round brings two sums to the driver; a round clamps a source at least."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    free = (F.col("weight") > 0) & (F.col("source_size") > 0)
    level, clamped = 0.0, -1
    while True:
        full = free & (F.col("weight") * level >= cap) if clamped >= 0 else F.lit(False)
        got = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(free & ~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if got.n == clamped or not got.weight:
            level = level if got.weight else float("inf")
            break
        level, clamped = (budget - got.held) / got.weight, got.n
    return sources.withColumn("target", F.when(free, F.least(cap, F.col("weight") * F.lit(level))).otherwise(0.0))


def planned(docs: DataFrame, weights: DataFrame | tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, per_slice: int = 4096) -> tuple[DataFrame, list[str]]:
    """docs with size, source_size, target, whole (full repetitions), part (words of one more), under the names also returned.

    weights: (source, weight), or numbers dealt to the sources in order. share: of all words, the mix's budget."""
    size, source_size, target, whole, part, key, source, rest, line, words_left, copies, mark, s, t, ahead = names = own(docs.columns, "m_size", "m_source_size", "m_target", "m_whole", "m_part", "m_key", "m_source", "m_rest", "m_line", "m_words_left", "m_copies", "m_mark", "m_s", "m_t", "m_ahead")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    sized = docs.select("*", words().alias(size), order.alias(key))
    narrow = stored(sized.select("source", F.col(size).alias("size"), F.col(key).alias("key")), "sizes")
    sizes = stored(narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    sources = by_rank(sizes, weights) if isinstance(weights, tuple) else sizes.join(weights, sizes.source.eqNullSafe(weights.source), "left").select(sizes["*"], F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    filled = stored(water_fill(sources, share * total, max_epochs), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = filled.select("source", "source_size", "target", epochs.alias("whole"), (F.round("target") - epochs * F.col("source_size")).cast("long").alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("rows") / per_slice)).alias("slices"))
    plan = small(stored(plan, "plan"))

    # Where in the seeded order each source's line falls: sums by slice, then by place in that slice alone.
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = narrow.join(plan, narrow.source.eqNullSafe(plan.source)).select(narrow.source, "size", "key", "rest", F.floor(at * F.col("slices") / F.lit(1 << 32)).alias("slice"))
    sums = placed.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    cut = small(stored(cut.select("source", "slice", "before"), "cuts"))
    edge = placed.join(cut, placed.source.eqNullSafe(cut.source) & (placed.slice == cut.slice)).select(placed.source, "key", "size", "rest", "before")
    edge = edge.groupBy("source", "key").agg(F.sum("size").alias("words"), F.count("*").alias("copies"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    upto = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = edge.withColumn("upto", upto).where((F.col("upto") <= F.col("rest")) & (F.col("rest") < F.col("upto") + F.col("words")))
    found = found.select(F.col("source").alias("s"), F.col("key").alias("line"), (F.col("rest") - F.col("upto")).alias("words_left"), "copies")
    plan = plan.join(found, plan.source.eqNullSafe(found.s), "left")
    renamed = {"source": source, "source_size": source_size, "target": target, "whole": whole, "rest": rest, "line": line, "words_left": words_left, "copies": copies}
    plan = small(stored(plan.select(*(F.col(a).alias(b) for a, b in renamed.items())), "lines"))

    out = sized.join(plan, sized["source"].eqNullSafe(plan[source]))
    columns = [*docs.columns, size, source_size, target, whole]
    after = F.when(F.col(line).isNull(), F.when(F.col(rest) > 0, F.col(size)).otherwise(0)).when(F.col(key) < F.col(line), F.col(size)).when(F.col(key) == F.col(line), F.least(words_left, size)).otherwise(0)
    if plan.where(F.col(copies) > 1).isEmpty():
        return out.select(*columns, after.cast("long").alias(part)), names[:5]
    among = F.coalesce((F.col(copies) > 1) & (F.col(key) == F.col(line)), F.lit(False))
    tied = stored(out.where(among).select(*columns, F.col(words_left), F.col(source), F.monotonically_increasing_id().alias(mark)), "copies")
    counts = tied.groupBy(F.col(source).alias(s), F.shiftright(mark, 33).alias(t)).agg(F.count("*").alias("n"))
    counts = counts.select(s, t, F.coalesce(F.sum("n").over(Window.partitionBy(s).orderBy(t).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    counts = stored(counts, "copies-by-task")  # a row for each task
    inside = F.row_number().over(Window.partitionBy(source, F.shiftright(mark, 33)).orderBy(mark)) - 1  # one task's rows
    numbered = tied.withColumn(key, inside).join(small(counts), F.col(source).eqNullSafe(F.col(s)) & (F.shiftright(mark, 33) == F.col(t)))
    share_of = F.greatest(F.lit(0), F.least(F.col(size), F.col(words_left) - (F.col(ahead) + F.col(key)) * F.col(size)))
    numbered = numbered.select(*columns, share_of.cast("long").alias(part))
    return out.where(~among).select(*columns, after.cast("long").alias(part)).unionByName(numbered), names[:5]


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with size, source_size, target, whole (full repetitions), part (words of one more), taken.

    A column of docs with one of these names is replaced. Options: see `planned`."""
    made, inner = planned(docs, **how)
    names = ["size", "source_size", "target", "whole", "part"]
    size, _, _, whole, part = inner
    taken = (F.col(whole) * F.col(size) + F.col(part)).cast("long").alias("taken")
    return made.select(*(c for c in docs.columns if c not in [*names, "taken"]), *(F.col(a).alias(b) for a, b in zip(inner, names, strict=True)), taken)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix takes them: whole ones as often as it does, then a part as a text of its first words."""
    made, (size, _, _, whole, part) = planned(docs, **how)
    (last,) = own(made.columns, "m_last")
    copies = F.concat(F.array_repeat(F.lit(False), F.col(whole).cast("int")), F.array_repeat(F.lit(True), F.when(F.col(part) > 0, 1).otherwise(0)))
    rows = made.withColumn(last, F.explode(copies))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each holds one word and the space before it
    cut = F.col(last) & (F.col(part) < F.col(size))
    text = F.when(cut, F.array_join(F.slice(pieces, 1, F.col(part).cast("int")), "")).otherwise(F.col("text"))
    shown = {"text": text, "n_chars": F.when(cut, F.char_length(text)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*((shown[c].cast(docs.schema[c].dataType) if c in shown else F.col(c)).alias(c) for c in docs.columns))
