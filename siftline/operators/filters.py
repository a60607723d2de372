"""List filters from parameters that may be left out (PRJ-01..PRJ-05): one conjunction, pushed down to the scan where it can be."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .views import holds


@dataclass(frozen=True)
class Filters:
    """What a list may be filtered by. Names of parameters are names of columns, but for the search's `q`.

    search: columns in which q may stand, whatever its case; joined: they are read as one text, with spaces between. equal: columns
    that a parameter equals; contains: columns in which it stands, whatever its case; member: columns of lists that hold it."""

    search: tuple[str, ...] = ()
    equal: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    member: tuple[str, ...] = ()
    joined: bool = False

    def condition(self, params: dict[str, str | None]) -> Column:
        """True where all given parameters hold; blank ones and those that aren't known don't count. % and _ are plain characters."""
        given = {k: v.strip() for k, v in params.items() if v is not None and v.strip()}
        stands = lambda c, v: F.contains(F.lower(c), F.lit(v.lower()))
        tests = []
        if self.search and "q" in given:
            columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.search]
            where = [F.concat_ws(" ", *columns)] if self.joined else columns
            tests.append(reduce(lambda a, b: a | b, [stands(c, given["q"]) for c in where]))
        tests += [F.col(c) == given[c] for c in self.equal if c in given]
        tests += [stands(F.col(c), given[c]) for c in self.contains if c in given]
        tests += [F.array_contains(c, given[c]) for c in self.member if c in given]
        return holds(reduce(lambda a, b: a & b, tests, F.lit(True)))


def filtered(df: DataFrame, filters: Filters, params: dict[str, str | None]) -> DataFrame:
    return df.where(filters.condition(params))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n: the distinct values of each column, for the choices of a list's filters (SET-05); a list column counts its members."""
    kinds = dict(df.dtypes)
    listed = [F.col(c) if kinds[c].startswith("array") else F.array(c) for c in columns]
    named = [F.transform(values, labelled(c)) for values, c in zip(listed, columns, strict=True)]
    rows = df.select(F.explode(F.concat(*(F.coalesce(x, F.array().cast("array<struct<facet:string,value:string>>")) for x in named))).alias("f")).select("f.*")
    return rows.where("trim(value) <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def labelled(name: str):
    return lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value"))


def shortlist(df: DataFrame, eligible: Column, order: list[Column], n: int, domain: str | None = None) -> DataFrame:
    """The first n eligible rows in the order, with selection_rank (WIN-03); an error if there aren't n.

    domain: of rows that share one, only the first counts."""
    rows = df.where(holds(eligible))
    if domain:
        rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy(domain).orderBy(*order))).where("_first = 1").drop("_first")
    top = ranked(rows, order, rank="selection_rank").where(F.col("selection_rank") <= n)
    return top.withColumn("selection_rank", F.when(F.count("*").over(Window.partitionBy()) >= n, F.col("selection_rank")).otherwise(F.raise_error(F.lit(f"fewer than {n} rows are eligible"))))  # n rows at most
