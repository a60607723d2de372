"""Pages as numbered nodes, and what lies around and inside them.

`read_pages` reads markup once (functions.dom), a row for each page. Its nodes stand in document order, so a node's number is
its place in the array: an ancestor is found by its number, and what is inside a node is one slice, from n + 1 to last. All that
a page says of itself is worked out in its own row; nothing moves between tasks. `nodes` is the same as a relation, a row for each
node, for what compares nodes with one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.dom import PAGE, reader

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def read_pages(pages: DataFrame, key: str, url: str, markup: str) -> DataFrame:
    """page (a number of its own), key, url, text, nodes, things of each row of pages. Rows that repeat a key stay apart."""
    rows = pages.select(F.monotonically_increasing_id().alias("page"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(markup).cast("string").alias("markup"))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL(PAGE).fields])
    return rows.mapInArrow(reader(to_arrow_schema(schema)), schema)


def nodes(pages: DataFrame) -> DataFrame:
    """page and a node's fields, a row for each node."""
    return pages.select("page", F.inline("nodes"))


def attribute(node: Column, name: str) -> Column:
    """An attribute's value; empty where a node has none."""
    return F.coalesce(F.element_at(node["attrs"], name), F.lit(""))


def within(node: Column, every: Column | str = "nodes") -> Column:
    """The nodes inside a node, in order."""
    return F.slice(every, node["n"] + 2, node["last"] - node["n"])


def said(node: Column, text: Column | str = "text") -> Column:
    """A node's text."""
    return F.substring(text, node["t0"] + 1, node["t1"] - node["t0"])


def first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return first(F.transform(F.array(value), lambda x: body(x)))


def ancestors(node: Column, most: int, every: Column | str = "nodes") -> Column:
    """The nearest ancestors of a node, nearest first."""
    return F.transform(F.slice(node["up"], 1, most), lambda at: F.get(every, at))


def span(t0: Column, t1: Column, n: Column, last: Column) -> Column:
    return F.struct(n.alias("n"), last.alias("last"), t0.alias("t0"), t1.alias("t1"))


def holder(node: Column, near: int, fits, else_far: int, every: Column | str = "nodes", text: Column | str = "text") -> Column:
    """n, last, t0, t1 of the nearest of `near` ancestors that fits, else of the else_far-th, else of the whole page."""
    spanned = lambda a: span(a["t0"], a["t1"], a["n"], a["last"])
    fitting = F.transform(F.filter(ancestors(node, near, every), fits), spanned)
    other = F.transform(F.slice(node["up"], else_far, 1), lambda at: spanned(F.get(every, at)))
    whole = F.array(span(F.lit(0), F.length(text).cast("int"), F.lit(-1), F.size(every).cast("int") - 1))
    return first(F.concat(fitting, other, whole))


def preceding(node: Column, marks: Column | str) -> Column:
    """The last of marks (nodes in order) that begins before a node; null if none does."""
    return let(F.filter(marks, lambda m: m["n"] < node["n"]), lambda before: F.get(before, F.size(before) - 1))


def covering_text(at: Column, every: Column | str = "nodes") -> Column:
    """The text node in which the page's character `at` (from 0) stands."""
    return first(F.filter(every, lambda x: (x["tag"] == "#text") & (x["t0"] <= at) & (at < x["t1"])))
