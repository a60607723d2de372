"""A Merkle manifest of a table: a tree of hashes for each group, a tree over their roots, a proof for every row.

A row's leaf is the hash of its fields, each written as its UTF-8 length, a colon and the value, or as
a dash for null, so that no two rows write alike. Within a group leaves stand in order; runs of
`arity` neighbours have one parent, the hash of their digests, level by level until a node remains.
The groups' nodes, in the order of the groups, make one more tree, whose top is the root.

A level is a window: nodes are partitioned by group and parent index, and the ordered full frame's
collect_list gives the run, which is the parent's preimage and holds every member's siblings. The
first member of a run stands for its parent in the next level. Levels are written as tables, each
an eighth of the one below. Proofs are put together from the root down by the same window: a node's
path is its own siblings and then its parent's path, which moves once for a run and not once for
each row below it. A window holds `arity` rows, however many a group has; a group's leaves are
numbered over many tasks (`numbering`). What moves is a narrow row for each row, no text.

A proof is checked by `folded`: from any leaf and a path to the root that they imply.

Defined results: a null group is a group of its own, before all others; null fields are dashes; an
empty text is "0:"; rows that agree in the order are told apart by their leaf, and equal rows take
neighbouring places, each with a proof of its own; a group of one row has its leaf as subroot, and
a table of one row its leaf as root; texts of any length are hashed whole; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .numbering import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8


def leaf_of(fields: list[Column]) -> Column:
    """The hash of a row's fields."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (before and after it, level by level) imply."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings on a path, level by level and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def run_of(arity: int):
    return F.collect_list("node").over(Window.partitionBy("g", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def levels(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The tables g, i, node, n of all levels, from the given one up to that where every group has one node (n: of its group)."""
    out = [nodes]
    while not out[-1].where("n > 1").isEmpty():
        runs = out[-1].where("n > 1").withColumn("parent", F.expr(f"i div {arity}")).withColumn("run", run_of(arity))
        parents = runs.where(F.col("i") % arity == 0)  # the first of a run stands for its parent
        out.append(stored(parents.select("g", F.col("parent").alias("i"), F.sha2(F.array_join("run", ""), 256).alias("node"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n")), "level"))
    return out


def tops(tree: list[DataFrame]) -> DataFrame:
    """g, top: the one node that remains of each group."""
    out = tree[0].where("n = 1")
    for level in tree[1:]:
        out = out.unionByName(level.where("n = 1"))
    return out.select("g", F.col("node").alias("top"))


def with_paths(level: DataFrame, above: DataFrame | None, lone: DataFrame, arity: int) -> DataFrame:
    """A level's nodes with path: their siblings, then the parent's path. above: the next level's; lone: g, path of groups' tops."""
    alone = level.where("n = 1").join(lone, "g")
    if above is None:
        return alone
    up = above.select("g", F.col("i").alias("parent"), F.col("path").alias("up"))
    runs = level.where("n > 1").withColumn("parent", F.expr(f"i div {arity}")).withColumn("run", run_of(arity))
    place = (F.col("i") % arity).cast("int")
    step = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("before"), F.array_join(F.slice("run", place + 2, F.lit(arity)), "").alias("after"))
    joined = runs.withColumn("step", step).drop("run").join(up, ["g", "parent"])
    return joined.withColumn("path", F.concat(F.array("step"), "up")).drop("parent", "step", "up").unionByName(alone)


def proofs(tree: list[DataFrame], lone: DataFrame, arity: int) -> DataFrame:
    """The lowest level with path, from the highest level down."""
    above = None
    for level in reversed(tree[1:]):
        above = stored(with_paths(level, above, lone, arity), "paths")
    return with_paths(tree[0], above, lone, arity)


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, carry: dict[str, Column] | None = None) -> DataFrame:
    """id (the order's value), grp, leaf, subroot, root, path and what is carried, a row for each row of docs.

    carry: further columns by name, computed where the rows are read; they should be narrow."""
    carry = {f"c_{name}": column for name, column in (carry or {}).items()}
    leaves = stored(docs.select(F.col(order).alias("id"), F.col(group).alias("grp"), leaf_of([F.col(f) for f in fields]).alias("node"), *(c.alias(name) for name, c in carry.items())), "leaves")
    groups = stored(leaves.groupBy("grp").agg(F.count("*").alias("n")), "groups")
    groups = stored(numbered(groups, ["grp"], "g", "groups"), "groups")
    placed = leaves.join(small(groups.select(F.col("grp").alias("name"), "g", "n")), F.col("grp").eqNullSafe(F.col("name"))).drop("name", "n")
    base = stored(numbered(stored(placed, "leaves"), ["id", "node"], "i", "n", group="g"), "leaves")
    tree = levels(base, arity)
    subroots = stored(tops([base.select("g", "i", "node", "n"), *tree[1:]]), "subroots")
    over = stored(subroots.join(groups.select("g", "groups"), "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.col("top").alias("node"), F.col("groups").alias("n")), "subroots")
    upper = levels(over, arity)
    none = F.array().cast("array<struct<before:string,after:string>>")
    root = tops(upper)
    lone = proofs(upper, root.select("g", none.alias("path")), arity)
    lone = stored(lone.select(F.col("i").alias("g"), "path", F.col("node").alias("subroot")).join(F.broadcast(root.select(F.col("top").alias("root")))), "subroots")  # one root
    out = proofs(tree, small(lone.select("g", "path")), arity).join(small(lone.select("g", "subroot", "root")), "g")
    return out.select("id", "grp", F.col("node").alias("leaf"), "subroot", "root", "path", *(F.col(name).alias(name[2:]) for name in carry))
