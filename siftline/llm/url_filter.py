"""URL filters as a temporal list join.

Block and allow lists change over time: an entry is listed on one day and taken off, or given
another action, on a later one. The dated changes of an entry become validity intervals (from a
change until the next one of the same list, kind and pattern). Every capture is then judged by the
entries that were active when it was fetched.

A pattern is a host with all its subdomains (`domain`), a host alone (`host`), or a host and the
beginning of a path by whole segments (`prefix`). A URL has few keys of these kinds: its host, the
host's parents, and its path's beginnings. So the as-of join is an equi-join of keys with a check
of the interval, never a comparison of every URL with every entry. Keys that no entry has are
dropped at once, and the captures' keys, not their contents, are what moves. List tables of a
counted, bounded size are broadcast; larger ones are joined by a shuffle, in which Spark splits
hosts with many captures.

Of several entries active for a capture the most specific one decides (prefix, host, domain; the
longer pattern first; allow before block), as with exceptions in filter lists.

Defined results: a null or unreadable URL matches nothing and is kept; a null fetch time too;
changes of one entry at the same time leave the last by action; entries with a null pattern or
time are ignored; rows that repeat a capture are judged alike; URLs of any length are read whole, and
give no more keys than the deepest entry has path segments and host labels; empty lists keep
everything, an empty table of captures gives an empty result; columns of `captures` with the name of a
result column are replaced by it in `judge` and kept by `select`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own, small, stored

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.nullif(F.rtrim(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), F.lit(".")), F.lit(""))


def intervals(changes: DataFrame) -> DataFrame:
    """list, kind, pattern, action, valid_from, valid_to (null: still active) of dated changes (list, kind, pattern, action, at)."""
    clean = changes.where("pattern IS NOT NULL AND at IS NOT NULL").withColumn("pattern", F.lower(F.trim("pattern")))
    clean = clean.groupBy("list", "kind", "pattern", "at").agg(F.max("action").alias("action"))
    entry = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    spans = clean.withColumn("valid_to", F.lead("at").over(entry)).withColumnRenamed("at", "valid_from")
    return spans.where("action <> 'remove'").select("list", "kind", "pattern", "action", "valid_from", "valid_to")


def keys(url: Column, labels_most: int, segments_most: int) -> Column:
    """(kind, pattern) of every entry that could match a URL: its host, the host's parents, its path's beginnings; no longer than entries are."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.least(F.size(labels), F.lit(labels_most))
    parents = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".").alias("pattern")),
    )
    path = F.filter(F.split(F.regexp_extract(F.trim(url), PATH, 1), "/"), lambda s: s != "")
    n = F.least(F.size(path), F.lit(segments_most))
    begins = F.transform(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(path, 1, k), "/"))).alias("pattern")),
    )
    own_host = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(own_host, parents, begins)))


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched_at) with decision (allow, block, none), list, kind, pattern of the entry that decides, and n_active."""
    active = stored(intervals(changes), "intervals")
    most = active.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)).alias("segments"),
    ).first()
    active = small(active, weight=F.length("pattern"), limit=1 << 24)
    keyed = captures.select("page_id", "url", "fetched_at", F.explode(keys(F.col("url"), most.labels or 0, most.segments or 0)).alias("k")).select("page_id", "url", "fetched_at", "k.kind", "k.pattern")
    met = keyed.join(active, ["kind", "pattern"]).where((F.col("valid_from") <= F.col("fetched_at")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to"))))
    rank = F.struct(
        F.when(F.col("kind") == "prefix", 3).when(F.col("kind") == "host", 2).otherwise(1).alias("kind_rank"),
        F.length("pattern").alias("length"),
        F.when(F.col("action") == "allow", 1).otherwise(0).alias("allows"),
        "list", "kind", "pattern", "action",
    )
    page, url, at, best, n = own(captures.columns, "u_page", "u_url", "u_at", "u_best", "u_n")
    found = met.groupBy(F.col("page_id").alias(page), F.col("url").alias(url), F.col("fetched_at").alias(at)).agg(F.max(rank).alias(best), F.count_distinct("list", "kind", "pattern").alias(n))
    out = captures.join(found, F.col("page_id").eqNullSafe(F.col(page)) & (F.col("url") == F.col(url)) & (F.col("fetched_at") == F.col(at)), "left")
    made = {
        "decision": F.coalesce(F.col(best)["action"], F.lit("none")),
        "list": F.col(best)["list"],
        "kind": F.col(best)["kind"],
        "pattern": F.col(best)["pattern"],
        "n_active": F.coalesce(n, F.lit(0)).cast("long"),
    }
    return out.select(*(captures[c] for c in captures.columns if c not in made), *(v.alias(k) for k, v in made.items()))


def select(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """The captures that no list blocked when they were fetched."""
    blocked = judge(captures, changes).where("decision = 'block'").select("page_id", "url", "fetched_at").distinct()
    on = [captures[c].eqNullSafe(blocked[c]) for c in ("page_id", "url", "fetched_at")]
    return captures.join(blocked, on, "left_anti")
