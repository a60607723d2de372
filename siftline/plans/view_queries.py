"""Named views, filters and guards of siftline.operators.views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import views
from .catalog import Tables, query


@query("PRJ-08", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def export_view(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "VERIFIED").otherwise(F.col("o_orderstatus"))
    return views.export_view(t.orders.select("o_orderkey", "o_custkey", status.alias("verification_status")), "verified_companies").select("o_orderkey", "o_custkey")


@query(
    "PRJ-09",
    """WITH r AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS x FROM orders)
       SELECT o_orderkey, 'high_priority_company_review' AS view FROM r WHERE s = 'F' AND x >= 50000 AND p = '1-URGENT'
       UNION ALL SELECT o_orderkey, 'ambiguous_identity_review' FROM r WHERE s = 'O'
       UNION ALL SELECT o_orderkey, 'legacy_identity_unassessed' FROM r WHERE s = 'P'
       UNION ALL SELECT o_orderkey, 'missing_qualification_evidence' FROM r WHERE p = '5-LOW'
       UNION ALL SELECT o_orderkey, 'contact_channel_review' FROM r WHERE s = 'F' AND x >= 50000 AND p = '2-HIGH'""",
)
def review_views(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = t.orders.select(
        "o_orderkey",
        F.when(status == "F", "VERIFIED").when(status == "O", "FETCH_FAILED").when(status == "P", "BASELINE_NOT_RECHECKED").alias("identity_verification_status"),
        F.when(F.col("o_totalprice") >= 50000, "ELIGIBLE").alias("eligibility"),
        F.when(priority == "1-URGENT", "HIGH").alias("research_priority"),
        F.lit("PENDING").alias("company_review_status"),
        F.when(priority == "2-HIGH", "PENDING").alias("contact_channel_review_status"),
        F.when(priority == "5-LOW", F.array(F.lit("industry"))).alias("missing_evidence"),
    )
    return views.view_memberships(rows, "o_orderkey")


@query("PRJ-06", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus = 'R'")
def either_status(t: Tables) -> DataFrame:
    return t.lineitem.where(views.either("R", "l_returnflag", "l_linestatus")).select("l_orderkey", "l_linenumber")


@query("PRJ-07", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%')")
def source_filter(t: Tables) -> DataFrame:
    provenance = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("source_name"))
    return views.with_source(t.customer.select("c_custkey", "c_name"), provenance, "c_custkey", "Urgent")


@query("PRJ-13", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus IN ('O', 'P') AND l_linenumber < 3 AND l_returnflag <> 'A'")
def work_queue(t: Tables) -> DataFrame:
    delivery = F.when(F.col("l_returnflag") == "A", "DELIVERED").otherwise("NONE")
    rows = t.lineitem.withColumn("delivery", delivery)
    return rows.where(views.workable("l_linestatus", "l_linenumber", "delivery", ["O", "P"], 3)).select("l_orderkey", "l_linenumber")


@query(
    "FN-08",
    r"""WITH p AS (SELECT url, page_id, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS host FROM pages),
        z AS (SELECT *, regexp_extract(host, '([a-z]+)$', 1) AS zone FROM p WHERE host <> '')
        SELECT zone, host, arg_min(url, page_id) AS url FROM z GROUP BY zone, host""",
)
def distinct_sites(t: Tables) -> DataFrame:
    host = F.nullif(F.regexp_extract(F.lower("url"), r"^https?://([^/?#:]+)", 1), F.lit(""))
    rows = t.pages.select("url", "page_id", host.alias("host")).withColumn("zone", F.regexp_extract("host", "([a-z]+)$", 1))
    return views.distinct_sites(rows, "zone", "url", "host", "page_id")


@query(
    "FN-91",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN_DECISION' WHEN o_orderstatus = 'F' AND NOT (o_totalprice >= 20000 AND o_orderpriority <> '5-LOW') THEN 'NOT_FIRST_PARTY_AND_VERIFIED' END AS error FROM orders""",
)
def decision_guard(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = t.orders.select(
        "o_orderkey",
        F.when(status == "F", "approved").when(status == "O", "REJECTED").otherwise("MAYBE").alias("decision"),
        F.when(F.col("o_totalprice") >= 20000, "YES").alias("first_party"),
        F.lit("VERIFIED").alias("identity"),
        F.when(F.col("o_orderpriority") == "5-LOW", views.UNSUPPORTED).otherwise("GENERAL").alias("class"),
        F.lit("").alias("note"),
    )
    return rows.select("o_orderkey", views.decision_error("decision", "first_party", "identity", "class", "note").alias("error"))


@query(
    "ST-04",
    """WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1)
       SELECT user_id, ts FROM l, n WHERE epoch(now) - epoch(ts) <= 168 * 3600""",
)
def fresh_snapshots(t: Tables) -> DataFrame:
    now = F.broadcast(t.events.agg(F.max("ts").alias("now")))  # one row
    return views.fresh(t.events.select("user_id", "ts", "event_id").join(now), "user_id", "ts", "event_id", F.col("now")).select("user_id", "ts")


@query("ST-20", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def reserve_once(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return views.reserved(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query(
    "ST-13",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'STOPPED' WHEN l_linenumber <= 2 THEN 'REVOKED' WHEN l_quantity <= 10 THEN 'EXPIRED' ELSE 'VALID' END AS state FROM lineitem""",
)
def token_states(t: Tables) -> DataFrame:
    state = views.token_state(F.col("l_returnflag") == "A", F.col("l_linenumber"), F.when(F.col("l_quantity") <= 10, F.lit(2)).otherwise(F.lit(3)), F.lit(2))
    return t.lineitem.select("l_orderkey", "l_linenumber", state.alias("state"))


@query("AGG-30", "SELECT doc_id, round((n_chars * 0.15::DOUBLE + 100 * 0.6::DOUBLE) / 1e6::DOUBLE, 6) AS cost FROM documents")
def call_costs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", views.cost(F.col("n_chars"), F.lit(100), 0.15, 0.6).alias("cost"))
