"""Exports, selections and gates of siftline.operators.triage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import triage
from .catalog import Tables, query


@query(
    "PRJ-10",
    """WITH r AS (SELECT o_orderkey, o_orderstatus = 'F' AS v, o_totalprice >= 100000 AS e, o_orderpriority AS p FROM orders)
       SELECT o_orderkey, 'verified_candidates' AS export FROM r WHERE v
       UNION ALL SELECT o_orderkey, 'geo_eligible_candidates' FROM r WHERE e
       UNION ALL SELECT o_orderkey, 'contact_discovery_priority' FROM r WHERE v AND e AND p <> '1-URGENT'
       UNION ALL SELECT o_orderkey, 'exclusion_uncertainty_report' FROM r WHERE p IN ('4-NOT SPECIFIED', '5-LOW')""",
)
def triage_exports(t: Tables) -> DataFrame:
    priority = F.col("o_orderpriority")
    rows = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "VERIFIED").alias("verification_status"),
        F.when(F.col("o_totalprice") >= 100000, "ELIGIBLE").otherwise("UNKNOWN").alias("geo_eligibility_status"),
        F.when(priority == "1-URGENT", "CONTACT_FOUND").alias("contact_status"),
        F.when(priority != "5-LOW", "LIKELY_FIT").alias("screen_status"),
        F.when(priority == "4-NOT SPECIFIED", "CHAIN").otherwise("NO_STRUCTURED_SIGNAL").alias("chain_location_concern"),
        F.lit("NO_OBVIOUS_PATTERN").alias("website_domain_concern"),
    )
    return triage.export_memberships(rows, "o_orderkey")


def profiles(t: Tables) -> DataFrame:
    """Orders as profiles of their priority's type."""
    return t.orders.select(
        "o_orderkey",
        "o_orderdate",
        F.when(F.col("o_orderpriority") == "5-LOW", triage.FIXTURE).otherwise(F.col("o_orderpriority")).alias("profile_type"),
        F.when(F.col("o_orderstatus") != "P", "VERIFIED").alias("identity_verification_status"),
        F.when(F.col("o_totalprice") >= 50000, "ELIGIBLE").alias("qualification_status"),
        F.concat(F.lit("https://c"), "o_custkey", F.lit(".com")).alias("official_website"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETE").otherwise("NONE").alias("screening_status"),
    )


@query("PRJ-12", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 50000 AND o_orderpriority = '2-HIGH' ORDER BY o_orderdate, o_orderkey LIMIT 250")
def screenable(t: Tables) -> DataFrame:
    return triage.screenable(profiles(t), "o_orderkey", "o_orderdate", 250, "2-HIGH").select("o_orderkey", "o_orderdate")


@query("PRJ-16", "SELECT o_orderpriority AS profile_type, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1")
def saved_rows(t: Tables) -> DataFrame:
    return triage.saved(profiles(t)).groupBy("profile_type").agg(F.count("*").alias("n"))


@query(
    "PRJ-20",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '^www\.', '') AS host, url LIKE 'https:%' AS secure FROM pages),
        b AS (SELECT DISTINCT host FROM p WHERE secure)
        SELECT page_id, CASE WHEN host IN (SELECT host FROM b) THEN 'BASELINE_PRESERVED' ELSE 'NEW_EXPERIMENTAL' END AS cohort_membership, false AS website_url_is_third_party_profile FROM p""",
)
def cohort_flags(t: Tables) -> DataFrame:
    marked = triage.in_cohort(t.pages.select("page_id", "url"), t.pages.where("url LIKE 'https:%'"), "url")
    return marked.select("page_id", "cohort_membership", "website_url_is_third_party_profile")


@query(
    "FN-92",
    """SELECT o_orderkey, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linenumber <= 3 AND (l_linestatus = 'O' OR l_quantity >= 25)) AS n_usable
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def usable_channels(t: Tables) -> DataFrame:
    mail = F.col("l_linestatus") == "O"
    channel = F.struct(
        F.when(F.col("l_linenumber") > 3, "LINKEDIN").when(mail, "Partnership_Email").otherwise("CONTACT_FORM").alias("channel_type"),
        F.when(mail, "a@b.com").otherwise("").alias("email"),
        F.when(F.col("l_quantity") >= 25, "https://b.com/contact").alias("channel_url"),
        F.when(F.col("l_returnflag") == "R", "rejected").alias("review_status"),
    )
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(channel).alias("channels"))  # an order has seven lines at most
    return lines.join(t.orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", F.size(triage.usable_channels(F.col("channels"))).cast("long").alias("n_usable"))


@query(
    "FN-42",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'ACCESS_BLOCKED' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'FETCH_FAILED'
         WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice >= 100000 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'VERIFIED' END
         WHEN o_orderstatus = 'P' THEN 'INSUFFICIENT_EVIDENCE' WHEN o_totalprice >= 100000 THEN 'REJECTED_MISMATCH' ELSE 'AMBIGUOUS_IDENTITY' END AS status FROM orders""",
)
def refined_status(t: Tables) -> DataFrame:
    dear, priority, status = F.col("o_totalprice") >= 100000, F.col("o_orderpriority"), F.col("o_orderstatus")
    rows = t.orders.select(
        "o_orderkey",
        triage.refined_status(
            F.when(status == "P", "Q42").otherwise("Deep"),
            F.lit("https://www.deep.com/"),
            F.when(status == "F", "verified").otherwise("AMBIGUOUS"),
            F.when(priority == "5-LOW", "403").when(priority != "4-NOT SPECIFIED", "200"),
            F.when(dear, "https://deep2001.com/"),
            F.lit("Deep Casino"),
        ).alias("status"),
    )
    return rows


@query(
    "FN-54",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice >= 100000 THEN 'OPERATING_SIGNAL_REVIEW_REQUIRED' WHEN o_orderstatus IN ('F', 'O') THEN 'SERVICE_CONTENT_ONLY_REVIEW_REQUIRED' ELSE 'NOT_ESTABLISHED' END AS status FROM orders""",
)
def hotel_evidence(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    page = F.struct(
        F.when(status == "F", "Grand Hotel").alias("title"),
        F.when(status == "F", "Book now!").otherwise("About us").alias("meta_description"),
        F.when(status == "O", "LodgingBusiness").alias("structured_data_types"),
    )
    return t.orders.select("o_orderkey", triage.hotel_evidence(F.array(page), F.col("o_totalprice") >= 100000, F.lit(None).cast("boolean")).alias("status"))


@query(
    "FN-87",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'BLOCKED_NOT_ELIGIBLE' WHEN o_orderstatus = 'P' THEN 'BLOCKED_IDENTITY_UNVERIFIED' WHEN o_orderpriority = '5-LOW' THEN 'NO_SUITABLE_CHANNEL'
         WHEN o_orderstatus = 'O' THEN 'BLOCKED_GEOGRAPHY' WHEN o_orderpriority = '1-URGENT' THEN 'CHANNEL_NOT_FOUND' ELSE 'DRAFT_READY' END AS status FROM orders""",
)
def preview_gate(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    gate = triage.preview_gate(
        F.when(F.col("o_totalprice") >= 20000, "Eligible"),
        F.when(status != "P", "VERIFIED"),
        F.when(priority != "5-LOW", F.array(F.lit(1), F.lit(2))),
        F.when(status == "F", "VERIFIED_US"),
        F.when(priority != "1-URGENT", 2),
    )
    return t.orders.select("o_orderkey", gate.alias("status"))


@query("TOP-09", "SELECT c_name, c_custkey, c_mktsegment FROM customer ORDER BY lower(c_name), c_custkey, lower(c_mktsegment)")
def merge_order(t: Tables) -> DataFrame:
    return triage.export_order(t.customer.select("c_name", "c_custkey", "c_mktsegment"), "c_name", "c_custkey", "c_mktsegment")
