"""Site rows, contracts, records, replays and checkpoints of siftline.operators.records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import channels, records
from .catalog import Tables, query


@query(
    "FN-95",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'REJECTED_THIRD_PARTY' WHEN o_orderstatus = 'P' THEN 'BLOCKED'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'FETCH_FAILED' WHEN o_totalprice < 50000 THEN 'REJECTED_PARKED'
         WHEN o_orderstatus = 'F' THEN 'VERIFIED' ELSE 'AMBIGUOUS' END AS status FROM orders""",
)
def title_check(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    check = records.title_check(
        F.concat(F.lit("Customer "), "o_custkey", F.lit(" of Order, Inc.")),
        F.when(priority == "5-LOW", "https://www.facebook.com/x").otherwise("https://a.com"),
        F.when(status == "P", "BLOCKED").when(priority != "4-NOT SPECIFIED", "SUCCESS"),
        F.lit("https://a.com/home"),
        F.when(status == "F", F.concat(F.lit("Order of Customer "), "o_custkey")).otherwise("Welcome"),
        F.when(F.col("o_totalprice") < 50000, "Buy this domain!"),
    )
    return t.orders.select("o_orderkey", check.alias("status"))


@query(
    "FN-94",
    """WITH d AS (SELECT o_custkey AS c_custkey, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS source_names,
           string_agg(DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'r/' || o_orderpriority END, ' | ' ORDER BY CASE WHEN o_orderstatus = 'F' THEN 'r/' || o_orderpriority END) AS directory_routes FROM orders GROUP BY 1)
       SELECT c_custkey, coalesce(source_names, '') AS source_names, coalesce(directory_routes, '') AS directory_routes,
         CASE WHEN c_acctbal < 0 THEN 'NOT_FETCHED' ELSE 'SUCCESS' END AS fetch_status, c_acctbal >= 5000 AS redirected_to_different_domain FROM customer LEFT JOIN d USING (c_custkey)""",
)
def site_rows(t: Tables) -> DataFrame:
    companies = t.customer.select("c_custkey", F.lit("https://www.a.com/").alias("website"))
    route = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(F.concat(F.lit("r/"), "o_orderpriority").alias("source_directory_url"))))
    found = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit(None).cast("string").alias("source_name"), F.col("o_orderpriority").alias("source_type"), F.lit("i").alias("source_identifier"), F.lit("u").alias("source_url"), route.alias("raw_data"))
    final = F.when(F.col("c_acctbal") >= 5000, "https://b.com/").otherwise("http://a.com/x")
    snapshots = t.customer.where("c_acctbal >= 0").select("c_custkey", final.alias("final_url"), F.lit("SUCCESS").alias("fetch_status"))
    return records.site_rows(companies, found, snapshots, "c_custkey").select("c_custkey", "source_names", "directory_routes", "fetch_status", "redirected_to_different_domain")


@query(
    "FN-56",
    """SELECT l_orderkey, CASE WHEN count(*) > 3 THEN 'must contain 1 to 3 opportunities' WHEN max(l_tax) >= 0.06 THEN 'precise claims of uplift' END AS error FROM lineitem GROUP BY 1""",
)
def screening_contract(t: Tables) -> DataFrame:
    claim = F.when(F.col("l_tax") >= 0.06, "Expect a 20% Uplift").otherwise("Add an answer page")
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.to_json(F.struct(claim.alias("title")))).alias("found"))  # an order has few lines
    return lists.select("l_orderkey", records.screening_error(F.col("found")).alias("error"))


@query(
    "FN-56",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'unsupported mode' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unsupported rating' WHEN o_totalprice < 50000 THEN 'no evidence'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'evidence without source or excerpt' WHEN o_orderstatus = 'P' THEN 'incomplete invitation' WHEN o_orderstatus = 'F' THEN 'unsupported guarantee' END AS error FROM orders""",
)
def analysis_contract(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    item = F.struct(F.lit("https://a.com").alias("url"), F.when(priority != "3-MEDIUM", "We sell.").alias("excerpt"))
    error = records.analysis_error(
        F.when(priority != "5-LOW", "LOCAL_LLM"),
        F.when(priority == "4-NOT SPECIFIED", "GREAT").otherwise("LOW"),
        F.when(F.col("o_totalprice") >= 50000, F.array(item)),
        F.lit("Hello"),
        F.when(status == "P", "").when(status == "F", "We  guarantee more").otherwise("A 10 % idea"),
    )
    return t.orders.select("o_orderkey", error.alias("error"))


@query(
    "FN-85",
    """SELECT CAST(c_custkey AS VARCHAR) AS profile_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'unexpected schema_version' WHEN c_acctbal < 0 THEN 'profile_id and website are required' END AS error,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 'owner_controlled_test' WHEN 'HOUSEHOLD' THEN 'hotel_property' ELSE 'business_company' END AS profile_type,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN '' WHEN c_acctbal >= 5000 AND c_mktsegment = 'HOUSEHOLD' THEN 'SMB_COHORT,HOTEL_COHORT' WHEN c_acctbal >= 5000 THEN 'SMB_COHORT' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'HOTEL_COHORT' ELSE '' END AS memberships,
         'profile_import:' || c_custkey || ':' || left(sha256(c_name), 12) AS record_id FROM customer""",
)
def import_records(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    profiles = t.customer.select(
        F.when(segment != "BUILDING", "v1").alias("schema_version"),
        F.col("c_custkey").cast("string").alias("profile_id"),
        F.when(F.col("c_acctbal") >= 0, "https://a.com").alias("website"),
        F.col("c_name").alias("name"),
        F.when(segment == "MACHINERY", records.FIXTURE).when(segment == "HOUSEHOLD", records.HOTEL).otherwise("startup_company").alias("profile_type"),
        F.when(F.col("c_acctbal") >= 5000, "YES").alias("smb"),
        (segment.isin("HOUSEHOLD", "MACHINERY")).alias("hotel"),
        F.col("c_name").alias("body"),
    )
    made = records.import_records(profiles, "v1")
    return made.select("profile_id", "error", "profile_type", F.array_join("memberships", ",").alias("memberships"), "record_id")


@query(
    "FN-86",
    """WITH o AS (SELECT *, o_orderpriority = '5-LOW' AS old, o_totalprice < 50000 AS odd FROM orders)
       SELECT o_orderkey, CAST(NULL AS VARCHAR) AS record_type, 'envelope lacks fields' AS error FROM o WHERE odd
       UNION ALL SELECT o_orderkey, NULL, 'unsupported contract version' FROM o WHERE old AND NOT odd
       UNION ALL SELECT o_orderkey, 'audit_result_reference', CASE WHEN o_orderstatus = 'F' THEN 'missing audit_url, page_refs' END FROM o WHERE NOT odd AND NOT old
       UNION ALL SELECT o_orderkey, 'evaluation_question_set', NULL FROM o, range(2) WHERE NOT odd AND NOT old
       UNION ALL SELECT o_orderkey, 'ranked_strategy_recommendation', 'more than three strategies' FROM o WHERE NOT odd AND NOT old AND o_orderstatus = 'O'""",
)
def result_records(t: Tables) -> DataFrame:
    full = F.col("o_orderstatus") != "F"
    audit = F.struct(F.lit("a").alias("audit_id"), F.lit("s").alias("status"), F.when(full, "u").alias("audit_url"), F.when(full, F.array(F.lit("p"))).alias("page_refs"))
    plan = F.struct(F.lit("a").alias("audit_id"), F.lit("p").alias("ranking_policy"), F.array(*(F.lit(c) for c in "wxyz")).alias("strategies"))
    body = F.struct(
        F.when(F.col("o_orderpriority") == "5-LOW", "v0").otherwise("v1").alias("contract_version"),
        F.col("o_custkey").alias("source_profile_id"),
        F.lit("v1").alias("source_profile_version"),
        F.when(F.col("o_totalprice") >= 50000, "p1").alias("property_id"),
        F.col("o_orderdate").cast("string").alias("received_at"),
        audit.alias("audit"),
        F.array(*(F.struct(F.array(F.lit(q)).alias("questions")) for q in "ab")).alias("question_set"),
        F.when(F.col("o_orderstatus") == "O", F.array(plan)).alias("strategies"),
    )
    return records.result_records(t.orders.select("o_orderkey", F.to_json(body).alias("body")), "o_orderkey", "body", "v1").select("o_orderkey", "record_type", "error")


@query(
    "FN-86",
    """SELECT o_orderkey, 'deployment_receipt' AS record_type, CASE WHEN o_orderpriority = '5-LOW' THEN 'missing public_url, recorded_at' END AS error FROM orders WHERE o_orderstatus = 'O'
       UNION ALL SELECT o_orderkey, 'research_result_export', NULL FROM orders WHERE o_totalprice >= 100000
       UNION ALL SELECT o_orderkey, 'property_identity_mapping', CASE WHEN o_orderstatus = 'P' THEN 'missing mapped_at' END FROM orders WHERE o_orderstatus <> 'O'""",
)
def result_receipts(t: Tables) -> DataFrame:
    """Receipts, reports and mappings of envelopes; some receipts lack two fields."""
    status, late = F.col("o_orderstatus"), F.col("o_orderpriority") == "5-LOW"
    names = ["proposal_id", "approval_status", "source_git_revision", "content_hash", "deployed_git_revision", "vercel_deployment_id", "verification_status", "baseline_experiment_reference", "post_deployment_experiment_reference"]
    receipt = F.struct(*(F.lit("x").alias(n) for n in names), F.when(~late, "u").alias("public_url"), F.when(~late, F.col("o_orderdate").cast("string")).alias("recorded_at"))
    body = F.struct(
        *(F.lit("v1").alias(n) for n in ("contract_version", "source_profile_id", "source_profile_version", "property_id")), F.when(status == "O", F.array(receipt)).alias("deployment_receipts"), F.when(F.col("o_totalprice") >= 100000, F.struct(F.array(F.lit(1), F.lit(2)).alias("rows"))).alias("report"),
        F.when(status != "O", F.struct(F.lit("p").alias("property_id"), F.when(status == "F", "now").alias("mapped_at"))).alias("property_mapping"),
    )
    return records.result_records(t.orders.select("o_orderkey", F.to_json(body).alias("body")), "o_orderkey", "body", "v1").select("o_orderkey", "record_type", "error")


@query(
    "SRC-08",
    """WITH p AS (SELECT o_orderpriority AS source_type, o_custkey AS k, count(*) AS n FROM orders GROUP BY 1, 2),
        k AS (SELECT p.*, c_custkey IS NULL AS new FROM p LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON k = c_custkey)
       SELECT source_type, CAST(sum(n) AS BIGINT) AS processed, count(*) FILTER (WHERE new) AS created, CAST(sum(CASE WHEN new THEN n - 1 ELSE n END) AS BIGINT) AS duplicates FROM k GROUP BY 1""",
)
def replayed(t: Tables) -> DataFrame:
    site = F.concat(F.lit("https://www.c"), "o_custkey", F.lit(".com/"))
    saved = t.orders.select(F.col("o_orderpriority").alias("source_type"), F.to_json(F.struct(F.lit("n").alias("name"), site.alias("website"))).alias("raw_data"))
    return records.replayed(saved, t.customer.where("c_acctbal >= 0").select(F.concat(F.lit("c"), "c_custkey", F.lit(".com")).alias("domain")))


@query(
    "ST-23",
    """WITH a AS (SELECT o_custkey AS c_custkey, max(CAST(o_orderstatus = 'F' AS INT)) AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_failed,
           max_by(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS last_error FROM orders GROUP BY 1)
       SELECT c_custkey, coalesce(n_failed, 0) AS n_failed, last_error FROM customer LEFT JOIN a USING (c_custkey) WHERE coalesce(done, 0) = 0""",
)
def open_routes(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    attempts = t.orders.select(F.col("o_custkey").alias("c_custkey"), status.alias("status"), F.col("o_orderpriority").alias("error"), "o_orderkey")
    return records.open_routes(t.customer.select("c_custkey"), attempts, "c_custkey", "o_orderkey")


@query(
    "FN-89",
    """WITH r AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'VERIFIED' WHEN '2-HIGH' THEN 'ACCESS_BLOCKED' WHEN '3-MEDIUM' THEN 'AMBIGUOUS_IDENTITY' ELSE 'REJECTED_MISMATCH' END AS status, o_orderstatus AS s, o_totalprice AS p FROM orders)
       SELECT o_orderkey, CASE s WHEN 'F' THEN 'NONCOMMERCIAL_INDICATED' ELSE 'UNCONFIRMED' END AS commercial_business_assessment,
         CASE WHEN status <> 'VERIFIED' THEN 'UNATTRIBUTABLE_UNVERIFIED_SITE' WHEN s = 'F' THEN 'NOT_COMMERCIAL_GEO_TARGET' WHEN s = 'O' THEN 'HIGH' ELSE 'UNKNOWN' END AS relevance_assessment,
         concat_ws('; ', CASE WHEN status = 'AMBIGUOUS_IDENTITY' THEN 'independent first-party identity evidence (legal name, about/imprint, or Wikidata-linked identifier)' END,
           CASE WHEN status = 'ACCESS_BLOCKED' THEN 'independent accessible first-party identity source; do not bypass controls' END,
           CASE WHEN s = 'F' THEN 'confirm whether commercial research scope includes this entity type' ELSE 'current operating/commercial-status evidence' END,
           CASE WHEN p < 100000 THEN 'sourced employee count or other defensible size evidence' END, CASE WHEN p < 50000 THEN 'industry evidence' END) AS additional_evidence_needed FROM r""",
)
def quality_rows(t: Tables) -> DataFrame:
    priority, status, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    rows = t.orders.select(
        "o_orderkey",
        F.when(priority == "1-URGENT", "VERIFIED").when(priority == "2-HIGH", "ACCESS_BLOCKED").when(priority == "3-MEDIUM", "AMBIGUOUS_IDENTITY").otherwise("REJECTED_MISMATCH").alias("status"),
        F.when(status == "F", "NONCOMMERCIAL_INDICATED").alias("commercial"),
        F.when(status == "O", "HIGH").alias("rating"),
        F.when(price >= 100000, "LARGE_ENTERPRISE_SUPPORTED").alias("size_class"),
        F.when(price >= 50000, "Q1").alias("industries"),
    )
    return records.quality_rows(rows, "o_orderkey")


@query(
    "FN-90",
    """WITH s AS (SELECT o_custkey AS c_custkey, min('c' || o_orderkey || '.com') AS d, count(DISTINCT o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
       SELECT c_custkey, 'https://www.' || d || '/x' AS website_url, d AS normalized_domain, coalesce(n, 0) AS n_domains, c_acctbal >= 5000 AS large_enterprise, c_acctbal < 0 AS smb_supported, d IS NOT NULL AND c_acctbal < 5000 AS qualified
       FROM customer LEFT JOIN s USING (c_custkey)""",
)
def pilot_rows(t: Tables) -> DataFrame:
    size = F.when(F.col("c_acctbal") >= 5000, "LARGE_ENTERPRISE_SUPPORTED").when(F.col("c_acctbal") < 0, "SMB_SUPPORTED")
    url = F.when(F.col("o_orderstatus") == "F", "https://www.facebook.com/a").otherwise(F.concat(F.lit("https://www.c"), "o_orderkey", F.lit(".com/x")))
    return records.pilot_rows(t.customer.select("c_custkey", size.alias("size_class")), t.orders.select(F.col("o_custkey").alias("c_custkey"), url.alias("url")), "c_custkey")


@query(
    "SNK-19",
    """WITH m AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)
       SELECT (SELECT count(*) FROM orders) AS candidate_total, (SELECT '{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}' FROM m) AS o_orderstatus,
         (SELECT '{' || string_agg('"' || v || '":' || n, ',' ORDER BY v) || '}' FROM p) AS o_orderpriority""",
)
def validation_summary(t: Tables) -> DataFrame:
    return records.validation_summary(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "SNK-19",
    """WITH o AS (SELECT o_custkey AS k, o_orderstatus = 'P' AS idle, o_orderpriority <> '5-LOW' AS site FROM orders),
        d AS (SELECT k, count(*) AS n, k IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS known FROM o WHERE site AND NOT idle GROUP BY k)
       SELECT (SELECT count(*) FROM o) AS objects_examined, (SELECT count(*) FROM o WHERE idle) AS inactive_objects, (SELECT count(*) FROM o WHERE NOT idle AND NOT site) AS objects_without_site,
         CAST(coalesce(sum(n) FILTER (WHERE known), 0) AS BIGINT) AS active_cohort_duplicates, CAST(coalesce(sum(n - 1) FILTER (WHERE NOT known), 0) AS BIGINT) AS duplicate_domain_objects,
         count(*) AS distinct_domains, count(*) FILTER (WHERE NOT known) AS new_unique_candidates FROM d""",
)
def acquisition(t: Tables) -> DataFrame:
    site = F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("https://c"), "o_custkey", F.lit(".com/")))
    objects = t.orders.select(site.alias("url"), (F.col("o_orderstatus") == "P").alias("inactive"))
    return records.acquisition(objects, t.customer.where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey", F.lit(".com")).alias("domain")))


@query(
    "FN-65",
    """WITH p AS (SELECT c_custkey, 'c' || c_custkey || '.com' AS host, c_mktsegment AS s, c_acctbal AS b FROM customer)
       SELECT c_custkey, 'sales@' || host AS email, 'SALES_MARKETING_EMAIL' AS channel_type, 'https://' || host || '/home' AS channel_url FROM p WHERE s = 'BUILDING'
       UNION ALL SELECT c_custkey, 'info@' || host, 'GENERAL_BUSINESS_EMAIL', 'https://' || host || '/home' FROM p WHERE s = 'MACHINERY'
       UNION ALL SELECT c_custkey, 'privacy@' || host, 'RESTRICTED_EMAIL', 'https://' || host || '/home' FROM p WHERE s = 'FURNITURE'
       UNION ALL SELECT c_custkey, NULL, 'CONTACT_FORM', 'https://' || host || '/send' FROM p WHERE b >= 0
       UNION ALL SELECT c_custkey, NULL, 'CONTACT_FORM', 'https://forms.net/f' FROM p WHERE s = 'HOUSEHOLD'""",
)
def page_channels(t: Tables) -> DataFrame:
    host, segment = F.concat(F.lit("c"), "c_custkey", F.lit(".com")), F.col("c_mktsegment")
    body = (
        F.when(segment == "BUILDING", F.concat(F.lit("<a href='mailto:Sales@"), host, F.lit("?subject=x'>write</a>")))
        .when(segment == "MACHINERY", F.concat(F.lit("<p>info [at] c"), "c_custkey", F.lit(" [dot] com</p>")))
        .when(segment == "FURNITURE", F.concat(F.lit("<p>privacy@"), host, F.lit("</p>")))
        .when(segment == "HOUSEHOLD", F.lit("<a href='https://forms.net/f'>Contact us</a><a href='https://forms.net/privacy'>Contact</a><a href='/in'>Contact</a>"))
        .otherwise("<p>ann.lee@mail.org</p>")
    )
    form = F.when(F.col("c_acctbal") >= 0, "<form action='/send'><input type='email' placeholder='general inquiry'></form>").otherwise("<form action='/join'><input type='email' name='newsletter'></form>")
    pages = t.customer.select("c_custkey", F.concat(F.lit("https://"), host, F.lit("/home")).alias("url"), F.concat(F.lit("<body>"), body, form).alias("html"))
    return channels.page_channels(pages, "c_custkey", "url", "html").select("c_custkey", "email", "channel_type", "channel_url")
