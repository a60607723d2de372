"""Queries over companies with all that is known of them: customers with their orders as discoveries, snapshots and contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import channels, cohort
from .catalog import Tables, query

#: The same companies in SQL: c (companies), o (a customer's orders), d, s, k (what the orders say as discoveries, latest snapshot, contacts).
COMPANIES = """WITH c AS (SELECT c_custkey AS company_id, c_name AS company_name, 'https://c' || c_custkey || '.com/' AS website, 'c' || c_custkey || '.com' AS domain, CASE WHEN c_acctbal < 8000 THEN c_mktsegment END AS industry,
       CASE WHEN c_nationkey >= 3 THEN n_name END AS location, CASE WHEN c_acctbal >= -500 THEN greatest(0, floor(c_acctbal / 10))::INT END AS size, CASE WHEN c_acctbal >= 3000 THEN 'eligible' WHEN c_acctbal < 0 THEN 'INELIGIBLE' END AS eligibility,
       CASE WHEN c_nationkey % 4 = 0 THEN 'HIGH' WHEN c_nationkey % 4 = 1 THEN 'unknown' END AS opportunity, CASE WHEN c_acctbal >= 6000 THEN 'HIGH' END AS tier, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HIGH' END AS confidence,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'APPROVED' ELSE 'PENDING' END AS review, CASE WHEN c_acctbal < 1000 THEN 'NOT_RUN' WHEN c_acctbal < 2000 THEN 'FAILED' ELSE 'DONE' END AS contact_status,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'READY_FOR_REVIEW' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'NEEDS_REVIEW' WHEN c_mktsegment = 'FURNITURE' THEN 'FETCH_FAILED' ELSE 'NO_SUITABLE_CHANNEL' END AS contactability
       FROM customer JOIN nation ON c_nationkey = n_nationkey),
  o AS (SELECT *, 'https://c' || o_custkey || '.com/' AS home, CASE o_orderpriority WHEN '1-URGENT' THEN 'PARTNERSHIP_EMAIL' WHEN '2-HIGH' THEN 'CONTACT_FORM' WHEN '3-MEDIUM' THEN 'SUPPORT_EMAIL' WHEN '4-NOT SPECIFIED' THEN 'GENERAL_BUSINESS_EMAIL' END AS channel FROM orders),
  d AS (SELECT o_custkey AS company_id, string_agg(DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'import' ELSE o_orderpriority END, '; ' ORDER BY CASE WHEN o_orderstatus = 'P' THEN 'import' ELSE o_orderpriority END) AS sources,
       list(DISTINCT 'https://dir.example/' || o_orderpriority) || list(DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'https://dir.example/f' END) AS urls, arg_min('https://dir.example/' || o_orderpriority, o_orderkey) AS first_url,
       string_agg(o_orderkey::VARCHAR, ';' ORDER BY o_orderkey) AS ids, arg_min(o_totalprice, o_orderkey) AS first_price, count(*) AS n FROM o GROUP BY 1),
  s AS (SELECT o_custkey AS company_id, max_by(o, (o_orderdate, o_orderkey)) AS s FROM o WHERE o_orderstatus = 'O' GROUP BY 1),
  s2 AS (SELECT company_id, s.o_orderdate AS fetched_at, s.o_orderkey AS id, CASE WHEN s.o_orderpriority = '5-LOW' THEN 'FETCH_FAILED' WHEN s.o_orderpriority = '1-URGENT' THEN 'PARTIAL' ELSE 'SUCCESS' END AS fetch_status, s.home || 'o' || s.o_orderkey AS requested, s.home AS final, s.o_totalprice AS price FROM s),
  k AS (SELECT o_custkey AS company_id, count(*) FILTER (WHERE channel IN ('PARTNERSHIP_EMAIL', 'CONTACT_FORM', 'GENERAL_BUSINESS_EMAIL')) AS suitable, count(*) FILTER (WHERE channel IN ('PARTNERSHIP_EMAIL', 'CONTACT_FORM', 'GENERAL_BUSINESS_EMAIL') AND o_totalprice < 100000) AS pending,
       list(DISTINCT CASE WHEN channel IN ('PARTNERSHIP_EMAIL', 'CONTACT_FORM', 'GENERAL_BUSINESS_EMAIL') THEN home || o_orderpriority END) AS urls, bool_or(channel IN ('PARTNERSHIP_EMAIL', 'CONTACT_FORM', 'GENERAL_BUSINESS_EMAIL') AND o_totalprice < 200000 AND (channel = 'CONTACT_FORM' OR o_orderkey % 2 = 0)) AS own,
       string_agg(DISTINCT CASE WHEN o_totalprice > 250000 THEN 'Ann ' || o_orderstatus END, '; ' ORDER BY CASE WHEN o_totalprice > 250000 THEN 'Ann ' || o_orderstatus END) AS people FROM o GROUP BY 1),
  g AS (SELECT c.*, d.sources, d.urls AS d_urls, d.first_url, d.ids, d.first_price, coalesce(d.n, 0) AS n, s2.fetched_at, s2.id AS snapshot_id, s2.fetch_status, s2.requested, s2.final, s2.price, coalesce(k.suitable, 0) AS suitable, coalesce(k.pending, 0) AS pending, k.urls AS k_urls, k.own, k.people,
       CASE WHEN d.n >= 12 THEN 'VERIFIED' WHEN d.n >= 8 THEN 'MANUAL_REVIEW' END AS identity FROM c LEFT JOIN d USING (company_id) LEFT JOIN s2 USING (company_id) LEFT JOIN k USING (company_id))
"""


def companies(t: Tables) -> DataFrame:
    b, segment, nation = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("c_nationkey")
    key = F.col("c_custkey").cast("string")
    rows = t.customer.join(F.broadcast(t.nation), nation == F.col("n_nationkey"))  # 25 nations
    null = F.lit(None).cast("string")
    return rows.select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.concat(F.lit("https://c"), key, F.lit(".com/")).alias("website"), F.concat(F.lit("c"), key, F.lit(".com")).alias("normalized_domain"), F.when(b < 8000, segment).alias("industry"),
        F.when(nation >= 3, F.col("n_name")).alias("location"), F.when(b >= -500, F.greatest(F.lit(0), F.floor(b / 10)).cast("int")).alias("company_size_value"), null.alias("company_size_source"), null.alias("company_size_category"), F.when(b >= 3000, "eligible").when(b < 0, "INELIGIBLE").alias("eligibility"),
        F.when(nation % 4 == 0, "HIGH").when(nation % 4 == 1, "unknown").alias("geo_opportunity"), F.when(b >= 6000, "HIGH").alias("priority_tier"), F.when(segment == "BUILDING", "HIGH").alias("evidence_confidence"), F.when(segment.isin("BUILDING", "MACHINERY"), "APPROVED").otherwise("PENDING").alias("review_status"),
        F.when(b < 1000, "NOT_RUN").when(b < 2000, "FAILED").otherwise("DONE").alias("contact_status"), F.when(segment == "BUILDING", "READY_FOR_REVIEW").when(segment == "HOUSEHOLD", "NEEDS_REVIEW").when(segment == "FURNITURE", "FETCH_FAILED").otherwise("NO_SUITABLE_CHANNEL").alias("contactability_status"),
        null.alias("review_notes"), null.alias("reviewed_by"), F.when(segment == "MACHINERY", F.col("c_custkey")).alias("_override"), F.when(segment == "BUILDING", "READY_FOR_GEO").alias("pipeline_status"), null.alias("created_at"), null.alias("qualification_evidence"),
    )


def home(n: str = "o_custkey"):
    return F.concat(F.lit("https://c"), F.col(n).cast("string"), F.lit(".com/"))


def parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """discoveries, snapshots, contacts and identities of the customers."""
    o, status, priority = t.orders, F.col("o_orderstatus"), F.col("o_orderpriority")
    raw = F.to_json(F.struct(F.when(status == "F", "https://dir.example/f").alias("source_directory_url"), F.when(F.col("o_totalprice") < 60000, F.lit(False)).alias("active")))
    found = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.lit("import").alias("source_type"), F.when(status != "P", priority).alias("source_name"), F.concat(F.lit("https://dir.example/"), priority).alias("source_url"), F.col("o_orderkey").cast("string").alias("source_identifier"), raw.alias("raw_data"))
    price = F.col("o_totalprice")
    signals = F.to_json(F.struct(F.floor(price / 60000).cast("int").alias("pages_inspected"), (price > 20000).alias("reachable"), (price > 40000).alias("meaningful_text"), (price > 150000).alias("substantial"), (price > 90000).alias("relevance"), F.lit(False).alias("faq")))
    shots = o.where(status == "O").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("fetched_at"), F.when(priority == "5-LOW", "FETCH_FAILED").when(priority == "1-URGENT", "PARTIAL").otherwise("SUCCESS").alias("fetch_status"),
        F.concat(home(), F.lit("o"), F.col("o_orderkey").cast("string")).alias("requested_url"), home().alias("final_url"), F.lit(None).cast("string").alias("canonical_url"), signals.alias("extracted_signals"), F.lit(200).alias("http_status"))
    kind = F.when(priority == "1-URGENT", "PARTNERSHIP_EMAIL").when(priority == "2-HIGH", "CONTACT_FORM").when(priority == "3-MEDIUM", "SUPPORT_EMAIL").when(priority == "4-NOT SPECIFIED", "GENERAL_BUSINESS_EMAIL")
    mail = F.concat(F.lit("m"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("@c"), F.col("o_custkey").cast("string"), F.lit(".com"))).otherwise("@mail.example"))
    reach = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id"), kind.alias("channel_type"), home().alias("channel_url"), F.concat(home(), priority).alias("source_url"), F.when(kind != "CONTACT_FORM", mail).alias("email"),
        F.when(price < 100000, "PENDING").when(price < 200000, "APPROVED").otherwise("REJECTED").alias("review_status"), F.when(price > 250000, F.concat(F.lit("Ann "), status)).alias("name"), F.when(price > 250000, "PERSON").otherwise("GENERIC").alias("contact_type"), (status == "F").alias("recommended"), F.floor(price).cast("int").alias("ranking_score"))
    known = o.groupBy(F.col("o_custkey").alias("company_id")).agg(F.count("*").alias("n")).where("n >= 8").select("company_id", F.when(F.col("n") >= 12, "VERIFIED").otherwise("MANUAL_REVIEW").alias("identity"))
    return found, shots, reach, known


@query(
    "FN-88, FN-38, FN-39, FN-40, TOP-04",
    COMPANIES
    + """, r AS (SELECT *, coalesce(identity, 'BASELINE_NOT_RECHECKED') AS i, upper(coalesce(eligibility, 'NEEDS_REVIEW')) AS e, upper(coalesce(opportunity, 'UNKNOWN')) AS g, coalesce(tier, 'NEEDS_REVIEW') AS t, coalesce(confidence, 'LOW') AS f FROM g),
       q AS (SELECT *, CASE WHEN i = 'VERIFIED' THEN 'NOT_REQUIRED_MACHINE_VERIFIED' ELSE 'PENDING' END AS it, CASE WHEN e = 'NEEDS_REVIEW' THEN 'PENDING' WHEN review = 'PENDING' THEN 'MACHINE_SUPPORTED_PENDING_COMPANY_REVIEW' ELSE 'NOT_REQUIRED' END AS et,
             CASE WHEN g = 'UNKNOWN' THEN 'PENDING' WHEN review = 'PENDING' THEN 'MACHINE_SCORED_PENDING_COMPANY_REVIEW' ELSE 'NOT_REQUIRED' END AS ot,
             CASE WHEN pending > 0 AND i <> 'VERIFIED' THEN 'WAITING_FOR_IDENTITY_VERIFICATION' WHEN pending > 0 AND e <> 'ELIGIBLE' THEN 'WAITING_FOR_ELIGIBILITY_REVIEW' WHEN pending > 0 THEN 'PENDING' WHEN contact_status = 'NOT_RUN' THEN 'NOT_DISCOVERED'
                  WHEN contact_status = 'FAILED' OR contactability = 'FETCH_FAILED' THEN 'RESEARCH_FAILED_OR_BLOCKED' ELSE 'NO_PENDING_SUITABLE_CHANNEL' END AS ct FROM r),
       a AS (SELECT *, concat_ws('; ', CASE WHEN it = 'PENDING' THEN 'VERIFY_COMPANY_WEBSITE' END, CASE WHEN et = 'PENDING' THEN 'REVIEW_ELIGIBILITY' END, CASE WHEN ot = 'PENDING' THEN 'REVIEW_GEO_OPPORTUNITY' END, CASE WHEN ct = 'PENDING' THEN 'REVIEW_CONTACT_CHANNEL' END) AS todo FROM q)
       SELECT company_id, company_name, website, coalesce(sources, '') AS discovery_source, coalesce(industry, '') AS industry, coalesce(size::VARCHAR, '') AS company_size, 'unknown' AS company_size_evidence_source, 'UNKNOWN' AS company_size_category, coalesce(location, '') AS geography,
              coalesce(fetch_status, 'NOT_INSPECTED') AS website_fetch_status, i AS identity_verification_status, e AS eligibility, g AS geo_opportunity, t AS research_priority, f AS evidence_confidence,
              array_to_string(list_sort(list_distinct(list_filter(coalesce(d_urls, []) || [requested, final, website], lambda x: x IS NOT NULL))), ' | ') AS evidence_links,
              concat_ws('; ', CASE WHEN i <> 'VERIFIED' THEN 'first_party_identity_verification' END, CASE WHEN industry IS NULL THEN 'industry' END, CASE WHEN location IS NULL THEN 'geography' END, CASE WHEN coalesce(size, 0) <= 0 THEN 'employee_size_evidence' END,
                   CASE WHEN eligibility IS NULL THEN 'eligibility_evidence' END, CASE WHEN g = 'UNKNOWN' THEN 'geo_opportunity_evidence' END, CASE WHEN fetch_status IS NULL THEN 'website_inspection' END, CASE WHEN fetch_status = 'FETCH_FAILED' THEN 'usable_website_content' END) AS missing_evidence,
              CASE WHEN todo <> '' THEN todo WHEN review = 'PENDING' THEN 'CONFIRM_MACHINE_FINDINGS' ELSE 'NONE' END AS required_review_action, review AS company_review_status, it AS identity_task, et AS eligibility_task, ot AS opportunity_task, ct AS contact_task, 'NOT_GRANTED' AS outreach_approval,
              contact_status AS contact_channel_status, CASE WHEN i <> 'VERIFIED' THEN 'BLOCKED_IDENTITY_REVIEW' WHEN e <> 'ELIGIBLE' THEN 'BLOCKED_ELIGIBILITY_REVIEW' WHEN review <> 'APPROVED' THEN 'BLOCKED_COMPANY_REVIEW' WHEN ct = 'PENDING' THEN 'BLOCKED_CONTACT_CHANNEL_REVIEW'
                   WHEN contactability = 'READY_FOR_REVIEW' THEN 'CHANNEL_AVAILABLE' WHEN contact_status = 'NOT_RUN' THEN 'CONTACT_CHANNEL_NOT_DISCOVERED' WHEN contact_status = 'FAILED' THEN 'CONTACT_DISCOVERY_FAILED_OR_BLOCKED' ELSE 'NO_SUITABLE_CHANNEL_OR_UNRESOLVED' END AS outreach_readiness_status,
              array_to_string(list_sort(list_filter(coalesce(k_urls, []), lambda x: x IS NOT NULL)), ' | ') AS contact_channel_evidence_links, '' AS reviewer_notes, '' AS reviewed_by,
              concat_ws('/', CASE WHEN i = 'VERIFIED' THEN 0 ELSE 1 END, CASE e WHEN 'ELIGIBLE' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END, CASE g WHEN 'HIGH' THEN 0 WHEN 'UNKNOWN' THEN 3 ELSE 4 END, CASE t WHEN 'HIGH' THEN 0 ELSE 3 END, CASE f WHEN 'HIGH' THEN 0 ELSE 2 END, company_id) AS priority FROM a""",
)
def review_queue_rows(t: Tables) -> DataFrame:
    found, shots, reach, known = parts(t)
    rows = cohort.review_rows(companies(t), found, shots, reach, known)
    return rows.withColumn("priority", F.concat_ws("/", *(F.col(f"priority_key.{c}").cast("string") for c in "abcdef"))).drop("priority_key")


@query(
    "FN-55",
    COMPANIES
    + """, x AS (SELECT *, CASE WHEN fetch_status IS NULL OR fetch_status = 'FETCH_FAILED' THEN 'LOW' WHEN floor(price / 60000) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS qc, coalesce(first_price < 60000, false) AS inactive,
                CASE WHEN coalesce(first_price < 60000, false) THEN 'NEEDS_REVIEW' WHEN price > 40000 AND n > 0 THEN 'ELIGIBLE' ELSE 'NEEDS_REVIEW' END AS qe FROM g),
       y AS (SELECT *, CASE WHEN qc = 'LOW' THEN 'UNKNOWN' WHEN price > 150000 THEN 'HIGH' WHEN price > 90000 THEN 'MEDIUM' WHEN price > 40000 THEN 'LOW' ELSE 'UNKNOWN' END AS qo FROM x),
       z AS (SELECT *, least(100, CASE WHEN qe = 'ELIGIBLE' THEN 20 ELSE 0 END + CASE WHEN qc <> 'LOW' AND price > 20000 THEN 15 ELSE 0 END + CASE WHEN price > 90000 THEN 15 ELSE 0 END + CASE qo WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 10 ELSE 0 END + CASE qc WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 0 END) AS qp FROM y),
       first AS (SELECT o_custkey AS company_id, min(o_orderkey) AS id FROM orders GROUP BY 1),
       p AS (SELECT z.*, CASE WHEN contactability = 'NEEDS_REVIEW' THEN fo.o_orderkey END AS override, fo.channel, fo.o_orderkey AS fid, fo.o_orderpriority AS fp, fo.o_totalprice AS fprice, fo.home FROM z LEFT JOIN first USING (company_id) LEFT JOIN o fo ON fo.o_orderkey = first.id),
       w AS (SELECT *, channel IS NOT NULL AS has FROM p),
       alt AS (SELECT o_custkey AS company_id, to_json(list({'evidence_url': home || o_orderpriority, 'review_status': CASE WHEN o_totalprice < 100000 THEN 'PENDING' WHEN o_totalprice < 200000 THEN 'APPROVED' ELSE 'REJECTED' END, 'type': o.channel,
                   'value': CASE WHEN o.channel = 'CONTACT_FORM' THEN home ELSE 'm' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '@c' || o_custkey || '.com' ELSE '@mail.example' END END} ORDER BY o_orderstatus <> 'F', -floor(o_totalprice), o_orderkey))::VARCHAR AS j
               FROM o WHERE o.channel IS NOT NULL AND o_orderkey NOT IN (SELECT id FROM first) GROUP BY 1)
       SELECT company_id, company_name, website, coalesce(sources, '') AS discovery_source, coalesce(industry, '') AS industry, CASE WHEN size > 0 THEN size || ' employees (directory-reported)' ELSE '' END AS company_size, coalesce(location, '') AS geography, qe AS eligibility,
              CASE WHEN qe = 'ELIGIBLE' THEN 'discovery provenance is recorded; first-party website is reachable and has meaningful public content' WHEN inactive THEN 'discovery source explicitly marked the company inactive; current activity requires review'
                   ELSE 'insufficient evidence to establish an eligible research candidate; no exclusion inferred' END AS eligibility_reasons, qo AS geo_opportunity, CASE WHEN qc = 'LOW' OR qe = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' WHEN qp >= 75 THEN 'HIGH' WHEN qp >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS research_priority,
              printf('%.1f', qp::DOUBLE) AS priority_score, qc AS evidence_confidence, coalesce(fetch_status, 'NOT_INSPECTED') AS website_fetch_status, CASE WHEN has THEN channel ELSE '' END AS primary_channel_type,
              CASE WHEN NOT has THEN '' WHEN channel = 'CONTACT_FORM' THEN home ELSE 'm' || fid || CASE WHEN fid % 2 = 0 THEN '@c' || company_id || '.com' ELSE '@mail.example' END END AS primary_channel, CASE WHEN has THEN home || fp ELSE '' END AS channel_evidence_url,
              coalesce(j, '[]') AS alternative_channels, coalesce(people, '') AS named_decision_maker,
              CASE WHEN override IS NOT NULL AND has AND channel <> 'SUPPORT_EMAIL' THEN 'NEEDS_CHANNEL_REVIEW' WHEN override IS NOT NULL THEN 'NO_SUITABLE_CHANNEL' WHEN contactability = 'READY_FOR_REVIEW' THEN 'CHANNEL_AVAILABLE' WHEN contactability = 'NEEDS_REVIEW' THEN 'NEEDS_CHANNEL_REVIEW'
                   WHEN contactability = 'FETCH_FAILED' THEN 'FETCH_FAILED' ELSE 'NO_SUITABLE_CHANNEL' END AS outreach_readiness, review AS company_review_status, CASE WHEN NOT has THEN '' WHEN fprice < 100000 THEN 'PENDING' WHEN fprice < 200000 THEN 'APPROVED' ELSE 'REJECTED' END AS channel_review_status,
              '' AS reviewer_notes, coalesce(override::VARCHAR, '') AS channel_override_contact_id,
              concat_ws('; ', CASE WHEN size = 0 THEN 'company_size_count_zero_needs_verification' END, CASE WHEN industry IS NULL THEN 'industry' END, CASE WHEN location IS NULL THEN 'geography' END, CASE WHEN size IS NULL THEN 'company_size' END, CASE WHEN qc = 'LOW' THEN 'website_evidence' END,
                   CASE WHEN qe = 'NEEDS_REVIEW' THEN 'eligibility_evidence' END, CASE WHEN inactive THEN 'discovery_activity_status_conflicts_with_current_public_website' END, CASE WHEN qo = 'UNKNOWN' THEN 'GEO_opportunity_evidence' END) AS missing_information,
              has AND channel <> 'SUPPORT_EMAIL' AS has_channel FROM w LEFT JOIN alt USING (company_id)""",
)
def selection_records(t: Tables) -> DataFrame:
    """A customer's first order is their primary channel; for those who need a review it is the reviewer's choice."""
    found, shots, reach, _ = parts(t)
    first = t.orders.groupBy(F.col("o_custkey").alias("company_id")).agg(F.min("o_orderkey").alias("_first"))
    chosen = companies(t).join(first, "company_id", "left").withColumn("primary_channel_id", F.col("_first")).withColumn("channel_override_contact_id", F.when(F.col("contactability_status") == "NEEDS_REVIEW", F.col("_first")))
    return cohort.selection_records(chosen, found, shots, reach)


@query(
    "SET-06, SET-02, SET-03",
    COMPANIES
    + """, v AS (SELECT *, coalesce(identity, 'BASELINE_NOT_RECHECKED') AS i, upper(coalesce(eligibility, 'NEEDS_REVIEW')) AS e FROM g)
       SELECT 'curated:' || company_id AS candidate_id, company_name, website, domain AS canonical_domain, coalesce(industry, '') AS industry, coalesce(location, '') AS location, coalesce(sources, 'Legacy cohort') AS source_name, coalesce(first_url, '') AS source_url, coalesce(ids, '') AS source_record_id,
              'Existing cohort provenance; source permissions are recorded in its inventory and were not reassessed.' AS source_license_or_permission, '' AS discovery_timestamp, i AS verification_status, CASE WHEN i = 'VERIFIED' THEN e ELSE 'NEEDS_REVIEW' END AS geo_eligibility_status,
              CASE WHEN i = 'VERIFIED' AND e = 'ELIGIBLE' THEN upper(coalesce(opportunity, 'UNKNOWN')) ELSE 'UNKNOWN' END AS geo_opportunity_status, CASE WHEN own THEN 'CONTACT_FOUND' ELSE 'NOT_DISCOVERED' END AS contact_status, review AS human_review_status,
              CASE WHEN confidence = 'HIGH' AND i = 'VERIFIED' AND e = 'ELIGIBLE' AND review = 'APPROVED' THEN 'READY' ELSE 'NOT_READY' END AS outreach_ready_status, 'Inherited saved website verification; not re-crawled' AS verification_reason, NULL AS qualification_evidence, fetch_status,
              CASE WHEN i = 'VERIFIED' THEN 301 WHEN fetch_status IS NOT NULL THEN 200 END AS http_status,
              '{' || concat_ws(',', '"fetch_status":"' || fetch_status || '"', '"identity_review_source":"saved verification or snapshot"', '"origin":"curated cohort; not recrawled"', '"original_company_size_value":' || size, '"original_eligibility":"' || e || '"', '"original_priority_tier":"' || tier || '"') || '}' AS evidence_json,
              strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS last_inspected_at, 'curated' AS source_batch FROM v""",
)
def pool_projection(t: Tables) -> DataFrame:
    found, shots, reach, known = parts(t)
    saved = known.select("company_id", "identity", F.lit(None).cast("string").alias("reason"), F.when(F.col("identity") == "VERIFIED", 301).alias("http_status"))
    return cohort.pool_rows(companies(t), found, shots, reach, saved, "curated")


@query(
    "FN-70, FN-34",
    r"""WITH p AS (SELECT page_id, length(html) % 5 AS k, CASE WHEN length(url) % 7 = 0 THEN 'ftp://x/y' ELSE url END AS u FROM pages)
       SELECT page_id, CASE WHEN NOT regexp_matches(lower(u), '^https?://') THEN 'source_url must be HTTP(S)' END AS error, CASE WHEN regexp_matches(lower(u), '^https?://') THEN CASE k WHEN 0 THEN 'EMAIL_AND_FORM' WHEN 1 THEN 'EMAIL_ONLY' WHEN 2 THEN 'FORM_ONLY' WHEN 3 THEN 'NO_CONTACT' ELSE 'EMAIL_ONLY' END END AS channel_type,
              CASE WHEN regexp_matches(lower(u), '^https?://') THEN k IN (0, 2, 3, 4) END AS has_form FROM p""",
)
def supplied_contacts(t: Tables) -> DataFrame:
    """Whole pages with an address or a form added by their length; a page's own addresses, if it has any, are taken out of its text first."""
    k = F.length("html") % 5
    own = F.replace("html", F.lit("@"), F.lit(" "))
    mail, form, bare = F.lit("<p>Write to Desk@x.example now</p>"), F.lit("<form><div><textarea name=m></textarea></div></form>"), F.lit("<form><p>nothing</p></form>")
    added = F.when(k == 0, F.concat(mail, form)).when(k == 1, mail).when(k == 2, form).when(k == 3, bare).otherwise(F.concat(bare, mail))
    url = F.when(F.length("url") % 7 == 0, "ftp://x/y").otherwise(F.col("url"))
    return channels.supplied_contacts(t.pages.select("page_id", url.alias("url"), F.concat(own, added).alias("html")), "page_id", "url", "html").select("page_id", "error", "channel_type", "has_form")
