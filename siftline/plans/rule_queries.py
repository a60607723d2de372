"""Queries that classify and decide by ordered rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, decide, text, url
from ..operators import ranking, reports
from .catalog import Tables, query
from .entity_queries import HOST


@query("FN-16, AGG-01", "SELECT CASE WHEN p_size IS NULL THEN 'UNKNOWN' WHEN p_size <= 10 THEN 'MICRO' WHEN p_size <= 50 THEN 'SMALL' WHEN p_size <= 250 THEN 'MEDIUM' ELSE 'LARGE' END AS size_class, count(*) AS n FROM part GROUP BY 1")
def size_bucket(t: Tables) -> DataFrame:
    return t.part.groupBy(classify.size_bucket(F.col("p_size")).alias("size_class")).agg(F.count("*").alias("n"))


@query(
    "FN-15",
    """SELECT c_custkey, CASE WHEN x LIKE '%software%' OR x LIKE '%saas%' OR x LIKE '%technology%' THEN 'SaaS / Software' WHEN x LIKE '%retail%' OR x LIKE '%shopping%' THEN 'Retail'
              WHEN x LIKE '%finance%' OR x LIKE '%bank%' OR x LIKE '%insurance%' THEN 'Finance' WHEN x LIKE '%professional%' OR x LIKE '%consult%' THEN 'Professional Services'
              WHEN x LIKE '%consumer%' OR x LIKE '%service%' THEN 'Consumer Services' ELSE 'Other' END AS industry
       FROM (SELECT c_custkey, lower(c_mktsegment || CASE c_custkey % 5 WHEN 0 THEN ' software' WHEN 1 THEN ' bank' WHEN 2 THEN ' consulting' WHEN 3 THEN ' service' ELSE '' END) AS x FROM customer)""",
)
def token_class_first_match(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    tail = text.first_match([(k == 0, " software"), (k == 1, " bank"), (k == 2, " consulting"), (k == 3, " service")], "")
    return t.customer.select("c_custkey", classify.industry(F.concat("c_mktsegment", tail)).alias("industry"))


@query(
    "FN-17",
    """SELECT p_partkey, CASE WHEN v IN ('0', '') OR s = 'unknown' THEN 'SIZE_UNKNOWN' WHEN TRY_CAST(v AS BIGINT) IS NULL THEN 'CONFLICTING_EVIDENCE'
              WHEN c <> CASE WHEN v::INT <= 10 THEN 'MICRO' WHEN v::INT <= 50 THEN 'SMALL' WHEN v::INT <= 250 THEN 'MEDIUM' ELSE 'LARGE' END THEN 'CONFLICTING_EVIDENCE'
              WHEN c = 'LARGE' THEN 'LARGE_ENTERPRISE_SUPPORTED' ELSE 'SMB_SUPPORTED' END AS evidence
       FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'many' WHEN p_partkey % 7 = 0 THEN '0' ELSE (p_size * 8)::VARCHAR END AS v,
                    CASE WHEN p_size * 8 <= 50 THEN 'SMALL' WHEN p_size * 8 <= 250 THEN 'MEDIUM' ELSE 'LARGE' END AS c, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE 'register' END AS s FROM part)""",
)
def size_evidence(t: Tables) -> DataFrame:
    n = F.col("p_size") * 8
    value = F.when(F.col("p_partkey") % 9 == 0, "many").when(F.col("p_partkey") % 7 == 0, "0").otherwise(n.cast("string"))
    category = F.when(n <= 50, "SMALL").when(n <= 250, "MEDIUM").otherwise("LARGE")
    source = F.when(F.col("p_partkey") % 4 == 0, "unknown").otherwise("register")
    return t.part.select("p_partkey", classify.size_evidence(value, category, source).alias("evidence"))


@query(
    "FN-25",
    """WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'ACCESS_BLOCKED' WHEN 'signup' THEN 'AMBIGUOUS_IDENTITY' ELSE 'FETCH_FAILED' END AS status,
                         CASE WHEN event_id % 11 = 0 THEN 403 WHEN event_id % 7 = 0 THEN 500 END AS http,
                         CASE event_id % 5 WHEN 0 THEN 'request timed out' WHEN 1 THEN 'TLS handshake failed' WHEN 2 THEN 'connection refused' WHEN 3 THEN 'redirected from a to b' ELSE 'odd' END AS reason FROM events)
       SELECT category, count(*) AS n FROM (SELECT CASE WHEN status = 'AMBIGUOUS_IDENTITY' THEN 'IDENTITY_AMBIGUOUS' WHEN reason LIKE '%redirect%' THEN 'REDIRECT_ISSUE'
         WHEN http = 403 THEN 'HTTP_403_ACCESS_DENIED_UNSPECIFIED' WHEN status = 'ACCESS_BLOCKED' THEN 'ACCESS_RESTRICTION_UNSPECIFIED' WHEN reason LIKE '%timed out%' THEN 'TIMEOUT'
         WHEN reason LIKE '%handshake%' THEN 'TLS_ERROR' WHEN http IS NOT NULL THEN 'HTTP_' || http WHEN reason LIKE '%refused%' THEN 'TRANSIENT_CONNECTION' ELSE 'OTHER_FETCH_FAILURE' END AS category FROM e) GROUP BY 1""",
)
def failure_taxonomy(t: Tables) -> DataFrame:
    i, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "error", "ACCESS_BLOCKED").when(kind == "signup", "AMBIGUOUS_IDENTITY").otherwise("FETCH_FAILED")
    http = F.when(i % 11 == 0, 403).when(i % 7 == 0, 500)
    said = ["request timed out", "TLS handshake failed", "connection refused", "redirected from a to b"]
    reason = text.first_match([(i % 5 == k, s) for k, s in enumerate(said)], "odd")
    return t.events.groupBy(classify.failure(status, F.lit(""), http, reason).alias("category")).agg(F.count("*").alias("n"))


@query(
    "FN-18, FN-22, FN-23",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'shop=bakery' WHEN 1 THEN 'craft=brewery' WHEN 2 THEN 'amenity=hospital' WHEN 3 THEN 'tourism=museum' WHEN 4 THEN 'tourism=hotel' ELSE 'office=lawyer' END AS tag FROM part)
       SELECT tag, CASE tag WHEN 'shop=bakery' THEN 'consumer_retail' WHEN 'craft=brewery' THEN 'craft_and_local_services' WHEN 'amenity=hospital' THEN 'education_and_institutions'
                        WHEN 'tourism=museum' THEN 'culture_and_attractions' WHEN 'tourism=hotel' THEN 'hospitality_and_travel' ELSE 'business_and_professional_services' END AS category,
              CASE WHEN tag IN ('amenity=hospital', 'tourism=museum') THEN 'UNCERTAIN' ELSE 'LIKELY_FIT' END AS fit,
              CASE WHEN tag IN ('shop=bakery', 'craft=brewery') THEN 'Food and beverage' WHEN tag = 'amenity=hospital' THEN 'Healthcare' WHEN tag = 'tourism=museum' THEN 'Arts, culture, and tourism'
                   WHEN tag = 'tourism=hotel' THEN 'Travel and lodging' ELSE 'Professional and business services' END AS sector, tag = 'tourism=hotel' AS hotel, count(*) AS n FROM p GROUP BY tag""",
)
def tag_classes(t: Tables) -> DataFrame:
    tags = ["shop=bakery", "craft=brewery", "amenity=hospital", "tourism=museum", "tourism=hotel"]
    tag = text.first_match([(F.col("p_partkey") % 6 == k, x) for k, x in enumerate(tags)], "office=lawyer")
    c = F.col("tag")
    rows = t.part.groupBy(tag.alias("tag")).agg(F.count("*").alias("n"))
    return rows.select("tag", classify.category_group(c)["category"].alias("category"), classify.category_group(c)["fit"].alias("fit"), classify.sector(c).alias("sector"), classify.is_hotel(c).alias("hotel"), "n")


@query(
    "FN-24",
    """SELECT n_name, CASE WHEN lower(n_name) IN ('argentina','brazil','canada','france','germany','india','indonesia','japan','jordan','kenya','china','vietnam','united kingdom') THEN 'VERIFIED_NON_US'
              WHEN lower(n_name) = 'united states' THEN 'VERIFIED_US' ELSE 'COUNTRY_UNKNOWN' END AS class FROM nation""",
)
def geography(t: Tables) -> DataFrame:
    return t.nation.select("n_name", classify.geography(F.col("n_name"), F.lit(""), F.lit("")).alias("class"))


@query(
    "FN-19, FN-20, FN-21, AGG-01",
    f"""WITH d AS (SELECT {HOST} AS domain, count(*) AS n FROM pages GROUP BY 1)
        SELECT domain, n, CASE WHEN domain LIKE '%xn--%' THEN 'PUNYCODE_DOMAIN_REVIEW' WHEN length(domain) > 40 THEN 'LONG_DOMAIN_REVIEW' ELSE 'NO_OBVIOUS_PATTERN' END AS domain_concern,
               CASE WHEN n > 1 THEN 'MULTI_LOCATION_SOURCE_RECORDS' ELSE 'NO_STRUCTURED_SIGNAL' END AS chain, 'LIKELY_FIT' AS status, CASE WHEN n > 1 THEN 47 ELSE 50 END AS score FROM d""",
)
def site_triage(t: Tables) -> DataFrame:
    sites = t.pages.groupBy(url.domain_key(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))
    made = classify.triage(F.col("domain"), F.lit("shop=books"), F.col("domain"), F.lit("UNKNOWN"), F.lit("UNKNOWN"), F.col("n"), F.lit(1))
    return sites.select("domain", "n", made.alias("t")).select("domain", "n", "t.domain_concern", "t.chain", "t.status", "t.score")


def signals(t: Tables) -> DataFrame:
    """Signals of a customer, from their orders."""
    orders = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    return t.customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")


def qualified(t: Tables) -> DataFrame:
    n, f, u = (F.coalesce(c, F.lit(0)) for c in ("n", "f", "u"))
    s = {
        "has_evidence": n > 0, "fetch_status": F.when(F.col("c_custkey") % 13 == 0, "BLOCKED").otherwise("SUCCESS"), "pages": n, "reachable": n > 0, "meaningful_text": n >= 3,
        "substantial": n >= 10, "relevance": f >= 3, "faq": u >= 3, "structured": u >= 6, "active": F.col("c_acctbal") >= -500, "discovery": F.lit(True),
    }
    return signals(t).select("c_custkey", decide.qualification(s).alias("q")).select("c_custkey", "q.*")


QUALIFICATION = """WITH o AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY 1),
  s AS (SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n, coalesce(f, 0) AS f, coalesce(u, 0) AS u FROM customer LEFT JOIN o ON o_custkey = c_custkey),
  a AS (SELECT *, CASE WHEN c_custkey % 13 = 0 OR n = 0 THEN 'LOW' WHEN n >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
               CASE WHEN NOT c_acctbal >= -500 THEN 'NEEDS_REVIEW' WHEN n >= 3 THEN 'ELIGIBLE' ELSE 'NEEDS_REVIEW' END AS eligibility FROM s),
  b AS (SELECT *, CASE WHEN confidence = 'LOW' THEN 'UNKNOWN' WHEN n >= 10 AND f >= 3 AND (u < 3 OR u < 6) THEN 'HIGH' WHEN n >= 3 AND f >= 3 THEN 'MEDIUM' WHEN n >= 3 THEN 'LOW' ELSE 'UNKNOWN' END AS opportunity FROM a),
  c AS (SELECT *, least(100, (CASE WHEN eligibility = 'ELIGIBLE' THEN 20 ELSE 0 END) + (CASE WHEN confidence <> 'LOW' AND n > 0 THEN 15 ELSE 0 END) + (CASE WHEN f >= 3 THEN 15 ELSE 0 END)
               + (CASE opportunity WHEN 'HIGH' THEN 20 WHEN 'MEDIUM' THEN 10 ELSE 0 END) + (CASE confidence WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 0 END)) AS priority FROM b),
  q AS (SELECT c_custkey, confidence, eligibility, opportunity, priority, CASE WHEN confidence = 'LOW' OR eligibility = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' WHEN priority >= 75 THEN 'HIGH' WHEN priority >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
               CASE eligibility WHEN 'ELIGIBLE' THEN 'QUALIFIED' WHEN 'INELIGIBLE' THEN 'REJECTED' ELSE 'NEEDS_REVIEW' END AS decision FROM c) """


@query("FN-44, PRJ-14", QUALIFICATION + "SELECT * FROM q")
def qualification(t: Tables) -> DataFrame:
    return qualified(t)


@query("AGG-01, AGG-02, AGG-17", QUALIFICATION + "SELECT tier, count(*) AS n, count(*) FILTER (decision = 'QUALIFIED') AS qualified, max(priority) AS top FROM q GROUP BY tier")
def tier_distribution(t: Tables) -> DataFrame:
    return qualified(t).groupBy("tier").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "QUALIFIED").alias("qualified"), F.max("priority").alias("top"))


@query(
    "AGG-13, FN-51",
    """WITH d AS (SELECT doc_id, quality, n_chars, lang FROM documents LEFT JOIN labels USING (doc_id))
       SELECT 'NOT_REVIEWED' AS reason, count(*) AS n FROM d WHERE quality IS NULL HAVING count(*) > 0 UNION ALL SELECT 'LOW_QUALITY', count(*) FROM d WHERE quality = 0 HAVING count(*) > 0
       UNION ALL SELECT 'TOO_SHORT', count(*) FROM d WHERE n_chars < 200 HAVING count(*) > 0 UNION ALL SELECT 'NOT_ENGLISH', count(*) FROM d WHERE lang <> 'en' HAVING count(*) > 0""",
)
def overlapping_reasons(t: Tables) -> DataFrame:
    return reports.reason_counts(blocked(t), F.col("reasons"))


def blocked(t: Tables) -> DataFrame:
    rules = [("NOT_REVIEWED", F.col("quality").isNull()), ("LOW_QUALITY", F.col("quality") == 0), ("TOO_SHORT", F.col("n_chars") < 200), ("NOT_ENGLISH", F.col("lang") != "en")]
    return t.documents.select("doc_id", "n_chars", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left").withColumn("reasons", decide.blockers(rules))


@query(
    "AGG-14, FN-49",
    """SELECT concat_ws('|', CASE WHEN quality IS NULL THEN 'NOT_REVIEWED' END, CASE WHEN quality = 0 THEN 'LOW_QUALITY' END, CASE WHEN n_chars < 200 THEN 'TOO_SHORT' END, CASE WHEN lang <> 'en' THEN 'NOT_ENGLISH' END) AS reason_set, count(*) AS n
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 ORDER BY n DESC, reason_set LIMIT 25""",
)
def reason_sets(t: Tables) -> DataFrame:
    return reports.reason_sets(blocked(t), F.col("reasons"), 25)


@query(
    "FN-49, FN-48",
    """SELECT doc_id, CASE WHEN quality IS NOT NULL AND quality <> 0 AND n_chars >= 200 AND lang = 'en' THEN 'READY' WHEN quality = 0 OR n_chars < 200 THEN 'BLOCKED' ELSE 'NEEDS_REVIEW' END AS readiness
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def readiness(t: Tables) -> DataFrame:
    return blocked(t).select("doc_id", decide.readiness(F.col("reasons"), ["LOW_QUALITY", "TOO_SHORT"], ["NOT_REVIEWED", "NOT_ENGLISH"]).alias("readiness"))


@query(
    "FN-35",
    """SELECT reply, count(*) AS n FROM (SELECT CASE WHEN x LIKE '%unsubscribe%' OR x LIKE '%remove me%' OR x LIKE '%do not contact%' THEN 'UNSUBSCRIBE' WHEN x LIKE '%no thanks%' OR x LIKE '%decline%' OR x LIKE '%not interested%' THEN 'DECLINE'
         WHEN x LIKE '%consent%' OR x LIKE '%yes, interested%' OR x LIKE '%happy to participate%' THEN 'EXPLICIT_CONSENT' WHEN x LIKE '%?%' OR x LIKE '%what does%' OR x LIKE '%how does%' OR x LIKE '%question%' THEN 'QUESTION'
         WHEN x LIKE '%interested%' OR x LIKE '%tell me more%' OR x LIKE '%sounds good%' THEN 'POSITIVE_INTEREST' ELSE 'UNCLEAR' END AS reply FROM (SELECT lower(text) AS x FROM conversations)) GROUP BY 1""",
)
def reply_class(t: Tables) -> DataFrame:
    return t.conversations.groupBy(text.reply_class(F.col("text")).alias("reply")).agg(F.count("*").alias("n"))


@query("FN-76", """SELECT conv_id, turn, CASE WHEN regexp_matches(c, '^\\s*[=+@-]') THEN '''' || c ELSE c END AS cell FROM (SELECT conv_id, turn, (CASE turn % 4 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '' ELSE '-' END) || role AS c FROM conversations)""")
def formula_escape(t: Tables) -> DataFrame:
    lead = text.first_match([(F.col("turn") % 4 == 0, "="), (F.col("turn") % 4 == 1, " +"), (F.col("turn") % 4 == 2, "")], "-")
    return t.conversations.select("conv_id", "turn", text.formula_safe(F.concat(lead, "role")).alias("cell"))


@query(
    "FN-58, FN-60, FN-64",
    """SELECT lower(string_split(e, '@')[2]) AS mail_domain, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS e FROM documents) GROUP BY 1""",
)
def email_evidence(t: Tables) -> DataFrame:
    found = t.documents.where(F.col("text").contains("@")).select(F.explode(text.emails(F.col("text"))).alias("e"))
    return found.groupBy(F.split_part("e", F.lit("@"), F.lit(2)).alias("mail_domain")).agg(F.count("*").alias("n"))


@query(
    "FN-28, FN-32",
    """SELECT title, CASE WHEN title LIKE 'Owner%' THEN 'FOUNDER_OWNER' WHEN title LIKE 'Head of Growth%' THEN 'MARKETING_GROWTH' WHEN title LIKE 'Chief Executive%' THEN 'EXECUTIVE' WHEN title LIKE '%Director%' THEN 'GENERAL_BUSINESS' ELSE 'OTHER' END AS role, count(*) AS n
       FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'Owner & Cook' WHEN 1 THEN 'Head of Growth' WHEN 2 THEN 'Chief Executive' WHEN 3 THEN 'Art Director' ELSE 'Baker' END AS title FROM customer) GROUP BY title""",
)
def role_taxonomy(t: Tables) -> DataFrame:
    titles = ["Owner & Cook", "Head of Growth", "Chief Executive", "Art Director"]
    title = text.first_match([(F.col("c_custkey") % 5 == k, x) for k, x in enumerate(titles)], "Baker")
    return t.customer.groupBy(title.alias("title")).agg(F.count("*").alias("n")).select("title", text.role(F.col("title")).alias("role"), "n")


@query("FN-27", "SELECT o_orderkey, CASE WHEN s >= 6 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END) + (CASE WHEN o_totalprice > 50000 THEN 2 ELSE 0 END) + (CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS s FROM orders)")
def audit_confidence(t: Tables) -> DataFrame:
    made = decide.audit_confidence(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 50000, F.col("o_orderpriority") < "3", F.col("o_orderkey") % 2 == 0)
    return t.orders.select("o_orderkey", made.alias("confidence"))


@query(
    "FN-34, AGG-32",
    """SELECT user_id, CASE WHEN e AND f THEN 'EMAIL_AND_FORM' WHEN e THEN 'EMAIL_ONLY' WHEN f THEN 'FORM_ONLY' ELSE 'NO_CONTACT' END AS channels
       FROM (SELECT user_id, bool_or(event_type = 'signup') AS e, bool_or(event_type = 'purchase') AS f FROM events GROUP BY 1)""",
)
def channel_classes(t: Tables) -> DataFrame:
    flags = t.events.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("e"), F.bool_or(F.col("event_type") == "purchase").alias("f"))
    return flags.select("user_id", classify.channel_class(F.col("e"), F.col("f")).alias("channels"))


@query(
    "ST-02, ST-19",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS attempted, count(*) FILTER (event_type = 'purchase') AS verified, count(*) FILTER (event_type = 'signup') AS eligible FROM events GROUP BY 1),
       r AS (SELECT *, sum(attempted) OVER (ORDER BY day)::BIGINT AS total FROM d)
       SELECT day, attempted, total, CASE WHEN total >= 9000 THEN 'candidate_limit_reached' WHEN attempted = 0 THEN 'no_progress' WHEN verified / attempted < 0.23 OR eligible / attempted < 0.204 THEN 'quality_degradation_pause' END AS stop FROM r""",
)
def stop_reason(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("attempted"), F.count_if(F.col("event_type") == "purchase").alias("verified"), F.count_if(F.col("event_type") == "signup").alias("eligible"))
    run = days.withColumn("total", F.sum("attempted").over(Window.orderBy("day")))  # a row per day
    s = {k: F.col(k) for k in ("attempted", "verified", "eligible", "total")} | {"stop_requested": F.lit(False), "requests": F.lit(0), "seconds": F.lit(0.0), "cohort_complete": F.lit(True)}
    return run.select("day", "attempted", "total", decide.stop_reason(s, 10**9, 1e9, 9000).alias("stop"))


@query(
    "WIN-05",
    """SELECT doc_id, lang, k AS sample_rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('v1' || doc_id), doc_id) AS k FROM documents) WHERE k <= 15""",
)
def hash_stratified_sample(t: Tables) -> DataFrame:
    return ranking.hash_sample(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", "v1", 15)


@query("FN-13, FN-14", "SELECT o_orderkey, sha256(o_orderkey || chr(0) || lower(trim(o_orderpriority)) || chr(0) || lower(o_orderstatus)) AS key FROM orders")
def idempotency_keys(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", text.idempotency_key(F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("key"))
