"""Queries about entities: keys, owners, duplicates, merges, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, url
from ..operators import entities, intervals, joins, ranking
from .catalog import Tables, query

HOST = "regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '[.]+$', ''), '^www[.]', '')"
FORMS = "inc|incorporated|llc|ltd|limited|corp|corporation|company|co"


@query("FN-03, AGG-01", f"SELECT {HOST} AS domain, count(*) AS pages FROM pages GROUP BY 1")
def page_domain_key(t: Tables) -> DataFrame:
    return t.pages.groupBy(url.domain_key(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query(
    "FN-04",
    f"""SELECT page_id, 'https://' || {HOST} || regexp_replace(regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1), '/+$', '')
               || regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS canonical FROM pages""",
)
def page_url_canonical(t: Tables) -> DataFrame:
    return t.pages.select("page_id", url.url_canonical(F.col("url")).alias("canonical"))


@query("WIN-09, AGG-08, FN-03", f"SELECT domain, min_by(url, page_id) AS first_url, count(*) AS members FROM (SELECT *, {HOST} AS domain FROM pages) GROUP BY domain")
def entity_dedupe(t: Tables) -> DataFrame:
    keyed = t.pages.select("page_id", "url", url.domain_key(F.col("url")).alias("domain"))
    return entities.first_per_key(keyed, ["domain"], ["page_id"], "url")


@query("FN-11, FN-12", f"SELECT DISTINCT 'site:' || substr(sha256({HOST}), 1, 24) AS site_id FROM pages")
def stable_ids(t: Tables) -> DataFrame:
    return t.pages.select(text.stable_id("site:", url.domain_key(F.col("url"))).alias("site_id")).distinct()


@query(
    "WIN-08",
    """SELECT doc_id, CASE WHEN doc_id <> o THEN o END AS owner, n AS group_size
       FROM (SELECT doc_id, min(doc_id) OVER w AS o, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY text))""",
)
def duplicate_owner(t: Tables) -> DataFrame:
    return entities.owners(t.documents.select("doc_id", F.sha2("text", 256).alias("key")), "key", "doc_id")


@query(
    "WIN-12, AGG-11",
    """SELECT sha256(text) AS text_sha, min(doc_id) AS representative, count(*) - 1 AS duplicate_count, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources
       FROM documents GROUP BY text HAVING count(*) > 1""",
)
def duplicate_audit(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("text_sha"))
    groups = keyed.groupBy("text_sha").agg(F.min("doc_id").alias("representative"), (F.count("*") - 1).alias("duplicate_count"), F.collect_set("source").alias("s"))
    return groups.where("duplicate_count > 0").select("text_sha", "representative", "duplicate_count", text.sorted_join(F.col("s"), "; ").alias("sources"))


@query(
    "WIN-13, JOIN-24, FN-02",
    """WITH k AS (SELECT p_partkey, p_brand, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part),
       n AS (SELECT k, count(DISTINCT p_brand) AS n FROM k GROUP BY k) SELECT p_partkey, n, n > 1 AS collides FROM k JOIN n USING (k)""",
)
def name_collision_flag(t: Tables) -> DataFrame:
    return entities.collisions(t.part, [text.plain_key(F.col("p_name"))], "p_partkey", F.col("p_brand"))


@query(
    "FN-01",
    f"""SELECT s_suppkey, regexp_replace(trim(regexp_replace(lower(s_name || ' Company Ltd.'), '[^a-z0-9]+', ' ', 'g')), '(^| )({FORMS})( ({FORMS}))*$', '') AS name_key FROM supplier""",
)
def supplier_name_key(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text.name_key(F.concat("s_name", F.lit(" Company Ltd."))).alias("name_key"))


@query("AGG-04", "SELECT p_name, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def having_distinct(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.count_distinct("p_brand").alias("brands")).where("brands > 1")


@query(
    "WIN-01, JOIN-14, JOIN-15",
    "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
)
def latest_per_key(t: Tables) -> DataFrame:
    return entities.latest_per_key(t.events, ["user_id"], ["ts", "event_id"], ["event_type"])


@query(
    "JOIN-12",
    """SELECT o_custkey, count(*) AS orders, any_value(last_priority) AS last_priority FROM orders JOIN
       (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1""",
)
def latest_audit_event(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_priority"))


@query(
    "JOIN-16",
    """SELECT user_id, max(ts) FILTER (event_type = 'signup') AS first_at, max(ts) FILTER (event_type = 'purchase') AS then_at
       FROM events GROUP BY user_id HAVING max(ts) FILTER (event_type = 'purchase') >= max(ts) FILTER (event_type = 'signup')""",
)
def asof_exists(t: Tables) -> DataFrame:
    return intervals.followed_by(t.events, "user_id", "ts", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query("AGG-25", "SELECT c_nationkey, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) WHEN count(c_mktsegment) > 0 THEN 'CONFLICT' ELSE 'UNKNOWN' END AS label, count(DISTINCT c_mktsegment) AS n_values FROM customer GROUP BY 1")
def consensus_label(t: Tables) -> DataFrame:
    return entities.consensus(t.customer, ["c_nationkey"], "c_mktsegment")


@query(
    "ST-09",
    """SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(text, turn) FILTER (trim(text) <> '') AS last_text, count(*) AS records FROM conversations GROUP BY conv_id""",
)
def ingest_merge(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.col("role").alias("first_role"), F.col("text").alias("last_text"))
    return entities.ingest(rows, ["conv_id"], ["turn"], ["first_role"], ["last_text"])


@query(
    "ST-10",
    """WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 100 WHEN 'signup' THEN 80 WHEN 'click' THEN 50 ELSE 10 END AS rank FROM events)
       SELECT user_id, max(rank) AS rank, arg_min(event_type, (-rank, event_id)) AS event_type, arg_min(props, event_id) AS props FROM e GROUP BY user_id""",
)
def channel_upgrade(t: Tables) -> DataFrame:
    rank = text.first_match([(F.col("event_type") == k, v) for k, v in (("purchase", 100), ("signup", 80), ("click", 50))], 10)
    return entities.upgrade(t.events.withColumn("rank", rank), ["user_id"], ["event_id"], "rank", ["event_type"], ["props"])


@query(
    "ST-07, ST-08",
    """SELECT source, lang, arg_min(sha256(text), doc_id) AS content, count(*) AS rows, count(DISTINCT text) AS contents,
              CASE WHEN count(DISTINCT text) > 1 THEN 'CONFLICT' WHEN count(*) > 1 THEN 'SKIPPED_REPEATS' ELSE 'APPENDED' END AS outcome
       FROM documents GROUP BY source, lang""",
)
def idempotent_append(t: Tables) -> DataFrame:
    return entities.idempotent(t.documents, ["source", "lang"], F.sha2("text", 256), ["doc_id"])


@query(
    "WIN-21, SET-02, SET-03",
    """WITH u AS (SELECT sha256(text) AS key, 0 AS preference, item_id AS id FROM benchmark UNION ALL SELECT sha256(text), 1, doc_id FROM documents)
       SELECT key, min(preference) AS preference, arg_min(id, (preference, id)) AS id, count(*) AS rows FROM u GROUP BY key""",
)
def source_preference(t: Tables) -> DataFrame:
    key = F.sha2("text", 256).alias("key")
    return entities.preferred([(0, t.benchmark.select(key, F.col("item_id").alias("id"))), (1, t.documents.select(key, F.col("doc_id").alias("id")))], ["key"], ["id"], ["id"])


@query("JOIN-02, JOIN-11, JOIN-27", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def pending_anti(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("JOIN-10, JOIN-13", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_membership(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.where("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_brand")


@query("JOIN-01, JOIN-05, JOIN-06, JOIN-07", "SELECT o_orderpriority, count(*) AS lines, count(DISTINCT o_custkey) AS customers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def inner_lookup(t: Tables) -> DataFrame:
    joined = t.orders.join(t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("lines"), F.count_distinct("o_custkey").alias("customers"))


@query(
    "JOIN-03, JOIN-04, JOIN-08, JOIN-20, JOIN-21, SNK-16",
    "SELECT doc_id, source, coalesce(quality::VARCHAR, 'PENDING') AS decision FROM documents LEFT JOIN labels USING (doc_id)",
)
def attribute_coalesce(t: Tables) -> DataFrame:
    decisions = t.labels.select("doc_id", F.col("quality").cast("string").alias("decision"))
    return entities.overlay(t.documents.select("doc_id", "source"), decisions, ["doc_id"], {"decision": "PENDING"})


@query(
    "JOIN-17, FN-07",
    f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), d(domain) AS (VALUES ('example.com'), ('example.net'), ('spam-farm.example.org'))
        SELECT page_id, host, domain FROM h JOIN d ON host = domain OR ends_with(host, '.' || domain)""",
)
def suffix_domain_match(t: Tables) -> DataFrame:
    domains = t.spark.createDataFrame([("example.com",), ("example.net",), ("spam-farm.example.org",)], "domain string")
    return joins.suffix_join(t.pages.select("page_id", url.domain_key(F.col("url")).alias("host")), F.col("host"), domains, "domain")


@query(
    "JOIN-09",
    "SELECT c_custkey, s_suppkey FROM customer JOIN (SELECT s_nationkey, floor(s_acctbal / 100) AS band, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1, 2) ON c_nationkey = s_nationkey AND floor(c_acctbal / 100) = band",
)
def cross_cohort_overlap(t: Tables) -> DataFrame:
    last = t.supplier.groupBy("s_nationkey", F.floor(F.col("s_acctbal") / 100).alias("band")).agg(F.max("s_suppkey").alias("s_suppkey"))
    on = (F.col("c_nationkey") == F.col("s_nationkey")) & (F.floor(F.col("c_acctbal") / 100) == F.col("band"))
    return t.customer.join(last, on).select("c_custkey", "s_suppkey")


@query(
    "JOIN-23, SET-04",
    """SELECT count(*) FILTER (l AND NOT d) AS missing, count(*) FILTER (l AND d) AS matched, count(*) FILTER (NOT l AND d) AS unlabelled
       FROM (SELECT a.doc_id IS NOT NULL AS l, b.doc_id IS NOT NULL AS d FROM labels a FULL JOIN documents b ON a.doc_id = b.doc_id)""",
)
def shortlist_reconcile(t: Tables) -> DataFrame:
    sides = t.labels.select("doc_id", F.lit(1).alias("l"), F.lit(0).alias("d")).unionByName(t.documents.select("doc_id", F.lit(0).alias("l"), F.lit(1).alias("d")))
    ids = sides.groupBy("doc_id").agg(F.max("l").alias("l"), F.max("d").alias("d"))
    return ids.agg(F.count_if((F.col("l") == 1) & (F.col("d") == 0)).alias("missing"), F.count_if((F.col("l") == 1) & (F.col("d") == 1)).alias("matched"), F.count_if((F.col("l") == 0) & (F.col("d") == 1)).alias("unlabelled"))


@query(
    "JOIN-26",
    """SELECT 'duplicate_id' AS problem, count(*) AS n FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)
       UNION ALL SELECT 'unknown_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def referential_checks(t: Tables) -> DataFrame:
    duplicates = t.labels.groupBy("doc_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_id").alias("problem"), "n")
    unknown = t.labels.join(t.documents, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown_id").alias("problem"), "n")
    return duplicates.unionByName(unknown)


@query(
    "JOIN-22",
    """WITH w AS (SELECT p_partkey, p_brand, p_size, list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS w FROM part)
       SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(a.w, b.w)) AS shared, len(list_distinct(list_concat(a.w, b.w))) AS together
       FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""",
)
def token_jaccard(t: Tables) -> DataFrame:
    """All pairs of parts of one brand and size. As in the SQL, a null name has no words, and shares null as the first of a pair."""
    words = F.when(F.col("p_name").isNotNull(), F.array_distinct(F.split(text.plain_key(F.col("p_name")), " ")))
    known = lambda w: F.coalesce(w, F.array().cast("array<string>"))

    def counts(x: Column, y: Column) -> dict[str, Column]:
        return {"shared": F.when(x.isNotNull(), F.size(F.array_intersect(x, known(y)))), "together": F.size(F.array_union(known(x), known(y)))}

    return joins.class_pairs(t.part.select("p_partkey", "p_brand", "p_size", words.alias("w")), ["p_brand", "p_size"], "p_partkey", "w", counts)


@query("JOIN-22, FN-61")
def fuzzy_name(t: Tables) -> DataFrame:
    """Parts of a brand whose names are alike. Of parts with one name, the first is paired with those of alike names, and the others with firsts only."""
    return joins.similar_to_firsts(t.part.select("p_brand", "p_name", "p_partkey"), "p_brand", "p_name", "p_partkey")


@query(
    "ST-12",
    """WITH s AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
       SELECT conv_id, turn, role, b IS NULL OR b = role OR (b, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS valid FROM s""",
)
def transition_audit(t: Tables) -> DataFrame:
    allowed = t.spark.createDataFrame([("system", "user"), ("user", "assistant"), ("assistant", "user")], "source string, target string")
    return entities.valid_history(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role", allowed)


@query(
    "WIN-17",
    """WITH b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_totalprice < 1000 THEN 'TOO_SMALL' END AS r FROM orders),
       n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, r IS NOT NULL ORDER BY o_orderkey) AS k FROM b)
       SELECT o_orderkey, o_custkey, CASE WHEN r IS NOT NULL THEN r WHEN k > 1 THEN 'DUPLICATE_RECIPIENT' END AS reason FROM n""",
)
def first_accepted(t: Tables) -> DataFrame:
    reason = text.first_match([(F.col("o_orderstatus") == "P", "PENDING"), (F.col("o_totalprice") < 1000, "TOO_SMALL")], F.lit(None).cast("string"))
    return ranking.first_accepted(t.orders.select("o_orderkey", "o_custkey", reason.alias("reason")), ["o_custkey"], ["o_orderkey"], "reason", "DUPLICATE_RECIPIENT")


@query("SRC-05, SRC-06, FN-67, TOP-11, TOP-12", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links FROM pages")
def page_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).cast("long").alias("links"))
