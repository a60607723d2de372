"""Queries of lists filtered by parameters, their facets and gated shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import filters
from .catalog import Tables, query

POOL = filters.Filters(search=("c_name", "domain"), equal=("c_mktsegment", "status"))
SCREENED = filters.Filters(search=("c_name", "domain"), equal=("c_mktsegment", "status", "screen_status"))
REGISTRY = filters.Filters(search=("name", "website", "profile"), equal=("kind", "consent", "identity", "contact", "screening", "recruitment", "research", "geography"), contains=("industry", "location"))
COMPANIES = filters.Filters(search=("company_name", "website", "industry", "location"), joined=True, member=("sources",), equal=("verification", "eligibility", "priority"))

CUSTOMERS_SQL = """WITH c AS (SELECT *, 'c' || c_custkey || '.com' AS domain, CASE WHEN c_acctbal >= 3000 THEN 'VERIFIED' WHEN c_acctbal >= 0 THEN 'DISCOVERED' ELSE 'BLOCKED' END AS status, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) """


def customers(t: Tables) -> DataFrame:
    status = F.when(F.col("c_acctbal") >= 3000, "VERIFIED").when(F.col("c_acctbal") >= 0, "DISCOVERED").otherwise("BLOCKED")
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return rows.withColumn("domain", F.concat(F.lit("c"), "c_custkey", F.lit(".com"))).withColumn("status", status)


@query("PRJ-01", CUSTOMERS_SQL + "SELECT c_custkey, c_name, domain FROM c WHERE (lower(c_name) LIKE '%r#0000001%' OR lower(domain) LIKE '%r#0000001%') AND status = 'VERIFIED'")
def pool_list(t: Tables) -> DataFrame:
    return filters.filtered(customers(t), POOL, {"q": " R#0000001 ", "c_mktsegment": "", "status": "VERIFIED", "unknown": "x"}).select("c_custkey", "c_name", "domain")


@query(
    "PRJ-02",
    CUSTOMERS_SQL
    + """, s AS (SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'HOLD' ELSE 'PASS' END AS screen_status, sum(o_totalprice) AS score FROM orders GROUP BY 1)
       SELECT c_custkey, screen_status, floor(score)::BIGINT AS score FROM c JOIN s ON o_custkey = c_custkey WHERE contains(domain, '1.com') AND screen_status = 'PASS'""",
)
def screened_list(t: Tables) -> DataFrame:
    """Scores are sums of doubles, rounded down: each customer's orders are added in the order of the table's key, as the SQL reads them, however rows are dealt over tasks."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice")
    upto = F.sum("o_totalprice").over(order.rowsBetween(Window.unboundedPreceding, 0))
    summed = t.orders.select("o_custkey", "o_orderstatus", upto.alias("upto"), F.row_number().over(order).alias("k"))
    screen = summed.groupBy("o_custkey").agg(F.when(F.count_if(F.col("o_orderstatus") == "P") > 0, "HOLD").otherwise("PASS").alias("screen_status"), F.floor(F.max_by("upto", "k")).alias("score"))
    joined = customers(t).join(screen, F.col("c_custkey") == F.col("o_custkey"))
    return filters.filtered(joined, SCREENED, {"q": "1.COM", "status": None, "screen_status": "PASS"}).select("c_custkey", "screen_status", "score")


@query(
    "PRJ-03",
    """WITH r AS (SELECT p_partkey, p_name AS name, 'https://p' || p_partkey || '.example' AS website, 'part:' || p_partkey AS profile, p_type AS kind, p_brand AS consent, p_name || ' / ' || p_type AS industry FROM part)
       SELECT p_partkey, name FROM r WHERE (contains(lower(name), 'an') OR contains(lower(website), 'an') OR contains(lower(profile), 'an')) AND kind = (SELECT min(p_type) FROM part) AND contains(lower(industry), 'e')""",
)
def registry_list(t: Tables) -> DataFrame:
    kind = t.part.agg(F.min("p_type")).first()[0]
    rows = t.part.select("p_partkey", F.col("p_name").alias("name"), F.concat(F.lit("https://p"), "p_partkey", F.lit(".example")).alias("website"), F.concat(F.lit("part:"), "p_partkey").alias("profile"), F.col("p_type").alias("kind"), F.col("p_brand").alias("consent"), F.concat_ws(" / ", "p_name", "p_type").alias("industry"))
    return filters.filtered(rows, REGISTRY, {"q": "AN", "kind": kind, "consent": "", "industry": "E", "location": None}).select("p_partkey", "name")


COMPANY_SQL = CUSTOMERS_SQL + """, d AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS sources FROM orders GROUP BY 1),
       l AS (SELECT c_custkey, c_name AS company_name, 'https://' || domain AS website, c_mktsegment AS industry, n_name AS location, coalesce(sources, []) AS sources, status AS verification FROM c LEFT JOIN d ON o_custkey = c_custkey) """


def listed(t: Tables) -> DataFrame:
    sources = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("sources"))
    joined = customers(t).join(sources, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.col("c_name").alias("company_name"), F.concat(F.lit("https://"), "domain").alias("website"), F.col("c_mktsegment").alias("industry"), F.col("n_name").alias("location"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.col("status").alias("verification"))


@query("PRJ-04", COMPANY_SQL + "SELECT c_custkey FROM l WHERE list_contains(sources, '1-URGENT') AND contains(lower(company_name || ' ' || website || ' ' || industry || ' ' || location), '.com b') AND verification = 'DISCOVERED'")
def member_list(t: Tables) -> DataFrame:
    """The search runs over the joined text, so it may cross from a website into an industry."""
    return filters.filtered(listed(t), COMPANIES, {"q": ".COM B", "sources": "1-URGENT", "verification": "DISCOVERED", "priority": " "}).select("c_custkey")


@query(
    "SET-05",
    COMPANY_SQL + "SELECT 'industry' AS facet, industry AS value, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'location', location, count(*) FROM l GROUP BY 2 UNION ALL SELECT 'sources', s, count(*) FROM (SELECT unnest(sources) AS s FROM l) GROUP BY 2",
)
def facet_values(t: Tables) -> DataFrame:
    return filters.facets(listed(t), ["industry", "location", "sources"])


@query(
    "WIN-03, TOP-08",
    """WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F')
       SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS selection_rank FROM f WHERE k = 1 QUALIFY selection_rank <= 50""",
)
def gated_shortlist(t: Tables) -> DataFrame:
    """The 50 dearest filled orders, one a customer."""
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return filters.shortlist(t.orders, F.col("o_orderstatus") == "F", order, 50, "o_custkey").select("o_orderkey", "selection_rank")
