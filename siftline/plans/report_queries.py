"""Queries that report: distributions, yields, ranks, windows, funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import intervals, ranking, reports
from .catalog import Tables, query


def cents(name: str):
    return F.round(F.col(name) * 100).cast("long")


@query("AGG-05", "SELECT p_brand, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def multi_membership(t: Tables) -> DataFrame:
    joined = t.lineitem.select("l_partkey", "l_suppkey").join(t.part.select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return reports.memberships(joined, "p_brand", "l_suppkey")


@query(
    "AGG-06",
    """WITH c AS (SELECT coalesce(o_orderpriority, 'All') AS o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderstatus)))
       SELECT o_orderpriority, o_orderstatus, n, sum(n) OVER (PARTITION BY o_orderpriority)::BIGINT AS total, floor(n * 10000 / sum(n) OVER (PARTITION BY o_orderpriority))::BIGINT AS basis_points FROM c""",
)
def diversity_report(t: Tables) -> DataFrame:
    return reports.distribution(t.orders, "o_orderpriority", "o_orderstatus")


@query("AGG-07, AGG-19", "SELECT c_mktsegment, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents, count(*) AS n, sum(round(c_acctbal * 100)::BIGINT)::BIGINT / count(*) AS mean_cents FROM customer GROUP BY 1")
def average_by_group(t: Tables) -> DataFrame:
    sums = t.customer.groupBy("c_mktsegment").agg(F.coalesce(F.sum(cents("c_acctbal")), F.lit(0)).alias("cents"), F.count("*").alias("n"))
    return sums.select("*", (F.col("cents") / F.col("n")).alias("mean_cents"))


@query("AGG-11", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def sorted_distinct_join(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p")).select("o_custkey", text.sorted_join(F.col("p"), " | ").alias("priorities"))


@query(
    "AGG-09, AGG-10",
    """WITH a AS (SELECT user_id, event_type, max(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END) AS o, max(event_id) AS last FROM events GROUP BY 1, 2)
       SELECT user_id, ['error', 'view', 'click', 'signup', 'purchase'][max(o)] AS state, string_agg(event_type, '; ' ORDER BY event_type) AS kinds, max(last) AS last FROM a GROUP BY 1""",
)
def two_level_states(t: Tables) -> DataFrame:
    names = ["error", "view", "click", "signup", "purchase"]
    level = text.first_match([(F.col("event_type") == n, k + 1) for k, n in enumerate(names)], 1)
    per_kind = t.events.groupBy("user_id", "event_type").agg(F.max(level).alias("o"), F.max("event_id").alias("last"))
    out = per_kind.groupBy("user_id").agg(F.element_at(F.array(*map(F.lit, names)), F.max("o")).alias("state"), F.array_sort(F.collect_set("event_type")).alias("k"), F.max("last").alias("last"))
    return out.select("user_id", "state", F.array_join("k", "; ").alias("kinds"), "last")


@query(
    "AGG-24",
    """SELECT unnest([{rule: 'long', retained: count(*) FILTER (n_chars >= 1000), removed: count(*) FILTER (NOT n_chars >= 1000), good_retained: count(*) FILTER (n_chars >= 1000 AND quality = 1)},
                      {rule: 'english', retained: count(*) FILTER (lang = 'en'), removed: count(*) FILTER (NOT lang = 'en'), good_retained: count(*) FILTER (lang = 'en' AND quality = 1)}], recursive := true)
       FROM documents JOIN labels USING (doc_id)""",
)
def filter_comparison(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "n_chars", "lang").join(t.labels.select("doc_id", "quality"), "doc_id")
    return reports.rule_yield(rows, {"long": F.col("n_chars") >= 1000, "english": F.col("lang") == "en"}, F.col("quality") == 1)


@query("AGG-20", "SELECT event_type, count(value) AS n, quantile_disc(value, 0.95) AS p FROM events GROUP BY 1")
def latency_p95(t: Tables) -> DataFrame:
    return reports.nearest_rank(t.events, "event_type", "value")


RANKED = """WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (ORDER BY o_orderstatus <> 'F', o_orderpriority, o_orderkey) AS rank FROM orders) """


def ranked_orders(t: Tables) -> DataFrame:
    late = F.col("o_orderstatus") != "F"
    return ranking.ranked(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), [late, F.col("o_orderpriority"), F.col("o_orderkey")])


@query("WIN-02, WIN-04, WIN-19, TOP-03", RANKED + "SELECT o_orderkey, rank FROM r")
def rank_selection(t: Tables) -> DataFrame:
    return ranked_orders(t).select("o_orderkey", "rank")


@query(
    "WIN-14, AGG-21, AGG-22, AGG-23, JOIN-19",
    RANKED + """SELECT floor((rank - 1) / 500)::BIGINT + 1 AS window_no, count(*) AS attempted, count(*) FILTER (o_orderstatus = 'F') AS filled, floor(count(*) FILTER (o_orderstatus = 'F') * 10000 / count(*))::BIGINT AS filled_bp FROM r GROUP BY 1""",
)
def rank_window_yield(t: Tables) -> DataFrame:
    return reports.window_yield(intervals.bucketed(ranked_orders(t), "rank", 500), "window_no", {"filled": F.col("o_orderstatus") == "F"})


@query(
    "WIN-07",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, sum(n) OVER (ORDER BY day)::BIGINT AS last_rank, sum(n) OVER (ORDER BY day)::BIGINT - n + 1 AS first_rank FROM d""",
)
def running_cursor(t: Tables) -> DataFrame:
    return intervals.cursor(t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "day", "n")


def spans(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("user_id", at.alias("a"), (at + F.floor(F.col("value") * 60_000_000).cast("long")).alias("b"))


@query(
    "WIN-11",
    """WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + floor(value * 60000000)::BIGINT AS b FROM events),
       f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s WHERE b >= a),
       i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f),
       u AS (SELECT user_id, island, max(b) - min(a) AS n FROM i GROUP BY 1, 2) SELECT user_id, count(*) AS islands, sum(n)::BIGINT AS covered FROM u GROUP BY 1""",
)
def interval_union(t: Tables) -> DataFrame:
    return intervals.union_length(spans(t), ["user_id"], "a", "b", 86_400_000_000)


@query(
    "JOIN-18",
    """WITH s AS (SELECT event_id, epoch_us(ts) // 1000000 AS a, epoch_us(ts) // 1000000 + 3600 AS b FROM events WHERE event_type = 'error'),
       w AS (SELECT unnest(range(19723, 19753)) AS day) SELECT day, count(*) AS touching FROM s JOIN w ON a <= day * 86400 + 86399 AND b >= day * 86400 GROUP BY 1""",
)
def rank_range_join(t: Tables) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    runs = t.events.where("event_type = 'error'").select("event_id", at.alias("a"), (at + 3600).alias("b"))
    days = t.spark.range(19723, 19753).select(F.col("id").alias("day"), (F.col("id") * 86400).alias("low"), (F.col("id") * 86400 + 86399).alias("high"))
    return intervals.overlapping(runs, days, "a", "b", "low", "high", 86400).groupBy("day").agg(F.count("*").alias("touching"))


@query(
    "WIN-15",
    """SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n_recent FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events)""",
)
def rate_window_60s(t: Tables) -> DataFrame:
    timed = t.events.select("event_type", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return intervals.sliding_count(timed, ["event_type"], "s", 60).select("event_type", "event_id", "n_recent")


@query("WIN-16, ST-06", "SELECT CAST(ts AS DATE) AS day, count(*) AS sent, greatest(0, count(*) - 300) AS over_cap FROM events GROUP BY 1")
def daily_cap(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("sent")).select("day", "sent", F.greatest(F.lit(0), F.col("sent") - 300).alias("over_cap"))


@query(
    "WIN-06, TOP-07",
    """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, least(n::DOUBLE, 137 * n / sum(n) OVER ()) AS x, sum(n) OVER () AS all_n FROM g),
       f AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, source) AS k, least(137, all_n) - sum(floor(x)) OVER () AS rest FROM e),
       q AS (SELECT source, (floor(x) + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM f),
       d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS group_rank FROM documents)
       SELECT doc_id, source, group_rank, quota FROM d JOIN q USING (source) WHERE group_rank <= quota""",
)
def proportional_quota(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source", "n_chars")
    return ranking.quota_sample(rows, "source", [F.col("n_chars").desc(), F.col("doc_id")], 137).select("doc_id", "source", "group_rank", "quota")


@query("WIN-18")
def round_robin_pick(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("key"), "o_orderstatus")
    return ranking.round_robin(rows, "o_orderstatus", "key", ["o_orderkey"], {"F": 3, "O": 1}, 100)


@query(
    "SET-01, AGG-15, FN-36",
    """SELECT status, count(*) AS n FROM (SELECT 'OUTCOME-' || o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'INTERESTED' WHEN '2-HIGH' THEN 'MORE_INFO' ELSE 'UNKNOWN' END AS status FROM orders WHERE o_orderstatus = 'F'
         UNION ALL SELECT 'FORM-' || o_orderkey, 'PENDING_VERIFICATION' FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'NO-RESPONSE-' || o_orderkey, 'NO_RESPONSE' FROM orders WHERE o_orderstatus = 'O') GROUP BY 1
       UNION ALL SELECT 'NEEDS_FOLLOW_UP', count(*) FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR o_orderstatus = 'P'""",
)
def response_events(t: Tables) -> DataFrame:
    counts = responses(t).groupBy("status").agg(F.count("*").alias("n"))
    follow = counts.where(F.col("status").isin("INTERESTED", "MORE_INFO", "PENDING_VERIFICATION")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("NEEDS_FOLLOW_UP").alias("status"), "n")
    return counts.unionByName(follow)


def responses(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "INTERESTED").when(F.col("o_orderpriority") == "2-HIGH", "MORE_INFO").otherwise("UNKNOWN")
    leg = lambda state, prefix, label: t.orders.where(F.col("o_orderstatus") == state).select(F.concat(F.lit(prefix), "o_orderkey").alias("record_id"), "o_custkey", "o_orderdate", label.alias("status"))
    return leg("F", "OUTCOME-", status).unionByName(leg("P", "FORM-", F.lit("PENDING_VERIFICATION"))).unionByName(leg("O", "NO-RESPONSE-", F.lit("NO_RESPONSE")))


@query(
    "PRJ-05, TOP-05, TOP-06",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'P') AND CAST(o_orderdate AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' AND instr(lower(o_orderpriority), 'high') > 0
       ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50""",
)
def response_page(t: Tables) -> DataFrame:
    rows = t.orders.where(F.col("o_orderstatus").isin("F", "P") & F.to_date("o_orderdate").between(F.lit("1993-01-01").cast("date"), F.lit("1997-12-31").cast("date")) & F.contains(F.lower("o_orderpriority"), F.lit("high")))
    return ranking.page(rows.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey")], 2, 50)


@query("PRJ-01, SET-05", "SELECT DISTINCT p_brand, p_type FROM part WHERE contains(lower(p_name), 'an') AND p_type IN (SELECT p_type FROM part WHERE p_size = 1)")
def facet_filter(t: Tables) -> DataFrame:
    kinds = t.part.where("p_size = 1").select("p_type").distinct()
    return t.part.where(F.contains(F.lower("p_name"), F.lit("an"))).join(kinds, "p_type", "left_semi").select("p_brand", "p_type").distinct()


@query("PRJ-17, AGG-02, AGG-03", "SELECT count(*) FILTER (url LIKE '%.html') AS html, count(*) FILTER (length(url) > 40) AS long, count(DISTINCT CASE WHEN url LIKE 'https:%' THEN split_part(url, '/', 3) END) AS secure_hosts FROM pages")
def pattern_counts(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.agg(F.count_if(u.endswith(".html")).alias("html"), F.count_if(F.length(u) > 40).alias("long"), F.count_distinct(F.when(u.startswith("https:"), F.split_part(u, F.lit("/"), F.lit(3)))).alias("secure_hosts"))


@query(
    "AGG-16, AGG-18, AGG-36, AGG-40, PRJ-21",
    """SELECT count(*) AS items, count(DISTINCT o_custkey) AS companies, count(*) FILTER (o_orderstatus = 'F') AS delivered, count(*) FILTER (r) AS responded, greatest(0, 100000 - count(*) FILTER (r)) AS gap
       FROM (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS r FROM orders)""",
)
def funnel_analytics(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("r", F.lit(True))
    rows = t.orders.join(returned, "o_orderkey", "left")
    got = F.count_if(F.coalesce("r", F.lit(False)))
    return rows.agg(F.count("*").alias("items"), F.count_distinct("o_custkey").alias("companies"), F.count_if(F.col("o_orderstatus") == "F").alias("delivered"), got.alias("responded"), F.greatest(F.lit(0), F.lit(100000) - got).alias("gap"))


@query("AGG-26", "SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1, 2")
def json_metric(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_type", k.alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("AGG-28", "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM d")
def counter_deltas(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.select("day", "n", (F.col("n") - F.lag("n").over(Window.orderBy("day"))).alias("delta"))


@query("AGG-29, AGG-37", "SELECT target, ceil(target * 30.0 / count(*))::BIGINT AS days FROM events, (VALUES (1000), (2500), (5000)) v(target) GROUP BY target")
def projection(t: Tables) -> DataFrame:
    rate = t.events.agg(F.count("*").alias("n"))
    return rate.select(F.explode(F.array(*map(F.lit, (1000, 2500, 5000)))).alias("target"), "n").select("target", F.ceil(F.col("target") * 30.0 / F.col("n")).alias("days"))


@query("AGG-31, AGG-41", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 100")
def top_locations(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(100)


@query("AGG-33", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_nationkey < 12 AND c_mktsegment <> 'MACHINERY' GROUP BY 1")
def registry_targets(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 0 AND c_nationkey < 12 AND c_mktsegment <> 'MACHINERY'").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(
    "AGG-34, AGG-35",
    """SELECT count(*) AS parsed, count(*) FILTER (b) AS known, count(*) FILTER (k > 1) AS repeated, count(*) FILTER (NOT b AND k = 1) AS new_unique FROM
       (SELECT text IN (SELECT text FROM benchmark) AS b, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents)""",
)
def import_statistics(t: Tables) -> DataFrame:
    sha = F.sha2("text", 256).alias("key")
    groups = t.documents.groupBy(sha).agg(F.count("*").alias("n"))
    known = t.benchmark.select(sha, F.lit(True).alias("b")).distinct()
    g = groups.join(known, "key", "left").withColumn("b", F.coalesce("b", F.lit(False)))
    return g.agg(F.sum("n").alias("parsed"), F.coalesce(F.sum(F.when(F.col("b"), F.col("n"))), F.lit(0)).alias("known"), F.sum(F.col("n") - 1).alias("repeated"), F.count_if(~F.col("b")).alias("new_unique"))


@query("AGG-38", "SELECT doc_id, coalesce(nullif(concat_ws('; ', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END), ''), 'unspecified') AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclusion_queue(t: Tables) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "language")))
    rest = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id", "left_anti")
    return rest.select("doc_id", F.when(F.size(reasons) == 0, "unspecified").otherwise(F.array_join(reasons, "; ")).alias("reason"))


@query(
    "AGG-39, AGG-12",
    """SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_status, arg_max(o_orderpriority, o_orderkey) AS last_priority, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1""",
)
def company_rollup(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("first_status"), F.max_by("o_orderpriority", "o_orderkey").alias("last_priority"), F.collect_set("o_orderstatus").alias("s"))
    return g.select("o_custkey", "first_status", "last_priority", text.sorted_join(F.col("s"), ";").alias("statuses"))


@query("TOP-01, TOP-02, TOP-08, WIN-22", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC NULLS LAST, lower(s_name), s_suppkey LIMIT 20")
def top_by_score(t: Tables) -> DataFrame:
    return t.supplier.where("s_acctbal > 0").orderBy(F.col("s_acctbal").desc_nulls_last(), F.lower("s_name"), "s_suppkey").limit(20).select("s_suppkey", "s_name")


@query("AGG-27")
def table_digest(t: Tables) -> DataFrame:
    return reports.digest(t.supplier, "s_suppkey")


@query("PRJ-15", "SELECT c_custkey FROM (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_acctbal DESC, c_custkey LIMIT 50) WHERE c_nationkey < 10")
def limit_before_filter(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).orderBy(F.desc("c_acctbal"), "c_custkey").limit(50).where("c_nationkey < 10").select("c_custkey")
