"""Order-dependent operators against plain Python."""

import math
import random
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.operators import entities, intervals, joins, ranking, reports


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(0, 25)), min_size=1, max_size=25))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_interval_union(spark, rows):
    df = spark.createDataFrame([(k, a, a + n) for k, a, n in rows], "k long, a long, b long")
    want = {k: len({x for j, a, n in rows if j == k for x in range(a, a + n)}) for k, _, _ in rows}
    for chunk in (1, 7, 1000):
        got = {r.k: (r.covered, r.islands) for r in intervals.union_length(df, ["k"], "a", "b", chunk).collect()}
        assert {k: c for k, (c, _) in got.items()} == want
        assert all(got[k][1] == len({a for j, a, n in rows if j == k and not any(i == k and b < a <= b + m for i, b, m in rows)}) for k in want)


def test_quotas_deal_everything(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1), ("d", 0)], "g string, n long")
    got = {r.g: r.quota for r in ranking.quotas(sizes, "g", "n", 10).collect()}
    assert got == {"a": 5, "b": 5, "c": 0, "d": 0}
    assert {r.g: r.quota for r in ranking.quotas(sizes, "g", "n", 99).collect()} == {"a": 10, "b": 10, "c": 1, "d": 0}


def test_round_robin(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("AB"), rng.choice("abcdefghij") + rng.choice("xyz")) for i in range(200)] + [(900, "A", None)]
    queues, seen, want = {b: [r for r in rows if r[1] == b and r[2]] for b in "AB"}, set(), []
    while len(want) < 12 and any(queues.values()):
        for b, w in (("A", 3), ("B", 1)):
            for _ in range(w):
                while queues[b] and queues[b][0][2] in seen:
                    queues[b].pop(0)
                if queues[b] and len(want) < 12:
                    seen.add(queues[b][0][2])
                    want.append(queues[b].pop(0)[0])
    df = spark.createDataFrame(rows, "i long, b string, k string")
    got = ranking.round_robin(df, "b", "k", ["i"], {"A": 3, "B": 1}, 12).orderBy("pick").collect()
    assert [r.i for r in got] == want


def test_ranked_is_one_order(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 9)  # many ranges
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.randrange(5), rng.choice([None, 1, 2])) for i in range(100)], "i long, b long, c long")
    got = ranking.ranked(df, [F.col("b"), F.col("c").asc_nulls_first(), F.col("i")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 101))
    assert [(r.b, r.c or 0, r.i) for r in got] == sorted((r.b, r.c or 0, r.i) for r in got)
    for r in ranking.ranked(df, [F.col("i").desc()], ["c"]).collect():
        assert r["rank"] == sum(1 for x in got if x.c == r.c and x.i >= r.i)
    same = ranking.ranked(df, [F.lit(1)]).collect()
    assert sorted(r["rank"] for r in same) == list(range(1, 101))
    assert ranking.ranked(df.where("i < 0"), [F.col("i")]).count() == 0


def test_percentiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 9)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, -1.5, 0.0, 2.25, rng.random()])) for _ in range(150)] + [("n", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for share in (0.5, 0.95, 1.0):
        for r in reports.nearest_rank(df, "k", "v", share).collect():
            own = sorted(v for k, v in rows if k == r.k and v is not None)
            assert (r.n, r.p) == (len(own), own[math.ceil(share * len(own)) - 1] if own else None)


def test_quota_sample_takes_the_first_of_each_group(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("aaaabbc"), rng.randrange(50)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, x long")
    got = ranking.quota_sample(df, "g", [F.col("x").desc(), F.col("i")], 20).collect()
    assert len(got) == 20
    for g in {r.g for r in got}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.group_rank)
        assert [r.i for r in mine] == [r[0] for r in own[: mine[0].quota]]


def test_sliding_counts_over_cells(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", None]), rng.choice([rng.randrange(-50, 400), 100])) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k string, s long")
    for cell in (1, 60, 100, 3600):
        got = {r.i: r.n_recent for r in intervals.sliding_count(df, ["k"], "s", 60, cell).collect()}
        assert got == {i: sum(1 for _, j, t in rows if j == k and s - 60 <= t <= s) for i, k, s in rows}


def test_ingest_and_upgrade(spark):
    rows = [("a", 1, "A1", "x", 10), ("a", 2, "A2", "", 50), ("a", 3, "A3", "z", 50), ("b", 4, "B1", None, 0)]
    df = spark.createDataFrame(rows, "k string, pos long, name string, industry string, rank long")
    got = {r.k: (r.name, r.industry, r.records) for r in entities.ingest(df, ["k"], ["pos"], ["name"], ["industry"]).collect()}
    assert got == {"a": ("A1", "z", 3), "b": ("B1", None, 1)}
    up = {r.k: (r["rank"], r.name, r.industry) for r in entities.upgrade(df, ["k"], ["pos"], "rank", ["name"], ["industry"]).collect()}
    assert up == {"a": (50, "A2", "x"), "b": (0, "B1", None)}


def test_overlapping_counts_each_pair_once(spark):
    rng = random.Random(3)
    runs = [(i, a, a + rng.randrange(0, 300)) for i, a in enumerate(rng.randrange(-100, 1000) for _ in range(60))]
    windows = [(i, i * 90, i * 90 + 130) for i in range(10)]
    got = intervals.overlapping(spark.createDataFrame(runs, "r long, a long, b long"), spark.createDataFrame(windows, "w long, lo long, hi long"), "a", "b", "lo", "hi", 50)
    assert sorted((x.r, x.w) for x in got.collect()) == sorted((r, w) for r, a, b in runs for w, lo, hi in windows if a <= hi and b >= lo)


def test_first_accepted_ignores_blocked_rows(spark):
    df = spark.createDataFrame([(1, "k", "BLOCKED"), (2, "k", None), (3, "k", None), (4, "j", None)], "i long, k string, why string")
    got = {r.i: r.why for r in ranking.first_accepted(df, ["k"], ["i"], "why", "DUP").collect()}
    assert got == {1: "BLOCKED", 2: None, 3: "DUP", 4: None}


def test_collisions_of_blank_names_and_digest(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b"), (3, "x", "a")], "i long, n string, d string")
    got = {r.i: r.collides for r in entities.collisions(df, [F.coalesce("n", F.lit(""))], "i", F.col("d")).collect()}
    assert got == {1: True, 2: True, 3: False}
    assert reports.digest(df, "i").first() == reports.digest(df.repartition(7).orderBy(F.desc("i")), "i").first()


def test_name_similarity(spark):
    import difflib

    pairs = [("Blue Fern", "Blue Fern Inn"), ("Old Oak", "Oak Old"), ("abc", "xyz")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", joins.name_similarity(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        x, y = set(r.a.lower().split()), set(r.b.lower().split())
        assert abs(r.s - max(difflib.SequenceMatcher(None, r.a.lower(), r.b.lower()).ratio(), len(x & y) / len(x | y))) < 1e-4


def ratio(a, b):
    import difflib
    import re

    a, b = (re.sub("[^a-z0-9]+", " ", (n or "").lower()).strip() for n in (a, b))
    x, y = set(a.split(" ")), set(b.split(" "))
    return round(max(difflib.SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y)), 4)


def test_similar_names_match_brute_force(spark):
    rng = random.Random(14)
    names = ["", None, "a", "Ab", "blue fern", "fern, blue", "xa blue fern inn of the old quay", "old quay of the blue fern inn"]
    names += ["".join(rng.choice("aab c") for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    rows = [(i % 2, i, n) for i, n in enumerate(names * 2)]
    left = spark.createDataFrame(rows, "block long, a long, name string")
    got = joins.similar_names(left, left.select("block", F.col("a").alias("b"), F.col("name").alias("other")), "block", "name", "other").where("a < b")
    want = {(a, b): ratio(x, y) for p, a, x in rows for q, b, y in rows if p == q and a < b and ratio(x, y) >= 0.72}
    assert got.columns == ["block", "a", "name", "similarity", "b", "other"]
    assert {(r.a, r.b): r.similarity for r in got.collect()} == want and got.count() == len(want)


def test_fuzzy_name_reads_all_sizes(spark):
    from types import SimpleNamespace

    from siftline.plans import catalog, entity_queries

    assert "fuzzy_name" in catalog.QUERIES
    rows = [(1, "Brand#1", 3, "blue bolt"), (2, "Brand#1", 30, "blue bolt"), (3, "Brand#1", 31, "blue bolts"), (4, "Brand#2", 30, "blue bolt"), (5, "Brand#1", 40, "hot gear")]
    part = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_name string")
    got = entity_queries.fuzzy_name(SimpleNamespace(part=part)).collect()
    assert {(r.a, r.b) for r in got} == {(1, 2), (1, 3), (2, 3)}


def test_similar_to_firsts_loses_no_pair_and_grows_with_the_names(spark):
    rng = random.Random(15)
    names = ["", None, "a", "Ab", "blue fern", "fern, blue"] + ["".join(rng.choice("aab c") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = [(i % 2, i, n) for i, n in enumerate(names * 6)]
    df = spark.createDataFrame(rows, "block long, a long, name string")
    got = joins.similar_to_firsts(df, "block", "name", "a").collect()
    paired = joins.similar_names(df, df.select("block", F.col("a").alias("b"), F.col("name").alias("other")), "block", "name", "other").where("a < b").collect()
    every = {(r.a, r.b): r.similarity for r in paired}
    shown = {(r.a, r.b): r.similarity for r in got if r.similarity is not None}
    assert shown.items() <= every.items() and len({(r.a, r.b) for r in got}) == len(got) < len(every) / 2
    first = {r.b: r.a for r in got if r.same_key}
    of = lambda i: first.get(i, i)
    linked = {(r.a, r.b) for r in got if r.similarity is not None} | {(r.b, r.a) for r in got if r.reverse is not None}
    ids = [(p, i) for p, i, _ in rows]
    assert {(i, j) for p, i in ids for q, j in ids if p == q and i < j and (of(i) == of(j) or (of(i), of(j)) in linked)} == set(every)
    copies = {r.b: r.b_copies for r in got if r.b_copies} | {r.a: r.a_copies for r in got if r.a_copies}
    assert all(n == 1 + sum(of(i) == f and i != f for _, i in ids) for f, n in copies.items())


def test_block_pairs_spread_one_large_group(spark):
    rows = [("big" if i < 300 else None if i % 5 == 0 else f"g{i % 9}", i if i % 50 else None, i * i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = joins.block_pairs(df, ["g"], "k", block_rows=16, task_pairs=1000)
    want = {(p, q) for g, p, _ in rows for h, q, _ in rows if g is not None and g == h and p is not None and q is not None and p < q}
    pairs = [(r.a.k, r.b.k) for r in got.collect()]
    assert len(pairs) == len(want) and set(pairs) == want and got.first().a.v == got.first().a.k ** 2
    shares = [r.n for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(shares) > 10 and max(shares) < len(want) / 5
    assert joins.block_pairs(df.where("false"), ["g"], "k").count() == 0


def test_class_pairs_write_out_each_pair_once(spark):
    rows = [("big" if i < 300 else None if i % 5 == 0 else f"g{i % 9}", i % 390 if i % 50 else None, None if i % 7 == 0 else i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = joins.class_pairs(df, ["g"], "k", "v", lambda x, y: {"x": x, "less": F.coalesce(x - y, F.lit(9))}, class_rows=16)
    want = [(p, q, v, 9 if v is None or w is None else v - w) for g, p, v in rows for h, q, w in rows if g is not None and g == h and p is not None and q is not None and p < q]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert got.columns == ["a", "b", "x", "less"] and sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert joins.class_pairs(df.where("false"), ["g"], "k", "v", lambda x, y: {"x": x}).count() == 0


def test_token_jaccard_reads_all_sizes(spark):
    from types import SimpleNamespace

    import duckdb

    from siftline.plans import catalog, entity_queries

    names = ["blue bolt", "Blue, blue bolt", "hot gear", "hot bolt", "", "!!", None, "blue bolt"]
    rows = [(100 * size + i, "Brand#1", size, n) for size in (1, 5, 6, 50) for i, n in enumerate(names)] + [(7, "Brand#2", 6, "blue bolt"), (8, "Brand#1", None, "blue bolt"), (9, None, 6, "blue bolt"), (603, "Brand#1", 6, "hot")]
    part = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_name string")
    got = [tuple(r) for r in entity_queries.token_jaccard(SimpleNamespace(part=part)).select("a", "b", "shared", "together").collect()]
    assert {(600, 601, 2, 2), (600, 602, 0, 4), (5000, 5003, 1, 3), (5002, 5006, 0, 2), (5006, 5007, None, 2)} <= set(got)
    con = duckdb.connect()
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_brand VARCHAR, p_size INTEGER, p_name VARCHAR)")
    con.executemany("INSERT INTO part VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(str, got)) == sorted(map(str, con.execute(catalog.ORACLE_SQL["token_jaccard"]).fetchall()))


def test_overlay_and_preferred(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    over = spark.createDataFrame([(1, "z")], "id long, v string")
    assert {r.id: r.v for r in entities.overlay(base, over, ["id"], {"v": "PENDING"}).collect()} == {1: "z", 2: "PENDING"}
    legs = [(1, spark.createDataFrame([("k", 5)], "k string, i long")), (0, spark.createDataFrame([("k", 9)], "k string, i long"))]
    assert entities.preferred(legs, ["k"], ["i"], ["i"]).first().i == 9


def test_components_of_reports(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "g string, c string")
    rows = defaultdict(dict)
    for r in reports.distribution(df, "g", "c").collect():
        rows[r.g][r.c] = (r.n, r.total, r.basis_points)
    assert rows == {"a": {"x": (1, 2, 5000), "y": (1, 2, 5000)}, "b": {"x": (1, 1, 10000)}, "All": {"x": (2, 3, 6666), "y": (1, 3, 3333)}}


def test_campaigns(spark):
    from siftline.operators import campaigns

    page = '{"pages":[{"fetch_status":"SUCCESS","http_status":200,"visible_text_length":90}]}'
    candidates = spark.createDataFrame([("a", "VERIFIED", "ELIGIBLE", page), ("b", "VERIFIED", "ELIGIBLE", "{}"), ("c", "VERIFIED", "ELIGIBLE", page)], "candidate_id string, verification_status string, geo_eligibility_status string, evidence_json string")
    channels = spark.createDataFrame([(i, "GENERAL_BUSINESS_EMAIL", f"hi@{i}.org", "", "PENDING") for i in "abc"] + [("a", "CONTACT_FORM", None, "text only", "PENDING")], "candidate_id string, channel_type string, email string, evidence string, review_status string")
    overlay = spark.createDataFrame([("c", "LIKELY_CHAIN_OR_FRANCHISE")], "candidate_id string, chain_location_concern string")
    assert [(r.candidate_id, r.channel_type) for r in campaigns.contactable(channels, candidates, overlay, []).collect()] == [("a", "GENERAL_BUSINESS_EMAIL")]
    rows = spark.createDataFrame([(1, "x", 5), (2, "y", 9), (3, "y", 1), (1, "y", 7)], "k long, kind string, score long")
    got = campaigns.mixed_sample(rows, [F.col("kind") == "x", F.col("kind") == "y"], "k", "score", 2).collect()
    assert [(r.k, r.leg) for r in got] == [(1, 0), (2, 1)]
    assert campaigns.recheck_sample(rows, {"low": F.col("score") < 6, "high": F.col("score") >= 6}, "k", 1).count() == 2
    old = spark.createDataFrame([(1, "2020", "a"), (3, "2021", "c")], "id long, created string, v string")
    new = spark.createDataFrame([(1, "2024", "A"), (2, "2024", "B")], "id long, created string, v string")
    assert sorted(map(tuple, campaigns.registry(new, old, "id", ["created"]).collect())) == [(1, "2020", "A"), (2, "2024", "B"), (3, "2021", "c")]
    inv = spark.createDataFrame([("t", 10, True), ("u", 10, False)], "token_hash string, expires_at long, delivered boolean")
    subs = spark.createDataFrame([("t", "r1", 1), ("t", "r1", 2), ("t", "r2", 3), ("t", "r3", 11), ("u", "r", 1), ("z", "r", 1)], "token_hash string, response_hash string, submitted_at long")
    assert sorted((r.token_hash, r.submitted_at, r.outcome) for r in campaigns.accepted_submissions(subs, inv).collect()) == [("t", 1, "ACCEPTED"), ("t", 2, "DUPLICATE"), ("t", 3, "NEEDS_REVIEW"), ("t", 11, "EXPIRED"), ("u", 1, "NOT_DELIVERED"), ("z", 1, "UNKNOWN_REFERENCE")]
    drafts = spark.createDataFrame([("A@x.org",), ("b@x.org",), ("c@x.org",)], "recipient string")
    sup = spark.createDataFrame([("a@X.org",)], "email string")
    replies = spark.createDataFrame([("b@x.org", "UNSUBSCRIBE"), ("c@x.org", "QUESTION")], "email string, reply_class string")
    assert [r.recipient for r in campaigns.suppressed(drafts, sup, replies).collect()] == ["c@x.org"]


def test_page_people_deals_pages_over_tasks(spark, monkeypatch):
    from siftline.plans import page_queries

    monkeypatch.setattr(page_queries, "PER_TASK", 10)
    monkeypatch.setattr(page_queries.channels, "contact_evidence", lambda pages, *_: pages.selectExpr("c_custkey", "html AS name", "html AS title", "html AS email", "html AS contact_type"))
    customer = spark.createDataFrame([(i, 1, "BUILDING", 1.0) for i in range(95)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").coalesce(1)
    from types import SimpleNamespace

    pages = page_queries.page_people(SimpleNamespace(customer=customer, nation=spark.createDataFrame([(1, "PERU")], "n_nationkey int, n_name string")))
    shares = [r.n for r in pages.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(shares) == 95 and len(shares) == 10 and max(shares) <= 11
