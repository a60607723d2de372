"""Record operators on nulls, broken JSON, empty tables and the edges of their rules."""

import json

from pyspark.sql import functions as F

from siftline.operators import records

TITLES = [
    ("Deep Blue Inc", "https://deep.com", "SUCCESS", None, "Deep Blue | Home", None, "VERIFIED"),
    ("Deep Blue Inc", "https://deep.com", "PARTIAL", "", "Blue and deep", None, "VERIFIED"),
    ("Deep Blue", "https://deep.com", "SUCCESS", None, "Deep", None, "AMBIGUOUS"),
    ("AB", "https://ab.com", "SUCCESS", None, "Welcome", None, "AMBIGUOUS"),
    (None, "https://ab.com", "SUCCESS", None, None, None, "AMBIGUOUS"),
    ("Deep", "https://deep.com", "SUCCESS", "https://m.facebook.com/deep", "Deep", None, "REJECTED_THIRD_PARTY"),
    ("Deep", "https://deep.com", "SUCCESS", None, "Deep", "Parked Domain", "REJECTED_PARKED"),
    ("Deep", None, "ROBOTS_DENIED", None, None, None, "ROBOTS_DENIED"),
    ("Deep", None, None, None, "Deep", None, "FETCH_FAILED"),
]


def test_title_check(spark):
    names = ["name", "site", "fetch", "final", "title", "description"]
    rows = spark.createDataFrame(TITLES, ", ".join(f"{n} string" for n in [*names, "want"]))
    got = rows.select(records.title_check(*map(F.col, names)).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_site_rows_without_sources(spark):
    companies = spark.createDataFrame([(1, "https://www.a.com"), (2, None), (3, "https://c.com")], "id int, website string")
    found = spark.createDataFrame([(1, "B", "t", "i", None, "{"), (1, "A", "t", "i", "u", '{"source_directory_url": "r"}'), (1, "A", "t", "i", "u", None)], "id int, source_name string, source_type string, source_identifier string, source_url string, raw_data string")
    shots = spark.createDataFrame([(1, "http://a.com/x", "SUCCESS"), (2, "https://b.com", None), (3, None, "BLOCKED")], "id int, final_url string, fetch_status string")
    got = {r.id: tuple(r)[1:] for r in records.site_rows(companies, found, shots, "id").collect()}
    assert got[1] == ("A | B", "i", "u", "r", "a.com", "SUCCESS", False)
    assert got[2] == ("", "", "", "", None, "NOT_FETCHED", True)
    assert got[3] == ("", "", "", "", "c.com", "BLOCKED", False)
    assert records.site_rows(companies.limit(0), found, shots, "id").collect() == []


def test_contracts_on_nulls(spark):
    null, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    pages = F.lit(None).cast("array<struct<url:string,excerpt:string>>")
    nameless = F.array(F.struct(null.alias("url"), F.lit("x").alias("excerpt")))
    row = spark.range(1).select(
        records.screening_error(texts).alias("a"),
        records.screening_error(F.array(null, F.lit('{"t": "a PRECISE percentage"}'))).alias("b"),
        records.analysis_error(null, null, pages, null, null).alias("c"),
        records.analysis_error(F.lit("PAID_API"), F.lit("LOW"), nameless, null, null).alias("d"),
        records.analysis_error(F.lit("PAID_API"), F.lit("LOW"), F.array(F.struct(F.lit("u").alias("url"), F.lit("x").alias("excerpt"))), F.lit("s"), F.lit("a 12% uplift")).alias("e"),
    ).first()
    assert tuple(row) == ("must contain 1 to 3 opportunities", "precise claims of uplift", "unsupported mode", "evidence without source or excerpt", "unsupported guarantee")


def test_result_records(spark):
    base = {"contract_version": "v1", "source_profile_id": 1, "source_profile_version": "v", "property_id": None}
    bodies = [
        None,
        "{",
        json.dumps(base),
        json.dumps(base | {"question_set": {"questions": [1], "created_at": "x"}, "audit": None}),
        json.dumps(base | {"question_set": [{"created_at": "x"}, {"questions": [], "created_at": "x"}], "baseline": []}),
        json.dumps(base | {"strategies": [{"audit_id": 1, "ranking_policy": "p", "strategies": [1, 2, 3], "created_at": "x"}]}),
    ]
    table = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = sorted((r.id, r.record_type or "", r.error or "") for r in records.result_records(table, "id", "body", "v1").collect())
    asked, lacks = "evaluation_question_set", "envelope lacks fields"
    assert got == [(0, "", lacks), (1, "", lacks), (3, asked, ""), (4, asked, ""), (4, asked, "missing questions"), (5, "ranked_strategy_recommendation", "")]


def test_import_records(spark):
    names = "schema_version string, profile_id string, website string, name string, profile_type string, smb string, hotel string, body string"
    rows = [("v1", "p", "https://a.com", None, None, "true", "NO", "{}"), ("v1", "f", "https://a.com", "F", records.FIXTURE, "YES", "YES", None), (None, None, None, None, None, None, None, None)]
    got = records.import_records(spark.createDataFrame(rows, names), "v1").collect()
    assert [(r.error, r.official_name, r.memberships, r.exclusion_reason) for r in got] == [
        (None, "p", ["SMB_COHORT"], None),
        (None, "F", [], "CONTROLLED_TEST_FIXTURE"),
        ("unexpected schema_version", None, [], None),
    ]


def test_replay_and_routes(spark):
    saved = spark.createDataFrame([("s", '{"website": "https://www.a.com"}'), ("s", '{"website": "https://b.com"}'), ("s", '{"website": "https://b.com/x"}'), ("t", None)], "source_type string, raw_data string")
    known = spark.createDataFrame([("a.com",)], "domain string")
    assert sorted(tuple(r) for r in records.replayed(saved, known).collect()) == [("s", 3, 1, 2), ("t", 1, 0, 1)]
    routes = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "route string")
    tried = spark.createDataFrame([("a", "failed", "x", 1), ("a", "complete", None, 2), ("b", "failed", "y", 1), ("b", "failed", "z", 2), ("b", None, None, 3)], "route string, status string, error string, at int")
    got = sorted((str(r.route), r.n_failed, r.last_error) for r in records.open_routes(routes, tried, "route", "at").collect())
    assert got == [("None", 0, None), ("b", 2, "z"), ("c", 0, None)]


def test_rows_on_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None)], "id int, status string, commercial string, rating string, size_class string, industries string")
    got = records.quality_rows(rows, "id").first()
    assert got.relevance_assessment == "UNATTRIBUTABLE_UNVERIFIED_SITE" and got.additional_evidence_needed.count(";") == 2
    sites = spark.createDataFrame([(1, None), (1, "https://facebook.com/x"), (2, "https://z.com"), (2, "https://a.com/2"), (2, "https://a.com/1")], "id int, url string")
    sized = spark.createDataFrame([(1, None), (2, "SMB_SUPPORTED")], "id int, size_class string")
    pilots = {r.id: tuple(r)[1:] for r in records.pilot_rows(sized, sites, "id").collect()}
    assert pilots == {1: (None, None, 0, False, False, False), 2: ("https://a.com/1", "a.com", 2, False, True, True)}
    states = spark.createDataFrame([("x", None), ("x", "b"), ("a", "b")], "p string, q string")
    assert tuple(records.validation_summary(states, ["p", "q"]).first()) == (3, '{"a":1,"x":2}', '{"b":2,"null":1}')
    assert records.validation_summary(states.limit(0), ["p", "q"]).first().candidate_total == 0
    seen = spark.createDataFrame([(None, None), ("https://a.com", False), ("https://a.com/2", None), ("https://b.com", True), ("https://c.com", False)], "url string, inactive boolean")
    known = spark.createDataFrame([("c.com",)], "domain string")
    assert tuple(records.acquisition(seen, known).first()) == (5, 1, 1, 1, 1, 2, 1)
    assert tuple(records.acquisition(seen.limit(0), known).first()) == (0,) * 7
