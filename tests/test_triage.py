"""Triage operators on nulls, ties and the edges of their rules."""

import pytest
from pyspark.sql import functions as F

from siftline.operators import triage

CHECKS = [
    ("Deep", "https://www.deep.com", "VERIFIED", "200", None, "Deep learning", "VERIFIED"),
    ("Deep", "https://deep2001.com", "VERIFIED", "200", None, "Deep 2001", "INSUFFICIENT_EVIDENCE"),
    ("Deep Blue", "https://deep2001.com", "VERIFIED", "200", None, "Deep 2001", "VERIFIED"),
    ("Deep", None, "blocked", "200", None, "Deep", "ACCESS_BLOCKED"),
    ("Deep", "https://deep.com", "FETCH_FAILED", "403", None, "Deep", "ACCESS_BLOCKED"),
    ("Deep", "https://deep.com", "VERIFIED", None, None, "Deep", "FETCH_FAILED"),
    ("Deep", "https://deep.com", None, "200", None, "Deep", "INSUFFICIENT_EVIDENCE"),
    ("Deep", "https://deep.com", "NEW", "200", None, "Deep", "INSUFFICIENT_EVIDENCE"),
    ("Q42", "https://deep.com", "AMBIGUOUS", "200", None, "Deep", "INSUFFICIENT_EVIDENCE"),
    ("Deep", "https://deep.com", "AMBIGUOUS", "200", None, " Home ", "INSUFFICIENT_EVIDENCE"),
    ("Deep", "https://deep.com", "AMBIGUOUS", "200", "https://bets.com", "Judi Bola", "REJECTED_MISMATCH"),
    ("Deep", "https://deep.com", "AMBIGUOUS", "200", "https://www.deep.com/x", "Judi Bola", "AMBIGUOUS_IDENTITY"),
    ("Deep", "https://deep.com", "REJECTED_MISMATCH", "200", None, None, "REJECTED_MISMATCH"),
    (None, None, None, None, None, None, "INSUFFICIENT_EVIDENCE"),
]


def test_refined_status(spark):
    rows = spark.createDataFrame(CHECKS, "name string, site string, status string, http string, final string, title string, want string")
    got = rows.select("*", triage.refined_status(*map(F.col, ["name", "site", "status", "http", "final", "title"])).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_usable_channels(spark):
    kind = "array<struct<channel_type:string,email:string,channel_url:string,review_status:string>>"
    rows = [
        ([("partnership_email", "a@b.c", None, None), ("CONTACT_FORM", None, "https://b.c", "APPROVED"), ("CONTACT_FORM", "a@b.c", "", None)], 2),
        ([("PARTNERSHIP_EMAIL", "a@b.c", None, "rejected"), (None, "a@b.c", "https://b.c", None), ("PARTNERSHIP_EMAIL", "", None, None)], 0),
        ([], 0),
        (None, 0),
    ]
    got = spark.createDataFrame(rows, f"c {kind}, want int").select(F.size(triage.usable_channels(F.col("c"))).alias("n"), "want").collect()
    assert [r.n for r in got] == [r.want for r in got]


def test_screenable_limits(spark):
    names = ["id", "updated", "profile_type", "identity_verification_status", "qualification_status", "official_website", "screening_status"]
    rows = [(i, u, k, v, "ELIGIBLE", w, s) for i, u, k, v, w, s in [(3, 1, "a", "VERIFIED", "x", ""), (2, 1, "a", "VERIFIED", "x", ""), (1, 0, triage.FIXTURE, "VERIFIED", "x", ""), (4, 0, "a", None, "x", ""), (5, 0, "a", "VERIFIED", "", ""), (6, 0, "a", "VERIFIED", "x", "COMPLETE")]]
    table = spark.createDataFrame(rows, names)
    assert [r.id for r in triage.screenable(table, "id", "updated", 250).collect()] == [2, 3]
    assert triage.screenable(table.limit(0), "id", "updated", 1).collect() == []
    for limit in (0, 251):
        with pytest.raises(ValueError):
            triage.screenable(table, "id", "updated", limit)


def test_cohort_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "https://www.a.com/x", "k"), (2, None, None), (3, "https://facebook.com/b", "k"), (4, "http://c.com", "k")], "id int, url string, _known string")
    known = spark.createDataFrame([("a.com",), ("https://a.com/y",), (None,)], "url string")
    got = {r.id: (r.cohort_membership, r.website_url_is_third_party_profile) for r in triage.in_cohort(rows, known, "url").collect()}
    new = "NEW_EXPERIMENTAL"
    assert got == {1: ("BASELINE_PRESERVED", False), 2: (new, False), 3: (new, True), 4: (new, False)}


def test_gates_on_nulls(spark):
    null = F.lit(None).cast("string")
    ids = F.lit(None).cast("array<int>")
    pages = F.lit(None).cast("array<struct<title:string,meta_description:string,structured_data_types:string>>")
    row = spark.range(1).select(
        triage.preview_gate(null, null, ids, null, F.lit(1)).alias("a"),
        triage.preview_gate(F.lit("eligible"), F.lit("VERIFIED"), ids, null, F.lit(1)).alias("b"),
        triage.preview_gate(F.lit("eligible"), F.lit("VERIFIED"), F.array(F.lit(1)), F.lit("VERIFIED_US"), F.lit(1)).alias("c"),
        triage.hotel_evidence(pages, null.cast("boolean"), null.cast("boolean")).alias("d"),
    ).first()
    assert tuple(row) == ("BLOCKED_NOT_ELIGIBLE", "NO_SUITABLE_CHANNEL", "DRAFT_READY", "NOT_ESTABLISHED")
