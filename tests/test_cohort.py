"""Company rows with nothing known of them, ties and odd values; supplied pages."""

from siftline.operators import channels, cohort

COMPANY = "company_id long, company_name string, website string, normalized_domain string, industry string, location string, company_size_value int, company_size_source string, company_size_category string, eligibility string, geo_opportunity string, priority_tier string, evidence_confidence string, review_status string, contact_status string, contactability_status string, review_notes string, reviewed_by string, pipeline_status string, created_at string, qualification_evidence string, primary_channel_id long, channel_override_contact_id long"
DISCOVERY = "id long, company_id long, source_type string, source_name string, source_url string, source_identifier string, raw_data string"
SNAPSHOT = "id long, company_id long, fetched_at timestamp, fetch_status string, requested_url string, final_url string, canonical_url string, extracted_signals string, http_status int"
CONTACT = "id long, company_id long, channel_type string, channel_url string, source_url string, email string, review_status string, name string, contact_type string, recommended boolean, ranking_score int"


def company(i, **values):
    names = [c.split()[0] for c in COMPANY.split(", ")]
    row = dict.fromkeys(names) | {"company_id": i, "company_name": f"C{i}", "website": f"https://c{i}.com/", "normalized_domain": f"c{i}.com", "review_status": "PENDING", "contact_status": "NOT_RUN", "contactability_status": "NOT_RUN"} | values
    return tuple(row[n] for n in names)


def frames(spark):
    from datetime import datetime

    day = datetime(2024, 1, 1)
    companies = [company(1), company(2, eligibility="eligible", geo_opportunity="high", industry=" ", company_size_value=0, review_status="APPROVED", pipeline_status="READY_FOR_GEO", channel_override_contact_id=9), company(3, primary_channel_id=99, company_size_value=12)]
    found = [(2, 2, "csv", None, None, "b", "not json"), (1, 2, "csv", "Dir", "https://d/2", "a", '{"active": true}'), (3, 2, "csv", "", "https://d/1", None, None)]
    shots = [(1, 2, day, "BLOCKED", "https://c2.com/a", None, None, "{", 403), (2, 2, day, "SUCCESS", "https://c2.com/b", None, None, '{"pages_inspected": 2, "reachable": true, "meaningful_text": true}', 200)]
    reach = [(9, 2, "CONTACT_FORM", "https://www.c2.com/f", "https://c2.com/", None, "PENDING", None, None, None, None), (8, 2, "SUPPORT_EMAIL", None, "https://c2.com/", "x@c2.com", "APPROVED", "Ann Lee", "PERSON", True, 5), (7, 3, None, None, None, None, None, None, None, None, None)]
    return [spark.createDataFrame(rows, schema) for rows, schema in ((companies, COMPANY), (found, DISCOVERY), (shots, SNAPSHOT), (reach, CONTACT))]


def test_review_rows(spark):
    identities = spark.createDataFrame([(2, "VERIFIED")], "company_id long, identity string")
    got = {r.company_id: r for r in cohort.review_rows(*frames(spark), identities).collect()}
    assert got[1].website_fetch_status == "NOT_INSPECTED" and got[1].identity_verification_status == "BASELINE_NOT_RECHECKED" and got[1].evidence_links == "https://c1.com/" and got[1].contact_task == "NOT_DISCOVERED"
    two = got[2]
    assert (two.discovery_source, two.website_fetch_status, two.contact_task, two.outreach_readiness_status) == ("Dir; csv", "SUCCESS", "PENDING", "BLOCKED_CONTACT_CHANNEL_REVIEW")
    assert two.evidence_links == "https://c2.com/ | https://c2.com/b | https://d/1 | https://d/2" and two.required_review_action == "REVIEW_CONTACT_CHANNEL" and two.missing_evidence == "industry; geography; employee_size_evidence"
    assert sorted(got, key=lambda i: got[i].priority_key) == [2, 1, 3] and len(got[1]) == 30


def test_selection_records(spark):
    got = {r.company_id: r for r in cohort.selection_records(*frames(spark)).collect()}
    two = got[2]
    assert (two.eligibility, two.evidence_confidence, two.primary_channel, two.outreach_readiness, two.has_channel) == ("ELIGIBLE", "HIGH", "https://www.c2.com/f", "NEEDS_CHANNEL_REVIEW", True)
    assert two.alternative_channels == '[{"evidence_url":"https://c2.com/","review_status":"APPROVED","type":"SUPPORT_EMAIL","value":"x@c2.com"}]' and two.named_decision_maker == "Ann Lee"
    assert two.missing_information.startswith("company_size_count_zero_needs_verification; industry; geography")
    assert got[3].primary_channel == "" and got[3].company_size == "12 employees (directory-reported)" and got[1].alternative_channels == "[]"


def test_pool_rows(spark):
    saved = spark.createDataFrame([(2, "verified", None, None)], "company_id long, identity string, reason string, http_status int")
    rows = cohort.pool_rows(*frames(spark), saved, "old")
    got = {r.candidate_id: r for r in rows.collect()}
    two = got["old:2"]
    assert len(rows.columns) == 24 and (two.verification_status, two.geo_eligibility_status, two.geo_opportunity_status, two.contact_status, two.outreach_ready_status) == ("VERIFIED", "ELIGIBLE", "HIGH", "CONTACT_FOUND", "READY")
    assert (two.source_record_id, two.source_url, two.http_status) == ("a;b", "https://d/2", 200)
    assert (got["old:1"].source_name, got["old:1"].contact_status, got["old:1"].geo_eligibility_status) == ("Legacy cohort", "NOT_DISCOVERED", "NEEDS_REVIEW")
    assert cohort.pool_rows(*(f.limit(0) for f in frames(spark)), saved, "old").count() == 0


def test_supplied_contacts(spark):
    pages = [(1, "https://x.com", "<p>B@x.com, a@x.com b@x.com.</p><form action='/s'></form><form><input></form>"), (2, "http://x.com", "<form>text</form>"), (3, "mailto:a", "<p>a@x.com</p>"), (4, "https://x.com", None), (5, None, "<p>a@x.com</p>"), (6, "HTTPS://x.com", "<script>a@x.com</script><form><select></select></form>")]
    got = {r.id: tuple(r)[1:6] for r in channels.supplied_contacts(spark.createDataFrame(pages, "id int, url string, html string"), "id", "url", "html").collect()}
    wrong = ("source_url must be HTTP(S)", None, None, None, None)
    assert got == {1: (None, "EMAIL_AND_FORM", ["B@x.com", "a@x.com", "b@x.com"], True, True), 2: (None, "NO_CONTACT", [], True, False), 3: wrong, 4: (None, "NO_CONTACT", [], False, False), 5: wrong, 6: (None, "FORM_ONLY", [], True, True)}
