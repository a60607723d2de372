"""Scalar functions by tables of cases."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import classify, contacts, decide, html, review, text, url

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


URLS = [
    ("Example.com", "example.com", "https://example.com"),
    ("http://www.Example.com:80/a/?q=1#x", "example.com", "https://example.com/a?q=1"),
    ("https://shop.example.com:8443/a//", "shop.example.com", "https://shop.example.com:8443/a"),
    ("https://user:p@example.com./", "example.com", "https://example.com"),
    (" https://www.www.example.org ", "www.example.org", "https://www.example.org"),
    ("", None, None),
    (None, None, None),
]


@pytest.mark.parametrize(("given", "domain", "canonical"), URLS)
def test_urls(spark, given, domain, canonical):
    c = L(given).cast("string")
    assert value(spark, url.domain_key(c)) == domain
    assert value(spark, url.url_canonical(c)) == canonical


def test_hosts(spark):
    assert value(spark, url.suffixes(L("a.b.example"))) == ["a.b.example", "b.example", "example"]
    assert value(spark, url.third_party(L("https://m.facebook.com/x"))) and not value(spark, url.third_party(L("https://notfacebook.com")))
    assert value(spark, url.acceptable_website(L("bakery.com"))) == "bakery.com"
    for bad in ("n/a", "ftp://bakery.com", "localhost", "shop.example", "https://x.com/shop"):
        assert value(spark, url.acceptable_website(L(bad))) is None
    for given, ok in (("https://forms.site.org/a", True), ("http://forms.site.org", False), ("https://localhost/x", False), ("https://192.168.1.1/", False), ("https://u:p@site.org", False), ("https://site.invalid", False)):
        assert value(spark, url.public_form_url(L(given))) is ok
    assert value(spark, url.with_parameter(L("https://a.org/f"), "t", L("a b&c"))) == "https://a.org/f?t=a%20b%26c"
    assert value(spark, html.idna(L("bücher.de"))) == "xn--bcher-kva.de"


@pytest.mark.parametrize(("given", "key"), [("Acme, Inc.", "acme"), ("ACME Co. Ltd", "acme"), ("The Company", "the"), ("Company", ""), ("Incline", "incline"), ("A & B Corp", "a b"), (None, "")])
def test_name_key(spark, given, key):
    assert value(spark, text.name_key(L(given).cast("string"))) == key


def test_emails(spark):
    assert value(spark, text.emails(L("to A.b@X.org, or c@d.co; not @e.f"))) == ["a.b@x.org", "c@d.co"]
    assert value(spark, text.normal_email(L(" <Info@Site.org>. "))) == "info@site.org" and value(spark, text.normal_email(L("a b@c.d"))) is None
    assert value(spark, text.deobfuscated_emails(L("write info [at] site (dot) org"))) == ["info@site.org"]
    assert [value(spark, text.valid_recipient(L(x))) for x in ("a@b.co", "a@b", "a b@c.co")] == [True, False, False]


def test_texts(spark):
    for given, want in (("=1", "'=1"), (" +1", "' +1"), ("-", "'-"), ("", ""), ("a=1", "a=1"), (None, None)):
        assert value(spark, text.formula_safe(L(given).cast("string"))) == want
    for given, want in (("Please UNSUBSCRIBE me?", "UNSUBSCRIBE"), ("Not interested", "DECLINE"), ("Yes, interested", "EXPLICIT_CONSENT"), ("interested?", "QUESTION"), ("Sounds good", "POSITIVE_INTEREST"), (None, "UNCLEAR")):
        assert value(spark, text.reply_class(L(given).cast("string"))) == want
    for given, want in (("Co-Founder & CEO", "FOUNDER_OWNER"), ("Brand Lead", "MARKETING_GROWTH"), ("Brander", "OTHER"), ("", "UNKNOWN"), ("Office Manager", "GENERAL_BUSINESS")):
        assert value(spark, text.role(L(given))) == want
    assert value(spark, text.filled(L("Dear {name}, {greeting}"), {"name": L("Ann"), "greeting": L("hello")})) == "Dear Ann, hello"
    assert value(spark, text.filled(L("Dear {name}"), {})) is None
    assert value(spark, text.sorted_join(F.array(L("b"), L(""), L("a"), L("b")), "; ")) == "a; b"
    assert value(spark, text.evidence_window(L("x" * 900 + "KEY" + "y" * 900), L("KEY"), 100)).count("KEY") == 1
    assert value(spark, html.plain_punctuation(L("“Hi” — it’s 5…"))) == "\"Hi\" - it's 5..."
    assert value(spark, html.people(L("Ann Lee, owner and Bob Ray, the baker"))) == [("Ann Lee", "owner")]


def test_classes(spark):
    assert [value(spark, classify.size_bucket(L(n).cast("int"))) for n in (None, 10, 50, 250, 251)] == ["UNKNOWN", "MICRO", "SMALL", "MEDIUM", "LARGE"]
    for args, want in ((("12", "SMALL", "register"), "SMB_SUPPORTED"), (("many", "SMALL", "register"), "CONFLICTING_EVIDENCE"), (("12", "LARGE", "register"), "CONFLICTING_EVIDENCE"), (("900", "LARGE", "register"), "LARGE_ENTERPRISE_SUPPORTED"), (("0", "SMALL", "register"), "SIZE_UNKNOWN"), ((None, None, None), "SIZE_UNKNOWN"), (("9", "MICRO", "unknown"), "SIZE_UNKNOWN")):
        assert value(spark, classify.size_evidence(*(L(a).cast("string") for a in args))) == want
    for args, want in ((("Paris, France", "", ""), "VERIFIED_NON_US"), (("Paris, TX", "", ""), "VERIFIED_US"), (("Mexico, NY", "", ""), "COUNTRY_CONFLICT"), (("Austin", "", ""), "VERIFIED_US"), (("Ulm", "", ""), "COUNTRY_UNKNOWN"), (("", "", "Geofabrik US extract"), "VERIFIED_US"), ((None, None, None), "COUNTRY_UNKNOWN")):
        assert value(spark, classify.geography(*(L(a).cast("string") for a in args))) == want
    for args, want in ((("REJECTED_MISMATCH", "", None, "redirected"), "REDIRECT_ISSUE"), (("FETCH_FAILED", "", 403, "captcha"), "BOT_PROTECTION_EXPLICIT"), (("FETCH_FAILED", "", None, "HTTP 502 from origin"), "HTTP_502"), (("FETCH_FAILED", "FAILED", None, ""), "OTHER_FETCH_FAILURE")):
        assert value(spark, classify.failure(L(args[0]), L(args[1]), L(args[2]).cast("int"), L(args[3]))) == want
    t = value(spark, classify.triage(L("ALDI 5"), L("shop=food"), L("aldi.com"), L("VERIFIED"), L("ELIGIBLE"), L(1), L(1)))
    assert (t.status, t.score, t.chain) == ("LIKELY_FIT", 82, "LIKELY_CHAIN_OR_FRANCHISE")
    assert value(spark, classify.domain_concern(L("a.wixsite.com"))) == "HOSTED_PLATFORM_DOMAIN_REVIEW"


def identity(spark, **given):
    s = {"name": "Blue Fern Bakery", "requested": "bluefern.com", "final": "bluefern.com", "third_party": False, "has_snapshot": True, "fetch_status": "SUCCESS", "http_status": 200, "pages_ok": 1, "title": "Blue Fern Bakery", "titles": "Blue Fern Bakery", "content": "blue fern bakery bread", "text_length": 600} | given
    return value(spark, decide.identity({k: L(v) for k, v in s.items()}))


def test_identity(spark):
    assert identity(spark) == "VERIFIED"
    assert identity(spark, third_party=True) == "THIRD_PARTY_URL" and identity(spark, has_snapshot=False) == "FETCH_FAILED"
    assert identity(spark, http_status=403) == "ACCESS_BLOCKED" and identity(spark, content="this domain is for sale") == "REJECTED_MISMATCH"
    assert identity(spark, final="other.com", titles="Other", title="Other", content="other things") == "REJECTED_MISMATCH"
    assert identity(spark, final="bread.com", requested="bread.com", titles="Home", title="Home", content="bread", text_length=600) == "INSUFFICIENT_EVIDENCE"
    assert identity(spark, final="bread.com", requested="bread.com", titles="Bread", title="Bread", content="bread by fern") == "AMBIGUOUS_IDENTITY"


def test_qualification_never_counts_the_unknown_against_a_record(spark):
    names = ["has_evidence", "reachable", "meaningful_text", "substantial", "relevance", "faq", "structured", "active", "discovery"]
    unknown = {n: L(None).cast("boolean") for n in names} | {"fetch_status": L(None).cast("string"), "pages": L(None).cast("int")}
    q = value(spark, decide.qualification(unknown))
    assert (q.confidence, q.eligibility, q.opportunity, q.priority, q.tier, q.decision) == ("LOW", "NEEDS_REVIEW", "UNKNOWN", 0, "NEEDS_REVIEW", "NEEDS_REVIEW")
    full = {n: L(True) for n in names} | {"fetch_status": L("SUCCESS"), "pages": L(3), "faq": L(False)}
    q = value(spark, decide.qualification(full))
    assert (q.confidence, q.opportunity, q.priority, q.tier) == ("HIGH", "HIGH", 80, "HIGH")
    q = value(spark, decide.qualification(full | {"banned": L(True)}, decide.PriorityRules(exclusions=("banned",))))
    assert q.decision == "REJECTED"


def test_contacts(spark):
    kinds = [("Partner with us", "x@a.org", False, "PARTNERSHIP_EMAIL"), ("hello", "legal@a.org", False, "RESTRICTED_EMAIL"), ("", "info@a.org", False, "GENERAL_BUSINESS_EMAIL"), ("Contact us", None, True, "CONTACT_FORM"), ("Subscribe: contact us", None, True, "OTHER"), ("", "zed@a.org", False, "OTHER")]
    for context, mail, form, want in kinds:
        assert value(spark, contacts.channel_type(L(context), L(mail).cast("string"), L(form))) == want
    assert value(spark, contacts.channel_rank(L("CONTACT_FORM"), L("Partnership"))) == 105 and value(spark, contacts.channel_rank(L("SUPPORT_EMAIL"), L(""))) == 0
    assert value(spark, contacts.contact_rank(L("local_smb"), L("EXECUTIVE"), L(True), L(False))) == 100
    own = lambda mail: contacts.first_party(L("GENERAL_BUSINESS_EMAIL"), L(mail), L(None).cast("string"), L("https://www.a.org/contact"), L("a.org"), L("PENDING"))
    assert value(spark, own("hi@a.org")) and not value(spark, own("hi@b.org"))
    a = value(spark, contacts.audit_class(L("CONTACT_FORM"), L(None).cast("string"), L("https://a.org/c"), L("https://a.org/c"), L("Submit"), L("a.org")))
    assert a["class"] == "OFFICIAL_CONTACT_FORM" and a.first_party
    assert value(spark, contacts.form_fields(L("Your email and message. I agree")))["consent"]
    assert [value(spark, contacts.suitable_mailbox(L(m), ["jobs"])) for m in ("a@b.c", "jobs@b.c", "noreply@b.c", "b.c")] == [True, False, False, False]


def test_reviews(spark):
    both = ['{"pages":[{"fetch_status":"SUCCESS","http_status":200,"visible_text_length":90}]}', '{"saved_snapshot":{"pages":[{"fetch_status":"PARTIAL","http_status":301,"visible_text_length":80}]}}', '{"fetch_status":"SUCCESS","http_status":200,"visible_text_length":500}']
    for raw in both:
        assert value(spark, review.operational(L(raw)))
    for raw in (None, "not json", '{"pages":[{"fetch_status":"SUCCESS","http_status":404,"visible_text_length":900}]}'):
        assert value(spark, review.operational(L(raw).cast("string"))) is False
    gate = {k: L(True) for k in ("identity_verified", "recipient_valid", "outreach_approved", "message_approved", "sender_configured", "live_enabled")} | {"opted_out": L(False), "simulated": L(False), "eligibility": L("ELIGIBLE"), "channel_type": L("CONTACT_FORM"), "company_review": L("APPROVED"), "channel_review": L("APPROVED")}
    assert value(spark, review.delivery_gate(gate)) == "BLOCKED_NO_LIVE_PROVIDER"
    assert value(spark, review.delivery_gate(gate | {"opted_out": L(True), "identity_verified": L(False)})) == "SUPPRESSED_OPT_OUT"
    assert value(spark, review.delivery_gate({k: L(None).cast("boolean") if k in ("identity_verified",) else v for k, v in gate.items()})) == "BLOCKED_IDENTITY_UNVERIFIED"
    assert value(spark, review.consent(L("YES"), L("NO"), L(True), L(True))).outcome == "INTERESTED_NOT_AUTHORIZED"
    assert value(spark, review.consent(L("YES"), L("YES"), L(True), L(True))).outcome == "NEEDS_REVIEW"
    assert [value(spark, review.response_state(L(x))) for x in (" interested", "OTHER", "odd")] == ["INTERESTED", "RESPONSE_RECEIVED", None]
    assert value(spark, review.employee_evidence(F.array(L("+12"), L("10000"), L("x")))) == "LARGE_ENTERPRISE_SUPPORTED"
    s = {"geography": L("X"), "eligibility": L("NO"), "has_channel": L(False), **{k: L(None).cast("string") for k in ("identity", "company_review", "source_url", "channel_review")}, **{k: L(None).cast("boolean") for k in ("suppressed", "opted_out", "member", "form_ready", "has_token")}}
    assert value(spark, review.mail_merge_blockers(s)) == ["IDENTITY_NOT_VERIFIED", "GEOGRAPHY_NOT_VERIFIED_US", "COMPANY_HUMAN_REVIEW_INCOMPLETE", "NO_SUITABLE_FIRST_PARTY_EMAIL", "VALID_HTTPS_PARTICIPATION_FORM_NOT_CONFIGURED", "COMPANY_INVITATION_TOKEN_UNAVAILABLE"]
    assert value(spark, review.site_rating(L("We offer bread. Contact: phone, hours. " + "x" * 900), L("Fern Bread"), L("Ulm"))).rating == "HIGH"


def test_page_facts(spark):
    markup = """<html><head><title> A &amp; B </title><meta name=description content="Bread"><link rel="canonical" href="/a"><style>x</style>
      <script type="application/ld+json">[{"@type":["Store","Bakery"],"email":"mailto:Shop@A.org","x":{"@type":"Place"}}]</script></head>
      <body><p>Write to info@a.org<br>now <a href="mailto:hi@a.org?x">mail</a> <a href="/b">b</a><a href="/b">again</a>
      <form action="/send"><input type=email name=mail><textarea name=message></textarea></form><script>var t="no@b.org"</script>"""
    p = value(spark, html.page_facts(L(markup)))
    assert p.title == "A & B" and p.description == "Bread" and p.canonical == "/a" and p.types == ["Bakery", "Place", "Store"] and p.links == ["/b"]
    assert p.emails == ["hi@a.org", "info@a.org", "shop@a.org"] and p.forms[0].action == "/send" and "message" in p.forms[0].fields and "var t" not in p.text
    empty = value(spark, html.page_facts(L(None).cast("string")))
    assert empty.text == "" and empty.title is None and empty.emails == []


def test_evidence(spark):
    from siftline.functions import evidence as e

    assert value(spark, e.evidence_list(L('["b","a"]'))) == ["b", "a"] and value(spark, e.evidence_list(L("x; ;y"))) == ["x", "y"]
    assert value(spark, e.evidence_list(L(None).cast("string"))) == [] and value(spark, e.evidence_list(L('{"k":"v"}'))) == ["v"]
    assert value(spark, e.json_list(F.array(L("b"), L(""), L("a"), L("b")))) == '["a","b"]'
    assert value(spark, e.first_url(L("see https://a.org/x now"))) == "https://a.org/x"
    p = value(spark, e.paragraphs(L("one\n\ntwo"), 3))
    assert (p.body_paragraph_01, p.body_paragraph_02, p.body_paragraph_03) == ("one", "two", "")
    assert value(spark, e.display_name(L("Demo: Spring  round"))) == "Spring round"
    assert value(spark, e.site_names_company(L("Fern Bakery"), L("our BAKERY"))) and not value(spark, e.site_names_company(L("Fern Bakery"), L("x"))) and value(spark, e.site_names_company(L("The Inc"), L("x")))
    for mail, ok in (("ann@a.org", True), ("ann.lee@a.org", True), ("alee@a.org", True), ("annlee+x@a.org", True), ("bob@a.org", False)):
        assert value(spark, e.mailbox_agrees(L("Ann Lee"), L(mail))) is ok
    raw = '{"pages":[{"url":"https://a.org/contact","fetch_status":"SUCCESS","channels":[{"email":"Hi@a.org","type":"GENERAL_BUSINESS_EMAIL"},{"email":"x@b.org","type":"GENERAL_BUSINESS_EMAIL"},{"email":"p@a.org","name":"P","type":"NAMED_PERSON_EMAIL"}]},{"url":"https://b.org/contact","fetch_status":"SUCCESS"}]}'
    df = spark.createDataFrame([("c", "a.org", raw)], "candidate_id string, canonical_domain string, evidence_json string")
    assert sorted((r.channel_type, r.email) for r in e.channel_rows(df).collect()) == [("CONTACT_PAGE", ""), ("GENERAL_BUSINESS_EMAIL", "hi@a.org")]
    pages = df.select(e.without_personal(F.from_json("evidence_json", f"pages {e.PAGES}")["pages"]).alias("v")).first().v
    assert [c.email for c in pages[0].channels] == ["Hi@a.org", "x@b.org"] and "name" not in pages[0].channels[0].__fields__
