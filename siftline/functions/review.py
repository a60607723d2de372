"""Review and campaign decisions: ordered states as CASE WHEN (FN-36..FN-43, FN-46, FN-47, FN-50, FN-52, FN-53)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contacts import SUITABLE_TYPES
from .decide import blockers, yes
from .text import first_match
from .url import blank

PAGES = T.ArrayType(T.StructType([T.StructField("fetch_status", T.StringType()), T.StructField("http_status", T.IntegerType()), T.StructField("visible_text_length", T.LongType())]))
EVIDENCE = T.StructType([T.StructField("pages", PAGES), T.StructField("saved_snapshot", T.StructType([T.StructField("pages", PAGES), *PAGES.elementType.fields])), *PAGES.elementType.fields])


def operational(evidence: Column) -> Column:
    """Whether saved evidence (either of its two shapes) has a fetched first-party page with text."""
    e = F.from_json(evidence, EVIDENCE)
    some = lambda p: p.isNotNull() & (F.size(p) > 0)
    one = lambda s: F.array(F.struct(*(s[f.name].alias(f.name) for f in PAGES.elementType.fields)))
    pages = F.when(some(e["pages"]), e["pages"]).when(some(e["saved_snapshot"]["pages"]), e["saved_snapshot"]["pages"]).when(e["saved_snapshot"].isNotNull(), one(e["saved_snapshot"])).otherwise(one(e))
    fine = lambda p: p["fetch_status"].isin("SUCCESS", "PARTIAL") & p["http_status"].between(200, 399) & (F.coalesce(p["visible_text_length"], F.lit(0)) >= 80)
    return F.coalesce(F.exists(pages, fine), F.lit(False))


def delivery_gate(s: dict[str, Column]) -> Column:
    """Why a message isn't delivered. Nothing is ever sent: the last state blocks too."""
    return first_match(
        [
            (yes(s["opted_out"]), "SUPPRESSED_OPT_OUT"),
            (~yes(s["identity_verified"]), "BLOCKED_IDENTITY_UNVERIFIED"),
            (~yes(s["eligibility"] == "ELIGIBLE"), "BLOCKED_ELIGIBILITY_NOT_APPROVED"),
            (~yes(s["channel_type"].isin(SUITABLE_TYPES) & s["recipient_valid"]), "BLOCKED_UNSUITABLE_CHANNEL"),
            (yes(s["simulated"]), "SIMULATED_APPROVAL_ONLY"),
            (~yes(s["company_review"] == "APPROVED"), "BLOCKED_COMPANY_REVIEW"),
            (~yes(s["channel_review"] == "APPROVED"), "BLOCKED_CHANNEL_REVIEW"),
            (~yes(s["outreach_approved"] & s["message_approved"]), "BLOCKED_OUTREACH_OR_MESSAGE_APPROVAL"),
            (~yes(s["sender_configured"]), "BLOCKED_SENDER_NOT_CONFIGURED"),
            (~yes(s["live_enabled"]), "BLOCKED_LIVE_SENDING_DISABLED"),
        ],
        "BLOCKED_NO_LIVE_PROVIDER",
    )


def smb_target(s: dict[str, Column]) -> Column:
    """A company's place in the target group; what isn't established is for review, not excluded."""
    return first_match(
        [
            (yes(s["hotel"]), "EXCLUDED_HOTEL_TARGET"),
            (yes(s["identity_review"]), "NEEDS_REVIEW_COMPANY_IDENTITY"),
            (s["size_class"] == "LARGE_ENTERPRISE_SUPPORTED", "OUTSIDE_SMB_SIZE_SCOPE"),
            (s["size_class"] != "SMB_SUPPORTED", "NEEDS_REVIEW_SIZE"),
            (s["verification"] != "VERIFIED", "NEEDS_REVIEW_WEBSITE_IDENTITY"),
            (~yes(s["operational"]), "NEEDS_REVIEW_OPERATIONAL_EVIDENCE"),
            (s["eligibility"] != "ELIGIBLE", "NEEDS_REVIEW_GEO_ELIGIBILITY"),
            (s["channels"] == "NO_CONTACT", "QUALIFIED_SMB_NO_USABLE_CONTACT"),
        ],
        "QUALIFIED_CONTACTABLE_SMB",
    )


def response_state(kind: Column) -> Column:
    """The state that a response leads to; null for a kind that isn't known, to be rejected."""
    k = F.upper(F.trim(kind))
    return first_match([(k.isin("INTERESTED", "DECLINED", "OPTED_OUT"), k), (k == "OTHER", "RESPONSE_RECEIVED")], F.lit(None).cast("string"))


def consent(interest: Column, authorization: Column, complete: Column, email_matches: Column) -> Column:
    """(outcome, review) of a form's answers; nobody is taken to have agreed without a person's review."""
    pending = F.when(yes(email_matches), "PENDING").otherwise("NEEDS_REVIEW")
    made = lambda outcome, review: F.struct(F.lit(outcome).alias("outcome"), (review if isinstance(review, Column) else F.lit(review)).alias("review"))
    ok = yes(complete)
    return first_match(
        [(ok & (interest == "YES") & (authorization == "NO"), made("INTERESTED_NOT_AUTHORIZED", pending)), (ok & (interest == "NO") & (authorization == "NO"), made("DECLINED", pending))],
        made("NEEDS_REVIEW", "NEEDS_REVIEW"),
    )


def review_tasks(s: dict[str, Column]) -> Column:
    """The five independent labels of a review queue row."""
    waiting = s["pending_channels"] > 0
    told = lambda unknown, supported: first_match([(unknown, "PENDING"), (s["company_review"] == "PENDING", supported)], "NOT_REQUIRED")
    contact = first_match(
        [
            (waiting & (s["identity"] != "VERIFIED"), "WAITING_FOR_IDENTITY_VERIFICATION"),
            (waiting & (s["eligibility"] != "ELIGIBLE"), "WAITING_FOR_ELIGIBILITY_REVIEW"),
            (waiting, "PENDING"),
            (s["contact_status"] == "NOT_RUN", "NOT_DISCOVERED"),
            (s["contact_status"].isin("FAILED", "BLOCKED") | (s["contactability"] == "FETCH_FAILED"), "RESEARCH_FAILED_OR_BLOCKED"),
        ],
        "NO_PENDING_SUITABLE_CHANNEL",
    )
    return F.struct(
        F.when(s["identity"] == "VERIFIED", "NOT_REQUIRED_MACHINE_VERIFIED").otherwise("PENDING").alias("identity_task"),
        told(s["eligibility"].isin("NEEDS_REVIEW", "UNKNOWN", ""), "MACHINE_SUPPORTED_PENDING_COMPANY_REVIEW").alias("eligibility_task"),
        told(s["opportunity"].isin("UNKNOWN", ""), "MACHINE_SCORED_PENDING_COMPANY_REVIEW").alias("opportunity_task"),
        contact.alias("contact_task"),
        F.lit("NOT_GRANTED").alias("outreach_approval"),
    )


def outreach_readiness(s: dict[str, Column]) -> Column:
    return first_match(
        [
            (s["identity"] != "VERIFIED", "BLOCKED_IDENTITY_REVIEW"),
            (s["eligibility"] != "ELIGIBLE", "BLOCKED_ELIGIBILITY_REVIEW"),
            (s["company_review"] != "APPROVED", "BLOCKED_COMPANY_REVIEW"),
            (s["contact_task"] == "PENDING", "BLOCKED_CONTACT_CHANNEL_REVIEW"),
            (s["contactability"] == "READY_FOR_REVIEW", "CHANNEL_AVAILABLE"),
            (s["contact_status"] == "NOT_RUN", "CONTACT_CHANNEL_NOT_DISCOVERED"),
            (s["contact_status"].isin("FAILED", "BLOCKED"), "CONTACT_DISCOVERY_FAILED_OR_BLOCKED"),
        ],
        "NO_SUITABLE_CHANNEL_OR_UNRESOLVED",
    )


def missing_evidence(s: dict[str, Column]) -> Column:
    return blockers(
        [
            ("first_party_identity_verification", ~yes(s["identity"] == "VERIFIED")),
            ("industry", blank(s["industry"])),
            ("geography", blank(s["location"])),
            ("employee_size_evidence", F.coalesce(s["size"], F.lit(0)) <= 0),
            ("eligibility_evidence", F.coalesce(s["eligibility"], F.lit("NEEDS_REVIEW")) == "NEEDS_REVIEW"),
            ("geo_opportunity_evidence", F.lower(F.coalesce(s["opportunity"], F.lit("unknown"))) == "unknown"),
            ("website_inspection", s["fetch_status"].isNull()),
            ("usable_website_content", yes(s["fetch_status"].isin("FETCH_FAILED", "ROBOTS_DENIED", "BLOCKED"))),
        ]
    )


def screening_gate(s: dict[str, Column]) -> Column:
    """(status, blockers) before any costly screening; size never blocks."""
    why = blockers(
        [
            ("GEOGRAPHY", s["geography"] != "VERIFIED_US"),
            ("IDENTITY", s["identity"] != "VERIFIED"),
            ("QUALIFICATION_NOT_ELIGIBLE", s["qualification"] != "ELIGIBLE"),
            ("MISSING_OFFICIAL_WEBSITE", blank(s["website"])),
            ("NO_VALID_PUBLIC_BUSINESS_EMAIL", F.coalesce(s["emails"], F.lit(0)) == 0),
            ("CONSENT_SUPPRESSED", yes(s["consent"].isin("DECLINED", "WITHDRAWN"))),
            ("RECRUITMENT_SUPPRESSED", yes(s["recruitment"].isin("EXCLUDED", "UNSUBSCRIBED"))),
        ]
    )
    test = s["profile_type"] == "owner_controlled_test"
    status = first_match([(test, "EXCLUDED_OWNER_CONTROLLED_TEST"), (F.size(why) == 0, "ELIGIBLE_FOR_AI_SCREENING")], "BLOCKED_DETERMINISTIC")
    return F.struct(status.alias("status"), F.when(test, F.array(F.lit("OWNER_CONTROLLED_TEST"))).otherwise(why).alias("blockers"))


def site_rating(text: Column, name: Column, location: Column) -> Column:
    """(rating, score) of six plain signals in a site's text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = lambda c, n: F.exists(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.length(w) > n), lambda w: F.contains(low, w))
    signals = [
        F.contains(low, F.lower(name)) | words(name, 3),
        low.rlike(r"\b(?:services?|products?|menu|solutions?|offer|book|reserve|shop)\b"),
        low.rlike(r"\b(?:faq|frequently asked|hours|pricing|price|location|contact|how|what|when)\b"),
        words(location, 2),
        F.length(text) >= 900,
        low.rlike(r"\b(?:address|phone|email|hours|located|established)\b"),
    ]
    score = sum((F.when(yes(x), 1).otherwise(0) for x in signals), F.lit(0))
    return F.struct(first_match([(score >= 5, "HIGH"), (score >= 3, "MEDIUM"), (score >= 1, "LOW")], "INSUFFICIENT_EVIDENCE").alias("rating"), score.alias("score"))


def campaign_item(s: dict[str, Column]) -> Column:
    """A campaign item's status. A prior delivery, or an open item elsewhere, shuts a company out."""
    return first_match(
        [
            (s["eligibility"] != "ELIGIBLE", "EXCLUDED_NOT_ELIGIBLE"),
            (s["identity"] != "VERIFIED", "EXCLUDED_IDENTITY_UNVERIFIED"),
            ((s["emails"] == 0) & (s["forms"] == 0), "EXCLUDED_NO_SUITABLE_CHANNEL"),
            (s["geography"] != "VERIFIED_US", "EXCLUDED_GEOGRAPHICALLY_INELIGIBLE"),
            (yes(s["prior"]), "EXCLUDED_ALREADY_CAMPAIGNED"),
            ((s["emails"] > 0) & ~yes(s["recipient_valid"]), "EXCLUDED_DRAFT_VALIDATION"),
            ((s["emails"] > 0) & yes(s["suppressed"]), "EXCLUDED_SUPPRESSED_OPT_OUT"),
            (s["emails"] > 0, "DRAFT_REVIEW"),
        ],
        "CONTACT_FORM_REVIEW",
    )


def mail_merge_blockers(s: dict[str, Column]) -> Column:
    """All reasons that keep a company out of a mail merge but its repeats (see ranking.first_accepted)."""
    us, chosen = s["geography"] == "VERIFIED_US", yes(s["has_channel"])
    return blockers(
        [
            ("IDENTITY_NOT_VERIFIED", ~yes(s["identity"] == "VERIFIED")),
            ("GEOGRAPHY_NOT_VERIFIED_US", ~yes(us)),
            ("ELIGIBILITY_NOT_APPROVED", yes(us) & ~yes(s["eligibility"] == "ELIGIBLE")),
            ("COMPANY_HUMAN_REVIEW_INCOMPLETE", ~yes(s["company_review"] == "APPROVED")),
            ("NO_SUITABLE_FIRST_PARTY_EMAIL", ~chosen),
            ("CONTACT_EVIDENCE_MISSING", chosen & blank(s["source_url"])),
            ("CONTACT_HUMAN_REVIEW_INCOMPLETE", chosen & ~yes(s["channel_review"] == "APPROVED")),
            ("SUPPRESSED_EMAIL", chosen & yes(s["suppressed"])),
            ("COMPANY_OPTED_OUT", yes(s["opted_out"])),
            ("ALREADY_IN_SELECTED_CAMPAIGN", yes(s["member"])),
            ("VALID_HTTPS_PARTICIPATION_FORM_NOT_CONFIGURED", ~yes(s["form_ready"])),
            ("COMPANY_INVITATION_TOKEN_UNAVAILABLE", ~yes(s["has_token"])),
        ]
    )


def employee_evidence(values: Column) -> Column:
    """Whether any published head count marks a large enterprise; low counts prove nothing."""
    large = F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v.try_cast("double") >= 10_000, F.lit(False)))
    return F.when(large, "LARGE_ENTERPRISE_SUPPORTED").otherwise("SIZE_UNKNOWN")


def page_signals(pages: Column, links: Column) -> Column:
    """The signals of a site from its read pages (array of path, visible_text_length, structured types)."""
    total = F.aggregate(pages, F.lit(0).cast("long"), lambda a, p: a + F.coalesce(p["visible_text_length"].cast("long"), F.lit(0)))
    home = F.coalesce(F.get(pages, F.lit(0))["visible_text_length"].cast("long"), F.lit(0))
    under = lambda *terms: F.exists(pages, lambda p: F.lower(p["path"]).rlike("|".join(terms)))
    has = lambda kind: F.exists(pages, lambda p: F.array_contains(p["types"], kind))
    return F.struct(
        (F.size(pages) > 0).alias("reachable"), (home >= 500).alias("meaningful_text"), (total >= 1500).alias("substantial"),
        under("product", "service", "solution").alias("product_or_service_page"), under("blog", "resource", "about").alias("informational_content"),
        (under("faq") | has("FAQPage")).alias("faq"), under("contact").alias("contact_page"), under("pricing").alias("pricing_page"),
        F.exists(pages, lambda p: F.size(p["types"]) > 0).alias("structured"), ((total >= 1000) & (links > 0)).alias("relevance"),
        home.between(100, 999).alias("thin_content_opportunity"), F.size(pages).alias("pages"),
    )
