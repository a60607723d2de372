"""Composite decisions as struct expressions: qualification, identity, audit confidence, gates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, first_match, name_key


@dataclass(frozen=True)
class PriorityRules:
    """Points and thresholds; the defaults are the published configuration."""

    eligible: int = 20
    analyzable: int = 15
    relevance: int = 15
    opportunity_high: int = 20
    opportunity_medium: int = 10
    confidence_high: int = 10
    confidence_medium: int = 5
    high: int = 75
    medium: int = 55
    exclusions: tuple[str, ...] = field(default=())


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def qualification(s: dict[str, Column], rules: PriorityRules = PriorityRules()) -> Column:
    """(confidence, eligibility, opportunity, priority, tier, decision) from signals.

    s: has_evidence, fetch_status, pages, reachable, meaningful_text, substantial, relevance, faq,
    structured, active, discovery, and the columns that rules.exclusions names. What isn't known
    never counts against a record."""
    unread = yes(s["fetch_status"].isin("BLOCKED", "ROBOTS_DENIED", "FETCH_FAILED")) | ~yes(s["has_evidence"])
    confidence = first_match([(unread, "LOW"), (F.coalesce(s["pages"], F.lit(0)) >= 2, "HIGH")], "MEDIUM")
    excluded = F.lit(False)
    for name in rules.exclusions:
        excluded = excluded | yes(s[name])
    fits = yes(s["reachable"]) & (yes(s["meaningful_text"]) | yes(s["substantial"])) & yes(s["discovery"])
    eligibility = first_match([(excluded, "INELIGIBLE"), (~F.coalesce(s["active"], F.lit(True)), "NEEDS_REVIEW"), (fits, "ELIGIBLE")], "NEEDS_REVIEW")
    gap = ~yes(s["faq"]) | ~yes(s["structured"])
    opportunity = first_match(
        [
            (confidence == "LOW", "UNKNOWN"),
            (yes(s["substantial"]) & yes(s["relevance"]) & gap, "HIGH"),
            (yes(s["meaningful_text"]) & yes(s["relevance"]), "MEDIUM"),
            (yes(s["meaningful_text"]), "LOW"),
        ],
        "UNKNOWN",
    )
    points = [
        (eligibility == "ELIGIBLE", rules.eligible),
        ((confidence != "LOW") & yes(s["reachable"]), rules.analyzable),
        (yes(s["relevance"]), rules.relevance),
        (opportunity == "HIGH", rules.opportunity_high),
        (opportunity == "MEDIUM", rules.opportunity_medium),
        (confidence == "HIGH", rules.confidence_high),
        (confidence == "MEDIUM", rules.confidence_medium),
    ]
    priority = F.least(F.lit(100), sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0)))
    tier = first_match([((confidence == "LOW") | (eligibility == "NEEDS_REVIEW"), "NEEDS_REVIEW"), (priority >= rules.high, "HIGH"), (priority >= rules.medium, "MEDIUM")], "LOW")
    decision = first_match([(eligibility == "ELIGIBLE", "QUALIFIED"), (eligibility == "INELIGIBLE", "REJECTED")], "NEEDS_REVIEW")
    return F.struct(confidence.alias("confidence"), eligibility.alias("eligibility"), opportunity.alias("opportunity"), priority.alias("priority"), tier.alias("tier"), decision.alias("decision"))


# Words that identify nobody, and what parked or repurposed sites say.
GENERIC_TOKENS = ["the", "and", "for", "with", "company", "companies", "group", "holdings", "services", "service", "solutions", "solution", "technology", "technologies", "systems", "international", "global", "inc", "llc", "ltd", "limited", "corp", "corporation", "co", "center", "centre", "of", "at", "by"]
PARKED = ["domain is for sale", "buy this domain", "domain for sale", "parked free", "this domain may be for sale", "sedo domain parking", "afternic", "parkingcrew"]
REPURPOSED = ["togel", "judi bola", "online casino", "casino bonus", "sports betting"]
GENERIC_TITLES = ["home", "homepage", "welcome", "index", "website coming soon"]


def tokens(c: Column) -> Column:
    """Distinct telling words of at least three characters."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)), F.array(*map(F.lit, GENERIC_TOKENS)))


def identity(s: dict[str, Column]) -> Column:
    """The status of a website's identity, from a snapshot's saved evidence.

    s: name, requested (domain), final (domain), third_party, has_snapshot, fetch_status, http_status,
    pages_ok, title (the homepage's), titles, content (lower case), text_length (of all pages)."""
    key = name_key(s["name"])
    own = tokens(key)
    root = F.split_part(s["final"], F.lit("."), F.lit(1))
    host_words = tokens(F.regexp_replace(root, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " "))
    compact_name, compact_host = F.regexp_replace(key, "[^a-z0-9]", ""), F.regexp_replace(root, "[^a-z0-9]", "")
    on_domain, in_text, in_title = (F.array_intersect(own, x) for x in (host_words, tokens(s["content"]), tokens(s["titles"])))
    long_enough = F.length(compact_name) >= 4
    brand = long_enough & (compact_host.contains(compact_name) | compact_name.contains(compact_host))
    title_exact = long_enough & F.regexp_replace(F.lower(s["titles"]), "[^a-z0-9]", "").contains(compact_name)
    many, one = F.size(own) >= 2, (F.size(own) == 1) & (F.length(F.get(own, F.lit(0))) >= 5)
    supported = (
        (brand & (title_exact | (F.size(in_title) > 0)))
        | (many & (F.size(on_domain) > 0) & ((F.size(in_text) >= 2) | ((F.size(in_title) > 0) & (F.size(F.array_except(on_domain, in_title)) > 0))))
        | (one & brand & (title_exact | (F.size(in_text) > 0)))
    )
    nothing = (F.size(in_text) == 0) & (F.size(on_domain) == 0)
    title = F.lower(F.trim(F.coalesce(s["title"], F.lit(""))))
    return first_match(
        [
            (yes(s["third_party"]), "THIRD_PARTY_URL"),
            (~yes(s["has_snapshot"]), "FETCH_FAILED"),
            (s["fetch_status"] == "ROBOTS_DENIED", "ROBOTS_DENIED"),
            ((s["fetch_status"] == "BLOCKED") | yes(s["http_status"].isin(401, 403, 429)), "ACCESS_BLOCKED"),
            (s["fetch_status"].isin("FETCH_FAILED", "FAILED") | (F.coalesce(s["pages_ok"], F.lit(0)) == 0), "FETCH_FAILED"),
            (any_of(s["content"], PARKED), "REJECTED_MISMATCH"),
            (any_of(s["content"], REPURPOSED) & (F.size(in_text) == 0), "REJECTED_MISMATCH"),
            (supported, "VERIFIED"),
            ((s["requested"] != s["final"]) & nothing, "REJECTED_MISMATCH"),
            ((s["text_length"] < 100) | (title == "") | title.isin(GENERIC_TITLES), "INSUFFICIENT_EVIDENCE"),
        ],
        "AMBIGUOUS_IDENTITY",
    )


def audit_confidence(first_party: Column, verified: Column, purpose: Column, usable: Column) -> Column:
    score = F.when(first_party, 2).otherwise(0) + F.when(verified, 2).otherwise(0) + F.when(purpose, 1).otherwise(0) + F.when(usable, 1).otherwise(0)
    return first_match([(score >= 6, "HIGH"), (score >= 4, "MEDIUM")], "LOW")


def blockers(rules: list[tuple[str, Column]]) -> Column:
    """The reasons that hold, in order; an empty array when none does. Every reason is tested on its own."""
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules)))


def readiness(reasons: Column, hard: list[str], soft: list[str]) -> Column:
    lits = lambda xs: F.array(*map(F.lit, xs))
    return first_match([(F.size(reasons) == 0, "READY"), (F.arrays_overlap(reasons, lits(hard)), "BLOCKED"), (F.arrays_overlap(reasons, lits(soft)), "NEEDS_REVIEW")], "UNKNOWN")


def stop_reason(s: dict[str, Column], request_cap: int, time_cap: float, limit: int, least_verified: float = 0.23, least_eligible: float = 0.204) -> Column:
    """Why a run stops after a slice of work; null while it goes on."""
    rate = lambda n: s[n] / F.nullif(s["attempted"], F.lit(0))
    return first_match(
        [
            (yes(s["stop_requested"]), "operator_stop_requested"),
            (s["requests"] >= request_cap, "request_cap_exhausted"),
            (s["seconds"] >= time_cap, "time_cap_exhausted"),
            (s["total"] >= limit, "candidate_limit_reached"),
            (s["attempted"] == 0, "no_progress"),
            (yes(s["cohort_complete"]) & ((rate("verified") < least_verified) | (rate("eligible") < least_eligible)), "quality_degradation_pause"),
        ],
        F.lit(None).cast("string"),
    )
