"""Triage of saved candidate rows: named exports, selections, refinements and gates. Conditions on nulls are false, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, first_match
from ..functions.url import blank, domain_key, third_party
from .views import holds

#: Screening states that are done, the type of rows that are fixtures, and kinds of channels with an address.
SCREENED = ["COMPLETE", "SCREENING_COMPLETE"]
FIXTURE = "owner_controlled_test"
EMAIL_KINDS = ["GENERAL_BUSINESS_EMAIL", "SALES_MARKETING_EMAIL", "PARTNERSHIP_EMAIL", "BUSINESS_DEVELOPMENT_EMAIL", "NAMED_PERSON_EMAIL"]
#: Saved outcomes of a website's check, titles that say nothing, words of hijacked sites.
OUTCOMES = ["VERIFIED", "AMBIGUOUS", "AMBIGUOUS_IDENTITY", "INSUFFICIENT_EVIDENCE", "FETCH_FAILED", "ACCESS_BLOCKED", "REJECTED_MISMATCH"]
BARE_TITLES = ["", "home", "homepage", "welcome"]
GAMBLING = ["casino", "togel", "judi bola"]
#: Words of a hotel's pages, types of its structured data, and words of a page that takes bookings.
HOTEL_WORDS = ["hotel", "lodge", "inn", "resort", "rooms", "book", "reservation"]
HOTEL_TYPES = ["hotel", "lodgingbusiness", "offer"]
BOOKING_WORDS = ["book now", "reserve now", "check availability", "book a room", "make a reservation", "availability"]


def triage_exports() -> dict[str, Column]:
    """A condition for each export of a screening round (PRJ-10)."""
    verified = holds(F.col("verification_status") == "VERIFIED")
    eligible = holds(F.col("geo_eligibility_status") == "ELIGIBLE")
    calm = (F.col("screen_status") == "LIKELY_FIT") & (F.col("chain_location_concern") == "NO_STRUCTURED_SIGNAL") & (F.col("website_domain_concern") == "NO_OBVIOUS_PATTERN")
    return {
        "verified_candidates": verified,
        "geo_eligible_candidates": eligible,
        "contact_discovery_priority": verified & eligible & ~holds(F.col("contact_status") == "CONTACT_FOUND"),
        "exclusion_uncertainty_report": ~holds(calm),
    }


def export_memberships(rows: DataFrame, key: str) -> DataFrame:
    """key, export for every export that a row is in: one scan for all of them."""
    names = [F.when(condition, F.lit(name)) for name, condition in triage_exports().items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*names))).alias("export"))


def saved(rows: DataFrame, kind: str = "profile_type") -> DataFrame:
    """Rows that aren't fixtures (PRJ-16)."""
    return rows.where(F.col(kind) != FIXTURE)


def screenable(rows: DataFrame, key: str, updated: str, limit: int, kind: str | None = None) -> DataFrame:
    """The rows that wait longest for a screening: verified, eligible, with a website (PRJ-12); limit is 1 to 250."""
    if not 1 <= limit <= 250:
        raise ValueError("limit must be between 1 and 250")
    ready = (F.col("identity_verification_status") == "VERIFIED") & (F.col("qualification_status") == "ELIGIBLE") & (F.col("official_website") != "")
    found = saved(rows).where(ready & ~F.col("screening_status").isin(SCREENED))
    found = found if kind is None else found.where(F.col("profile_type") == kind)
    return found.orderBy(updated, key).limit(limit)


def in_cohort(rows: DataFrame, baseline: DataFrame, website: str) -> DataFrame:
    """Rows with cohort_membership and website_url_is_third_party_profile (PRJ-20). Domains of the baseline count once."""
    known = baseline.select(domain_key(F.col(website)).alias("_known")).where("_known IS NOT NULL").distinct()
    member = F.when(F.col("_base._known").isNotNull(), "BASELINE_PRESERVED").otherwise("NEW_EXPERIMENTAL")
    marked = rows.alias("_rows").join(known.alias("_base"), domain_key(F.col(f"_rows.{website}")) == F.col("_base._known"), "left")
    return marked.select("_rows.*", member.alias("cohort_membership"), third_party(F.col(f"_rows.{website}")).alias("website_url_is_third_party_profile"))


def usable_channels(channels: Column) -> Column:
    """Of an array of channels (channel_type, email, channel_url, review_status) those with an address of a
    business kind or a form with a URL, unless rejected (FN-92). Null gives an empty array."""

    def usable(c: Column) -> Column:
        kind = F.upper(c.channel_type)
        reachable = holds(kind.isin(EMAIL_KINDS) & (c.email != "")) | holds((kind == "CONTACT_FORM") & (c.channel_url != ""))
        return reachable & ~holds(F.upper(c.review_status) == "REJECTED")

    return F.coalesce(F.filter(channels, usable), F.array().cast("array<struct<channel_type:string,email:string,channel_url:string,review_status:string>>"))


def refined_status(name: Column, website: Column, status: Column, http: Column, final: Column, title: Column) -> Column:
    """A saved website check's outcome, refined and never promoted (FN-42): VERIFIED stays unless a name of one
    word stands in the title of a host of another name; an ambiguous one can only become worse."""
    was, said, code = F.upper(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(title, F.lit(""))), F.coalesce(http, F.lit(""))
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit(r"(?U)(\w{2,})"), F.lit(1))
    word, host = F.get(words, F.lit(0)), domain_key(F.when(blank(final), website).otherwise(final))
    collides = (F.size(words) == 1) & holds(F.contains(said, word)) & ~holds(F.split(host, r"\.")[0] == word)
    nameless = (F.size(words) == 0) | holds(F.trim(name).rlike(r"^[qQ]\d+$"))
    moved = holds(domain_key(website) != domain_key(final))
    blocked = was.isin("BLOCKED", "ACCESS_BLOCKED")
    return first_match(
        [
            (blocked, "ACCESS_BLOCKED"),
            (~was.isin(OUTCOMES), "INSUFFICIENT_EVIDENCE"),
            (code.isin("401", "403", "429"), "ACCESS_BLOCKED"),
            ((was == "FETCH_FAILED") | (code == ""), "FETCH_FAILED"),
            ((was == "VERIFIED") & ~collides, "VERIFIED"),
            (was == "VERIFIED", "INSUFFICIENT_EVIDENCE"),
            (was == "REJECTED_MISMATCH", "REJECTED_MISMATCH"),
            (nameless | F.trim(said).isin(BARE_TITLES), "INSUFFICIENT_EVIDENCE"),
            (any_of(said, GAMBLING) & moved, "REJECTED_MISMATCH"),
        ],
        "AMBIGUOUS_IDENTITY",
    )


def hotel_evidence(pages: Column, product_page: Column, substantial: Column) -> Column:
    """What saved pages (title, meta_description, structured_data_types) say of a hotel at work (FN-54); a person confirms it."""

    def words(p: Column) -> Column:
        return F.lower(F.concat_ws(" ", p.title, p.meta_description))

    service = F.filter(pages, lambda p: any_of(words(p), HOTEL_WORDS) | any_of(F.lower(F.coalesce(p.structured_data_types, F.lit(""))), HOTEL_TYPES))
    books = holds(F.exists(service, lambda p: any_of(words(p), BOOKING_WORDS)))
    return (
        F.when(books & (holds(product_page) | holds(substantial)), "OPERATING_SIGNAL_REVIEW_REQUIRED")
        .when(holds(F.size(service) > 0), "SERVICE_CONTENT_ONLY_REVIEW_REQUIRED")
        .otherwise("NOT_ESTABLISHED")
    )


def preview_gate(eligibility: Column, identity: Column, channels: Column, geography: Column, chosen: Column) -> Column:
    """Whether a draft may be shown, else why not (FN-87); channels is the array of ids of suitable channels."""
    return first_match(
        [
            (~holds(F.upper(eligibility) == "ELIGIBLE"), "BLOCKED_NOT_ELIGIBLE"),
            (~holds(identity == "VERIFIED"), "BLOCKED_IDENTITY_UNVERIFIED"),
            (~holds(F.size(channels) > 0), "NO_SUITABLE_CHANNEL"),
            (~holds(geography == "VERIFIED_US"), "BLOCKED_GEOGRAPHY"),
            (~holds(F.array_contains(channels, chosen)), "CHANNEL_NOT_FOUND"),
        ],
        "DRAFT_READY",
    )


def export_order(rows: DataFrame, name: str, key: str, recipient: str) -> DataFrame:
    """Rows in the order of the merge export: name without case, id, recipient without case (TOP-09)."""
    return rows.orderBy(F.lower(name), key, F.lower(recipient))
