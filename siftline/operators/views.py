"""Named views, filters and guards over candidate, channel and queue rows. Conditions on nulls are false, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exports by name, with the column and value that a row needs (PRJ-08).
EXPORTS = {"all_candidates": None, "verified_companies": ("verification_status", "VERIFIED"), "geo_eligible_companies": ("geo_eligibility_status", "ELIGIBLE"), "contact_candidates": ("contact_status", "CONTACT_FOUND")}
#: Identity outcomes that a person must look at, and evidence a qualification needs (PRJ-09).
UNSURE = ["AMBIGUOUS_IDENTITY", "INSUFFICIENT_EVIDENCE", "ACCESS_BLOCKED", "FETCH_FAILED", "ROBOTS_DENIED", "REJECTED_MISMATCH", "THIRD_PARTY_URL"]
NEEDED = ["eligibility_evidence", "geo_opportunity_evidence", "usable_website_content", "industry", "geography", "employee_size_evidence"]
UNSUPPORTED = "INVALID_AMBIGUOUS_OR_UNSUPPORTED"


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def export_view(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a named export (PRJ-08); an unknown name is an error."""
    if name not in EXPORTS:
        raise ValueError(f"no export named {name}")
    needs = EXPORTS[name]
    return rows if needs is None else rows.where(F.col(needs[0]) == needs[1])


def review_views() -> dict[str, Column]:
    """A condition for each queue of a reviewer (PRJ-09); missing_evidence is an array of names."""
    sound = holds((F.col("identity_verification_status") == "VERIFIED") & (F.col("eligibility") == "ELIGIBLE"))
    return {
        "high_priority_company_review": sound & holds((F.col("research_priority") == "HIGH") & (F.col("company_review_status") == "PENDING")),
        "ambiguous_identity_review": holds(F.col("identity_verification_status").isin(UNSURE)),
        "legacy_identity_unassessed": holds(F.col("identity_verification_status") == "BASELINE_NOT_RECHECKED"),
        "missing_qualification_evidence": holds(F.arrays_overlap("missing_evidence", F.array(*map(F.lit, NEEDED)))),
        "contact_channel_review": sound & holds(F.col("contact_channel_review_status") == "PENDING"),
    }


def view_memberships(rows: DataFrame, key: str) -> DataFrame:
    """key, view for every view that a row is in: one scan for all of them."""
    names = [F.when(condition, F.lit(name)) for name, condition in review_views().items()]
    return rows.select(key, F.explode(F.filter(F.array(*names), lambda v: v.isNotNull())).alias("view"))


def either(value: str, *columns: str) -> Column:
    """Whether any of the columns has the value (PRJ-06)."""
    return holds(F.lit(value).isin(*(F.col(c) for c in columns)))


def with_source(rows: DataFrame, provenance: DataFrame, key: str, part: str) -> DataFrame:
    """Rows any of whose provenance rows names a source that contains part, case aside (PRJ-07)."""
    named = provenance.where(F.contains(F.lower("source_name"), F.lit(part.lower())))
    return rows.join(named.select(key), key, "left_semi")


def workable(status: str, attempts: str, delivery: str, statuses: list[str], most_attempts: int) -> Column:
    """Queue rows that may be worked on: status as listed, attempts left, nothing delivered (PRJ-13)."""
    return holds(F.col(status).isin(statuses) & (F.coalesce(attempts, F.lit(0)) < most_attempts)) & F.coalesce(F.col(delivery) != "DELIVERED", F.lit(True))


def distinct_sites(rows: DataFrame, key: str, url: str, domain: str, order: str) -> DataFrame:
    """key, url, domain: the first web URL of each domain of a key (FN-08)."""
    web = rows.where(F.lower(F.substring_index(url, ":", 1)).isin("http", "https") & F.col(domain).isNotNull())
    return web.groupBy(key, domain).agg(F.min_by(url, F.struct(order, url)).alias(url)).select(key, url, domain)


def decision_error(decision: str, first_party: str, identity: str, channel_class: str, note: str) -> Column:
    """Why a reviewer's decision on a channel can't be recorded, null if it can (FN-91)."""
    sound = holds((F.col(first_party) == "YES") & (F.col(identity) == "VERIFIED") & (F.col(channel_class) != UNSUPPORTED))
    return (
        F.when(~holds(F.upper(decision).isin("PENDING", "APPROVED", "REJECTED")), F.lit("UNKNOWN_DECISION"))
        .when(holds(F.length(note) > 1000), F.lit("NOTE_TOO_LONG"))
        .when(holds(F.upper(decision) == "APPROVED") & ~sound, F.lit("NOT_FIRST_PARTY_AND_VERIFIED"))
    )


def fresh(snapshots: DataFrame, key: str, fetched: str, tie: str, now: Column, hours: int = 168) -> DataFrame:
    """Each key's latest snapshot, if it is young enough to be used again (ST-04)."""
    latest = snapshots.groupBy(key).agg(F.max_by(F.struct(*snapshots.columns), F.struct(fetched, tie)).alias("s")).select("s.*")
    return latest.where(F.timestamp_diff("SECOND", F.col(fetched), now) <= hours * 3600)


def reserved(known: DataFrame, requests: DataFrame, key: str, order: str) -> DataFrame:
    """The requests that get their key: those without a known one, the first of each (ST-20)."""
    first = requests.groupBy(key).agg(F.min_by(F.struct(*requests.columns), order).alias("r")).select("r.*")
    return first.join(known.select(key), key, "left_anti")


def token_state(stopped: Column, revoked_at: Column, expires_at: Column, now: Column) -> Column:
    """STOPPED, REVOKED, EXPIRED or VALID, the first that holds (ST-13)."""
    return F.when(holds(stopped), "STOPPED").when(holds(revoked_at <= now), "REVOKED").when(F.coalesce(expires_at <= now, F.lit(True)), "EXPIRED").otherwise("VALID")


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """A call's price from prices for a million tokens, to six places (AGG-30)."""
    return F.round((F.coalesce(tokens_in, F.lit(0)) * F.lit(price_in) + F.coalesce(tokens_out, F.lit(0)) * F.lit(price_out)) / F.lit(1e6), 6)
