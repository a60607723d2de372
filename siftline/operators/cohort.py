"""Rows that gather all that is known of a company: review queue, selection, pool (FN-55, FN-88, SET-06).

Discoveries, contacts and snapshots are each one aggregation by company before they are joined, so a company may have any
number of them; "first" is by id and "latest" by time, then id. Companies without any keep their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import SUITABLE_TYPES, first_party
from ..functions.decide import PriorityRules, blockers, qualification
from ..functions.review import missing_evidence, outreach_readiness, review_tasks
from ..functions.text import first_match, sorted_join
from ..functions.url import blank
from .views import holds

TEXTS = "array<string>"
# What a pool row says of where it comes from.
ORIGIN, INHERITED = "curated cohort; not recrawled", "Inherited saved website verification; not re-crawled"
PERMISSION = "Existing cohort provenance; source permissions are recorded in its inventory and were not reassessed."


def empty(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(TEXTS))


def in_order(by: str, value: Column) -> Column:
    """The values of a company's rows that aren't blank, in the order of `by`."""
    return F.transform(F.array_sort(F.collect_list(F.when(~blank(value), F.struct(F.col(by).alias("by"), value.alias("value"))))), lambda x: x["value"])


def discovered(discoveries: DataFrame) -> DataFrame:
    """A row for each company of discoveries (id, company_id, source_type, source_name, source_url, source_identifier, raw_data)."""
    raw = F.from_json("raw_data", "source_directory_url string, active boolean, ineligible boolean, unsuitable boolean")
    source = F.coalesce(F.nullif("source_name", F.lit("")), F.nullif("source_type", F.lit("")))
    read = discoveries.withColumn("_raw", raw)
    return read.groupBy("company_id").agg(
        F.collect_set(source).alias("d_sources"), in_order("id", F.col("source_url")).alias("d_urls"), in_order("id", F.col("source_identifier")).alias("d_ids"),
        F.collect_set("_raw.source_directory_url").alias("d_directories"), F.min_by("_raw", "id").alias("d_first"), F.count("*").alias("d_n"),
    )


def latest(snapshots: DataFrame) -> DataFrame:
    """company_id and s, the latest row of snapshots (id, company_id, fetched_at, ...)."""
    return snapshots.groupBy("company_id").agg(F.max_by(F.struct(*(F.col(c) for c in snapshots.columns if c != "company_id")), F.struct("fetched_at", "id")).alias("s"))


def reached(companies: DataFrame, contacts: DataFrame) -> DataFrame:
    """A row for each company of contacts (id, company_id, channel_type, channel_url, source_url, email, review_status, name, contact_type, recommended, ranking_score)."""
    own = contacts.join(companies.select("company_id", "normalized_domain"), "company_id")
    suitable = F.col("channel_type").isin(SUITABLE_TYPES)
    party = first_party(F.col("channel_type"), F.col("email"), F.col("channel_url"), F.col("source_url"), F.col("normalized_domain"), F.col("review_status"))
    value = F.coalesce(F.nullif("email", F.lit("")), F.nullif("channel_url", F.lit("")), "source_url")
    ranked = F.struct((~holds(F.col("recommended"))).alias("a"), (-F.coalesce("ranking_score", F.lit(0))).alias("b"), F.col("id").alias("c"), F.struct(F.coalesce("channel_type", F.lit("")).alias("type"), value.alias("value"), F.col("source_url").alias("evidence_url"), "review_status").alias("channel"))
    return own.groupBy("company_id").agg(
        F.count_if(suitable).alias("c_suitable"), F.count_if(suitable & (F.col("review_status") == "PENDING")).alias("c_pending"), F.collect_set(F.when(suitable, F.coalesce(F.nullif("source_url", F.lit("")), F.nullif("channel_url", F.lit(""))))).alias("c_urls"),
        F.max(party).alias("c_own"), F.array_sort(F.collect_list(F.when(F.col("channel_type").isNotNull(), ranked))).alias("c_channels"), F.collect_set(F.when(F.col("contact_type") == "PERSON", F.col("name"))).alias("c_people"),
    )


def gathered(companies: DataFrame, discoveries: DataFrame, snapshots: DataFrame, contacts: DataFrame) -> DataFrame:
    """companies with all that the aggregations of the others say of them."""
    out = companies
    for side in (discovered(discoveries), latest(snapshots), reached(companies, contacts)):
        out = out.join(side, "company_id", "left")
    return out


def upper(name: str, default: str) -> Column:
    return F.upper(F.coalesce(F.nullif(name, F.lit("")), F.lit(default)))


def review_rows(companies: DataFrame, discoveries: DataFrame, snapshots: DataFrame, contacts: DataFrame, identities: DataFrame) -> DataFrame:
    """The review queue: a row for each company, 29 columns and its priority (FN-88). identities: company_id, identity.

    The priority orders by identity (verified first), eligibility, opportunity, tier, evidence, then id."""
    rows = gathered(companies, discoveries, snapshots, contacts).join(identities, "company_id", "left")
    identity, pending = F.coalesce("identity", F.lit("BASELINE_NOT_RECHECKED")), F.coalesce("c_pending", F.lit(0))
    eligibility, opportunity, evidence = upper("eligibility", "NEEDS_REVIEW"), upper("geo_opportunity", "UNKNOWN"), upper("evidence_confidence", "LOW")
    facts = {"identity": identity, "eligibility": eligibility, "opportunity": opportunity, "company_review": F.col("review_status"), "contact_status": F.col("contact_status"), "contactability": F.col("contactability_status"), "pending_channels": pending}
    rows = rows.withColumn("_tasks", review_tasks(facts))
    tasks = {n: F.col(f"_tasks.{n}") for n in ("identity_task", "eligibility_task", "opportunity_task", "contact_task", "outreach_approval")}
    ready = outreach_readiness(facts | {"contact_task": tasks["contact_task"]})
    missing = missing_evidence({"identity": identity, "industry": F.col("industry"), "location": F.col("location"), "size": F.col("company_size_value"), "eligibility": F.col("eligibility"), "opportunity": F.col("geo_opportunity"), "fetch_status": F.col("s.fetch_status")})
    todo = blockers([("VERIFY_COMPANY_WEBSITE", tasks["identity_task"] == "PENDING"), ("REVIEW_ELIGIBILITY", tasks["eligibility_task"] == "PENDING"), ("REVIEW_GEO_OPPORTUNITY", tasks["opportunity_task"] == "PENDING"), ("REVIEW_CONTACT_CHANNEL", tasks["contact_task"] == "PENDING")])
    action = first_match([(F.size(todo) > 0, F.array_join(todo, "; ")), (F.col("review_status") == "PENDING", "CONFIRM_MACHINE_FINDINGS")], "NONE")
    links = F.concat(empty(F.col("d_urls")), empty(F.col("d_directories")), F.array("s.requested_url", "s.final_url", "s.canonical_url", "website"))
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    order = lambda c, *labels: first_match([(c == n, k) for k, n in enumerate(labels)], len(labels))
    shown = {
        "company_id": F.col("company_id"), "company_name": F.col("company_name"), "website": F.col("website"), "discovery_source": sorted_join(empty(F.col("d_sources")), "; "), "industry": text("industry"), "company_size": text("company_size_value"),
        "company_size_evidence_source": F.coalesce(F.nullif("company_size_source", F.lit("")), F.lit("unknown")), "company_size_category": F.coalesce(F.nullif("company_size_category", F.lit("")), F.lit("UNKNOWN")), "geography": text("location"),
        "website_fetch_status": F.coalesce("s.fetch_status", F.lit("NOT_INSPECTED")), "identity_verification_status": identity, "eligibility": eligibility, "geo_opportunity": opportunity, "research_priority": upper("priority_tier", "NEEDS_REVIEW"), "evidence_confidence": evidence,
        "evidence_links": sorted_join(links, " | "), "missing_evidence": F.array_join(missing, "; "), "required_review_action": action, "company_review_status": F.col("review_status"), **tasks, "contact_channel_status": F.col("contact_status"), "outreach_readiness_status": ready,
        "contact_channel_evidence_links": sorted_join(empty(F.col("c_urls")), " | "), "reviewer_notes": text("review_notes"), "reviewed_by": text("reviewed_by"),
    }
    priority = F.struct(
        order(identity, "VERIFIED").alias("a"), order(eligibility, "ELIGIBLE", "NEEDS_REVIEW", "INELIGIBLE").alias("b"), order(opportunity, "HIGH", "MEDIUM", "LOW", "UNKNOWN").alias("c"), order(upper("priority_tier", "NEEDS_REVIEW"), "HIGH", "MEDIUM", "LOW", "NEEDS_REVIEW").alias("d"),
        order(evidence, "HIGH", "MEDIUM", "LOW").alias("e"), F.col("company_id").alias("f"),
    )
    return rows.select(*(c.alias(n) for n, c in shown.items()), priority.alias("priority_key"))


def selection_records(companies: DataFrame, discoveries: DataFrame, snapshots: DataFrame, contacts: DataFrame, rules: PriorityRules = PriorityRules()) -> DataFrame:
    """The unified selection record of each company (FN-55): what the rules say of it, its channel and the others, what is missing.

    The latest snapshot's signals and the first discovery's flags go to the rules. The channel is the reviewer's choice if there is one
    (of the company's own contacts), else the primary one; alternatives follow in order of recommendation, rank and id."""
    rows = gathered(companies, discoveries, snapshots, contacts)
    signals = F.from_json("s.extracted_signals", "pages_inspected int, reachable boolean, meaningful_text boolean, substantial boolean, relevance boolean, faq boolean, structured boolean")
    rows = rows.withColumn("_e", signals)
    e = lambda n: F.col(f"_e.{n}")
    facts = {"has_evidence": F.col("s").isNotNull(), "fetch_status": F.col("s.fetch_status"), "pages": e("pages_inspected"), "active": F.col("d_first.active"), "ineligible": F.col("d_first.ineligible"), "unsuitable": F.col("d_first.unsuitable"), "discovery": F.coalesce("d_n", F.lit(0)) > 0}
    facts |= {n: e(n) for n in ("reachable", "meaningful_text", "substantial", "relevance", "faq", "structured")}
    facts |= {n: facts.get(n, F.lit(False)) for n in rules.exclusions}
    rows = rows.withColumn("_q", qualification(facts, rules))
    chosen = F.coalesce("channel_override_contact_id", "primary_channel_id")
    every = F.coalesce("c_channels", F.array().cast(rows.schema["c_channels"].dataType))
    rows = rows.withColumn("_channel", F.get(F.filter(every, lambda c: c["c"].eqNullSafe(chosen)), F.lit(0))["channel"])
    others = F.transform(F.filter(every, lambda c: ~c["c"].eqNullSafe(F.when(F.col("_channel").isNotNull(), chosen))), lambda c: F.struct(c["channel"]["evidence_url"].alias("evidence_url"), c["channel"]["review_status"].alias("review_status"), c["channel"]["type"].alias("type"), c["channel"]["value"].alias("value")))
    fits = holds(F.col("_channel.type").isin(SUITABLE_TYPES))
    overridden = F.col("channel_override_contact_id").isNotNull()
    readiness = first_match(
        [(overridden & fits, "NEEDS_CHANNEL_REVIEW"), (overridden, "NO_SUITABLE_CHANNEL"), (F.col("contactability_status") == "READY_FOR_REVIEW", "CHANNEL_AVAILABLE"), (F.col("contactability_status") == "NEEDS_REVIEW", "NEEDS_CHANNEL_REVIEW"), (F.col("contactability_status") == "FETCH_FAILED", "FETCH_FAILED")],
        "NO_SUITABLE_CHANNEL",
    )
    size, q = F.col("company_size_value"), lambda n: F.col(f"_q.{n}")
    inactive = ~F.coalesce("d_first.active", F.lit(True))
    missing = blockers(
        [
            ("company_size_count_zero_needs_verification", holds(size == 0)), ("industry", blank(F.col("industry"))), ("geography", blank(F.col("location"))), ("company_size", size.isNull() | (size < 0)), ("website_evidence", F.col("s").isNull() | (q("confidence") == "LOW")),
            ("eligibility_evidence", q("eligibility") == "NEEDS_REVIEW"), ("discovery_activity_status_conflicts_with_current_public_website", inactive), ("GEO_opportunity_evidence", q("opportunity") == "UNKNOWN"),
        ]
    )
    why = first_match(
        [
            (q("eligibility") == "ELIGIBLE", "discovery provenance is recorded; first-party website is reachable and has meaningful public content"),
            (q("eligibility") == "INELIGIBLE", "explicit configured exclusion evidence: " + ", ".join(rules.exclusions)),
            (inactive, "discovery source explicitly marked the company inactive; current activity requires review"),
        ],
        "insufficient evidence to establish an eligible research candidate; no exclusion inferred",
    )
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    shown = {
        "company_id": F.col("company_id"), "company_name": F.col("company_name"), "website": F.col("website"), "discovery_source": sorted_join(empty(F.col("d_sources")), "; "), "industry": text(F.col("industry")),
        "company_size": F.when(size > 0, F.concat(size.cast("string"), F.lit(" employees (directory-reported)"))).otherwise(""), "geography": text(F.col("location")), "eligibility": q("eligibility"), "eligibility_reasons": why, "geo_opportunity": q("opportunity"),
        "research_priority": q("tier"), "priority_score": F.format_string("%.1f", q("priority").cast("double")), "evidence_confidence": q("confidence"), "website_fetch_status": F.coalesce("s.fetch_status", F.lit("NOT_INSPECTED")), "primary_channel_type": text(F.col("_channel.type")),
        "primary_channel": text(F.col("_channel.value")), "channel_evidence_url": text(F.col("_channel.evidence_url")), "alternative_channels": F.to_json(others), "named_decision_maker": sorted_join(empty(F.col("c_people")), "; "), "outreach_readiness": readiness,
        "company_review_status": F.col("review_status"), "channel_review_status": text(F.col("_channel.review_status")), "reviewer_notes": text(F.col("review_notes")), "channel_override_contact_id": text(F.col("channel_override_contact_id")), "missing_information": F.array_join(missing, "; "), "has_channel": fits,
    }
    return rows.select(*(c.alias(n) for n, c in shown.items()))


def pool_rows(companies: DataFrame, discoveries: DataFrame, snapshots: DataFrame, contacts: DataFrame, saved: DataFrame, batch: str) -> DataFrame:
    """Curated companies as rows of the candidates' pool, 24 columns (SET-06). saved: company_id, identity, reason, http_status of earlier verifications.

    Eligibility and opportunity hold only for verified companies; a contact is found if a suitable channel is the company's own; a
    company is ready only if it was sent on, is verified, eligible and approved. The evidence says where each value came from."""
    rows = gathered(companies, discoveries, snapshots, contacts).join(saved, "company_id", "left")
    identity = F.coalesce(F.upper(F.nullif("identity", F.lit(""))), F.lit("BASELINE_NOT_RECHECKED"))
    verified, before = identity == "VERIFIED", upper("eligibility", "NEEDS_REVIEW")
    eligibility = F.when(verified, before).otherwise("NEEDS_REVIEW")
    opportunity = F.when(verified & (eligibility == "ELIGIBLE"), upper("geo_opportunity", "UNKNOWN")).otherwise("UNKNOWN")
    ready = holds((F.col("pipeline_status") == "READY_FOR_GEO") & verified & (eligibility == "ELIGIBLE") & F.upper("review_status").isin("APPROVED", "HUMAN_APPROVED"))
    evidence = F.to_json(F.struct(F.col("s.fetch_status").alias("fetch_status"), F.lit("saved verification or snapshot").alias("identity_review_source"), F.lit(ORIGIN).alias("origin"), F.col("company_size_category").alias("original_company_size_category"), F.col("company_size_value").alias("original_company_size_value"), before.alias("original_eligibility"), F.col("priority_tier").alias("original_priority_tier")))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    sources = sorted_join(empty(F.col("d_sources")), "; ")
    shown = {
        "candidate_id": F.concat(F.lit(f"{batch}:"), F.col("company_id").cast("string")), "company_name": text(F.col("company_name")), "website": text(F.col("website")), "canonical_domain": text(F.col("normalized_domain")), "industry": text(F.col("industry")), "location": text(F.col("location")),
        "source_name": F.when(sources == "", "Legacy cohort").otherwise(sources), "source_url": text(F.get(empty(F.col("d_urls")), F.lit(0))), "source_record_id": F.array_join(empty(F.col("d_ids")), ";"), "source_license_or_permission": F.lit(PERMISSION), "discovery_timestamp": text(F.col("created_at")),
        "verification_status": identity, "geo_eligibility_status": eligibility, "geo_opportunity_status": opportunity, "contact_status": F.when(holds(F.col("c_own")), "CONTACT_FOUND").otherwise("NOT_DISCOVERED"), "human_review_status": F.coalesce(F.nullif("review_status", F.lit("")), F.lit("PENDING")),
        "outreach_ready_status": F.when(ready, "READY").otherwise("NOT_READY"), "verification_reason": F.coalesce(F.nullif("reason", F.lit("")), F.lit(INHERITED)), "qualification_evidence": F.col("qualification_evidence"), "fetch_status": F.col("s.fetch_status"), "http_status": F.coalesce("http_status", "s.http_status"),
        "evidence_json": evidence, "last_inspected_at": F.col("s.fetched_at").cast("string"), "source_batch": F.lit(batch),
    }
    return rows.select(*(c.alias(n) for n, c in shown.items()))
