"""Saved records read again: site rows and checks, import and result records, replays and checkpoints.

Rows that break a contract stay, with what is wrong in `error`; conditions on nulls are false, never null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, first_match, name_key, sorted_join
from ..functions.url import blank, domain_key, third_party
from .views import holds

#: Words of parked sites, phrases that no screening may hold, and of invitations.
PARKED = ["domain for sale", "buy this domain", "parked domain", "domain parking"]
PRECISE = ["% uplift", "% increase", "precise percentage"]
PROMISE = r"(?i)\b(we\s+guarantee|guaranteed\s+(increase|uplift|improvement)|\d+\s*%\s*(increase|uplift|improvement))\b"
MODES = ["RULE_BASED", "LOCAL_LLM", "PAID_API"]
RATINGS = ["HIGH", "MEDIUM", "LOW", "INSUFFICIENT_EVIDENCE"]
#: The type of the test fixtures, and of a hotel; all others are companies.
FIXTURE, HOTEL, COMPANY = "owner_controlled_test", "hotel_property", "business_company"
#: Sections of a result envelope with their records' type and the fields that it needs.
SECTIONS = {
    "property_mapping": ("property_identity_mapping", ["property_id", "mapped_at"]),
    "audit": ("audit_result_reference", ["audit_id", "status", "audit_url", "page_refs", "captured_at"]),
    "strategies": ("ranked_strategy_recommendation", ["audit_id", "ranking_policy", "strategies", "created_at"]),
    "exact_text_edits": ("exact_text_edit_proposal", ["page_id", "proposal_id", "approval_status", "evidence_refs", "created_at"]),
    "question_set": ("evaluation_question_set", ["questions", "created_at"]),
    "baseline": ("baseline_experiment_reference", ["experiment_id", "status", "results_present", "created_at"]),
    "deployment_receipts": ("deployment_receipt", ["proposal_id", "approval_status", "source_git_revision", "content_hash", "deployed_git_revision", "vercel_deployment_id", "public_url", "verification_status", "baseline_experiment_reference", "post_deployment_experiment_reference", "recorded_at"]),
    "post_deployment": ("post_deployment_evaluation", ["deployment_id", "baseline_reference", "post_reference", "status", "results_present", "created_at"]),
}
#: The record that an envelope's report makes, and what it takes over from the envelope.
REPORT = ("research_result_export", {"audit_reference": "audit", "strategies": "strategies", "question_set_reference": "question_set", "baseline_reference": "baseline", "post_deployment_reference": "post_deployment", "report": "report", "exported_at": "received_at"})
ENVELOPE = ["contract_version", "source_profile_id", "source_profile_version", "property_id"]


def title_check(name: Column, website: Column, fetch: Column, final: Column, title: Column, description: Column) -> Column:
    """What a saved homepage's title says of a company (FN-95): VERIFIED if it holds the name, or all the name's words of three letters and more."""
    key, said = name_key(F.coalesce(name, F.lit(""))), name_key(F.coalesce(title, F.lit("")))
    words = F.filter(F.split(key, " "), lambda w: F.length(w) > 2)
    named = (key != "") & (F.contains(said, key) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(said, w))))
    text = F.lower(F.concat_ws(" ", title, description))
    return first_match(
        [
            (holds(third_party(website)), "REJECTED_THIRD_PARTY"),
            (holds(fetch == "ROBOTS_DENIED"), "ROBOTS_DENIED"),
            (holds(fetch == "BLOCKED"), "BLOCKED"),
            (~holds(fetch.isin("SUCCESS", "PARTIAL")), "FETCH_FAILED"),
            (holds(third_party(final)), "REJECTED_THIRD_PARTY"),
            (any_of(text, PARKED), "REJECTED_PARKED"),
            (named, "VERIFIED"),
        ],
        "AMBIGUOUS",
    )


def site_rows(companies: DataFrame, discoveries: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """A row a company: where it was found, what its site answered, and whether that is another domain's (FN-94).

    companies: key, website; discoveries: key, source_name, source_type, source_identifier, source_url, raw_data;
    snapshots: key, final_url, fetch_status, a row a key at most. The sources of a company are few."""
    route = F.get_json_object("raw_data", "$.source_directory_url")
    lists = {"source_names": F.coalesce("source_name", "source_type"), "source_identifiers": F.col("source_identifier"), "source_profile_urls": F.col("source_url"), "directory_routes": route}
    found = discoveries.groupBy(key).agg(*(F.collect_set(c).alias(n) for n, c in lists.items()))
    rows = companies.select(key, "website").join(found, key, "left").join(snapshots.select(key, "final_url", "fetch_status"), key, "left")
    other = ~blank(F.col("final_url")) & ~domain_key(F.col("final_url")).eqNullSafe(domain_key(F.col("website")))
    return rows.select(
        key,
        *(F.coalesce(sorted_join(F.col(n), " | "), F.lit("")).alias(n) for n in lists),
        domain_key(F.col("website")).alias("normalized_domain"),
        F.coalesce("fetch_status", F.lit("NOT_FETCHED")).alias("fetch_status"),
        holds(other).alias("redirected_to_different_domain"),
    )


def screening_error(opportunities: Column) -> Column:
    """What is wrong with a screening's array of opportunities (JSON texts), null if nothing is (FN-56)."""
    n = F.coalesce(F.size(opportunities), F.lit(0))
    return first_match(
        [
            (~n.between(1, 3), "must contain 1 to 3 opportunities"),
            (holds(F.exists(opportunities, lambda x: any_of(F.lower(x), PRECISE))), "precise claims of uplift"),
        ],
        None,
    )


def analysis_error(mode: Column, rating: Column, evidence: Column, subject: Column, body: Column) -> Column:
    """What is wrong with a one-pass analysis, null if nothing is (FN-56). evidence: an array of structs with url and excerpt."""
    return first_match(
        [
            (~holds(mode.isin(MODES)), "unsupported mode"),
            (~holds(rating.isin(RATINGS)), "unsupported rating"),
            (~holds(F.size(evidence) > 0), "no evidence"),
            (holds(F.exists(evidence, lambda e: holds(e.url == "") | holds(e.excerpt == "") | e.url.isNull() | e.excerpt.isNull())), "evidence without source or excerpt"),
            (~holds((subject != "") & (body != "")), "incomplete invitation"),
            (holds(body.rlike(PROMISE)), "unsupported guarantee"),
        ],
        None,
    )


def import_records(profiles: DataFrame, version: str) -> DataFrame:
    """profile_id, error and the record of saved profiles (FN-85).

    profiles: schema_version, profile_id, website, name, profile_type, smb, hotel (YES or true make a member), body (canonical JSON)."""
    fixture = holds(F.col("profile_type") == FIXTURE)
    member = lambda c, name: F.when(~fixture & holds(F.col(c).cast("string").isin("YES", "true")), F.lit(name))
    error = first_match([(~holds(F.col("schema_version") == version), "unexpected schema_version"), (blank(F.col("profile_id")) | blank(F.col("website")), "profile_id and website are required")], None)
    digest = F.sha2(F.coalesce("body", F.lit("")), 256)
    return profiles.select(
        "profile_id",
        error.alias("error"),
        F.when(fixture, FIXTURE).when(holds(F.col("profile_type") == HOTEL), HOTEL).otherwise(COMPANY).alias("profile_type"),
        F.coalesce("name", "profile_id").alias("official_name"),
        F.col("website").alias("official_domain"),
        F.array_compact(F.array(member("smb", "SMB_COHORT"), member("hotel", "HOTEL_COHORT"))).alias("memberships"),
        F.when(fixture, "CONTROLLED_TEST_FIXTURE").alias("exclusion_reason"),
        F.concat(F.lit("profile_import:"), F.col("profile_id"), F.lit(":"), F.substring(digest, 1, 12)).alias("record_id"),
    )


def result_records(envelopes: DataFrame, key: str, body: str, version: str) -> DataFrame:
    """key, record_type, item, error: a row for every record of a saved result envelope (FN-86).

    A section is one object or a list of them; a record has the envelope's fields where it lacks its own. A report is one
    record, with what the envelope says beside it. An envelope that can't be read, or lacks a field, is one row without a type."""
    fields = F.from_json(F.col(body), "map<string,string>")
    rows = envelopes.select(key, F.coalesce(fields, F.create_map().cast("map<string,string>")).alias("_fields"))
    field = lambda name: F.col("_fields")[name]

    def items(section: str) -> Column:
        value = field(section)
        many = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).when(value.isNotNull(), F.array(value))
        return F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda x: F.struct(F.lit(section).alias("section"), x.alias("item")))

    lacks = reduce(lambda a, b: a | b, [~F.map_contains_key("_fields", F.lit(c)) for c in ENVELOPE])
    broken = F.when(lacks, "envelope lacks fields").when(~holds(field("contract_version") == version), "unsupported contract version")
    report = F.to_json(F.struct(*(field(source).alias(name) for name, source in REPORT[1].items())))
    whole = F.when(field("report").isNotNull(), F.array(F.struct(F.lit("report").alias("section"), report.alias("item")))).otherwise(F.array().cast("array<struct<section:string,item:string>>"))
    sections = F.when(broken.isNull(), F.flatten(F.array(*map(items, SECTIONS), whole)))
    none = F.array(F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("item")))
    each = rows.select(key, "_fields", broken.alias("_broken"), F.explode(F.when(broken.isNull(), sections).otherwise(none)).alias("_record"))
    own = F.from_json("_record.item", "map<string,string>")
    has = F.array_union(F.array(*map(F.lit, ENVELOPE)), F.coalesce(F.map_keys(own), F.array().cast("array<string>")))
    has = F.when(field("received_at").isNotNull(), F.array_union(has, F.array(F.lit("created_at"), F.lit("captured_at")))).otherwise(has)
    section = F.col("_record.section")
    needs = reduce(lambda acc, s: acc.when(section == s, F.array(*map(F.lit, SECTIONS[s][1]))), SECTIONS, F.when(F.lit(False), F.array().cast("array<string>")))
    kind = reduce(lambda acc, s: acc.when(section == s, F.lit(SECTIONS[s][0])), SECTIONS, F.when(section == "report", F.lit(REPORT[0])))
    missing = F.array_join(F.array_sort(F.array_except(needs, has)), ", ")
    many = holds(F.size(F.from_json(own["strategies"], "array<string>")) > 3) & holds(section == "strategies")
    error = F.coalesce("_broken", F.when(missing != "", F.concat(F.lit("missing "), missing)).when(many, "more than three strategies"))
    return each.select(key, kind.alias("record_type"), F.col("_record.item").alias("item"), error.alias("error"))


def replayed(provenance: DataFrame, known: DataFrame) -> DataFrame:
    """source_type, processed, created, duplicates: candidates rebuilt from their saved JSON and set against what is there (SRC-08).

    provenance: source_type, raw_data with name and website; known: domain, one row each. A replay that adds nothing has created = 0 everywhere."""
    rebuilt = provenance.select("source_type", domain_key(F.get_json_object("raw_data", "$.website")).alias("_domain"))
    there = known.select(F.col("domain").alias("_known"))
    counts = rebuilt.groupBy("source_type", "_domain").agg(F.count("*").alias("n"))
    counts = counts.join(there, F.col("_domain") == F.col("_known"), "left")
    new = F.col("_known").isNull() & F.col("_domain").isNotNull()
    return counts.groupBy("source_type").agg(F.sum("n").alias("processed"), F.count_if(new).alias("created"), F.sum(F.when(new, F.col("n") - 1).otherwise(F.col("n"))).alias("duplicates"))


def open_routes(routes: DataFrame, attempts: DataFrame, key: str, order: str) -> DataFrame:
    """routes that no attempt completed, with n_failed and the error of the last one (ST-23). attempts: key, status, error, order."""
    seen = attempts.groupBy(key).agg(
        F.max(F.col("status") == "complete").alias("_done"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.max_by("error", F.when(F.col("status") == "failed", F.col(order))).alias("last_error"),
    )
    return routes.join(seen, key, "left").where(~holds(F.col("_done"))).withColumn("n_failed", F.coalesce("n_failed", F.lit(0))).drop("_done")


def quality_rows(rows: DataFrame, key: str) -> DataFrame:
    """What is still to be learned of an entity (FN-89): its size class, what its site's rating may be said of, and a list of needs.

    rows: key, status (of its site), commercial (null: unconfirmed), rating, size_class, industries."""
    status, commercial = F.col("status"), F.coalesce("commercial", F.lit("UNCONFIRMED"))
    doubtful, shut = status.isin("AMBIGUOUS_IDENTITY", "INSUFFICIENT_EVIDENCE"), status.isin("FETCH_FAILED", "ACCESS_BLOCKED")
    #: What is asked for, in this order.
    needs = [
        (doubtful, "independent first-party identity evidence (legal name, about/imprint, or Wikidata-linked identifier)"),
        (shut, "independent accessible first-party identity source; do not bypass controls"),
        (commercial == "UNCONFIRMED", "current operating/commercial-status evidence"),
        (commercial.isin("NONCOMMERCIAL_INDICATED", "ASSOCIATION_INDICATED"), "confirm whether commercial research scope includes this entity type"),
        (~holds(F.col("size_class") == "LARGE_ENTERPRISE_SUPPORTED"), "sourced employee count or other defensible size evidence"),
        (blank(F.col("industries")), "industry evidence"),
    ]
    relevance = first_match(
        [
            (~holds(status == "VERIFIED"), "UNATTRIBUTABLE_UNVERIFIED_SITE"),
            (commercial == "NONCOMMERCIAL_INDICATED", "NOT_COMMERCIAL_GEO_TARGET"),
            (holds(F.col("rating").isin("HIGH", "MEDIUM", "LOW")), F.col("rating")),
        ],
        "UNKNOWN",
    )
    return rows.select(
        key,
        commercial.alias("commercial_business_assessment"),
        relevance.alias("relevance_assessment"),
        F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in needs))), "; ").alias("additional_evidence_needed"),
    )


def pilot_rows(rows: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """A row an entity with its site, the first by domain of those that aren't profiles elsewhere, and flags of size (FN-90).

    rows: key, size_class; sites: key, url. An entity without a site of its own keeps nulls and isn't qualified."""
    own_sites = sites.select(key, "url", domain_key(F.col("url")).alias("domain")).where("domain <> ''").where(~holds(third_party(F.col("url"))))
    chosen = own_sites.groupBy(key).agg(F.min(F.struct("domain", "url")).alias("_site"), F.count_distinct("domain").alias("n_domains"))
    large = holds(F.col("size_class") == "LARGE_ENTERPRISE_SUPPORTED")
    return rows.join(chosen, key, "left").select(
        key,
        F.col("_site.url").alias("website_url"),
        F.col("_site.domain").alias("normalized_domain"),
        F.coalesce("n_domains", F.lit(0)).alias("n_domains"),
        large.alias("large_enterprise"),
        (holds(F.col("size_class").startswith("SMB"))).alias("smb_supported"),
        (F.col("_site").isNotNull() & ~large).alias("qualified"),
    )


def validation_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: candidate_total and, a column each, the counts of its values as a sorted JSON map (SNK-19). One scan; values are labels, few in number."""
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("_cell")
    counts = rows.select(named).groupBy("_cell.name", "_cell.value").agg(F.count("*").alias("n"))
    maps = {c: F.sort_array(F.collect_list(F.when(F.col("name") == c, F.struct(F.coalesce("value", F.lit("null")).alias("value"), "n")))) for c in columns}
    total = F.coalesce(F.sum(F.when(F.col("name") == columns[0], F.col("n"))), F.lit(0)).alias("candidate_total")
    return counts.agg(total, *(F.to_json(F.map_from_entries(m)).alias(c) for c, m in maps.items()))


def acquisition(objects: DataFrame, active: DataFrame) -> DataFrame:
    """One row of a source's yield (SNK-19): objects seen, without a usable site, inactive, of the active cohort, repeats of a domain, and new.

    objects: url, inactive (boolean); active: domain, one row each."""
    marked = objects.select(domain_key(F.col("url")).alias("_domain"), holds(F.col("inactive")).alias("_inactive"))
    usable = ~blank(F.col("_domain")) & ~F.col("_inactive")
    folded = marked.groupBy(F.when(usable, F.col("_domain")).alias("_domain")).agg(F.count("*").alias("n"), F.count_if("_inactive").alias("idle"))
    known = F.col("active.domain").isNotNull()
    joined = folded.join(active.select("domain").alias("active"), F.col("_domain") == F.col("active.domain"), "left")
    here, new = F.col("_domain").isNotNull(), F.col("_domain").isNotNull() & ~known
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.agg(
        total("n").alias("objects_examined"),
        total("idle").alias("inactive_objects"),
        total(F.when(~here, F.col("n") - F.col("idle"))).alias("objects_without_site"),
        total(F.when(known, F.col("n"))).alias("active_cohort_duplicates"),
        total(F.when(new, F.col("n") - 1)).alias("duplicate_domain_objects"),
        F.count_if(here).alias("distinct_domains"),
        F.count_if(new).alias("new_unique_candidates"),
    )
