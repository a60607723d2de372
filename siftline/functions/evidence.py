"""Saved evidence: JSON lists, page summaries, channel rows, people and mailboxes (FN-57, FN-62, FN-75..FN-84)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contacts import local_part
from .text import first_match
from .url import blank, domain_key

CHANNELS = "array<struct<email string, name string, title string, type string, url string, source_url string, evidence string, purpose string>>"
PAGES = f"array<struct<url string, fetch_status string, http_status int, visible_text_length bigint, title string, channels {CHANNELS}>>"
# Path parts of pages that lead to a contact, and channel kinds that are business routes.
CONTACT_PATHS = "contact|partner|business|inquir|enquir"
BUSINESS_TYPES = ["GENERAL_BUSINESS_EMAIL", "SALES_MARKETING_EMAIL", "BUSINESS_DEVELOPMENT_EMAIL", "PARTNERSHIP_EMAIL", "CONTACT_FORM"]


def evidence_list(raw: Column) -> Column:
    """Texts of a JSON list, of a JSON object's values, or of a string parted by semicolons."""
    parts = F.filter(F.transform(F.split(raw, ";"), lambda x: F.trim(x)), lambda x: x != "")
    values = F.map_values(F.from_json(raw, "map<string,string>"))
    return F.when(blank(raw), F.array().cast("array<string>")).when(F.trim(raw).startswith("["), F.coalesce(F.from_json(raw, "array<string>"), parts)).when(F.trim(raw).startswith("{"), F.coalesce(values, parts)).otherwise(parts)


def json_list(values: Column) -> Column:
    """A JSON list of the distinct texts that aren't blank, in order."""
    return F.to_json(F.array_sort(F.array_distinct(F.filter(values, lambda v: ~blank(v)))))


def page_summary(pages: Column) -> Column:
    """A line on each page: status, code, title."""
    line = lambda p: F.concat_ws(" ", F.coalesce(p["fetch_status"], F.lit("UNKNOWN")), F.coalesce(p["http_status"].cast("string"), F.lit("-")), F.coalesce(p["title"], F.lit("")))
    return F.array_join(F.transform(pages, lambda p: F.rtrim(line(p))), " | ")


def first_url(body: Column) -> Column:
    return F.regexp_extract(F.coalesce(body, F.lit("")), r"(https?://[^\s<>]+)", 1)


def paragraphs(body: Column, most: int = 32) -> Column:
    """A struct of columns body_paragraph_01..: a mail merge's fields."""
    parts = F.split(F.coalesce(body, F.lit("")), "\n\n")
    return F.struct(*(F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(f"body_paragraph_{k + 1:02d}") for k in range(most)))


def display_name(name: Column) -> Column:
    """A campaign's name without test marks and doubled spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\b(?:test|demo|simulated)\b[:\-]?", ""), r"\s+", " "))


def site_names_company(name: Column, text: Column) -> Column:
    """Whether a homepage has any telling word of the name; a name without one is taken to match."""
    # Words that tell nothing.
    idle = F.array(*map(F.lit, ["america", "company", "group", "inc", "llc", "responsive", "the"]))
    words = F.array_except(F.filter(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 4), idle)
    return (F.size(words) == 0) | F.exists(words, lambda w: F.contains(F.lower(text), w))


def mailbox_agrees(name: Column, email: Column) -> Column:
    """Whether a mailbox reads like the person: first name, full name, or initial and last name at its beginning."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}' -]+", " ")), r"\s+")
    box = F.split_part(local_part(email), F.lit("+"), F.lit(1))
    first, last, joined = F.get(words, F.lit(0)), F.element_at(words, -1), F.array_join(words, "")
    dotted = F.startswith(box, F.concat(first, F.lit("."))) | F.startswith(box, F.concat(first, F.lit("_"))) | F.startswith(box, F.concat(first, F.lit("-")))
    return F.coalesce((box == first) | dotted | F.startswith(box, joined) | ((F.size(words) >= 2) & F.startswith(box, F.concat(F.substring(first, 1, 1), last))), F.lit(False))


def channel_rows(candidates: DataFrame) -> DataFrame:
    """A row for each usable channel of candidates (candidate_id, canonical_domain, evidence_json), and for each page that leads to one.

    A typed channel counts when its page, its source and its mailbox are the company's own."""
    pages = candidates.select("candidate_id", "canonical_domain", F.explode(F.from_json("evidence_json", f"pages {PAGES}")["pages"]).alias("p"))
    read = pages.where(F.col("p.fetch_status").isin("SUCCESS", "PARTIAL") & (domain_key(F.col("p.url")) == F.col("canonical_domain")))
    routes = read.where(F.lower("p.url").rlike(f"/[^?#]*(?:{CONTACT_PATHS})")).select("candidate_id", F.lit("CONTACT_PAGE").alias("channel_type"), F.lit("").alias("email"), F.col("p.url").alias("channel_url"), F.col("p.url").alias("source_url"), F.lit("").alias("evidence"))
    c = read.select("candidate_id", "canonical_domain", "p.url", F.explode("p.channels").alias("c"))
    own = lambda col: domain_key(col) == F.col("canonical_domain")
    mail = F.coalesce("c.email", F.lit(""))
    fine = F.col("c.type").isin(BUSINESS_TYPES) & own(F.coalesce("c.source_url", "url")) & F.when(mail == "", own(F.coalesce("c.url", "url"))).otherwise(own(F.split_part(mail, F.lit("@"), F.lit(-1))))
    typed = c.where(fine).select("candidate_id", F.col("c.type").alias("channel_type"), F.lower(mail).alias("email"), F.coalesce("c.url", "url").alias("channel_url"), F.coalesce("c.source_url", "url").alias("source_url"), F.substring(F.coalesce("c.evidence", F.lit("")), 1, 1200).alias("evidence"))
    return routes.unionByName(typed).dropDuplicates(["candidate_id", "channel_type", "email", "channel_url"])


def without_personal(pages: Column) -> Column:
    """Pages whose channels have no names or titles, and none but business kinds (FN-83)."""
    kept = lambda cs: F.transform(F.filter(cs, lambda c: c["type"].isin(BUSINESS_TYPES)), lambda c: c.dropFields("name", "title"))
    return F.transform(pages, lambda p: p.withField("channels", kept(p["channels"])))


def contact_status(name_ok: Column, agrees: Column, role: Column, email: Column, legal_page: Column) -> Column:
    """Whether found contact facts are taken over (FN-84)."""
    return first_match(
        [(legal_page, "REJECTED_LEGAL_PAGE"), (~name_ok & email.isNull(), "REJECTED_NO_NAME"), (email.isNotNull() & name_ok & ~agrees, "REJECTED_MAILBOX_DISAGREES"), (name_ok & role.isin("UNKNOWN", "OTHER") & email.isNull(), "REJECTED_NO_ROLE"), (email.isNull(), "NO_EMAIL")],
        "SYNTAX_VALID",
    )
