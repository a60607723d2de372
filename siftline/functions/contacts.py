"""Contact channels: kinds, ranks, roles, suitability (FN-26..FN-34, FN-72, PRJ-11, PRJ-19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, first_match
from .url import domain_key

# What names a channel's purpose, in the order in which it is looked for; mailboxes; weights.
PURPOSES = [
    ("RESTRICTED_EMAIL", r"\b(?:privacy|accessibility|legal|abuse|security|data protection|dpo)\b"),
    ("SUPPORT_EMAIL", r"\b(?:customer support|support|help desk|technical support)\b"),
    ("PARTNERSHIP_EMAIL", r"\b(?:partnerships?|collaborations?|research collaboration|partner with us)\b"),
    ("BUSINESS_DEVELOPMENT_EMAIL", r"\b(?:business inquiries|business development|business opportunities|business enquiries)\b"),
    ("SALES_MARKETING_EMAIL", r"\b(?:sales|marketing|press|media inquiries|media relations)\b"),
    ("GENERAL_BUSINESS_EMAIL", r"\b(?:general inquiries|general enquiries|contact us|contact information|reach us|email us)\b|/(?:contact|contact-us)(?:/|$)"),
]
NOT_FOR_CONTACT = r"newsletter|subscribe|login|sign[- ]?in|password|job application|careers|apply now|privacy|accessibility|legal"
FORM_PURPOSE = r"\b(?:partnership|collaboration|business inquiry|business enquiry|contact us|general inquiry|general enquiry)\b|/(?:contact|contact-us)(?:/|$)"
MAILBOXES = [
    ("PARTNERSHIP_EMAIL", ["partnership", "partnerships", "collaboration", "collaborations"]),
    ("BUSINESS_DEVELOPMENT_EMAIL", ["bizdev", "businessdevelopment"]),
    ("SALES_MARKETING_EMAIL", ["sales", "marketing", "press", "media"]),
    ("GENERAL_BUSINESS_EMAIL", ["info", "hello", "contact", "office", "team", "business", "founder", "founders"]),
]
RESTRICTED_MAILBOXES = ["privacy", "accessibility", "legal", "abuse", "security", "dpo"]
MAILBOX_ROLES = [
    ("FOUNDER_OWNER", ["founder", "founders", "owner", "owners"]),
    ("PARTNERSHIPS", ["partnership", "partnerships", "partners"]),
    ("MARKETING_GROWTH", ["marketing", "growth"]),
    ("BUSINESS_DEVELOPMENT", ["business", "bizdev"]),
]
SUITABLE_TYPES = ["PARTNERSHIP_EMAIL", "BUSINESS_DEVELOPMENT_EMAIL", "GENERAL_BUSINESS_EMAIL", "NAMED_PERSON_EMAIL", "SALES_MARKETING_EMAIL", "CONTACT_FORM"]
CHANNEL_RANKS = {"PARTNERSHIP_EMAIL": 100, "BUSINESS_DEVELOPMENT_EMAIL": 90, "GENERAL_BUSINESS_EMAIL": 80, "CONTACT_FORM": 70, "NAMED_PERSON_EMAIL": 60, "SALES_MARKETING_EMAIL": 50, "OTHER": 10, "SUPPORT_EMAIL": 0, "RESTRICTED_EMAIL": -10}
ROLE_WEIGHTS = {
    "startup_or_small": {"FOUNDER_OWNER": 100, "EXECUTIVE": 90, "MARKETING_GROWTH": 82, "SEO_CONTENT": 76, "PARTNERSHIPS": 72, "BUSINESS_DEVELOPMENT": 68, "DIGITAL_ECOMMERCE": 65, "COMMUNICATIONS": 62, "GENERAL_BUSINESS": 50, "OTHER": 30, "UNKNOWN": 20},
    "medium_company": {"MARKETING_GROWTH": 100, "DIGITAL_ECOMMERCE": 94, "SEO_CONTENT": 92, "PARTNERSHIPS": 86, "COMMUNICATIONS": 82, "BUSINESS_DEVELOPMENT": 78, "EXECUTIVE": 60, "FOUNDER_OWNER": 55, "GENERAL_BUSINESS": 45, "OTHER": 30, "UNKNOWN": 20},
    "local_smb": {"FOUNDER_OWNER": 100, "EXECUTIVE": 92, "MARKETING_GROWTH": 78, "GENERAL_BUSINESS": 74, "DIGITAL_ECOMMERCE": 70, "BUSINESS_DEVELOPMENT": 66, "PARTNERSHIPS": 62, "SEO_CONTENT": 58, "COMMUNICATIONS": 55, "OTHER": 30, "UNKNOWN": 20},
}
FORM_CONTROLS = ["submit", "textarea", "form-submit", "your-message", "message"]
CONFIRMED_CONTROLS = ["<form", "textarea", "submit", "form-submit", "form id", "button", "input", "your-message"]


def lookup(values: dict[str, int], key: Column, default: int) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def local_part(email: Column) -> Column:
    return F.lower(F.split_part(F.coalesce(email, F.lit("")), F.lit("@"), F.lit(1)))


def channel_type(context: Column, email: Column, is_form: Column) -> Column:
    """The kind of a channel, from the text around it and its mailbox; a general mailbox never says partnership."""
    said, box = F.lower(F.coalesce(context, F.lit(""))), local_part(email)
    return first_match(
        [
            (box.isin(RESTRICTED_MAILBOXES), "RESTRICTED_EMAIL"),
            (is_form & said.rlike(NOT_FOR_CONTACT), "OTHER"),
            (is_form & said.rlike(FORM_PURPOSE), "CONTACT_FORM"),
            (is_form, "OTHER"),
            *((said.rlike(pattern), name) for name, pattern in PURPOSES),
            *((box.isin(boxes), name) for name, boxes in MAILBOXES),
        ],
        "OTHER",
    )


def mailbox_role(email: Column) -> Column:
    return first_match([(local_part(email).isin(boxes), name) for name, boxes in MAILBOX_ROLES], "UNKNOWN")


def company_context(sources: Column, size: Column) -> Column:
    return first_match([(F.lower(sources).contains("growthzone"), "local_smb"), (size.isin("MEDIUM", "LARGE"), "medium_company")], "startup_or_small")


def contact_rank(context: Column, role: Column, has_email: Column, generic: Column) -> Column:
    weight = first_match([(context == name, lookup(weights, role, 20)) for name, weights in ROLE_WEIGHTS.items()], 20)
    return F.greatest(F.lit(0), weight + F.when(has_email, 8).otherwise(0) - F.when(generic, 25).otherwise(0))


def channel_rank(kind: Column, purpose: Column) -> Column:
    said, form = F.lower(F.coalesce(purpose, F.lit(""))), kind == "CONTACT_FORM"
    return first_match(
        [
            (form & said.rlike("partnership|collaboration"), 105),
            (form & said.rlike("business inquiries|business enquiries|business development"), 95),
            (form & said.rlike("sales|marketing"), 50),
        ],
        lookup(CHANNEL_RANKS, kind, 0),
    )


def first_party(kind: Column, email: Column, channel_url: Column, source_url: Column, domain: Column, review: Column) -> Column:
    """Whether a channel is of a suitable kind, not rejected, and its evidence and its address are the company's own (PRJ-11)."""
    own = F.when(kind == "CONTACT_FORM", domain_key(channel_url) == domain).otherwise(domain_key(F.split_part(email, F.lit("@"), F.lit(2))) == domain)
    seen = domain_key(F.coalesce(source_url, channel_url)) == domain
    return F.coalesce(kind.isin(SUITABLE_TYPES) & (F.coalesce(review, F.lit("")) != "REJECTED") & seen & own, F.lit(False))


def audit_class(kind: Column, email: Column, channel_url: Column, evidence_url: Column, evidence: Column, domain: Column) -> Column:
    """What an audit calls a channel: (class, first_party)."""
    own = F.coalesce((domain != "") & (domain_key(evidence_url) == domain) & (domain_key(channel_url) == domain), F.lit(False))
    mail = kind.isin("GENERAL_BUSINESS_EMAIL", "SALES_MARKETING_EMAIL", "BUSINESS_DEVELOPMENT_EMAIL", "PARTNERSHIP_EMAIL")
    same_host = F.coalesce(domain_key(F.split_part(email, F.lit("@"), F.lit(-1))) == domain, F.lit(False))
    named = evidence.rlike(r"\b(?:[A-Z][a-z]+\s+[A-Z][a-z]+|Dr\.?\s+[A-Z][a-z]+)\b") & local_part(email).rlike("^[a-z]+[._-][a-z]+$")
    controls = any_of(F.lower(F.coalesce(evidence, F.lit(""))), FORM_CONTROLS)
    made = lambda name, flag: F.struct(F.lit(name).alias("class"), F.lit(flag).alias("first_party"))
    return first_match(
        [
            (mail & own & same_host & F.coalesce(named, F.lit(False)), made("NAMED_INDIVIDUAL_BUSINESS_CONTACT", True)),
            (mail & own & same_host, made("PUBLIC_BUSINESS_EMAIL", True)),
            ((kind == "CONTACT_FORM") & own & controls, made("OFFICIAL_CONTACT_FORM", True)),
            (kind.isin("CONTACT_FORM", "CONTACT_PAGE") & own, made("OFFICIAL_CONTACT_PAGE_NO_CONFIRMED_METHOD", True)),
        ],
        made("INVALID_AMBIGUOUS_OR_UNSUPPORTED", False),
    )


def suitable_mailbox(email: Column, banned: list[str]) -> Column:
    box = F.trim(local_part(email))
    return F.coalesce(email.contains("@") & (box != "") & ~box.isin(banned or [""]) & ~box.rlike("^no-?reply"), F.lit(False))


def confirmed_form(evidence: Column) -> Column:
    return any_of(F.lower(F.coalesce(evidence, F.lit(""))), CONFIRMED_CONTROLS)


def form_fields(evidence: Column) -> Column:
    """field -> whether it shows in a form's evidence (FN-71)."""
    said = F.lower(F.coalesce(evidence, F.lit("")))
    # What names a field.
    fields = {"name": r"\bname\b|first_name|full_name", "email": r"\bemail\b", "phone": r"\bphone\b|telephone", "company": r"\bcompany\b|organization", "subject": r"\bsubject\b", "message": r"\bmessage\b|comments?|how can we help", "captcha": "captcha", "consent": "consent|privacy policy|terms and conditions|i agree"}
    return F.create_map(*(x for name, pattern in fields.items() for x in (F.lit(name), said.rlike(pattern))))
