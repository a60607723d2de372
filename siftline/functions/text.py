"""Names, e-mail addresses, keys and cells as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import blank

# Legal forms that end a company's name; roles in the order in which they are looked for.
LEGAL_SUFFIXES = ["inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "company", "co"]
ROLES = [
    ("FOUNDER_OWNER", ["founder", "co-founder", "cofounder", "owner", "proprietor"]),
    ("MARKETING_GROWTH", ["marketing", "growth", "demand generation", "brand"]),
    ("SEO_CONTENT", ["seo", "content", "editorial"]),
    ("PARTNERSHIPS", ["partnership", "alliances"]),
    ("BUSINESS_DEVELOPMENT", ["business development", "biz dev"]),
    ("DIGITAL_ECOMMERCE", ["digital", "ecommerce", "e-commerce"]),
    ("COMMUNICATIONS", ["communications", "public relations", "media relations"]),
    ("EXECUTIVE", ["chief executive", "ceo", "president", "managing director", "general manager", "principal"]),
    ("GENERAL_BUSINESS", ["manager", "director", "business", "office"]),
]
REPLIES = [
    ("UNSUBSCRIBE", ["unsubscribe", "remove me", "do not contact"]),
    ("DECLINE", ["no thanks", "decline", "not interested"]),
    ("EXPLICIT_CONSENT", ["consent", "yes, interested", "happy to participate"]),
    ("QUESTION", ["?", "what does", "how does", "question"]),
    ("POSITIVE_INTEREST", ["interested", "tell me more", "sounds good"]),
]
EMAIL = r"(?<![\w.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})(?![\w.-])"


def first_match(rules: list[tuple[Column, object]], otherwise) -> Column:
    """The value of the first rule that holds: every ordered rule list is one CASE WHEN."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(v)
    chain = reduce(lambda acc, r: acc.when(r[0], lift(r[1])), rules[1:], F.when(rules[0][0], lift(rules[0][1])))
    return chain.otherwise(lift(otherwise))


def any_of(c: Column, tokens: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in tokens])


def plain_key(name: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def name_key(name: Column) -> Column:
    """plain_key without the legal forms at its end; a name of nothing but those has an empty key."""
    return F.regexp_replace(plain_key(name), rf"(?:^| )(?:{'|'.join(LEGAL_SUFFIXES)})(?: (?:{'|'.join(LEGAL_SUFFIXES)}))*$", "")


def emails(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(EMAIL), 1), F.lower)


def normal_email(value: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.trim(value), r"""^[.,;:<>\[\]()"']+|[.,;:<>\[\]()"']+$""", ""))
    return F.when(bare.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), bare)


def valid_recipient(value: Column) -> Column:
    bare = F.lower(F.trim(value))
    return F.coalesce(bare.rlike(r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$") & (F.length(bare) <= 320), F.lit(False))


def spelt(word: str, entity: str) -> str:
    """A pattern of the ways in which a sign is spelt out: its word in brackets, its entity, or the word alone."""
    marked = "|".join(rf"\Q{x}\E" for x in (f"[{word}]", f"({word})", entity))
    return rf"\s*(?:{marked}|\b{word}\b)\s*"


def deobfuscated_emails(text: Column) -> Column:
    """Addresses written as name [at] host [dot] tld."""
    # The words and entities of @ and of the last dot.
    pattern = r"(?i)\b([\w.%+-]+)" + spelt("at", "&#64;") + r"([a-z0-9.-]+)" + spelt("dot", "&#46;") + r"([a-z]{2,})\b"
    whole = F.when(F.lower(text).contains("dot") | text.contains("&#46;"), F.regexp_extract_all(text, F.lit(pattern), 0)).when(text.isNotNull(), F.array().cast("array<string>"))
    part = lambda m, i: F.regexp_extract(m, pattern, i)
    return F.transform(whole, lambda m: F.lower(F.concat(part(m, 1), F.lit("@"), part(m, 2), F.lit("."), part(m, 3))))


def role(title: Column) -> Column:
    folded = F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(title, F.lit("")), F.lit("&"), F.lit(" and "))), r"\s+", " "))
    rules = [(folded.rlike("(?<![a-z])(?:" + "|".join(terms) + ")(?![a-z])"), name) for name, terms in ROLES]
    return first_match([*rules, (folded != "", "OTHER")], "UNKNOWN")


def reply_class(text: Column) -> Column:
    """What a reply says, by ordered phrases; a question mark decides before friendly words do."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_match([(any_of(low, phrases), name) for name, phrases in REPLIES], "UNCLEAR")


def formula_safe(cell: Column) -> Column:
    """A cell that a spreadsheet won't run: a quote goes before =, +, - and @, also after spaces; empty cells stay empty."""
    return F.when(cell.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def safe_component(value: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.lower(value), "[^a-z0-9._-]+", "-"), 1, most)


def sorted_join(values: Column, sep: str) -> Column:
    """Distinct values that aren't blank, in order, in one string; values: an array."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(values, lambda x: ~blank(x)))), sep)


def stable_id(prefix: str, c: Column, length: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, length))


def idempotency_key(*parts: Column) -> Column:
    """SHA-256 of the trimmed lower-case parts, NUL between them; null counts as empty."""
    return F.sha2(F.concat_ws("\0", *(F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts)), 256)


def channel_key(candidate: Column, kind: Column, email: Column, url: Column) -> Column:
    who = F.coalesce(F.nullif(F.lower(F.trim(email)), F.lit("")), F.lower(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")))
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(candidate.cast("string"), F.lit("")), F.coalesce(kind, F.lit("")), who), 256), 1, 24)


def evidence_window(text: Column, target: Column, most: int = 700) -> Column:
    """Up to `most` characters around the first place where target stands; the text's beginning if it doesn't."""
    at = F.call_function("locate", target, text)
    return F.substring(text, F.greatest(F.lit(1), at - most // 2), F.lit(most))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """template with {name} replaced; null if a name is left without a value."""
    out = reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit("{" + kv[0] + "}"))), values.items(), template)
    return F.when(~out.rlike(r"\{[a-z_]+\}"), out)
