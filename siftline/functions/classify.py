"""Classifications by ordered rules: each is a CASE WHEN that Catalyst keeps inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of, first_match, plain_key
from .url import blank

# Words that name an industry, in the order in which they are looked for.
INDUSTRY_WORDS = [
    (["software", "saas", "technology"], "SaaS / Software"),
    (["retail", "shopping"], "Retail"),
    (["ecommerce", "e-commerce"], "E-commerce"),
    (["health", "medical", "hospital"], "Healthcare"),
    (["education", "school"], "Education"),
    (["finance", "bank", "insurance"], "Finance"),
    (["real estate", "construction"], "Real Estate"),
    (["travel", "hotel"], "Travel / Hospitality"),
    (["restaurant", "food"], "Food / Restaurant"),
    (["professional", "consult"], "Professional Services"),
    (["consumer", "service"], "Consumer Services"),
]
BRANDS = ["state farm", "goodwill", "the ups store", "wild birds unlimited", "habitat for humanity", "century 21", "berkshire hathaway", "verizon", "re max", "minuteman press", "key food", "coldwell banker", "barnes noble", "sport clips", "aldi", "ace hardware"]
HOSTED_PLATFORMS = ["square.site", "lodgify.com", "wixsite.com", "wix.com", "wordpress.com", "myshopify.com", "weebly.com", "squarespace.com", "business.site", "godaddysites.com"]
SECTOR_TAGS = [
    (["tourism=hotel", "amenity=hotel", "tourism=guest_house", "tourism=motel"], "Travel and lodging"),
    (["amenity=restaurant", "amenity=cafe", "amenity=fast_food", "amenity=bar", "amenity=pub", "craft=brewery", "shop=bakery"], "Food and beverage"),
    (["amenity=dentist", "amenity=doctors", "amenity=clinic", "amenity=hospital", "healthcare="], "Healthcare"),
    (["office=lawyer", "office=accountant", "office=estate_agent", "office=insurance", "office=company"], "Professional and business services"),
    (["shop="], "Retail"),
    (["office=educational", "amenity=school", "amenity=college"], "Education"),
    (["tourism="], "Arts, culture, and tourism"),
    (["craft="], "Manufacturing and trades"),
]
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
US_TERMS = ["united states", "usa", "u.s.", "u.s.a."]
US_CITIES = ["albany", "allentown", "anaheim", "atlanta", "austin", "boston", "brooklyn", "buffalo", "cambridge", "dallas", "el paso", "fort worth", "fresno", "harrisburg", "houston", "irving", "lancaster", "los angeles", "new york", "new york city", "philadelphia", "pittsburgh", "portland", "rochester", "sacramento", "san antonio", "san diego", "san francisco", "savannah", "state college", "syracuse"]
OTHER_COUNTRIES = ["argentina", "australia", "austria", "belgium", "brazil", "canada", "chile", "china", "colombia", "costa rica", "croatia", "denmark", "finland", "france", "germany", "hong kong", "india", "indonesia", "ireland", "israel", "italy", "japan", "jordan", "kenya", "lithuania", "malaysia", "mexico", "netherlands", "new zealand", "nigeria", "norway", "pakistan", "poland", "portugal", "romania", "singapore", "slovenia", "south africa", "south korea", "spain", "sweden", "switzerland", "taiwan", "thailand", "turkey", "united arab emirates", "united kingdom", "vietnam"]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def industry(value: Column) -> Column:
    low = F.lower(value)
    return first_match([(blank(value), "Unknown"), *((any_of(low, words), name) for words, name in INDUSTRY_WORDS)], "Other")


def size_bucket(n: Column) -> Column:
    return first_match([(n.isNull(), "UNKNOWN"), (n <= 10, "MICRO"), (n <= 50, "SMALL"), (n <= 250, "MEDIUM")], "LARGE")


def size_evidence(value: Column, category: Column, source: Column) -> Column:
    """Whether a reported size supports a small business; no evidence is no answer."""
    n, stored = value.try_cast("long"), F.upper(F.coalesce(category, F.lit("UNKNOWN")))
    return first_match(
        [
            (blank(value) | (value == "0") | blank(source) | (F.lower(source) == "unknown"), "SIZE_UNKNOWN"),
            (n.isNull(), "CONFLICTING_EVIDENCE"),
            (n <= 0, "SIZE_UNKNOWN"),
            (stored != size_bucket(n), "CONFLICTING_EVIDENCE"),
            (stored == "LARGE", "LARGE_ENTERPRISE_SUPPORTED"),
        ],
        "SMB_SUPPORTED",
    )


def category_group(tag: Column) -> Column:
    """(group, fit) of a key=value tag."""
    key, value = F.split_part(tag, F.lit("="), F.lit(1)), F.lower(F.split_part(tag, F.lit("="), F.lit(2)))
    pair = lambda group, fit: F.struct(F.lit(group).alias("category"), F.lit(fit).alias("fit"))
    institution = pair("education_and_institutions", "UNCERTAIN")
    return first_match(
        [
            (key == "shop", pair("consumer_retail", "LIKELY_FIT")),
            (key == "craft", pair("craft_and_local_services", "LIKELY_FIT")),
            ((key == "office") & (value == "educational_institution"), institution),
            (key == "office", pair("business_and_professional_services", "LIKELY_FIT")),
            ((key == "amenity") & value.isin("college", "university", "hospital"), institution),
            (key == "amenity", pair("consumer_and_local_services", "LIKELY_FIT")),
            ((key == "tourism") & value.isin("museum", "attraction"), pair("culture_and_attractions", "UNCERTAIN")),
            (key == "tourism", pair("hospitality_and_travel", "LIKELY_FIT")),
        ],
        pair("unknown", "UNCERTAIN"),
    )


def chain_concern(name: Column, provenance: Column, same_name: Column) -> Column:
    return first_match([(any_of(plain_key(name), BRANDS), "LIKELY_CHAIN_OR_FRANCHISE"), (same_name > 1, "REPEATED_NAME_REVIEW"), (provenance > 1, "MULTI_LOCATION_SOURCE_RECORDS")], "NO_STRUCTURED_SIGNAL")


def domain_concern(domain: Column) -> Column:
    d = F.lower(text(domain))
    hosted = d.rlike("[.](?:" + "|".join(p.replace(".", "[.]") for p in HOSTED_PLATFORMS) + ")$")
    return first_match([(d.contains("xn--"), "PUNYCODE_DOMAIN_REVIEW"), (hosted, "HOSTED_PLATFORM_DOMAIN_REVIEW"), (F.length(d) > 40, "LONG_DOMAIN_REVIEW")], "NO_OBVIOUS_PATTERN")


def triage(name: Column, tag: Column, domain: Column, verification: Column, eligibility: Column, provenance: Column, same_name: Column) -> Column:
    """(status, score, category, chain, domain_concern): a cheap order of work, not a verdict."""
    d, group = F.lower(text(domain)), category_group(tag)
    status = first_match(
        [((d == "") | d.rlike("[.](?:invalid|example|test|localhost)$"), "LIKELY_IRRELEVANT"), (d.rlike("[.](?:gov|mil|edu)$"), "UNCERTAIN")], group["fit"]
    )
    chain = chain_concern(name, provenance, same_name)
    points = (
        first_match([(status == "LIKELY_FIT", 50), (status == "UNCERTAIN", 25)], 0)
        + F.when(verification == "VERIFIED", 30).otherwise(0)
        + F.when(eligibility == "ELIGIBLE", 10).otherwise(0)
        - first_match([(chain == "LIKELY_CHAIN_OR_FRANCHISE", 8), (chain == "MULTI_LOCATION_SOURCE_RECORDS", 3)], 0)
    )
    return F.struct(status.alias("status"), F.greatest(F.lit(0), points).alias("score"), group["category"].alias("category"), chain.alias("chain"), domain_concern(domain).alias("domain_concern"))


def sector(tags: Column) -> Column:
    low = F.lower(text(tags))
    return first_match([(low == "", "Unknown"), *((any_of(low, words), name) for words, name in SECTOR_TAGS)], "Other / source category retained")


def is_hotel(tags: Column) -> Column:
    return F.exists(F.split(F.lower(text(tags)), r"\|"), lambda t: F.trim(t).isin("tourism=hotel", "amenity=hotel"))


def whole_words(terms: list[str]) -> str:
    return "(?<![a-z])(?:" + "|".join(t.replace(".", "[.]") for t in terms) + ")(?![a-z])"


def geography(location: Column, address: Column, source: Column) -> Column:
    """VERIFIED_US, VERIFIED_NON_US, COUNTRY_CONFLICT or COUNTRY_UNKNOWN; a US extract of physical places comes first."""
    loc, both, src = F.lower(F.trim(text(location))), F.lower(F.concat_ws(" ", F.trim(text(location)), F.trim(text(address)))), F.lower(text(source))
    parts = F.transform(F.split(F.concat_ws(",", text(location), text(address)), "[,;/|]"), lambda p: F.replace(F.upper(F.trim(p)), F.lit("."), F.lit("")))
    state = F.arrays_overlap(parts, F.array(*map(F.lit, STATES)))
    abroad, home = loc.rlike(whole_words(OTHER_COUNTRIES)), state | both.rlike(whole_words(US_TERMS))
    extract = src.contains("geofabrik") & any_of(src, ["us", "california", "texas", "georgia"])
    city = F.trim(F.split_part(loc, F.lit(","), F.lit(1))).isin(US_CITIES)
    return first_match([(extract, "VERIFIED_US"), (abroad & home, "COUNTRY_CONFLICT"), (abroad, "VERIFIED_NON_US"), (home | city, "VERIFIED_US")], "COUNTRY_UNKNOWN")


def failure(status: Column, fetch_status: Column, http: Column, reason: Column) -> Column:
    """The category of a failed inspection; a denied or failed fetch is never an identity mismatch."""
    said = F.lower(F.concat_ws(" ", text(reason), text(fetch_status)))
    code = F.coalesce(http.cast("string"), F.nullif(F.regexp_extract(said, r"\bhttp\s+(\d{3})\b", 1), F.lit("")))
    return first_match(
        [
            (status == "AMBIGUOUS_IDENTITY", "IDENTITY_AMBIGUOUS"),
            (status == "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_IDENTITY_EVIDENCE"),
            (said.contains("redirect"), "REDIRECT_ISSUE"),
            (status == "REJECTED_MISMATCH", "IDENTITY_MISMATCH_OR_PARKED"),
            ((status == "ROBOTS_DENIED") | any_of(said, ["robots.txt", "robots denied"]), "ROBOTS_DENIED"),
            (any_of(said, ["captcha", "bot protection", "challenge page"]), "BOT_PROTECTION_EXPLICIT"),
            (http == 403, "HTTP_403_ACCESS_DENIED_UNSPECIFIED"),
            (http == 429, "HTTP_429_RATE_LIMITED"),
            (http == 401, "HTTP_401_AUTH_REQUIRED"),
            (status == "ACCESS_BLOCKED", "ACCESS_RESTRICTION_UNSPECIFIED"),
            (any_of(said, ["timed out", "timeout"]), "TIMEOUT"),
            (any_of(said, ["ssl", "certificate", "tls", "handshake", "eof occurred in violation"]), "TLS_ERROR"),
            (any_of(said, ["nodename", "name or service not known", "temporary failure in name", "dns"]), "DNS_FAILURE"),
            (code.isNotNull(), F.concat(F.lit("HTTP_"), code)),
            (any_of(said, ["connection reset", "connection refused", "temporarily unavailable"]), "TRANSIENT_CONNECTION"),
            (any_of(said, ["size limit", "exceeded configured size"]), "RESPONSE_TOO_LARGE"),
            (said.contains("invalid domain"), "INVALID_DOMAIN"),
            (said.contains("invalid website url"), "INVALID_SOURCE_URL"),
            (said.contains("non-html content type"), "NON_HTML_CONTENT"),
        ],
        "OTHER_FETCH_FAILURE",
    )


def channel_class(has_email: Column, has_form: Column) -> Column:
    return first_match([(has_email & has_form, "EMAIL_AND_FORM"), (has_email, "EMAIL_ONLY"), (has_form, "FORM_ONLY")], "NO_CONTACT")
