"""Hosts, domains and URLs as Column expressions (FN-03..FN-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts of third parties' profile pages, and names that no website can have.
THIRD_PARTY_HOSTS = [
    "about.me", "bbb.org", "beacons.ai", "chamberofcommerce.com", "crunchbase.com", "facebook.com", "foursquare.com", "google.com", "instagram.com", "linkedin.com", "linktr.ee",
    "mapquest.com", "medium.com", "substack.com", "threads.net", "tiktok.com", "tripadvisor.com", "twitter.com", "wikipedia.org", "x.com", "yellowpages.com", "yelp.com", "youtube.com",
]
RESERVED_SUFFIXES = ["invalid", "example", "test", "localhost"]
PLACEHOLDERS = ["", "yes", "no", "none", "unknown", "n/a"]


def blank(c: Column) -> Column:
    """Whether a string says nothing: null, empty or white space."""
    return c.isNull() | (F.trim(c) == "")


def with_scheme(url: Column) -> Column:
    u = F.trim(url)
    return F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))


def raw_host(url: Column) -> Column:
    """Lower-case host name without user, port and final dots; null if there is none."""
    host = F.regexp_extract(F.lower(with_scheme(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def domain_key(url: Column) -> Column:
    """The host without one leading www.; names beyond ASCII stay as they are (see `idna`)."""
    return F.regexp_replace(raw_host(url), r"^www\.", "")


def url_canonical(url: Column) -> Column:
    """https, canonical host, no default port, no fragment, no final slashes; the query stays."""
    full = with_scheme(url)
    port = F.regexp_extract(full, r"^[^/]*//[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    path = F.regexp_replace(F.regexp_extract(full, r"^[^/]*//[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(full, r"^[^?#]*(\?[^#]*)", 1)
    shown = F.when(port.isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(raw_host(url).isNotNull(), F.concat(F.lit("https://"), domain_key(url), shown, path, F.when(query == "?", "").otherwise(query)))


def suffixes(host: Column) -> Column:
    """A host and its parents, so that a suffix match becomes an equi-join or an array overlap (JOIN-17)."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def under_any(host: Column, domains: list[str]) -> Column:
    """Whether host is one of the domains or below one."""
    return F.coalesce(F.arrays_overlap(suffixes(host), F.array(*map(F.lit, domains))), F.lit(False))


def third_party(url: Column) -> Column:
    return under_any(domain_key(url), THIRD_PARTY_HOSTS)


def acceptable_website(url: Column) -> Column:
    """The URL if it can be a company's own website, else null."""
    host = domain_key(url)
    scheme = F.lower(F.regexp_extract(with_scheme(url), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    fine = (
        ~F.lower(F.trim(url)).isin(PLACEHOLDERS) & scheme.isin("http", "https") & host.contains(".")
        & ~F.element_at(F.split(host, r"\."), -1).isin(RESERVED_SUFFIXES) & ~third_party(url)
    )
    return F.when(fine, url)


def public_form_url(url: Column) -> Column:
    """Whether a form's URL is https on a public host, without a user name."""
    host = raw_host(url)
    private = host.rlike(r"^(?:localhost|.*\.invalid|invalid|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(?:1[6-9]|2\d|3[01])\..*)$")
    return F.coalesce(F.trim(url).startswith("https://") & ~private & ~url.rlike(r"^[^/]*//[^/?#]*@"), F.lit(False))


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """url with one more query parameter, percent-encoded (a space as %20)."""
    encoded = F.regexp_replace(F.url_encode(value), r"\+", "%20")
    return F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(name + "="), encoded)
