"""Directory cards: repeated blocks of a listing page, one record each (SRC-07).

A card is an element of a card's class or an item of structured markup, or one of at least `repeated` sibling elements
whose subtrees have the same path signature: the tags on the way from the block to each element below it, at most `depth`
levels. Blocks without a class are found so, wherever a listing repeats its shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .channels import absolute, host
from .nodes import HEADINGS, attribute, first, let, read_pages, said, within
from .views import holds

# Classes of cards, of their titles and of their categories; item types of companies; labels of website links.
CARD_CLASSES = ["gz-list-card", "gz-directory-card"]
TITLE_CLASS, CATEGORY_CLASSES = "gz-card-title", ["gz-card-cat", "gz-card-category"]
ITEM_TYPES = ["Organization", "LocalBusiness"]
WEBSITE_LABELS = ["visit website", "website"]


def has_class(node: Column, *names: str) -> Column:
    return F.arrays_overlap(F.split(attribute(node, "class"), r"\s+"), F.array(*map(F.lit, names)))


def shape(x: Column, depth: int) -> Column:
    """A hash of an element's tag and of the tag paths below it, down to `depth` levels; null if no element is inside."""
    far = lambda y: F.array_position(F.slice(y["up"], 1, depth), x["n"]).cast("int")
    below = F.filter(within(x), lambda y: (y["tag"] != "#text") & (far(y) > 0))
    paths = F.array_sort(F.array_distinct(F.transform(below, lambda y: F.struct(far(y).alias("far"), y["tag"].alias("tag")))))
    return let(paths, lambda p: F.when(F.size(p) > 0, F.xxhash64(x["tag"], p)))


def repeated(pages: DataFrame, payload, least: int = 3, depth: int = 2) -> DataFrame:
    """page, key, n, payload of the elements that have at least least - 1 siblings of their own shape.

    payload: what is wanted of an element, from its node; it is narrow, for these rows move."""
    shaped = F.filter(
        F.transform("nodes", lambda x: F.struct(x["n"].alias("n"), F.coalesce(first(x["up"]), F.lit(-1)).alias("parent"), F.when((x["tag"] != "#text") & (x["last"] > x["n"]), shape(x, depth)).alias("signature"), payload(x).alias("payload"))),
        lambda s: s["signature"].isNotNull(),
    )
    rows = pages.select("page", "key", F.inline(shaped))
    alike = F.count("*").over(Window.partitionBy("page", "parent", "signature"))
    return rows.withColumn("_alike", alike).where(F.col("_alike") >= least).select("page", "key", "n", "payload")


def is_card(x: Column) -> Column:
    """Whether an element says that it is a card."""
    item = F.element_at(x["attrs"], "itemscope").isNotNull() & attribute(x, "itemtype").rlike("|".join(ITEM_TYPES))
    return (x["tag"] != "#text") & (has_class(x, *CARD_CLASSES) | item)


def first_text(parts: Column | str, fits) -> Column:
    """The text of the first of a card's parts that fits; null if none does."""
    return said(first(F.filter(parts, fits)))


def directory_cards(pages: DataFrame, key: str, url: str, markup: str, own_host: str = "", shapes: bool = False) -> DataFrame:
    """key, company_name, website, location, category, source_url, identifier of each card of each listing page.

    A card needs a name and a link to a website on another host than own_host's; others are left out. The detail link names the
    record: its URL, and as identifier what stands behind its last hyphen; without one the page's URL does. shapes: also take
    repeated blocks without a mark, whose name is then the text of their first heading, strong text or link; pages are read twice
    then, once for the shapes.

    A card's parts are one slice of its page's nodes. Defined results: null markup has no cards; nested cards are records of their
    own; a page may repeat a card; a card without category or place has null there."""
    prop = lambda x: F.lower(attribute(x, "itemprop"))
    has_prop = lambda p: lambda x: prop(x) == p
    linked = lambda x: (x["tag"] == "a") & F.element_at(x["attrs"], "href").isNotNull()
    read = read_pages(pages, key, url, markup)
    chosen = F.filter("nodes", is_card)
    if shapes:
        alike = repeated(read, lambda x: F.lit(None)).groupBy("page").agg(F.collect_set("n").alias("shaped"))
        read = read.join(alike, "page", "left")
        chosen = F.filter("nodes", lambda x: is_card(x) | F.coalesce(F.array_contains("shaped", x["n"]), F.lit(False)))
    cards = read.select("key", "url", "text", "nodes", F.explode(chosen).alias("card")).withColumn("parts", within(F.col("card")))
    name = first_text("parts", lambda x: prop(x) == "name")
    if shapes:
        name = F.coalesce(name, first_text("parts", tagged_as(*HEADINGS, "strong", "b", "a")))
    # The website's link holds a mark that says so, or is labelled so.
    marks = F.filter("parts", lambda x: prop(x) == "sameas")
    above = F.filter(F.transform(marks, lambda x: F.get("nodes", first(x["up"]))), lambda x: linked(x) & (x["n"] > F.col("card.n")))
    labelled = F.filter("parts", lambda x: linked(x) & F.lower(said(x)).isin(WEBSITE_LABELS))
    site = attribute(first(F.concat(above, labelled)), "href")
    titled = F.flatten(F.transform(F.filter("parts", lambda x: has_class(x, TITLE_CLASS)), lambda t: F.filter(within(t), linked)))
    details = F.concat(titled, F.filter("parts", lambda x: linked(x) & (prop(x) == "url")))
    place = F.array_compact(F.array(*(F.nullif(first_text("parts", has_prop(p)), F.lit("")) for p in ("addresslocality", "addressregion"))))
    rows = cards.select(
        "key", "url", name.alias("company_name"), F.when(F.size(F.concat(above, labelled)) > 0, site).alias("site"), F.nullif(F.array_join(place, ", "), F.lit("")).alias("location"),
        first_text("parts", lambda x: has_class(x, *CATEGORY_CLASSES) | (prop(x) == "category")).alias("category"), first(F.array_sort(F.transform(details, lambda x: F.struct(x["n"].alias("n"), attribute(x, "href").alias("href")))))["href"].alias("detail"),
    )
    whole = absolute(F.col("site"), F.col("url"))
    detail = F.when(F.col("detail").isNull(), F.col("url")).otherwise(absolute(F.col("detail"), F.col("url")))
    identifier = F.element_at(F.split(F.regexp_replace(detail, "/+$", ""), "-"), -1)
    fine = holds(F.col("company_name").isNotNull() & F.col("site").isNotNull() & whole.rlike("^https?://")) & (F.lit(own_host == "") | ~F.lower(host(whole)).contains(own_host.lower()))
    return rows.where(fine).select(F.col("key").alias(key), "company_name", whole.alias("website"), "location", "category", detail.alias("source_url"), identifier.alias("identifier"))


def tagged_as(*tags: str):
    return lambda x: x["tag"].isin(*tags)
