"""Ways to reach a company that its pages show: addresses, people, forms and links to contact pages elsewhere (FN-62..FN-65).

Everything is read from a page's nodes (`operators.nodes`): what an address is for follows from the element it stands in
and the heading before it, not from the page at large. Pages are read once and their parts found in their own row; what
moves are the narrow rows of found parts, to drop those that agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contacts import NOT_FOR_CONTACT, channel_type
from ..functions.people import people_said, person_nearby, plausible_name
from ..functions.text import EMAIL, deobfuscated_emails, evidence_window, normal_email, role
from .nodes import HEADINGS, attribute, covering_text, first, holder, let, preceding, read_pages, said, span, within
from .views import holds

# Words of links to a contact page and of paths that aren't one; elements that hold a thing of its own, headings
# and emphasis; structured data of businesses; marks of elements whose people aren't the company's.
CONTACT_LABELS = ["contact us", "contact", "partnership", "partnerships", "collaboration", "collaborations", "business inquiries", "contact sales"]
OTHER_PATHS = ["accessibility", "privacy", "legal", "abuse", "careers", "jobs", "login", "sign-in", "subscribe", "newsletter"]
HOLDERS = ["article", "li", "section", "div", "footer"]
STRONG = [*HEADINGS, "strong", "b"]
CONTROLS = ["input", "textarea", "select", "button"]
BUSINESSES = ["Organization", "LocalBusiness", "MedicalOrganization", "Corporation", "Store"]
NOT_STAFF = ["testimonial", "customer", "partner", "sponsor", "vendor", "author", "blog", "press"]
NOT_SPEAKING = ["testimonial", "customer", "vendor", "author", "blog"]
# Fixed value: an address as supplied pages write it, sentence marks after it aside.
WRITTEN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
#: Characters: the longest text of an element that holds one address, of a context, of a title.
HOLDS, CONTEXT, TITLE = 500, 700, 100


def words_in(text: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases stands in a text as whole words."""
    return F.lower(text).rlike(r"\b(?:" + "|".join(sorted(phrases, key=len, reverse=True)) + r")\b")


def absolute(link: Column, base: Column) -> Column:
    """A link as a whole URL; what is neither whole, nor from the root, nor another scheme's stands beside the page."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    bare = F.trim(F.coalesce(link, F.lit("")))
    return (
        F.when(bare == "", base)
        .when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^([^/]*)", 1), bare))
        .when(bare.startswith("/"), F.concat(origin, bare))
        .otherwise(F.concat(folder, bare))
    )


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def titled_role(text: Column) -> Column:
    """Whether a short text names a role."""
    return holds((F.length(text) <= TITLE) & ~role(text).isin("UNKNOWN", "OTHER"))


def tagged(*tags: str):
    return lambda x: x["tag"].isin(*tags)


#: What a page may show, in one shape. kind and place: where it was found, which orders what agrees; box: the element around it
#: or the thing itself; head: the heading before it; said: what is known without the page's text.
FOUND = "struct<kind:int,place:long,email:string,box:struct<n:int,last:int,t0:int,t1:int>,head:struct<t0:int,t1:int>,said:string,target:string,name:string,types:array<string>>"
MAIL, SPELT, SHOWN, STATED, FORM, LINK = range(1, 7)


def found(kind: int, place: Column, **fields) -> Column:
    """A FOUND."""
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), place.cast("long").alias("place"), *(fields.get(n, null).alias(n) for n in ("email", "box", "head", "said", "target", "name", "types"))).cast(FOUND)


def mail_of(node: Column) -> Column:
    """The address of a link to one; null if it isn't one."""
    bare = F.split_part(F.regexp_replace(attribute(node, "href"), "^[^:]*:", ""), F.lit("?"), F.lit(1))
    return normal_email(bare)


def linked_mail() -> Column:
    """Links to addresses among a page's anchors."""
    return F.filter("anchors", lambda x: F.lower(attribute(x, "href")).startswith("mailto:") & mail_of(x).isNotNull())


def in_holder(tags: list[str], most: int | None = None):
    return lambda a: a["tag"].isin(tags) & (F.lit(True) if most is None else a["t1"] - a["t0"] <= most)


def around(mark: Column) -> Column:
    """From where to where a heading's text stands."""
    return let(mark, lambda m: F.struct(m["t0"].alias("t0"), m["t1"].alias("t1")))


def mail_found(near: int, most: int | None) -> Column:
    return F.transform(linked_mail(), lambda m: found(MAIL, m["n"], email=mail_of(m), box=holder(m, near, in_holder(HOLDERS, most), 1), head=around(preceding(m, "heads"))))


def shown_found(near: int) -> Column:
    """Addresses in a page's text, each once, where they first stand."""
    words = F.array_join(F.filter(F.split("text", " "), lambda w: w.contains("@")), " ")  # an address has no space in it
    raw = F.array_distinct(F.transform(F.regexp_extract_all(words, F.lit(EMAIL), 1), normal_email))
    placed = F.transform(F.filter(raw, lambda m: m.isNotNull()), lambda m: F.struct(m.alias("email"), (F.call_function("locate", m, F.lower("text")) - 1).alias("at")))
    stood = F.transform(placed, lambda p: F.struct(p["email"].alias("email"), covering_text(p["at"]).alias("node")))
    return F.transform(stood, lambda p, k: found(SHOWN, k, email=p["email"], box=let(p["node"], lambda x: holder(x, near, in_holder(HOLDERS), near + 1))))


def spelt_found() -> Column:
    spelt = F.transform(deobfuscated_emails(F.col("text")), normal_email)
    return F.transform(F.filter(spelt, lambda m: m.isNotNull()), lambda m, k: found(SPELT, k, email=m, said=m))


def stated_found() -> Column:
    stated = F.filter("things", lambda t: normal_email(t["email"]).isNotNull())
    return F.transform(stated, lambda t, k: found(STATED, k, email=normal_email(t["email"]), said=t["evidence"], target=t["purpose"], name=F.when(F.array_contains(t["types"], "Person"), t["name"]), types=t["types"]))


def asks(x: Column) -> Column:
    """Whether a control asks for an address or a message."""
    name = F.lower(attribute(x, "name"))
    return ((x["tag"] == "input") & ((F.lower(attribute(x, "type")) == "email") | name.contains("email"))) | ((x["tag"] == "textarea") & name.contains("message"))


def form_found() -> Column:
    asking = F.filter("nodes", lambda f: (f["tag"] == "form") & F.exists(within(f), asks))
    named = lambda x: F.concat_ws(" ", attribute(x, "name"), attribute(x, "id"), attribute(x, "placeholder"))
    fields = lambda f: F.lower(F.array_join(F.transform(F.filter(within(f), tagged(*CONTROLS)), named), " "))
    upper = F.filter("heads", tagged(*HEADINGS[:4]))
    return F.transform(asking, lambda f: found(FORM, f["n"], box=span(f["t0"], f["t1"], f["n"], f["last"]), head=around(preceding(f, upper)), said=fields(f), target=attribute(f, "action")))


def link_found() -> Column:
    away = F.filter("anchors", lambda x: attribute(x, "href").rlike("(?i)^(https?:)?//"))  # others stay on the page's host
    return F.transform(away, lambda x: found(LINK, x["n"], box=span(x["t0"], x["t1"], x["n"], x["last"]), target=attribute(x, "href")))


def parts_found(pages: DataFrame, *parts: Column) -> DataFrame:
    """page, key, url and a FOUND's fields, with the box's and the heading's text, the person named in the box whose mailbox it is, and their title.

    A page's parts are worked out in its own row; then each is a row of its own."""
    marked = pages.withColumn("heads", F.filter("nodes", tagged(*HEADINGS))).withColumn("anchors", F.filter("nodes", tagged("a")))
    rows = marked.withColumn("f", F.explode(F.concat(*parts))).select("page", "key", "url", "f.*", said(F.col("f.box")).alias("box_text"), said(F.col("f.head")).alias("heading"),
        F.when(F.col("f.kind").isin(MAIL, SHOWN), F.transform(F.filter(within(F.col("f.box")), tagged(*STRONG)), lambda x: said(x))).alias("strong"))
    mailed = F.col("kind").isin(MAIL, SHOWN)
    named = rows.withColumn("_who", person_nearby(F.when(mailed, F.substring("box_text", 1, 1200)), F.when(mailed, F.col("email"))))
    title = F.when(F.col("_who").isNotNull(), first(F.filter("strong", titled_role)))
    return named.withColumn("name", F.coalesce("name", "_who")).withColumn("title", title).drop("_who", "strong", "box", "head")


def without_known(rows: DataFrame, known: list[int]) -> DataFrame:
    """rows without shown addresses that a part of a known kind has as well."""
    others = Window.partitionBy("page", "email")
    seen = F.max(F.when(F.col("kind").isin(known), True)).over(others)
    return rows.withColumn("_seen", F.coalesce(seen, F.lit(False))).where(~((F.col("kind") == SHOWN) & F.col("_seen"))).drop("_seen")


def page_channels(pages: DataFrame, key: str, url: str, markup: str) -> DataFrame:
    """key, email, channel_type, channel_url, source_url, name, title, evidence, purpose of each page's channels (FN-65).

    Linked addresses take their kind from the nearest small element around them and the heading before it; shown ones from the
    element around their text; a person named there whose mailbox it is makes it theirs. Spelt out ones and structured data speak
    for themselves. Forms count by their fields, label and heading, links to other hosts by their label. Of rows that agree in
    address, kind and URL the last found stays. Shown addresses and forms whose kind is OTHER are left out.

    Defined results: null or empty markup has no channels; rows that repeat a key are pages of their own; a null URL leaves
    channel_url null, or relative links as they are; pages of any length are read whole."""
    rows = parts_found(read_pages(pages, key, url, markup), mail_found(6, HOLDS), spelt_found(), shown_found(4), stated_found(), form_found(), link_found())
    kind, none, no = F.col("kind"), F.lit(None).cast("string"), F.lit(False)
    own = evidence_window(F.col("box_text"), F.col("email"), CONTEXT)
    filled = lambda *names: F.concat_ws(" ", *(F.nullif(n, F.lit("")) for n in names))
    context = (
        F.when((kind == MAIL) & F.col("heading").isNotNull(), F.substring(F.concat("heading", F.lit(" | "), own), 1, CONTEXT))
        .when(kind.isin(MAIL, SHOWN), own)
        .when(kind == FORM, F.substring(filled("heading", "box_text", "said", "url"), 1, 1800))
        .when(kind == LINK, F.col("box_text"))
        .otherwise(F.col("said"))
    )
    target = F.when(kind.isin(FORM, LINK), absolute(F.col("target"), F.col("url"))).otherwise(F.col("url"))
    rows = rows.withColumn("_context", context).withColumn("channel_url", target)
    about = F.when(kind == SPELT, F.substring(F.concat_ws(" ", "said", "url"), 1, CONTEXT)).otherwise(F.col("_context"))
    said_type = channel_type(about, F.col("email"), kind == FORM)
    path = F.regexp_extract("channel_url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
    leads = words_in(F.col("box_text"), CONTACT_LABELS) & F.col("channel_url").rlike("(?i)^https?://") & ~F.lower(path).rlike("|".join(OTHER_PATHS)) & ~host(F.col("channel_url")).eqNullSafe(host(F.col("url")))
    business = F.arrays_overlap("types", F.array(*map(F.lit, BUSINESSES)))
    typed = (
        F.when(kind == LINK, F.when(holds(leads), "CONTACT_FORM").otherwise("OTHER"))
        .when((kind == STATED) & F.array_contains("types", "Person"), "NAMED_PERSON_EMAIL")
        .when((kind == STATED) & business & (said_type == "OTHER"), "GENERAL_BUSINESS_EMAIL")
        .when(kind.isin(MAIL, SHOWN) & F.col("name").isNotNull(), "NAMED_PERSON_EMAIL")
        .when((kind == FORM) & F.lower(filled("heading", "box_text", "said")).rlike(NOT_FOR_CONTACT), "OTHER")
        .otherwise(said_type)
    )
    kept = without_known(rows.withColumn("channel_type", typed), [MAIL, SPELT]).where(~(kind.isin(SHOWN, FORM, LINK) & (F.col("channel_type") == "OTHER")))
    purpose = F.when(kind == STATED, F.col("target")).otherwise(F.substring("_context", 1, 500))
    shown = {"email": F.col("email"), "channel_type": F.col("channel_type"), "channel_url": F.col("channel_url"), "source_url": F.when(kind.isin(FORM, LINK), F.col("url")), "name": F.col("name"), "title": F.col("title"), "evidence": F.substring("_context", 1, 1200), "purpose": purpose}
    last = kept.groupBy("page", "key", "email", "channel_type", "channel_url").agg(F.max_by(F.struct(*(c.alias(n) for n, c in shown.items())), F.struct("kind", "place")).alias("c"))
    return last.select(F.col("key").alias(key), "c.*")


def person_cards() -> Column:
    """n, name, title of the people whom a heading, strong text or element of class name names, with a role beside it."""
    kinds = lambda x: F.lower(attribute(x, "class"))
    named = lambda x: F.array_contains(F.split(kinds(x), r"\s+"), "name") | kinds(x).endswith("-name") | kinds(x).endswith("__name")
    box = lambda x: F.get("nodes", x["box"])
    staff = lambda x: ~F.coalesce(F.lower(F.concat_ws(" ", attribute(box(x), "id"), attribute(box(x), "class"))).rlike("|".join(NOT_STAFF)), F.lit(False))
    wanted = F.filter("nodes", lambda x: (x["tag"].isin(STRONG) | ((x["tag"] != "#text") & named(x))) & plausible_name(said(x)) & staff(x))
    beside = lambda x: F.transform(F.filter(F.array(x["before"], x["after"]), lambda i: i >= 0), lambda i: F.get("nodes", i))
    parts = lambda x: F.filter(within(box(x)), lambda y: y["tag"].isin("p", "strong", "b", "span") & (first(y["up"]) == x["box"]) & (y["n"] != x["n"]))
    marked = lambda x: kinds(x).rlike(r"(?:^|[\s_-])name(?:$|[\s_-])") & (x["box"] >= 0)
    texts = lambda x: F.concat(F.transform(beside(x), lambda y: said(y)), F.when(marked(x), F.transform(parts(x), lambda y: said(y))).otherwise(F.array().cast("array<string>")))
    cards = F.transform(wanted, lambda x: F.struct(x["n"].alias("n"), said(x).alias("name"), first(F.filter(texts(x), titled_role)).alias("title")))
    return F.filter(cards, lambda c: c["title"].isNotNull())


def spoken_text() -> tuple[Column, Column]:
    """The elements in which customers and authors speak, for the column _others; a page's text without what is said there."""
    others = F.filter("nodes", lambda x: (x["tag"] != "#text") & F.lower(attribute(x, "class")).rlike("|".join(NOT_SPEAKING)))
    texts = F.filter("nodes", lambda x: (x["tag"] == "#text") & ~F.exists("_others", lambda o: (o["n"] < x["n"]) & (x["n"] <= o["last"])))
    return others, F.when(F.size("_others") == 0, F.col("text")).otherwise(F.array_join(F.transform(texts, lambda x: said(x)), " "))


def contact_evidence(pages: DataFrame, key: str, url: str, markup: str) -> DataFrame:
    """key, name, title, email, contact_type, source_url of each page's explicit contact facts, once each (FN-64).

    Structured data first, then linked addresses (with the person whose mailbox it is, if named beside it), then addresses only
    shown, then people with a role but no address. Facts that agree in name, address and role count once; shown addresses only if
    not known yet. Defined results: as those of page_channels."""
    read = read_pages(pages, key, url, markup)
    others, spoken = spoken_text()
    cards = F.transform(person_cards(), lambda p, k: found(FORM, k, name=p["name"], said=p["title"]))
    sentences = F.array(found(LINK, F.lit(0), said=spoken))  # a page's, as one part
    rows = parts_found(read.withColumn("_others", others), stated_found(), mail_found(5, None), shown_found(4), cards, sentences)
    said_by = rows.withColumn("_people", people_said(F.when(F.col("kind") == LINK, F.col("said"))))
    rows = said_by.select("*", F.posexplode_outer("_people").alias("_k", "_p")).where((F.col("kind") != LINK) | F.col("_p").isNotNull())
    sentence, card = F.col("kind") == LINK, F.col("kind") == FORM
    facts = without_known(rows, [STATED, MAIL]).withColumn("place", F.coalesce("_k", "place"))
    facts = facts.withColumn("title", F.when(sentence, F.col("_p.title")).when(card, F.col("said")).otherwise(F.col("title")))
    facts = facts.withColumn("name", F.when(sentence, F.col("_p.name")).when(card | (F.col("kind") == MAIL), F.col("name")))
    order = F.when(F.col("kind") == STATED, 0).otherwise(F.col("kind"))
    once = facts.groupBy("page", "key", "url", F.lower("name").alias("_name"), F.col("email").alias("_email"), role(F.col("title")).alias("_role")).agg(F.min_by(F.struct("name", "title", "email"), F.struct(order, F.col("place"))).alias("c"))
    kind = F.when(F.col("c.name").isNotNull(), "PERSON").otherwise("GENERIC_BUSINESS_CONTACT")
    return once.select(F.col("key").alias(key), "c.*", kind.alias("contact_type"), F.col("url").alias("source_url"))


def supplied_contacts(pages: DataFrame, key: str, url: str, markup: str) -> DataFrame:
    """key, error, channel_type, emails, has_form, controls, evidence of supplied pages, none of which is fetched (FN-70).

    A page's visible addresses, each as it is written, in order; its first form, and whether it has controls or an action. A URL that
    isn't one of the web is an error and has nothing else. Null markup has no channel."""
    read = read_pages(pages, key, url, markup)
    fine = holds(F.lower("url").rlike("^https?://"))
    words = F.array_join(F.filter(F.split("text", " "), lambda w: w.contains("@")), " ")
    emails = F.array_sort(F.array_distinct(F.regexp_extract_all(words, F.lit(WRITTEN), 0)))
    form = first(F.filter("nodes", tagged("form")))
    controls = let(form, lambda f: f.isNotNull() & (F.exists(within(f), tagged(*CONTROLS)) | (attribute(f, "action") != "")))
    rows = read.select("key", fine.alias("_fine"), emails.alias("emails"), F.exists("nodes", tagged("form")).alias("has_form"), F.coalesce(controls, F.lit(False)).alias("controls"), F.substring("text", 1, 1000).alias("evidence"))
    mail, usable = F.size("emails") > 0, F.col("controls")
    kind = F.when(mail & usable, "EMAIL_AND_FORM").when(mail, "EMAIL_ONLY").when(usable, "FORM_ONLY").otherwise("NO_CONTACT")
    only = lambda c: F.when(F.col("_fine"), c)
    return rows.select(F.col("key").alias(key), F.when(~F.col("_fine"), "source_url must be HTTP(S)").alias("error"), only(kind).alias("channel_type"), only(F.col("emails")).alias("emails"), only(F.col("has_form")).alias("has_form"), only(usable).alias("controls"), only(F.col("evidence")).alias("evidence"))
