"""Channels, people and evidence of pages: by element, links made whole, nothing lost on odd markup."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import dom, people
from siftline.operators import cards, channels, nodes

BASE = "https://a.com/about/us.html?x=1"
LINKS = [
    (None, BASE, BASE),
    ("", BASE, BASE),
    ("/send", BASE, "https://a.com/send"),
    ("send", BASE, "https://a.com/about/send"),
    ("send", "https://a.com", "https://a.com/send"),
    ("//b.com/x", BASE, "https://b.com/x"),
    ("http://b.com", BASE, "http://b.com"),
    ("javascript:void(0)", BASE, "javascript:void(0)"),
]


def test_absolute(spark):
    rows = spark.createDataFrame(LINKS, "link string, base string, want string")
    assert [r.got == r.want or (r.link, r.got) for r in rows.select("*", channels.absolute(F.col("link"), F.col("base")).alias("got")).collect()] == [True] * len(LINKS)


def test_page_channels(spark):
    pages = [
        (1, BASE, "<p>Partnerships: <a href='mailto:ann@a.com'>Ann</a></p>" + "<p>x</p>" * 400 + "<p>legal@a.com</p>"),
        (2, BASE, '<script type="application/ld+json">{"@type": "Store", "email": "mailto:office@a.com"}</script><form><input name=email><label>Contact us</label></form>'),
        (3, "https://a.com/contact/", "<form action=go><textarea name=message></form><form action=in><input type=email><input type=password></form>"),
        (4, BASE, "<a href='https://b.com/reach'><b>Contact</b> Sales</a><a href='https://b.com/careers'>Contact</a><a href='https://a.com/c'>Contact</a><a href='mailto:x'>Contact</a><a>Contact"),
        (5, None, "<form action='/x'><input name=email placeholder='contact us'>"),
        (6, BASE, None),
        (7, BASE, ""),
        (8, BASE, "<p>joe@mail.org <a href='https://b.com/d'>contact" * 2),
    ]
    got = channels.page_channels(spark.createDataFrame(pages, "id int, url string, html string"), "id", "url", "html").collect()
    assert sorted((r.id, r.email or "", r.channel_type, r.channel_url or "") for r in got) == [
        (1, "ann@a.com", "PARTNERSHIP_EMAIL", BASE),
        (1, "legal@a.com", "RESTRICTED_EMAIL", BASE),
        (2, "", "CONTACT_FORM", BASE),  # its label says contact us
        (2, "office@a.com", "GENERAL_BUSINESS_EMAIL", BASE),
        (3, "", "CONTACT_FORM", "https://a.com/contact/go"),
        (3, "", "CONTACT_FORM", "https://a.com/contact/in"),  # by the page's path; a field's type isn't part of what is said
        (4, "", "CONTACT_FORM", "https://b.com/reach"),
        (5, "", "CONTACT_FORM", ""),
        (8, "", "CONTACT_FORM", "https://b.com/d"),
    ]
    assert channels.page_channels(spark.createDataFrame([], "id int, url string, html string"), "id", "url", "html").collect() == []


# the node relation


@given(st.lists(st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<li class=x>", "</li>", "<br>", "<b>", "</b>", "a", " b c ", "<!-- x -->", "<script>no</script>", "&amp;", "<i/>"]), max_size=40))
@settings(max_examples=200, deadline=None)
def test_nodes_are_nested_intervals(parts):
    page = dom.numbered("".join(parts))
    rows, text = page["nodes"], page["text"]
    assert [x["n"] for x in rows] == list(range(len(rows)))
    assert text == " ".join(text[x["t0"] : x["t1"]] for x in rows if x["tag"] == "#text")
    for x in rows:
        assert x["n"] <= x["last"] < len(rows)
        own = [y for y in rows[x["n"] : x["last"] + 1] if y["tag"] == "#text"]
        assert text[x["t0"] : x["t1"]] == " ".join(text[y["t0"] : y["t1"]] for y in own)
        around = [y["n"] for y in rows if y["n"] < x["n"] <= y["last"]]
        assert x["up"] == around[::-1][: dom.NEAR]
        assert x["box"] == max((n for n in around if rows[n]["tag"] in dom.BOXES), default=-1)
        siblings = [y["n"] for y in rows if y["tag"] != "#text" and y["up"][:1] == x["up"][:1]]
        if x["tag"] != "#text":
            k = siblings.index(x["n"])
            assert x["before"] == (siblings[k - 1] if k else -1) and x["after"] == (siblings[k + 1] if k + 1 < len(siblings) else -1)


def test_structure_of_pages(spark):
    markup = "<h1>Top</h1><div>one<p>two <b>three</b></p></div><h2>Low</h2><p>four</p>"
    read = nodes.read_pages(spark.createDataFrame([(7, "u", markup), (7, "u", "<p>four</p>"), (8, "u", None)], "id int, u string, h string"), "id", "u", "h")
    assert read.select("page").distinct().count() == 3 and nodes.nodes(read).count() == 12 + 2
    heads = read.withColumn("heads", F.filter("nodes", lambda x: x["tag"].isin("h1", "h2")))
    wanted = heads.select("*", F.explode(F.filter("nodes", lambda x: x["tag"].isin("b", "p"))).alias("x"))
    got = wanted.select("x.tag", nodes.said(nodes.preceding(F.col("x"), "heads")).alias("heading"), nodes.said(F.col("x")).alias("said"), F.size(nodes.within(F.col("x"))).alias("size")).collect()
    assert sorted((r.tag, r.heading or "", r.said, r["size"]) for r in got) == [("b", "Top", "three", 1), ("p", "", "four", 1), ("p", "Low", "four", 1), ("p", "Top", "two three", 3)]
    at = read.where("text LIKE 'Top%'").withColumn("x", nodes.covering_text(F.instr("text", "three") - 1))
    held = at.select(F.size("x.up").alias("deep"), nodes.said(nodes.holder(F.col("x"), 4, lambda a: a["tag"] == "div", 1)).alias("div"), nodes.said(nodes.holder(F.col("x"), 1, lambda a: a["tag"] == "div", 2)).alias("second"), nodes.said(nodes.holder(F.col("x"), 1, lambda a: a["tag"] == "x", 9)).alias("whole")).first()
    assert tuple(held) == (3, "one two three", "two three", "Top one two three Low four")


# channels by element


def test_channels_take_their_kind_from_their_element(spark):
    """Distractors stand at the page's beginning; each address has its own element and heading."""
    pages = [
        (1, "<p>Customer support and help desk hours</p>" + "<p>filler words</p>" * 60 + "<p>Partnerships: <a href='mailto:kim@x.com'>Kim</a></p>"),
        (2, "<p>Customer support</p>" + "<p>filler words</p>" * 60 + "<div>collaborations write Kim@X.com</div>"),
        (3, "<section><h2>Partnerships</h2><p>For collaborations email <a href='mailto:hello@x.com'>hello</a>.</p></section>"),
        (4, "<section><h2>Sulan Zhang, co-founder</h2><p>Questions go to sulanzhangart@gmail.com</p></section>"),
        (5, "<section class='team-member'><h3>Jane Doe</h3><strong>Founder</strong><a href='mailto:jane@x.com'>Email Jane</a></section><footer><a href='mailto:hello@x.com'>Contact us</a></footer>"),
        (6, '<script type="application/ld+json">{"@type":["Organization","LocalBusiness"],"email":"info@x.com"}</script><script type="application/ld+json">{"@type":"Person","name":"Al","email":"mailto:al@x.com"}</script>'),
        (7, "<p>write to sales [at] x [dot] com</p><p>press: sales@x.com</p>"),
        (8, "<h2>Press</h2>" + "<li>" * 5000 + "<a href='mailto:a@x.com'>deep</a>"),
        (9, "<h2>Legal</h2><p><a href='mailto:b@x.com'>one</a></p><h2>Sales</h2><p><a href='mailto:b@x.com'>two</a></p><p><a href='mailto:B@x.com?cc=1'>three</a></p>"),
    ]
    table = spark.createDataFrame([(i, "https://x.com/about", h) for i, h in pages], "id int, url string, html string")
    got = {(r.id, r.email): r for r in channels.page_channels(table, "id", "url", "html").collect()}
    kinds = {k: r.channel_type for k, r in got.items() if k[0] != 9}
    assert kinds == {
        (1, "kim@x.com"): "PARTNERSHIP_EMAIL", (2, "kim@x.com"): "PARTNERSHIP_EMAIL", (3, "hello@x.com"): "PARTNERSHIP_EMAIL", (4, "sulanzhangart@gmail.com"): "NAMED_PERSON_EMAIL",
        (5, "jane@x.com"): "NAMED_PERSON_EMAIL", (5, "hello@x.com"): "GENERAL_BUSINESS_EMAIL", (6, "info@x.com"): "GENERAL_BUSINESS_EMAIL", (6, "al@x.com"): "NAMED_PERSON_EMAIL",
        (7, "sales@x.com"): "SALES_MARKETING_EMAIL", (8, "a@x.com"): "SALES_MARKETING_EMAIL",
    }
    assert (got[4, "sulanzhangart@gmail.com"].name, got[4, "sulanzhangart@gmail.com"].title) == ("Sulan Zhang", "Sulan Zhang, co-founder")
    assert (got[5, "jane@x.com"].name, got[5, "jane@x.com"].title) == ("Jane Doe Founder", "Founder")  # three capitalised words read as one name
    nine = [(r.channel_type, r.evidence) for r in channels.page_channels(table.where("id = 9"), "id", "url", "html").collect()]
    assert sorted(nine) == [("RESTRICTED_EMAIL", "Legal | one"), ("SALES_MARKETING_EMAIL", "Sales | three")]  # the later of two rows that agree


def test_contact_evidence(spark):
    pages = [
        (1, "<section class='team-member'><h3>Jane Doe</h3><strong>Founder</strong><a href='mailto:jane@x.com'>Email Jane</a></section><footer><a href='mailto:hello@x.com'>Contact us</a></footer><section><h3>Sam Smith</h3><strong>Marketing Director</strong></section>"),
        (2, "<main><h1>Frequently Asked Questions</h1><p>Still need help? <a href='mailto:accessibility@x.com'>Email us</a></p></main><section><h2>Jane Smith</h2><p>Head of Marketing</p><a href='mailto:info@x.com'>Contact Jane</a></section>"),
        (3, "<section><h3>Jane Smith</h3><p>Executive Director</p></section>"),
        (4, "<main><p>Sulan Zhang, co-founder, started the company in 2020.</p><div class='team-card'><span class='name'>Aly Moursy</span><span class='title'>Founder & CEO</span></div><div class='testimonial'><strong>Happy Customer</strong><p>Founder</p></div></main>"),
        (5, "<p>Jane Smith is the co-founder and CEO of Example Inc.</p><div class='customer-quote'>Max Lie, owner</div>"),
        (6, "<p>ask x@y.com or X@Y.com</p>"),
        (7, None),
    ]
    table = spark.createDataFrame([(i, "https://x.com/team", h) for i, h in pages], "id int, url string, html string")
    rows = channels.contact_evidence(table, "id", "url", "html").collect()
    got = {i: sorted(((r.name, r.title, r.email, r.contact_type) for r in rows if r.id == i), key=str) for i in range(1, 8)}
    assert ("Jane Doe Founder", "Founder", "jane@x.com", "PERSON") in got[1] and ("Jane Doe", "Founder", None, "PERSON") in got[1] and (None, None, "hello@x.com", "GENERIC_BUSINESS_CONTACT") in got[1] and ("Sam Smith", "Marketing Director", None, "PERSON") in got[1]
    assert (None, None, "accessibility@x.com", "GENERIC_BUSINESS_CONTACT") in got[2] and (None, None, "info@x.com", "GENERIC_BUSINESS_CONTACT") in got[2] and ("Jane Smith", "Head of Marketing", None, "PERSON") in got[2]
    assert got[3] == [("Jane Smith", "Executive Director", None, "PERSON")]
    assert {r[0] for r in got[4]} == {"Sulan Zhang", "Aly Moursy"}
    assert [(r[0], r[1].lower()) for r in got[5]] == [("Jane Smith", "co-founder")]
    assert got[6] == [(None, None, "x@y.com", "GENERIC_BUSINESS_CONTACT")] and got[7] == []


# people in sentences


WORDS = ["Ann", "Lee", "Jo-Ann", "O'Neil", "bo", "X", "the", "a", "is", "our", "Our", "I'm", "I’m", "Hi", "owner", "Owner", "co-founder", "cofounder", "CEO", "president", "executive director", "vice-president", "owner-operator", "founder's", "team", "Émile", "a1"]


def plain_people(text):
    name, named = r"([A-Z][A-Za-z'’-]+\s+[A-Z][A-Za-z'’-]+)", r"((?:co-?)?founder|owner|CEO|president|executive director)"
    out = []
    for k, p in enumerate((rf"(?<![\w'’-]){name},\s*{named}(?!\w)", rf"(?<![\w'’-]){name}\s+is\s+(?:the\s+|an?\s+)?{named}(?!\w)", rf"(?<![\w])((?:co-?)?founder|owner|CEO|president),?\s+{name}(?![\w'’-])", rf"(?<![\w'’-])I['’]m\s+{name}(?![\w'’-])(.{{0,180}}?\b(?:founder|owner|CEO|president)\b)")):
        for m in re.finditer(p, text, re.I):
            who, role = (m.group(2), m.group(1)) if k == 2 else m.groups()[:2]
            role = re.search(r"(?:co-?)?founder|owner|CEO|president", role, re.I).group() if k == 3 else role
            if people.plausible(who):
                out.append((who, role))
    return list(dict.fromkeys(out))


@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", ", ", ". ", ","])), max_size=14))
@settings(max_examples=500, deadline=None)
def test_sentence_forms_match_a_plain_parser(parts):
    text = " ".join("".join(w + s for w, s in parts).split())
    assert people.said_people(text) == plain_people(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We met Ann Lee, owner, here", [("Ann Lee", "owner")]),
        ("Ann Lee is an Executive Director.", [("Ann Lee", "Executive Director")]),
        ("Our CEO, Ann Lee and president Bo Ray", [("Ann Lee", "CEO"), ("Bo Ray", "president")]),
        ("Hi, I’m Ann Lee and for ten years I was the cofounder and CEO", [("Ann Lee", "cofounder")]),
        ("I'm Ann Lee. " + "word " * 40 + "owner", []),
        ("Contact Us, owner", []),
        (None, []),
    ],
)
def test_sentence_forms(text, want):
    assert people.said_people(text) == want


def test_mailboxes_agree_with_names_nearby():
    assert people.person_near("Contact Erica Perez with questions: eperez11@x.edu", "eperez11@x.edu") == "Erica Perez"
    assert people.person_near("Ann Mary Lee", "annmarylee@x.com") == "Ann Mary Lee"
    assert people.person_near("Ann Lee", "ann.l@x.com") == "Ann Lee" and people.person_near("Ann Lee", "anna@x.com") is None
    assert people.person_near("Info Lee", "info@x.com") is None and people.person_near(None, "a@x.com") is None


# directory cards


CARD = "<div class='gz-list-card'><div class='gz-card-title'><a href='/list/member/{id}'><span itemprop='name'>{name}</span></a></div><span itemprop='addressLocality'>Dalton</span><span itemprop='addressRegion'>GA</span><span class='gz-card-cat'>{cat}</span><a href='{site}'><span itemprop='sameAs'></span></a></div>"


def test_directory_cards(spark):
    whole = CARD.format(id="ann-bakery-17", name="Ann &amp; Bakery", cat="Food", site="https://ann.example")
    broken = [
        CARD.format(id="own-1", name="Own", cat="", site="https://www.chamber.example/x"),  # the directory's own host
        CARD.format(id="rel-2", name="Relative", cat="", site="/just/here").replace("itemprop='name'", ""),  # no name
        "<div class='gz-list-card'><span itemprop='name'>No link</span></div>",
        "<div class='gz-list-card'><span itemprop='name'>Mail</span><a href='mailto:a@b.c'>Website</a></div>",
        "<div itemscope itemtype='https://schema.org/LocalBusiness'><b itemprop='name'>Labelled</b><a href='http://lab.example'>Visit  Website</a><a itemprop='url' href='https://dir.example/m/lab-9/'>more</a>",
    ]
    pages = [(1, whole + "".join(broken)), (2, None), (3, "<p>none</p>"), (3, whole)]
    table = spark.createDataFrame([(i, "https://dir.example/list", h) for i, h in pages], "id int, url string, html string")
    got = sorted(tuple(r) for r in cards.directory_cards(table, "id", "url", "html", own_host="chamber.example").select("id", "company_name", "website", "location", "category", "source_url", "identifier").collect())
    ann = ("Ann & Bakery", "https://ann.example", "Dalton, GA", "Food", "https://dir.example/list/member/ann-bakery-17", "17")
    assert got == [(1, *ann), (1, "Labelled", "http://lab.example", None, None, "https://dir.example/m/lab-9/", "9"), (3, *ann)]


def test_cards_by_their_shape(spark):
    item = "<li><h3>{0}</h3><p><a href='https://{0}.example'>Website</a></p></li>"
    other = "<li><h3>odd</h3><a href='https://odd.example'>Website</a></li>"
    markup = "<ul>" + "".join(item.format(x) for x in "abc") + other + "</ul><ul>" + item.format("d") + "</ul>"
    table = spark.createDataFrame([(1, "https://dir.example/", markup)], "id int, url string, html string")
    got = cards.directory_cards(table, "id", "url", "html", shapes=True).collect()
    assert sorted((r.company_name, r.website) for r in got) == [(x, f"https://{x}.example") for x in "abc"]
    assert cards.directory_cards(table, "id", "url", "html").count() == 0
