"""Queries over pages as nodes and texts as lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cards, channels, markdown
from ..sources import envelopes, published
from ..sources.scratch import shared_folder
from .catalog import Tables, query

#: Headings that the pages' added sections carry, chosen by the pages' own lengths, and what each is for.
HEADINGS = ["Partnerships", "Customer support", "Press office", "Legal notice", "General inquiries", "Opening hours", "Business development"]
KINDS = ["PARTNERSHIP_EMAIL", "SUPPORT_EMAIL", "SALES_MARKETING_EMAIL", "RESTRICTED_EMAIL", "GENERAL_BUSINESS_EMAIL", "OTHER", "BUSINESS_DEVELOPMENT_EMAIL"]

#: Pages that a task reads, where narrow rows are made into pages.
PER_TASK = 8192


def phrase(at):
    return F.element_at(F.array(*map(F.lit, HEADINGS)), (at % len(HEADINGS) + 1).cast("int"))


@query(
    "FN-62, FN-65",
    f"""WITH p AS (SELECT page_id, length(html) AS a, length(url) AS b, 'site' || page_id || '.example' AS host FROM pages),
       k AS (SELECT *, list_extract({KINDS}, (a % 7 + 1)::INT) AS ka, list_extract({KINDS}, (b % 7 + 1)::INT) AS kb, list_extract({KINDS}, ((a + b) % 7 + 1)::INT) AS kc FROM p)
       SELECT page_id, 'desk' || page_id || '@' || host AS email, ka AS channel_type, NULL AS name FROM k
       UNION ALL SELECT page_id, 'line' || page_id || '@' || host, kb, NULL FROM k
       UNION ALL SELECT page_id, 'shown' || page_id || '@' || host, kc, NULL FROM k WHERE kc <> 'OTHER'
       UNION ALL SELECT page_id, 'ann.lee@' || host, 'NAMED_PERSON_EMAIL', 'Ann Lee' FROM k WHERE a % 2 = 0""",
)
def channels_by_element(t: Tables) -> DataFrame:
    """Whole pages with four sections more: each address belongs to its own section, whatever the others say."""
    host, a, b = F.concat(F.lit("site"), "page_id", F.lit(".example")), F.length("html"), F.length("url")
    desk = F.concat(F.lit("<section><h2>"), phrase(a), F.lit('</h2><p>Write <a href="mailto:Desk'), "page_id", F.lit("@"), host, F.lit('?subject=x">us</a></p></section>'))
    line = F.concat(F.lit("<section><h3>"), phrase(b), F.lit('</h3><ul><li><a href="MAILTO:line'), "page_id", F.lit("@"), host, F.lit('">here</a></li></ul></section>'))
    shown = F.concat(F.lit("<div>"), phrase(a + b), F.lit(": <b>Shown"), "page_id", F.lit("@"), F.upper(host), F.lit("</b></div>"))
    person = F.when(a % 2 == 0, F.concat(F.lit("<div><p>Ask Ann Lee</p><p>ann.lee@"), host, F.lit("</p></div>"))).otherwise("")
    whole = F.concat("html", desk, line, shown, person)
    pages = t.pages.select("page_id", F.concat(F.lit("https://"), host, F.lit("/about")).alias("url"), whole.alias("html"))
    return channels.page_channels(pages, "page_id", "url", "html").where(F.col("email").endswith(host)).select("page_id", "email", "channel_type", "name")


@query(
    "FN-61, FN-63, FN-64",
    r"""WITH c AS (SELECT c_custkey, c_acctbal AS b, c_mktsegment AS s, n_name, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || upper(n_name[1]) || lower(regexp_replace(n_name[2:], '[^A-Z].*$', '')) AS who
                   FROM customer JOIN nation ON c_nationkey = n_nationkey),
       r AS (SELECT *, CASE WHEN b < 0 THEN 'Owner' WHEN b < 3000 THEN 'Marketing Director' WHEN b < 6000 THEN 'Head of nothing' ELSE 'co-founder' END AS role FROM c)
       SELECT c_custkey, who AS name, role AS title, NULL AS email, 'PERSON' AS contact_type FROM r WHERE s IN ('BUILDING', 'MACHINERY') AND role <> 'Head of nothing'
       UNION ALL SELECT c_custkey, who, role, NULL, 'PERSON' FROM r WHERE s IN ('HOUSEHOLD', 'FURNITURE') AND role IN ('Owner', 'co-founder')
       UNION ALL SELECT c_custkey, NULL, NULL, 'team' || c_custkey || '@x.example', 'GENERIC_BUSINESS_CONTACT' FROM r""",
)
def page_people(t: Tables) -> DataFrame:
    """A person on each page, in one of four forms by segment, with a role by balance; only some forms and roles name people."""
    from pyspark.sql.functions import broadcast

    segment, b = F.col("c_mktsegment"), F.col("c_acctbal")
    who = F.concat_ws(" ", F.initcap("c_mktsegment"), F.initcap(F.regexp_replace("n_name", "[^A-Z].*$", "")))
    role = F.when(b < 0, "Owner").when(b < 3000, "Marketing Director").when(b < 6000, "Head of nothing").otherwise("co-founder")
    body = (
        F.when(segment == "BUILDING", F.concat(F.lit("<section><h3>"), who, F.lit("</h3><p>"), role, F.lit("</p></section>")))
        .when(segment == "MACHINERY", F.concat(F.lit("<div class='team'><span class='card-name'>"), who, F.lit("</span><i>x</i><span>"), role, F.lit("</span></div>")))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("<p>There "), who, F.lit(" is the "), role, F.lit(" of it all.</p>")))
        .when(segment == "FURNITURE", F.concat(F.lit("<p>So says "), who, F.lit(", "), role, F.lit(".</p>")))
        .otherwise(F.concat(F.lit("<div class='testimonial'><b>"), who, F.lit("</b><i>"), role, F.lit("</i></div><div class='customer'>"), who, F.lit(", owner</div>")))
    )
    mail = F.concat(F.lit("<p>mail team"), "c_custkey", F.lit("@x.example</p>"))
    rows = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    rows = rows.repartition(max(1, -(-rows.count() // PER_TASK)))  # pages are read where their rows stand, and few row groups hold many rows
    pages = rows.join(broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lit("https://x.example/").alias("url"), F.concat(body, mail).alias("html"))  # 25 nations
    return channels.contact_evidence(pages, "c_custkey", "url", "html").select("c_custkey", "name", "title", "email", "contact_type")


@query(
    "SRC-07",
    """WITH c AS (SELECT *, c_custkey // 20 AS listing FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT listing, replace(c_name, '#', ' & ') AS company_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'https://dir.example/out/' || c_custkey ELSE 'https://c' || c_custkey || '.example' END AS website,
              CASE WHEN c_mktsegment = 'FURNITURE' THEN n_name ELSE n_name || ', ' || n_regionkey END AS location, nullif(CASE WHEN c_acctbal < 3000 THEN lower(c_mktsegment) ELSE '' END, '') AS category,
              'https://dir.example/member/' || lower(c_mktsegment) || '-' || c_custkey AS source_url, c_custkey::VARCHAR AS identifier
       FROM c WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'""",
)
def directory_cards(t: Tables) -> DataFrame:
    """Listings of 20 customers a page; customers in debt have no website, machinery's lead to the directory's own host."""
    segment, n = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    site = F.when(segment == "BUILDING", F.concat(F.lit("/out/"), n)).when(segment == "MACHINERY", F.concat(F.lit("https://www.chamber.example/"), n)).otherwise(F.concat(F.lit("https://c"), n, F.lit(".example")))
    link = F.when(F.col("c_acctbal") < 0, "<i>no site</i>").when(segment == "HOUSEHOLD", F.concat(F.lit("<a href='"), site, F.lit("'> Visit <b>Website</b></a>"))).otherwise(F.concat(F.lit("<a href='"), site, F.lit("'><span itemprop='sameAs'></span></a>")))
    card = F.concat(
        F.lit("<div class='gz-list-card x'><h5 class='gz-card-title'><a href='/member/"), F.lower(segment), F.lit("-"), n, F.lit("/'><span itemprop='name'>"), F.replace("c_name", F.lit("#"), F.lit(" &amp; ")), F.lit("</span></a></h5><span itemprop='addressLocality'>"),
        "n_name", F.lit("</span>"), F.when(segment == "FURNITURE", "").otherwise(F.concat(F.lit("<span itemprop='addressRegion'>"), F.col("n_regionkey").cast("string"), F.lit("</span>"))),
        F.when(F.col("c_acctbal") < 3000, F.concat(F.lit("<div class='gz-card-category'>"), F.lower(segment), F.lit("</div>"))).otherwise(""), link, F.lit("</div>"),
    )
    cards_of = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.expr("c_custkey div 20").alias("listing"))  # 25 nations
    pages = cards_of.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", card.alias("card")))), lambda x: x["card"]), "\n").alias("html"))
    listed = pages.select("listing", F.lit("https://dir.example/list").alias("url"), F.concat(F.lit("<html><body><main>"), "html", F.lit("</main></body></html>")).alias("html"))
    found = cards.directory_cards(listed, "listing", "url", "html", own_host="chamber.example")
    return found.withColumn("source_url", F.regexp_replace("source_url", "/$", ""))


@query(
    "SRC-07",
    r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]+</a></li>', 1)) AS link FROM pages),
       n AS (SELECT page_id, count(*) AS n FROM m GROUP BY page_id HAVING count(*) >= 3)
       SELECT page_id, link, count(*) AS times FROM m JOIN n USING (page_id) GROUP BY page_id, link""",
)
def repeated_blocks(t: Tables) -> DataFrame:
    """The entries of the pages' menus, found by nothing but their repeated shape: list items that hold a link."""
    from ..operators import nodes

    links = lambda x: F.when(x["tag"] == "li", F.transform(F.filter(nodes.within(x), lambda y: y["tag"] == "a"), lambda y: nodes.attribute(y, "href")))
    blocks = cards.repeated(nodes.read_pages(t.pages, "page_id", "url", "html"), links)
    return blocks.select(F.col("key").alias("page_id"), F.explode("payload").alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("times"))


_NAME = r"([A-Za-z][A-Za-z''’-]{1,30}\s+[A-Za-z][A-Za-z''’-]{1,30})"
_ROLE = r"\b(?:" + "|".join(markdown.ROLE_WORDS) + r")\b"


@query(
    "FN-68",
    rf"""WITH d AS (SELECT doc_id, source, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS w, text FROM documents),
       m AS (SELECT doc_id, '# ' || source || chr(10) || '**' || w || '**' || chr(10) || CASE WHEN length(text) % 3 = 0 THEN 'Founder & CEO' WHEN length(text) % 3 = 1 THEN 'Our Team' ELSE 'x' || chr(10) || '- the [marketing manager](http://x)' END
                    || chr(10) || text || chr(10) || 'our founder, ' || w || ' spoke' || chr(10) || 'Ann Lee, cofounder of ' || source AS t FROM d),
       s AS (SELECT doc_id, unnest(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS raw, generate_subscripts(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), 1) AS pos FROM m),
       c AS (SELECT doc_id, pos, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(raw, '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '^[#>*\-\s]+', ''), '**', ''), '\s+', ' ', 'g')) AS said FROM s),
       l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line, said FROM c WHERE said <> ''),
       n AS (SELECT *, [lead(said) OVER o, lag(said) OVER o, lead(said, 2) OVER o, lag(said, 2) OVER o] AS beside,
                    list(said) OVER (o ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS wide, regexp_replace(said, '^[ .,:;|]+|[ .,:;|]+$', '', 'g') AS exact
             FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
       r AS (SELECT doc_id, line, said, exact, list_filter(beside, lambda x: x IS NOT NULL AND regexp_matches(lower(x), '{_ROLE}') AND length(x) <= 120)[1] AS near, list_filter(wide, lambda x: regexp_matches(lower(x), '{_ROLE}'))[1] AS far FROM n),
       p AS (SELECT doc_id, line, 0 AS form, exact AS name, near AS title FROM r WHERE near IS NOT NULL AND len(regexp_split_to_array(exact, '\s+')) = 2 AND length(exact) <= 60 AND exact NOT LIKE '%@%'
                    AND len(list_filter(regexp_split_to_array(exact, '\s+'), lambda w: list_contains({markdown.NOT_IN_NAMES}, regexp_replace(lower(w), '^[.,:’'']+|[.,:’'']+$', '', 'g')))) = 0
             UNION ALL SELECT doc_id, line, 1, regexp_extract(said, '(?i)^{_NAME},\s*((?:co-?)?founder\b[^|.]*)', 1), regexp_extract(said, '(?i)^{_NAME},\s*((?:co-?)?founder\b[^|.]*)', 2) FROM r WHERE regexp_matches(said, '(?i)^{_NAME},\s*((?:co-?)?founder\b[^|.]*)')
             UNION ALL SELECT doc_id, line, 2, regexp_extract(said, '(?i)\b(?:our\s+)?founder,?\s+{_NAME}', 1), far FROM r WHERE regexp_matches(said, '(?i)\b(?:our\s+)?founder,?\s+{_NAME}')
             UNION ALL SELECT doc_id, line, 3, regexp_extract(said, '(?i)\bI[''’]m\s+{_NAME}', 1), far FROM r WHERE regexp_matches(said, '(?i)\bI[''’]m\s+{_NAME}')),
       q AS (SELECT *, len(regexp_split_to_array(trim(name), '\s+')) = 2 AND length(name) <= 60 AND name NOT LIKE '%@%'
                    AND len(list_filter(regexp_split_to_array(trim(name), '\s+'), lambda w: list_contains({markdown.NOT_IN_NAMES}, regexp_replace(lower(w), '^[.,:’'']+|[.,:’'']+$', '', 'g')))) = 0 AS fine,
                    coalesce(regexp_matches(lower(title), '{_ROLE}'), false) AS told FROM p),
       z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name), fine AND told ORDER BY line, form) AS k FROM q)
       SELECT doc_id, line, form, name, coalesce(nullif(regexp_extract(title, '(?i)\b(?:{"|".join(markdown.ROLE_LABELS)})\b', 0), ''), title[1:255]) AS title,
              CASE WHEN NOT fine THEN 'NOT_A_NAME' WHEN NOT told THEN 'NO_ROLE' WHEN k > 1 THEN 'SEEN' ELSE 'FOUND' END AS outcome FROM z""",
)
def markdown_people(t: Tables) -> DataFrame:
    """Whole documents as Markdown, with their first two words as a name before and after them."""
    w = F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    kind = F.length("text") % 3
    role = F.when(kind == 0, "Founder & CEO").when(kind == 1, "Our Team").otherwise("x\n- the [marketing manager](http://x)")
    body = F.concat(F.lit("# "), "source", F.lit("\n**"), w, F.lit("**\n"), role, F.lit("\n"), "text", F.lit("\nour founder, "), w, F.lit(" spoke\nAnn Lee, cofounder of "), "source")
    return markdown.markdown_people(t.documents.select("doc_id", body.alias("md")), "doc_id", "md").drop("evidence")


@query(
    "SRC-12, SRC-13, TOP-10",
    """SELECT page_id AS number, 'Q' || page_id AS qid, CASE WHEN page_id % 3 = 0 THEN [url, 'https://www.site' || page_id || '.example/'] ELSE [url] END AS websites, CASE WHEN page_id <= 100 THEN 'before' ELSE 'after' END AS part FROM pages""",
)
def keyset_envelopes(t: Tables) -> DataFrame:
    """All pages' URLs as saved envelopes of 50 entities, read up to a key and after it; a third have a second website."""
    folder = f"{shared_folder(t.spark)}/siftline-envelopes-{uuid.uuid4().hex}"
    second = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.site"), "page_id", F.lit(".example/")))
    rows = t.pages.select(F.col("page_id").alias("number"), F.explode(F.array_compact(F.array("url", second))).alias("website"))
    envelopes.save(rows, folder, per_range=50)
    # An envelope lists websites by name; the page's own comes first here, as in the table.
    made = lambda w: F.when(w.contains("//www.site"), 1).otherwise(0)
    own = F.array_sort("websites", lambda a, b: made(a) - made(b)).alias("websites")
    before, after = envelopes.saved(t.spark, folder, 50, upto=100), envelopes.saved(t.spark, folder, 50, after=100)
    return before.select("number", "qid", own, F.lit("before").alias("part")).unionByName(after.select("number", "qid", own, F.lit("after").alias("part")))


@query("SNK-12", "SELECT doc_id::VARCHAR AS doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(n_chars::VARCHAR, '') AS n_chars, (SELECT count(*) FROM documents) AS published FROM documents")
def published_export(t: Tables) -> DataFrame:
    """All documents' facts, published by source and read back through the manifest."""
    folder = f"{shared_folder(t.spark)}/siftline-export-{uuid.uuid4().hex}"
    shown = published.publish(t.documents.select("doc_id", "source", "lang", "n_chars"), folder, [F.col("source"), F.col("doc_id")])
    return published.published(t.spark, folder).withColumn("published", F.lit(shown["rows"]).cast("long"))
