"""Facts from HTML: the one place where Python reads rows, in Arrow batches (FN-62..FN-70, FN-73)."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what counts as an e-mail address in a text.
MAIL = re.compile(r"(?<![\w.+-])([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})(?![\w.-])", re.I)
SILENT = {"script", "style", "noscript", "svg"}
PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("canonical", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("types", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("emails", T.ArrayType(T.StringType())), T.StructField("forms", T.ArrayType(T.StructType([T.StructField("action", T.StringType()), T.StructField("fields", T.StringType())]))),
        T.StructField("anchors", T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())]))),
    ]
)


class Page(HTMLParser):
    """One pass over a page's tags; unclosed tags do no harm."""

    def __init__(self):
        super().__init__()
        self.silent, self.in_title, self.in_json, self.form, self.anchor = 0, False, False, None, None
        self.title, self.description, self.canonical = [], None, None
        self.text, self.json, self.links, self.mails, self.forms, self.anchors = [], [], [], [], [], []

    def handle_starttag(self, tag, attributes):
        a = {k: v or "" for k, v in attributes}
        if tag in SILENT:
            self.silent += 1
            self.in_json = tag == "script" and a.get("type", "").lower() == "application/ld+json"
            if self.in_json:
                self.json.append("")
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and a.get("name", "").lower() == "description":
            self.description = a.get("content") or self.description
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonical = a.get("href") or self.canonical
        elif tag == "a" and a.get("href"):
            if a["href"].lower().startswith("mailto:"):
                self.mails.append(a["href"][7:].split("?")[0])
            else:
                self.links.append(a["href"])
                self.anchor = (a["href"], [])
                self.anchors.append(self.anchor)
        elif tag == "form":
            self.form = {"action": a.get("action", ""), "fields": []}
            self.forms.append(self.form)
        elif tag in {"input", "textarea", "select", "button"} and self.form is not None:
            self.form["fields"] += filter(None, (tag, a.get("type"), a.get("name"), a.get("id"), a.get("placeholder")))

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent, self.in_json = max(0, self.silent - 1), False
        elif tag == "title":
            self.in_title = False
        elif tag == "form":
            self.form = None
        elif tag == "a":
            self.anchor = None

    def handle_data(self, data):
        if self.in_json:
            self.json[-1] += data
        if self.silent:
            return
        if self.in_title:
            self.title.append(data)
        if self.anchor is not None:
            self.anchor[1].append(data)
        self.text.append(data)

    def structured(self) -> list:
        """All objects of the page's JSON-LD; blocks that aren't JSON, or are nested too deeply to read, count as none."""
        found = []
        for raw in self.json:
            try:
                found += objects(json.loads(raw))
            except (ValueError, RecursionError):
                continue
        return found


def objects(item) -> Iterator[dict]:
    """The object itself and all within it."""
    if isinstance(item, dict):
        yield item
    for part in item.values() if isinstance(item, dict) else item if isinstance(item, list) else ():
        yield from objects(part)


def squeeze(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def read_page(markup: str | None, text_most: int | None = None) -> dict:
    """The whole page is searched; text_most limits the text that is given back."""
    page = Page()
    page.feed(markup or "")
    page.close()
    things = page.structured()
    kinds = {str(k) for x in things for k in (x["@type"] if isinstance(x.get("@type"), list) else [x.get("@type")]) if k}
    text = squeeze(page.text)
    mails = [*page.mails, *MAIL.findall(text), *(str(x["email"]).removeprefix("mailto:") for x in things if x.get("email"))]
    return {
        "title": squeeze(page.title) or None, "description": page.description, "canonical": page.canonical, "text": text[:text_most], "types": sorted(kinds),
        "links": list(dict.fromkeys(page.links)), "emails": sorted({m.strip(" .,;:<>[]()\"'").lower() for m in mails if MAIL.fullmatch(m.strip(" .,;:<>[]()\"'"))}),
        "forms": [{"action": f["action"], "fields": " ".join(f["fields"]).lower()} for f in page.forms],
        "anchors": [{"href": href, "label": squeeze(label)} for href, label in page.anchors],
    }


@F.pandas_udf(PAGE)
def page_facts(markup: pd.Series) -> pd.DataFrame:
    """title, description, canonical, text, types, links, emails, forms, anchors of each page."""
    return pd.DataFrame([read_page(m) for m in markup], columns=PAGE.names)


# Roles that name a person who may speak for a company.
SPEAKING_ROLES = ("founder", "co-founder", "cofounder", "owner", "ceo", "president", "executive director")


def named_people(text: str | None) -> list[tuple[str, str]]:
    """(name, role) where two capitalised words end in a comma and a role follows."""
    words = (text or "").split()
    found = []
    for i in range(len(words) - 2):
        first, last = words[i].lstrip("([\"'"), words[i + 1]
        if not last.endswith(","):
            continue
        plain = [w.replace("'", "").replace("’", "").replace("-", "") for w in (first, last[:-1])]
        if not all(len(p) > 1 and p.isascii() and p.isalpha() and w[0].isupper() for p, w in zip(plain, (first, last), strict=True)):
            continue
        for n in (2, 1):
            said = " ".join(words[i + 2 : i + 2 + n]).rstrip(".,;:!?)]\"'")
            if said.lower() in SPEAKING_ROLES:
                found.append((f"{first} {last[:-1]}", said))
                break
    return list(dict.fromkeys(found))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("title", T.StringType())])))
def people(text: pd.Series) -> pd.Series:
    """People that a text names with their role, as in "Ann Lee, owner"."""
    return pd.Series([[{"name": n, "title": r} for n, r in named_people(t)] for t in text])


@F.pandas_udf(T.StringType())
def plain_punctuation(text: pd.Series) -> pd.Series:
    """Typographic marks as ASCII ones; letters and digits stay."""
    # Marks with an ASCII counterpart of their own.
    marks = str.maketrans({"—": "-", "–": "-", "−": "-", "‐": "-", "‑": "-", "…": "...", "“": '"', "”": '"', "‘": "'", "’": "'"})
    folded = (unicodedata.normalize("NFKC", t).translate(marks) if t is not None else None for t in text)
    return pd.Series([None if t is None else "".join("-" if ord(c) > 127 and unicodedata.category(c)[0] == "P" else c for c in t) for t in folded])


@F.pandas_udf(T.StringType())
def idna(host: pd.Series) -> pd.Series:
    """A host name in its ASCII form; null if it has none (the part of FN-03 that Spark lacks)."""

    def one(h):
        try:
            return None if h is None else h.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return pd.Series([one(h) for h in host])
