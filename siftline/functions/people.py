"""People that a text names, and the mailbox that is theirs (FN-61..FN-64)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that no name holds, and mailboxes that are nobody's own.
NOT_A_NAME = frozenset(
    "about apply committee contact content copyright executive faq frequently functions leadership management our questions statement "
    "age agreement ai apple arbitration banker board business care class coldwell company control customer data disclaimer elect export "
    "joint law notice opt-out past platform privacy realtor references requirements reseller rules service startup team tech termination "
    "terms use vice waiver works your".split()
)
SHARED_MAILBOXES = ["accessibility", "admin", "billing", "business", "careers", "contact", "dpo", "founders", "hello", "info", "legal", "marketing", "office", "partners", "partnerships", "privacy", "sales", "support", "team", "webmaster"]
# Roles in sentences, besides executive director.
LED = ("co-founder", "cofounder", "founder", "owner", "ceo", "president")
SAID = ("founder", "owner", "ceo", "president")
#: How far after "I'm" and a name a role may stand.
REACH = 180
#: How much of a block of text is searched for a name.
NEARBY = 1200
#: What a name is made of, besides letters.
JOINERS = "'’-"


def plausible(name: str) -> bool:
    """Two or three capitalised words of Latin letters, none of them a word that names don't hold."""
    words = name.split()
    shaped = all(len(w) > 1 and "A" <= w[0] <= "Z" and all(c.isascii() and c.isalpha() or c in JOINERS for c in w[1:]) for w in words)
    return 2 <= len(words) <= 3 and len(name) <= 60 and shaped and not any(w.strip(".:-").lower() in NOT_A_NAME or w.lower() in NOT_A_NAME for w in words)


def plausible_name(name: Column) -> Column:
    """`plausible` as an expression."""
    bare = F.trim(name)
    words = F.split(F.regexp_replace(F.lower(bare), r"^[ .:-]+|[ .:-]+$", ""), r"\s+")
    shaped = bare.rlike(r"^[A-Z][A-Za-z'’-]+(?:\s+[A-Z][A-Za-z'’-]+){1,2}$")
    return F.coalesce(shaped & (F.length(bare) <= 60) & ~F.arrays_overlap(words, F.array(*map(F.lit, sorted(NOT_A_NAME)))), F.lit(False))


class Tokens:
    """The words of a text as the sentence forms see them, with what stands between them."""

    WORD = re.compile(r"\w+(?:['’-]+\w+)*['’-]*")

    def __init__(self, text: str):
        self.text = text
        found = list(self.WORD.finditer(text))
        self.word, self.start, self.end = [m.group() for m in found], [m.start() for m in found], [m.end() for m in found]
        self.low = [w.lower() for w in self.word]

    def gap(self, i: int) -> str:
        """What stands between word i and the next; nothing after the last."""
        return self.text[self.end[i] : self.start[i + 1]] if i + 1 < len(self.word) else ""

    def spaced(self, i: int) -> bool:
        return self.gap(i).isspace()

    def name(self, i: int) -> str | None:
        """The two words from i on, if they could be a first and a last name."""
        return f"{self.word[i]} {self.word[i + 1]}" if self.spaced(i) and lettered(self.word[i]) and lettered(self.word[i + 1]) else None

    def role_from(self, i: int) -> tuple[str, int] | None:
        """The role with which word i begins, and the last word of it."""
        if i < len(self.word):
            if self.low[i] == "executive" and self.gap(i) == " " and leading(self.low[i + 1], ("director",)):
                return f"{self.word[i]} {self.word[i + 1][:8]}", i + 1
            role = leading(self.low[i], LED)
            return (self.word[i][: len(role)], i) if role else None
        return None


def lettered(word: str) -> bool:
    return len(word) > 1 and word[0].isascii() and word[0].isalpha() and all(c.isascii() and c.isalpha() or c in JOINERS for c in word)


def leading(word: str, roles: tuple[str, ...]) -> str | None:
    """The role that a word is, or that stands before a hyphen or apostrophe in it."""
    return next((r for r in roles if word.startswith(r) and (len(word) == len(r) or word[len(r)] in JOINERS)), None)


def ending(word: str, roles: tuple[str, ...]) -> str | None:
    """The longest role that a word is, or that stands after a hyphen or apostrophe in it."""
    return next((r for r in sorted(roles, key=len, reverse=True) if word.endswith(r) and (len(word) == len(r) or word[-len(r) - 1] in JOINERS)), None)


def name_comma_role(t: Tokens, i: int):
    """Ann Lee, owner"""
    name = t.name(i)
    if name and t.gap(i + 1).startswith(",") and not t.gap(i + 1)[1:].strip():
        role = t.role_from(i + 2)
        return role and (name, *role)
    return None


def name_is_role(t: Tokens, i: int):
    """Ann Lee is the owner"""
    name, at = t.name(i), i + 2
    if name and t.spaced(i + 1) and t.low[at] == "is" and t.spaced(at):
        at += 2 if t.low[at + 1] in ("the", "a", "an") and t.spaced(at + 1) else 1
        role = t.role_from(at)
        return role and (name, *role)
    return None


def role_name(t: Tokens, i: int):
    """Our founder, Ann Lee"""
    role, gap = ending(t.low[i], LED), t.gap(i)
    name = t.name(i + 1) if role and gap.removeprefix(",").isspace() else None
    return name and (name, t.word[i][-len(role) :], i + 2)


def i_am_name(t: Tokens, i: int):
    """I'm Ann Lee ... owner"""
    name = t.name(i + 1) if t.low[i] in ("i'm", "i’m") and t.spaced(i) else None
    if name:
        begin = t.end[i + 2]
        for k in range(i + 3, len(t.word)):
            if t.start[k] - begin > REACH:
                break
            at = next((p.start() for p in re.finditer(r"[^'’-]+", t.low[k]) if p.group() in SAID), None)
            if at is not None and t.start[k] + at - begin <= REACH:
                said = t.text[begin : t.end[k]]  # the first mention of a role between, whole word or not
                spots = [(x, r) for r in ("co-founder", "cofounder", *SAID) for x in [said.lower().find(r)] if x >= 0]
                x, r = min(spots, key=lambda s: (s[0], -len(s[1])))
                return name, said[x : x + len(r)], k
    return None


FORMS = (name_comma_role, name_is_role, role_name, i_am_name)


def said_people(text: str | None) -> list[tuple[str, str]]:
    """(name, role) of the people that the four sentence forms name; form by form, leftmost first, each match after the one before."""
    t, found = Tokens(" ".join((text or "").split())), []
    for form in FORMS:
        i = 0
        while i < len(t.word):
            got = form(t, i)
            if got and plausible(got[0]):
                found.append(got[:2])
            i = got[2] + 1 if got else i + 1
    return list(dict.fromkeys(found))


def agrees(name: str, box: str) -> bool:
    """Whether a mailbox begins with the full name or initial and last name, or is the first name, alone or before a mark."""
    words = "".join(c if c.isalnum() or c in "_' -" else " " for c in name.casefold()).split()
    return box == words[0] or box.startswith(("".join(words), words[0][0] + words[-1], *(words[0] + mark for mark in "._-")))


def person_near(text: str | None, email: str | None) -> str | None:
    """The first plausible name in a text with which the mailbox agrees; shared mailboxes are nobody's."""
    box = (email or "").split("@")[0].split("+")[0].casefold()
    if not box or box in SHARED_MAILBOXES:
        return None
    t = Tokens(" ".join((text or "").split())[:NEARBY])
    fine = [lettered(w) and w[0].isupper() and len(w) <= 31 for w in t.word]
    for i in range(len(t.word) - 1):
        if fine[i] and fine[i + 1] and t.spaced(i):
            name = " ".join(t.word[i : i + 3] if i + 2 < len(t.word) and fine[i + 2] and t.spaced(i + 1) else t.word[i : i + 2])
            if plausible(name) and agrees(name, box):
                return name
    return None


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("title", T.StringType())])))
def people_said(text: pd.Series) -> pd.Series:
    return pd.Series([[{"name": n, "title": r} for n, r in said_people(t)] for t in text])


@F.pandas_udf(T.StringType())
def person_nearby(text: pd.Series, email: pd.Series) -> pd.Series:
    return pd.Series([person_near(t, e) for t, e in zip(text, email, strict=True)])
