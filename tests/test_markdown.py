"""People in Markdown against a plain version, line by line."""

import random
import re

from siftline.operators import markdown

ROLE = re.compile(r"\b(" + "|".join(markdown.ROLE_WORDS) + r")\b", re.I)
LABEL = re.compile(r"\b(?:" + "|".join(markdown.ROLE_LABELS) + r")\b", re.I)
NAME = r"([A-Z][A-Za-z'’-]{1,30}\s+[A-Z][A-Za-z'’-]{1,30})"


def plain(text):
    def clean(line):
        line = re.sub(r"\[([^]]+)\]\([^)]+\)", r"\1", re.sub(r"!\[([^]]*)\]\([^)]+\)", r"\1", line))
        return " ".join(re.sub(r"^[#>*\-\s]+", "", line).replace("**", "").split())

    def is_name(x):
        return len(x.split()) == 2 and len(x) <= 60 and "@" not in x and not any(w.lower().strip(".,:’'") in markdown.NOT_IN_NAMES for w in x.split())

    rows, out, seen = [x for x in map(clean, (text or "").splitlines()) if x], [], set()
    for i, line in enumerate(rows):
        got = []
        exact = line.strip(" .,:;|")
        if is_name(exact):
            role = next((rows[p] for o in (1, -1, 2, -2) for p in [i + o] if 0 <= p < len(rows) and ROLE.search(rows[p]) and len(rows[p]) <= 120), None)
            got += [(0, exact, role)] if role else []
        wide = next((x for x in rows[max(0, i - 8) : i + 9] if ROLE.search(x)), None)
        if m := re.search(rf"^{NAME},\s*((?:co-?)?founder\b[^|.]*)", line, re.I):
            got.append((1, *m.groups()))
        for form, p in ((2, rf"\b(?:our\s+)?founder,?\s+{NAME}"), (3, rf"\bI['’]m\s+{NAME}")):
            if m := re.search(p, line, re.I):
                got.append((form, m.group(1), wide))
        for form, name, title in got:
            fine = is_name(name) and title and ROLE.search(title)
            outcome = "NOT_A_NAME" if not is_name(name) else "NO_ROLE" if not fine else "SEEN" if name.lower() in seen else "FOUND"
            if fine:
                seen.add(name.lower())
            label = LABEL.search(title) if title else None
            out.append((i, form, name, label.group() if label else title and title[:255], " | ".join(rows[max(0, i - 2) : i + 3])[:1000], outcome))
    return out


CASES = [
    "## Jane Doe\nFounder & CEO\n\n## Our Team\nMarketing Director",
    "Ann Lee, co-founder of all | else\nAnn Lee, founder",
    "Hi, I'm Bo Ray\n" + "line\n" * 7 + "I am the owner",
    "Hi, I'm Bo Ray\n" + "line\n" * 8 + "I am the owner",
    "our founder, Al Bo spoke\nFounder Al Bo\nfounder the team",
    "[Jo Ann](http://x) \n![Chief](y.png) officer\n**Max Lie**\n> - * Owner",
    "Director\nJane Roe\r\nx\x0bVP Kim Po",
    None, "", "\n\n", "Contact Us\nmanager", "A B\n" + "owner " * 40,
]


def test_markdown_people_match_a_plain_version(spark):
    rng = random.Random(3)
    words = ["Ann Lee", "Bo Ray", "ann lee", "Our Team", "owner", "CEO", "x", "", "# Jo Li", "our founder Jo Li", "I'm Ann Lee", "Bo Ray, cofounder and more", "marketing", "a line of words"]
    texts = CASES + ["\n".join(rng.choice(words) for _ in range(rng.randrange(25))) for _ in range(150)]
    got = markdown.markdown_people(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()
    assert sorted((r.id, r.line, r.form, r.name, r.title or "", r.evidence, r.outcome) for r in got) == sorted((i, *row[:3], row[3] or "", *row[4:]) for i, t in enumerate(texts) for row in plain(t))
    assert [(r.name, r.title) for r in got if r.id == 0 and r.outcome == "FOUND"] == [("Jane Doe", "Founder")]
