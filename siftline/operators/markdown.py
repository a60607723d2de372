"""People in Markdown: names with a role on a line nearby (FN-68)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_match

# Words of roles, roles as they are called, words that no name holds, what a name is.
ROLE_WORDS = ["founder", "owner", "chief", "ceo", "president", "director", "manager", "marketing", "growth", "operations", "executive", "cfo", "vp"]
ROLE_LABELS = [
    "co-?founder", "founder", "owner", "chief executive officer", "CEO", "president", "executive director", "marketing director", "marketing manager",
    "growth manager", "operations director", "director", "manager", "CFO", "VP",
]
NOT_IN_NAMES = (
    "about accessibility builders committee contact content cookie coaching details developer director donate email executive frequently github http "
    "leadership marketing maximum message platforms questions show staff statement storage subscribe team veeza who your"
).split()
NAME = r"([A-Za-z][A-Za-z'’-]{1,30}\s+[A-Za-z][A-Za-z'’-]{1,30})"
BREAKS = "\r\n|[\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]"
#: Lines before and after: of evidence, and where a founder's role is looked for; characters of a role's line, and of evidence.
NEAR, WIDE, ROLE_LINE, EVIDENCE = 2, 8, 120, 1000


def cleaned(line: Column) -> Column:
    """A line's text without images, links, marks at its beginning, and bold."""
    plain = F.regexp_replace(F.regexp_replace(line, r"!\[([^\]]*)\]\([^)]+\)", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1")
    bare = F.replace(F.regexp_replace(plain, r"^[#>*\-\s]+", ""), F.lit("**"), F.lit(""))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def names_role(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"\b(?:" + "|".join(ROLE_WORDS) + r")\b"), F.lit(False))


def plausible(name: Column) -> Column:
    words = F.split(F.trim(name), r"\s+")
    banned = F.exists(words, lambda w: F.regexp_replace(F.lower(w), "^[.,:’']+|[.,:’']+$", "").isin(NOT_IN_NAMES))
    return (F.size(words) == 2) & (F.length(name) <= 60) & ~name.contains("@") & ~banned


def role_label(line: Column) -> Column:
    found = F.regexp_extract(line, r"(?i)\b(?:" + "|".join(ROLE_LABELS) + r")\b", 0)
    return F.when(found != "", found).otherwise(F.substring(line, 1, 255))


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 0), said: the lines of each text that aren't empty once cleaned."""
    split = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), BREAKS)).alias("_at", "_raw")).select(key, "_at", cleaned(F.col("_raw")).alias("said")).where("said <> ''")
    return split.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1).alias("line"), "said")


def pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, form, name, title, evidence: what the forms find, right or not. Each line sees 8 lines before and behind it, no more."""
    order = Window.partitionBy(key).orderBy("line")
    beside = F.array(*(F.lag("said", -k).over(order) for k in (1, -1, 2, -2)))
    around = lambda n: F.collect_list("said").over(order.rowsBetween(-n, n))
    seen = lines(docs, key, text).withColumn("_beside", beside).withColumn("_near", around(NEAR)).withColumn("_wide", around(WIDE))
    exact = F.regexp_replace("said", r"^[ .,:;|]+|[ .,:;|]+$", "")
    next_role = F.get(F.filter("_beside", lambda x: x.isNotNull() & names_role(x) & (F.length(x) <= ROLE_LINE)), F.lit(0))
    wide_role = F.get(F.filter("_wide", names_role), F.lit(0))
    own, led, me = rf"(?i)^{NAME},\s*((?:co-?)?founder\b[^|.]*)", rf"(?i)\b(?:our\s+)?founder,?\s+{NAME}", rf"(?i)\bI['’]m\s+{NAME}"
    none = F.lit(None).cast("struct<form:int,name:string,title:string>")

    def found(form: int, holds: Column, name: Column, title: Column) -> Column:
        return F.when(holds, F.struct(F.lit(form).alias("form"), name.alias("name"), title.alias("title"))).otherwise(none)

    forms = [
        found(0, plausible(exact) & next_role.isNotNull(), exact, next_role),
        found(1, F.col("said").rlike(own), F.regexp_extract("said", own, 1), F.regexp_extract("said", own, 2)),
        found(2, F.col("said").rlike(led), F.regexp_extract("said", led, 1), wide_role),
        found(3, F.col("said").rlike(me), F.regexp_extract("said", me, 1), wide_role),
    ]
    evidence = F.substring(F.array_join("_near", " | "), 1, EVIDENCE)
    return seen.select(key, "line", evidence.alias("evidence"), F.explode(F.array_compact(F.array(*forms))).alias("_p")).select(key, "line", "_p.*", "evidence")


def markdown_people(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, form, name, title, evidence, outcome of each name that Markdown pairs with a role.

    outcome: FOUND once for each name of a text, however written, in the order of lines and forms; else why not: NOT_A_NAME,
    NO_ROLE or SEEN. A line is a name that stands alone beside a role's line, "Ann Lee, founder ...", "our founder Ann Lee" or
    "I'm Ann Lee" near a role. Defined results: null and empty texts have none; key names one text; texts are read whole."""
    fine = plausible(F.col("name"))
    told = F.coalesce(names_role(F.col("title")), F.lit(False))
    first = F.row_number().over(Window.partitionBy(key, F.lower("name"), fine & told).orderBy("line", "form"))
    rows = pairs(docs, key, text).withColumn("_k", first)
    outcome = first_match([(~fine, "NOT_A_NAME"), (~told, "NO_ROLE"), (F.col("_k") > 1, "SEEN")], "FOUND")
    return rows.select(key, "line", "form", "name", role_label(F.col("title")).alias("title"), "evidence", outcome.alias("outcome"))
