"""Leads and evidence from files: explicit schemas, rejected rows beside accepted ones (SRC-01..SRC-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import valid_recipient
from ..functions.url import blank, domain_key

LEADS = "company_name string, website string, industry string, location string, company_size string, source_url string, customer_facing boolean, search_dependent boolean, content_rich boolean, active boolean, geo_opportunity string, unsuitable boolean, dead_website boolean"


def tidy(df: DataFrame) -> DataFrame:
    """Empty strings as null, strings trimmed."""
    return df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes))


def csv_leads(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of leads with a header, by column name, a byte order mark before it or not."""
    raw = spark.read.option("header", True).csv(path)  # all strings
    raw = raw.toDF(*(c.lstrip("﻿").removeprefix("ï»¿").strip() for c in raw.columns))
    wanted = [part.strip().split(" ") for part in LEADS.split(",")]
    cells = [F.nullif(F.trim(F.col(n)), F.lit("")).try_cast(kind).alias(n) if n in raw.columns else F.lit(None).cast(kind).alias(n) for n, kind in wanted]
    return raw.select(*cells)


def json_leads(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that holds an array of leads."""
    return tidy(spark.read.schema(LEADS).option("multiLine", True).option("mode", "FAILFAST").json(path))


def leads(spark: SparkSession, path: str) -> DataFrame:
    readers = {"csv": csv_leads, "json": json_leads}
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind not in readers:
        raise ValueError(f"no reader for files of this kind: {path}")
    return readers[kind](spark, path)


def checked(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leads with a name and a website that has a host, and the others with their errors (SRC-04)."""
    problems = F.array_compact(F.array(F.when(blank(F.col("company_name")), "company_name is blank"), F.when(blank(F.col("website")), "website is blank"), F.when(~blank(F.col("website")) & domain_key(F.col("website")).isNull(), "website has no host")))
    marked = df.withColumn("_errors", problems)
    return marked.where(F.size("_errors") == 0).drop("_errors"), marked.where(F.size("_errors") > 0)


def embedded_profile(html: Column, attribute: str = "data-page") -> Column:
    """(name, website, status, team_size) of a directory page that carries its record in an attribute (SRC-05)."""
    raw = F.regexp_extract(html, attribute + r'\s*=\s*"([^"]*)"', 1)
    plain = F.regexp_replace(F.regexp_replace(raw, "&quot;", '"'), "&amp;", "&")
    return F.from_json(F.coalesce(F.get_json_object(plain, "$.props.company"), plain), "name string, website string, status string, team_size int")


def active_small(profile: Column, most: int = 250) -> Column:
    return F.coalesce((profile["status"] == "Active") & (profile["team_size"].isNull() | (profile["team_size"] <= most)), F.lit(False))


def new_links(pages: DataFrame, links: str, seen: DataFrame, limit: int) -> DataFrame:
    """The first links of directory pages that weren't seen, in order, at most 5 a wanted record and 250 (SRC-06)."""
    limit = min(50, max(1, limit))
    flat = pages.select("page_id", F.posexplode(links).alias("pos", "link"))
    first = flat.groupBy("link").agg(F.min(F.struct("page_id", "pos")).alias("at"))
    return first.join(seen, "link", "left_anti").orderBy("at").limit(min(250, 5 * limit)).select("link")


# Map tags that make a point of interest commercial, and those that say it is gone.
COMMERCIAL = {"shop": None, "craft": None, "office": None, "amenity": ["restaurant", "cafe", "bar", "pub", "fast_food", "dentist", "doctors", "clinic", "pharmacy", "veterinary", "bank", "school", "college", "hospital"], "tourism": ["hotel", "motel", "guest_house", "museum", "attraction", "gallery"]}
INACTIVE = ["disused", "abandoned", "demolished", "removed", "closed"]


def map_points(elements: DataFrame) -> DataFrame:
    """id, name, website, tag of named, active, commercial elements (element_type, id, tags) with a website (SRC-09)."""
    tag = lambda k: F.col("tags")[k]
    gone = F.exists(F.map_keys("tags"), lambda k: F.lower(F.split_part(k, F.lit(":"), F.lit(1))).isin(INACTIVE))
    kinds = [F.when(tag(k).isNotNull() & (F.lit(True) if v is None else tag(k).isin(v)), F.concat(F.lit(k + "="), tag(k))) for k, v in COMMERCIAL.items()]
    site = F.coalesce(tag("website"), tag("contact:website"), tag("url"))
    rows = elements.where(~gone).select(F.concat_ws("/", "element_type", "id").alias("record_id"), tag("name").alias("name"), site.alias("website"), F.coalesce(*kinds).alias("tag"), "tags")
    return rows.where(~blank(F.col("name")) & ~blank(F.col("website")) & F.col("tag").isNotNull())


def hotels(elements: DataFrame) -> DataFrame:
    """Named hotels of map elements with address, amenities and room tags packed (SRC-10)."""
    tag = lambda k: F.col("tags")[k]
    address = F.nullif(F.concat_ws(", ", F.nullif(F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street")), F.lit("")), tag("addr:city"), tag("addr:state"), tag("addr:postcode")), F.lit(""))
    amenities = F.map_filter("tags", lambda k, v: k.isin("internet_access", "swimming_pool", "parking", "breakfast", "wheelchair"))
    rooms = F.map_filter("tags", lambda k, v: k.isin("rooms", "beds", "stars"))
    found = elements.where(((tag("tourism") == "hotel") | (tag("amenity") == "hotel")) & ~blank(tag("name")))
    return found.select(F.concat_ws("/", "element_type", "id").alias("record_id"), tag("name").alias("name"), address.alias("address"), F.to_json(amenities).alias("amenities_json"), F.to_json(rooms).alias("rooms_json"), F.coalesce(tag("brand"), tag("operator")).alias("chain_name"))


def entity_links(elements: DataFrame, known: DataFrame) -> DataFrame:
    """record_id, qid of known records with an entity id (SRC-11)."""
    rows = elements.select(F.concat_ws("/", "element_type", "id").alias("record_id"), F.col("tags")["wikidata"].alias("qid"))
    return rows.where(F.col("qid").rlike("^Q[1-9][0-9]*$")).join(known, "record_id", "left_semi")


SPARQL = "results struct<bindings array<struct<company struct<value string>, website struct<value string>>>>"


def sparql_rows(spark: SparkSession, path: str) -> DataFrame:
    """qid, websites (distinct, in order) of a saved result envelope, by number (SRC-12, TOP-10)."""
    raw = spark.read.schema(SPARQL).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("results.bindings").alias("pos", "b")).select("pos", F.regexp_extract("b.company.value", "(Q[0-9]+)$", 1).alias("qid"), F.col("b.website.value").alias("site"))
    first = rows.groupBy("qid", "site").agg(F.min("pos").alias("pos"))
    sites = F.transform(F.array_sort(F.collect_list(F.when(~blank(F.col("site")), F.struct("pos", "site")))), lambda x: x["site"])
    return first.groupBy("qid").agg(sites.alias("websites")).orderBy(F.substring("qid", 2, 20).cast("long"))


def claim_values(entity: Column, property_id: str) -> Column:
    """The values of an entity document's claims: ids, amounts, times or plain values as strings (SRC-14)."""
    values = F.from_json(F.get_json_object(entity, f"$.claims.{property_id}"), "array<struct<mainsnak struct<datavalue struct<value string>>>>")
    one = lambda v: F.coalesce(F.get_json_object(v, "$.id"), F.ltrim(F.get_json_object(v, "$.amount"), F.lit("+")), F.get_json_object(v, "$.time"), v)
    return F.filter(F.transform(values, lambda c: one(c["mainsnak"]["datavalue"]["value"])), lambda v: v.isNotNull())


def after(df: DataFrame, key: str, last: object, batch: int) -> DataFrame:
    """The next page by key, of 10 to 25 rows (SRC-13)."""
    rows = df if last is None else df.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(min(25, max(10, batch)))


def latest_status(files: list[DataFrame], key: str, status: str, order_by: str | None = None) -> DataFrame:
    """The status of each key in the last file, and the last row of it, that has the key (SRC-16).

    order_by: a column with a row's place in its file; without one, rows count in the order of the file's splits."""
    out = None
    for order, df in enumerate(files):
        place = F.col(order_by).cast("long") if order_by else F.monotonically_increasing_id()
        rows = df.select(key, status, F.lit(order).alias("_file"), place.alias("_pos"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(key).agg(F.max_by(status, F.struct("_file", "_pos")).alias(status))


def sheet(spark: SparkSession, values: list[list[str]]) -> DataFrame:
    """A spreadsheet range, its first row the header; short rows are filled with nulls (SRC-17)."""
    header = values[0] if values else []
    rows = [[*r[: len(header)], *[None] * (len(header) - len(r))] for r in values[1:]]
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))


def suppressions(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """email, reason, source of valid addresses in lower case; the last row of an address counts (SRC-18).

    order_by: a column with a row's place in its file; without one, rows count in the order of the file's splits."""
    place = F.col(order_by).cast("long") if order_by else F.monotonically_increasing_id()
    rows = df.where(valid_recipient(F.col("email"))).select(F.lower(F.trim("email")).alias("email"), "reason", "source", place.alias("_pos"))
    return rows.groupBy("email").agg(F.max_by(F.struct("reason", "source"), "_pos").alias("r")).select("email", "r.reason", "r.source")


def tokens(raw: Column) -> Column:
    """company id -> token of a JSON map, digit keys and long values only (SRC-19)."""
    return F.map_filter(F.from_json(raw, "map<string,string>"), lambda k, v: k.rlike("^[0-9]+$") & (F.length(v) >= 32))


def incomplete(payloads: DataFrame, metas: DataFrame, key: str) -> DataFrame:
    """Keys with a payload but no meta, or a meta but no payload (SRC-21)."""
    both = payloads.select(key).distinct().withColumn("p", F.lit(True)).join(metas.select(key).distinct().withColumn("m", F.lit(True)), key, "full")
    return both.where(F.col("p").isNull() | F.col("m").isNull()).select(key, F.when(F.col("p").isNull(), "payload").otherwise("meta").alias("missing"))
