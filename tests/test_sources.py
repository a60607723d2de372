"""Readers, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from siftline.sources import readers, sinks
from siftline.streaming import jobs


def test_leads(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿company_name,website,active,odd\nFern,fern.org,true,1\n ,x.org,,\nOak,,no idea,\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps([{"company_name": "Elm", "website": "elm.org", "odd": 1}]))
    good, bad = readers.checked(readers.leads(spark, str(tmp_path / "a.csv")))
    assert [(r.company_name, r.active) for r in good.collect()] == [("Fern", True)]
    assert sorted(r._errors[0] for r in bad.collect()) == ["company_name is blank", "website is blank"]
    assert readers.leads(spark, str(tmp_path / "b.json")).first().company_name == "Elm"
    with pytest.raises(ValueError):
        readers.leads(spark, "a.xml")


def test_evidence_readers(spark, tmp_path):
    envelope = {"results": {"bindings": [{"company": {"value": "http://e/Q10"}, "website": {"value": "b.org"}}, {"company": {"value": "http://e/Q9"}, "website": {"value": "a.org"}}, {"company": {"value": "http://e/Q10"}, "website": {"value": "b.org"}}, {"company": {"value": "http://e/Q10"}}]}}
    (tmp_path / "s.json").write_text(json.dumps(envelope))
    assert [(r.qid, r.websites) for r in readers.sparql_rows(spark, str(tmp_path / "s.json")).collect()] == [("Q9", ["a.org"]), ("Q10", ["b.org"])]
    entity = json.dumps({"claims": {"P1": [{"mainsnak": {"datavalue": {"value": {"amount": "+12"}}}}, {"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}, {"mainsnak": {"datavalue": {"value": "plain"}}}, {"mainsnak": {}}]}})
    assert spark.range(1).select(readers.claim_values(F.lit(entity), "P1").alias("v")).first().v == ["12", "Q5", "plain"]
    tags = [("node", 1, {"shop": "bakery", "name": "Fern", "website": "fern.org"}), ("node", 2, {"disused:shop": "x", "shop": "x", "name": "G", "website": "g.org"}), ("way", 3, {"tourism": "hotel", "name": "Inn", "addr:city": "Ulm", "wikidata": "Q7", "parking": "yes"}), ("way", 4, {"amenity": "bench", "name": "B", "website": "b.org"})]
    elements = spark.createDataFrame(tags, "element_type string, id long, tags map<string,string>")
    assert [(r.record_id, r.tag) for r in readers.map_points(elements).collect()] == [("node/1", "shop=bakery")]
    inn = readers.hotels(elements).first()
    assert inn.address == "Ulm" and json.loads(inn.amenities_json) == {"parking": "yes"}
    assert readers.entity_links(elements, spark.createDataFrame([("way/3",)], "record_id string")).first().qid == "Q7"
    page = '<div data-page="{&quot;name&quot;:&quot;Fern&quot;,&quot;status&quot;:&quot;Active&quot;,&quot;team_size&quot;:9}">'
    p = spark.range(1).select(readers.embedded_profile(F.lit(page)).alias("p")).select("p.*", readers.active_small(F.col("p")).alias("ok")).first()
    assert p.name == "Fern" and p.ok
    assert [r.k for r in readers.sheet(spark, [["k", "v"], ["a"], ["b", "2", "3"]]).orderBy("k").collect()] == ["a", "b"]
    files = [spark.createDataFrame([("a", "OLD"), ("b", "B")], "k string, s string"), spark.createDataFrame([("a", "NEW")], "k string, s string")]
    assert {r.k: r.s for r in readers.latest_status(files, "k", "s").collect()} == {"a": "NEW", "b": "B"}
    sup = spark.createDataFrame([("A@b.co", "x", "s"), ("a@B.co", "y", "s"), ("bad", "z", "s")], "email string, reason string, source string").coalesce(1)
    assert [(r.email, r.reason) for r in readers.suppressions(sup).collect()] == [("a@b.co", "y")]
    placed = spark.createDataFrame([("A@b.co", "late", "s", "10"), ("a@b.co", "early", "s", "2")], "email string, reason string, source string, row string").repartition(2)
    assert [r.reason for r in readers.suppressions(placed, "row").collect()] == ["late"]
    raw = json.dumps({"12": "t" * 32, "13": "short", "x": "t" * 40})
    assert list(spark.range(1).select(readers.tokens(F.lit(raw)).alias("t")).first().t) == ["12"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k long")
    assert {(r.k, r.missing) for r in readers.incomplete(ids(1, 2), ids(2, 3), "k").collect()} == {(1, "meta"), (3, "payload")}
    links = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "page_id long, links array<string>")
    assert {r.link for r in readers.new_links(links, "links", spark.createDataFrame([("a",)], "link string"), 1).collect()} == {"b", "c"}
    assert readers.after(ids(*range(50)), "k", 9, 3).count() == 10


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "=SUM(1)"), (1, None)], "id long, cell string")
    sinks.export_csv(df, str(tmp_path / "csv"), ["id", "cell"], [F.col("id")], one_file=True)
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    assert raw == "id,cell\r\n1,\r\n2,'=SUM(1)\r\n"
    sinks.export_profiles(df, str(tmp_path / "json"), ["id"])
    assert "".join(p.read_text() for p in sorted((tmp_path / "json").glob("part-*"))).splitlines() == ['{"id":1}', '{"cell":"=SUM(1)","id":2}']
    assert sinks.append_new(df, str(tmp_path / "t"), ["id"]) == 2 and sinks.append_new(df, str(tmp_path / "t"), ["id"]) == 0
    edited = spark.createDataFrame([(1, "new", "APPROVED")], "id long, cell string, status string")
    current = spark.createDataFrame([(1, "old", "PENDING"), (2, "b", "PENDING")], "id long, cell string, status string")
    assert {r.id: (r.cell, r.status) for r in sinks.imported_decisions(current, edited, "id", ["status"]).collect()} == {1: ("old", "APPROVED"), 2: ("b", "PENDING")}
    assert "| 1 |" in sinks.markdown("T", df.select("id"), ["id"])


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("events") / "e")
    rows = spark.range(600).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 400)").alias("ts"), (F.col("id") % 5).alias("user_id"),
        F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    rows.repartitionByRange(3, "event_id").write.parquet(path)
    return path


def test_streams_match_batches(spark, folder):
    batch = spark.read.parquet(folder)
    got = run(jobs.daily_counts(jobs.event_stream(spark, folder)), spark, "daily", "complete")
    want = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert run(jobs.once(jobs.event_stream(spark, folder), ["event_id"]), spark, "once").count() == 600
    assert run(jobs.sessions(jobs.event_stream(spark, folder), "40 minutes"), spark, "sess", "complete").agg(F.sum("n")).first()[0] == 600
    assert run(jobs.busy_minutes(jobs.event_stream(spark, folder), 0), spark, "busy", "complete").count() > 0


def test_work_resumes(spark, folder, tmp_path):
    done, checkpoint = str(tmp_path / "done"), str(tmp_path / "c")
    for _ in range(2):
        jobs.work(jobs.event_stream(spark, folder, 1), done, "event_id", lambda d: d.select("event_id"), checkpoint).awaitTermination()
    assert spark.read.parquet(done).count() == 600
