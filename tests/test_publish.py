"""The data source of saved envelopes and the committing writer."""

import csv
import hashlib
import io
import json

import pytest
from pyspark.sql import functions as F

from siftline.sources import envelopes, published


def rows_of(spark, numbers):
    return spark.createDataFrame([(n, f"https://{x}{n}.example") for n in numbers for x in "ab"] + [(numbers[0], f"https://a{numbers[0]}.example")], "number long, website string")


def test_envelopes_by_range_with_pushed_filters(spark, tmp_path):
    folder = f"file://{tmp_path}/env"
    envelopes.save(rows_of(spark, list(range(5, 95))), folder, per_range=10)
    every = envelopes.saved(spark, folder, 10)
    got = every.collect()
    assert sorted(r.number for r in got) == list(range(5, 95)) and all(r.qid == f"Q{r.number}" and r.websites == [f"https://{x}{r.number}.example" for x in "ab"] for r in got)
    assert every.rdd.getNumPartitions() == 10
    after = every.where("number > 57 AND number <= 83 AND qid <> 'Q60'")
    assert sorted(r.number for r in after.collect()) == [n for n in range(58, 84) if n != 60]
    assert after.rdd.getNumPartitions() == 4  # 50s to 80s; nothing below the cursor is opened
    both = envelopes.saved(spark, folder, 10, upto=30).unionByName(envelopes.saved(spark, folder, 10, after=30))
    assert sorted(r.number for r in both.collect()) == list(range(5, 95))
    assert every.where("number = 41").count() == 1 and every.where("number >= 1000").count() == 0


def test_what_is_no_envelope_is_an_error(spark, tmp_path):
    for bad in ({}, {"results": 1}, {"results": {"bindings": [{"company": {"value": "x/Q1"}}]}}, {"results": {"bindings": [{"company": {"value": "x/P1"}, "website": {"value": "y"}}]}}):
        with pytest.raises(ValueError, match="envelope"):
            envelopes.grouped(bad)
    good = {"results": {"bindings": [{"company": {"value": f"x/Q{q}"}, "website": {"value": w}} for q, w in ((20, "b"), (3, "c"), (20, "a"), (20, "b"))]}}
    assert envelopes.grouped(good) == [(3, "Q3", ["c"]), (20, "Q20", ["b", "a"])]


def test_a_restarted_stream_repeats_nothing(spark, tmp_path):
    folder, out = f"file://{tmp_path}/env", f"file://{tmp_path}/out"

    def run():
        stream = envelopes.arriving(spark, folder, 10).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/progress").trigger(availableNow=True).start()
        stream.awaitTermination()
        return sorted(r.number for r in spark.read.parquet(out).collect())

    envelopes.save(rows_of(spark, list(range(0, 25))), folder, per_range=10)
    assert run() == list(range(25))
    assert run() == list(range(25))
    envelopes.save(rows_of(spark, list(range(30, 45))), folder, per_range=10)
    assert run() == list(range(25)) + list(range(30, 45))


def test_publish_is_ordered_digested_and_replaced_at_once(spark, tmp_path):
    folder = f"file://{tmp_path}/export"
    assert published.manifest(folder)["rows"] == 0 and published.published(spark, folder).count() == 0
    rows = [(i, f"=cmd {i}" if i % 3 else None, 'say "x",\nthen' if i % 5 == 0 else "é") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, name string, note string").repartition(5)
    shown = published.publish(df, folder, [F.col("id").desc()])
    want = [[str(i), f"'=cmd {i}" if i % 3 else "", 'say "x",\nthen' if i % 5 == 0 else "é"] for i in reversed(range(300))]
    parts = [(tmp_path / "export" / "parts" / p["name"]).read_bytes() for p in shown["parts"]]
    assert list(csv.reader(io.StringIO(b"".join(parts).decode(), newline=""))) == want
    assert [p["digest"] for p in shown["parts"]] == [hashlib.sha256(p).hexdigest() for p in parts]
    assert shown["rows"] == 300 and shown["digest"] == hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()
    assert sorted(list(r) for r in published.published(spark, folder).collect()) == sorted(want)
    old = published.published(spark, folder)
    again = published.publish(df.where("id < 10"), folder, [F.col("id")])
    assert again["rows"] == 10 and published.published(spark, folder).count() == 10 and old.count() == 300  # the old parts are still there
    assert published.swept(folder) == len(shown["parts"]) and published.published(spark, folder).count() == 10


def test_a_failed_task_publishes_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/export"
    published.publish(spark.range(5).select("id"), folder, [F.col("id")])
    before = json.loads((tmp_path / "export" / "manifest.json").read_text())
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        published.publish(broken, folder, [F.lit(1)])
    assert json.loads((tmp_path / "export" / "manifest.json").read_text()) == before
    assert published.published(spark, folder).count() == 5
