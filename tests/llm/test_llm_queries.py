"""The registered queries and the pipeline over the driver's smallest tables."""

import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import near_dup, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("name", [n for n in queries.ORACLE_SQL if n != "op10_url_filter"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    order = ", ".join(sorted(got.columns))
    want = con.execute(f"SELECT {order} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert rows(got) == sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in want)


def test_url_filter_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    want = con.execute(f"SELECT page_id, decision, pattern, n_active FROM ({queries.ORACLE_SQL['op10_url_filter']})").fetchall()
    got = queries.QUERIES["op10_url_filter"](spark, FOLDER).select("page_id", "decision", "pattern", "n_active").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_stages_do_their_work(spark):
    docs = first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, FOLDER)
        assert docs.columns == first.columns, name
        if name != "mixing":
            assert 0 < docs.count() <= before.count()
        if name == "near_duplicates":
            assert near_dup.near_duplicates(docs).where("NOT kept").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n > 1024 OR n <> end").count() == 0
    assert packed.agg(F.count_distinct("doc_id")).first()[0] == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, FOLDER).count() == packed.count()


def test_stages_handle_nulls_repeats_and_clashing_names(spark):
    """Rows with nulls in any column, repeated and null ids, empty and long texts, columns named as those used inside, and no rows at all."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = docs.where("n_chars > 500").limit(40)
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, "s", 1), (1, "x " * 30_000, "en", None, 60_000), (1, "x " * 30_000, "en", None, 60_000), (2, "Same words here as there are", "en", "s", 5), (2, "Same words here as there are", "en", "s", 5)]
    mixed = good.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in ("h", "key", "root", "size", "target", "shard", "m_size", "sequence_id"):
        mixed = mixed.withColumn(name, F.lit("mine"))
    for rows in (mixed, mixed.limit(0)):
        current = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, FOLDER)
            assert current.columns == rows.columns, name
            current = spark.createDataFrame(current.collect(), current.schema)  # as read again
        packed = corpus_pipeline.STAGES[-1][1](spark, current, FOLDER)
        full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
        assert full.where("n > 1024 OR n <> end").count() == 0
        assert (packed.count() == 0) == (current.count() == 0)


def test_held_out_rule(spark):
    from siftline.llm import langid

    got = spark.range(50).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
