"""Every catalogued query against its SQL in DuckDB, on the driver's smallest tables."""

import os

import duckdb
import pytest

from siftline.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    rows = got.select(*sorted(got.columns)).collect()
    if name in catalog.ORACLE_SQL:
        result = con.execute(f"SELECT {', '.join(sorted(got.columns))} FROM ({catalog.ORACLE_SQL[name]})")
        assert plain(rows) == plain(result.fetchall())
    else:
        assert rows


def test_entry_imports_without_the_subpackage(spark, monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("siftline.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("siftline.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delattr(sys.modules["siftline"], "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalog.QUERIES) and entry.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__")
