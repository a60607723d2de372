"""Filters from parameters: blank and unknown ones don't count, nulls never match, marks are plain characters."""

import math
import random
from types import SimpleNamespace

import pytest

from siftline.operators import filters
from siftline.plans import filter_queries

ROWS = [(1, "Ann 100%", "a.com", "x", ["p", "q"]), (2, None, "ANN.org", "y", ["q"]), (3, "bob", None, None, None), (4, "", "c_d", "x", [])]
SPEC = filters.Filters(search=("name", "site"), equal=("kind",), contains=("site",), member=("tags",))


@pytest.mark.parametrize(
    ("params", "want"),
    [({}, [1, 2, 3, 4]), ({"q": " "}, [1, 2, 3, 4]), ({"q": "aNn"}, [1, 2]), ({"q": "0%"}, [1]), ({"q": "_"}, [4]), ({"kind": "x"}, [1, 4]), ({"kind": "x", "tags": "q"}, [1]), ({"tags": "q", "other": "z"}, [1, 2]), ({"site": "A"}, [1, 2]), ({"kind": None, "q": "b"}, [3]), ({"q": "a.com ann"}, [])],
)
def test_filters(spark, params, want):
    df = spark.createDataFrame(ROWS, "id int, name string, site string, kind string, tags array<string>")
    assert sorted(r.id for r in filters.filtered(df, SPEC, params).collect()) == want


def test_joined_search_crosses_columns(spark):
    df = spark.createDataFrame(ROWS, "id int, name string, site string, kind string, tags array<string>")
    joined = filters.Filters(search=("name", "site"), joined=True)
    assert [r.id for r in filters.filtered(df, joined, {"q": "% a.c"}).collect()] == [1]


def test_facets_and_shortlist(spark):
    df = spark.createDataFrame(ROWS, "id int, name string, site string, kind string, tags array<string>")
    assert sorted(tuple(r) for r in filters.facets(df, ["kind", "tags"]).collect()) == [("kind", "x", 2), ("kind", "y", 1), ("tags", "p", 1), ("tags", "q", 2)]
    top = filters.shortlist(df, df.kind.isNotNull(), [df.id.desc()], 2, "kind").collect()
    assert [(r.id, r.selection_rank) for r in sorted(top, key=lambda r: r.selection_rank)] == [(4, 1), (2, 2)]
    with pytest.raises(Exception, match="fewer than 3 rows are eligible"):
        filters.shortlist(df, df.kind.isNotNull(), [df.id], 3, "kind").collect()


def test_screened_scores_are_added_in_the_order_of_orders(spark):
    """Sums of cents that come to whole numbers, from orders dealt over tasks out of order: the floor is that of the sum in order."""
    rng, orders, want = random.Random(2), [], {}
    for c in range(1, 3001, 10):
        cents = [rng.randrange(100_000, 45_000_000) for _ in range(9)]
        prices = [x / 100 for x in [*cents, 100 - sum(cents) % 100]]
        orders += [(c * 100 + k, c, "F", p) for k, p in enumerate(prices)]
        total = 0.0
        for p in prices:
            total += p
        want[c] = math.floor(total)
    t = SimpleNamespace(
        customer=spark.createDataFrame([(c, f"C{c}", 1, "BUILDING", 5.0) for c in want], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double"),
        nation=spark.createDataFrame([(1, "PERU")], "n_nationkey int, n_name string"),
        orders=spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").repartition(7),
    )
    assert {r.c_custkey: r.score for r in filter_queries.screened_list(t).collect()} == want
