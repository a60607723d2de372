"""The Merkle manifest, the shuffle into shards and hard negatives against plain versions, with nulls, ties, repeats, long texts and empty tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import hard_negatives as hn
from siftline.llm import merkle, numbering, sharding
from siftline.llm.common import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, grp string, leaf string, path string, g string, i string, n string, node string, shard string, slot string"


def documents(spark, rows):
    """rows: (doc_id, text, lang[, source]); with columns named as those that the operators use inside."""
    return spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else "s", len(r[1] or "") or None, *["x"] * 10) for r in rows], DOCS)


EDGES = [(None, None, None), (None, "no id", "en"), (1, "", None), (2, "Ünïcode", "fr"), (2, "Ünïcode", "fr"), (2, "another", "fr"), (3, "L" * 200_000, "de", None), (4, None, "de")]


# numbers


def test_numbers_within_groups_and_over_all(spark, monkeypatch):
    monkeypatch.setattr(numbering, "TASK_ROWS", 7)  # many ranges
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, 1, 2, 3])) for _ in range(100)]
    table = stored(spark.createDataFrame(rows, "g string, k int"), "rows")
    got = numbering.numbered(table, ["k"], "no", "of", group="g").collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    for g, own in by.items():
        own.sort(key=lambda r: r.no)
        assert [r.no for r in own] == list(range(len(own))) and {r.of for r in own} == {len(own)}
        assert [r.k for r in own] == sorted((k for h, k in rows if h == g), key=lambda k: (k is not None, k or 0))
    every = numbering.numbered(table, ["g", "k"], "no", "of").collect()
    assert sorted(r.no for r in every) == list(range(100)) and {r.of for r in every} == {100}


# 11 Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """The top, and for each node its path of (before, after)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for p, i in zip(paths, at):
            run = level[i // arity * arity : (i // arity + 1) * arity]
            p.append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
        at = [i // arity for i in at]
    return level[0], paths


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_manifest_matches_plain_version(spark, monkeypatch, arity):
    monkeypatch.setattr(numbering, "TASK_ROWS", 16)
    rng = random.Random(arity)
    rows = EDGES + [(100 + i, f"text {i}", rng.choice(["en", "en", "en", "fr", "é", "z"])) for i in rng.sample(range(300), 150)] + [(999, "alone", "zz")]
    docs = documents(spark, rows)
    full = [(r[0], r[3] if len(r) > 3 else "s", r[2], len(r[1] or "") or None, r[1]) for r in rows]
    by = defaultdict(list)
    for f in full:
        by[f[2]].append((f[0] is not None, f[0] or 0, plain_leaf(*f)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(by[g])], arity) for g in langs}
    root, over = plain_tree([trees[g][0] for g in langs], arity)
    want = sorted(str((i if known else None, g, leaf, trees[g][0], root, path + top)) for g, top in zip(langs, over) for (known, i, leaf), path in zip(sorted(by[g]), trees[g][1]))
    made = merkle.manifest(docs, arity=arity, carry={"node": F.lower("text")})  # a name that is used inside
    got = made.withColumn("back", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted(str((r.id, r.grp, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path])) for r in got) == want
    assert {r.back for r in got} == {root} and sorted(str(r.node) for r in got) == sorted(str(r[1] and r[1].lower()) for r in rows)


def test_manifest_notices_any_change(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "fr") for i in range(40)]
    fields = [F.col(c) for c in merkle.FIELDS]
    changed = {"shown": merkle.leaf_of([*fields[:-1], F.when(F.col("doc_id") == 7, F.lit("text 8")).otherwise(F.col("text"))])}
    got = merkle.manifest(documents(spark, rows), carry=changed).select("id", (merkle.folded(F.col("shown"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r.id for r in got if not r.ok} == {7}
    null, dash, empty = (merkle.leaf_of([F.lit(x).cast("string")]) for x in (None, "-", ""))
    assert len(set(spark.range(1).select(null, dash, empty).first())) == 3


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(documents(spark, [(5, "x", "en")])).first()
    assert one.leaf == one.subroot == one.root and one.path == []
    assert merkle.manifest(documents(spark, [])).count() == 0


# 12 shards


@given(st.integers(1, 5000), st.integers(0, 2**40), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_shuffle_is_a_permutation_and_turns_back(n, seed, shards):
    rows = np.arange(n)
    shard, slot = sharding.place(rows, n, shards, seed)
    assert sorted((slot * shards + shard).tolist()) == list(range(n))
    sizes = np.bincount(shard, minlength=shards)
    assert sizes.max() - sizes.min() <= 1
    assert sharding.row_at(shard, slot, n, shards, seed).tolist() == rows.tolist()


def test_shuffle_of_huge_numbers_stays_in_range():
    n = 10**15 + 7
    rows = np.array([0, 1, 2, n // 2, n - 2, n - 1])
    shuffle = sharding.Shuffle(n)
    assert (shuffle.place(rows) < n).all() and shuffle.row(shuffle.place(rows)).tolist() == rows.tolist()


def test_shuffle_depends_on_the_seed_and_spreads():
    a, b = (sharding.Shuffle(10_000, s).place(np.arange(10_000)) for s in (1, 2))
    assert (a == b).mean() < 0.01 and abs(np.corrcoef(np.arange(10_000), a)[0, 1]) < 0.05


def test_sharded_rows(spark, monkeypatch):
    monkeypatch.setattr(numbering, "TASK_ROWS", 16)
    rows = EDGES + [(i, f"t{i % 5}", "en") for i in range(10, 150)]
    docs = stored(documents(spark, rows), "rows")
    got = sharding.sharded(docs, ties=("text",), shards=7).collect()
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert (r.shard, r.slot) == tuple(int(x[0]) for x in sharding.place(np.array([r.row_number]), len(rows), 7))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.row_number)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    again = sharding.sharded(stored(docs.repartition(3), "rows"), ties=("text",), shards=7).collect()
    key = lambda r: str((r.doc_id, r.text, r.shard, r.slot))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.sharded(stored(documents(spark, []), "rows")).count() == 0
    assert {r.shard for r in sharding.sharded(stored(documents(spark, EDGES[:2]), "rows")).collect()} <= set(range(24))


def test_written_shards_hold_whole_rows_in_slot_order(spark, tmp_path):
    rows = EDGES + [(i, f"t{i}", "en") for i in range(10, 150)]
    sizes = sharding.write_shards(documents(spark, rows), f"file://{tmp_path}/shards", shards=5, per_file=8).collect()
    assert sum(r["rows"] for r in sizes) == len(rows)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(str((r.doc_id, r.text)) for r in back.collect()) == sorted(str(r[:2]) for r in rows)
    wanted = sharding.row_at(np.array([3]), np.array([4]), len(rows), 5)[0]
    assert back.where("shard = 3 AND slot = 4").first().row_number == wanted


# 13 hard negatives


def plain_negatives(rows, scale=256, positives=5, negatives=5, low=80, high=100):
    dim = max((len(v) for _, v, _ in rows if v), default=0)
    fine = [(i, [int(np.floor(scale * np.float64(np.float32(x)))) for x in v], l) for i, v, l in rows if v and l is not None and len(v) == dim and all(x is not None and np.isfinite(x) and abs(x) < hn.LARGEST for x in v)]
    out = []
    for at, (a, v, l) in enumerate(fine):
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i is None, i or 0, m) for k, (i, w, m) in enumerate(fine) if k != at), key=lambda x: x[:3])
        for s, none, p, m in [x for x in scored if x[3] == l][:positives]:
            hits = [x for x in scored if x[3] != l and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, None if none else p, k + 1, None if y[1] else y[2], -s, -y[0]) for k, y in enumerate(hits)]
    return sorted(map(str, out))


@pytest.mark.parametrize("kind", ["even", "clustered", "ties"])
def test_hard_negatives_match_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(600):
        v = {"even": rng.normal(size=8), "clustered": centres[i % 12] + 0.1 * rng.normal(size=8), "ties": rng.integers(-1, 2, 8) / 4}[kind]
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 3))))
    rows += [(700, None, 1), (800, [1.0, None] + [0.0] * 6, 1), (900, [float("nan")] + [0.0] * 7, 1), (1000, [float("inf")] + [0.0] * 7, 1), (1100, rows[0][1], None), (1200, [1.0, 2.0], 1), (1300, [], 1), (1400, [1e30] * 8, 0)]
    rows += [(200, rows[200][1], rows[200][2]), (None, rows[5][1], 0), (None, rows[6][1], 1), (1500, [0.0] * 8, 2), (1600, [0.0] * 8, 2)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, r string, slice int")
    got = hn.hard_negatives(table, F.col("vec_id") % 100 == 0, slice_rows=100, sample_rows=200)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_negatives(rows)


def test_no_vectors_no_negatives(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(table, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(one, F.col("vec_id") % 100 == 0).count() == 0


@given(st.integers(0, 2**32), st.integers(2, 40))
@settings(max_examples=40, deadline=None)
def test_bounds_hold_and_prune(seed, cells):
    rng = np.random.default_rng(seed)
    x = rng.integers(-300, 300, (200, 6))
    grid = hn.Cells(x[:50], x.min(axis=0), x.max(axis=0), cells)
    anchors = rng.integers(-300, 300, (5, 6))
    low, high = grid.bounds(grid.codes(x), grid.tables(anchors))
    exact = x @ anchors.T
    assert (low <= exact).all() and (exact <= high).all()


def test_few_rows_are_scored_exactly():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64)) * 32
    x = np.floor(x).astype(np.int64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(4000, np.int64)), pa.array(np.zeros(4000, np.int32)), pa.array(np.arange(4000)), pa.array(np.arange(4000)), pa.array(np.zeros(4000, np.int64)), pa.array(x.tolist(), pa.list_(pa.int32())), pa.nulls(4000, pa.list_(pa.int64()))], ["slice", "kind", "r", "vec_id", "label", "v", "scores"])
    own = hn.Slice([batch], hn.Cells(x[:1000], x.min(axis=0), x.max(axis=0)))
    every = (np.array([hn.LEAST]), np.array([np.iinfo(np.int64).max]))
    found = own.searched(x[:20], lambda s: np.ones((len(own.r[s]), 20), bool), 5, [every] * 20)
    for a, got in enumerate(found):
        assert [i for i, _, _ in got] == np.argsort(-(x @ x[a]), kind="stable")[:5].tolist()
    assert own.scored < 0.2 * 20 * 4000
