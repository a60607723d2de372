"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample (`sample_rows`, the lowest hashes of vec_id): a node splits by
the hyperplane between two of its sample's vectors, drawn at random. All vectors are then indexed:
each goes to a leaf of every tree. Leaves are to hold about `leaf_rows` of all vectors, so trees
grow by a level as the corpus doubles; below the sample's resolution nodes split by random
directions through their centre. Inner products are searched as angles, with the usual extra
coordinate that gives all vectors one length.

A query walks all trees through one priority queue, ordered by the squared margins crossed on the
way. How many leaves it takes is measured, at every corpus size in the same way: a few of the
sample's vectors are searched in the sample, whose true neighbours are known, and the share of
leaves in which `recall` of these are found is the share that all queries take. It is a matter of
the data: clustered vectors need a few percent; vectors spread evenly over 64 dimensions, as the
driver's are, need leaves that hold half of the corpus or more, counted in each tree, and then the
work grows with queries times rows, as it must for any method that compares vectors.

Leaves are numbered in the order of the tree, and neighbouring leaves form branches of about
`branch_rows` vectors. A task holds one branch, and the queries that visit it stream past, a few at a
time; a vector moves once for each tree, a query once for each branch it visits. The trees have
`most_leaves` leaves at most, so what the driver holds and sends to tasks has a fixed bound; beyond
`most_leaves * leaf_rows` vectors leaves hold more, and the share of them that a query takes is the
same. The best of each task are joined and ranked anew by exact inner products of the original vectors.
Queries that found fewer than k (in nearly empty leaves) search once more, all leaves of a tree.

Equal vectors are one entry with its k + 1 least ids, so a vector that a third of all rows share
neither floods a leaf nor hides other neighbours; equal queries are searched once.

Defined results: vectors that are null, zero, of another dimension than most, or hold a null or
non-finite component take no part; ties go to the smaller vec_id; a query with fewer candidates
than k gets them all; of rows that repeat a vec_id with different vectors the one with the
smallest components, in order, counts, as candidate and as query; no queries or rows give an empty
result; other columns are ignored. Texts don't occur; a vector's length is bounded by its row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, stored

TREES, LEAF_ROWS, SAMPLE_ROWS, RECALL, MEASURED = 4, 32, 32_768, 0.95, 100
#: Leaves of a tree at most; vectors of a branch, and queries that are compared with it at a time.
MOST_LEAVES, BRANCH_ROWS, QUERY_ROWS = 1 << 14, 4096, 256


@dataclass
class Tree:
    """Node i splits by normals[i] . x - cuts[i] < 0; children[i] are nodes, or leaves as -1 - leaf."""

    normals: np.ndarray
    cuts: np.ndarray
    children: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        if not len(self.cuts):
            return node
        open_ = np.arange(len(x))
        while len(open_):
            at = node[open_]
            right = np.einsum("ij,ij->i", x[open_], self.normals[at]) >= self.cuts[at]
            node[open_] = self.children[at, right.astype(np.int64)]
            open_ = open_[node[open_] >= 0]
        return -1 - node


def grow(sample: np.ndarray, leaves: int, rng: np.random.Generator) -> Tree:
    """A tree of about `leaves` leaves. Nodes split in the order of their share of the sample, the largest first."""
    normals, cuts, children = [], [], []
    n_leaves, tie = 1, 0
    heap = [(-1.0, 0, np.arange(len(sample)), None)]  # share, tie, members, (parent, side)

    def attach(where, child):
        if where:
            children[where[0]][where[1]] = child

    while heap and n_leaves < leaves:
        share, _, own, where = heapq.heappop(heap)
        x = sample[own]
        if len(own) >= 2:
            i, j = rng.choice(len(own), 2, replace=False)
            normal = x[j] - x[i]
        else:
            normal = np.zeros(sample.shape[1])
        if not np.any(normal):
            normal = rng.standard_normal(sample.shape[1])
        normal = normal / np.linalg.norm(normal)
        along = x @ normal if len(own) else np.zeros(0)
        cut = float(np.median(along)) if len(own) else 0.0
        right = along >= cut
        attach(where, len(cuts))
        me = len(cuts)
        normals.append(normal), cuts.append(cut), children.append([0, 0])
        for side, part in ((0, own[~right]), (1, own[right])):
            tie += 1
            heapq.heappush(heap, (share * (len(part) / len(own) if len(own) > 1 else 0.5), tie, part, (me, side)))
        n_leaves += 1
    for _, _, _, where in heap:
        attach(where, -1)
    leaf, todo = 0, [0] if cuts else []
    while todo:  # leaves are numbered from left to right, so that neighbours have one parent
        node = todo.pop()
        if isinstance(node, tuple):
            children[node[0]][node[1]], leaf = -1 - leaf, leaf + 1
        else:
            todo += [child if child >= 0 else (node, side) for side, child in ((1, children[node][1]), (0, children[node][0]))]
    return Tree(np.array(normals).reshape(len(cuts), sample.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(len(cuts), 2))


def search(forest: list[Tree], q: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the `leaves` most promising leaves of all trees, by one queue."""
    queue: list = []
    for t, tree in enumerate(forest):
        heapq.heappush(queue, (0.0, t, 0 if len(tree.cuts) else -1))
    margins = [tree.normals @ q - tree.cuts if len(tree.cuts) else None for tree in forest]
    out: list[tuple[int, int]] = []
    while queue and len(out) < leaves:
        crossed, t, node = heapq.heappop(queue)
        while node >= 0:
            m = margins[t][node]
            near, far = (1, 0) if m >= 0 else (0, 1)
            heapq.heappush(queue, (crossed + m * m, t, int(forest[t].children[node, far])))
            node = int(forest[t].children[node, near])
        out.append((t, -1 - node))
    return out


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more coordinate, which gives them all the squared length `longest`."""
    return np.column_stack([x, np.sqrt(np.maximum(0, longest - np.einsum("ij,ij->i", x, x)))])


def measured_share(sample: np.ndarray, longest: float, k: int, trees: int, leaf_rows: int, recall: float, rng: np.random.Generator, queries: int = MEASURED) -> float:
    """Leaves to visit, as a share of one tree's leaves, for the recall of the k nearest within the sample."""
    n_leaves = -(-len(sample) // leaf_rows)
    if n_leaves < 2:
        return float(trees)
    points = lifted(sample, longest)
    forest = [grow(points, n_leaves, rng) for _ in range(trees)]
    leaf_of = np.stack([tree.leaves(points) for tree in forest])
    reached = []
    for i in rng.permutation(len(sample))[:queries].tolist():
        scores = sample @ sample[i]
        scores[i] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        when = np.full((trees, n_leaves), trees * n_leaves)
        for at, (t, leaf) in enumerate(search(forest, np.append(sample[i], 0.0), trees * n_leaves)):
            when[t, leaf] = at + 1
        reached.append(np.min([when[t][leaf_of[t][best]] for t in range(trees)], axis=0))
    return float(np.quantile(np.concatenate(reached), recall)) / n_leaves


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the vectors that take part; one for each vec_id."""
    v = F.col("embedding")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return rows.where(fine).where(F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, keep: int, salts: int = 32) -> DataFrame:
    """u (its least vec_id), v, ids (the `keep` least vec_ids) of each distinct vector; large groups are thinned in two steps, by order alone."""
    keyed = rows.withColumn("u", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    first = Window.partitionBy("u", "v", "salt").orderBy("vec_id")
    thin = keyed.withColumn("k", F.row_number().over(first)).where(F.col("k") <= keep).drop("k", "salt")
    return thin.groupBy("u", "v").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, keep).alias("ids")).select(F.col("ids")[0].alias("u"), "v", "ids")


@dataclass
class Forest:
    trees: list[Tree]
    n_leaves: int
    longest: float
    dim: int
    kind: str
    leaves_per_branch: int

    def index(self, unique: DataFrame, trees: int) -> DataFrame:
        """tree, branch, leaf, u, v: each vector once for each of the first `trees` trees."""
        forest, longest, dim, per = self.trees[:trees], self.longest, self.dim, self.leaves_per_branch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = lifted(batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim), longest)
                    for t, tree in enumerate(forest):
                        leaf = tree.leaves(x)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf // per), pa.array(leaf), *batch.columns], ["tree", "branch", "leaf", "u", "v"])

        return unique.select("u", "v").mapInArrow(run, f"tree int, branch long, leaf long, u long, v {self.kind}")

    def visits(self, asked: DataFrame, trees: int, leaves: int) -> DataFrame:
        """tree, branch, qu, q, leaves: each query once for each branch that it visits, with its leaves there."""
        forest, dim, per = self.trees[:trees], self.dim, self.leaves_per_branch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                    rows, tree, branch, taken = [], [], [], []
                    for i, q in enumerate(batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim)):
                        got = np.array(sorted(search(forest, np.append(q, 0.0), leaves)), np.int64)
                        key = got[:, 0] * (1 << 40) + got[:, 1] // per
                        for own in np.split(got, np.flatnonzero(np.diff(key)) + 1):
                            rows.append(i), tree.append(int(own[0, 0])), branch.append(int(own[0, 1]) // per), taken.append(own[:, 1])
                    yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(branch, pa.int64()), *(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(taken, pa.list_(pa.int64()))], ["tree", "branch", "qu", "q", "leaves"])

        return asked.select("qu", "q").mapInArrow(run, f"tree int, branch long, qu long, q {self.kind}, leaves array<long>")


class Branch:
    """The vectors of a branch, each in its leaf."""

    def __init__(self, rows: list[pa.RecordBatch], leaves_per_branch: int):
        table = pa.Table.from_batches(rows)
        order = np.argsort(table["id"].to_numpy(), kind="stable")  # so that ties go to the smaller id
        self.u, self.leaves = table["id"].to_numpy()[order], leaves_per_branch
        self.place = table["leaf"].to_numpy()[order] % leaves_per_branch
        self.v = table["x"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(order), -1)[order]

    def nearest(self, q: np.ndarray, visited: list[list[int]], k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(row of q, ids, scores) of the k + 1 nearest of each query, among the leaves that it visits."""
        seen = np.zeros((len(q), self.leaves), bool)
        for i, leaves in enumerate(visited):
            seen[i, np.asarray(leaves, np.int64) % self.leaves] = True
        near = np.where(seen[:, self.place], q @ self.v.T, -np.inf)
        m = min(len(self.v), k + 1)
        least = np.partition(near, len(self.v) - m, axis=1)[:, len(self.v) - m]
        out = []
        for i in range(len(q)):
            best = np.flatnonzero((near[i] >= least[i]) & (near[i] > -np.inf))
            if len(best) > m:
                above = near[i][best] > least[i]
                best = np.concatenate([best[above], best[~above][: m - np.count_nonzero(above)]])
            if len(best):
                out.append((i, self.u[best], np.einsum("j,kj->k", q[i], self.v[best])))
        return out


def comparer(k: int, leaves_per_branch: int):
    """For rows (tree, branch, kind, id, leaf, x, leaves) sorted so that a branch's vectors stand before its queries: holds one branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, branch = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            cuts = [0, *(np.flatnonzero(np.any(np.diff(key, axis=1), axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if tuple(key[:2, a]) != now:
                    now, held, branch = tuple(key[:2, a]), [], None
                if key[2, a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if branch is None and held:
                    branch, held = Branch(held, leaves_per_branch), []
                for at in range(a, b if branch is not None else a, QUERY_ROWS):
                    part = batch.slice(at, min(QUERY_ROWS, b - at))
                    q = part.column(5).flatten().to_numpy().astype(np.float64).reshape(part.num_rows, -1)
                    found = branch.nearest(q, part.column(6).to_pylist(), k)
                    ids = part.column(3).take(pa.array([i for i, _, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([u for _, u, _ in found], pa.list_(pa.int64())), pa.array([x for _, _, x in found], pa.list_(pa.float64()))], ["qu", "us", "scores"])

    return run


def merger(k: int):
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        """The nearest of one query's branches; a vector found in two trees has one score."""
        u, score = np.concatenate(rows["us"].to_list()), np.concatenate(rows["scores"].to_list())
        u, first = np.unique(u, return_index=True)
        order = np.lexsort((u, -score[first]))[: k + 1]
        return pd.DataFrame({"qu": rows["qu"].iloc[0], "u": u[order], "score": score[first][order]})

    return merge


def searched(forest: Forest, unique: DataFrame, asked: DataFrame, k: int, trees: int, leaves: int) -> DataFrame:
    """qu, u, score: the nearest entries found, k + 1 where there are as many."""
    spread = asked.repartition(blocks_for(asked.count(), 256), "qu")  # walking the trees is work for many tasks
    none = F.lit(None)
    queries = forest.visits(spread, trees, leaves).select("tree", "branch", F.lit(1).alias("kind"), F.col("qu").alias("id"), none.cast("long").alias("leaf"), F.col("q").alias("x"), "leaves")
    vectors = forest.index(unique, trees).select("tree", "branch", F.lit(0).alias("kind"), F.col("u").alias("id"), "leaf", F.col("v").alias("x"), none.cast("array<long>").alias("leaves"))
    branches = blocks_for(forest.n_leaves, forest.leaves_per_branch) * trees
    met = vectors.unionByName(queries).repartition(branches, "tree", "branch").sortWithinPartitions("tree", "branch", "kind")
    near = met.mapInArrow(comparer(k, forest.leaves_per_branch), "qu long, us array<long>, scores array<double>")
    return near.groupBy("qu").applyInPandas(merger(k), "qu long, u long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, share: float | None = None, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors but itself.

    share: of one tree's leaves to visit, in all trees together; None: as measured for `recall`."""
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType.simpleString()
    unique = stored(distinct_vectors(clean(vectors), k + 1), "vectors")
    stats = unique.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "dim").first()
    if stats is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, longest = stats.dim, stats.n, stats.top * (1 + 1e-12)
    unique = unique.where(F.size("v") == dim)

    sample = unique.orderBy(F.xxhash64("u", F.lit(seed)), "u").limit(sample_rows).select("v").toArrow()
    sample = np.array(sample["v"].to_pylist(), np.float64).reshape(-1, dim)
    rng = np.random.default_rng(seed)
    n_leaves = min(MOST_LEAVES, max(1, -(-n // leaf_rows)))
    share = measured_share(sample, longest, k, trees, leaf_rows, recall, rng) if share is None else share
    points = lifted(sample, longest)
    forest = Forest([grow(points, n_leaves, rng) for _ in range(trees)], n_leaves, longest, dim, kind, max(1, BRANCH_ROWS * n_leaves // n))

    wanted = clean(queries).where(F.size("v") == dim).withColumn("qu", F.xxhash64("v"))
    wanted = stored(wanted, "queries")
    asked = stored(wanted.groupBy("qu").agg(F.first("v").alias("q")), "asked")
    found = stored(searched(forest, unique, asked, k, trees, min(trees * n_leaves, max(1, round(share * n_leaves)))), "found")
    enough = found.join(unique.select("u", F.size("ids").alias("c")), "u").groupBy("qu").agg(F.sum("c").alias("c")).where(F.col("c") > k)
    few = stored(asked.join(enough, "qu", "left_anti"), "few")
    if n_leaves > 1 and not few.isEmpty():  # a tree's leaves hold every vector once
        more = searched(forest, unique, few, k, 1, n_leaves)
        found = found.join(few, "qu", "left_anti").unionByName(stored(more, "found"))
    found = stored(found.join(unique.select("u", "ids"), "u").select("qu", "score", "ids"), "found")
    pairs = wanted.select(F.col("vec_id").alias("query_id"), "qu").join(found, "qu").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
