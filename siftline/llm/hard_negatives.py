"""Hard negatives by a vector-approximation file: table look-ups first, exact inner products for what is left.

Vectors are whole numbers: floor(scale * x) (`scaled`). Each dimension is quantised into `cells` cells, whose inner
edges are quantiles of a bounded sample (`sample_rows`, the lowest hashes of vec_id) and whose outer
edges are the least and largest component of all vectors, so that bounds hold for every row. The
approximation of a vector is a byte for each dimension. For an anchor, a table holds what a cell of a
dimension adds to the inner product at least and at most; a row's lower and upper bound are sums of
looked-up entries. Only rows whose bounds let them enter are scored exactly:

* positives: rows of the anchor's label whose upper bound reaches the `positives`-th best score yet;
* negatives: rows of another label whose bounds meet the window of one of the anchor's positives
  (low_pct * positive <= 100 * negative <= high_pct * positive) and whose upper bound reaches the
  `negatives`-th best score found in that window yet.

Rows whose bounds lie wholly inside a window raise that mark by their lower bounds, before any is scored.

Rows are dealt into slices of about `slice_rows`; a task holds one slice, and the anchors stream past
it in batches: rows never move again, anchors (the small side) once a slice. Each slice gives its best
few for an anchor, and these few are ranked over all slices. The second pass begins once the first
has fixed the positives. Bounds are sums of whole numbers, so nothing within them is lost; the result
is that of comparing every anchor with every row.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no
part, nor do vectors of another length than the longest, or with a component of 2^17 or more in size
(their products wouldn't be exact in 64 bits); an anchor never meets itself, but rows that repeat its vec_id count as others; ties go to the smaller
vec_id, null last; an anchor without positives, or a positive without negatives in its window, gives
no row; a negative positive score leaves its window empty; no anchors or rows give an empty result;
other columns are ignored. Texts don't occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, stored

CELLS, SAMPLE_ROWS, SLICE_ROWS = 64, 32_768, 16_384
POSITIVES, NEGATIVES, LOW_PCT, HIGH_PCT = 5, 5, 80, 100
#: Rows and anchors of one table look-up.
CHUNK, BATCH = 2048, 64
#: Components at or above this in size take no part.
LARGEST = float(1 << 17)
LEAST = np.iinfo(np.int64).min


def scaled(vectors: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """r (a number of its own), vec_id, label, v (whole numbers), anchor of the rows that take part; a stored table."""
    raw = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").alias("v")).where("label IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST)))
    rows = raw.where(fine).select("vec_id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = stored(rows, "vectors")
    length = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return stored(rows.where(F.size("v") == length).select(F.monotonically_increasing_id().alias("r"), "*"), "vectors")


class Cells:
    """Cell c of dimension d holds the whole numbers from edges[d, c] to edges[d, c + 1] - 1."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, cells: int = CELLS):
        inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="lower").astype(np.int64).T
        inner = np.clip(inner, least[:, None], most[:, None] + 1)
        self.edges = np.column_stack([least, inner, most + 1])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A byte for each dimension, as columns."""
        return np.stack([np.searchsorted(e[1:-1], x[:, d], side="right") for d, e in enumerate(self.edges)]).astype(np.uint8)

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What cell c of dimension d adds to the inner product with anchor a, at least and at most: [d, c, a]."""
        first, last = self.edges[:, :-1, None], np.maximum(self.edges[:, 1:, None] - 1, self.edges[:, :-1, None])
        a, b = first * anchors.T[:, None, :], last * anchors.T[:, None, :]
        return np.minimum(a, b), np.maximum(a, b)

    def bounds(self, codes: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, rows by anchors."""
        return tuple(sum(table[d][codes[d]] for d in range(len(codes))) for table in tables)


def fitted(rows: DataFrame, cells: int, sample_rows: int, seed: int) -> Cells | None:
    extremes = rows.select(F.posexplode("v")).groupBy("pos").agg(F.min("col").alias("a"), F.max("col").alias("b")).orderBy("pos").collect()  # a row for each dimension
    if not extremes:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "r").limit(sample_rows).select("v").toArrow()
    return Cells(matrix(sample["v"].combine_chunks()), *(np.array([e[k] for e in extremes], np.int64) for k in (1, 2)), cells)


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


class Slice:
    """The rows of one slice, and the search of anchors among them."""

    def __init__(self, batches: list[pa.RecordBatch], cells: Cells):
        rows = pa.Table.from_batches(batches)
        vec_id = rows["vec_id"].combine_chunks()
        self.known = ~np.asarray(vec_id.is_null())
        self.id = vec_id.fill_null(0).to_numpy()
        order = np.lexsort((rows["r"].to_numpy(), self.id, ~self.known))  # so that ties go to the smaller id
        self.id, self.known, self.r, self.label, self.v = self.id[order], self.known[order], rows["r"].to_numpy()[order], rows["label"].to_numpy()[order], matrix(rows["v"].combine_chunks())[order]
        self.cells, self.codes = cells, cells.codes(self.v)
        self.scored = 0

    def exact(self, at: np.ndarray, who: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        self.scored += len(at)
        return np.einsum("ij,ij->i", self.v[at], anchors[who])

    def searched(self, anchors: np.ndarray, may: list, top: int, windows: list[tuple[np.ndarray, np.ndarray]]) -> list[list[tuple[int, int, int]]]:
        """For each anchor (row, window, score) of the `top` best rows in each of its windows (least, most), best first.

        may: for a range of rows, which of them an anchor may meet."""
        tables = self.cells.tables(anchors)
        n, n_windows = len(anchors), max(len(w[0]) for w in windows)
        least, most = np.full((n, n_windows), np.iinfo(np.int64).max), np.full((n, n_windows), LEAST)
        for a, (low, high) in enumerate(windows):
            least[a, : len(low)], most[a, : len(high)] = low, high
        reach = np.full((n, n_windows), LEAST)  # the top-th best score yet
        kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for at in range(0, len(self.r), CHUNK):
            low, high = self.cells.bounds(self.codes[:, at : at + CHUNK], tables)
            free, hit = may(slice(at, at + CHUNK)), np.zeros(low.shape, bool)
            for w in range(n_windows):
                if len(low) >= top:  # rows surely inside the window hold the top-th best at least at their lower bounds
                    sure = np.where(free & (low >= least[:, w]) & (high <= most[:, w]), low, LEAST)
                    reach[:, w] = np.maximum(reach[:, w], np.partition(sure, len(sure) - top, axis=0)[len(sure) - top])
                hit |= (high >= np.maximum(least[:, w], reach[:, w])) & (low <= most[:, w])
            rows, who = np.nonzero(hit & free)
            score = self.exact(rows + at, who, anchors)
            for w in range(n_windows):
                fits = (score >= least[who, w]) & (score <= most[who, w]) & (score >= reach[who, w])
                for a in np.unique(who[fits]).tolist():
                    mine = fits & (who == a)
                    best = kept.get((a, w), []) + list(zip((-score[mine]).tolist(), (rows[mine] + at).tolist()))
                    best.sort()  # rows stand in the order of ids
                    kept[a, w] = best = best[:top]
                    if len(best) == top:
                        reach[a, w] = -best[-1][0]
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for (a, w), best in sorted(kept.items()):
            out[a] += [(i, w, -s) for s, i in best]
        return out


def streamed(cells: Cells, give):
    """For rows sorted by slice, a slice's own rows before its anchors: holds one slice, yields give(slice, batch of anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = np.flatnonzero(np.any(np.diff(key, axis=1), axis=0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key[0, a] != now:
                    now, held, ready = key[0, a], [], None
                if key[1, a] == 0:
                    held.append(part)
                elif held or ready:
                    if ready is None:
                        ready, held = Slice(held, cells), []
                    for at in range(0, part.num_rows, BATCH):
                        yield give(ready, part.slice(at, BATCH))

    return run


def dealt(rows: DataFrame, anchors: DataFrame, slices: int) -> DataFrame:
    """slice, kind (0 a row, 1 an anchor), r, vec_id, label, v, scores: rows in their slice, anchors in every slice."""
    own = rows.select(F.pmod(F.xxhash64("r"), F.lit(slices)).alias("slice"), F.lit(0).alias("kind"), "r", "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("scores"))
    every = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(1).alias("kind"), "r", "vec_id", "label", "v", "scores")
    return own.unionByName(every).repartition(slices, "slice").sortWithinPartitions("slice", "kind")


def found(rows: list[list[tuple[int, int, int]]], anchors: pa.RecordBatch, own: Slice, names: tuple[str, str]) -> pa.RecordBatch:
    flat = [(a, *x) for a, got in enumerate(rows) for x in got]
    who, at, window, score = (np.array([x[k] for x in flat], np.int64) for k in range(4))
    ids = pa.array(own.id[at], pa.int64(), mask=~own.known[at])
    return pa.RecordBatch.from_arrays([anchors.column(2).take(pa.array(who)), pa.array(window), ids, pa.array(own.r[at], pa.int64()), pa.array(score)], ["anchor", "window", *names, "score"])


def best(pairs: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "r")
    return pairs.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)


def hard_negatives(vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES, low_pct: int = LOW_PCT, high_pct: int = HIGH_PCT, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, slice_rows: int = SLICE_ROWS, seed: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: which rows of vectors are anchors."""
    spark = vectors.sparkSession
    rows = scaled(vectors, anchor, scale)
    grid = fitted(rows, cells, sample_rows, seed)
    if grid is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    slices = blocks_for(rows.count(), slice_rows)
    anchors = rows.where("anchor").drop("anchor")
    kind = "anchor long, window long, vec_id long, r long, score long"

    def same_label(own: Slice, part: pa.RecordBatch) -> pa.RecordBatch:
        label, r = part.column(4).to_numpy(), part.column(2).to_numpy()
        open_ = [(np.array([LEAST]), np.array([np.iinfo(np.int64).max]))] * len(r)
        return found(own.searched(matrix(part.column(5)), lambda s: (own.label[s, None] == label) & (own.r[s, None] != r), positives, open_), part, own, ("vec_id", "r"))

    near = dealt(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), slices).mapInArrow(streamed(grid, same_label), kind)
    near = stored(best(near, ["anchor"], positives).select("anchor", F.struct("k", "score", "vec_id").alias("p")), "positives")
    chosen = near.groupBy("anchor").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # at most `positives` of them
    held = stored(anchors.join(chosen, anchors.r == chosen.anchor).select(anchors["*"], F.transform("ps", lambda p: p["score"]).alias("scores"), F.transform("ps", lambda p: p["vec_id"]).alias("ids")), "anchors")

    def other_label(own: Slice, part: pa.RecordBatch) -> pa.RecordBatch:
        label, windows = part.column(4).to_numpy(), []
        for s in part.column(6).to_pylist():
            s = np.array(s, np.int64)
            windows.append((-(-low_pct * s // 100), high_pct * s // 100))  # the least and largest whole numbers within
        return found(own.searched(matrix(part.column(5)), lambda x: own.label[x, None] != label, negatives, windows), part, own, ("vec_id", "r"))

    far = dealt(rows, held.drop("ids"), slices).mapInArrow(streamed(grid, other_label), kind)
    far = best(far, ["anchor", "window"], negatives).select("anchor", "window", "k", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = far.join(held.select(F.col("r").alias("anchor"), F.col("vec_id").alias("anchor_id"), "ids", "scores"), "anchor")
    at = F.col("window").cast("int")
    return joined.select("anchor_id", F.get("ids", at).alias("positive_id"), F.col("k").cast("int").alias("rank"), "negative_id", F.get("scores", at).alias("positive_score"), "negative_score")
