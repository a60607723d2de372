"""Quality classification by importance resampling.

Two generative models over hashed n-grams are compared: one of target text (documents labelled as
good), one of the raw corpus (all documents). The importance weight of a document is the ratio of
its probabilities under the two, and documents are drawn without replacement in proportion to
their weights by Gumbel top-k: the k largest of log weight / temperature + Gumbel noise stay. The
noise is seeded by doc_id, so reruns agree; at the default temperature of 1 the draw is by weight.

How many are drawn is an argument: k documents, or a share of those with a word. Without either, k
is an estimate of how many are target-like: with a fraction p of good ones among all labels, p
times the weight is the probability that a document is, and k counts those with `least` or more.

N-grams are of three views, so that junk shows at any corpus size: words, pairs of words, and
triples of word shapes (case, digits, symbols, end mark, same word as before).

The raw model counts all documents; the target model counts at most `target_docs` labelled ones
(the lowest hashes of doc_id). Each task adds its counts up before they are exchanged; what reaches
the driver has the models' fixed size. The threshold of the top k is found exactly by counting
digits of the keys, without sorting them in one place.

Defined results: null and empty texts have no n-grams and are rejected; rows that repeat a doc_id
and text get the same key, rows that share a doc_id the same noise and label, and a null doc_id is
never labelled; ties at the threshold all stay; without any good label, nothing is known and every
document with a word stays; texts of any length are read whole, in slices of about 2^19 characters of
whole texts; an empty table gives an empty result; other columns are passed through by `select`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own, pieces, stored
from .hashing import BY_SPACE, chained, mix, spans, words_of

BUCKET_BITS = 15
VIEWS = 3
SIZE = VIEWS << BUCKET_BITS

_b = np.arange(256)
#: Bits for what a byte is: lower-case letter or beyond ASCII, upper-case letter, digit, mark of prose, any other symbol.
KINDS = np.select([(_b >= 97) & (_b < 123) | (_b >= 128), (_b >= 65) & (_b < 91), (_b >= 48) & (_b < 58), np.isin(_b, [*b".,;:'\"!?()-"])], [1, 2, 4, 8], 16).astype(np.uint8)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and each text's offsets among them."""
    words = words_of(texts, BY_SPACE)
    if not len(words.hashes):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = KINDS[words.data]
    kind[BY_SPACE[words.data] == 0] = 0
    kind = kind[: words.starts[-1] + words.lengths[-1]]
    shape = np.bitwise_or.reduceat(kind, words.starts).astype(np.uint64)
    same = np.concatenate([[False], words.hashes[1:] == words.hashes[:-1]])
    same[words.offsets[:-1][np.diff(words.offsets) > 0]] = False  # a text's first word has none before it
    flags = kind[words.starts + words.lengths - 1] == 8, kind[words.starts] == 2, same, words.lengths > 1
    for k, flag in enumerate(flags):
        shape |= flag.astype(np.uint64) << np.uint64(5 + k)
    low = np.uint64((1 << BUCKET_BITS) - 1)
    pairs, pair_at = spans(words.offsets, 2)
    triples, triple_at = spans(words.offsets, 3)
    parts = (words.hashes, words.offsets), (chained(words.hashes, pairs, 2), pair_at), (chained(mix(shape), triples, 3), triple_at)
    n = sum(np.diff(o) for _, o in parts)
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(int(offsets[-1]), np.int64)
    begin = offsets[:-1].copy()
    for view, (h, o) in enumerate(parts):
        k = np.diff(o)
        out[np.arange(int(o[-1])) - np.repeat(o[:-1], k) + np.repeat(begin, k)] = (h & low).astype(np.int64) + (view << BUCKET_BITS)
        begin += k
    return out, offsets


def slices(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about `most` characters: the place of the first, and the texts."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= most or i == len(texts) - 1:
            yield at, held
            at, held, size = i + 1, [], 0


@dataclass
class Model:
    """log_ratio: of each bucket, target over raw, for documents outside [0] and inside [1] the target sample;
    share: of target-like documents in the corpus; chosen: doc_id, target of the sample."""

    log_ratio: np.ndarray
    share: float
    chosen: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"chosen": None}  # tasks need the numbers alone

    def flagged(self, docs: DataFrame) -> DataFrame:
        """docs with one more column, whether a document is of the sample, the size of which is bounded."""
        name, flag, target = own(docs.columns, "chosen_id", "chosen", "target")
        chosen = self.chosen.select(F.col("doc_id").alias(name), F.col("target").alias(flag))
        joined = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col(name), "left")
        return joined.select(*docs.columns, F.coalesce(flag, F.lit(False)).alias(target))

    def log_weights(self, texts: list[str | None], target: np.ndarray) -> np.ndarray:
        """-inf for texts without a word."""
        out = []
        for at, some in slices(texts):
            grams, offsets = ngrams(some)
            inside = np.repeat(target[at : at + len(some)].astype(np.int64), np.diff(offsets))
            sums = np.concatenate([[0.0], np.cumsum(self.log_ratio[inside, grams])])
            out.append(np.where(np.diff(offsets) > 0, sums[offsets[1:]] - sums[offsets[:-1]], -np.inf))
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, target_docs: int = 20_000, smoothing: float = 10.0) -> Model:
    """docs: doc_id, text; labels: doc_id, quality (1: good)."""
    graded = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = graded.agg(F.count("*").alias("all"), F.count_if(F.col("quality") == 1).alias("good")).first()
    chosen = graded.where("quality = 1").select("doc_id", F.lit(True).alias("target")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs)
    model = Model(np.zeros((2, SIZE)), n.good / n.all if n.good else 1.0, stored(chosen, "quality-sample"))
    flagged = model.flagged(docs.select("doc_id", "text")).drop("doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for batch in pieces(batches):
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for at, some in slices(batch.column(0).to_pylist()):
                grams, offsets = ngrams(some)
                raw += np.bincount(grams, minlength=SIZE)
                target += np.bincount(grams[np.repeat(good[at : at + len(some)], np.diff(offsets))], minlength=SIZE)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counts = flagged.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = (np.zeros(SIZE) for _ in range(2))
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    for view in range(VIEWS):
        part = slice(view << BUCKET_BITS, (view + 1) << BUCKET_BITS)
        scale = target[part].sum() / max(1, raw[part].sum())
        if scale:  # an occurrence is no evidence about its own document, so it is left out of what it is held against
            expected = np.maximum(0, raw[part] - 1) * scale + smoothing
            model.log_ratio[0, part] = np.log((target[part] + smoothing) / expected)
            model.log_ratio[1, part] = np.log((np.maximum(0, target[part] - 1) + smoothing) / expected)
    return model


#: The probability from which a document counts as target-like, where k isn't given.
LEAST = 0.1
TEMPERATURE = 1.0
SEED = 11


def gumbel(doc_ids: list[int | None], seed: int) -> np.ndarray:
    ids = np.array([0 if i is None else i for i in doc_ids], np.int64).view(np.uint64)
    u = (mix(ids * np.uint64(2) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) + 0.5
    return -np.log(-np.log(u / 2.0**53))


def sortable(keys: np.ndarray) -> np.ndarray:
    """Long integers in the order of the doubles."""
    bits = (keys + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def scores(docs: DataFrame, model: Model, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, log_weight, key (sortable long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column(0).to_pylist()
            w = model.log_weights(batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(sortable(w / temperature + gumbel(ids, seed)))], ["doc_id", "log_weight", "key"])

    return model.flagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, log_weight double, key long")


def kth_largest(df: DataFrame, col: str, k: int) -> int | None:
    """The exact k-th largest long, by counting 16 bits at a time; at most 65,536 counts reach the driver."""
    if k <= 0:
        return None
    prefix = None
    for shift in (48, 32, 16, 0):
        rows = df if prefix is None else df.where(F.shiftright(F.col(col), shift + 16) == prefix)
        counts = {r.digit: r.n for r in rows.groupBy(F.shiftright(F.col(col), shift).alias("digit")).agg(F.count("*").alias("n")).collect()}
        for digit in sorted(counts, reverse=True):
            if counts[digit] >= k:
                prefix = digit
                break
            k -= counts[digit]
    return prefix


def resample(scored: DataFrame, model: Model, k: int | None = None, share: float | None = None, least: float = LEAST) -> int | None:
    """The threshold: keys at or above it are drawn. k, share: how many to draw; neither: as many as are target-like with a probability of `least`."""
    real = scored.where(F.col("log_weight") > float("-inf"))
    n = real.count()
    if k is None:
        k = round(share * n) if share is not None else real.where(F.col("log_weight") >= math.log(least / model.share)).count()
    return kth_largest(real, "key", min(k, n))


def kept(threshold: int | None):
    return (F.col("log_weight") > float("-inf")) & (F.lit(False) if threshold is None else F.col("key") >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, seed: int = SEED, temperature: float = TEMPERATURE, **how) -> DataFrame:
    """doc_id, log_weight, kept for every row of docs. Further options: see `fit`."""
    model = fit(docs, labels, **how)
    scored = stored(scores(docs, model, seed, temperature), "scores")
    return scored.select("doc_id", F.when(F.col("log_weight") > float("-inf"), F.col("log_weight")).alias("log_weight"), kept(resample(scored, model, k, share)).alias("kept"))


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, share: float | None = None, seed: int = SEED, temperature: float = TEMPERATURE, **how) -> DataFrame:
    """The rows of docs that are drawn, with their columns as they were. Texts are scored once more rather than shuffled."""
    model = fit(docs, labels, **how)
    threshold = resample(stored(scores(docs, model, seed, temperature), "scores"), model, k, share)
    columns = docs.columns
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = model.log_weights(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            keep = np.isfinite(w) & (threshold is not None)
            if keep.any():
                keep &= sortable(w / temperature + gumbel(batch.column(id_at).to_pylist(), seed)) >= threshold
            yield batch.select(columns).filter(pa.array(keep))

    return model.flagged(docs).mapInArrow(run, docs.schema)
