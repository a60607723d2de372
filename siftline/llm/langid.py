"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters counts as one space, and its n-grams of one to three
characters fall into hashed buckets. A bucket's weight in a text is its share of the text's
n-grams times its inverse document frequency, which is counted over all documents that may be
learnt from. The regression is trained with follow-the-regularised-leader updates (a step size of
its own for every weight) under an elastic net, whose absolute part leaves most weights at zero.
Shards of the training sample are trained side by side and their weights averaged. Finally one
temperature, fitted on documents that the training left out, scales the scores so that they can be
read as probabilities.

Sample: at most `per_lang` documents of a language (the lowest hashes of doc_id), a fifth of them
for the temperature. Model and counts have a size fixed by buckets and languages; nothing else
reaches the driver. Whole texts are read, however long.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if
there is nothing to learn from; with one language, all others have score 1; rows that repeat a
doc_id are rows of their own; a null doc_id isn't learnt from and isn't held out; ties go to the
language that is first in order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stored
from .hashing import spans
from .quality import slices

BITS = 16
SIZE = 1 << BITS
WIDTHS = (1, 2, 3)
SCALE = 16.0
UNKNOWN = "und"
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, each text's offsets among them, and whether it has a letter."""
    raw = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    points = np.frombuffer(b"".join(raw), np.uint32)
    ends = np.cumsum([len(r) // 4 for r in raw])
    is_letter = letters()[points]
    seen = np.concatenate([[0], np.cumsum(is_letter)])
    has = seen[ends] > seen[np.concatenate([[0], ends[:-1]])]
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])
    keep[np.concatenate([[0], ends[:-1]])] = True  # a text's first space
    kept = np.concatenate([[0], np.cumsum(keep)])
    chars = np.where(is_letter, points, 32)[keep].astype(np.uint64)
    offsets = np.concatenate([[0], kept[ends]])
    parts = []
    for n in WIDTHS:
        at, place = spans(offsets, n)
        h = chars[at] * MULTIPLIERS[0]
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) * MULTIPLIERS[k] + chars[at + k] * MULTIPLIERS[0]
        h = (h + np.uint64(n)) * MULTIPLIERS[1]
        parts.append(((h >> np.uint64(64 - BITS)).astype(np.int32), place))
    n = sum(np.diff(place) for _, place in parts)
    whole = np.concatenate([[0], np.cumsum(n)])
    out, begin = np.empty(int(whole[-1]), np.int32), whole[:-1].copy()
    for h, place in parts:
        k = np.diff(place)
        out[np.arange(len(h)) - np.repeat(place[:-1], k) + np.repeat(begin, k)] = h
        begin += k
    return out, whole, has


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # bucket, language; the inverse document frequency is in it
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        grams, offsets, has = ngrams(texts)
        n = np.maximum(1, np.diff(offsets))
        sums = np.stack([np.add.reduceat(w[grams], offsets[:-1]) for w in self.weights.T], axis=1) if len(grams) else np.zeros((len(texts), len(self.langs)))
        return sums * (SCALE / n)[:, None], has

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], []
        for _, some in slices(texts, 1 << 18):
            z, has = self.logits(some)
            z = z / self.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            langs += [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, has, strict=True)]
            scores.append(np.where(has, p[np.arange(len(p)), best], 0.0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


class Ftrl:
    """Follow-the-regularised-leader for a multinomial model; weights are worked out from the sums z and n when a text needs them."""

    def __init__(self, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """text, lang, rank of at most per_lang documents of each language, those with the lowest hashes.

    Languages are counted first, and only documents below a hash that leaves hardly more than per_lang of each are
    ranked, so no task ranks more than that however large a language is. Rows that share a doc_id have hashes of their own."""
    steps = 1 << 30
    counts = stored(docs.groupBy("lang").agg(F.count("*").alias("n")), "languages")  # a row for each language
    some = F.least(F.lit(1.0), F.lit(per_lang + 8 * per_lang**0.5) / F.col("n"))
    limits = F.broadcast(counts.select(F.col("lang").alias("name"), (some * steps).cast("long").alias("limit")))
    keyed = docs.select("text", "lang", F.xxhash64("doc_id", "text").alias("o"))
    low = keyed.join(limits, F.col("lang") == F.col("name")).where(F.pmod(F.shiftright("o", 8), F.lit(steps)) <= F.col("limit"))
    order = Window.partitionBy("lang").orderBy(F.pmod(F.shiftright("o", 8), F.lit(steps)), "o")
    return low.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang).select("text", "lang", "rank")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each bucket, and documents, over all of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, mark = np.zeros(SIZE + 1, np.int64), 0, np.zeros(SIZE, np.uint8)
        for batch in pieces(batches):
            for _, some in slices(batch.column(0).to_pylist(), 1 << 18):
                grams, offsets, _ = ngrams(some)
                n += len(some)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if b - a < 2000:
                        df[np.unique(grams[a:b])] += 1
                    else:
                        mark[grams[a:b]] = 1
                        df[:SIZE] += mark
                        mark[grams[a:b]] = 0
        df[SIZE] = n
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(df[used])], ["bucket", "df"])

    rows = docs.select("text").mapInArrow(count, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(SIZE + 1, np.int64)
    df[rows.bucket] = rows.df
    return df[:SIZE], int(df[SIZE])


def fit(docs: DataFrame, per_lang: int = 2500, shards: int = 8, epochs: int = 3, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.02, l2: float = 0.01) -> Model | None:
    """docs: doc_id, text, lang of the documents to learn from."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    picked = stored(sample(docs, per_lang), "lang-sample")
    langs = [r.lang for r in picked.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    code = {x: i for i, x in enumerate(langs)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, ranks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, some in slices(batch.column(0).to_pylist(), 1 << 18):
                grams, offsets, _ = ngrams(some)
                at, x = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    own, counts = np.unique(grams[a:b], return_counts=True)
                    at.append(own)
                    x.append((counts * idf[own] * (SCALE / max(1, b - a))).astype(np.float32))
                upto = first + len(some)
                yield pa.RecordBatch.from_arrays([pa.array([code[y] for y in names[first:upto]], pa.int32()), pa.array(ranks[first:upto], pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], ["label", "rank", "at", "x"])

    rows = stored(picked.mapInArrow(features, "label int, rank int, at array<int>, x array<float>"), "lang-features")
    classes = len(langs)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        model = Ftrl(classes, alpha, beta, l1, l2)
        rows = rows.sort_values(["rank", "label"])
        for _ in range(epochs):
            for label, at, x in zip(rows["label"], rows["at"], rows["x"], strict=True):
                model.learn(at, x.astype(np.float64), label)
        w = model.weights(slice(None))
        at, label = np.nonzero(w)
        return pd.DataFrame({"at": at.astype(np.int32), "label": label.astype(np.int32), "w": w[at, label]})

    shard = (F.floor(F.col("rank") / 5) % shards).alias("shard")
    trained = rows.where("rank % 5 <> 0").select(shard, "rank", "label", "at", "x").groupBy("shard").applyInPandas(train, "at int, label int, w double")
    used = max(1, rows.where("rank % 5 <> 0").select(shard).distinct().count())
    means = trained.groupBy("at", "label").agg((F.sum("w") / used).alias("w")).toPandas()
    weights = np.zeros((SIZE, classes))
    weights[means["at"], means["label"]] = means["w"]

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            labels, ats, xs = (c.to_pylist() for c in batch.columns)
            z = [(np.array(x) @ weights[np.array(at, np.int64)]).tolist() if at else [0.0] * classes for at, x in zip(ats, xs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(z, pa.list_(pa.float64()))], ["label", "z"])

    left_out = rows.where("rank % 5 = 0").select("label", "at", "x").mapInArrow(logits, "label int, z array<double>").toPandas()  # a fifth of the sample
    return Model(langs, weights * idf[:, None], calibrate(left_out))


def calibrate(rows: pd.DataFrame) -> float:
    """The temperature with the least cross-entropy, by golden-section search over its logarithm."""
    if not len(rows):
        return 1.0
    z, y = np.stack(rows["z"].to_list()), rows["label"].to_numpy()

    def loss(log_t: float) -> float:
        s = z / np.exp(log_t)
        top = s.max(axis=1)
        return float(np.mean(top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(y)), y])) + 1e-4 * log_t**2  # where all are right, no temperature is too low

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out (if there), lang_pred, score for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(2).to_pylist()
            langs, scores = model.predict(texts) if model else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows that aren't held out."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    return identify(marked, fit(marked.where(~F.col("held_out")), **how))
