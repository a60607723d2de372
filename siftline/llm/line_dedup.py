"""Line deduplication by a deletion-neighbourhood join.

Two lines are alike if they are the same words, or if one edit makes them so (a word changed, added
or taken out) and the longer one has `min_words` words or more: at 5, an edit leaves a similarity
of 0.8. A line goes when a line like it stands earlier in the corpus, in the order of doc_id, text
hash and line number, be that one kept or not; so the earliest stays.

Lines within one edit share a variant: the line with one word deleted (or, of the shorter one of
two, the line as it is). All variants are emitted as 64-bit keys, equal keys meet in a join, and
what meets is verified word by word. With a key goes the place of the deleted word: lines of one
key and place differ in that word alone, so each needs only the earliest among them, and lines
that are longer by a word than the key's whole line need only that line. No pairs are made within
a group, yet no earlier line within the bound is missed.

Most lines have no such neighbour, and an edit leaves one half of a line untouched. So first the
halves of all lines are counted, and only lines that share a half with another line emit variants,
of deletions in the other half. This drops no pair.

What moves, at every size by the same plan: a narrow row for each distinct line of a task (a line
that half of all documents carry is one row per task), its halves' keys, and the texts of the lines
that emit variants. A Bloom filter of bounded size, of the lines, variants or documents that
matter, is asked in the map tasks before each of these exchanges, so the others stay where they
are; what it lets through by chance is dropped by the exact join behind it. Documents move only if
they lose a line.

A line is known by 128 bits of its words, a row by its doc_id and 64 bits of its text.

Defined results: null texts stay null, empty ones stay empty; lines without a word always stay;
a text whose lines with words all go is dropped by `select` and has an empty text in
`deduplicated`; rows that repeat a doc_id are rows of their own, rows that repeat doc_id and text
share their fate; a null doc_id comes first; texts and lines of any length are read whole, and the
work for a line grows with its words; an empty table gives an empty result; other columns are passed
through, but a column of docs named n_lines or n_gone is replaced by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KeyFilter, lists, own, pieces, stored
from .hashing import powers

MIN_WORDS = 5
INVERSE = pow(0x9E3779B97F4A7C15, -1, 1 << 64)  # of the base that `powers` counts by
LINE = ["h", "g"]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_key(words: list[str]) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(" ".join(words))
    return signed(x >> 64), signed(x & 0xFFFFFFFFFFFFFFFF)


def halves(words: list[str], min_words: int) -> list[int | None] | None:
    """Keys of the first and the last half, once as the longer line of a pair and once as the shorter one.

    Of a pair whose longer line has n words, the first n // 2 or the last n - n // 2 words are equal."""
    if len(words) + 1 < min_words:
        return None
    out: list[int | None] = []
    for n in (len(words), len(words) + 1):
        parts = words[: n // 2], words[len(words) - (n - n // 2) :]
        out += [None if n < min_words else signed(xxhash.xxh64_intdigest(" ".join(x), 2 * n + i)) for i, x in enumerate(parts)]
    return out


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, t (with it the key of a row), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, t, line, h, g, words, keys (4 halves' keys, null where no pair is possible) of each line with a word."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ts, texts in lists(batches, 256):
            rows = []
            for doc_id, t, text in zip(ids, ts, texts, strict=True):
                for k, line in enumerate(text.split("\n")):
                    words = line.split()
                    if words:
                        rows.append((doc_id, t, k, *line_key(words), len(words), halves(words, min_words)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "t", "line", "h", "g", "words", "keys"])

    return narrow(docs).mapInArrow(run, "doc_id long, t long, line int, h long, g long, words int, keys array<long>")


def line_texts(docs: DataFrame, chosen: KeyFilter, rows: KeyFilter) -> DataFrame:
    """h, g, line_text of the lines whose h may be among the chosen, in texts whose hash may be among the rows."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(rows.has(batch.column(1).to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in lists(some(batches), 256):
            words = [w for text in texts for line in text.split("\n") if (w := line.split())]
            keys = np.array([line_key(w) for w in words], np.int64).reshape(-1, 2)
            at = np.flatnonzero(chosen.has(keys[:, 0]))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0]), pa.array(keys[at, 1]), pa.array([" ".join(words[i]) for i in at.tolist()], pa.string())], ["h", "g", "line_text"])

    return narrow(docs).mapInArrow(run, "h long, g long, line_text string")


def variants(texts: DataFrame, among: KeyFilter | None = None) -> DataFrame:
    """h, g, v (the variant's key), spot (the deleted word's place, -1 for none) of texts (h, g, line_text, sides); among: keys of interest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hs, gs, texts, sides in lists(batches, 256):
            own_at, out_v, out_spot = [], [], []
            for i, (text, side) in enumerate(zip(texts, sides, strict=True)):
                words = text.split()
                n = len(words)
                terms = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64) * powers(n)
                before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
                spots = []
                if side & 12:  # as the shorter line of a pair: whole
                    own_at.append(np.array([i])), out_v.append(before[-1:]), out_spot.append(np.array([-1]))
                if side & 1:  # the first half is shared: the edit is in the last one
                    spots.append(np.arange(n // 2, n))
                if side & 2:
                    spots.append(np.arange(0, n // 2))
                if spots:
                    spot = np.concatenate(spots)
                    own_at.append(np.full(len(spot), i))
                    out_v.append(before[spot] + (before[-1] - before[spot + 1]) * np.uint64(INVERSE))
                    out_spot.append(spot)
            if own_at:
                at, v, spot = (np.concatenate(x) for x in (own_at, out_v, out_spot))
                v = v.view(np.int64)
                if among is not None:
                    some = among.has(v)
                    at, v, spot = at[some], v[some], spot[some]
                h, g = np.array(hs, np.int64)[at], np.array(gs, np.int64)[at]
                for a in range(0, len(v), 1 << 16):
                    cut = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(h[cut]), pa.array(g[cut]), pa.array(v[cut]), pa.array(spot[cut].astype(np.int32))], ["h", "g", "v", "spot"])

    return texts.select("h", "g", "line_text", "sides").mapInArrow(run, "h long, g long, v long, spot int")


@F.pandas_udf(T.BooleanType())
def within_one(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether at most one word differs, was added or taken out."""

    def one(x: str, y: str) -> bool:
        p, q = x.split(), y.split()
        if abs(len(p) - len(q)) > 1:
            return False
        most = min(len(p), len(q))
        i = next((i for i in range(most) if p[i] != q[i]), most)
        k = next((k for k in range(most - i) if p[-1 - k] != q[-1 - k]), most - i)
        return max(len(p), len(q)) - i - k <= 1

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def shortened(rows: DataFrame, numbers: str) -> DataFrame:
    """rows whose text lacks the lines of the column `numbers` (null: none)."""
    text_at, gone_at = rows.columns.index("text"), rows.columns.index(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            texts = []
            for text, gone in zip(batch.column(text_at).to_pylist(), batch.column(gone_at).to_pylist(), strict=True):
                if gone is not None and text is not None:
                    dropped = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in dropped)
                texts.append(text)
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return rows.mapInArrow(run, rows.schema)


def place() -> Column:
    return F.struct("doc_id", "t", "line")


def first_lines(rows: DataFrame) -> DataFrame:
    """h, g, first (place of its first line), n (how many there are), keys for each distinct line of rows."""
    return rows.groupBy(*LINE).agg(F.min(place()).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys"))


def chosen_lines(distinct: DataFrame) -> DataFrame:
    """h, g, first, sides (bits of the halves that another line has too) of the lines that emit variants."""
    keyed = distinct.where("keys IS NOT NULL").select(*LINE, F.posexplode("keys").alias("side", "key")).where("key IS NOT NULL")
    # A half is of use if at least two lines have it, one of them as the longer line of a pair.
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("side")).where("n > 1 AND side < 2").select("key"), "halves")
    some = keyed.where(KeyFilter.of(shared).column(F.col("key")))
    sides = some.join(shared.hint("merge"), "key").groupBy(*LINE).agg(F.bit_or(F.expr("shiftleft(1, side)")).alias("sides"))
    return sides.join(distinct.select(*LINE, "first").hint("merge"), LINE)


def near_earlier(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """h, g of the lines that have an earlier line within one edit."""
    chosen = stored(chosen_lines(distinct), "near")
    texts = line_texts(docs, KeyFilter.of(chosen.select("h")), KeyFilter.of(chosen.select("first.t"))).groupBy(*LINE).agg(F.first("line_text").alias("line_text"))
    texts = stored(texts.join(chosen.hint("merge"), LINE), "texts")

    met = stored(variants(texts).groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"), "keys")
    met = variants(texts, KeyFilter.of(met)).join(met.hint("merge"), "v")
    met = stored(met.join(texts.select(*LINE, "first").hint("merge"), LINE), "variants")
    z = F.struct("first", *LINE)
    whole = met.where("spot < 0").groupBy("v").agg(F.min(z).alias("z"))
    cut = met.where("spot >= 0")
    spots = cut.groupBy("v", "spot").agg(F.min(z).alias("z"))
    any_cut = spots.groupBy("v").agg(F.min("z").alias("z"))
    pairs = cut.join(spots, ["v", "spot"]).select(*LINE, "first", "z")
    pairs = pairs.unionByName(cut.join(whole, "v").select(*LINE, "first", "z"))
    pairs = pairs.unionByName(met.where("spot < 0").join(any_cut, "v").select(*LINE, "first", "z"))
    pairs = pairs.where(F.col("z.first") < F.col("first")).select(*LINE, F.col("z.h").alias("b_h"), F.col("z.g").alias("b_g"))
    pairs = stored(pairs.distinct(), "line-pairs")
    a = texts.select(*LINE, F.col("line_text").alias("a"))
    b = texts.select(F.col("h").alias("b_h"), F.col("g").alias("b_g"), F.col("line_text").alias("b"))
    return pairs.join(a, LINE).join(b, ["b_h", "b_g"]).where(within_one("a", "b")).select(*LINE).distinct()


def dropped(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, t, gone (line numbers) for each row that loses lines."""
    rows = stored(lines(docs, min_words), "lines")
    distinct = stored(first_lines(rows), "distinct-lines")
    near = near_earlier(docs, distinct).withColumn("near", F.lit(True))
    fate = distinct.select(*LINE, "first", "n").join(near, LINE, "left").where("near OR n > 1")
    fate = stored(fate.select(*LINE, "first", F.coalesce("near", F.lit(False)).alias("near")), "fates")
    some = rows.select("doc_id", "t", "line", *LINE).where(KeyFilter.of(fate.select("h")).column(F.col("h")))
    lost = some.join(fate.hint("merge"), LINE).where(F.col("near") | ~place().eqNullSafe(F.col("first")))
    return lost.groupBy("doc_id", "t").agg(F.collect_set("line").alias("gone"))


def with_lines_dropped(docs: DataFrame, min_words: int, n_lines: str, n_gone: str) -> DataFrame:
    """docs with shorter texts and two more columns of these names; an n_chars column follows the text."""
    gone = stored(dropped(docs, min_words), "gone-lines")
    t, gone_id, gone_t, numbers = own(docs.columns, "t", "gone_id", "gone_t", "gone")
    kept = [c for c in docs.columns if c not in (n_lines, n_gone)]
    keyed = docs.select(*kept, F.xxhash64("text").alias(t))
    maybe = KeyFilter.of(gone.select("t")).column(F.col(t))
    n = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("t").alias(gone_t), F.col("gone").alias(numbers))
    loses = keyed.where(maybe).join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(t) == F.col(gone_t)), "left")
    made = shortened(loses.select(*kept, n.alias(n_lines), F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias(n_gone), numbers), numbers)
    if "n_chars" in kept:
        made = made.withColumn("n_chars", F.when(F.col(numbers).isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    made = made.select(*kept, n_lines, n_gone)
    return keyed.where(~maybe).select(*kept, n.alias(n_lines), F.lit(0).cast("long").alias(n_gone)).unionByName(made)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text holding the lines that stay, and n_lines, n_gone; an n_chars column follows the text."""
    return with_lines_dropped(docs, min_words, "n_lines", "n_gone")


def select(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs without the lines that go; a row goes with its last line."""
    n_lines, n_gone = own(docs.columns, "n_lines", "n_gone")
    out = with_lines_dropped(docs, min_words, n_lines, n_gone)
    return out.where((F.col(n_gone) == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)
