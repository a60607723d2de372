"""Exact deduplication by counting quotient filters.

Every partition of fingerprints becomes a counting quotient filter: a 64-bit fingerprint is split
into a quotient, which names a run, and a remainder, which is kept sorted inside its run with a
counter. Filters are exchanged in blocks of neighbouring quotients and merged without loss, run by
run in the order of the remainders, adding counters. Only fingerprints whose merged counter is
above one reach the second step, which compares whole texts byte by byte.

What is shuffled is one narrow row per document and the texts of suspected copies; the copies of
one text collapse to a row per task before they move, so a text that a third of all rows share is
no hot key.

Defined results: a null text is the empty text, and empty texts are copies of each other; rows
that repeat a doc_id get the same answer; a null doc_id loses against any other and, alone in its
group, keeps itself; texts of any length are hashed and compared whole, each in one task; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, small, stored, text_or_empty

FINGERPRINT_BITS = 64


@dataclass
class QuotientBlock:
    """The runs of neighbouring quotients: run_ends[q] is where the run of quotient q ends among the sorted remainders."""

    remainder_bits: int
    run_ends: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray, quotient_bits: int, remainder_bits: int) -> QuotientBlock:
        """keys: sorted and distinct, quotient above remainder."""
        runs = np.bincount((keys >> np.uint64(remainder_bits)).astype(np.int64), minlength=1 << quotient_bits)
        return cls(remainder_bits, np.cumsum(runs).astype(np.uint32), keys & np.uint64((1 << remainder_bits) - 1), counts.astype(np.uint64))

    def keys(self) -> np.ndarray:
        runs = np.diff(self.run_ends, prepend=np.uint32(0))
        return (np.repeat(np.arange(len(runs), dtype=np.uint64), runs) << np.uint64(self.remainder_bits)) | self.remainders

    def bytes(self) -> tuple[bytes, bytes, bytes]:
        return self.run_ends.tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def read(cls, remainder_bits: int, run_ends: bytes, remainders: bytes, counts: bytes) -> QuotientBlock:
        return cls(remainder_bits, np.frombuffer(run_ends, np.uint32), np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.uint64))

    def merge(self, other: QuotientBlock) -> QuotientBlock:
        """Lossless: both are sorted, so one stable merge brings equal remainders of a run together and their counters add up."""
        keys = np.concatenate([self.keys(), other.keys()])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], np.concatenate([self.counts, other.counts])[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - np.uint64(1)) != 0) if len(keys) else np.array([], np.int64)
        counts = np.add.reduceat(counts, first) if len(first) else counts
        return QuotientBlock.of(keys[first], counts, int(len(self.run_ends)).bit_length() - 1, self.remainder_bits)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_sha256, text of each document; text is lower-cased in A-Z alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in lists(batches):
            low = [(t or "").encode().lower() for t in texts]  # bytes.lower() changes ASCII letters only
            fps = [xxhash.xxh64_intdigest(b) - (1 << 63) for b in low]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in low], pa.string()), pa.array(low, pa.binary())],
                ["doc_id", "fp", "text_sha256", "bytes"],
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, "doc_id long, fp long, text_sha256 string, bytes binary")


def filters(fps: DataFrame, block_bits: int, quotient_bits: int = 8, hold: int = 1 << 20) -> DataFrame:
    """The quotient filter of each partition, cut into 2^block_bits blocks of 2^quotient_bits quotients. At most hold fingerprints are held at once."""
    remainder_bits = FINGERPRINT_BITS - block_bits - quotient_bits

    def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        block = (keys >> np.uint64(FINGERPRINT_BITS - block_bits)).astype(np.int32)
        rest = keys & np.uint64((1 << (FINGERPRINT_BITS - block_bits)) - 1)
        at = np.flatnonzero(np.diff(block, prepend=-1))
        out = [QuotientBlock.of(rest[a:b], counts[a:b], quotient_bits, remainder_bits).bytes() for a, b in zip(at, [*at[1:], len(keys)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(block[at]), *(pa.array(list(c), pa.binary()) for c in zip(*out, strict=True))], ["block", "run_ends", "remainders", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63))
                n += b.num_rows
            if n >= hold:
                yield blocks(held)
                held, n = [], 0
        if held:
            yield blocks(held)

    return fps.select("fp").mapInArrow(run, "block int, run_ends binary, remainders binary, counts binary")


def repeated(blocks: DataFrame, block_bits: int, quotient_bits: int = 8) -> DataFrame:
    """fp, copies: the fingerprints whose counter is above one once the blocks of all partitions are merged."""
    remainder_bits = FINGERPRINT_BITS - block_bits - quotient_bits

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        heap = [(len(r.remainders), i, QuotientBlock.read(remainder_bits, r.run_ends, r.remainders, r.counts)) for i, r in enumerate(rows.itertuples())]
        heapq.heapify(heap)
        while len(heap) > 1:  # the two smallest first, as in an optimal merge pattern
            (_, i, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            c = a.merge(b)
            heapq.heappush(heap, (c.remainders.nbytes, i, c))
        whole = heap[0][2]
        many = whole.counts > 1
        top = np.uint64(int(rows.block.iloc[0])) << np.uint64(FINGERPRINT_BITS - block_bits)
        return pd.DataFrame({"fp": ((whole.keys()[many] | top) ^ np.uint64(1 << 63)).view(np.int64), "copies": whole.counts[many].astype(np.int64)})

    return blocks.groupBy("block").applyInPandas(merge, "fp long, copies long")


def exact_dedup(docs: DataFrame, per_block: int = 1 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; the largest doc_id of equal texts stays."""
    prints = stored(fingerprint(docs).drop("bytes"), "fingerprints")
    block_bits = max(8, math.ceil(math.log2(max(2, prints.count()) / per_block)))
    suspects = stored(repeated(filters(prints, block_bits), block_bits).select("fp"), "suspects")
    same = fingerprint(docs).select("doc_id", "fp", "bytes").join(small(suspects), "fp", "left_semi")
    groups = same.groupBy("fp", "bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.select("fp", F.sha2("bytes", 256).alias("text_sha256"), "keep_id", "group_size")
    return prints.join(groups, ["fp", "text_sha256"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
