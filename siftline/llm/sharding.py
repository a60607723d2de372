"""A reproducible shuffle into shards: a Feistel permutation over row numbers.

Rows are numbered from 0 to n - 1 in the order of their key, over many tasks (`numbering`). A Feistel
network permutes the numbers of 2b bits, the least even width that holds n - 1; a result of n or more
is permuted again until it falls below n (cycle walking: fewer than four steps on average, and it
ends, for the number itself lies on its cycle). Permuted place p belongs to shard p mod shards at slot
p div shards. So shards differ by at most one row, slots have no gaps, and both follow from the row
number, n, the seed and the number of shards alone: `place` computes them, `row_at` turns them back,
and no table of the shuffle is kept.

The only exchange is the one that puts rows in order. A reader that knows a shard and a slot knows
the row's number, and the ordered table has it there.

Defined results: a null key comes first in the order; rows that repeat a key are numbered by the
hash of the row's other columns that the caller names (`ties`), and rows that agree in these too are
equal in all that decides, so which takes which place doesn't show; texts of any length move only
where the caller passes them along (`write_shards`); with fewer rows than shards the last shards stay
empty; an empty table gives an empty result; other columns are passed through, but one named shard
or slot is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own, stored
from .numbering import numbered

SHARDS, ROUNDS, SEED = 24, 6, 11
#: Odd multipliers below 2^32; factors stay below 2^31, so products fit 63 bits in numpy and in SQL.
FIRST, SECOND, LOW = 0x9E3779B1, 0x85EBCA6B, (1 << 31) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}/{k}".encode()).digest()[:4], "little") & LOW for k in range(rounds)]


def half_bits(n: int) -> int:
    """Half the width of the least even number of bits that holds 0 to n - 1."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


class Shuffle:
    """A permutation of 0 .. n - 1."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n, self.bits, self.keys = n, half_bits(n), round_keys(seed, rounds)
        self.mask = (1 << self.bits) - 1

    def mixed(self, half: np.ndarray, key: int) -> np.ndarray:
        x = (half ^ key) * FIRST
        x = ((x ^ (x >> 29)) & LOW) * SECOND
        return (x ^ (x >> 32)) & self.mask

    def once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.bits, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self.mixed(right, key)
        return (left << self.bits) | right

    def once_back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.bits, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self.mixed(left, key), left
        return (left << self.bits) | right

    def walked(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x, np.int64))
        while len(far := np.flatnonzero(out >= self.n)):
            out[far] = step(out[far])
        return out

    def place(self, rows: np.ndarray) -> np.ndarray:
        return self.walked(rows, self.once)

    def row(self, places: np.ndarray) -> np.ndarray:
        return self.walked(places, self.once_back)


def place(rows: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """shard and slot of the rows with these numbers."""
    p = Shuffle(n, seed).place(rows)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The number of the row that stands at slot of shard."""
    return Shuffle(n, seed).row(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64))


def sharded(rows: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = (), shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows (a stored table) with shard int, slot long and row_number long, its number in the order of key and ties."""
    number, total, at, tie = own(rows.columns, "s_number", "s_total", "s_place", "s_tie")
    hashed = rows.withColumn(tie, F.xxhash64(*ties) if ties else F.lit(0).cast("long"))
    numbers = numbered(hashed, [key, tie], number, total)

    @F.pandas_udf("long")
    def permuted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shuffle = None
        for row, n in batches:
            if len(row):
                shuffle = shuffle or Shuffle(int(n.iloc[0]), seed)  # n is one number for the whole table
                yield pd.Series(shuffle.place(row.to_numpy(np.int64)))
            else:
                yield pd.Series([], dtype=np.int64)

    placed = numbers.withColumn(at, permuted(number, total))
    made = {"shard": (F.col(at) % shards).cast("int"), "slot": F.expr(f"`{at}` div {shards}"), "row_number": F.col(number)}
    return placed.select(*(c for c in rows.columns if c.lower() not in made), *(c.alias(name) for name, c in made.items()))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", ties: tuple[str, ...] = ("text",), shards: int = SHARDS, seed: int = SEED, per_file: int = 1 << 16) -> DataFrame:
    """Writes docs whole into a folder for each shard, in files by ranges of slots, in slot order; returns shard, rows.

    A shard is split over as many tasks as its rows need, so neither a task nor a file holds a whole shard."""
    placed = sharded(stored(docs, "rows"), key, ties, shards, seed)
    block = F.expr(f"slot div {per_file}")
    n_blocks = max(1, -(-docs.count() // (per_file * shards))) * shards
    placed.withColumn("slot_block", block).repartition(n_blocks, "shard", "slot_block").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("rows"))
