"""Best-fit packing of token sequences, improved by a swap-based local search.

Texts longer than a sequence are cut into full sequences after a shorter first piece, and every
full piece is a sequence of its own. The other pieces are dealt at random into shards of bounded
size. Inside a shard they go longest first into the fullest bin with room for them. A local search
then works on the underfull bins: it moves a piece, exchanges one for one or two for one, always so that
the sum of squared fills grows, and so the emptier bins run empty. Pieces that stand in bins with
an eighth of their room left are dealt into shards again and packed once more, until a round saves
no bin; a shard's last bins thus don't add up over many shards.

Defined results: a null or empty text is its end id alone; rows that repeat a doc_id are packed as
rows of their own; a null doc_id is packed like any other, and however many rows share an id or
have none, they are spread over all shards; texts of any length are read whole, one at a time, and
give as many pieces as they need; an empty table gives an empty result; other columns of `parts` are
passed through by `pack`, but one named sequence_id or offset is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, lists, own, stored, text_or_empty
from .tokens import CACHE_WORDS, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, spaced: bool, end_id: int, capacity: int = 1024, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; with ids (binary, 32 bits each) if asked. cache_words: words that a worker keeps."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, spaced, cache_words).encode
        for ids, texts in lists(batches, 256):
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                got = encode(text) + end
                n = len(got) // 4
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(got[4 * a : 4 * b]), got[4 * a : 4 * b] if with_ids else None) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions, longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin with room r stands
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


class LocalSearch:
    """Empties the emptiest bins: each step moves or exchanges pieces so that a fuller bin grows and the squared fills' sum with it."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bin = np.empty(len(lengths), np.int64)
        for k, b in enumerate(bins):
            self.bin[b] = k
        self.fill = np.bincount(self.bin, weights=lengths, minlength=len(bins)).astype(np.int64)
        self.least = -(-int(lengths.sum()) // capacity)

    def run(self) -> list[list[int]]:
        emptied = True
        while emptied and np.count_nonzero(self.fill) > self.least:
            emptied = False
            for a in np.argsort(self.fill, kind="stable").tolist():
                if not 0 < self.fill[a] < self.capacity:
                    continue
                while self.fill[a] and self.step(a):
                    pass
                emptied |= not self.fill[a]
                if np.count_nonzero(self.fill) <= self.least:
                    break
        order = np.argsort(self.bin, kind="stable")
        return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(self.bin[order])) + 1)]

    def step(self, a: int) -> bool:
        fills = self.fill[self.bin]
        others = np.flatnonzero((fills < self.capacity) & (fills >= self.fill[a]) & (self.bin != a))
        if not len(others):
            return False
        mine = np.flatnonzero(self.bin == a)
        sizes, room = self.lengths[mine], self.capacity - fills[others]
        k = int(np.argmax(np.where(sizes <= room.max(), sizes, -1)))
        if sizes[k] <= room.max():  # the longest that fits moves to where it fits best
            to = others[np.argmin(np.where(room >= sizes[k], room, self.capacity + 1))]
            self.change(a, mine[[k]], int(self.bin[to]), mine[:0])
            return True
        ones = [(int(n), (i,)) for i, n in enumerate(sizes.tolist())]
        twos = [(x + y, (*i, *j)) for k, (x, i) in enumerate(ones) for y, j in ones[k + 1 :] if x + y < self.capacity]
        for give in (dict(ones), dict(twos)):  # one for one, then two for one
            if not give:
                continue
            sums = np.array(sorted(give))
            at = np.searchsorted(sums, self.lengths[others] + room, side="right") - 1  # the longest that the room allows
            gain = np.where(at >= 0, sums[at] - self.lengths[others], 0)
            best = int(np.argmax(gain))
            if gain[best] > 0:
                self.change(a, mine[list(give[int(sums[at[best]])])], int(self.bin[others[best]]), others[[best]])
                return True
        return False

    def change(self, a: int, give: np.ndarray, b: int, take: np.ndarray) -> None:
        self.bin[give], self.bin[take] = b, a
        moved = int(self.lengths[give].sum() - self.lengths[take].sum())
        self.fill[a] -= moved
        self.fill[b] += moved


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The bins of one shard, full pieces first."""
    full = [[int(i)] for i in np.flatnonzero(lengths >= capacity)]
    rest = np.flatnonzero(lengths < capacity)
    if not len(rest):
        return full
    bins = LocalSearch(lengths[rest], best_fit(lengths[rest], capacity), capacity).run()
    return full + [[int(rest[i]) for i in b] for b in bins]


def packer(columns: list[str], shard: str, open_: str, capacity: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        sequence, offset, is_open = (np.zeros(len(rows), np.int64) for _ in range(3))
        base = (level << 59) + (int(rows[shard].iloc[0]) << 24)
        for k, b in enumerate(pack_lengths(lengths, capacity)):
            at = np.cumsum(lengths[b]) - lengths[b]
            sequence[b], offset[b], is_open[b] = base + k, at, at[-1] + lengths[b[-1]] <= capacity - capacity // 8
        return rows[columns].assign(**{"sequence_id": sequence, "offset": offset, open_: is_open.astype(bool)})

    return run


def pack(parts: DataFrame, capacity: int = 1024, per_shard: int = 8192, rounds: int = 4) -> DataFrame:
    """parts (with a length up to capacity) with sequence_id and offset. Other columns are passed through."""
    columns = [c for c in parts.columns if c not in ("sequence_id", "offset")]
    shard, open_ = own([*columns, "sequence_id", "offset"], "shard", "open")
    zero = F.lit(0).cast("long")
    schema = parts.select(*columns, zero.alias("sequence_id"), zero.alias("offset"), F.lit(True).alias(open_)).schema
    done: list[DataFrame] = []
    left, before = stored(parts.select(*columns), "parts"), None
    for level in range(rounds):
        n = left.count()
        shards = blocks_for(n, per_shard)
        # A stored table's rows have the same place in every attempt, so rows that repeat an id are told apart by it.
        spread = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(level)), F.lit(shards))
        packed = stored(left.withColumn(shard, spread).groupBy(shard).applyInPandas(packer(columns, shard, open_, capacity, level), schema), f"packed{level}")
        bins = packed.where(F.col(open_)).agg(F.countDistinct("sequence_id").alias("n")).first().n
        last = shards == 1 or level == rounds - 1 or (before is not None and bins >= 0.98 * before)
        done.append(packed if last else packed.where(~F.col(open_)))
        if last:
            break
        left, before = packed.where(F.col(open_)).select(*columns), bins
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.drop(open_)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: the packed sequences themselves, from parts that carry ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # at most a sequence's length
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
