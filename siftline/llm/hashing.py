"""Hashes of the words of many texts at once, over flat byte arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
SEGMENT = 1 << 18

_bytes = np.arange(256)
#: Byte to byte; 0 parts words.
BY_SPACE = np.where(np.isin(_bytes, [0, 9, 10, 11, 12, 13, 32]), 0, _bytes).astype(np.uint8)
_alnum = (_bytes >= 128) | np.isin(_bytes, [*range(48, 58), *range(65, 91), *range(97, 123)])
BY_LETTERS = np.where(_alnum, np.where((_bytes >= 65) & (_bytes < 91), _bytes + 32, _bytes), 0).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096) - 1, BASE)]))
    return _powers[:n]


@dataclass
class Words:
    """hashes and byte places of the words of some texts; those of text i are at offsets[i] : offsets[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray
    data: np.ndarray


def words_of(texts: list[str], table: np.ndarray = BY_SPACE) -> Words:
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    hashes, starts, lengths = [], [], []
    at = 0
    while at < len(data):
        stop = min(len(data), at + SEGMENT)
        while stop < len(data) and table[data[stop - 1]]:  # a word is not parted
            stop += 1
        folded = table[data[at:stop]]
        inside = folded != 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        first, last = edge[::2], edge[1::2]
        if len(first):
            n = last - first
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            terms = (folded[inside].astype(np.uint64) + np.uint64(1)) * powers(int(n.max()) + 1)[place]
            hashes.append(mix(np.add.reduceat(terms, np.cumsum(n) - n) + n.astype(np.uint64)))
            starts.append(first + at)
            lengths.append(n)
        at = stop
    joined = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, np.uint64), (starts, np.int64), (lengths, np.int64))]
    offsets = np.concatenate([[0], np.searchsorted(joined[1], ends)]).astype(np.int64)
    return Words(*joined, offsets, data)


def spans(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of `width` neighbouring items within one text begin, and the texts' offsets among them."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    place = np.concatenate([[0], np.cumsum(n)])
    return np.arange(int(place[-1])) - np.repeat(place[:-1], n) + np.repeat(offsets[:-1], n), place


def chained(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` neighbouring items from each place on; their order counts."""
    out = hashes[at].copy()
    for k in range(1, width):
        out = out * BASE + hashes[at + k]
    return mix(out)
