"""Near duplicates by Order MinHash, with candidates verified by banded alignment.

A document is its sequence of words (letters and digits, lower case). Its k-mers are runs of five
words, labelled with their occurrence, so that a run that comes twice counts as two. For each of
`sketches` hash functions the `ell` k-mers with the smallest hashes are taken and written down in
the order in which they stand in the text: two documents agree on a sketch only if they share the
k-mers and their order, which tells edit similarity from mere overlap. Documents that agree on a
sketch are candidates.

Equal word sequences (by 128 bits) are first brought together and searched once. Of the candidates
that share a sketch, only pairs with one centre are made first, which links most of what is alike. A
pair is a link if an alignment of the two word sequences inside a diagonal band as wide as the bound
allows has at most (1 - similarity) times the longer one's words in edits; words are compared as
they are. Members of a key that still holds several classes are then compared with each other, all
with all, by what no link can exceed: the difference of their lengths, and the bits in which the sets
of their words differ (an edit takes a word out of the set and puts one in, at most). Pairs within both
bounds are aligned, unless their classes are joined already. A task holds two blocks of such a key. This is
done with keys of any number of members: larger ones have more blocks, and larger blocks up to a bound, so
no task grows with a key, and no pair that shares a sketch is left out, however many others share it. The
comparisons of a key grow with the square of its members, in lengths and bits; they are dealt over tasks, and no pairs pile up.
Classes are the connected components of links.

What links are found: two texts with a share e of their words edited at random keep k-mers with a
Jaccard similarity of about J = q / (2 - q), q = (1 - e)^5, and share one of n sketches with a
probability of 1 - (1 - J^ell)^n. The declared bound of the search is 15 percent of edits, where
that is 0.93 (tests measure at least 0.9 there, and at 5 and 10 percent); pairs of up to 20 percent
are links too if they meet, which about 0.7 of them do. A similarity of 0.8 of the 5-word runs, which
a few scattered edits in 100 words leave, is found with a probability above 0.999. The same holds
among documents made of shared passages (a test measures 5, 10 and 15 percent there too).

A document may be in no class but its own however many others share a passage with it; groups of
any size cost a row for each member and sketch. Lengths that differ by more than the bound are
never aligned, nor are texts whose words or word pairs, order aside, differ by more. Only the texts
of candidates move, found by a Bloom filter of bounded size in the map tasks.

Defined results: texts without a word (null, empty) are classes of their own; texts of fewer than
five words have one k-mer, all their words; equal word sequences are one class; the least doc_id
of a class is its class_id (null if all are null), and of the rows with it the one with the least
text hash stays; rows that repeat a doc_id are rows of their own, those that repeat doc_id and text
share their fate; texts of any length are read whole, and the alignment of two takes time in
proportion to their words times the words that may be edited, 64 at a time; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, own, pieces, stored
from .components import components
from .hashing import BY_LETTERS, Words, chained, mix, spans, words_of
from .quality import slices

K, ELL, SKETCHES, SIMILARITY = 5, 2, 32, 0.8
#: Members of a block of a key's members, of which a task compares two: CROWD, while a key has no more than BLOCKS of these, then
#: up to LARGER times as many. A block has about BLOCK_WORDS words at most. None of these changes what is found.
CROWD, BLOCKS, LARGER, BLOCK_WORDS = 256, 16, 8, 1 << 19
#: The bits in which a text's words are noted.
BITS = 1024
#: Bytes of lower-cased text to bytes of words parted by spaces.
SPACED = np.where(BY_LETTERS == 0, 32, BY_LETTERS).astype(np.uint8).tobytes()


def occurrences(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each hash came before in its text."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    begin = np.flatnonzero(new)
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return out


def kmers(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers; a text with fewer than k words has one, all its words."""
    n = np.diff(words.offsets)
    at, offsets = spans(words.offsets, k)
    hashes = chained(words.hashes, at, k) if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([int(mix(np.bitwise_xor.reduce(mix(words.hashes[words.offsets[i] : words.offsets[i + 1]] * np.arange(1, n[i] + 1, dtype=np.uint64)), keepdims=True))[0]) for i in short], np.uint64)
        hashes = np.insert(hashes, offsets[short], own)
        offsets = offsets + np.concatenate([[0], np.cumsum((n > 0) & (n < k))])
    seen = occurrences(hashes, offsets)
    return np.where(seen > 0, mix(hashes + seen.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)), hashes), offsets


def order_minhash(hashes: np.ndarray, offsets: np.ndarray, sketches: int, ell: int, seed: int) -> np.ndarray:
    """A row of sketches for each text that has k-mers; offsets hold such texts only."""
    n = np.diff(offsets)
    owner_at = offsets[:-1]
    out = np.empty((len(n), sketches), np.uint64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    factors = mix(np.arange(1, sketches + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)
    for j, factor in enumerate(factors):
        order = hashes * factor  # a hash function of its own: k-mers' hashes are spread over 64 bits already
        order ^= order >> np.uint64(32)
        order *= np.uint64(0x94D049BB133111EB)
        picked = []
        for _ in range(ell):
            least = np.minimum.reduceat(order, owner_at)
            hit = np.flatnonzero(order == np.repeat(least, n))
            first = hit[np.searchsorted(hit, owner_at)]  # where it stands
            picked.append(first)
            order[first] = none  # a text with fewer k-mers repeats its last place
        places = np.sort(np.stack(picked), axis=0)
        key = np.full(len(n), np.uint64(j + 1))
        for p in places:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[p])
        out[:, j] = key
    return out


def sequence_key(words: Words, i: int) -> tuple[int, int]:
    """128 bits of a text's words."""
    x = xxhash.xxh3_128_intdigest(words.hashes[words.offsets[i] : words.offsets[i + 1]].tobytes())
    return (x >> 64) - (1 << 63), (x & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, t (with it the key of a row), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))


def sketched(docs: DataFrame, k: int = K, ell: int = ELL, sketches: int = SKETCHES, seed: int = 5) -> DataFrame:
    """doc_id, t, h and g (of the word sequence; null without a word), n (words), sketch (array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for at, some in slices(batch.column(2).to_pylist()):
                words = words_of([t.lower() for t in some], BY_LETTERS)
                n = np.diff(words.offsets)
                full = np.flatnonzero(n > 0)
                keys: list = [None] * len(some)
                whole: list = [(None, None)] * len(some)
                if len(full):
                    hashes, offsets = kmers(words, k)
                    rows = order_minhash(hashes, np.append(offsets[full], offsets[-1]), sketches, ell, seed).view(np.int64)
                    for i, row in zip(full.tolist(), rows, strict=True):
                        keys[i] = row
                        whole[i] = sequence_key(words, i)
                own_keys = (pa.array([x[i] for x in whole], pa.int64()) for i in (0, 1))
                rows = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *own_keys, pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t", "h", "g", "n", "sketch"])

    return narrow(docs).mapInArrow(run, "doc_id long, t long, h long, g long, n long, sketch array<long>")


def coded(docs: DataFrame, some: KeyFilter) -> DataFrame:
    """h, g, code (the words, parted by spaces) of the texts whose hash may be among some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces([whole.filter(pa.array(some.has(whole.column(1).to_numpy())))]):
                for _, texts in slices(batch.column(2).to_pylist()):
                    low = [t.lower() for t in texts]
                    words = words_of(low, BY_LETTERS)
                    rows = [(*sequence_key(words, i), b" ".join(t.encode().translate(SPACED).split()).decode()) for i, t in enumerate(low) if words.offsets[i + 1] > words.offsets[i]]
                    columns = list(zip(*rows, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["h", "g", "code"])

    return narrow(docs).mapInArrow(run, "h long, g long, code string")


def banded(x: list, y: list, bound: int) -> bool:
    """Whether y comes from x by at most `bound` edits, by alignment inside the band of `bound` diagonals to either side.

    A column of the band is two integers, the bits of which say where the distance grows or falls by one from row to row
    (bit b of column j is row j - bound + b); what a column adds is followed along the lowest diagonal until the last row,
    and then along that row."""
    m, n, k = len(x), len(y), bound
    if abs(m - n) > k:
        return False
    full, top = (1 << (2 * k + 1)) - 1, 1 << (2 * k)
    places: dict = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | (1 << i)
    plus, minus = ((1 << (k + 1)) - 1) << k, 0
    distance, last = min(k, m), max(0, m - k)
    most = k + n - last  # along the last row it may fall by one in each column
    for j, w in enumerate(y):
        equal = places.get(w, 0)
        equal = (equal >> (j - k) if j >= k else equal << (k - j)) & full
        same = (((equal & plus) + plus) ^ plus | equal | minus) & full
        up, down = minus | (full ^ (full & (same | plus))), same & plus
        if j < last:
            if not same & top:
                distance += 1
                if distance > most:
                    return False
        else:
            bit = m - j - 1 + k
            distance += (up >> bit & 1) - (down >> bit & 1)
            if distance > k + n - j - 1:
                return False
        same >>= 1
        plus, minus = down | (full ^ (full & (same | up))), same & up
    return distance <= k


def within(a: str, b: str, bound: int) -> bool:
    """Whether at most `bound` words must be changed, added or taken out to make a into b."""
    p, q = a.split(" "), b.split(" ")
    if abs(len(p) - len(q)) > bound:
        return False
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in (p, q))
    differ = np.flatnonzero(x[: len(y)] != y[: len(x)])
    begin = int(differ[0]) if len(differ) else min(len(x), len(y))
    x, y = x[begin:], y[begin:]
    differ = np.flatnonzero(x[::-1][: len(y)] != y[::-1][: len(x)])
    end = int(differ[0]) if len(differ) else min(len(x), len(y))
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not len(x) or not len(y):
        return max(len(x), len(y)) <= bound
    more = np.bincount(x, minlength=len(number)) - np.bincount(y, minlength=len(number))
    if max(more[more > 0].sum(), -more[more < 0].sum()) > bound:  # an edit adds or takes a word at most
        return False
    if max(len(x), len(y)) - 1 > 2 * bound:  # and two pairs of neighbours
        pairs, count = np.unique(np.concatenate([x[:-1] * len(number) + x[1:], y[:-1] * len(number) + y[1:]]), return_inverse=True)
        own_x = np.bincount(count[: len(x) - 1], minlength=len(pairs))
        own_y = np.bincount(count[len(x) - 1 :], minlength=len(pairs))
        if np.minimum(own_x, own_y).sum() < max(len(x), len(y)) - 1 - 2 * bound:
            return False
    return banded(x.tolist(), y.tolist(), bound)


def aligned(pairs: DataFrame) -> DataFrame:
    """a, b, near of pairs (a, b, a_code, b_code, bound); few texts are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            near = [within(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near, pa.bool_())], ["a", "b", "near"])

    return pairs.select("a", "b", "a_code", "b_code", "bound").mapInArrow(run, "a long, b long, near boolean")


def verified(pairs: DataFrame, codes: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b) with near, whether their alignment stays within the bound."""
    bound = F.floor(F.greatest("n", "b_n") * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    sized = pairs.join(sizes.select(F.col("h").alias("a"), "n"), "a").join(sizes.select(F.col("h").alias("b"), F.col("n").alias("b_n")), "b")
    sized = stored(sized.withColumn("bound", bound), "pairs")
    close = sized.where(F.abs(F.col("n") - F.col("b_n")) <= F.col("bound"))
    some = [codes.where(KeyFilter.of(sized.select(c)).column(F.col("h"))).select(F.col("h").alias(c), F.col("code").alias(f"{c}_code")) for c in ("a", "b")]
    text = close.join(some[0].hint("merge"), "a").join(some[1].hint("merge"), "b")
    near = aligned(text)
    far = sized.where(F.abs(F.col("n") - F.col("b_n")) > F.col("bound")).select("a", "b", F.lit(False).alias("near"))
    return near.unionByName(far)


def links(members: DataFrame, codes: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """a, b: the links of members (key, h) to their key's centre, that of the least h; a is the greater of a pair."""
    centre = members.groupBy("key").agg(F.min("h").alias("c"), (F.min("h") != F.max("h")).alias("mixed")).where("mixed").select("key", "c")
    pairs = members.join(centre, "key").where("h <> c").select(F.greatest("h", "c").alias("a"), F.least("h", "c").alias("b")).distinct()
    return stored(verified(stored(pairs, "pairs"), codes, sizes, similarity), "tried").where("near").select("a", "b")


def word_bits(codes: DataFrame) -> DataFrame:
    """h, bits of texts (h, code): a bit for each word's hash, BITS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            words = words_of(batch.column(1).to_pylist(), BY_LETTERS)
            bits = np.zeros((batch.num_rows, BITS), bool)
            bits[np.repeat(np.arange(batch.num_rows), np.diff(words.offsets)), (words.hashes % np.uint64(BITS)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())], ["h", "bits"])

    return codes.mapInArrow(run, "h long, bits binary")


def within_bounds(g: np.ndarray, n: np.ndarray, bits: np.ndarray, share: float, block: np.ndarray | None = None) -> Iterator[tuple[int, int, int]]:
    """(i, j, bound): the pairs of members that are of different classes and may be within the bound by length and by their words.

    block: where members of two blocks stand together, only pairs of one with the other count."""
    order = np.argsort(n, kind="stable")
    g, n, bits, block = g[order], n[order], bits[order], None if block is None or block.min() == block.max() else block[order]
    bounds = np.floor(n * share + 1e-9).astype(np.int64)  # of a pair, that of the longer, which comes later
    first = np.searchsorted(n, n - bounds)
    for i in range(1, len(g)):
        some = slice(int(first[i]), i)
        apart = g[some] != g[i] if block is None else (g[some] != g[i]) & (block[some] != block[i])
        near = np.flatnonzero(apart & (np.bitwise_count(bits[some] ^ bits[i]).sum(axis=1, dtype=np.int64) <= 2 * bounds[i]))
        for j in (near + some.start).tolist():
            yield int(order[i]), int(order[j]), int(bounds[i])


class Classes:
    """Which members are known to be of one class, in one task."""

    def __init__(self, names: list[int]):
        self.above = {g: g for g in names}

    def of(self, g: int) -> int:
        while self.above[g] != g:
            self.above[g] = g = self.above[self.above[g]]
        return g

    def join(self, g: int, other: int) -> None:
        self.above[self.of(g)] = self.of(other)


def crowded(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between members (key, blocks, h, g, keys, n, bits, code) of one key that join their classes.

    A key's members are dealt into as many blocks as said, and a task compares two blocks, or one with itself. Pairs within the bounds
    of length and words are aligned where they stand; two members of several keys are tried in the least of these, and not at all
    once their classes are joined in the task. So a task gives no more links than it holds classes."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        h, g, n, block = (rows[c].to_numpy() for c in ("h", "g", "n", "block"))
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(h), -1)
        key, codes, keys, classes = rows["key"][0].as_py(), rows["code"].to_pylist(), [set(k) for k in rows["keys"].to_pylist()], Classes(g.tolist())
        left, right = [], []
        alone = rows["cross"][0].as_py() and block.min() == block.max()  # the other block is empty
        for i, j, bound in () if alone else within_bounds(g, n, bits, 1 - similarity, block):
            if min(keys[i] & keys[j]) == key and classes.of(int(g[i])) != classes.of(int(g[j])) and within(codes[i], codes[j], bound):
                classes.join(int(g[i]), int(g[j]))
                left.append(max(h[i], h[j])), right.append(min(h[i], h[j]))
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.flatnonzero(np.any(np.diff(key, axis=1), axis=0)) + 1).tolist(), batch.num_rows]
            for at, end in zip(cuts, cuts[1:]):
                if end > at:
                    if held and tuple(key[:, at]) != now:
                        yield flush(held)
                        held = []
                    now = tuple(key[:, at])
                    held.append(batch.slice(at, end - at))
        if held:
            yield flush(held)

    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("h"), blocks)
    met = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.struct((F.least(x, F.col("block")) * blocks + F.greatest(x, F.col("block"))).alias("met"), (x != F.col("block")).alias("cross")))
    dealt = members.withColumn("block", own).select("key", F.inline(met), "h", "g", "keys", "n", "bits", "code", "block")
    return dealt.repartition("key", "met").sortWithinPartitions("key", "met").mapInArrow(run, "a long, b long")


def sequences(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows and their distinct word sequences, with h telling them apart: where two sequences agree in h and not in g, others than the first get a new h."""
    unique = rows.where("h IS NOT NULL").groupBy("h", "g").agg(F.first("n").alias("n"), F.min("t").alias("t"), F.first("sketch").alias("sketch"))
    unique = stored(unique, "unique")
    twins = stored(unique.groupBy("h").agg(F.min("g").alias("least"), F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("twin"), "least"), "twins")
    if not twins.isEmpty():  # next to never
        twins = F.broadcast(twins)
        name = F.when(F.col("g") != F.col("least"), F.xxhash64("h", "g")).otherwise(F.col("h"))
        rows, unique = (df.join(twins, df.h == twins.twin, "left").withColumn("h", name).drop("twin", "least") for df in (rows, unique))
    return rows, unique


def blocks_of(members: Column, words: Column, crowd: int) -> Column:
    """Into how many blocks a key's members are dealt: enough that none has more than LARGER times `crowd` members or BLOCK_WORDS words, and while they are few, `crowd` each."""
    return F.greatest(F.least(F.ceil(members / crowd), F.lit(BLOCKS)), F.ceil(members / (LARGER * crowd)), F.ceil(words / BLOCK_WORDS)).cast("long")


def classified(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, ell: int = ELL, sketches: int = SKETCHES, crowd: int = CROWD, overlap: float | None = None) -> DataFrame:
    """doc_id, t (hash of the text), class_id, class_size, kept for every row of docs. crowd: members of a block, which nothing
    that is found depends on, and neither on overlap, which earlier callers give."""
    rows, unique = sequences(stored(sketched(docs, k, ell, sketches), "sketches"))
    members = unique.select("h", F.explode("sketch").alias("key"))
    shared = stored(members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared")
    members = members.where(KeyFilter.of(shared).column(F.col("key")))
    members = stored(members.join(shared.hint("merge"), "key"), "members")
    sizes = unique.select("h", F.col("g").alias("low"), "n", "t").join(members.select("h").distinct().hint("merge"), "h", "left_semi")
    sizes = stored(sizes, "sizes")
    codes = coded(docs, KeyFilter.of(sizes.select("t"))).groupBy("h", "g").agg(F.first("code").alias("code"))
    named = sizes.select(F.col("h").alias("node"), F.col("low").alias("g"))
    codes = stored(codes.join(named, "g").where((F.col("node") == F.col("h")) | (F.col("node") == F.xxhash64("h", "g"))).select(F.col("node").alias("h"), "code"), "codes")
    sizes = sizes.select("h", "n")
    # One centre for the many keys of a class makes few pairs.
    found = links(members, codes, sizes, similarity)
    roots = components(found)

    # Keys that still hold several classes, of however many members: all with all.
    classes = roots.select(F.col("node").alias("h"), "root")
    named = stored(members.join(classes, "h", "left").select("key", "h", F.coalesce("root", "h").alias("g")), "named")
    held = named.join(sizes, "h").groupBy("key").agg((F.min("g") != F.max("g")).alias("mixed"), F.count("*").alias("m"), F.sum("n").alias("words")).where("mixed")
    held = stored(held.select("key", blocks_of(F.col("m"), F.col("words"), crowd).alias("blocks")), "held")
    left = stored(named.join(held, "key").select("key", "blocks", "h", "g"), "left")
    some = KeyFilter.of(left.select("h"))
    texts = stored(codes.where(some.column(F.col("h"))).join(left.groupBy("h").agg(F.collect_list("key").alias("keys")).hint("merge"), "h"), "texts")  # at most `sketches` keys
    texts = texts.join(word_bits(texts.select("h", "code")).hint("merge"), "h")
    more = stored(crowded(left.join(sizes, "h").join(texts.hint("merge"), "h"), similarity), "crowded")
    found = found.unionByName(more)
    roots = components(found)
    classed = rows.select("doc_id", "t", "h").join(roots.select(F.col("node").alias("h"), "root"), "h", "left").select("doc_id", "t", F.coalesce("root", "h").alias("root"))
    classed = stored(classed, "classed")
    stays = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t"))  # null only where all are
    classes = classed.where("root IS NOT NULL").groupBy("root").agg(stays.alias("stays"), F.count("*").alias("class_size"))
    out = classed.join(classes, "root", "left")
    one = F.col("root").isNull()
    kept = one | (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("t") == F.col("stays.t")))
    class_id = F.when(one, F.col("doc_id")).otherwise(F.col("stays.doc_id"))
    return out.select("doc_id", "t", class_id.alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of docs. Options: see `classified`."""
    return classified(docs, **how).drop("t")


def select(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay, with their columns as they were."""
    gone = stored(classified(docs, **how).where("NOT kept").select("doc_id", "t").distinct(), "gone")
    t, gone_id, gone_t = own(docs.columns, "t", "gone_id", "gone_t")
    keyed = docs.withColumn(t, F.xxhash64("text"))
    maybe = KeyFilter.of(gone.select("t")).column(F.col(t))
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("t").alias(gone_t))
    left = keyed.where(maybe).join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(t) == F.col(gone_t)), "left_anti")
    return keyed.where(~maybe).unionByName(left).drop(t)
