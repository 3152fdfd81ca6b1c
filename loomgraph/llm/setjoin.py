"""Exact Jaccard self-join of token sets by rare-first prefix filtering.

Items (texts, or lines of texts) are sets of 64-bit token hashes. Items of equal sets are one
class from the start (key k of 64 bits together with the set size n), so copies are never paired.

1. A pass over the texts counts words and tokens in hash buckets (fixed size, summed over all
   texts) and writes each item's class. The counts estimate how rare a token is.
   The key is of the tokens' whole hashes. Tokens that are single words are counted once for each item, so that
   one whose bucket counts 1 is in one item only and needs no posting; for them step 2 is left out.
2. A second pass asks of each token that may be so whether one class only has it: each task sends its distinct
   tokens by bucket (sorted, so that they pack into few bytes) and gets a bit for each back, in a file of its own.
   A task that doesn't find its answers takes no token for unshared, which is right but slower.
3. A third pass orders each set: first unshared tokens, which need no posting, then the others by (estimated
   rarity, hash). Of the prefix that the threshold requires it packs the shared tokens' postings by token bucket.
4. Postings of one token meet in its bucket, in order of set size, under the length and positional filters and, on sketches of 64 bits, the suffix filter. A
   pair whose postings follow the same token has already met there and is left out. Tokens whose count
   is far above a bucket's mean are spread by class and meet in a Spark join instead, which splits hot keys.
5. Pairs are distinct and pass the suffix filter: parity sketches of the two sets, of 2 bits or more for
   each token, bound their Hamming distance from below. Lines have passed it in 4, on 128 bits where they
   have more than WIDE words: their sketches of 2 bits a word would rule out few pairs more.
6. What is left is verified once. Pairs go to blocks by the least neighbour of either end, so that
   the members of a group meet in few blocks; a large group has many. Only there are sets sent, and intersected.
   Lines whose sets are sent are found by their places, so that the others aren't split into words again.
7. Unless tokens are single words: where DENSE classes or more have a token and most of them would pair up, no pair is made of it: such tokens' classes are
   a dense group, and all pairs within it are verified, in blocks of two lots. So what is sent grows with a group's classes and
   its lots, not with its pairs.

The order only affects speed: every pair of classes with intersection / union >= percent / 100 is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components
from loomgraph.session import cut, discard, scratch

from .common import record, small_batches
from .packing import pack_sorted, unpack_sorted
from .textkernel import NOT_SPACE, U64, chunks, mix, scan

#: Buckets of the count tables of words and of tokens, as powers of two.
BITS = (23, 20)
PIECE = 1 << 15
#: Bytes of text that are worked on at once, so that the arrays stay in a core's cache.
CACHED_BYTES = 1 << 18
#: Lines of more words than this have a parity of 128 bits, others of 64.
WIDE = 64
#: Tokens that a task holds before it sends them.
FLUSH = 700_000
#: Tokens with an estimated count from here on are taken to be shared without being asked for.
SURELY_SHARED = 16
#: Classes of one group that are verified together (two such lots at most are in memory).
LOT = 128
#: Postings from which on a token's classes may be a dense group; of so many sampled ones against all, the share that passes the filters there; and classes and tokens of a lot.
DENSE, SAMPLED, DENSE_SHARE, DENSE_LOT, DENSE_TOKENS = 128, 16, 0.25, 512, 1 << 18
#: Tokens that two sets' lots are intersected on at once; classes of dense groups that may be broadcast.
COLUMNS, BROADCAST_CLASSES = 1 << 13, 1 << 20
#: Packed postings that a bucket should have, and what a word of the input gives rise to at most, as measured.
BUCKET_BYTES, POSTING_BYTES = 32 << 20, 6
#: Bits of the largest Bloom filter that keeps sets that no pair needs from being sent; a full filter only sends more.
BLOOM_BITS = 1 << 28


@dataclass
class Sets:
    """Tokens of a chunk's items, in the order of items: item of each token, its hash, and words (hashes, one or two per token) for its rarity."""

    item: np.ndarray
    token: np.ndarray
    left: np.ndarray
    right: np.ndarray | None
    row: np.ndarray  # of each item: its text within the chunk
    part: np.ndarray  # and its number there


def shingles(data: np.ndarray, off: np.ndarray) -> Sets:
    """An item is a text, its tokens are pairs of neighbouring words; a text of one word has that word."""
    w = scan(data, off, NOT_SPACE)
    h, doc, n = w.hashes(), w.text_of_word(), w.counts()
    if not len(h):
        z = np.zeros(0, U64)
        return Sets(np.zeros(0, np.int64), z, z, z, np.arange(len(n)), np.zeros(len(n), np.int64))
    pair = doc[1:] == doc[:-1]
    one = w.first[:-1][n == 1]
    left, right = h[:-1][pair], h[1:][pair]
    item = np.r_[doc[1:][pair], doc[one]]
    token = np.r_[mix(left * U64(3) + mix(right)), mix(h[one] ^ U64(0x5BD1E995))]
    left, right = np.r_[left, h[one]], np.r_[right, h[one]]
    if len(one):
        order = np.argsort(item, kind="stable")
        item, token, left, right = item[order], token[order], left[order], right[order]
    return Sets(item, token, left, right, np.arange(len(n)), np.zeros(len(n), np.int64))


def _line_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line, in order: where it starts, its text, and its number there."""
    ends = np.flatnonzero(data == 10)
    row = np.searchsorted(off, ends, side="right") - 1
    keep = np.r_[off[:-1], ends + 1]
    own = np.r_[np.arange(len(off) - 1), row]
    order = np.lexsort((np.r_[np.full(len(off) - 1, -1), ends], own))
    starts, own = keep[order], own[order]
    return starts, own, np.arange(len(own)) - np.searchsorted(own, np.arange(len(off) - 1))[own]


def lines(data: np.ndarray, off: np.ndarray) -> Sets:
    """An item is a line of a text (between \\n), its tokens are its words."""
    starts, own, number = _line_starts(data, off)
    w = scan(data, np.r_[np.minimum(starts, len(data)), len(data)], NOT_SPACE)
    h = w.hashes()
    return Sets(w.text_of_word(), h, h, None, own, number)


def _sums(item: np.ndarray, value: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each item's distinct values (rows are sorted by item): how many there are, and the sum of their hashes."""
    size = np.bincount(item, minlength=n_items)
    total = np.zeros(len(item) + 1, U64)
    np.cumsum(mix(value), out=total[1:])
    first = np.r_[0, np.cumsum(size)]
    return size, total[first[1:]] - total[first[:-1]]


_LOW48, _LOW42 = U64((1 << 48) - 1), U64((1 << 42) - 1)


def ordered(s: Sets, rarity: Callable[[Sets], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each item, rarest first: item, token (its level and 42 bits of its hash), and each item's size and class key.

    Sizes and class keys see all 64 bits of the hashes: the key is of two sums over the set, one of the tokens' upper 42 bits and one of their lower 48.
    Tokens of one item with the same 42 bits (none, mostly) are listed each.
    """
    n_items = len(s.row)
    level = U64(0) if rarity is None else rarity(s).astype(U64)
    if n_items <= 1 << 16:  # item, level and token fit into one number, so a plain sort does
        key = (s.item.astype(U64) << U64(48)) | (s.token & _LOW48)
        key.sort()
        if len(key):
            key = key[np.r_[True, key[1:] != key[:-1]]]
        size, low = _sums((key >> U64(48)).astype(np.int64), key & _LOW48, n_items)
        key = (s.item.astype(U64) << U64(48)) | (level << U64(42)) | (s.token >> U64(22))
        key.sort()
        if len(key):
            key = key[np.r_[True, key[1:] != key[:-1]]]
        item, token = (key >> U64(48)).astype(np.int64), key & _LOW48
        found, high = _sums(item, token & _LOW42, n_items)
        if (size == found).all():
            return item, token, size, mix(high + U64(0x9E37) + mix(low ^ U64(0x51ED))).astype(np.int64)
    order = np.lexsort((s.token, np.broadcast_to(level, s.token.shape), s.item))
    full, item, level = s.token[order], s.item[order], np.broadcast_to(level, s.token.shape)[order]
    new = np.r_[True, (full[1:] != full[:-1]) | (item[1:] != item[:-1])] if len(full) else np.zeros(0, bool)
    full, item, level = full[new], item[new], level[new]

    def sums(value: np.ndarray) -> np.ndarray:
        at = np.lexsort((value, item))
        v, i = value[at], item[at]
        new = np.r_[True, (v[1:] != v[:-1]) | (i[1:] != i[:-1])] if len(v) else np.zeros(0, bool)
        return _sums(i[new], v[new], n_items)[1]

    k = mix(sums(full >> U64(22)) + U64(0x9E37) + mix(sums(full & _LOW48) ^ U64(0x51ED))).astype(np.int64)
    return item, (level << U64(42)) | (full >> U64(22)), np.bincount(item, minlength=n_items), k


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def _six(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _ends(pairs: DataFrame, *more: str) -> DataFrame:
    """k, n of both ends of the pairs, after other columns; repeated."""
    end = lambda i: F.struct(F.col(f"k{i}").alias("k"), F.col(f"n{i}").alias("n"))
    return pairs.select(*more, F.explode(F.array(end(1), end(2))).alias("e")).select(*more, "e.k", "e.n")


def _whole(b: bytes) -> np.ndarray:
    six = _unpack(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").reshape(-1)


def _by_frequency(tok: np.ndarray, k: np.ndarray, n: np.ndarray, pos: np.ndarray, prev: np.ndarray, parity: np.ndarray, wide: np.ndarray, dense: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Distinct postings by token, size and class: of tokens that fewer than `dense` classes have, and of the others (0: none)."""
    order = _by_token_size_class(tok, n, k)
    tok, k, n, pos, prev, parity, wide = tok[order], k[order], n[order].astype(np.int64), pos[order].astype(np.int64), prev[order], parity[order], wide[order]
    new = np.r_[True, (tok[1:] != tok[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])] if len(tok) else np.zeros(0, bool)
    all_of = tuple(c[new] for c in (tok, k, n, pos, prev, parity, wide))
    if not dense:
        return all_of, tuple(c[:0] for c in all_of)
    first = np.flatnonzero(np.r_[True, all_of[0][1:] != all_of[0][:-1]]) if len(all_of[0]) else np.zeros(0, int)
    length = np.diff(np.r_[first, len(all_of[0])])
    often = np.repeat(length >= dense, length)
    return (all_of, tuple(c[:0] for c in all_of)) if not often.any() else (tuple(c[~often] for c in all_of), tuple(c[often] for c in all_of))


def _met(tok: np.ndarray, k: np.ndarray, n: np.ndarray, pos: np.ndarray, prev: np.ndarray, parity: np.ndarray, wide: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of postings (by token, size, class) of one token that pass the length, positional and (for small sets) suffix filters and haven't met at the token before."""
    alive, step, got, size = np.arange(len(tok) - 1), 0, [], 0
    while len(alive):  # sizes ascend within a token: once a partner is too large, all later ones are
        step += 1
        alive = alive[alive + step < len(tok)]
        j = alive + step
        ok = (tok[alive] == tok[j]) & (n[j] * percent <= n[alive] * 100)
        alive, j = alive[ok], j[ok]
        good = (np.minimum(n[alive] - pos[alive], n[j] - pos[j]) * (100 + percent) >= (n[alive] + n[j]) * percent) & ((prev[alive] != prev[j]) | (prev[alive] == 0))
        left, j = alive[good], j[good]
        x, y = parity[left] ^ parity[j], wide[left] ^ wide[j]
        apart = np.where(n[left] > WIDE, np.bitwise_count(x) + np.bitwise_count(y), np.bitwise_count(x ^ y)).astype(np.int64)  # n ascends: the other is wide, too
        near = apart * (100 + percent) <= (n[left] + n[j]) * (100 - percent)
        left, j = left[near], j[near]
        if len(j):
            got.append(np.column_stack([k[left], n[left], k[j], n[j]]))
            size += len(got[-1])
        if got and (size > 1_000_000 or not len(alive)):
            yield _distinct(np.concatenate(got))
            got, size = [], 0


def _by_token_size_class(tok: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """np.lexsort((k, n, tok)) by one sort of a joint key; only ties are sorted by class."""
    if not len(tok) or n.max() >= 1 << 16:
        return np.lexsort((k, n, tok))
    key = tok << U64(16) | n.astype(U64)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    order[tied] = order[tied][np.lexsort((k[order[tied]], key[tied]))]
    return order


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    rows = rows[np.lexsort(rows.T)]
    return tuple(rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]].T)


@dataclass
class _Census:
    """Distinct tokens of a lot, ascending; whether two of its classes have it; the place of each of the lot's tokens among them."""

    tokens: np.ndarray
    shared: np.ndarray
    place: np.ndarray

    def by_bucket(self, buckets: int, below: int) -> Iterator[tuple[int, np.ndarray]]:
        """The places of tokens to ask for, bucket by bucket."""
        at = np.flatnonzero((self.tokens >> U64(42)) < U64(below))
        bucket = (mix(self.tokens[at]) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(at) else []
        for a, b in zip(edge, [*edge[1:], len(at)]):
            yield int(bucket[a]), at[a:b]


@dataclass
class _Held:
    """Items with their tokens in order: item of each token, token, and each item's size and key."""

    item: np.ndarray
    token: np.ndarray
    size: np.ndarray
    k: np.ndarray

    def census(self) -> _Census:
        _, own = np.unique(self.k, return_inverse=True)
        order = np.argsort(self.token)
        t, c = self.token[order], own[self.item[order]]
        head = np.r_[True, t[1:] != t[:-1]]
        first = np.flatnonzero(head)
        place = np.empty(len(t), np.int64)
        place[order] = np.cumsum(head) - 1
        return _Census(t[first], np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first), place)

    def once(self) -> np.ndarray:
        """Whether an item is the one of its class that has postings in this lot."""
        order = np.lexsort((self.size, self.k))
        k, n = self.k[order], self.size[order]
        out = np.zeros(len(self.size), bool)
        out[order] = np.r_[True, (k[1:] != k[:-1]) | (n[1:] != n[:-1])][: len(order)]
        return out

    def line_postings(self, shared_from: U64, percent: int) -> tuple[np.ndarray, ...]:
        """postings() of the tokens of level shared_from or more, which come last in each set, and the parity of the tokens with bit 6 where parity lacks those (n > WIDE)."""
        start = np.cumsum(self.size) - self.size
        parity, wide = np.zeros(len(self.size), U64), np.zeros(len(self.size), U64)
        full = np.flatnonzero(self.size)
        if len(full):
            bits = U64(1) << (self.token & U64(63))
            parity[full] = np.bitwise_xor.reduceat(bits, start[full])
            wide[full] = np.bitwise_xor.reduceat(bits * (self.token >> U64(6) & U64(1)), start[full])
        wide[self.size <= WIDE] = 0
        parity ^= wide
        length = np.where(self.once() & (self.size > 0), self.size - (percent * self.size + 99) // 100 + 1, 0)
        item = np.repeat(np.arange(len(self.size)), length)
        pos = np.arange(len(item)) - (np.cumsum(length) - length)[item]
        token = self.token[start[item] + pos]
        shared = token >> U64(42) >= shared_from
        prev = np.where((pos > 0) & np.r_[False, shared[:-1]], np.r_[U64(0), token[:-1]], U64(0)) if len(item) else token
        item = item[shared]
        return token[shared], self.k[item], self.size[item].astype(np.int32), np.minimum(pos[shared], 65535).astype(np.uint16), prev[shared], parity[item], wide[item]

    def postings(self, shared: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
        """token, k, n, pos, prev, parity of the shared tokens of all prefixes; prev is the shared token before it, 0 for the first;
        parity is the set's sketch in 64 bits, which for small sets is enough for the suffix filter; and zeros, as there is no wider one."""
        parity = np.zeros(len(self.size), U64)
        full = np.flatnonzero(self.size)
        if len(full):
            parity[full] = np.bitwise_xor.reduceat(U64(1) << (self.token & U64(63)), (np.cumsum(self.size) - self.size)[full])
        _, first = np.unique(np.column_stack([self.k, self.size]), axis=0, return_index=True)
        once = np.zeros(len(self.size), bool)
        once[first] = True  # of a class's items in this lot, one has postings
        shared = shared & once[self.item]
        item, token = self.item[shared], self.token[shared]
        count = np.bincount(item, minlength=len(self.size))
        place = np.arange(len(item)) - (np.cumsum(count) - count)[item]
        pos = (self.size - count)[item] + place  # unshared tokens come first
        take = pos < (self.size - (percent * self.size + 99) // 100 + 1)[item]
        prev = np.where(place > 0, np.r_[U64(0), token[:-1]], U64(0))[take] if len(item) else token
        return token[take], self.k[item][take], self.size[item][take].astype(np.int32), np.minimum(pos[take], 65535).astype(np.uint16), prev, parity[item][take], np.zeros(take.sum(), U64)


def _answers(path: str, block: int) -> dict[tuple[int, int], tuple[int, int, bytes]]:
    """What the shared folder holds for a task's block, by lot and bucket."""
    from pyarrow import dataset, fs

    where, inside = fs.FileSystem.from_uri(path)
    folder = f"{inside}/block={block}"
    if where.get_file_info(folder).type == fs.FileType.NotFound:
        return {}
    t = dataset.dataset(folder, filesystem=where, format="parquet").to_table(["lot", "bucket", "n", "total", "bits"])
    return {(r[0], r[1]): r[2:] for r in zip(*(c.to_pylist() for c in t.columns))}


@dataclass
class Rarity:
    """Levels 0 to 63 of a token: by its words' share of all words, as if they met by chance, or by its own
    bucket's count beyond what chance puts there, whichever is more."""

    words: np.ndarray  # 6 log2(1 + count) of a bucket
    tokens: np.ndarray | None  # log2 of a bucket's count beyond chance
    n: float

    def hot(self) -> int:
        """The level from which on a token's postings are too many for a bucket: its count is above the mean of a token bucket by far."""
        usual = 4 * self.n / (1 << BITS[1]) + 2000
        return min(63, int(2 * np.log2(usual) if self.tokens is None else 1.2 * np.log2(usual) + 36))

    def shared_from(self) -> int:
        """The least level of a single word that two items may have: a count of 1 is of one item, which makes level 2."""
        return 3

    def asked_below(self) -> int:
        return int(2 * np.log2(1 + SURELY_SHARED) if self.tokens is None else 1.2 * np.log2(SURELY_SHARED) + 36) + 1

    def __call__(self, s: Sets) -> np.ndarray:
        lw = self.words[_bucket(s.left, 0)] / np.float32(6)
        if s.right is None:
            return np.clip(np.rint(2 * lw), 0, 63)
        chance = lw + self.words[_bucket(s.right, 0)] / np.float32(6) - np.float32(np.log2(self.n + 1))
        level = np.maximum(chance, self.tokens[_bucket(s.token, 1)])
        return np.clip(np.rint(1.2 * level + 36), 0, 63)


def _bucket(h: np.ndarray, table: int) -> np.ndarray:
    return (h >> U64(64 - BITS[table])).astype(np.int64)


def _add(table: np.ndarray, at: np.ndarray) -> None:
    """Adds one at each place; a number of the table's own type keeps numpy on its fast path."""
    np.add.at(table, at, table.dtype.type(1))


def sketches(item: np.ndarray, token: np.ndarray, size: np.ndarray) -> bytes:
    """Parity sketches of all items, one after the other: bit t mod B is set when an odd number of tokens have it."""
    bits = sketch_bits(size)
    at = np.cumsum(bits) - bits
    odd = np.bincount(at[item] + (token.astype(np.int64) & (bits[item] - 1)), minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketch_bits(size: np.ndarray) -> np.ndarray:
    """Bits of a sketch: the power of two from 2 * size up, 32 at least; none for the empty set."""
    size = np.asarray(size, dtype=np.int64)
    return np.where(size > 0, 1 << np.ceil(np.log2(np.maximum(2 * size, 32))).astype(np.int64), 0)


def distance(a: bytes, b: bytes) -> int:
    """No more than the number of tokens that one of the two sets only has."""
    return _distance(int.from_bytes(a, "little"), 8 * len(a), int.from_bytes(b, "little"), 8 * len(b))


def _distance(x: int, x_bits: int, y: int, y_bits: int) -> int:
    while x_bits > y_bits:  # the longer sketch folded is the sketch of the shorter's length
        x_bits //= 2
        x = (x >> x_bits) ^ (x & ((1 << x_bits) - 1))
    while y_bits > x_bits:
        y_bits //= 2
        y = (y >> y_bits) ^ (y & ((1 << y_bits) - 1))
    return (x ^ y).bit_count()


_A = pa.schema([("kind", pa.int32()), ("piece", pa.int32()), ("counts", pa.binary()), ("doc", pa.binary()), ("row", pa.binary()), ("part", pa.binary()), ("k", pa.binary()), ("n", pa.binary()), ("sketch", pa.binary())])


class SetJoin:
    """The join over `texts` (doc_id, text, row; doc_id and row tell documents apart). `kind` makes a chunk's items; classes() and links() are its results."""

    def __init__(self, texts: DataFrame, kind: Callable[[np.ndarray, np.ndarray], Sets], percent: int, small: bool = False):
        """small: items are lines and tokens their words, whose counts tell rare ones without asking; doc_id and row must then be the same in each pass."""
        self.texts, self.kind, self.percent, self.small = texts, kind, percent, small
        self.spark = texts.sparkSession
        self.used: list[str] = []
        self.groups: DataFrame | None = None  # k, n, home of the classes of dense groups
        path = scratch(self.spark, "classes")
        self._first_pass().write.parquet(path)
        self.first = self.spark.read.parquet(path)

    def _first_pass(self) -> DataFrame:
        kind, small = self.kind, self.small

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(1 << b, np.int32) for b in BITS]
            for batch in batches:
                ids, rows = (batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in (0, 2))
                for i, j, data, off in chunks(batch.column(1), CACHED_BYTES):
                    s = kind(data, off)
                    item, token, size, k = ordered(s, None)
                    if small:
                        _add(counts[0], _bucket(token << U64(22), 0))
                    else:
                        _add(counts[0], _bucket(s.left, 0))
                        _add(counts[1], _bucket(s.token, 1))
                    yield record(_A, [0], [0], [b""], [_pack(ids[i:j][s.row])], [_pack(rows[i:j][s.row])], [_pack(s.part.astype(np.int32))], [_pack(k)], [_pack(size.astype(np.int32))], [b"" if small else sketches(item, token, size)])
            for which, c in enumerate(counts):
                if c.any():
                    for p in range(0, len(c), PIECE):
                        yield record(_A, [1 + which], [p // PIECE], [_pack(c[p : p + PIECE])], *([b""] for _ in range(6)))

        return self.texts.mapInArrow(run, "kind int, piece int, counts binary, doc binary, row binary, part binary, k binary, n binary, sketch binary")

    def rarity(self) -> Rarity:
        """The count tables summed: tables of a fixed size come to the driver, whatever the input."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for kind, piece, c in zip(*(batch.column(x).to_pylist() for x in range(3))):
                    c = _unpack(c, np.int32)
                    if (kind, piece) in total:
                        total[kind, piece] += c
                    else:
                        total[kind, piece] = c.astype(np.int64)
            if total:
                yield record(pa.schema(list(_A)[:3]), [k for k, _ in total], [p for _, p in total], [_pack(c) for c in total.values()])

        got = self.first.where("kind > 0").select("kind", "piece", "counts").repartition("kind", "piece").mapInArrow(add, "kind int, piece int, counts binary").collect()
        tables = [np.zeros(1 << b, np.int64) for b in BITS]
        for kind, piece, c in got:
            tables[kind - 1][piece * PIECE : (piece + 1) * PIECE] += _unpack(bytes(c), np.int64)
        n = float(tables[0].sum())
        words = np.rint(6 * np.log2(1 + tables[0])).astype(np.uint8)
        if not tables[1].any():
            return Rarity(words, None, n)
        chance = tables[1].mean()
        return Rarity(words, np.log2(np.maximum(tables[1] - 2 * chance - 3 * np.sqrt(chance), 2.0**-20)).astype(np.float32), n)

    def items(self) -> DataFrame:
        """doc, row, part, k, n of every item of every row, those with empty sets (n = 0) too."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("n", pa.int32())])
            for batch in batches:
                for doc, row, part, k, n in zip(*(batch.column(x).to_pylist() for x in range(5))):
                    yield record(schema, _unpack(doc, np.int64), _unpack(row, np.int64), _unpack(part, np.int32), _unpack(k, np.int64), _unpack(n, np.int32))

        return self.first.where("kind = 0").select("doc", "row", "part", "k", "n").mapInArrow(run, "doc long, row long, part int, k long, n int")

    def classes(self) -> DataFrame:
        """k, n, doc, row and part of the first item in order, copies: one row for each distinct set but the empty one."""
        return self.items().where("n > 0").groupBy("k", "n").agg(F.min(F.struct("doc", "row", "part")).alias("least"), F.count("*").alias("copies")).select("k", "n", "least.doc", "least.row", "least.part", "copies")

    def _held(self, shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[_Held]]:
        """Lots of a task's items with all their tokens; the same in each pass over the same partition."""
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[_Held]:
            got: list[tuple[np.ndarray, ...]] = []
            count = items = 0
            for batch in batches:
                for _, _, data, off in chunks(batch.column(1), CACHED_BYTES):
                    item, token, size, k = ordered(kind(data, off), shared.value)
                    got.append((item + items, token, size, k))
                    items += len(size)
                    count += len(token)
                    if count >= FLUSH:
                        yield _Held(*(np.concatenate(c) for c in zip(*got)))
                        got, count, items = [], 0, 0
            if count:
                yield _Held(*(np.concatenate(c) for c in zip(*got)))

        return run

    def _ask(self, shared: Broadcast, buckets: int, below: int) -> str:
        """A folder with, for each task of the texts (block), bits that tell which of its tokens are shared."""
        lots = self._held(shared)
        asked = pa.schema([("block", pa.int32()), ("lot", pa.int32()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("flags", pa.binary())])
        told = pa.schema([("block", pa.int32()), ("lot", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("total", pa.int64()), ("bits", pa.binary())])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = TaskContext.get().partitionId()
            for i, lot in enumerate(lots(batches)):
                c = lot.census()
                for bucket, at in c.by_bucket(buckets, below):
                    yield record(asked, [block], [i], [bucket], [pack_sorted(c.tokens[at])], [np.packbits(c.shared[at]).tobytes()])

        def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, tokens, flags = [], [], []
            for batch in batches:
                for block, lot, bucket, t, f in zip(*(c.to_pylist() for c in batch.columns)):
                    t = unpack_sorted(t)
                    rows.append((block, lot, bucket, len(t), int(t.sum().view(np.int64))))
                    tokens.append(t)
                    flags.append(np.unpackbits(np.frombuffer(f, np.uint8), count=len(t)).astype(bool))
            if not rows:
                return
            every = np.concatenate(tokens)
            order = np.argsort(every)
            head = np.r_[True, every[order][1:] != every[order][:-1]]
            group = np.cumsum(head) - 1
            many = (np.bincount(group) > 1) | (np.bincount(group, weights=np.concatenate(flags)[order]) > 0)
            known = np.zeros(len(every), bool)
            known[order] = many[group]
            bits = [np.packbits(b).tobytes() for b in np.split(known, np.cumsum([r[3] for r in rows])[:-1])]
            yield record(told, *zip(*rows), bits)

        path = scratch(self.spark, "shared")
        self.used.append(path)
        answers = self.texts.mapInArrow(ask, "block int, lot int, bucket int, tokens binary, flags binary").repartitionById(buckets, F.col("bucket"))
        answers.mapInArrow(tell, "block int, lot int, bucket int, n int, total long, bits binary").repartition("block").write.partitionBy("block").parquet(path)
        return path

    def candidates(self) -> DataFrame:
        """pairs(), computed and kept; what was written on the way is deleted."""
        got = cut(self.pairs(self.rarity()))
        for path in self.used:
            discard(self.spark, path)
        self.used.clear()
        return got

    def pairs(self, rarity: Rarity) -> DataFrame:
        """k1, n1, k2, n2: each candidate pair of classes once, but for those within a dense group."""
        percent, small = self.percent, self.small
        shared = self.spark.sparkContext.broadcast(rarity)
        # longer runs of a class in each, and about BUCKET_BYTES where there are few partitions for much text
        buckets = max(4, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 2, int(rarity.n * POSTING_BYTES / BUCKET_BYTES))
        # words are common in many lines that aren't alike: their postings are too many to be judged outside of a bucket
        dense = 0 if self.small else DENSE
        hot, below, shared_from = U64(rarity.hot()), rarity.asked_below(), U64(rarity.shared_from())
        lots, told = self._held(shared), None if self.small else self._ask(shared, buckets, below)
        schema = pa.schema([("bucket", pa.int32()), ("tok", pa.binary()), ("k", pa.binary()), ("n", pa.binary()), ("pos", pa.binary()), ("prev", pa.binary()), ("parity", pa.binary()), ("wide", pa.binary())])
        out = pa.schema([("tok", pa.int64()), ("k1", pa.int64()), ("n1", pa.int32()), ("k2", pa.int64()), ("n2", pa.int32()), ("pos", pa.int32()), ("prev", pa.int64()), ("parity", pa.int64())])
        ddl = "tok long, k1 long, n1 int, k2 long, n2 int, pos int, prev long, parity long"

        def sent(tok: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
            k = more[0]
            bucket = (mix(tok) % U64(buckets)).astype(np.int32)
            warm = (tok >> U64(42)) >= hot  # spread by class: their postings meet in a join that splits them further
            bucket[warm] = buckets + (mix(k[warm].view(U64)) % U64(buckets)).astype(np.int32)
            at = np.argsort(bucket.astype(np.uint16) if 2 * buckets < 1 << 16 else bucket, kind="stable")  # classes stay together
            bucket = bucket[at]
            edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(at) else []
            for a, b in zip(edge, [*edge[1:], len(at)]):
                x = at[a:b]
                k, n, pos, prev, parity, wide = (c[x] for c in more)
                yield record(schema, [bucket[a]], *([_pack(c)] for c in (_six(tok[x]), k, n, pos, _six(prev), parity, wide[n > WIDE] if small else wide[:0])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            answers = _answers(told, TaskContext.get().partitionId()) if told else {}
            for i, lot in enumerate(lots(batches)):
                if not told:
                    yield from sent(*lot.line_postings(shared_from, percent))
                    continue
                c = lot.census()
                known = c.shared | (c.tokens >> U64(42) >= U64(below))
                for bucket, at in c.by_bucket(buckets, below):
                    n, total, bits = answers.get((i, bucket), (0, 0, b""))
                    if n == len(at) and total == int(c.tokens[at].sum().view(np.int64)):
                        known[at] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                    else:
                        known[at] = True
                yield from sent(*lot.postings(known[c.place], percent))

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[np.ndarray, ...]]] = {}
            for batch in batches:
                for bucket, tok, k, n, pos, prev, parity, wide in zip(*(c.to_pylist() for c in batch.columns)):
                    own = (_whole(tok), _unpack(k, np.int64), _unpack(n, np.int32), _unpack(pos, np.uint16), _whole(prev), _unpack(parity, U64))
                    whole = np.zeros(len(own[2]), U64 if small else np.uint8)
                    if small:
                        whole[own[2] > WIDE] = _unpack(wide, U64)
                    own = (*own, whole)
                    if bucket < buckets:
                        held.setdefault(bucket, []).append(own)
                    else:
                        yield record(out, own[0].astype(np.int64), own[1], own[2], [None] * len(own[1]), [None] * len(own[1]), own[3].astype(np.int32), own[4].astype(np.int64), (own[5] ^ own[6]).view(np.int64))
            for bucket in list(held):  # its parts are free once they are joined
                few, often = _by_frequency(*(np.concatenate(x) for x in zip(*held.pop(bucket))), dense)
                if len(often[0]):
                    tok, k, n, pos, prev, parity, _ = often
                    none = [None] * len(k)
                    yield record(out, tok.astype(np.int64), k, n.astype(np.int32), none, none, pos.astype(np.int32), prev.astype(np.int64), parity.view(np.int64))
                for k1, n1, k2, n2 in _met(*few, percent):
                    none = [None] * len(k1)
                    yield record(out, none, k1, n1, k2, n2, none, none, none)

        path = scratch(self.spark, "pairs")
        self.used.append(path)
        self.texts.mapInArrow(run, "bucket int, tok binary, k binary, n binary, pos binary, prev binary, parity binary, wide binary").repartitionById(buckets, F.col("bucket") % buckets).mapInArrow(reduce, ddl).write.parquet(path)
        both = self.spark.read.schema(ddl).parquet(path)
        own = both.where("tok is not null").select("tok", F.col("k1").alias("k"), F.col("n1").alias("n"), "pos", "prev", "parity").groupBy("tok", "k", "n").agg(F.min("pos").alias("pos"), F.min("prev").alias("prev"), F.min("parity").alias("parity"))
        own = cut(own) if dense else own
        keys = ("k1", "n1", "k2", "n2")
        pairs = both.where("tok is null").select(*keys)
        grouped = self._dense(own) if dense else None
        if grouped is not None:
            own = own.join(grouped, "tok", "left_anti")
        met = self._both(own, own).where(
            ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("k1") < F.col("k2")))) & self._pass() & ((F.col("prev1") != F.col("prev2")) | (F.col("prev1") == 0))
        )
        pairs = pairs.unionByName(met.select(*keys))
        if self.groups is not None:
            home = self.groups.select("k", "home").distinct()
            home = F.broadcast(home) if self.groups.count() <= BROADCAST_CLASSES else home
            for i in (1, 2):
                pairs = pairs.join(home.select(F.col("k").alias(f"k{i}"), F.col("home").alias(f"home{i}")), f"k{i}", "left")
            pairs = pairs.where("home1 is null or home2 is null or home1 <> home2").select(*keys)
        return pairs.distinct()

    @staticmethod
    def _both(a: DataFrame, b: DataFrame) -> DataFrame:
        """Postings of a and b that share a token, as columns 1 and 2."""
        a, b = (x.select("tok", *(F.col(c).alias(f"{c}{i}") for c in ("k", "n", "pos", "prev", "parity"))) for i, x in ((1, a), (2, b)))
        return a.join(b, "tok")

    def _pass(self) -> F.Column:
        """The length, positional and suffix filters of _met on _both()."""
        p, both = self.percent, F.col("n1") + F.col("n2")
        return (
            (F.greatest("n1", "n2") * p <= F.least("n1", "n2") * 100)
            & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) * (100 + p) >= both * p)
            & (F.bit_count(F.col("parity1").bitwiseXOR(F.col("parity2"))) * (100 + p) <= both * (100 - p))
        )

    def _dense(self, own: DataFrame) -> DataFrame | None:
        """Sets groups to the dense groups among the tokens of `own`, and gives their tokens (tok); None if there is none.

        Tokens that share a class are of one group. A group is left to pairs where all pairs in it would be more than its tokens' pairs.
        """
        many = own.groupBy("tok").agg(F.count("*").alias("f")).where(F.col("f") >= DENSE)
        if many.isEmpty():
            return None
        sample = own.join(many, "tok").where(F.pmod(F.xxhash64("k", "tok"), F.col("f")) < SAMPLED)
        share = self._both(sample, own).groupBy("tok").agg(F.avg(self._pass().cast("double")).alias("share")).where(F.col("share") >= DENSE_SHARE)
        tokens = cut(many.join(share, "tok").select("tok", "f"))
        members = own.join(tokens, "tok").select("tok", "k", "n")
        heads = cut(members.groupBy("tok").agg(F.min("k").alias("head")))
        linked = connected_components(members.join(heads, "tok").select("k", "head").distinct(), "k", "head")
        of_token = tokens.join(heads, "tok").join(linked.withColumnRenamed("vertex", "head"), "head").select("tok", "f", "component")
        most = of_token.groupBy("component").agg(F.sum(F.col("f").cast("double") * F.col("f")).alias("made"))
        taken = linked.groupBy("component").agg(F.count("*").alias("c")).join(most, "component").where(F.col("made") >= F.col("c").cast("double") * F.col("c")).select("component")
        groups = cut(members.select("k", "n").distinct().join(linked.join(taken, "component").select(F.col("vertex").alias("k"), F.col("component").alias("home")), "k"))
        if groups.isEmpty():
            return None
        self.groups = groups
        return of_token.join(taken, "component").select("tok")

    def near(self, placed: DataFrame) -> DataFrame:
        """The placed pairs whose sketches don't rule them out."""
        bloom = self.spark.sparkContext.broadcast(_bloom(_ends(placed)))
        percent = self.percent
        one = pa.schema([("k", pa.int64()), ("n", pa.int32()), ("sketch", pa.binary())])

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[int, int]] = set()
            for batch in batches:
                for k, n, sketch in zip(*(batch.column(x).to_pylist() for x in range(3))):
                    k, n = _unpack(k, np.int64), _unpack(n, np.int32)
                    size = sketch_bits(n) // 8
                    at = np.cumsum(size) - size
                    rows = []
                    for i in np.flatnonzero((n > 0) & _in_bloom(bloom.value, k)).tolist():
                        if (key := (int(k[i]), int(n[i]))) not in seen:
                            seen.add(key)
                            rows.append((*key, sketch[at[i] : at[i] + size[i]]))
                    if rows:
                        yield record(one, *zip(*rows))

        def judge(at: tuple, members: dict, wanted: list) -> list[tuple]:
            own = {m: (int.from_bytes(v[4], "little"), 8 * len(v[4])) for m, v in members.items()}
            return [(*at, a, b, c, d) for a, b, c, d in wanted if _distance(*own[a, b], *own[c, d]) * (100 + percent) <= (b + d) * (100 - percent)]

        picked = self.first.where("kind = 0").select("k", "n", "sketch").mapInArrow(pick, "k long, n int, sketch binary").groupBy("k", "n").agg(F.min("sketch").alias("payload"))
        none = picked.select("k", "n", F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("row"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("copies"), "payload")
        narrow = ("lo", "hi", "n1", "n2")
        schema = pa.schema([(c, pa.int32() if c in narrow else pa.int64()) for c in ("home", "lo", "hi", "k1", "n1", "k2", "n2")])
        return self._meet(placed, none, judge, schema, "home long, lo int, hi int, k1 long, n1 int, k2 long, n2 int")

    def line_sets(self, wanted: DataFrame) -> DataFrame:
        """sets() of lines: wanted has doc, row and part of one line of each class; only lines at such places are split into words."""
        bloom = self.spark.sparkContext.broadcast(_bloom(wanted.select("doc", "row", "part"), _place))
        schema = pa.schema([("k", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, rows = (batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in (0, 2))
                for i, j, data, off in chunks(batch.column(1)):
                    starts, own, number = _line_starts(data, off)
                    at = np.flatnonzero(_in_bloom(bloom.value, _place(ids[i:j][own], rows[i:j][own], number)))
                    if not len(at):
                        continue
                    # a line ends where the next one of its text starts, or its text; the \n before that is white space
                    last = np.r_[own[1:] != own[:-1], True][at]
                    ends = np.where(last, off[own[at] + 1], np.r_[starts[1:], 0][at] - 1)
                    some = [data[a:b] for a, b in zip(starts[at].tolist(), ends.tolist())]
                    s = lines(np.concatenate(some), np.r_[0, np.cumsum([len(x) for x in some])])
                    _, _, size, k = ordered(s, None)
                    first = np.searchsorted(s.item, np.arange(len(size) + 1)).tolist()
                    full = np.flatnonzero(size > 0)
                    yield record(schema, k[full], size[full].astype(np.int32), [np.unique(s.token[first[x] : first[x + 1]]).tobytes() for x in full.tolist()])

        return self.texts.mapInArrow(run, "k long, n int, tokens binary")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """k, n, tokens (whole hashes, ascending) of wanted classes and perhaps others; a class may come once from each task."""
        kind = self.kind
        bloom = self.spark.sparkContext.broadcast(_bloom(wanted))
        schema = pa.schema([("k", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, seen = bloom.value, set()
            for batch in batches:
                for _, _, data, off in chunks(batch.column(1), CACHED_BYTES):
                    s = kind(data, off)
                    _, _, size, k = ordered(s, None)
                    first = np.searchsorted(s.item, np.arange(len(size) + 1)).tolist()
                    rows = []
                    for i in np.flatnonzero((size > 0) & _in_bloom(bits, k)).tolist():
                        if (key := (int(k[i]), int(size[i]))) not in seen:
                            seen.add(key)
                            rows.append((*key, np.unique(s.token[first[i] : first[i + 1]]).tobytes()))
                    if rows:
                        yield record(schema, *zip(*rows))

        return self.texts.mapInArrow(run, "k long, n int, tokens binary")

    def verified(self, pairs: DataFrame, classes: DataFrame, found: Callable, schema: pa.Schema, ddl: str, settles: Callable | None = None) -> DataFrame:
        """`found` of each block, of dense groups too: it gets the members {(k, n): (doc, row, part, copies, ...)} and the linked pairs of them, and gives rows.

        settles: gives the end of a pair of which, once the pair is linked, other pairs that it would settle are needless. They may be left out.
        """
        percent = self.percent
        near = cut(self.placed(pairs))
        near = near if self.small else cut(self.near(near))
        wanted = _ends(near) if self.groups is None else _ends(near).unionByName(self.groups.select("k", "n"))
        if self.small:
            classes = cut(classes.join(wanted.distinct(), ["k", "n"], "left_semi"))
        sets = (self.line_sets(classes) if self.small else self.sets(wanted)).groupBy("k", "n").agg(F.min("tokens").alias("payload"))
        own = classes.join(sets, ["k", "n"]).select("k", "n", "doc", "row", "part", "copies", "payload")
        judge = lambda at, members, wanted: found(members, _all_linked(members, at, percent) if at[1] < 0 else _linked(members, wanted, percent, settles))
        return self._meet(near, own, judge, schema, ddl, self._dense_blocks())

    def _dense_blocks(self) -> DataFrame | None:
        """home, lo (below 0: -1 for lot 0, -2 for lot 1), hi, k, n, lot: the classes of dense groups in the blocks of each two lots."""
        if self.groups is None:
            return None
        lots = self.groups.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / DENSE_LOT), F.ceil(F.sum("n") / DENSE_TOKENS)).cast("int").alias("lots"))
        own = self.groups.join(lots, "home").withColumn("lot", F.pmod(F.xxhash64("k"), F.col("lots")).cast("int"))
        every = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        return every.select("home", (-1 - F.least("lot", "other")).alias("lo"), F.greatest("lot", "other").alias("hi"), "k", "n", "lot")

    def placed(self, pairs: DataFrame) -> DataFrame:
        """The pairs with their blocks: home, lo, hi.

        A pair's home is the least neighbour of either end; a home with more than LOT classes has blocks for each two lots of them.
        """
        both = pairs.unionByName(pairs.select(F.col("k2").alias("k1"), F.col("n2").alias("n1"), F.col("k1").alias("k2"), F.col("n1").alias("n2")))
        least = both.groupBy("k1", "n1").agg(F.min("k2").alias("m")).select("k1", "n1", F.least("k1", "m").alias("m"))
        homes = pairs.join(least.withColumnRenamed("m", "m1"), ["k1", "n1"]).join(least.select(F.col("k1").alias("k2"), F.col("n1").alias("n2"), F.col("m").alias("m2")), ["k2", "n2"])
        homes = homes.select(F.least("m1", "m2").alias("home"), "k1", "n1", "k2", "n2")
        lots = _ends(homes, "home").distinct().groupBy("home").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
        lot = lambda k: F.pmod(F.xxhash64(k), F.col("lots")).cast("int")
        placed = homes.join(lots, "home").withColumn("x", lot("k1")).withColumn("y", lot("k2"))
        return placed.select("home", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "k1", "n1", "k2", "n2")

    def _meet(self, placed: DataFrame, own: DataFrame, judge: Callable, schema: pa.Schema, ddl: str, more: DataFrame | None = None) -> DataFrame:
        """The rows that `judge` makes of each block of pairs, and of blocks of `more` classes without; own: k, n, doc, row, part, copies, payload of the classes."""
        block = ("home", "lo", "hi")
        members = _ends(placed, *block).distinct().withColumn("lot", F.lit(0))
        members = (members if more is None else members.unionByName(more)).join(own, ["k", "n"])
        no = lambda t: F.lit("" if t == "binary" else 0).cast(t)  # no nulls, so that numbers stay whole in numpy
        rows = members.select(*block, F.lit(0).alias("what"), "k", "n", no("long").alias("k2"), F.col("lot").alias("n2"), "doc", "row", "part", "copies", "payload").unionByName(
            placed.select(*block, F.lit(1).alias("what"), F.col("k1").alias("k"), F.col("n1").alias("n"), "k2", "n2", no("long").alias("doc"), no("long").alias("row"), no("int").alias("part"), no("long").alias("copies"), no("binary").alias("payload"))
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, members, wanted = None, {}, []
            for batch in batches:
                out = []
                own = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
                new = np.zeros(batch.num_rows, bool)
                new[:1] = True
                for c in own:
                    new[1:] |= c[1:] != c[:-1]
                first = np.flatnonzero(new).tolist()
                for i, j in zip(first, [*first[1:], batch.num_rows]):  # members of one block, or its pairs
                    here = tuple(int(c[i]) for c in own[:3])
                    if here != at:
                        if at is not None:
                            out += judge(at, members, wanted)
                        at, members, wanted = here, {}, []
                    k, n, k2, n2, doc, row, part, copies, payload = batch.columns[4:]
                    part_of = lambda c, i=i, j=j: c.slice(i, j - i)
                    if own[3][i]:
                        wanted += zip(*(part_of(c).to_numpy().tolist() for c in (k, n, k2, n2)))
                    else:
                        values = zip(*(part_of(c).to_pylist() for c in (doc, row, part, copies, payload, n2)))
                        members.update(zip(zip(part_of(k).to_numpy().tolist(), part_of(n).to_numpy().tolist()), values))
                if out:
                    yield record(schema, *zip(*out))
            if at is not None and (out := judge(at, members, wanted)):
                yield record(schema, *zip(*out))

        small_batches(self.texts)
        return rows.repartition(*block).sortWithinPartitions(*block, "what").mapInArrow(run, ddl)


def _linked(members: dict, wanted: list, percent: int, settles: Callable | None = None) -> list:
    """The wanted pairs that reach the threshold; of those that settle the same end, one."""
    tokens = {m: np.frombuffer(v[4], U64) for m, v in members.items()}
    sets: dict = {}

    def as_set(m: tuple) -> set:
        if m not in sets:
            sets[m] = set(tokens[m].tolist())
        return sets[m]

    out, settled = [], set()
    for a, b, c, d in wanted:
        x, y = (a, b), (c, d)
        if settles and (end := settles(members, x, y)) in settled:
            continue
        if b + d < 400:
            same = len(as_set(x) & as_set(y))
        else:
            both = np.concatenate((tokens[x], tokens[y]))
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
        if 100 * same >= percent * (b + d - same):
            out.append((x, y))
            if settles:
                settled.add(end)
    return out


def _all_linked(members: dict, at: tuple, percent: int) -> list:
    """The pairs of a dense group's block that reach the threshold: of its lot with itself, or of its one lot with the other."""
    keys = list(members)
    lot, size = np.array([members[m][5] for m in keys]), np.array([m[1] for m in keys])
    left, right = np.flatnonzero(lot == -1 - at[1]), np.flatnonzero(lot == at[2])
    tokens = [np.frombuffer(members[m][4], U64) for m in keys]
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(keys)), [len(x) for x in tokens])
    _, of, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # a token that one set has is in no intersection
    owner, of = owner[count[of] > 1], column[of[count[of] > 1]]
    same = np.zeros((len(left), len(right)), np.int64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        here = (of >= c) & (of < c + COLUMNS)
        has = np.zeros((len(keys), COLUMNS), bool)
        has[owner[here], of[here] - c] = True
        bits = np.packbits(has, axis=1).view(U64)
        bits = np.ascontiguousarray(bits[:, bits.any(axis=0)])
        other = bits[right]
        for i, x in enumerate(left.tolist()):
            same[i] += np.bitwise_count(bits[x] & other).sum(axis=1, dtype=np.int64)
    ok = 100 * same >= percent * (size[left][:, None] + size[right][None, :] - same)
    if -1 - at[1] == at[2]:
        ok = np.triu(ok, 1)
    return [(keys[i], keys[j]) for i, j in zip(*(x[y].tolist() for x, y in zip((left, right), np.nonzero(ok))))]


def _places(k: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(k.astype(np.int64).view(U64))
    return [((h >> U64(s)) % U64(bits)).astype(np.int64) for s in (0, 17, 34)]


def _place(doc: np.ndarray, row: np.ndarray, part: np.ndarray) -> np.ndarray:
    """A hash of a line's place."""
    doc, row, part = (np.asarray(x).astype(np.int64).view(U64) for x in (doc, row, part))
    return mix(mix(mix(doc) + row) + part).view(np.int64)


def _in_bloom(table: np.ndarray, k: np.ndarray) -> np.ndarray:
    out = np.ones(len(k), bool)
    for p in _places(k, 8 * len(table)):
        out &= (table[p >> 3] >> (p & 7).astype(np.uint8) & 1) == 1
    return out


def _bloom(wanted: DataFrame, key: Callable[..., np.ndarray] | None = None) -> np.ndarray:
    """A Bloom filter of keys (k, or what `key` makes of all columns), of 8 bits for each, BLOOM_BITS at most: the bits that tasks find are or-ed by range."""
    keys = wanted.count()
    bits = min(BLOOM_BITS, max(1 << 20, 1 << int(8 * keys).bit_length()))
    piece = min(bits // 8, 1 << 17)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for p in _places(key(*columns) if key else columns[0], bits):
                np.bitwise_or.at(got, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        for i in range(0, len(got), piece):
            if got[i : i + piece].any():
                yield record(schema, [i // piece], [_pack(got[i : i + piece])])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = _unpack(b, np.uint8)
                total[i] = total[i] | b if i in total else b
        for i, b in total.items():
            yield record(schema, [i], [_pack(b)])

    schema = pa.schema([("i", pa.int32()), ("bits", pa.binary())])
    table = np.zeros(bits // 8, np.uint8)
    for i, b in (wanted if key else wanted.select("k")).mapInArrow(run, "i int, bits binary").repartition("i").mapInArrow(join, "i int, bits binary").collect():
        table[i * piece : (i + 1) * piece] |= _unpack(bytes(b), np.uint8)
    return table
