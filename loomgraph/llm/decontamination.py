"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are windows of `width` consecutive words of a benchmark item (the whole item where it
has fewer). Patterns of one length m form a search: blocks of B = 2 words (1 for patterns of a
single word) have a shift table. A block that ends no pattern's first m words at any place has the
greatest shift m - B + 1, so looking at every (m - B + 1)-th block of a text is enough to find
all places where a pattern can be; where a looked-at block is in the table, the ends that its
shifts allow are tried: their last block must be a pattern's (suffix-hash bucket), the hash of
the m words must be one of the bucket's, and the words are then compared directly.

Words are told apart by their 64-bit hashes; the direct comparison is of their bytes.

Defined results: null texts and texts without words have no words, no hits, no items, and are not
contaminated (the digest is that of the empty string). Items of equal text are all listed, an
item repeated under one id is listed once. The windows of items without an id count as hits, but no id is
listed for them. Repeated document rows give repeated rows.

A benchmark is read a block of bounded size at a time. At most BLOCKS_AT_ONCE searches are broadcast; a larger benchmark
takes several passes over the documents, between which what was found is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import discard, scratch, table

from .common import documents, fresh, id_and_text, record, small_batches
from .textkernel import ALNUM, U64, Words, buffers, chunks, mix, scan

WIDTH = 13
#: Bytes of benchmark text that one search holds, and searches that are broadcast together.
BLOCK_BYTES, BLOCKS_AT_ONCE = 8 << 20, 8


def _rolled(h: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of m words."""
    out = np.zeros(max(len(h) - m + 1, 0), U64)
    for k in range(m):
        out = mix(out * U64(0x100000001B3) + h[k : k + len(out)])
    return out


@dataclass
class _Length:
    """Patterns of m words. shift_keys: blocks with a shift below the greatest, and for each the
    places (as a bit mask of how far before a pattern's end the block ends); tail_keys: last blocks; runs: the patterns' hashes, sorted."""

    m: int
    block: int
    shift_keys: np.ndarray
    shift_bits: np.ndarray
    tail_keys: np.ndarray
    runs: np.ndarray
    begin: np.ndarray  # first word of each pattern in the benchmark
    first: np.ndarray  # items of pattern p: items[first[p] : first[p + 1]]
    items: np.ndarray


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == keys, at, -1)


def _pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left) * U64(0x100000001B3) + right)


class WindowSearch:
    """All windows of some items (id or None, text), ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str]], width: int = WIDTH):
        data, off = buffers(pa.array([t or "" for _, t in items], pa.large_string()))
        w = scan(data, off, ALNUM)
        self.raw, self.starts, self.ends = w.data.tobytes(), w.starts, w.ends
        ids = np.array([0 if i is None else i for i, _ in items], dtype=np.int64)
        known = np.array([i is not None for i, _ in items], dtype=bool)
        h, own, n = w.hashes(), w.text_of_word(), w.counts()
        self.lengths = [self._length(m, h, own, ids, known, np.minimum(n, width) == m) for m in np.unique(np.minimum(n, width)).tolist() if m]

    @staticmethod
    def _length(m: int, h: np.ndarray, own: np.ndarray, ids: np.ndarray, known: np.ndarray, wanted: np.ndarray) -> _Length:
        every = _rolled(h, m)
        at = np.flatnonzero((own[: len(every)] == own[m - 1 :]) & wanted[own[: len(every)]])
        runs, begin, pattern = np.unique(every[at], return_index=True, return_inverse=True)
        begin = at[begin]
        listed = known[own[at]]
        both = np.unique(np.column_stack([pattern[listed], ids[own[at[listed]]]]), axis=0)
        b = 2 if m > 1 else 1
        if b == 1:
            keys, bits = mix(h[begin]), np.ones(len(begin), np.int64)
            tails = keys
        else:
            keys = np.concatenate([_pair_key(h[begin + k], h[begin + k + 1]) for k in range(m - 1)])
            bits = np.repeat(1 << np.arange(m - 2, -1, -1, dtype=np.int64), len(begin))
            tails = keys[-len(begin) :]
        order = np.argsort(keys, kind="stable")
        keys, bits = keys[order], bits[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        first = np.searchsorted(both[:, 0], np.arange(len(runs) + 1))
        return _Length(m, b, keys[new], np.bitwise_or.reduceat(bits, new), np.unique(tails), runs, begin, first, both[:, 1])

    def _words(self, s: _Length, pattern: int) -> list[bytes]:
        at = int(s.begin[pattern])
        return [self.raw[self.starts[x] : self.ends[x]] for x in range(at, at + s.m)]

    def occurrences(self, w: Words) -> Iterator[tuple[_Length, np.ndarray, np.ndarray]]:
        """For each length: first words of occurrences, and the pattern of each."""
        h, doc, raw = w.hashes(), w.text_of_word(), None
        for s in self.lengths:
            reach = s.m - s.block + 1
            ends = np.arange(s.m - 1, len(h))
            if not len(ends):
                continue
            if s.block == 1:
                hit = np.flatnonzero(_find(s.shift_keys, mix(h)) >= 0)
            else:
                # every reach-th block; the block ending at word i
                look = np.arange(s.block - 1, len(h), reach)
                at = _find(s.shift_keys, _pair_key(h[look - 1], h[look]))
                look, bits = look[at >= 0], s.shift_bits[at[at >= 0]]
                tries = [look[(bits >> back & 1) == 1] + back for back in range(reach)]
                hit = np.unique(np.concatenate(tries)) if tries else look
                hit = hit[(hit >= s.m - 1) & (hit < len(h))]
                hit = hit[_find(s.tail_keys, _pair_key(h[hit - 1], h[hit])) >= 0]
            begin = hit - s.m + 1
            begin = begin[doc[begin] == doc[begin + s.m - 1]] if len(begin) else begin
            run = np.zeros(len(begin), U64)
            for k in range(s.m):
                run = mix(run * U64(0x100000001B3) + h[begin + k])
            p = _find(s.runs, run)
            begin, p = begin[p >= 0], p[p >= 0]
            if len(begin):
                raw = w.data.tobytes() if raw is None else raw
                same = [[raw[w.starts[x] : w.ends[x]] for x in range(i, i + s.m)] == self._words(s, q) for i, q in zip(begin.tolist(), p.tolist())]
                yield s, begin[same], p[same]

    def hits(self, w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A flag for each word that lies in an occurrence, and one for each text that has a window of `width` words."""
        delta, whole = np.zeros(len(w.starts) + 1, dtype=np.int64), np.zeros(len(w.first) - 1, bool)
        doc = w.text_of_word()
        for s, begin, _ in self.occurrences(w):
            np.add.at(delta, begin, 1)
            np.add.at(delta, begin + s.m, -1)
            if s.m == width:
                whole[doc[begin]] = True
        return np.cumsum(delta[:-1]) > 0, whole

    def search(self, w: Words) -> tuple[np.ndarray, list[np.ndarray]]:
        """A flag for each word that lies in an occurrence, and the ids of the items found in each text."""
        delta = np.zeros(len(w.starts) + 1, dtype=np.int64)
        pairs = []
        doc = w.text_of_word()
        for s, begin, p in self.occurrences(w):
            np.add.at(delta, begin, 1)
            np.add.at(delta, begin + s.m, -1)
            both = np.unique(np.column_stack([doc[begin], p]), axis=0)
            n = np.diff(s.first)[both[:, 1]]
            at = np.repeat(s.first[both[:, 1]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            pairs.append(np.column_stack([np.repeat(both[:, 0], n), s.items[at]]))
        items: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(w.first) - 1)
        if pairs:
            both = np.unique(np.concatenate(pairs), axis=0)
            for d, own in zip(*(lambda u, i: (u, np.split(both[:, 1], i[1:])))(*np.unique(both[:, 0], return_index=True))):
                items[d] = own
        return np.cumsum(delta[:-1]) > 0, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of bounded size (or of one longer item), streamed to the driver a partition at a time."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    block: list[tuple[int | None, str]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        if size and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def _groups(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, width: int) -> Iterator[tuple[list, bool]]:
    """Broadcast searches, BLOCKS_AT_ONCE or fewer, and whether they are the last."""
    group: list = []
    for block in _blocks(benchmark, id_col, text_col, block_bytes):
        if len(group) == BLOCKS_AT_ONCE:
            yield group, False
            for b in group:
                b.destroy()
            group = []
        group.append(benchmark.sparkSession.sparkContext.broadcast(WindowSearch(block, width)))
    yield group, True


def find_items(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items array<long> (sorted by number): one row per row."""
    spark = docs.sparkSession
    done = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64()))])
    more = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hit", pa.binary()), ("items", pa.list_(pa.int64()))])

    def search(searches: list, last: bool, again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).cast(pa.int64())
                before = [batch.column(c).to_pylist() for c in (2, 3)] if again else None
                for i, j, data, off in chunks(batch.column(1)):
                    w = scan(data, off, ALNUM)
                    hit, items = np.zeros(len(w.starts), bool), None
                    if again:
                        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(before[0][i:j], w.counts().tolist())]
                        hit |= np.concatenate([*flags, np.zeros(0, np.uint8)]).astype(bool)
                        items = [np.array(x, dtype=np.int64) for x in before[1][i:j]]
                    for s in searches:  # a text is read once, and met with each search
                        h, own = s.value.search(w)
                        hit |= h
                        items = own if items is None else [np.union1d(a, b) for a, b in zip(items, own)]
                    if last:
                        total = np.r_[0, np.cumsum(hit)]
                        yield record(done, ids.slice(i, j - i), w.counts(), total[w.first[1:]] - total[w.first[:-1]], items)
                    else:
                        yield record(more, ids.slice(i, j - i), batch.column(1).slice(i, j - i), [np.packbits(hit[a:b]).tobytes() for a, b in zip(w.first[:-1], w.first[1:])], items)

        return run

    state, path = id_and_text(docs, id_col, text_col), None
    for searches, last in _groups(benchmark, item_id, item_text, block_bytes, width):
        out = state.mapInArrow(search(searches, last, path is not None), "doc_id long, n_words long, n_hit long, items array<long>" if last else "doc_id long, text string, hit binary, items array<long>")
        if last:
            return out
        old, path = path, scratch(spark, "found")
        out.write.parquet(path)
        if old:
            discard(spark, old)
        state = spark.read.parquet(path)


def digests(found: DataFrame) -> DataFrame:
    """The result of find_items with the number of items, their digest and the verdict."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", share: int = 20, item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, whole_windows: bool = False) -> DataFrame:
    """The rows of docs (all columns) that aren't contaminated: no word, or fewer than one in `share`, lies in an occurrence.

    whole_windows: a window of `width` words is enough, however long the text; items of fewer words still go by the share.
    What several passes found (for a benchmark beyond what is broadcast at once) is kept in a column of its own meanwhile.
    """
    spark, schema, hits = docs.sparkSession, docs.schema, fresh("_hits", docs)
    columns = docs.columns
    at, with_hits = columns.index(text_col), docs.withColumn(hits, F.lit(None).cast("binary")).schema

    def search(searches: list, last: bool, again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, found = np.ones(batch.num_rows, bool), []
                for i, j, data, off in chunks(batch.column(at).cast(pa.string())):
                    w = scan(data, off, ALNUM)
                    hit, whole = np.zeros(len(w.starts), bool), np.zeros(j - i, bool)
                    if again:
                        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(batch.column(batch.num_columns - 1).slice(i, j - i).to_pylist(), w.counts().tolist())]
                        hit |= np.concatenate([*flags, np.zeros(0, np.uint8)]).astype(bool)
                    for s in searches:
                        h, own = s.value.hits(w, width)
                        hit |= h
                        whole |= own & whole_windows
                    total = np.r_[0, np.cumsum(hit)]
                    n = total[w.first[1:]] - total[w.first[:-1]]
                    keep[i:j] = ~(whole | (n > 0) & (share * n >= w.counts())) if last else ~whole
                    found += [] if last else [np.packbits(hit[a:b]).tobytes() for a, b in zip(w.first[:-1], w.first[1:])]
                own = list(batch.columns)[: batch.num_columns - again]
                if not last:
                    own.append(pa.array(found, pa.binary()))
                out = pa.RecordBatch.from_arrays(own, names=(columns if last else [*columns, hits]))
                yield out.filter(pa.array(keep))

        return run

    state, path = docs, None
    for searches, last in _groups(benchmark, item_id, item_text, block_bytes, width):
        out = small_batches(state).mapInArrow(search(searches, last, path is not None), schema if last else with_hits)
        if last:
            return out
        old, path = path, scratch(spark, "found")
        out.write.parquet(path)
        if old:
            discard(spark, old)
        state = spark.read.parquet(path)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))
