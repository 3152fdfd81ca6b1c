"""Toxicity by lexicon induction: random walks from labelled seed terms over a PPMI graph of terms.

Terms are lower-cased words (by a 64-bit hash where they are longer than 6 bytes) and, so that a word is also known by its stems, their first
4 and 6 bytes, up to the end of a character. Where a script has no spaces, a run of characters of 3 bytes or more also gives each two
neighbours. The graph's nodes are all terms that two or more labelled texts have, and those with at least
`least` of all terms (so 1 / least of them at most). Two nodes are linked where they occur together more
often than chance has it (positive pointwise mutual information): words next to one another, shortest stems within
`window` places, stop terms (above `most` of all) and words below `least` left out, and the terms of one word. Counts are over all texts; a pair counts from `support`
occurrences on, as the information of one or two is mostly chance. Seeds are terms
that labelled toxic texts have significantly more often; the counterpart are terms of the other labelled texts
by their frequency. The polarity of a term is the log ratio of two random walks with restart, one from
either, each raised by the share of `SMOOTH` occurrences. A word's polarity is the mean of its terms', and a text's polarities (the three greatest of its words, the mean) are calibrated by a logistic fit.

The labelled rows that seeds and fit read are a bounded sample: `per_class` of each class, first by a hash of
their id.

Defined results: null scores as the empty text, whose polarities are those of a neutral term. Labels that are null or
neither 0 nor 1 are left out; without labels of both classes the score is the share of toxic ones
(0.0 without any). Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import cut, table

from .common import documents, id_and_text, record, remainder
from .packing import COUNTED_DDL, Counter, pack, total, unpack
from .quality import _logistic, fit_logistic
from .textkernel import ALNUM, U64, Words, chunks, mix, scan

#: Bytes of stems; the longest is that of words which stand for themselves.
STEMS = (4, 6)
LEAST = 1e-6
MOST = 5e-3
WINDOW = 2
RESTART = 0.3
ROUNDS = 8
PER_CLASS = 8000
EDGE_PARTS = 32
SUPPORT = 3
SMOOTH = 1.0


def stems(w: Words, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size (at most 7, ascending), the first bytes of each word as a number, up to the end of a character; words have no byte 0, so it is unique.
    Last, the words themselves: the same number, or beyond the longest stem a hash with the first bit set."""
    out, cur = [], np.zeros(len(w.starts), U64)
    data = np.r_[w.data, np.zeros(8, np.uint8)]
    for k in range(sizes[-1]):
        at = w.starts + k
        cur = np.where(at < w.ends, (cur << U64(8)) | data[np.minimum(at, len(data) - 1)].astype(U64), cur)
        if k + 1 in sizes:
            out.append(cur)
    longer = w.ends - w.starts > sizes[-1]
    for i, size in enumerate(sizes):  # the bytes of a character that was cut are left out
        cut_at = w.starts + size
        inside = (cut_at < w.ends) & ((data[np.minimum(cut_at, len(data) - 1)] & 0xC0) == 0x80)
        own = out[i].copy()
        for _ in range(3):
            if not inside.any():
                break
            last = (own[inside] & U64(0xC0)) == U64(0x80)  # a trailing byte; the first of the character goes too
            own[inside] >>= U64(8)
            inside[np.flatnonzero(inside)[~last]] = False
        out[i] = own
    return [*out, np.where(longer, w.hashes() | U64(1 << 63), out[-1])]


def neighbours(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text, and number, of each two neighbouring characters of 3 bytes or more (their first 3 bytes) within a word."""
    lead = np.flatnonzero(w.data >= 0xE0)
    if not len(lead):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    size = np.where(w.data[lead] >= 0xF0, 4, 3)
    next_to = np.flatnonzero(lead[1:] == (lead + size)[:-1])
    a, b = lead[next_to], lead[next_to + 1]
    data, x = np.r_[w.data, np.zeros(4, np.uint8)], np.zeros(len(a), U64)
    for at in (a, a + 1, a + 2, b, b + 1, b + 2):
        x = (x << U64(8)) | data[at].astype(U64)
    word = np.searchsorted(w.starts, a, side="right") - 1
    return np.searchsorted(w.first, word, side="right") - 1, x | U64(1 << 62)


@dataclass
class Lexicon:
    """Nodes (sorted terms) with their polarities, the stem sizes, and the calibration."""

    terms: np.ndarray
    polarity: np.ndarray
    sizes: tuple[int, ...]
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    base: float = 0.0

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The three greatest polarities of each text's distinct words (0 where there are fewer), and their mean. A word has the mean of its terms."""
        w = scan(data, off, ALNUM)
        n = len(off) - 1
        out = np.zeros((n, 4))
        if not len(w.starts) or not len(self.terms):
            return out
        own, total, count, before = stems(w, self.sizes), np.zeros(len(w.starts)), np.zeros(len(w.starts)), None
        for s in own:
            at = _place(self.terms, s)
            new = at >= 0 if before is None else (at >= 0) & (at != before)
            total[new] += self.polarity[at[new]]
            count += new
            before = at
        doc, pairs = neighbours(w)
        at = _place(self.terms, pairs)
        there = count > 0
        doc = np.r_[w.text_of_word()[there], doc[at >= 0]]
        _, first = np.unique(mix(np.r_[own[-1][there], pairs[at >= 0]]) + doc.astype(U64) * U64(0x9E3779B97F4A7C15), return_index=True)
        doc, p = doc[first], np.r_[total[there] / count[there], self.polarity[at[at >= 0]]][first]
        order = np.lexsort((-p, doc))
        doc, p = doc[order], p[order]
        first = np.searchsorted(doc, np.arange(n))
        count = np.bincount(doc, minlength=n)
        for k in range(3):
            there = count > k
            out[there, k] = p[first[there] + k]
        some = count > 0
        out[some, 3] = np.bincount(doc, weights=p, minlength=n)[some] / count[some]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return _logistic(np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.weights)


def _place(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return np.where(known[at] == x, at, -1)


def _distinct_terms(w: Words, terms: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """text << 32 | node of each text's nodes, once each."""
    doc, keys = w.text_of_word(), []
    for s in stems(w, sizes):
        at = _place(terms, s)
        keys.append(np.unique((doc[at >= 0] << 32) | at[at >= 0]))
    doc, pairs = neighbours(w)
    at = _place(terms, pairs)
    return np.unique(np.concatenate([*keys, (doc[at >= 0] << 32) | at[at >= 0]]))


def term_counts(texts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """term (long), count of all texts."""
    buckets = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("term", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter(buckets)
        for batch in batches:
            for _, _, data, off in chunks(batch.column(1)):
                w = scan(data, off, ALNUM)
                own = stems(w, sizes)
                for i, s in enumerate(own):  # a word no longer than the stem before is counted there
                    yield from c.add(s if not i else s[s != own[i - 1]])
                yield from c.add(neighbours(w)[1])
        yield from c.flush()

    def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield record(schema, keys.astype(np.int64), counts)

    return total(texts.mapInArrow(run, COUNTED_DDL), out, "term long, count long", buckets)


def nodes(texts: DataFrame, sample: DataFrame, sizes: tuple[int, ...], least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Terms with a share of at least `least` and those that two texts of the sample have, sorted; their counts; and the count of all terms."""
    counts = cut(term_counts(texts, sizes))
    n = counts.agg(F.sum("count")).first()[0] or 0

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in chunks(batch.column(1)):
                w = scan(data, off, ALNUM)
                doc, more = neighbours(w)
                key = np.concatenate([*stems(w, sizes), more])
                of = np.r_[np.tile(w.text_of_word(), len(sizes) + 1), doc].astype(U64)
                _, once = np.unique(mix(key) + of * U64(0x9E3779B97F4A7C15), return_index=True)
                yield record(pa.schema([("term", pa.int64())]), key[once].view(np.int64))

    in_sample = sample.mapInArrow(own, "term long").groupBy("term").count().where("count >= 2").select("term")
    frequent = F.col("count") >= max(2.0, least * n)  # 1 / least rows at most
    rows = counts.where(frequent).unionByName(counts.where(~frequent).join(in_sample, "term", "left_semi")).toArrow()
    term, count = rows.column(0).to_numpy().view(U64), rows.column(1).to_numpy()
    order = np.argsort(term)
    return term[order], count[order], int(n)


#: Mark pairs of terms of one word, and pairs of whole words that stand next to one another.
OF_WORD, NEXT = U64(1 << 63), U64(1 << 62)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x, y).astype(U64) << U64(32) | np.maximum(x, y).astype(U64)


def graph(texts: DataFrame, terms: np.ndarray, counts: np.ndarray, n: int, sizes: tuple[int, ...], window: int, most: float, support: int = SUPPORT, least: float = 0.0) -> DataFrame:
    """a, b (places among the nodes), ppmi: each linked pair once."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    content = counts <= most * n if len(counts) > 100 else np.ones(len(counts), bool)
    frequent = content & (counts >= least * n)  # words below it, which few labelled texts have, hang on their stems
    shared = spark.sparkContext.broadcast((terms, counts, content, frequent))
    within = float(counts[content].sum())
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("ppmi", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, _, content, frequent = shared.value
        c = Counter(buckets)
        for batch in batches:
            for _, _, data, off in chunks(batch.column(1)):
                w = scan(data, off, ALNUM)
                if not len(w.starts) or not len(terms):
                    continue
                at, doc = [_place(terms, s) for s in stems(w, sizes)], w.text_of_word()
                for x, y in zip(at, at[1:]):
                    ok = (x >= 0) & (y >= 0) & (x != y)
                    yield from c.add(_pair(x[ok], y[ok]) | OF_WORD)
                for own, linked in ((at[0], content), (at[-1], frequent)):
                    keep = (own >= 0) & linked[own]
                    whole, place, of = own is at[-1], own[keep], doc[keep]
                    short = at[0][keep]
                    for k in range(1, 2 if whole else window + 1):
                        x, y = place[:-k], place[k:]
                        ok = (of[:-k] == of[k:]) & (x != y)
                        if whole:  # words that are their own shortest stems have met
                            ok &= (x != short[:-k]) | (y != short[k:])
                        yield from c.add(_pair(x[ok], y[ok]) | (NEXT if whole else U64(0)))
        yield from c.flush()

    def out(keys: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, counts, _, _ = shared.value
        keep = pairs >= support
        keys, pairs = keys[keep], pairs[keep]
        word, next_to = (keys & OF_WORD) != 0, (keys & NEXT) != 0
        keys = keys & ~(OF_WORD | NEXT)
        a, b = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
        # chance: 2 * window places for a pair, among content terms
        chance = np.where(word, counts[a] / n * counts[b], np.where(next_to, 2.0, 2.0 * window) * counts[a] / within * counts[b])
        ppmi = np.log(pairs / chance)
        good = ppmi > 0
        for i in range(0, int(good.sum()), 1 << 16):
            s = np.flatnonzero(good)[i : i + (1 << 16)]
            yield record(schema, a[s].astype(np.int32), b[s].astype(np.int32), ppmi[s].astype(np.float32))

    return total(texts.mapInArrow(run, COUNTED_DDL), out, "a int, b int, ppmi float", buckets)


def walk(edges: DataFrame, starts: np.ndarray, restart: float = RESTART, rounds: int = ROUNDS) -> np.ndarray:
    """Shares of time of random walks with restart; starts: a column of restart shares for each walk.

    Each round sends the shares out and gets a dense vector of sums back from each of a fixed number of partitions.
    """
    spark, n = edges.sparkSession, len(starts)
    edges = cut(edges.repartition(EDGE_PARTS, "a"))

    def moved(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, some = shared.value, False
            sums = np.zeros(own.shape)
            for batch in batches:
                a, b, p = (batch.column(i).to_numpy() for i in range(3))
                some = some or len(a) > 0
                for j in range(own.shape[1]):
                    sums[:, j] += np.bincount(b, weights=p * own[a, j], minlength=n) + np.bincount(a, weights=p * own[b, j], minlength=n)
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([pack(sums.astype(np.float64))], pa.binary())], names=["sums"])

        out = np.zeros(x.shape)
        for r in edges.mapInArrow(run, "sums binary").collect():
            out += unpack(bytes(r.sums), np.float64).reshape(x.shape)
        return out

    degree = moved(np.ones((n, 1)))
    x = starts
    for _ in range(rounds):
        to = moved(np.where(degree > 0, x / np.maximum(degree, 1e-12), 0))
        lost = 1 - to.sum(axis=0)  # shares of terms without a link go back to the start
        x = (1 - restart) * (to + lost * starts) + restart * starts
    return x


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, float]:
    """doc_id (0 for label 0, 1 for label 1), text of the sample; and the share of label 1 among all labels."""
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and key is not null")
    share = known.agg(F.avg("y")).first()[0]
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(first[0].union(first[1]))  # 2 * per_class rows at most
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).join(chosen, "key").select("y", "text"), 0.0 if share is None else float(share)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sizes: tuple[int, ...] = STEMS, least: float = LEAST, most: float = MOST, window: int = WINDOW, support: int = SUPPORT, per_class: int = PER_CLASS) -> Lexicon:
    texts = id_and_text(docs, id_col, text_col)
    sample, share = labelled(docs, labels, id_col, text_col, label_col, per_class)
    sample = cut(id_and_text(sample, "y", "text").distinct())  # a text that was copied counts once
    terms, counts, n = nodes(texts, sample, sizes, least)
    seen = _document_counts(sample, terms, sizes)
    toxic, other = (sample.where(F.col("doc_id") == y).count() for y in (1, 0))
    none = Lexicon(terms, np.zeros(len(terms)), sizes, base=share)
    if toxic < 2 or other < 2 or not len(terms):
        return none
    a, b = seen[1] + 0.5, seen[0] + 0.5
    odds = np.log(a / (toxic - seen[1] + 0.5)) - np.log(b / (other - seen[0] + 0.5))
    z = odds / np.sqrt(1 / a + 1 / b)
    seeds = np.where((z > 3) & (odds > 1.5), odds * np.minimum(seen[1], 100), 0.0)
    if not seeds.sum():
        seeds = np.maximum(z, 0) ** 2
    rest = np.where(seeds > 0, 0.0, seen[0])
    if not seeds.sum() or not rest.sum():
        return none
    p = walk(graph(texts, terms, counts, n, sizes, window, most, support, least), np.column_stack([seeds / seeds.sum(), rest / rest.sum()]))
    least_share = SMOOTH / n
    lexicon = Lexicon(terms, np.log((p[:, 0] + least_share) / (p[:, 1] + least_share)), sizes, base=share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1)):
                x = lexicon.features(data, off)
                yield record(pa.schema([("y", pa.int64()), *((f"x{k}", pa.float64()) for k in range(4))]), batch.column(0).cast(pa.int64()).slice(i, j - i), *x.T)

    got = np.array([tuple(r) for r in sample.mapInArrow(run, "y long, x0 double, x1 double, x2 double, x3 double").collect()])
    got = got[np.lexsort(got.T[::-1])]
    y, x = got[:, 0], got[:, 1:]
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    lexicon.mean, lexicon.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    lexicon.weights = fit_logistic(np.column_stack([np.ones(len(x)), (x - lexicon.mean) / lexicon.scale]), y, w, ridge=0.1)
    return lexicon


def _document_counts(sample: DataFrame, terms: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """For labels 0 and 1: in how many texts of the sample each node is."""
    shared = sample.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        out = np.zeros((2, len(terms)), np.int64)
        for batch in batches:
            y = batch.column(0).cast(pa.int64()).to_numpy()
            for i, j, data, off in chunks(batch.column(1)):
                w = scan(data, off, ALNUM)
                if len(w.starts) and len(terms):
                    key = _distinct_terms(w, terms, sizes)
                    np.add.at(out, (y[i:j][key >> 32], key & ((1 << 32) - 1)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([pack(out)], pa.binary())], names=["counts"])

    out = np.zeros((2, len(terms)), np.int64)
    for r in sample.coalesce(8).mapInArrow(run, "counts binary").collect():
        out += unpack(bytes(r.counts), np.int64).reshape(2, -1)
    return out


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), predicted: one row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1)):
                s = shared.value.score(shared.value.features(data, off))
                yield record(schema, batch.column(0).cast(pa.int64()).slice(i, j - i), s, (s >= threshold).astype(np.int32))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    lexicon = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs, lexicon).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
