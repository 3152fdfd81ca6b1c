"""Brown class-based bigram model: exchange clustering, and the log10 probabilities of texts.

Every word (lower-cased A-Z, between white space) of the training texts is put into one of the classes by exchange,
in two steps. First frequent words (`clustered` of all training tokens or more) and, for all others, 256 units by
their ending are moved between classes one by one while that raises the likelihood of the training bigrams. Then each
remaining word, however rare, leaves its ending's class for the class that its own neighbours make likeliest, in parallel
over the vocabulary against the tables of class bigrams: in `TURNS` turns, a share of the words by their hash in
each, with tables counted anew before it. As words of one turn don't see each other move, new classes arise in the first step only. What one word's removal changes in the cells that its own neighbours share with it is
left out of its gain. Only words that training hasn't seen go by their ending: by the class of most words
seen once that have it.

A text's probability is the product of class transitions (smoothed by `alpha`) and word emissions: a known word's share of its
class less what leaving-one-out counts leave for unknown words.

Counts cover all training texts. The vocabulary is never broadcast: texts are written as lots of places in the lot's own
sorted words; each lot sends its words to their buckets of the vocabulary and gets counts and classes back, in a file of its block.

Defined results: null and the empty text are one end token. Repeated rows are scored each. Without
training rows counts are zero. Words are told apart by 48-bit hashes and their ending's unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import scratch

from .common import documents, id_and_text, record, remainder
from .packing import COUNTED_DDL, Counter, pack, pack_sorted, total, unpack, unpack_sorted
from .textkernel import NOT_SPACE, U64, Words, chunks, mix, scan

CLASSES = 64
SHAPES = 256
CLUSTERED = 2.5e-4
SWEEPS = 4
TURNS = 2
ALPHA = 0.5
#: Words of a lot.
LOT = 1 << 20
#: In the low byte of a word's key: its neighbour's class, above it the side; or that the neighbour is the word itself.
RIGHT, SELF = 128, 127


def word_keys(w: Words) -> np.ndarray:
    """48 bits of a word's hash, then its unit among the endings, then a byte that is left free."""
    last = w.data[w.ends - 1].astype(U64)
    before = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(U64)
    return (w.hashes() & ~U64(0xFFFF)) | (mix(last << U64(8) | before) & U64(SHAPES - 1)) << U64(8)


def shape_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(8) & U64(SHAPES - 1)).astype(np.int64)


def place(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.full(len(x), -1)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return np.where(known[at] == x, at, -1)


def exchange(a: np.ndarray, b: np.ndarray, count: np.ndarray, units: int, fixed: int, classes: int, sweeps: int) -> np.ndarray:
    """Classes of units, from bigram counts. The last `fixed` units keep classes of their own (after `classes`).

    Each unit in turn, the most frequent first, moves to the class that gives the greatest
    sum of N(c, d) log N(c, d) less that of both margins.
    """
    n_all = classes + fixed
    often = np.bincount(a, weights=count, minlength=units) + np.bincount(b, weights=count, minlength=units)
    free = np.argsort(-often[: units - fixed], kind="stable")
    cls = np.zeros(units, np.int64)
    cls[free] = np.arange(len(free)) % classes
    cls[units - fixed :] = classes + np.arange(fixed)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    rows, cols = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    row_at, col_at = np.searchsorted(a[rows], np.arange(units + 1)), np.searchsorted(b[cols], np.arange(units + 1))
    big = np.zeros((n_all, n_all))
    np.add.at(big, (cls[a], cls[b]), count)
    for _ in range(sweeps):
        moved = 0
        for u in free.tolist():
            if not often[u]:
                continue
            r, c = rows[row_at[u] : row_at[u + 1]], cols[col_at[u] : col_at[u + 1]]
            own = float(count[r[b[r] == u]].sum())
            r, c = r[b[r] != u], c[a[c] != u]
            out = np.bincount(cls[b[r]], weights=count[r], minlength=n_all)
            inn = np.bincount(cls[a[c]], weights=count[c], minlength=n_all)
            old = cls[u]
            big[old] -= out
            big[:, old] -= inn
            big[old, old] -= own
            base = f(big)
            x, y = f(big + out[None, :]) - base, f(big + inn[:, None]) - base
            d = np.diagonal(big)
            gain = x.sum(axis=1) - np.diagonal(x) + y.sum(axis=0) - np.diagonal(y) + f(d + out + inn + own) - f(d)
            left, right, no, ni = big.sum(axis=1), big.sum(axis=0), out.sum() + own, inn.sum() + own
            gain -= f(left + no) - f(left) + f(right + ni) - f(right)
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            big[new] += out
            big[:, new] += inn
            big[new, new] += own
            cls[u] = new
            moved += new != old
        if not moved:
            break
    return cls


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(keys: np.ndarray, counts: np.ndarray, old_of_shape: np.ndarray, big: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and the class of each that gives the greatest sum of N(c, d) log N(c, d) less that of both margins.

    keys: words with, in the low byte, a neighbour's class and side, ascending; counts: how often. big: class bigrams with the words in the classes of their endings.
    """
    word = keys & ~U64(0xFF)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, int)
    of = np.cumsum(np.r_[True, word[1:] != word[:-1]]) - 1 if len(word) else np.zeros(0, int)
    own, code = word[first], (keys & U64(0xFF)).astype(np.int64)
    old = old_of_shape[shape_of(own)]
    n_all = len(big)
    right, same = (code & RIGHT) > 0, (code & SELF) == SELF
    d = np.where(same, 0, code & SELF)
    size = counts.astype(float)
    gain = np.zeros((len(own), classes))
    columns = np.arange(classes)
    for i in range(0, len(code), 1 << 14):
        s = slice(i, i + (1 << 14))
        cells = np.where(right[s, None], big[:classes].T[d[s]], big[:, :classes][d[s]])  # N(c, d) or N(d, c) for each c
        cells = np.where(same[s, None], np.diagonal(big)[None, :classes], cells)
        # in its own class the word is counted already
        cells = cells - np.where(columns[None, :] == old[of[s], None], size[s, None], 0.0)
        np.add.at(gain, of[s], _f(np.maximum(cells, 0) + size[s, None]) - _f(np.maximum(cells, 0)))
    for margin, mine in ((big.sum(axis=1), right | same), (big.sum(axis=0), ~right | same)):
        n = np.bincount(of, weights=np.where(mine, size, 0.0), minlength=len(own))
        without = np.maximum(margin[None, :classes] - np.where(columns[None, :] == old[:, None], n[:, None], 0.0), 0)
        gain -= _f(without + n[:, None]) - _f(without)
    new = gain.argmax(axis=1) if len(own) else np.zeros(0, np.int64)
    stay = gain[np.arange(len(own)), new] <= gain[np.arange(len(own)), old] + 1e-9
    return own, np.where(stay, old, new)


@dataclass
class ClassModel:
    """Clustered words and their classes; the class of each ending, for words without one of their own; log10 tables."""

    keys: np.ndarray
    cls: np.ndarray
    endings: np.ndarray
    classes: str  # a folder of the other words' classes
    tokens: int
    distinct: int
    ends: int
    step: np.ndarray  # log10 P(class | class)
    known: np.ndarray  # per class: log10((1 - unknown share) / tokens of the class)
    unknown: np.ndarray  # per class: log10 of the unknown share


def sequences(first: np.ndarray, unit: np.ndarray, end: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of all bigrams of all texts, the begin and end marks included; a text of k words has k + 1, in order."""
    n = np.diff(first)
    at = first[1:] + np.arange(len(n))  # place of each text's end in the sequence of words and ends
    seq = np.full(len(unit) + len(n), end)
    mask = np.ones(len(seq), bool)
    mask[at] = False
    seq[mask] = unit
    prev = np.r_[begin, seq[:-1]] if len(seq) else seq
    prev[first[:-1] + np.arange(len(n))] = begin
    return prev, seq


LOTS = pa.schema([("block", pa.int32()), ("lot", pa.int32()), ("ids", pa.list_(pa.int64())), ("first", pa.binary()), ("place", pa.binary()), ("words", pa.binary()), ("times", pa.binary())])
LOTS_DDL = "block int, lot int, ids array<long>, first binary, place binary, words binary, times binary"
CLASSES_DDL = "word long, cls int"


@dataclass
class Lot:
    """Texts as places of their words among the lot's distinct words (ascending); word i of text d is first[d] <= i < first[d + 1]."""

    block: int
    lot: int
    ids: pa.Array
    first: np.ndarray
    place: np.ndarray
    words: np.ndarray
    times: np.ndarray


def lots(texts: DataFrame) -> DataFrame:
    """The texts as lots, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            words, place, times = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True, return_counts=True)
            first = np.r_[0, np.cumsum(np.concatenate([n for _, _, n in held]))].astype(np.int64)
            ids = [x for i, _, _ in held for x in i.to_pylist()]
            return record(LOTS, [block], [number], [ids], [pack(first)], [pack(place.astype(np.uint32))], [pack_sorted(words)], [pack(times.astype(np.int64))])

        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for i, j, data, off in chunks(batch.column(1)):
                w = scan(data, off, NOT_SPACE)
                held.append((ids.slice(i, j - i), word_keys(w), w.counts()))
                size += len(w.starts) + j - i
                if size >= LOT:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    spark = texts.sparkSession
    path = scratch(spark, "lots")
    texts.mapInArrow(run, LOTS_DDL).write.parquet(path)
    return spark.read.schema(LOTS_DDL).parquet(path)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Lot]:
    for batch in batches:
        for i in range(batch.num_rows):
            block, lot, _, first, place, words, times = (c[i].as_py() if n != 2 else None for n, c in enumerate(batch.columns))
            yield Lot(block, lot, batch.column(2)[i].values, unpack(first, np.int64), unpack(place, np.uint32).astype(np.int64), unpack_sorted(words), unpack(times, np.int64))


def _by_bucket(words: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (mix(words >> U64(8)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(words) else []
    for a, b in zip(edge, [*edge[1:], len(words)]):
        yield int(bucket[order[a]]), order[a:b]


def ask(own: DataFrame, known: DataFrame, buckets: int) -> str:
    """A folder with, for each block of lots, the values (long, or -1) that `known` (word, value) has for the lots' words."""
    spark = own.sparkSession
    sent = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("lot", pa.int32()), ("words", pa.binary()), ("value", pa.binary())])
    ddl = "bucket int, block int, lot int, words binary, value binary"

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _each(batches):
            for bucket, at in _by_bucket(x.words, buckets):
                yield record(sent, [bucket], [x.block], [x.lot], [pack_sorted(x.words[at])], [None])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            words, value = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(words.view(U64))
            words, value = words.view(U64)[order], value[order]
            for bucket, at in _by_bucket(words, buckets):
                yield record(sent, [bucket], [-1], [-1], [pack_sorted(words[at])], [pack(value[at])])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in range(2)))
            size += batch.num_rows
            if size >= LOT:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, asked = [], []
        for batch in batches:
            for bucket, block, lot, words, value in zip(*(c.to_pylist() for c in batch.columns)):
                if block < 0:
                    table.append((unpack_sorted(words), unpack(value, np.int64)))
                else:
                    asked.append((bucket, block, lot, words))
        words, value = (np.concatenate(x) for x in zip(*table)) if table else (np.zeros(0, U64), np.zeros(0, np.int64))
        order = np.argsort(words)
        words, value = words[order], value[order]
        for bucket, block, lot, w in asked:
            at = place(words, unpack_sorted(w))
            yield record(sent, [bucket], [block], [lot], [b""], [pack(np.where(at >= 0, value[at], -1) if len(value) else np.full(len(at), -1))])

    path = scratch(spark, "told")
    wide = known.select(F.col("word").cast("long"), F.col("value").cast("long"))
    questions = own.mapInArrow(asked, ddl).unionByName(wide.mapInArrow(values, ddl)).repartitionById(buckets, F.col("bucket"))
    questions.mapInArrow(tell, ddl).select("block", "lot", "bucket", "value").repartition("block").write.partitionBy("block").parquet(path)
    return path


class Told:
    """Reads what ask() wrote, block by block; each lot's values stand in the order of its words."""

    def __init__(self, path: str, buckets: int):
        self.path, self.buckets, self.block, self.rows = path, buckets, None, {}

    def __call__(self, x: Lot) -> np.ndarray:
        if x.block != self.block:
            from pyarrow import dataset, fs

            where, inside = fs.FileSystem.from_uri(self.path)
            folder = f"{inside}/block={x.block}"
            self.block, self.rows = x.block, {}
            if where.get_file_info(folder).type != fs.FileType.NotFound:
                t = dataset.dataset(folder, filesystem=where, format="parquet").to_table(["lot", "bucket", "value"])
                self.rows = {r[:2]: r[2] for r in zip(*(c.to_pylist() for c in t.columns))}
        out = np.empty(len(x.words), np.int64)
        for bucket, at in _by_bucket(x.words, self.buckets):
            out[at] = unpack(self.rows[x.lot, bucket], np.int64)  # a lot without its answer is an error
        return out


def _table(own: DataFrame, of_words: Callable[[], Callable[[Lot], np.ndarray]], classes: int) -> np.ndarray:
    """Counts of class bigrams; of_words() makes a task's function from lots to the classes of their words."""
    n = classes + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out = of_words(), np.zeros(n * n, np.int64)
        for x in _each(batches):
            a, b = sequences(x.first, of(x)[x.place], classes, classes + 1)
            out += np.bincount(a * n + b, minlength=n * n)
        yield pa.RecordBatch.from_arrays([pa.array([pack(out)], pa.binary())], names=["counts"])

    return sum((unpack(bytes(r[0]), np.int64) for r in own.mapInArrow(run, "counts binary").collect()), np.zeros(n * n, np.int64)).reshape(n, n).astype(float)


def likelihood(big: np.ndarray) -> float:
    """What the exchange raises."""
    return float(_f(big).sum() - _f(big.sum(axis=0)).sum() - _f(big.sum(axis=1)).sum())


def train(texts: DataFrame, *, classes: int = CLASSES, clustered: float = CLUSTERED, sweeps: int = SWEEPS, alpha: float = ALPHA, turns: int = TURNS) -> tuple[ClassModel, DataFrame]:
    """The model, and the vocabulary (word long, count long)."""
    if classes + 2 > SELF:
        raise ValueError(f"{SELF - 2} classes at most")
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = lots(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter(buckets, 8)
        for x in _each(batches):
            yield from c.add(x.words, x.times)
        yield from c.flush()

    pairs = pa.schema([("word", pa.int64()), ("count", pa.int64())])
    path = scratch(spark, "vocabulary")
    total(own.mapInArrow(count, COUNTED_DDL), lambda k, c: iter([record(pairs, k.view(np.int64), c)]), "word long, count long", buckets).write.parquet(path)
    vocabulary = spark.read.schema("word long, count long").parquet(path)
    ends = own.agg(F.sum(F.size("ids"))).first()[0] or 0
    n, v = vocabulary.agg(F.sum("count"), F.count("*")).first()
    n, v = (n or 0) + ends, v + (ends > 0)
    got = vocabulary.where(F.col("count") >= max(2.0, clustered * n)).collect()  # 1 / clustered words at most
    top = np.sort(np.array([r.word for r in got], dtype=np.int64).view(U64))
    m = len(top)
    end, begin, units = m + SHAPES, m + SHAPES + 1, m + SHAPES + 2

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter(buckets)
        for x in _each(batches):
            at = place(top, x.words)
            a, b = sequences(x.first, np.where(at >= 0, at, m + shape_of(x.words))[x.place], end, begin)
            yield from c.add(a.astype(U64) << U64(32) | b.astype(U64))
        yield from c.flush()

    packed = pa.schema([("keys", pa.binary()), ("counts", pa.binary())])
    rows = total(own.mapInArrow(bigrams, COUNTED_DDL), lambda k, c: iter([record(packed, [pack_sorted(k)], [pack(c)])]), "keys binary, counts binary", buckets).collect()
    # units are at most 1 / clustered + 258, so the pairs are bounded
    k = np.concatenate([unpack_sorted(bytes(r["keys"])) for r in rows] + [np.zeros(0, U64)])
    c = np.concatenate([unpack(bytes(r["counts"]), np.int64) for r in rows] + [np.zeros(0, np.int64)]).astype(float)
    order = np.argsort(k)
    k, c = k[order], c[order]
    a, b = (k >> U64(32)).astype(np.int64), (k & U64(0xFFFFFFFF)).astype(np.int64)
    cls = exchange(a, b, c, units, 2, classes, sweeps)
    endings = cls[m : m + SHAPES]
    cls = cls[:m]

    # the other words, a share of them in each turn
    found: DataFrame | None = None
    told: str | None = None
    folder = scratch(spark, "classes")
    placed = pa.schema([("word", pa.int64()), ("cls", pa.int32())])

    def of_words(told: str | None) -> Callable[[], Callable[[Lot], np.ndarray]]:
        def make() -> Callable[[Lot], np.ndarray]:
            answers = Told(told, buckets) if told else lambda x: np.full(len(x.words), -1)
            return lambda x: known_classes(x.words, top, cls, endings, answers(x))

        return make

    for turn in range(turns):
        big = _table(own, of_words(told), classes)
        make = of_words(told)

        def contexts(batches: Iterator[pa.RecordBatch], turn=turn, make=make) -> Iterator[pa.RecordBatch]:
            of, c = make(), Counter(buckets, 8)
            for x in _each(batches):
                own = (place(top, x.words) < 0) & ((mix(x.words >> U64(8)) >> U64(40)) % U64(turns) == U64(turn))
                words = len(x.words)
                a, b = sequences(x.first, x.place, words, words + 1)
                code = np.r_[of(x), classes, classes + 1]
                moves = np.r_[own, False, False]
                key = np.r_[x.words, U64(0), U64(0)]
                same = a == b
                r, l = moves[a], moves[b] & ~same
                yield from c.add(np.r_[key[a[r]] | np.where(same[r], SELF, code[b[r]] | RIGHT).astype(U64), key[b[l]] | code[a[l]].astype(U64)])
            yield from c.flush()

        def move(k: np.ndarray, n: np.ndarray, big=big) -> Iterator[pa.RecordBatch]:
            w, new = best_classes(k, n, endings, big, classes)
            yield record(placed, w.view(np.int64), new.astype(np.int32))

        total(own.mapInArrow(contexts, COUNTED_DDL), move, CLASSES_DDL, buckets).write.mode("append").parquet(folder)
        found = spark.read.schema(CLASSES_DDL).parquet(folder)
        told = ask(own, found.select("word", F.col("cls").alias("value")), buckets)
    big = _table(own, of_words(told), classes)
    step = np.log10((big + alpha) / (big.sum(axis=1, keepdims=True) + alpha * (classes + 1)))
    # of each class: its tokens, and words seen once, by their ending
    t, once = big[:, :classes].sum(axis=0), np.zeros((SHAPES, classes))
    for r in vocabulary.where("count = 1").join(found, "word").groupBy(F.shiftright("word", 8).bitwiseAND(SHAPES - 1).alias("s"), "cls").count().collect():
        once[r.s, r.cls] += r["count"]
    t, o = np.r_[t, 0, 0], np.r_[once.sum(axis=0), 0, 0]
    unknown = (o + 0.5) / (t + 1)
    endings = np.where(once.any(axis=1), once.argmax(axis=1), endings)
    return ClassModel(top, cls, endings, folder, n, v, ends, step, np.log10((1 - unknown) / np.maximum(t, 1)), np.log10(unknown)), vocabulary


def known_classes(words: np.ndarray, top: np.ndarray, cls: np.ndarray, endings: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Classes of words: of a clustered one, its own (-1: none), or that of its ending."""
    at = place(top, words)
    out = np.where(own >= 0, own, endings[shape_of(words)])
    return np.where(at >= 0, cls[at], out) if len(cls) else out


def score(texts: DataFrame, model: ClassModel, vocabulary: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of texts (doc_id, text)."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = lots(texts)
    # one number for both: the count, and the class or 255 for a clustered word
    found = spark.read.schema(CLASSES_DDL).parquet(model.classes)
    values = vocabulary.join(found, "word", "left").select("word", (F.col("count") * 256 + F.coalesce("cls", F.lit(255))).alias("value"))
    told = ask(own, values, buckets)
    shared = spark.sparkContext.broadcast(model)
    per = float(np.log10(model.tokens + model.distinct + 1))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, answers, classes = shared.value, Told(told, buckets), len(shared.value.step) - 2
        for x in _each(batches):
            value = answers(x)
            count = np.where(value >= 0, value >> 8, 0)
            cls = known_classes(x.words, m.keys, m.cls, m.endings, np.where((value >= 0) & (value & 255 != 255), value & 255, -1))
            n = len(x.first) - 1
            words = np.diff(x.first)
            doc = np.repeat(np.arange(n), words)
            a, b = sequences(x.first, cls[x.place], classes, classes + 1)
            emitted = np.where(count > 0, np.log10(np.maximum(count, 1)) + m.known[cls], m.unknown[cls])
            score = np.bincount(np.repeat(np.arange(n), words + 1), weights=m.step[a, b], minlength=n) + np.bincount(doc, weights=emitted[x.place], minlength=n)
            base = np.bincount(doc, weights=np.log10(count + 1.0)[x.place], minlength=n) + np.log10(m.ends + 1.0) - per * (words + 1)
            known = np.bincount(doc, weights=(count > 0)[x.place], minlength=n).astype(np.int64) + (m.ends > 0)
            yield record(schema, x.ids, words + 1, known, np.full(n, m.tokens), base, score)

    return own.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, vocabulary = train(id_and_text(docs.where(remainder("doc_id", 7) != 2)))
    return score(id_and_text(docs), model, vocabulary).select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
