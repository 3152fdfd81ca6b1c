"""Quality classifier: compression under zstandard dictionaries.

One dictionary is built from good and one from bad labelled texts. A text that looks like
the good ones is smaller under the first. Each text is compressed in two views: as it is, and as its shape (every
letter the same, every capital, every digit), which tells form from words and so holds for words that no labelled text
has. In each view the difference of the two compressed sizes, normalised by the larger, and the
two compressed sizes against the raw size, are calibrated to a probability by a logistic fit in which each labelled text is
measured under dictionaries that haven't seen it, once as it is and once in cipher (letters permuted at random),
so that unknown words are calibrated too. Measures beyond `FAR` deviations count as that many.

The fit reads a bounded sample of the labelled rows: `per_class` rows of each class (those first
by a hash of the id), of at most `max_bytes` bytes each. Scoring reads every text as a whole.

Defined results: null scores as the empty text, which has a score like any other. Labels that are
null, or neither 0 nor 1, are left out of the fit. Without labels of both classes the score is
the share of good ones among the labels (0.5 without any). Repeated rows give repeated rows; ties don't occur.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import table

from .common import documents, id_and_text, record, remainder

PER_CLASS = 4000
MAX_BYTES = 1 << 15
#: Of the view as it is, and of the shapes.
DICTIONARY_BYTES = (1 << 17, 1 << 15)
LEVEL = 3
FAR = 4.0


def _shapes() -> bytes:
    t = np.arange(256, dtype=np.uint8)
    t[65:91], t[97:123], t[128:], t[48:58] = 65, 97, 97, 48
    return t.tobytes()


SHAPE = _shapes()


def cipher(rng: random.Random) -> bytes:
    """A translation table that permutes the letters A-Z (capitals alike), and the trailing bytes of all other characters."""
    letters, rest = list(range(26)), list(range(0x80, 0xC0))
    rng.shuffle(letters)
    rng.shuffle(rest)
    t = bytearray(range(256))
    for i, j in enumerate(letters):
        t[97 + i], t[65 + i] = 97 + j, 65 + j
    t[0x80:0xC0] = bytes(rest)
    return bytes(t)


@dataclass
class CompressionModel:
    """pairs: for each view, the dictionaries of good and of bad texts."""

    pairs: list[tuple[bytes, bytes]]
    weights: np.ndarray | None
    mean: np.ndarray
    scale: np.ndarray
    base: float

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_ready"} | {"_ready": None}

    def features(self, texts: list[bytes]) -> np.ndarray:
        if self._ready is None:
            self._ready = [tuple(_compressor(d) for d in p) for p in self.pairs]
        n = np.array([len(t) for t in texts], dtype=float)
        columns = []
        for view, (a, b) in enumerate(self._ready):
            seen = [t.translate(SHAPE) for t in texts] if view else texts
            g, q = (np.array([len(c.compress(t)) for t in seen], dtype=float) for c in (a, b))
            columns += [(g - q) / np.maximum(np.maximum(g, q), 1), np.log((g + 8) / (n + 8)), np.log((q + 8) / (n + 8))]
        return np.column_stack([*columns, np.log(n + 8)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        return _logistic(_expanded(self._scaled(self.features(texts))) @ self.weights)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -FAR, FAR)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False, write_checksum=False)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _expanded(x: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    return np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i in range(k) for j in range(i, k))])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Newton's method; the first column (of ones) isn't held small."""
    b = np.zeros(x.shape[1])
    hold = np.full(len(b), ridge)
    hold[0] = 1e-6
    for _ in range(rounds):
        p = _logistic(x @ b)
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(hold), x.T @ (weight * (y - p)) - hold * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _dictionary(texts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, texts, k=64, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:  # too few texts to choose from: all of them are the dictionary
        return b"\n".join(texts)[-size:] or b"\n" * 8


def _pairs(good: list[bytes], bad: list[bytes]) -> list[tuple[bytes, bytes]]:
    shapes = [[t.translate(SHAPE) for t in texts] for texts in (good, bad)]
    return [tuple(_dictionary(t, size) for t in texts) for texts, size in zip(((good, bad), shapes), DICTIONARY_BYTES)]


def fit_texts(good: list[bytes], bad: list[bytes], share_good: float, folds: int = 2) -> CompressionModel:
    """share_good is the share of good labels in all. Each fold is measured under dictionaries of the other folds."""
    none = np.zeros(7)
    m = CompressionModel([], None, none, none + 1, share_good)
    n = min(len(good), len(bad))
    if n < 2 * folds:
        return m
    rng = random.Random(1)
    xs, ys = [], []
    for k in range(folds):  # dictionaries of equally many texts of either class
        fold = CompressionModel(_pairs(*([t for i, t in enumerate(texts[:n]) if i % folds != k] for texts in (good, bad))), None, none, none + 1, share_good)
        for y, texts in ((1.0, good), (0.0, bad)):
            own = [t for i, t in enumerate(texts) if i % folds == k]
            x = fold.features(own + [t.translate(cipher(rng)) for t in own])
            xs.append(x)
            ys.append(np.full(len(x), y))
    x, y = np.vstack(xs), np.concatenate(ys)
    m.pairs = _pairs(good[:n], bad[:n])
    w = np.where(y == 1, share_good / y.mean(), (1 - share_good) / (1 - y.mean()))
    m.mean, m.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    m.weights = fit_logistic(_expanded(m._scaled(x)), y, w, ridge=0.3)
    return m


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES) -> CompressionModel:
    """A model from `labels` (those rows only that may be learnt from), by a bounded sample of each class."""
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and key is not null")
    share = known.agg(F.avg("y")).first()[0]
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(per_class) for y in (1, 0)]
    chosen = first[0].union(first[1])  # 2 * per_class rows at most, so they can be broadcast
    texts = docs.select(F.col(id_col).alias("key"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("raw"))
    rows = texts.join(F.broadcast(chosen), "key").where(F.octet_length("raw") <= max_bytes).select("y", "raw", F.xxhash64("key").alias("h"), "key").limit(2 * per_class).collect()
    rows.sort(key=lambda r: (r.h, r.key, bytes(r.raw)))
    return fit_texts([bytes(r.raw) for r in rows if r.y], [bytes(r.raw) for r in rows if not r.y], 0.5 if share is None else float(share))


def score(docs: DataFrame, model: CompressionModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold): one row per row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield record(schema, batch.column(0).cast(pa.int64()), s, (s >= threshold).astype(np.int32))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: CompressionModel, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of `docs` (all columns, in their order) whose text scores at least `threshold`."""
    from .common import small_batches

    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score([t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()])
            yield batch.filter(pa.array(s >= threshold))

    return small_batches(docs).mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
