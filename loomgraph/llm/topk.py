"""Exact top-k search by inner product, with a pivot-distance index.

With one more coordinate, sqrt(M^2 - |x|^2) for the greatest norm M, inner products become distances: the greatest
product has the least distance. Every vector is keyed by its nearest pivot and its distance from it, and the
index is sorted by that key, so that a run of rows is an annulus around a pivot. For a query, the triangle inequality bounds the
distance to all of an annulus from below, and so their inner products from above. Queries come in blocks sorted by their
nearest pivot; a block takes the annuli from the one with the best bound on, and stops where no bound reaches its queries' k-th scores.

Pivots are chosen on a bounded sample (`sample` rows first by a hash of the id), which also gives the first k-th
scores; every row is in the index. The index is met in phases, each GROWTH times as large as all before: each finds k-th scores for the next, so that a query has
some k * GROWTH candidates in each phase, whatever the input. Queries are a table in the shared folder that a task streams; neither they nor their results meet in one place.

Where vectors have no clusters (as random ones of many dimensions) distances concentrate and bounds rule out few rows: the search is then a blocked scan.

Defined results: vectors that are null, or hold a null or non-finite component, take no part. Components are
floor(256 * x). Vectors of unequal length are compared as if filled up with zeros; an empty vector is a zero vector. A row never finds a row of its own id. Of
repeated query ids one is asked (the least vector); repeated candidate rows are found each. Ties go to the smaller id. Scores beyond 64 bits become the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.session import cut, discard, scratch, table

from .common import record

PIVOTS = 64
#: Rows of the sample, and bytes that it has at most.
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
#: Queries that meet an annulus together.
BLOCK = 1 << 10
#: Rows of an annulus, and bytes of rows that a task holds at once.
ANNULUS, LOT_BYTES = 256, 64 << 20
GROWTH = 32


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v array<double> of floors, of the rows that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).select("vec_id", F.transform("x", lambda c: F.floor(c * 256).cast("double")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows filled up to dim; exact in float64 while products stay below 2**53, Python integers beyond."""
    off = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    n = np.diff(off)
    if len(n) and (n == dim).all():
        out = flat[off[0] : off[-1]].reshape(-1, dim)
    else:
        out = np.zeros((len(n), dim))
        for i, (a, b) in enumerate(zip(off[:-1], off[1:])):
            out[i, : b - a] = flat[a:b]
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**53:
        whole = [np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape) for m in (a, b)]
        return np.clip(whole[0] @ whole[1].T, -(2**63), 2**63 - 1).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each further pivot is the sampled vector that is farthest from those before."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    at, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(at) < min(count, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(axis=1))
    return sample[at]


class Space:
    """Vectors of `dim` components with the coordinate that turns products into distances, and the pivots there."""

    def __init__(self, pivots: np.ndarray, square: float):
        self.pivots, self.square = pivots, square
        self.rest = np.sqrt(np.maximum(0, square - (pivots**2).sum(axis=1)))

    def distances(self, m: np.ndarray, query: bool = False) -> np.ndarray:
        """Of rows (or of queries, whose further coordinate is 0) from all pivots."""
        own = (m**2).sum(axis=1)
        rest = np.zeros(len(m)) if query else np.sqrt(np.maximum(0, self.square - own))
        return np.sqrt(np.maximum(0, own[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * (m @ self.pivots.T) + (rest[:, None] - self.rest[None, :]) ** 2))


def build_index(vectors: DataFrame, space: Space, dim: int, parts: int) -> DataFrame:
    """vec_id, v, pivot, distance, sorted by the last two: a hot cell is many partitions' work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("pivot", pa.int32()), ("distance", pa.float64())])
        for batch in batches:
            d = space.distances(_matrix(batch.column(1), dim))
            nearest = d.argmin(axis=1)
            yield record(schema, batch.column(0), batch.column(1), nearest.astype(np.int32), d[np.arange(len(d)), nearest])

    keyed = vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, pivot int, distance double")
    return keyed.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")


class _Best:
    """The k best (score, id) of each query so far, best first, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def limit(self) -> np.ndarray:
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        if s.shape[1] > 4 * k:  # only what reaches the k-th best is sorted, ties included
            cut_at = ~np.partition(~s, k - 1, axis=1)[:, k - 1 : k]  # ~ turns the order without overflow
            most = int((s >= cut_at).sum(axis=1).max())
            if most < s.shape[1]:
                keep = np.argsort(~(s >= cut_at), axis=1, kind="stable")[:, :most]
                s, i = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
        order = np.lexsort((i, ~s), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def _query_blocks(path: str, dim: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, vectors and k-th scores so far of the queries in the shared folder, block by block."""
    from pyarrow import dataset, fs

    where, inside = fs.FileSystem.from_uri(path)
    for batch in dataset.dataset(inside, filesystem=where, format="parquet").to_batches(columns=["vec_id", "v", "floor"], batch_size=size, batch_readahead=1, fragment_readahead=1):
        if batch.num_rows:
            yield batch.column(0).to_numpy(), _matrix(batch.column(1), dim), batch.column(2).to_numpy()


class Search:
    """Of one task: lots of rows in the index's order, each met with all queries. looked and pairs: how many pairs of a query and a row were scored, and how many there are."""

    def __init__(self, space: Space, dim: int, k: int):
        self.space, self.dim, self.k, self.looked, self.pairs = space, dim, k, 0, 0

    def lot(self, vec: np.ndarray, m: np.ndarray, p: np.ndarray, d: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """query, row and score of the best rows of this lot for each query."""
        edges = np.unique(np.r_[0, np.flatnonzero(np.diff(p)) + 1, np.arange(0, len(p), ANNULUS), len(p)])
        first, last, pivot = edges[:-1], edges[1:] - 1, p[edges[:-1]]
        for ids, q, floor in blocks:
            best, to = _Best(len(ids), self.k, floor), self.space.distances(q, query=True)[:, pivot]
            near = np.maximum(0, np.maximum(d[first][None, :] - to, to - d[last][None, :]))
            whole = (q**2).sum(axis=1)[:, None] + self.space.square
            bound = (whole - near**2) / 2 + 1 + 1e-9 * whole
            self.pairs += len(ids) * len(vec)
            for ring in np.argsort(-bound.max(axis=0), kind="stable"):
                a, b = edges[ring], edges[ring + 1]
                own = np.flatnonzero(bound[:, ring] >= best.limit())
                if not len(own):
                    continue
                self.looked += len(own) * (b - a)
                s = _scores(q[own], m[a:b])
                s[vec[None, a:b] == ids[own][:, None]] = np.iinfo(np.int64).min
                hit = (s >= best.limit()[own][:, None]).any(axis=1)
                if hit.any():
                    best.add(own[hit], s[hit], vec[a:b])
            rows, place = np.nonzero((best.score > np.iinfo(np.int64).min) & (best.score >= floor[:, None]))
            yield ids[rows], best.id[rows, place], best.score[rows, place]


def search(index: DataFrame, queries: str, space: Space, dim: int, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score: for each query of the table in the shared folder, its k best rows of each lot of the index (fewer where bounds rule them out)."""
    lot_rows = max(1024, LOT_BYTES // (8 * dim))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, work = [], 0, Search(space, dim, k)

        def found() -> Iterator[pa.RecordBatch]:
            for found in work.lot(*(np.concatenate(c) for c in zip(*held)), _query_blocks(queries, dim, block)):
                yield record(schema, *found)

        for batch in batches:
            held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), dim), batch.column(2).to_numpy(), batch.column(3).to_numpy()))
            size += batch.num_rows
            if size >= lot_rows:
                yield from found()
                held, size = [], 0
        if size:
            yield from found()

    return index.mapInArrow(run, "query_id long, vec_id long, score long")


def phases(total: int, sample: int) -> list[float]:
    """Shares of the rows that are searched by the end of each phase."""
    out, size = [], sample * GROWTH
    while size < total:
        out.append(size / total)
        size *= GROWTH
    return [*out, 1.0]


def _with_floor(queries: DataFrame, space: Space, known: np.ndarray, known_ids: np.ndarray, dim: int, k: int) -> DataFrame:
    """vec_id, v, floor (the k-th score within the sample), pivot (the nearest)."""
    least = np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("floor", pa.int64()), ("pivot", pa.int32())])
        for batch in batches:
            floor = np.full(batch.num_rows, least)
            ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            for lo in range(0, len(q) if len(known) > k else 0, 1024):
                s = _scores(q[lo : lo + 1024], known)
                s[known_ids[None, :] == ids[lo : lo + 1024, None]] = least
                floor[lo : lo + 1024] = np.partition(s, -k, axis=1)[:, -k]
            yield record(schema, batch.column(0), batch.column(1), floor, space.distances(q, query=True).argmin(axis=1).astype(np.int32))

    return queries.mapInArrow(run, "vec_id long, v array<double>, floor long, pivot int")


def top_k(vectors: DataFrame, is_query, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the greatest inner products for each query row (a condition on vec_id)."""
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vector_col)
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    total, dim, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    fill = lambda v: np.r_[np.array(v, dtype=np.float64), np.zeros(dim - len(v))]
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * dim)))
    first = [(r.vec_id, fill(r.v)) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()]
    known, known_ids = np.array([v for _, v in first]).reshape(-1, dim), np.array([i for i, _ in first], dtype=np.int64)
    space = Space(pivots_of(known, pivots), float(most))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    asked = _with_floor(rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v")), space, known, known_ids, dim, k)
    asked = cut(asked.repartitionByRange(parts, "pivot", "vec_id").sortWithinPartitions("pivot", "vec_id"))
    turn = F.pmod(F.xxhash64("vec_id", F.lit("phase")), F.lit(1 << 30)) / float(1 << 30)
    best, low = None, 0.0
    for high in phases(total, sample):
        path = scratch(spark, "queries")
        asked.write.parquet(path)
        part = rows if (low, high) == (0.0, 1.0) else rows.where((turn >= low) & (turn < high))
        # a task has a few annuli at least, and one lot at most
        count = total * (high - low)
        tasks = max(min(parts, 1 + int(count) // (4 * ANNULUS)), int(count * dim * 8) // LOT_BYTES)
        found = search(build_index(part, space, dim, tasks), path, space, dim, k, block)
        found = found if best is None else found.unionByName(best)
        best = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"))
        discard(spark, path)
        if high < 1:
            floors = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("found"))
            asked = asked.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.greatest("floor", "found").alias("floor"), "pivot").repartitionByRange(parts, "pivot", "vec_id").sortWithinPartitions("pivot", "vec_id")
        low = high
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
