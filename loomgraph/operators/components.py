"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """vertex, component (the smallest vertex reachable): one row for each vertex that has an edge.

    Alternates large-star and small-star steps, so that the number of rounds grows as the
    logarithm of the diameter. A hub is never gathered: both steps need only the minimum
    of a vertex's neighbours, which is aggregated before it is shuffled. Self-loops and null ends are ignored;
    a vertex with nothing but those isn't listed.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # large star: neighbours above a vertex are linked to the least of its neighbours and itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a vertex and its lesser neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component"))).distinct()


def merged(pieces: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The least vertex of each vertex's component, for edges in pieces (u, v) over vertices 0 to n - 1."""
    label = np.arange(n)
    for u, v in pieces:
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def gathered(pieces: Iterable[tuple[np.ndarray, np.ndarray]], least: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces put together until they have `least` edges."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[0])
        if size >= least:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def numbered_components(edges: DataFrame, n: int, pieces=None) -> DataFrame:
    """vertex, component of edges (u, v) between the numbers 0 to n - 1; a vertex that is the least of its component isn't listed.

    Each partition, and then each of fewer and fewer groups of partitions, is replaced by the stars of its components, so that no
    more than n rows leave a task, which holds an array of n numbers and a bounded lot of edges. pieces: how a batch is read, if not as u, v.
    """
    ddl, names = "vertex long, component long", ["vertex", "component"]

    def stars(read):
        def run(batches):
            label = merged(gathered(read(b) for b in batches), n)
            at = np.flatnonzero(label != np.arange(n))
            for lo in range(0, len(at), 1 << 16):
                part = at[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(label[part])], names=names)

        return run

    columns = lambda b: (b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
    out = edges.mapInArrow(stars(pieces or columns), ddl)
    for groups in (8, 1):
        out = out.repartition(groups).mapInArrow(stars(columns), ddl)
    return cut(out)
