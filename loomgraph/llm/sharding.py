"""Sharding: best-fit-decreasing bin packing of indivisible groups, by the law `bytes` (sizes near equal).

Rows of equal text are one group; its size is the sum of its rows' (UTF-8 bytes and 1 more each). Groups
go in descending order of size into the bin with the least remaining room that still
holds them, found in a balanced tree of remaining rooms. Bins have one fixed capacity, the smallest (to within
a `tolerance` share) with which no bin beyond the shard count is opened.

Only the histogram (group size, number of groups) comes to the driver: groups of one size are alike, and a run of them that goes to one bin is one
step. Distinct sizes are far fewer than groups: with T bytes in all there are at most sqrt(2 T). Which groups of a size go where is by a
rank of the group's digest, given in parallel.

Defined results: null is a text of its own, of size 1, as is the empty text; both are groups like any other.
No rows give no rows. Ties of size are broken by digest. Rows of one group are numbered by doc_id; repeated rows in any order.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import cut

from .common import documents

SHARDS = 8
TOLERANCE = 1e-4


class Rooms:
    """Remaining rooms of the open bins in a balanced (AVL) tree, ordered by (room, bin)."""

    def __init__(self):
        self.root = None

    def insert(self, key: tuple[int, int]) -> None:
        self.root = _insert(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = _remove(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (room, bin) with room >= size."""
        node, best = self.root, None
        while node:
            if node[0] >= (size, -1):
                node, best = node[1], node[0]
            else:
                node = node[2]
        return best


# a node is [key, left, right, height]
def _height(t) -> int:
    return t[3] if t else 0


def _fixed(t):
    t[3] = 1 + max(_height(t[1]), _height(t[2]))
    lean = _height(t[1]) - _height(t[2])
    if lean > 1:
        if _height(t[1][1]) < _height(t[1][2]):
            t[1] = _turned(t[1], 2)
        return _turned(t, 1)
    if lean < -1:
        if _height(t[2][2]) < _height(t[2][1]):
            t[2] = _turned(t[2], 1)
        return _turned(t, 2)
    return t


def _turned(t, side: int):
    up, other = t[side], 3 - side
    t[side], up[other] = up[other], t
    for x in (t, up):
        x[3] = 1 + max(_height(x[1]), _height(x[2]))
    return up


def _insert(t, key):
    if t is None:
        return [key, None, None, 1]
    side = 1 if key < t[0] else 2
    t[side] = _insert(t[side], key)
    return _fixed(t)


def _remove(t, key):
    if t[0] == key:
        if not t[1] or not t[2]:
            return t[1] or t[2]
        low = t[2]
        while low[1]:
            low = low[1]
        t[0] = low[0]
        t[2] = _remove(t[2], low[0])
    else:
        side = 1 if key < t[0] else 2
        t[side] = _remove(t[side], key)
    return _fixed(t)


def pack(sizes: list[tuple[int, int]], capacity: int, most_bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first rank, end rank, bin) of a best-fit-decreasing packing of (size, number of items), sizes descending.

    None when an item is larger than the capacity or more than most_bins bins are opened.
    """
    rooms, bins, runs = Rooms(), 0, []
    for size, count in sizes:
        done = 0
        while done < count:
            fit = rooms.tightest(size)
            if fit is None:
                if size > capacity or bins == most_bins:
                    return None
                fit = (capacity, bins)
                bins += 1
                rooms.insert(fit)
            # the tightest bin stays the tightest until it holds no more
            n = min(count - done, fit[0] // size)
            rooms.remove(fit)
            rooms.insert((fit[0] - n * size, fit[1]))
            runs.append((size, done, done + n, fit[1]))
            done += n
    return runs


def assign(sizes: list[tuple[int, int]], shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int, int, int]]:
    """Runs as pack() gives them, into `shards` bins of the smallest capacity found. sizes: (size, number of groups), descending.

    A group as large as an equal share of what is left has a bin of its own; the others are packed into the other bins.
    """
    left, own = [list(s) for s in sizes], []
    total, bins = sum(s * n for s, n in sizes), shards
    while left and bins > 1 and left[0][0] * bins >= total:
        size, count = left[0]
        at = next(n for s, n in sizes if s == size) - count
        own.append((size, at, at + 1, shards - bins))
        total, bins = total - size, bins - 1
        left[0][1] -= 1
        if not left[0][1]:
            left.pop(0)
    if not left:
        return own
    rest = [(s, n) for s, n in left]
    low = ceil(total / bins)
    unit = max(1, int(low * tolerance))
    bad, high, step = low - 1, low, unit
    while (runs := pack(rest, high, bins)) is None:  # widen, then halve
        bad, high, step = high, high + step, 2 * step
    while high - bad > unit:
        mid = (bad + high) // 2
        if (found := pack(rest, mid, bins)) is None:
            bad = mid
        else:
            high, runs = mid, found
    shift = {s: next(m for t, m in sizes if t == s) - n for s, n in rest[:1]}
    return own + [(s, i + shift.get(s, 0), j + shift.get(s, 0), b + shards - bins) for s, i, j, b in runs]


def ranked(df: DataFrame, by: list[str], out: str, parts: int | None = None) -> DataFrame:
    """`df` with its place (from 0) in the order of `by`, without a window over all rows: sorted ranges are counted, then offset."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r._p, r.n) for r in own.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).collect())
    offsets, total = {}, 0
    for p, c in counts:  # one number for each partition
        offsets[p] = total
        total += c
    spark = df.sparkSession
    table = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "_p long, _o long")
    return own.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(out, F.col("_o") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_o", "_at")


def shard(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").cast("binary")
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"")).alias("digest"),
        )
    )
    groups = ranked(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), ["bytes", "digest"], "rank")
    sizes = sorted(((r.bytes, r.n, r.first) for r in groups.groupBy("bytes").agg(F.count("*").alias("n"), F.min("rank").alias("first")).collect()), reverse=True)
    first = {s: f for s, _, f in sizes}
    runs = sorted((first[s] + i, b) for s, i, _, b in assign([(s, n) for s, n, _ in sizes], shards)) if sizes else [(0, 0)]
    put = spark.sparkContext.broadcast((np.array([r for r, _ in runs], dtype=np.int64), np.array([b for _, b in runs], dtype=np.int32)))

    @F.pandas_udf("int")
    def bin_of(rank: pd.Series) -> pd.Series:
        starts, bins = put.value
        return pd.Series(bins[np.searchsorted(starts, rank.to_numpy(), side="right") - 1])

    placed = rows.join(groups.select("digest", bin_of("rank").alias("shard")), "digest")
    placed = ranked(placed.select("doc_id", "size", "text_crc32", "shard"), ["shard", "doc_id", "text_crc32"], "place")
    before, offsets = 0, []
    for r in sorted(placed.groupBy("shard").agg(F.count("*").alias("n")).collect()):
        offsets += [F.lit(r.shard), F.lit(before).cast("long")]
        before += r.n
    slot = F.col("place") - (F.create_map(*offsets)[F.col("shard")] if offsets else F.lit(0))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
