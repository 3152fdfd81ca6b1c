import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import sharding, topk


def slow_pack(sizes, capacity):
    rooms, out = [], []
    for s, n in sizes:
        for i in range(n):
            fit = [(r, b) for b, r in enumerate(rooms) if r >= s]
            if fit:
                b = min(fit)[1]
            else:
                b = len(rooms)
                rooms.append(capacity)
            rooms[b] -= s
            out.append((s, i, b))
    return out


def test_pack_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        sizes = sorted({rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}.items(), reverse=True)
        got = [(s, i, b) for s, a, z, b in sharding.pack(sizes, 50) for i in range(a, z)]
        assert got == slow_pack(sizes, 50)
    assert sharding.pack([(60, 1)], 50) is None


def test_assign_covers_and_balances():
    rng = random.Random(2)
    for _ in range(50):
        sizes = sorted({rng.randint(1, 500): rng.randint(1, 30) for _ in range(rng.randint(1, 60))}.items(), reverse=True)
        runs = sharding.assign(sizes, 8)
        for s, n in sizes:
            assert sorted(i for t, a, z, _ in runs if t == s for i in range(a, z)) == list(range(n))
        load = np.zeros(8)
        for s, a, z, b in runs:
            load[b] += s * (z - a)
        assert load.max() <= max(sizes[0][0], load.sum() / 8) + sizes[0][0]


def test_tree_finds_the_tightest():
    rng, rooms, plain = random.Random(3), sharding.Rooms(), set()
    for i in range(600):
        if plain and rng.random() < 0.4:
            k = rng.choice(sorted(plain))
            plain.remove(k)
            rooms.remove(k)
        else:
            k = (rng.randint(0, 60), i)
            plain.add(k)
            rooms.insert(k)
        s = rng.randint(0, 70)
        assert rooms.tightest(s) == min((k for k in plain if k[0] >= s), default=None)


def test_shards(spark):
    rng = random.Random(4)
    texts = [None, "", "é" * 50, "x" * 100_000] + ["t" * rng.randint(0, 90) + str(rng.randint(0, 40)) for _ in range(300)] + ["hot"] * 150
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("size", "shard", "slot", "rank", "n", "bytes", "place", "digest"))).repartition(3)
    got = sharding.shard(df, shards=8).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    of = dict(zip(got["doc_id"], got["shard"]))
    seen = {}
    for i, t in rows:
        assert seen.setdefault(t, of[i]) == of[i]
    import zlib

    for r in got.itertuples():
        t = texts[r.doc_id] if r.doc_id < len(texts) else None
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
    load = got.groupby("shard")["size"].sum()
    rest = load.drop(of[3])
    assert rest.max() - rest.min() <= 3 * 160
    assert sharding.shard(df.limit(0)).count() == 0
    few = sharding.shard(df.where("doc_id < 2")).collect()
    assert len(few) == 2 and all(r.slot == 0 for r in few) or len({r.shard for r in few}) == 1


def slow_topk(rows, k=5):
    dim = max((len(v) for _, v in rows), default=0)
    fill = lambda v: v + [0] * (dim - len(v))
    out = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        own = fill(min(v for i, v in rows if i == q))
        s = sorted(((-sum(a * b for a, b in zip(own, fill(v))), i) for i, v in rows if i != q))[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return out


@pytest.mark.parametrize("block,pivots,sample", [(1 << 10, 64, 4096), (2, 3, 8)])
def test_topk(spark, monkeypatch, block, pivots, sample):
    monkeypatch.setattr(topk, "GROWTH", 3)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(260)]
    rows += [(300, [1.0, 2.0]), (350, []), (301, rows[3][1]), (302, rows[3][1]), (302, rows[3][1]), (400, [0.0] * 6)]
    bad = [(401, None), (450, [1.0, None, 2.0]), (402, [float("nan")]), (500, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").select("*", *(F.lit(1).alias(c) for c in ("v", "pivot", "distance", "score", "rank"))).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, lambda i: i % 50 == 0, block=block, pivots=pivots, sample=sample).collect())
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    assert got == sorted(slow_topk(whole))
    assert topk.top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 50"), lambda i: i % 50 == 0).count() == 0


def test_topk_large_numbers(spark):
    rows = [(0, [3e6, 1.0]), (1, [2e6, 3.0]), (2, [2e6, 4.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, lambda i: i % 50 == 0, k=3).orderBy("rank").collect()]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    assert got == slow_topk(whole, 3)


def test_bounds_rule_out_other_clusters():
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (16, 24))
    m = np.floor(256 * (centres[rng.integers(0, 16, 8000)] + rng.normal(0, 0.05, (8000, 24))))
    space = topk.Space(topk.pivots_of(m[:1000], 16), float((m**2).sum(axis=1).max()))
    d = space.distances(m)
    p = d.argmin(axis=1)
    order = np.lexsort((d.min(axis=1), p))
    work, q = topk.Search(space, 24, 5), m[::50]
    got = list(work.lot(np.arange(8000)[order], m[order], p[order], d.min(axis=1)[order], iter([(np.arange(0, 8000, 50), q, np.full(len(q), np.iinfo(np.int64).min))])))
    assert work.pairs == 160 * 8000 and work.looked < 0.5 * work.pairs
    best = np.sort(np.where(np.arange(8000)[None, :] == np.arange(0, 8000, 50)[:, None], -(2**62), (q @ m.T).astype(np.int64)), axis=1)[:, -5:]
    assert np.array_equal(np.sort(np.concatenate([s for *_, s in got]).reshape(-1, 5), axis=1), best)
