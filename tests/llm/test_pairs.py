import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomgraph.llm import setjoin
from loomgraph.llm.common import small_batches, with_ids
from loomgraph.llm.linededup import dedup_lines, removed_lines
from loomgraph.llm.neardups import near_duplicates


def corpus(seed=1, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "día", "THE", "the"]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            w = (rng.choice(docs)[1] or "x").split(" ")
            for _ in range(rng.randint(0, max(1, len(w) // 6))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((i, " ".join(w)))
        else:
            docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))))
    return docs + [(500, None), (501, ""), (502, "  \n\t"), (503, "single"), (504, "Single"), (505, "a b"), (506, "A  b\n")]


def table(spark, docs, parts=3):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # columns that clash with names that operators use inside
    return df.select("*", *(F.lit(7).alias(c) for c in ("k", "n", "part", "copies", "component", "removed", "tok"))).repartition(parts)


@pytest.mark.parametrize("hot,lot", [(None, None), (0, 3)])
def test_near_duplicates(spark, monkeypatch, hot, lot):
    if hot is not None:
        monkeypatch.setattr(setjoin.Rarity, "hot", lambda self: hot)
        monkeypatch.setattr(setjoin, "LOT", lot)
    docs = corpus()
    got = sorted(tuple(r) for r in near_duplicates(table(spark, docs)).collect())
    assert got == brute.near(docs)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("hot", [None, 0])
def test_dense_groups_make_no_pairs(spark, monkeypatch, hot):
    if hot is not None:  # all tokens meet in the join; small groups and lots
        monkeypatch.setattr(setjoin.Rarity, "hot", lambda self: hot)
        for name, value in (("DENSE", 5), ("DENSE_LOT", 7)):
            monkeypatch.setattr(setjoin, name, value)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    copies = 500 if hot is None else 40
    docs = corpus() + [(1000 + i, " ".join(f"c{rng.randrange(10**6)}" if rng.random() < 0.09 else w for w in base)) for i in range(copies)]
    texts = table(spark, docs).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    join = setjoin.SetJoin(with_ids(small_batches(texts)), setjoin.shingles, 60)
    pairs = join.candidates()
    assert join.groups.count() >= copies and pairs.count() < copies * copies / 8
    got = sorted(tuple(r) for r in near_duplicates(table(spark, docs)).collect())
    want = brute.near(docs)
    linked = [r[2] for r in want if r[0] >= 1000]
    assert got == want and 2 < sum(linked) / copies < copies - 2


def test_near_duplicates_repeated_and_empty(spark):
    docs = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None), (3, None)]
    got = sorted(tuple(r) for r in near_duplicates(table(spark, docs)).collect())
    assert got == [(1, 2, 2, 1), (1, 2, 2, 1), (2, 2, 2, 1), (3, 0, 0, 3), (3, 0, 0, 3)]
    assert near_duplicates(table(spark, docs).limit(0)).count() == 0
    odd = [(None, "p q r s t u v w"), (4, "p q r s t u v x"), (5, "p q r s t u v w"), (None, "q")]
    got = sorted(near_duplicates(table(spark, odd)).collect(), key=str)
    assert sorted((r.doc_id, r.n_similar, r.component_id) for r in got if r.doc_id) == [(4, 2, 4), (5, 2, 4)]
    assert sorted((r.n_similar, r.component_id or 0) for r in got if r.doc_id is None) == [(0, 0), (2, 4)]


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    a, z, y = "a b c d e f g h", "p q r s t u v w", "k l m n o i j x"
    docs = [(1, a), (None, a + " more"), (None, z), (None, y), (7, z + " more"), (8, "one two three"), (8, y + " more")]
    got = {(r.doc_id, r.n_shingles, r.n_similar, r.component_id) for r in near_duplicates(table(spark, docs)).collect()}
    assert got == {(1, 7, 1, 1), (None, 8, 1, 1), (None, 7, 1, 7), (7, 8, 1, 7), (8, 2, 0, 8), (None, 7, 1, 8), (8, 8, 1, 8)}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, z = "a b c d e f g h", "p q r s t u v w"
    docs = [(1, a), (None, a + " more"), (None, z), (None, z + " more"), (None, "alone here"), (None, None), (None, ""), (4, "own text of four"), (4, a)]
    got = [(r.doc_id, r.text) for r in cp.near_dedup(spark, table(spark, docs), "").collect()]
    whole = [x for x in got if not (x[1] or "").startswith(z)]
    assert sorted(whole, key=str) == sorted([(1, a), (None, "alone here"), (None, None), (None, ""), (4, "own text of four")], key=str)
    assert len(got) - len(whole) == 1


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(f"t{rng.randrange(10**6)}" for _ in range(400_000))
    docs = [(1, long), (2, long + " more"), (3, "z" * 3_000_000), (4, "short one")]
    got = {r.doc_id: (r.n_similar, r.component_id) for r in near_duplicates(table(spark, docs)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


@pytest.mark.parametrize("hot", [None, 0])
def test_line_dedup(spark, monkeypatch, hot):
    if hot is not None:
        monkeypatch.setattr(setjoin.Rarity, "hot", lambda self: hot)
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    docs = [(i, "\n".join(rng.choice([*pool, "", "  "]) + rng.choice(["", "", " x"]) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "\n\n"), (93, docs[0][1])]
    want = brute.line_dedup(docs)
    got = {r.doc_id: (r._removed or [], r.text) for r in dedup_lines(table(spark, docs)).collect()}
    assert got == want and any(g for g, _ in got.values())


@pytest.mark.parametrize("hot", [None, 0])
def test_line_dedup_of_dense_groups(spark, monkeypatch, hot):
    if hot is not None:
        monkeypatch.setattr(setjoin.Rarity, "hot", lambda self: hot)
        for name, value in (("DENSE", 4), ("DENSE_LOT", 5)):
            monkeypatch.setattr(setjoin, name, value)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(40)]
    lines = [" ".join(f"c{rng.randrange(10**6)}" if rng.random() < 0.08 else w for w in base) for _ in range(500 if hot is None else 50)]
    docs = [(i, "\n".join([f"own {i}", *lines[i : i + 2]])) for i in range(0, len(lines), 2)]
    got = {r.doc_id: (r._removed or [], r.text) for r in dedup_lines(table(spark, docs)).collect()}
    assert got == brute.line_dedup(docs) and any(g for g, _ in got.values())


def test_line_dedup_repeated_and_empty(spark):
    docs = [(5, "p q r s t\nnew"), (5, "p q r s t\nnew"), (7, "p q r s t\nnewer")]
    got = sorted((r.doc_id, r.text) for r in dedup_lines(table(spark, docs)).collect())
    assert got == [(5, "p q r s t\nnew"), (5, "p q r s t\nnew"), (7, "newer")]
    odd = {(r.doc_id, r.text) for r in dedup_lines(table(spark, [(None, "p q r s t\nown"), (7, "p q r s t\nother")])).collect()}
    assert odd == {(None, "own"), (7, "p q r s t\nother")}
    assert removed_lines(table(spark, docs).limit(0)).count() == 0
    assert dedup_lines(table(spark, docs).limit(0)).count() == 0


def test_line_dedup_of_rows_that_share_an_id_or_have_none(spark):
    docs = [(1, "p q r s t"), (None, "p q r s t\nfirst own"), (None, "unique clean text"), (None, "same a b c d\nx"), (None, "same a b c d\ny"), (5, "p q r s t\nz"), (5, "keep this line")]
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(table(spark, docs)).collect()), key=str)
    left = [x for x in got if x[1] not in ("same a b c d\nx", "x", "same a b c d\ny", "y")]
    assert left == sorted([(1, "p q r s t"), (None, "first own"), (None, "unique clean text"), (5, "z"), (5, "keep this line")], key=str)
    assert sorted(len(t) for _, t in got if (None, t) not in left and _ is None) == [1, 14]  # the line stays in one of the two


def test_sketch_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.choice(1 << 40, rng.integers(1, 300), replace=False).astype(np.uint64)
        b = np.unique(np.r_[rng.permutation(a)[: rng.integers(1, len(a) + 1)], rng.choice(1 << 40, rng.integers(1, 100)).astype(np.uint64)])
        s = [setjoin.sketches(np.zeros(len(x), np.int64), x, np.array([len(x)])) for x in (a, b)]
        assert setjoin.distance(*s) <= len(np.setxor1d(a, b))
        assert setjoin.distance(s[0], s[0]) == 0


def test_sizes_and_keys_dont_depend_on_the_chunk():
    import numpy as np
    import pyarrow as pa

    from loomgraph.llm.textkernel import buffers

    texts = [t or "" for _, t in corpus(4)]
    whole = setjoin.ordered(setjoin.shingles(*buffers(pa.array(texts))), None)
    for i, t in enumerate(texts):
        one = setjoin.ordered(setjoin.shingles(*buffers(pa.array([t]))), None)
        assert (one[2][0], one[3][0]) == (whole[2][i], whole[3][i]) and one[2][0] == len(brute.shingle_set(t))
    # tokens that agree in their upper 42 bits, or in their lower 48, are told apart
    token = np.array([1 << 40, (1 << 40) + 1, 1 << 60, (1 << 60) + 7, 7, (1 << 50) + 7], dtype=np.uint64)
    item = np.array([0, 0, 1, 1, 2, 3])
    s = setjoin.Sets(item, token, token, None, np.arange(4), np.zeros(4, np.int64))
    _, _, size, k = setjoin.ordered(s, None)
    assert size.tolist() == [2, 2, 1, 1] and len(set(k.tolist())) == 4
    again = setjoin.ordered(setjoin.Sets(np.array([0]), token[4:5], token[4:5], None, np.arange(1), np.zeros(1, np.int64)), None)
    assert again[3][0] == k[2]


def test_only_lines_that_pairs_need_are_split_into_words(spark):
    base = [f"b{i}" for i in range(20)]
    texts = [(1, " ".join(base) + "\n\n own one two\r\n"), (2, "\n \nother line\n" + " ".join([*base[1:], "x"])), (3, None), (4, ""), (5, "\n"), (None, " ".join(["y", *base[:-1]]) + "\nlast of all")]
    docs = small_batches(with_ids(spark.createDataFrame([(*d, i) for i, d in enumerate(texts)], "doc_id long, text string, row long").repartition(2)))
    join = setjoin.SetJoin(docs, setjoin.lines, 80, small=True)
    classes = join.classes().where("n = 20").cache()
    got = sorted((r.k, r.n, bytes(r.tokens)) for r in join.line_sets(classes).where("n = 20").collect())
    want = sorted((r.k, r.n, bytes(r.tokens)) for r in join.sets(classes.select("k", "n")).where("n = 20").collect())
    assert len(got) == 3 and got == want
    assert not {r.n for r in join.line_sets(classes).collect()} - {20}


def test_words_of_one_line_have_no_postings(spark):
    def postings(texts):
        docs = small_batches(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row long").repartition(2))
        join, sent = setjoin.SetJoin(docs, setjoin.lines, 80, small=True), spark.sparkContext.accumulator(0)
        rarity, held = join.rarity(), join._held(spark.sparkContext.broadcast(join.rarity()))
        level = setjoin.U64(rarity.shared_from())
        def count(batches):
            for lot in held(batches):
                sent.add(len(lot.line_postings(level, 80)[0]))
            yield from ()

        docs.mapInArrow(count, "n long").collect()
        return sent.value

    own = [" ".join(f"w{i}x{j}" for j in range(10)) + f" w{i}x0" for i in range(30)]
    assert postings(own) == 0  # a word that a line repeats is of that line only
    assert postings([*own, own[3] + " more"]) >= 2


def test_wide_parity_loses_no_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    vocabulary = np.sort(rng.choice(1 << 62, 600, replace=False).astype(np.uint64))
    sets = []
    for n in (50, 60, 64, 65, 70, 80, 130, 200):
        first = rng.choice(vocabulary, n, replace=False)
        sets += [first, np.unique(np.r_[first, rng.choice(vocabulary, 4)]), *(np.unique(np.r_[first[rng.permutation(n)[: n - c]], rng.choice(vocabulary, c)]) for c in (0, 2, n // 10, n // 8, n // 5))]
    item = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    tokens = setjoin.ordered(setjoin.Sets(item, flat, flat, None, np.arange(len(sets)), np.zeros(len(sets), np.int64)), None)
    lot = setjoin._Held(*tokens)
    few, _ = setjoin._by_frequency(*lot.line_postings(setjoin.U64(0), 80), 0)
    met = {frozenset((int(a), int(b))) for got in setjoin._met(*few, 80) for a, b in zip(got[0], got[2])}
    key, as_sets = lot.k.tolist(), [set(s.tolist()) for s in sets]
    want = {frozenset((key[i], key[j])) for i in range(len(sets)) for j in range(i) if key[i] != key[j] and 100 * len(as_sets[i] & as_sets[j]) >= 80 * len(as_sets[i] | as_sets[j])}
    assert want and want <= met
    assert any(min(len(as_sets[key.index(k)]) for k in p) <= 64 < max(len(as_sets[key.index(k)]) for k in p) for p in want)


def test_an_end_that_is_settled_needs_no_other_pair():
    import numpy as np

    from loomgraph.llm.linededup import _later, _later_of

    tokens = np.arange(10, dtype=np.uint64).tobytes()
    members = {(k, 10): (k, 0, 0, 1, tokens, 0) for k in range(6)}
    pairs = [(a, 10, b, 10) for a in range(6) for b in range(a)]
    assert len(setjoin._linked(members, pairs, 80)) == 15
    few = setjoin._linked(members, pairs, 80, _later_of)
    assert len(few) == 5 and sorted(_later(members, few)) == [(k, 0, 0) for k in range(1, 6)]
