import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import estimates
from loomgraph.functions.text import TokenCounter, chunk_paragraphs, exceeds_non_alpha, full_texts, is_good_chunk, keep_good_chunks, pack_paragraphs, split_documents, split_text, stripped


@pytest.mark.parametrize("text,threshold,exceeds", [("OnlyLettersHere", 0.4, False), ("12345!?*+", 0.4, True), ("A9876#~", 0.4, True), ("Some words, 42 of them!", 0.4, False), ("", 0.4, False), ("xyz789", 0.5, False), ("é\n\t", 0.4, True)])
def test_non_alpha(spark, text, threshold, exceeds):
    assert spark.createDataFrame([(text,)], "t string").select(exceeds_non_alpha(F.col("t"), threshold)).first()[0] is exceeds


def test_good_chunk_and_strip(spark):
    rows = spark.createDataFrame([("a" * 99,), ("a" * 100,), (None,), ("7" * 200,)], "t string").select(is_good_chunk(F.col("t"))).collect()
    assert [r[0] for r in rows] == [False, True, False, False]
    assert spark.createDataFrame([("　 a b\n",)], "t string").select(stripped(F.col("t"))).first()[0] == "a b"


def test_split_text_bounds_and_coverage():
    rng = random.Random(3)
    for _ in range(60):
        # numbered words, so that each piece stands at one place only
        number = iter(range(10**6))
        word = lambda: f"w{next(number):04d}"
        text = "".join(rng.choice([lambda: word() + " ", lambda: f"longer{word()} ", word, lambda: "\n", lambda: "\n\n", lambda: " ", lambda: "".join(word() for _ in range(rng.randint(1, 18)))])() for _ in range(rng.randint(0, 120)))
        pieces = split_text(text, 60, 15)
        assert all(0 < len(p) <= 60 and p == p.strip() for p in pieces)
        at = 0
        dense = "".join(text.split())
        for p in pieces:  # each piece is in the text, and nothing lies between two of them
            q = "".join(p.split())
            found = dense.find(q)
            assert 0 <= found <= at
            at = max(at, found + len(q))
        assert at == len(dense)
    assert split_text("") == []
    with pytest.raises(ValueError):
        split_text("a", 5, 6)


def test_split_documents_keeps_numbers(spark):
    docs = spark.createDataFrame([(1, "b" * 150 + "\n\n" + "1" * 1400 + "\n\n" + "c" * 150), (2, None), (3, "")], "doc_id long, text string")
    every = split_documents(docs, size=1500).collect()
    kept = keep_good_chunks(split_documents(docs, size=1500)).collect()
    assert {r.doc_id for r in every} == {"1"}
    assert len(kept) < len(every) and kept[-1].chunk_id == len(every) - 1


def test_pack_paragraphs():
    count = lambda t: len(t.split())
    p = lambda n, role=None, page=1: (role, " ".join(["w"] * n), page)
    got = pack_paragraphs([p(6), p(6, page=2), p(3, "null"), p(1, page=3)], count, 10)
    assert [(c, len(t.split()), page) for c, t, page in got] == [(0, 6, 2), (1, 7, 3)]
    # a heading closes a chunk that is more than 70 % full
    got = pack_paragraphs([p(7), p(1, "sectionHeading"), p(2)], count, 10)
    assert [(c, len(t.split())) for c, t, _ in got] == [(0, 7), (1, 3)]
    # a heading that doesn't fit is flushed twice: a number is used up by nothing
    got = pack_paragraphs([p(5), p(8, "sectionHeading")], count, 10)
    assert [c for c, _, _ in got] == [0, 2]
    assert pack_paragraphs([], count) == []


def test_chunk_paragraphs(spark):
    rows = [("d", i, None, "word " * 60, i) for i in range(12)] + [("d", 99, "null", "left out", 1), ("e", 0, None, "short", None)]
    df = spark.createDataFrame(rows, "doc_id string, id int, role string, content string, page_num int")
    got = chunk_paragraphs(df).orderBy("chunk_id").collect()
    assert len(got) > 1 and all(r.doc_id == "d" for r in got)
    assert all(TokenCounter()(r.text) <= 430 for r in got)
    assert full_texts(df).where("doc_id = 'e'").first().full_text == "short\n"


def test_estimates():
    assert estimates.cost(1_000_000, "gpt-4o") == 21.875
    assert estimates.cost(1_000_000, "gpt-4o-mini") == 0.75
    with pytest.raises(ValueError):
        estimates.cost(1, "another")
    assert estimates.time_text(2, "gpt-4o") == "20 seconds"
    assert estimates.time_text(10, "gpt-4o") == "1.667 minutes"
    assert estimates.time_text(3, "gpt-4o-mini") == "16 seconds"


def test_chunk_paragraphs_packs_as_pack_paragraphs(spark):
    rng = random.Random(11)
    rows = []
    for d in range(40):
        for i in range(rng.randrange(1, 60)):
            rows.append((f"d{d}", i, rng.choice([None, "sectionHeading", "null", "body"]), rng.choice([None, "", "word " * rng.randrange(90), "é9! " * rng.randrange(200)]), rng.choice([None, 1, 2, 3])))
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id string, id int, role string, content string, page_num int").repartition(5)
    for counter in (None, len):
        want = {(d, *c) for d in {r[0] for r in rows} for c in pack_paragraphs([(r, c or "", p) for x, _, r, c, p in rows if x == d], counter or TokenCounter())}
        got = chunk_paragraphs(df, counter, keep_all=True)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "FlatMapGroupsInPandas" not in chunk_paragraphs(df)._jdf.queryExecution().toString()


def test_split_documents_takes_no_large_batches(spark):
    plan = split_documents(spark.createDataFrame([("1", "a")], "doc_id string, text string"))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" in plan
