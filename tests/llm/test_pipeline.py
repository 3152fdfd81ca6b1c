import brute
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from loomgraph.llm import decontamination, queries


def test_stages_in_turn(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding"]
    kept = cp.quality(spark, docs, small)
    lines = cp.line_dedup(spark, kept, small)
    before = {r.doc_id: r.text for r in kept.collect()}
    want = {i: (g, t) for i, (g, t) in brute.line_dedup(list(before.items())).items() if not g or len(t) >= cp.LEAST_LEFT * len(before[i])}
    assert len(want) < len(before)
    got = {r.doc_id: r for r in lines.collect()}
    assert set(got) == set(want) and all(got[i].text == want[i][1] for i in got)
    assert lines.columns == docs.columns and all(r.n_chars == len(r.text) for r in got.values())
    near = cp.near_dedup(spark, lines, small)
    parts = brute.near([(i, r.text) for i, r in got.items()])
    assert {r.doc_id for r in near.collect()} == {i for i, _, _, c in parts if i == c}
    clean = cp.decontamination(spark, near, small)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = [(i, got[i].text) for i, _, _, c in parts if i == c]
    want = {i for i, n, hit, _ in brute.contaminated(left, items) if not (hit and 20 * hit >= n)}
    assert {r.doc_id for r in clean.collect()} == want and near.columns == clean.columns == docs.columns
    out = cp.run(spark, small)
    assert {r.doc_id for r in out.collect()} == want and "ids_sha256" in out.columns


def test_stages_with_odd_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    odd = docs.select(F.col("doc_id") + 10_000_000, *(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c != "doc_id")).toDF(*docs.columns)
    mixed = docs.unionByName(odd).unionByName(docs.limit(3)).withColumns({"k": F.lit(1), "_kept_too": F.lit(None).cast("string"), **{c: F.lit(2) for c in ("_doc", "_document", "_removed", "_REMOVED_", "_before", "_row", "__row", "_kept", "row", "n")}})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, mixed, small)
        assert out.columns == mixed.columns and out.count() <= mixed.count()
        assert stage(spark, mixed.limit(0), small).count() == 0


def test_decontamination_of_long_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(decontamination, "BLOCKS_AT_ONCE", 1)
    item, filler = " ".join(f"q{i}" for i in range(20)), " ".join(f"w{i}" for i in range(2000))
    bench = [(1, item), (2, "of course"), (3, " ".join(f"z{i}" for i in range(13)))]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, filler), (2, f"{filler} {item} {filler}"), (3, f"{filler} of course"), (4, "of course it is"), (5, f"{filler} {item[:40]}"), (6, f"{bench[2][1]} {filler}"), (7, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.decontamination(spark, frame, str(tmp_path)).collect()) == [1, 3, 5, 7]
    passes = decontamination.keep_clean(frame, spark.createDataFrame(bench, "item_id long, text string"), block_bytes=30, whole_windows=True)
    assert sorted(r.doc_id for r in passes.collect()) == [1, 3, 5, 7]


def test_registry():
    q = entry.queries()
    assert "pipeline" in q and {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in queries.QUERIES}
    assert set(queries.ORACLES) <= set(q)
