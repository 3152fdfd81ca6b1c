from collections import Counter
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import providers as pr
from loomgraph.api import Graph
from loomgraph.errors import DuplicateDocument, IllogicalAction, InvalidObject, MissingCredentials, TablesMissing, TemplateMismatch, UnknownDocument, UnsupportedFile
from loomgraph.operators import community, extract, graphstore as gs, index, multimodal, report, search
from loomgraph.schemas import ANALYSIS, CHANGE_LOG, EDGES, NODE_CHILDREN, NODES, PROPERTIES, DOCUMENTS, empty, schema
from loomgraph.sources import readers


def m(*docs):
    return [(d, 0, None) for d in docs]


def tables(spark):
    nodes = [("a", "a", "", 0, False, "k", m("d1")), ("b", "b", "", 0, False, "k", m("d1", "d2")), ("c", "c", "", 0, False, None, m("d2")), ("k", "k", "", 1, False, None, [])]
    edges = [("e1", "a", "b", "x", m("d1")), ("e2", "b", "c", "y", m("d2"))]
    props = [("p1", "a", 0, "pa", m("d1")), ("p2", "b", 0, "pb", m("d1")), ("p3", "b", 1, "pc", m("d1", "d2"))]
    docs = [("d1", "one.txt", 1, 5, {"type": "report", "field": "23"}, {"type": "str", "field": "int"}), ("d2", "two.txt", 1, 5, {"type": "paper", "is_latest": "False"}, {"type": "str", "is_latest": "bool"})]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return gs.Tables(make(nodes, NODES), make(edges, EDGES), make(props, PROPERTIES), make([("k", "a"), ("k", "b")], NODE_CHILDREN), make(docs, DOCUMENTS), empty(spark, CHANGE_LOG))


def ids(df):
    return {r[0] for r in df.select("id").collect()}


def test_lookups_and_views(spark):
    t = tables(spark)
    assert ids(gs.by_id(t.nodes, ["a", "zz"])) == {"a"} and ids(gs.at_level(t.nodes, 1)) == {"k"}
    assert gs.max_level(t.nodes).first()[0] == 1 and gs.max_level(t.nodes.limit(0)).first()[0] is None
    want = spark.createDataFrame([("d2", "b"), ("d1", "c")], "document_id string, name string")
    assert ids(gs.by_name(t.nodes, want)) == {"b"}
    full = {r.id: r for r in gs.node_view(t, "full").collect()}
    assert sorted(full["b"].edge_ids) == ["e1", "e2"] and full["b"].properties == ["pb", "pc"] and full["k"].child_ids == ["a", "b"]
    assert gs.node_view(t, "reference").columns == ["id"]


def test_delete_node(spark):
    t = gs.delete_nodes(tables(spark), spark.createDataFrame([("b",)], "id string"))
    assert ids(t.nodes) == {"a", "c", "k"} and ids(t.edges) == set() and ids(t.properties) == {"p1"}
    assert [r.child_id for r in t.node_children.collect()] == ["a"]
    log = {(r.id, r.action) for r in t.change_log.collect()}
    assert log == {("b", "delete"), ("e1", "delete"), ("e2", "delete"), ("p2", "delete"), ("p3", "delete"), ("a", "update"), ("c", "update")}
    assert sorted(r.seq for r in t.change_log.collect()) == list(range(7))
    t = gs.delete_nodes(t, spark.createDataFrame([("k",)], "id string"))
    assert t.nodes.where("community_id is not null").count() == 0 and gs.clear_log(t).change_log.count() == 0


def test_delete_document(spark):
    t = gs.delete_document(tables(spark), "d1")
    assert ids(t.nodes) == {"b", "c", "k"} and ids(t.edges) == {"e2"} and ids(t.properties) == {"p3"} and ids(t.documents) == {"d2"}
    assert t.nodes.where("id = 'b'").first().metadata[0].document_id == "d2"
    t = gs.delete_document(t, "d2")
    assert ids(t.nodes) == set() and t.edges.count() == t.properties.count() == 0


def test_puts(spark):
    t = tables(spark)
    node = lambda *r: spark.createDataFrame([r], NODES)
    t2 = gs.put_nodes(t, node("a", "renamed", "", 0, False, None, m("d1")))
    assert t2.nodes.where("id = 'a'").first().name == "renamed" and t2.change_log.first().action == "update"
    for bad in (node("z", "b", "", 0, False, None, m("d2")), node("z", "z", "", 0, False, None, [])):
        with pytest.raises(InvalidObject):
            gs.put_nodes(t, bad)
    edge = lambda *r: spark.createDataFrame([r], EDGES)
    for bad in (edge("z", "a", "a", "", []), edge("z", "q", "w", "", []), edge("z", "a", "q", "", [])):
        with pytest.raises(InvalidObject):
            gs.put_edges(t, bad)
    t3 = gs.put_edges(t, edge("z", "a", "q", "", m("d1")), missing=node("q", "q", "", 0, False, None, m("d1")))
    assert "q" in ids(t3.nodes) and "z" in ids(t3.edges)
    with pytest.raises(InvalidObject):
        gs.put_properties(t, spark.createDataFrame([("z", "none", 0, "", [])], PROPERTIES))
    t4 = gs.sync_children(t, spark.createDataFrame([("a",)], "id string"), t.edges.limit(0), spark.createDataFrame([("p9", "a", 0, "new", [])], PROPERTIES))
    assert ids(t4.edges) == {"e2"} and ids(t4.properties) == {"p2", "p3", "p9"}


def test_tags(spark):
    d = tables(spark).documents
    reg = {r.tag: (r.type, r["count"]) for r in gs.tag_registry(d).collect()}
    assert reg == {"type": ("str", 2), "field": ("int", 1), "is_latest": ("bool", 1)}
    assert {r.tag: (r.type, r["count"]) for r in gs.tag_registry(d.where("id = 'd2'")).collect()} == {"type": ("str", 1), "is_latest": ("bool", 1)}
    assert ids(gs.filter_by_tags(d, {"type": "report"})) == {"d1"} and ids(gs.filter_by_tags(d, {"field": "23", "type": "paper"})) == set()
    assert ids(gs.filter_by_tags(d, {"field": "23"}, ignore_missing=True)) == {"d1", "d2"}


def test_save_and_load(spark, tmp_path):
    t, folder = tables(spark), f"file://{tmp_path}/g"
    assert gs.load(spark, folder) is None
    gs.save(t, folder)
    gs.save(gs.delete_nodes(t, spark.createDataFrame([("b",)], "id string")), folder)
    again = gs.load(spark, folder)
    assert ids(again.nodes) == {"a", "c", "k"} and gs.current_version(spark, folder) == 2
    import shutil

    shutil.rmtree(tmp_path / "g" / "v000002" / "edges")
    with pytest.raises(TablesMissing):
        gs.load(spark, folder)


def test_sync_compaction(spark):
    rows = [(0, "a", "create", "node", 0), (1, "a", "update", "node", 0), (2, "b", "update", "node", 1), (3, "c", "create", "edge", 0), (4, "c", "delete", "edge", 0), (5, "d", "delete", "edge", 0), (6, "d", "update", "node", 3)]
    df = spark.createDataFrame([(*r, []) for r in rows], CHANGE_LOG)
    got = {r.id: (r.to_create, r.to_delete, r.type) for r in index.compacted(df).collect()}
    assert got == {"a": (True, False, "node"), "b": (True, True, "node"), "c": (False, False, "edge"), "d": (False, True, "edge")}


def test_communities(spark):
    rng = random.Random(4)
    names = [f"n{i:03d}" for i in range(80)]
    pairs = {tuple(sorted((names[8 * (i // 8) + rng.randrange(8)], names[i]))) for i in range(80) for _ in range(4)} | {(names[i], names[i + 8]) for i in range(0, 56, 8)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    nodes = spark.createDataFrame([(n,) for n in names + ["alone"]], "id string")
    edges = spark.createDataFrame([(f"e{i}", *p) for i, p in enumerate(pairs)], "id string, frm string, `to` string")
    got = community.communities(nodes, edges)
    own = {r.node_id: r.community for r in got.collect()}
    assert set(own) == set(names) | {"alone"} and own["alone"] == "alone" and len(set(own.values())) < len(own)
    again = {r.node_id: r.community for r in community.communities(nodes.repartition(1), edges.repartition(7)).collect()}
    assert own == again
    w = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a string, b string, w double")
    q = community.modularity(w, got)
    parts = {c: [n for n in own if own[n] == c] for c in set(own.values())}
    for members in parts.values():  # each is connected
        reached, todo = set(), [members[0]]
        while todo:
            u = todo.pop()
            reached.add(u)
            todo += [v for a, b in pairs for u2, v in ((a, b), (b, a)) if u2 == u and v in members and v not in reached]
        assert reached == set(members)
    from loomgraph.operators.components import connected_components

    whole = connected_components(w, "a", "b").select(F.col("vertex").alias("node_id"), F.col("component").alias("community"))
    assert q > community.modularity(w, whole) and q > 0.3
    spread = community.communities(nodes, edges, local_edges=5)
    assert {r.node_id for r in spread.collect()} == set(own) and community.modularity(w, spread) > 0


def test_multimodal(spark):
    cells = [(0, 0, "H1", []), (0, 1, "H2", []), (1, 1, "v*|", []), (1, 1, "last", [])]
    region = [(3, [1.0, 2.0, 9.0, 2.0, 5.0, 6.0, 1.0, 6.0])]
    doc = ([(0, 2, 2, "Cap", 3, region, cells), (1, 2, 2, None, 3, [(3, [1.0, 2.0, 3.0, 4.0])], [])], [("f", "Fig", 3, region)], [(0, None, "text", 1)])
    a = spark.createDataFrame([doc], ANALYSIS).withColumn("doc_id", F.lit("d"))
    got = multimodal.visual_elements(a).collect()
    assert [r.type for r in got] == ["TABLE", "TABLE", "FIGURE"]
    assert got[0].content == "Cap\n| H1 | H2 |\n| --- | --- |\n|  | last |" and got[1].content.startswith("None\n|  |  |") and got[1].save_location == ""
    assert multimodal.analysis_paragraphs(a).first().content == "text"
    box = spark.createDataFrame([([5.0, 6.0, -1.0, 2.0], 4, 4), ([9.0, 9.0, 9.5, 9.5], 4, 4), ([1.0, 1.0, 1.0, 3.0], 4, 4)], "b array<double>, w int, h int")
    assert [r[0] for r in box.select(multimodal.crop_box(F.col("b"), F.col("w"), F.col("h"))).collect()] == [[0.0, 144.0, 288.0, 288.0], None, None]
    answers = spark.createDataFrame([('{"entities": [{"main_node": true, "name": "a", "description": "x"}, {"main_node": true, "name": "b", "description": "y"}]}',), ('{"entities": [{"name": "a"}]}',), ("no json",)], "answer string")
    v = multimodal.visual_nodes(answers).collect()
    assert [(r.is_valid, r.main) for r in v] == [(True, "b"), (False, None), (False, None)]


def test_validation(spark):
    good = '{"entities": [{"name": "a", "description": "b"}], "relations": [{"source": "a", "target": "b", "relationship": "r"}]}'
    rows = [good, '{"entities": [{"name": 1, "description": "b"}], "relations": []}', '{"entities": []}', "{", None]
    df = spark.createDataFrame([(r,) for r in rows], "answer string")
    assert [r.is_valid for r in extract.validated(df).collect()] == [True, False, False, False, False]
    p = extract.property_answers(spark.createDataFrame([('[{"a": ["x", "y"], "b": ["z"]}, {}]',)], "answer string")).first().properties
    assert [(q.entity_name, q.properties) for q in p] == [("a", ["x", "y"])]


def test_threshold_and_rerank(spark):
    rows = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.5), (4, 0.1)], "rank int, score double")
    assert [r["rank"] for r in search.above_threshold(rows, 0.3).collect()] == [1]
    assert [r["rank"] for r in search.above_threshold(rows, 0.1).orderBy("rank").collect()] == [1, 2, 3]
    hits = spark.createDataFrame([("x", "same text", 0.1), ("y", "same text", 0.4), ("z", "other", 0.2)], "id string, text string, distance double")
    got = search.reranked(hits, "same", pr.OverlapReranker(), 0.1).collect()
    assert [r.id for r in got] == ["y"]
    assert pr.OverlapReranker().rerank("a", []) == []


def test_nearest(spark):
    rows = spark.createDataFrame([(str(i), [float(i), 0.0], i % 3) for i in range(9)], "id string, embedding array<float>, level int")
    assert [r.id for r in index.nearest(rows, [2.2, 0.0], 3).collect()] == ["2", "3", "1"]
    assert [r.id for r in index.nearest(rows, [2.2, 0.0], 30, {"level": 1}).collect()] == ["1", "4", "7"]
    q = spark.createDataFrame([(7, [2.2, 0.0]), (8, [8.0, 0.0])], "query_id long, query array<double>")
    got = {(r.query_id, r.id, r["rank"]) for r in index.nearest_batch(rows, q, 2, block=1).collect()}
    assert got == {(7, "2", 1), (7, "3", 2), (8, "8", 1), (8, "7", 2)}
    assert index.nearest_batch(rows, q.limit(0), 2).count() == 0


def test_providers(monkeypatch):
    assert pr.variables("{{ a }} {{b}}") == {"a", "b"} and pr.fill("{{ a }}!", {"a": "x"}) == "x!"
    with pytest.raises(TemplateMismatch):
        pr.fill("{{ a }}", {"a": 1, "b": 2})
    calls = []

    def fails():
        calls.append(1)
        raise KeyError

    with pytest.raises(KeyError):
        pr.retried(fails, 3, sleep=lambda s: None)()
    assert len(calls) == 3

    class Needy(pr.HashedEmbedder):
        required_credentials = ("NEEDY_KEY",)

    with pytest.raises(MissingCredentials):
        pr.Providers(embedder=Needy()).check_credentials({})
    pr.Providers(embedder=Needy()).check_credentials({"NEEDY_KEY": "x"})
    with pytest.raises(ValueError):
        pr.embedder("unknown")
    assert len(pr.HashedEmbedder(16).embed(["", "a b"])[1]) == 16


TEXT = "Ada Lovelace worked with Charles Babbage in London. Charles Babbage built the Analytical Engine. The Analytical Engine was never finished, but Ada Lovelace wrote programs for it.\n\n"


def test_build_search_report(spark, tmp_path):
    a, b = tmp_path / "one.txt", tmp_path / "two.txt"
    a.write_text(TEXT * 3)
    b.write_text("Grace Hopper wrote a compiler for the Harvard Mark. Grace Hopper served in the United States Navy and worked with Howard Aiken on the Harvard Mark.\n" * 2)
    folder = f"file://{tmp_path}/graph"
    g = Graph(spark, "test", folder=folder)
    with pytest.raises(IllogicalAction):
        g.search("who?")
    with pytest.raises(UnsupportedFile):
        g.build([str(tmp_path / "x.docx")])
    g.build([str(a), str(b)])
    assert {r.name for r in g.get_all_documents().collect()} == {"one.txt", "two.txt"}
    levels = {r.level: r["count"] for r in g.tables.nodes.groupBy("level").count().collect()}
    assert levels[0] >= 5 and levels[1] >= 2 and levels[2] == 2
    assert g.index.groupBy("level").count().count() == 3
    answer = g.search("Who worked with Charles Babbage?")
    assert "Babbage" in answer.answer and answer.sources
    assert "Babbage" not in g.search("Who worked with Grace Hopper?", ["two.txt"]).answer
    assert g.search("  ").answer == search.ASK and isinstance(g.global_search("compiler"), str)
    with pytest.raises(UnknownDocument):
        g.search("x", ["three.txt"])
    with pytest.raises(DuplicateDocument):
        g.build(str(a))
    with pytest.raises(DuplicateDocument):
        g.build([str(tmp_path / "n.txt"), str(tmp_path / "n.txt")])
    assert "top nodes" in g.dashboard()
    g.visualize(str(tmp_path / "g.html"))
    assert "canvas" in (tmp_path / "g.html").read_text()
    row = report.totals(g.tables).first()
    assert row.total_degree >= 2 and row.documents == 2
    again = Graph(spark, "test", folder=folder)
    assert ids(again.tables.nodes) == ids(g.tables.nodes) and again.index.count() == g.index.count()
    again.set_tags("one.txt", {"year": 1843})
    assert {r.tag: r.type for r in gs.tag_registry(again.tables.documents).collect()} == {"year": "int"}
    again.remove_document("two.txt")
    assert again.tables.nodes.where("name = 'grace hopper'").count() == 0
    n = again.add_node("Extra", "added", 0, "one")
    other = again.tables.nodes.where("level = 0 and id <> '%s'" % n).first().id
    again.add_edge(n, other, "knows", "one")
    again.sync()
    assert again.index.where("text = 'Extra, added'").count() == 1


def test_readers(spark, tmp_path):
    xml = '<pdf2xml><page number="1" width="600" height="800"><fontspec id="0" size="12" family="AB+Bold" color="#111111"/><text top="10" left="5" width="40" height="10" font="0">Big <b>News</b></text><text top="30" left="5" width="0" height="10" font="9"> </text><text top="50" left="5" width="40" height="10" font="0">More of it.</text></page></pdf2xml>'
    (tmp_path / "a.xml").write_text(xml)
    from loomgraph.operators import layout

    tokens = layout.parse_layout_xml(readers.read_xml(spark, [f"file://{tmp_path}/a.xml"]))
    rows = tokens.orderBy("idx").collect()
    assert [(r.content, r.bold, r.right) for r in rows] == [("Big News", True, 45.0), ("More of it.", True, 45.0)]
    assert layout.has_text(tokens).count() == 1
    segs = layout.segments(layout.islands(tokens.withColumn("joined", F.lit(1))))
    assert segs.first().text == "Big News More of it."
    assert [r.role for r in layout.to_paragraphs(segs).collect()] == [None]
    labels = spark.createDataFrame([(rows[0].doc_id, 1, 0.0, 0.0, 600.0, 25.0, 5), (rows[0].doc_id, 1, 0.0, 0.0, 50.0, 22.0, 8)], "doc_id string, page int, left double, top double, right double, bottom double, label int")
    assert [r.type for r in layout.label_types(tokens, labels).orderBy("idx").collect()] == ["SECTION_HEADER", "TEXT"]
    assert layout.same_line(tokens).count() == 0 and layout.gap_without_between(tokens).first().gap == 30.0
    f = layout.with_context(layout.pair_features(tokens), ["length"], 1).orderBy("idx").collect()
    assert (f[0].length_m1, f[0].length_p1, f[1].length_p1) == (-1.0, 11.0, -1.0)
    hot = tokens.select(layout.unicode_categories(F.col("content")).alias("c")).first().c
    assert sum(hot) == 4 and len(hot) == 4 * len(layout.CATEGORIES)
    p = layout.predict(tokens.withColumn("mean", F.lit(6.0)).withColumn("share", F.lit(0.5)).withColumn("mark", F.lit(0)), ["font_size", "mean", "share", "mark"], layout.rule_types)
    assert p.first().predicted == layout.TOKEN_TYPES.index("SECTION_HEADER")
    assert layout.normal_box(5, 5, 5, 1) == (5, 1, 6, 5)
    assert layout.line_context(tokens).count() == 0
    (tmp_path / "t.txt").write_text("\n  hello \n")
    assert readers.read_text(spark, [f"file://{tmp_path}/t.txt"]).first().text == "hello"
    with pytest.raises(UnsupportedFile):
        readers.list_files(spark, ["a.txt", "b.doc"])


def test_stream(spark, tmp_path):
    from loomgraph.streaming.ingest import chunk_stream, ingest, stream_texts

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TEXT * 2)
    seen = []
    q = ingest(chunk_stream(stream_texts(spark, f"file://{tmp_path}/in")), lambda df, i: seen.append((i, df.count())), f"file://{tmp_path}/cp")
    q.awaitTermination(60)
    assert sum(n for _, n in seen) == 1


def test_layout_gap_and_positions(spark):
    from loomgraph.operators import layout

    box = lambda i, left, top, right, bottom: ("d", 1, i, f"word, {i}.", left, top, right, bottom, "TEXT" if i < 2 else "TITLE", 600, 800, 12.0)
    rows = [box(0, 0.0, 0.0, 10.0, 10.0), box(1, 0.0, 50.0, 10.0, 60.0), box(2, 40.0, 15.0, 50.0, 20.0), box(3, 60.0, 15.0, 70.0, 20.0)]
    tokens = spark.createDataFrame(rows, "doc_id string, page int, idx int, content string, left double, top double, right double, bottom double, type string, page_width int, page_height int, font_size double")
    assert [r.gap for r in layout.gap_without_between(tokens).orderBy("idx").collect()] == [15.0, -45.0, -5.0]
    p = layout.position_features(tokens, layout.Modes(line_space=2.0, right=100.0)).orderBy("idx").collect()
    assert len(p) == 3 and p[0].asDict().keys() == {"doc_id", "page", "idx", *layout.POSITIONS}
    assert (p[2].line_right, p[2].right_gap, p[2].next_left_gap, p[2].right_to_mode, p[2].gap_to_mode) == (70.0, 10.0, 10.0, 30.0, 7.0)
    f = layout.paragraph_features(tokens).orderBy("idx").collect()
    assert [(r.type_TEXT, r.next_type_TITLE) for r in f] == [(1, 0), (1, 1), (0, 1)]
    assert tokens.select(layout.punctuation_count(F.col("content")).alias("n")).first().n == 2
    m = layout.document_modes(tokens).first()
    assert (m.right, m.font_size, m.line_space) == (10.0, 12.0, -45.0)
    assert layout.joined(tokens).where("joined = 1").count() == 1 and layout.typed(tokens).count() == 4
    assert layout.position_features(tokens.limit(0)).count() == 0


def test_contracts(spark, tmp_path):
    from loomgraph import contracts
    from loomgraph.providers import Function, FunctionCall, HashedEmbedder, Parameter, message

    repo = contracts.default_repository(spark, "g", f"file://{tmp_path}")
    assert repo.max_level() == 0 and repo.node("x") is None
    meta = [("doc", 1, None)]
    nodes = spark.createDataFrame([("a", "Ada", "first", 0, False, None, meta), ("b", "Bob", "second", 0, False, None, meta)], schema(NODES))
    repo.put(nodes=nodes)
    repo.put(edges=spark.createDataFrame([("e", "a", "b", "knows", meta)], schema(EDGES)))
    assert repo.node_named("ADA", "doc").id == "a" and repo.edge("e").description == "knows" and repo.nodes_at(0).count() == 2
    assert repo.change_log().count() == 3
    repo.save()
    repo.remove_node("a")
    assert repo.node("a") is None and repo.edge("e") is None
    assert contracts.default_repository(spark, "g", f"file://{tmp_path}").node("a").name == "Ada"
    store = contracts.vector_store("table", spark, HashedEmbedder(16))
    rows = spark.createDataFrame([("1", "red apple", 0, "node", "d", ["d"]), ("2", "blue sky", 0, "edge", "d", ["d"])], "id string, text string, level int, type string, document_id string, document_ids array<string>")
    store.insert(rows)
    store.insert(rows)
    assert store.search("red apple", 5).first().id == "1" and store.search("red apple", 5, {"type": "edge"}).count() == 1
    store.delete(["1"])
    assert store.search("red apple", 5).count() == 1
    with pytest.raises(ValueError):
        contracts.vector_store("none", spark, HashedEmbedder(16))
    f = Function("find", "finds", (Parameter("kind", "string", "what", ("a", "b")), Parameter("n", "integer", "how many", required=False)))
    assert f.schema()["function"]["parameters"] == {"type": "object", "properties": {"kind": {"type": "string", "description": "what", "enum": ["a", "b"]}, "n": {"type": "integer", "description": "how many"}}, "required": ["kind"]}
    assert FunctionCall("find", '{"n": 2}').values() == {"n": 2}
    assert message("user", "look", b"\x00")["content"][1]["image_url"]["url"] == "data:image/png;base64,AA=="


def test_embedder_hashes_triples():
    import hashlib
    import math

    from loomgraph.providers import HashedEmbedder

    def slow(t, width):
        t, v = f" {' '.join(__import__('re').findall(r'[^\W_]+', t.lower()))} ", [0.0] * width
        for i in range(len(t) - 2):
            h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "little")
            v[h % width] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    texts = ["Hello, wörld 日本語!", "", "a", "ab", "The quick\nbrown_fox \U0001f600 jumps", "x" * 50]
    assert HashedEmbedder(32).embed(texts) == [slow(t, 32) for t in texts]


def test_communities_of_large_components(spark):
    """What is laid out by number gives the rows of label propagation by joins, a round at a time."""
    rng = random.Random(5)
    names = [f"{p}{i}" for p in "ps" for i in range(60)]
    drawn = [(g + rng.choice(names), g + rng.choice(names)) for g in ("x", "y") for _ in range(260)] + [("z1", "z2"), ("z2", "z3")]
    edges = spark.createDataFrame([(str(i), a, b) for i, (a, b) in enumerate(drawn)], "id string, frm string, to string")
    nodes = spark.createDataFrame([(g + n,) for g in ("x", "y") for n in names] + [("z1",), ("z2",), ("z3",), ("alone",), (None,)], "id string")
    near, ids = {}, sorted({x for e in drawn for x in e})
    for a, b in drawn:
        if a != b:
            near.setdefault(a, Counter())[b] += 1
            near.setdefault(b, Counter())[a] += 1
    frame = spark.createDataFrame([(i,) for i in ids], "id string")
    label = {i: i for i in ids}
    for r in range(20):
        turn = {x.id for x in frame.where(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0).collect()}
        votes = {}
        for a in near:
            votes[a] = Counter()
            for b, w in near[a].items():
                votes[a][label[b]] += w
        new = {a: max(v, key=lambda x: (v[x], x)) if a in turn else label[a] for a, v in votes.items()}
        done = all(label[a] == new[a] for a in new)
        label |= new
        if done:
            break
    parts = {}
    for i in ids:  # in order, so that a part is named by its least member
        stack = [] if i in parts else [i]
        while stack:
            u = stack.pop()
            if u not in parts:
                parts[u] = i
                stack += [v for v in near.get(u, ()) if label[v] == label[u]]
    large = {r.node_id: r.community for r in community.communities(nodes, edges, local_edges=2).collect()}
    assert {k: v for k, v in large.items() if k and k[0] in "xy" and k in near} == {k: v for k, v in parts.items() if k[0] in "xy" and k in near}
    assert (large["alone"], large[None]) == ("alone", None) and len(large) == nodes.count()
    small = {r.node_id: r.community for r in community.communities(nodes, edges).collect()}
    assert small["z1"] == small["z3"] == "z1" and {large[z] for z in ("z1", "z2", "z3")} == {"z1"}


def test_nearest_batch_holds_no_more_than_the_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    q = rng.normal(size=(7, 8))
    got, rows = index._Nearest(q, 5), []
    for lo in range(0, 4000, 500):
        m = rng.integers(-2, 3, size=(500, 8)).astype(float) if lo % 1000 else rng.normal(size=(500, 8)) + 1e6 * (lo == 2000)
        m[::7] = m[0]  # many ties
        rows.append(m)
        got.add(m, np.arange(lo, lo + 500))
        assert len(got.d) <= 7 * 5
    every = np.concatenate(rows)
    for i in range(7):
        d = ((every - q[i]) ** 2).sum(axis=1)
        want = sorted((x, j) for j, x in enumerate(d))[:5]
        assert [(x, j) for x, j in zip(got.d[got.query == i], got.ids[got.query == i])] == want
    few = index._Nearest(q, 5)
    few.add(np.array([[np.nan] * 8, [np.inf] * 8, [0.0] * 8]), np.array([2, 1, 0]))
    assert few.ids.tolist() == [0, 1, 2] * 7


def test_embedded_asks_for_few_texts_at_once(spark):
    class FewTexts(pr.HashedEmbedder):
        def embed(self, texts):
            assert len(texts) <= 256
            return pr.HashedEmbedder.embed(self, texts)

    rows = spark.range(700).coalesce(1).select("id", F.concat(F.lit("text "), "id").alias("text"))
    got = {r.id: r.embedding for r in index.embedded(rows, FewTexts(16)).collect()}
    want = pr.HashedEmbedder(16).embed([f"text {i}" for i in range(700)])
    assert len(got) == 700 and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in range(700))


def test_enriched_meets_each_table_once(spark):
    t = tables(spark)
    hits = spark.createDataFrame([("a", "node", 1), ("a", "edge", 2), ("e1", "edge", 3), ("e9", "edge", 4), ("x", "other", 5), ("y", None, 6)], "id string, type string, n int")
    lame = t.edges.unionByName(spark.createDataFrame([("e3", "a", "gone", "z", m("d1"))], EDGES))
    got = {(r.id, r.n): r for r in search.enriched(hits.unionByName(spark.createDataFrame([("e3", "edge", 7)], hits.schema)), gs.Tables(t.nodes, lame, t.properties, t.node_children, t.documents, t.change_log)).collect()}
    assert {k: r.parent_nodes for k, r in got.items()} == {("a", 1): ["a"], ("a", 2): [], ("e1", 3): ["b", "a"], ("e9", 4): [], ("x", 5): [], ("y", 6): [], ("e3", 7): []}
    assert got["e1", 3].metadata[0].document_id == "d1" and got["e3", 7].metadata is None
    assert "LeftSemi" not in search.enriched(hits, t)._jdf.queryExecution().optimizedPlan().toString()
