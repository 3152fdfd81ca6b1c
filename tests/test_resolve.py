import itertools
import random

from pyspark.sql import functions as F

from loomgraph.functions.fuzzy import common_length, similar_pairs, subset_pairs, token_set_ratio, token_set_ratio_column
from loomgraph.operators import resolve
from loomgraph.operators.components import connected_components
from loomgraph.providers import LongestNameResolver, OverlapReranker
from loomgraph.schemas import BUILD_LOG


def test_common_length_is_the_longest_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 20))) for _ in range(2))
        assert common_length(a, b) == slow(a, b)


def test_token_set_ratio():
    assert token_set_ratio("Ada", "ada lovelace") == 100
    assert token_set_ratio("", "x") == 0 and token_set_ratio(None, "x") == 0
    assert token_set_ratio("abcd", "abce") == 75
    assert token_set_ratio("b a", "A,B!") == 100
    assert token_set_ratio("one two", "three four") < 60


def _names():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "internationalisation", "internationalization", "compartmentalisation"]
    out = {" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(40)}
    for n in list(out)[:15]:
        i = rng.randrange(len(n))
        out.add(n[:i] + rng.choice("xyz") + n[i + 1 :])
    return sorted(out | {"a", "b", "é", "!!"})


def test_similar_pairs_loses_nothing(spark):
    names = _names()
    want = {(a, b) for a, b in itertools.combinations(names, 2) if token_set_ratio(a, b) >= 95}
    df = spark.createDataFrame([(n,) for n in names + [None]], "name string")
    assert {(r.name1, r.name2) for r in similar_pairs(df).collect()} == want and want
    pairs = spark.createDataFrame(list(itertools.product(names[:9], names[:9])), "a string, b string")
    for r in pairs.select("a", "b", token_set_ratio_column(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == token_set_ratio(r.a, r.b)


def test_subset_pairs(spark):
    df = spark.createDataFrame([("a b",), ("a b c",), ("c",), ("d",), ("B a",)], "name string")
    assert {(r.small, r.big) for r in subset_pairs(df).collect()} == {("a b", "a b c"), ("c", "a b c"), ("B a", "a b c"), ("a b", "B a"), ("B a", "a b")}


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: root(v) for v in list(parent)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _log(spark):
    rows = [
        ("l1", "d1", 0, "", [("Sam", "founder of Acme"), ("Acme", "a company")], [("Sam", "Acme", "founded")], [("Sam", ["is tall"])], None, None),
        ("l2", "d1", 1, "", [("Sam Jones", "works at Acme")], [("Sam Jones", "Acme", "works for")], [], None, None),
        ("l3", "d2", 0, "", [("Unlike", "nothing")], [], [], None, None),
    ]
    return spark.createDataFrame(rows, BUILD_LOG)


def test_resolution_of_a_log(spark):
    log = _log(spark)
    assert {r.name for r in resolve.unique_names(log).collect()} == {"sam", "acme", "sam jones", "unlike"}
    sets = resolve.match_sets(resolve.unique_names(log))
    assert {(r.set_id, r.name) for r in sets.collect()} == {("sam", "sam"), ("sam", "sam jones")}
    names = resolve.true_names(resolve.resolved(sets, LongestNameResolver()), sets)
    assert [(r.entity, r.candidates) for r in names.collect()] == [("sam", ["sam jones"])]
    contexts = resolve.candidate_context(log, spark.createDataFrame([("sam",), ("zz",), ("a",)], "candidate string"))
    got = {r.candidate: r.context for r in contexts.collect()}
    assert got["sam"] == "founder of Acme, founded, is tall, works at Acme, works for" and got["zz"] == ""
    assert "a company" in got["a"]
    out = {r.log_id: r for r in resolve.resolve_log(log, LongestNameResolver(), OverlapReranker()).collect()}
    assert out["l1"].nodes[0].name == "sam jones" and out["l1"].edges[0].source == "sam jones" and out["l1"].properties[0].entity_name == "sam jones"
    assert out["l3"].nodes[0].name == "Unlike" and len(out) == 3
