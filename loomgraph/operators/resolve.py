"""Entity resolution: similar names become sets, a resolver decides, and build logs are rewritten."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions.fuzzy import similar_pairs
from loomgraph.providers import Reranker, Resolver

from .components import connected_components


def unique_names(build_log: DataFrame) -> DataFrame:
    """Distinct lower-cased names of the text logs' entities, relation ends and property owners."""
    text = build_log.where("visual is null")
    parts = [
        text.select(F.explode("nodes.name").alias("name")),
        text.select(F.explode("edges.source").alias("name")),
        text.select(F.explode("edges.target").alias("name")),
        text.select(F.explode("properties.entity_name").alias("name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lower("name").alias("name")).where("name is not null").distinct()


def match_sets(names: DataFrame, col: str = "name") -> DataFrame:
    """set_id (its least name), name: the closure of similarity; names that nothing is similar to are left out."""
    return connected_components(similar_pairs(names, col), "name1", "name2").select(F.col("component").alias("set_id"), F.col("vertex").alias("name"))


def resolved(sets: DataFrame, resolver: Resolver) -> DataFrame:
    """set_id, name (the true one), merged array<string>: what the resolver says of each set."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        got = resolver.resolve(sorted(rows["name"]))
        return pd.DataFrame({"set_id": key[0], "name": [n for n, _ in got], "merged": [list(m) for _, m in got]})

    return sets.groupBy("set_id").applyInPandas(run, "set_id string, name string, merged array<string>")


def true_names(answers: DataFrame, sets: DataFrame) -> DataFrame:
    """entity, candidates array<string>: lower-cased true names of each merged entity. A set that is answered with itself is left out, as is a name that is its own only candidate."""
    before = sets.groupBy("set_id").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("suggested"))
    after = answers.groupBy("set_id").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("true"))
    changed = before.join(after, "set_id").where(~F.col("suggested").eqNullSafe(F.col("true"))).select("set_id")
    each = answers.join(changed, "set_id", "left_semi").select(F.lower("name").alias("name"), F.explode("merged").alias("merged"))
    out = each.groupBy(F.lower("merged").alias("entity")).agg(F.array_sort(F.collect_set("name")).alias("candidates"))
    return out.where(~((F.size("candidates") == 1) & (F.col("candidates")[0] == F.col("entity"))))


def candidate_context(build_log: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidate, context: descriptions of entities whose name holds the candidate, relations with an end that holds it, and
    properties of the entity of that name, in log order. candidates: a column candidate.

    Names are matched through their distinct values: those (not their occurrences) meet the candidates, and the broadcast is left to the planner's size check.
    """
    nodes = build_log.select("log_id", F.posexplode("nodes").alias("i", "x")).select("log_id", F.lit(0).alias("kind"), "i", F.lower("x.name").alias("name"), F.col("x.description").alias("text"))
    ends = build_log.select("log_id", F.posexplode("edges").alias("i", "x")).select("log_id", F.lit(1).alias("kind"), "i", F.explode(F.array_distinct(F.array(F.lower("x.source"), F.lower("x.target")))).alias("name"), F.col("x.relationship").alias("text"))
    props = build_log.select("log_id", F.posexplode("properties").alias("i", "x")).select("log_id", F.lit(2).alias("kind"), "i", F.lower("x.entity_name").alias("name"), F.array_join("x.properties", ", ").alias("text"))
    part = nodes.unionByName(ends)
    own = candidates.select(F.lower("candidate").alias("candidate")).distinct()
    # a name that holds the candidate holds its first three characters
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    named = part.select("name").where("name is not null").distinct().withColumn("key", F.explode(grams(F.col("name"))))
    long = own.where(F.length("candidate") >= 3).withColumn("key", F.substring("candidate", 1, 3)).join(named, "key").where(F.contains("name", "candidate")).select("candidate", "name")
    short = own.where(F.length("candidate") < 3).withColumn("key", F.col("candidate"))
    starts = part.select("name").where("name is not null").distinct()
    parts_of = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(size)))
    pieces = starts.select("name", F.explode(F.array_distinct(F.concat(parts_of(1), parts_of(2)))).alias("key"))
    held = long.unionByName(short.join(pieces, "key").select("candidate", "name")).distinct()
    rows = part.join(held, "name").unionByName(props.join(own.select("candidate", F.col("candidate").alias("name")), "name"), allowMissingColumns=True)
    rows = rows.select("candidate", "log_id", "kind", "i", "text").distinct()
    parts = F.transform(F.array_sort(F.collect_list(F.struct("log_id", "kind", "i", "text"))), lambda p: p["text"])
    got = rows.groupBy("candidate").agg(F.array_join(parts, ", ").alias("context"))
    return own.join(got, "candidate", "left").select("candidate", F.coalesce("context", F.lit("")).alias("context"))


def assigned(build_log: DataFrame, names: DataFrame, contexts: DataFrame, reranker: Reranker) -> DataFrame:
    """log_id, entity, assigned: for each entity of a log that has candidates, the one that fits its first description there best."""
    first = (
        build_log.select("log_id", F.posexplode("nodes").alias("i", "x")).select("log_id", F.lit(0).alias("kind"), "i", F.lower("x.name").alias("entity"), F.concat("x.name", F.lit(", "), F.coalesce("x.description", F.lit(""))).alias("query"))
        .unionByName(build_log.select("log_id", F.posexplode("edges").alias("i", "x")).select("log_id", F.lit(1).alias("kind"), "i", F.explode(F.array("x.source", "x.target")).alias("n")).select("log_id", "kind", "i", F.lower("n").alias("entity"), F.concat("n", F.lit(", ")).alias("query")))
        .unionByName(build_log.select("log_id", F.posexplode("properties").alias("i", "x")).select("log_id", F.lit(2).alias("kind"), "i", F.lower("x.entity_name").alias("entity"), F.concat("x.entity_name", F.lit(", "), F.array_join("x.properties", ", ")).alias("query")))
    )
    w = Window.partitionBy("log_id", "entity").orderBy("kind", "i", "query")
    first = first.withColumn("n", F.row_number().over(w)).where("n = 1").select("log_id", "entity", "query").join(names, "entity")

    @F.pandas_udf("double")
    def fit(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([reranker.score(q, t) for q, t in zip(query, text)], dtype=float)

    each = first.select("log_id", "entity", "query", F.posexplode("candidates").alias("place", "candidate")).join(contexts, "candidate")
    scored = each.withColumn("score", fit(F.col("query"), F.concat("candidate", F.lit("---"), "context")))
    return scored.groupBy("log_id", "entity").agg(F.max_by("candidate", F.struct("score", -F.col("place"))).alias("assigned"))


def rewritten(build_log: DataFrame, mapping: DataFrame) -> DataFrame:
    """The build log with entities replaced by what they are assigned, in nodes, edges and properties."""
    per = mapping.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("entity", "assigned"))).alias("_map"))
    own = build_log.join(per, "log_id", "left")
    name = lambda c: F.coalesce(F.try_element_at("_map", F.lower(c)), c)
    nodes = F.transform("nodes", lambda x: F.struct(name(x["name"]).alias("name"), x["description"].alias("description")))
    edges = F.transform("edges", lambda x: F.struct(name(x["source"]).alias("source"), name(x["target"]).alias("target"), x["relationship"].alias("relationship")))
    props = F.transform("properties", lambda x: F.struct(name(x["entity_name"]).alias("entity_name"), x["properties"].alias("properties")))
    some = F.col("_map").isNotNull()
    out = own.withColumns({"nodes": F.when(some, nodes).otherwise(F.col("nodes")), "edges": F.when(some, edges).otherwise(F.col("edges")), "properties": F.when(some, props).otherwise(F.col("properties"))})
    return out.select(*build_log.columns)


def resolve_log(build_log: DataFrame, resolver: Resolver, reranker: Reranker) -> DataFrame:
    """All of the above for a build log."""
    sets = match_sets(unique_names(build_log))
    names = true_names(resolved(sets, resolver), sets)
    contexts = candidate_context(build_log, names.select(F.explode("candidates").alias("candidate")))
    return rewritten(build_log, assigned(build_log, names, contexts, reranker))
