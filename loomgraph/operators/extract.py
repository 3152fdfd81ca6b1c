"""From chunks to build logs, and from build logs to graph rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.providers import Extractor
from loomgraph.schemas import BUILD_LOG, METADATA, VISUAL, derived_id, schema


def build_logs(chunks: DataFrame, extractor: Extractor, parallel: int | None = None) -> DataFrame:
    """A build log for each chunk, and `error` where the extractor failed (nothing is extracted then). `parallel` bounds the calls in flight."""
    ddl = f"{BUILD_LOG}, error string"
    names = schema(ddl).names

    def run(frames):
        for frame in frames:
            rows = []
            for doc, chunk, text in zip(frame["doc_id"], frame["chunk_id"], frame["text"]):
                nodes, edges, props, error = [], [], [], None
                try:
                    nodes, edges = extractor.entities(text)
                    found = list(dict.fromkeys(n for n, _ in nodes))
                    props = extractor.properties(text, found) if found else []
                except Exception as e:  # one chunk's failure is a row, not the end of the job
                    error = f"{type(e).__name__}: {e}"
                rows.append((f"{doc}:{chunk:09d}", doc, chunk, text, [{"name": n, "description": d} for n, d in nodes], [{"source": a, "target": b, "relationship": r} for a, b, r in edges], [{"entity_name": n, "properties": list(p)} for n, p in props], None, None, error))
            yield pd.DataFrame(rows, columns=names)

    own = chunks.select("doc_id", "chunk_id", "text")
    return (own.repartition(parallel) if parallel else own).mapInPandas(run, ddl)


def visual_logs(elements: DataFrame, answers: DataFrame) -> DataFrame:
    """Build logs of visual elements whose answer is valid. answers: visual_nodes() of a table with doc_id, save_location."""
    visual = F.struct(derived_id("doc_id", "save_location").alias("id"), F.col("content"), F.col("save_location"), F.col("page_num"), F.col("type")).cast(VISUAL)
    own = elements.join(answers.where("is_valid").select("doc_id", "save_location", "nodes", "main"), ["doc_id", "save_location"])
    empty = lambda kind: F.array().cast(dict(zip(("edges", "properties"), ("array<struct<source: string, target: string, relationship: string>>", "array<struct<entity_name: string, properties: array<string>>>")))[kind])
    return own.select(F.concat("doc_id", F.lit(":v:"), "save_location").alias("log_id"), F.col("doc_id").alias("document_id"), F.lit(None).cast("int").alias("chunk_id"), F.col("content").alias("chunk_text"), "nodes", empty("edges").alias("edges"), empty("properties").alias("properties"), F.col("main").alias("main_visual_entity_name"), visual.alias("visual"))


ENTITY_ANSWER = "struct<entities: array<struct<name: string, description: string>>, relations: array<struct<source: string, target: string, relationship: string>>>"


def validated(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """nodes, edges and is_valid of JSON answers: every entity has a name and a description, every relation its three parts, all of them strings."""
    p = F.from_json(answer, ENTITY_ANSWER)
    v = F.try_parse_json(answer)
    text = lambda e, k: F.coalesce(F.schema_of_variant(F.variant_get(e, f"$.{k}", "variant")) == "STRING", F.lit(False))
    all_text = lambda path, keys: F.coalesce(F.forall(F.try_variant_get(v, path, "array<variant>"), lambda e: _all([text(e, k) for k in keys])), F.lit(False))
    ok = all_text("$.entities", ("name", "description")) & all_text("$.relations", ("source", "target", "relationship"))
    return answers.withColumn("is_valid", ok).withColumn("nodes", F.when(ok, p["entities"])).withColumn("edges", F.when(ok, p["relations"]))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def property_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """properties of answers [{entity: [text, ...]}, ...]: the first entity of each object only."""
    parsed = F.from_json(answer, "array<map<string, array<string>>>")
    first = F.transform(F.filter(parsed, lambda m: F.size(m) > 0), lambda m: F.map_entries(m)[0])
    return answers.withColumn("properties", F.transform(first, lambda e: F.struct(e["key"].alias("entity_name"), e["value"].alias("properties"))))


def _metadata() -> F.Column:
    return F.array(F.struct(F.col("document_id"), F.col("chunk_id"), F.col("visual")).cast(METADATA))


def graph_nodes(log: DataFrame) -> DataFrame:
    """Level-0 nodes: the first of each lower-cased name of a document, in order of log and place, gives description and metadata."""
    each = log.select("log_id", "document_id", "chunk_id", "visual", "main_visual_entity_name", F.posexplode("nodes").alias("i", "x"))
    w = Window.partitionBy("document_id", F.lower("x.name")).orderBy("log_id", "i")
    first = each.where("x.name is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.select(
        derived_id(F.lit("node"), "document_id", F.lower("x.name")).alias("id"), F.lower("x.name").alias("name"), F.coalesce("x.description", F.lit("")).alias("description"), F.lit(0).alias("level"),
        F.coalesce(F.lower("main_visual_entity_name") == F.lower("x.name"), F.lit(False)).alias("is_visual"), F.lit(None).cast("string").alias("community_id"), _metadata().alias("metadata"), F.col("document_id"),
    )


def graph_edges(log: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges; self-edges as property rows (node_id, description, metadata, log_id, i); and relations with an end that no node has."""
    each = log.select("log_id", "document_id", "chunk_id", "visual", F.posexplode("edges").alias("i", "x")).withColumn("a", F.lower("x.source")).withColumn("b", F.lower("x.target"))
    end = lambda i, n: nodes.select("document_id", F.col("name").alias(n), F.col("id").alias(i))
    both = each.join(end("frm", "a"), ["document_id", "a"], "left").join(end("to", "b"), ["document_id", "b"], "left")
    whole = both.where("frm is not null and `to` is not null")
    edges = whole.where("frm <> `to`").select(derived_id(F.lit("edge"), "log_id", "i").alias("id"), "frm", "to", F.col("x.relationship").alias("description"), _metadata().alias("metadata"))
    loops = whole.where("frm = `to`").select(F.col("frm").alias("node_id"), F.col("x.relationship").alias("description"), _metadata().alias("metadata"), "log_id", F.lit(0).alias("kind"), "i", F.lit(0).alias("j"))
    rejects = both.where("frm is null or `to` is null").select("log_id", "document_id", F.col("x.source").alias("source"), F.col("x.target").alias("target"), F.col("x.relationship").alias("relationship"))
    return edges, loops, rejects


def graph_properties(log: DataFrame, nodes: DataFrame, loops: DataFrame) -> DataFrame:
    """Properties, numbered by their order within the node; those of unknown names are left out."""
    each = log.select("log_id", "document_id", "chunk_id", "visual", F.posexplode("properties").alias("i", "x")).select("*", F.lower("x.entity_name").alias("name"), F.posexplode("x.properties").alias("j", "description"))
    own = each.join(nodes.select("document_id", "name", F.col("id").alias("node_id")), ["document_id", "name"]).select("node_id", "description", _metadata().alias("metadata"), "log_id", F.lit(1).alias("kind"), "i", "j")
    every = own.unionByName(loops)
    w = Window.partitionBy("node_id").orderBy("log_id", "kind", "i", "j")
    return every.select(derived_id(F.lit("property"), "node_id", "log_id", "kind", "i", "j").alias("id"), "node_id", (F.row_number().over(w) - 1).alias("pos"), "description", "metadata")
