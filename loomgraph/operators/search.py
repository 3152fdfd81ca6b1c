"""Retrieval: nearest objects, reranked, cut at a threshold, enriched, and made an answer."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.errors import IllogicalAction, UnknownDocument
from loomgraph.providers import TEMPLATES, Providers, Reranker, fill
from loomgraph.session import cut

from .graphstore import Tables
from .index import nearest

LOCAL = {"level": 0, "k": 40, "threshold": 0.1}
GLOBAL = {"level": 1, "k": 15, "threshold": 0.0}
NO_CONTEXT = "There is no context for this question."
NO_ANSWER = "The model gave no answer."
ASK = "please ask a question"


@dataclass
class Answer:
    answer: str
    sources: list[dict] | None = None
    visuals: list[dict] | None = None


def score_column(query: Column, text: Column, reranker: Reranker) -> Column:
    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([reranker.score(a, b) for a, b in zip(q, t)], dtype=float)

    return run(query, text)


def last_of_equal_texts(hits: DataFrame, text: str = "text", order: str = "distance") -> DataFrame:
    """One hit for each text: the one farthest down the list."""
    return hits.groupBy(text).agg(F.max_by(F.struct(*hits.columns), F.struct(order, "id")).alias("h")).select("h.*")


def above_threshold(ranked: DataFrame, threshold: float, score: str = "score", rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Hits before the first whose score isn't above the threshold."""
    so_far = Window.partitionBy(*(by or [])).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("_least", F.min(score).over(so_far)).where(F.col("_least") > threshold).drop("_least")


def reranked(hits: DataFrame, query: str, reranker: Reranker, threshold: float) -> DataFrame:
    """hits (id, text, distance, ...) with score and rank, best first, those above the threshold."""
    scored = last_of_equal_texts(hits).withColumn("score", score_column(F.lit(query), F.col("text"), reranker))
    kept = scored.where(F.col("score") > threshold)  # hits are a top-k list, so one window over them is small
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "distance", "id")))


def enriched(hits: DataFrame, t: Tables) -> DataFrame:
    """hits (id, type) with metadata and parent_nodes: the node itself; an edge's `to`, then `frm`; a property's node. Unknown objects have no parents.
    Each hit meets the tables of its type only, and nothing is joined that no hit asks for."""
    rest = [c for c in hits.columns if c not in ("id", "type")]
    own = lambda kind: hits.where(F.col("type") == kind)
    names = lambda i: t.nodes.select(F.col("id").alias(f"_end{i}"), F.col("name").alias(f"_name{i}"), F.lit(True).alias(f"_in{i}"))

    def shown(found: DataFrame, ends: int) -> DataFrame:
        known = F.lit(True)
        for i in range(ends):
            known = known & F.coalesce(F.col(f"_in{i}"), F.lit(False))
        parents = F.when(known, F.array(*(f"_name{i}" for i in range(ends)))).otherwise(F.array().cast("array<string>"))
        return found.select("id", "type", *rest, F.when(known, F.col("_metadata")).alias("metadata"), parents.alias("parent_nodes"))

    n = own("node").join(t.nodes.select("id", F.col("metadata").alias("_metadata"), F.col("name").alias("_name0"), F.lit(True).alias("_in0")), "id", "left")
    e = own("edge").join(t.edges.select("id", F.col("metadata").alias("_metadata"), F.col("to").alias("_end0"), F.col("frm").alias("_end1")), "id", "left").join(names(0), "_end0", "left").join(names(1), "_end1", "left")
    p = own("property").join(t.properties.select("id", F.col("metadata").alias("_metadata"), F.col("node_id").alias("_end0")), "id", "left").join(names(0), "_end0", "left")
    other = hits.where(~F.coalesce(F.col("type").isin("node", "edge", "property"), F.lit(False)))
    other = other.withColumns({"_metadata": F.lit(None).cast(t.nodes.schema["metadata"].dataType), "_name0": F.lit(None).cast("string"), "_in0": F.lit(False)})
    return shown(n, 1).unionByName(shown(e, 2)).unionByName(shown(p, 1)).unionByName(shown(other, 1))


def retrieve(index: DataFrame, t: Tables, query: str, providers: Providers, level: int, k: int, threshold: float, document_ids: list[str] | None = None) -> DataFrame:
    """rank, score, text, id, type, metadata, parent_nodes."""
    rows = index.where(F.arrays_overlap("document_ids", F.array(*map(F.lit, document_ids)))) if document_ids else index
    vector = providers.embedder.embed([query])[0]
    hits = nearest(rows, vector, k, {"level": level}).select("id", "text", "type", "distance")
    return enriched(cut(reranked(hits, query, providers.reranker, threshold)), t)


def context(hits: DataFrame, text: str = "text", rank: str = "rank", by: list[str] | None = None, end: str = "\n") -> DataFrame:
    """The texts in order of rank, a line each."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(rank, text))), lambda x: x[text])
    return hits.groupBy(*(by or [])).agg(F.concat(F.array_join(lines, "\n"), F.lit(end)).alias("context"))


def check(t: Tables) -> None:
    if not t.nodes.where("level = 0").limit(1).count():
        raise IllogicalAction("the graph has no node to search")


def document_ids(documents: DataFrame, names: list[str]) -> list[str]:
    """Ids of documents by file name; an unknown name raises."""
    found = {r.name: r.id for r in documents.where(F.col("name").isin(names)).select("name", "id").collect()}
    if missing := sorted(set(names) - set(found)):
        raise UnknownDocument(", ".join(missing))
    return [found[n] for n in names]


def local_search(index: DataFrame, t: Tables, query: str, providers: Providers, doc_ids: list[str] | None = None) -> Answer:
    if not query.strip():
        return Answer(ASK)
    hits = retrieve(index, t, query, providers, document_ids=doc_ids, **LOCAL).orderBy("rank").collect()  # 40 at most
    text = "".join(h.text + "\n" for h in hits) or NO_CONTEXT
    answer = providers.model.answer(fill(TEMPLATES["local"], {"query": query, "context": text}))
    return Answer(answer or NO_ANSWER, [h.asDict(recursive=True) for h in hits])


def global_search(index: DataFrame, t: Tables, query: str, providers: Providers, doc_ids: list[str] | None = None) -> str:
    hits = retrieve(index, t, query, providers, document_ids=doc_ids, **GLOBAL).orderBy("rank").collect()  # 15 at most
    return providers.model.answer(fill(TEMPLATES["global"], {"query": query, "context": "\n".join(h.text for h in hits)})) or ""
