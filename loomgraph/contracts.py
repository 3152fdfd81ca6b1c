"""Contracts of a graph repository and of a vector store, the implementations on tables, and their factories."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import IllogicalAction
from loomgraph.operators import graphstore as gs
from loomgraph.operators import index
from loomgraph.providers import Embedder
from loomgraph.schemas import GRAPH_TABLES, VECTOR_INDEX, empty, schema
from loomgraph.session import cut


class GraphRepository(ABC):
    """What a graph asks of its storage. Rows go in as frames of the row types in schemas, single objects come out as rows or None."""

    @abstractmethod
    def node(self, node_id: str) -> Row | None: ...

    @abstractmethod
    def node_named(self, name: str, document_id: str) -> Row | None: ...

    @abstractmethod
    def edge(self, edge_id: str) -> Row | None: ...

    @abstractmethod
    def property(self, property_id: str) -> Row | None: ...

    @abstractmethod
    def nodes_at(self, level: int) -> DataFrame: ...

    @abstractmethod
    def max_level(self) -> int: ...

    @abstractmethod
    def put(self, *, nodes: DataFrame | None = None, edges: DataFrame | None = None, properties: DataFrame | None = None, documents: DataFrame | None = None) -> None: ...

    @abstractmethod
    def remove_node(self, node_id: str) -> None: ...

    @abstractmethod
    def remove_document(self, document_id: str) -> None: ...

    @abstractmethod
    def documents(self) -> DataFrame: ...

    @abstractmethod
    def document(self, *, document_id: str | None = None, name: str | None = None) -> Row | None: ...

    @abstractmethod
    def tags(self) -> DataFrame: ...

    @abstractmethod
    def documents_tagged(self, wanted: dict[str, str], ignore_missing: bool = False) -> DataFrame: ...

    @abstractmethod
    def change_log(self) -> DataFrame: ...

    @abstractmethod
    def clear_change_log(self) -> None: ...

    @abstractmethod
    def save(self) -> None: ...


class TableRepository(GraphRepository):
    """The repository on graph tables, kept in versions below a folder (or in the session only)."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.tables = (gs.load(spark, folder) if folder else None) or gs.Tables.new(spark)

    def node(self, node_id):
        return gs.by_id(self.tables.nodes, [node_id]).first()

    def node_named(self, name, document_id):
        """The level-0 node of that name, in any case, that the document has."""
        own = F.exists("metadata", lambda m: m["document_id"] == document_id)
        return self.tables.nodes.where((F.col("level") == 0) & (F.lower("name") == name.lower()) & own).first()

    def edge(self, edge_id):
        return gs.by_id(self.tables.edges, [edge_id]).first()

    def property(self, property_id):
        return gs.by_id(self.tables.properties, [property_id]).first()

    def nodes_at(self, level):
        return gs.at_level(self.tables.nodes, level)

    def max_level(self):
        """0 of an empty graph."""
        return self.tables.nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]

    def put(self, *, nodes=None, edges=None, properties=None, documents=None):
        t = self.tables
        t = gs.put_nodes(t, nodes) if nodes is not None else t
        t = gs.put_edges(t, edges) if edges is not None else t
        t = gs.put_properties(t, properties) if properties is not None else t
        self._keep(gs.put_documents(t, documents) if documents is not None else t)

    def _keep(self, t: gs.Tables) -> None:
        """Cuts the lineage of what changed, so that it doesn't grow with each call."""
        self.tables = gs.Tables(**{n: new if (new := getattr(t, n)) is getattr(self.tables, n) else cut(new) for n in GRAPH_TABLES})

    def remove_node(self, node_id):
        self._keep(gs.delete_nodes(self.tables, self.tables.nodes.where(F.col("id") == node_id).select("id")))

    def remove_document(self, document_id):
        self._keep(gs.delete_document(self.tables, document_id))

    def documents(self):
        return self.tables.documents

    def document(self, *, document_id=None, name=None):
        if (document_id is None) == (name is None):
            raise IllogicalAction("a document is asked for by its id or its name")
        return self.tables.documents.where(F.col("id") == document_id if name is None else F.col("name") == name).first()

    def tags(self):
        return gs.tag_registry(self.tables.documents)

    def documents_tagged(self, wanted, ignore_missing=False):
        return gs.filter_by_tags(self.tables.documents, wanted, ignore_missing)

    def change_log(self):
        return self.tables.change_log

    def clear_change_log(self):
        self.tables = gs.clear_log(self.tables)

    def save(self):
        if self.folder:
            gs.save(self.tables, self.folder)


class VectorStore(ABC):
    """What a graph asks of its vector index."""

    @abstractmethod
    def insert(self, texts: DataFrame) -> None:
        """texts: as VECTOR_INDEX without the embedding."""

    @abstractmethod
    def delete(self, ids: list[str]) -> None: ...

    @abstractmethod
    def search(self, query: str, top_n: int, metadata: dict | None = None) -> DataFrame: ...


class TableIndex(VectorStore):
    def __init__(self, spark: SparkSession, embedder: Embedder):
        self.embedder, self.table = embedder, empty(spark, VECTOR_INDEX)

    def insert(self, texts):
        """A row whose id is there replaces it."""
        new = index.embedded(texts, self.embedder).select(*schema(VECTOR_INDEX).names)
        self.table = cut(self.table.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new))

    def delete(self, ids):
        self.table = self.table.where(~F.col("id").isin(ids))

    def search(self, query, top_n, metadata=None):
        return index.nearest(self.table, self.embedder.embed([query])[0], top_n, metadata or {})


_STORES = {"table": TableIndex}


def default_repository(spark: SparkSession, name: str | None = None, root: str | None = None) -> GraphRepository:
    """The repository of a graph's name below `root` (or the folder that LOOMGRAPH_HOME names); without a name, one in the session."""
    root = root or os.environ.get("LOOMGRAPH_HOME")
    return TableRepository(spark, f"{root.rstrip('/')}/{name}" if name and root else None)


def vector_store(kind: str, spark: SparkSession, embedder: Embedder) -> VectorStore:
    if kind not in _STORES:
        raise ValueError(f"unknown vector store {kind}")
    return _STORES[kind](spark, embedder)
