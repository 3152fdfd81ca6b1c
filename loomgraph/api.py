"""The graph that users work with: build, search, report."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import DuplicateDocument
from loomgraph.functions.estimates import cost, time_text
from loomgraph.functions.text import TokenCounter, chunk_paragraphs, full_texts, keep_good_chunks, split_documents, token_count
from loomgraph.operators import community, extract, index, layout, multimodal, report, resolve, search
from loomgraph.operators import graphstore as gs
from loomgraph.providers import Providers
from loomgraph.schemas import METADATA, VECTOR_INDEX, derived_id, empty, schema
from loomgraph.session import cut
from loomgraph.sources import readers


class Graph:
    """A property graph with its vector index.

    `folder` holds versions of the tables; without one the graph lives in the session.
    Communities are rebuilt over the whole graph by each build (community_mode="append" keeps earlier ones).
    """

    def __init__(self, spark: SparkSession, name: str, *, folder: str | None = None, providers: Providers | None = None, counter=None, community_mode: str = "replace", **credentials: str):
        self.spark, self.name, self.folder = spark, name, folder
        self.providers = providers or Providers()
        self.providers.check_credentials(credentials)
        self.counter = counter or TokenCounter()
        self.community_mode = community_mode
        self.tables = (gs.load(spark, folder) if folder else None) or gs.Tables.new(spark)
        self.index = empty(spark, VECTOR_INDEX)
        if folder and readers._exists(spark, f"{folder}/index"):
            last = sorted(r.v for r in spark.read.schema("v long").json(f"{folder}/index/CURRENT").collect())[-1]
            self.index = spark.read.schema(schema(VECTOR_INDEX)).parquet(f"{folder}/index/v{last:06d}")
        self.synced_seq = -1
        self.rejects: DataFrame | None = None  # chunks of the last build that a model failed on, with the error

    # building

    def build(self, paths: str | list[str], multi_modal: bool = False) -> None:
        """Reads files into the graph: text files, layout XML (or PDF, where a converter is installed), or analysis JSON with multi_modal."""
        paths = [paths] if isinstance(paths, str) else paths
        self._check_names([p.rpartition("/")[2] for p in paths])
        if multi_modal:
            analysis = readers.read_analysis(self.spark, paths)
            paragraphs, elements = multimodal.analysis_paragraphs(analysis), multimodal.visual_elements(analysis)
            names = analysis.select("doc_id", "name")
        else:
            elements = None
            plain, other = [p for p in paths if p.endswith(".txt")], [p for p in paths if not p.endswith(".txt")]
            if any(not p.endswith((".pdf", ".xml")) for p in other):
                readers.list_files(self.spark, other)
            if other:
                files = readers.read_xml(self.spark, [p for p in other if p.endswith(".xml")]) if all(p.endswith(".xml") for p in other) else readers.read_pdf_xml(self.spark, other)
                tokens = layout.joined(cut(layout.typed(layout.parse_layout_xml(files))))
                paragraphs = layout.to_paragraphs(layout.segments(layout.islands(tokens)))
                names = files.select("doc_id", "name")
            else:
                paragraphs = names = None
            if plain:
                texts = readers.read_text(self.spark, plain)
                return self.build_texts(texts.select("doc_id", "name", "text"), paragraphs, names)
        self.build_texts(None, paragraphs, names, elements)

    def build_texts(self, texts: DataFrame | None, paragraphs: DataFrame | None = None, names: DataFrame | None = None, elements: DataFrame | None = None) -> None:
        """texts: doc_id, name, text; paragraphs: as analysed, with names (doc_id, name)."""
        chunks, full, named = [], [], []
        if texts is not None:
            chunks.append(keep_good_chunks(split_documents(texts)))
            full.append(texts.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("full_text")))
            named.append(texts.select(F.col("doc_id").cast("string").alias("doc_id"), "name"))
        if paragraphs is not None:
            chunks.append(chunk_paragraphs(paragraphs, self.counter))
            full.append(full_texts(paragraphs))
            named.append(names.select("doc_id", "name"))
        union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(xs[1])
        chunks, full, named = cut(union(chunks)), union(full), union(named)
        self._add(chunks, full, named, elements)

    def _check_names(self, names: list[str]) -> None:
        twice = sorted({n for n in names if names.count(n) > 1})
        known = [r.name for r in self.tables.documents.where(F.col("name").isin(names)).select("name").collect()]
        if twice or known:
            raise DuplicateDocument(", ".join(twice + known))

    def _add(self, chunks: DataFrame, full: DataFrame, names: DataFrame, elements: DataFrame | None) -> None:
        p = self.providers
        made = cut(extract.build_logs(chunks, p.extractor, p.model.max_threads))
        self.rejects = made.where("error is not null").select("document_id", "chunk_id", "chunk_text", "error")
        log = made.where("error is null").drop("error")
        if elements is not None:
            log = log.unionByName(extract.visual_logs(elements, self._visual_answers(elements)).select(*log.columns))
        log = cut(resolve.resolve_log(cut(log), p.resolver, p.reranker))
        nodes = cut(extract.graph_nodes(log))
        edges, loops, _ = extract.graph_edges(log, nodes)
        t = gs.put_nodes(self.tables, nodes.drop("document_id"))
        t = gs.put_edges(t, cut(edges))
        t = gs.put_properties(t, cut(extract.graph_properties(log, nodes, loops)))
        sizes = chunks.withColumn("tokens", token_count(F.col("text"), self.counter)).groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_num"), F.sum("tokens").alias("token_num"))
        empty_map = F.create_map().cast("map<string, string>")
        docs = names.join(sizes, "doc_id", "left").select(F.col("doc_id").alias("id"), "name", F.coalesce("chunk_num", F.lit(0)).alias("chunk_num"), F.coalesce("token_num", F.lit(0).cast("long")).alias("token_num"), empty_map.alias("tags"), empty_map.alias("tag_types"))
        t = gs.put_documents(t, cut(docs))
        self.tables = self._kept(t)
        self.build_communities()
        self._add_document_nodes(full, names)
        self.sync()
        self.save()

    def _visual_answers(self, elements: DataFrame) -> DataFrame:
        caption = F.coalesce("caption", F.element_at(F.split("content", "\n"), 1), F.lit("figure"))
        entity = F.array(F.struct(F.lit(True).alias("main_node"), caption.alias("name"), F.col("content").alias("description")))
        return multimodal.visual_nodes(elements.select("doc_id", "save_location", F.to_json(F.struct(entity.alias("entities"))).alias("answer")))

    @staticmethod
    def _kept(t: gs.Tables) -> gs.Tables:
        return gs.Tables(**{n: cut(getattr(t, n)) for n in ("nodes", "edges", "properties", "node_children", "documents", "change_log")})

    def build_communities(self) -> None:
        """Clusters the level-0 nodes and rolls their communities up."""
        t = self.tables
        if self.community_mode == "replace":
            t = gs.delete_nodes(t, t.nodes.where("level = 1").select("id"))
        base = gs.at_level(t.nodes, 0)
        membership = cut(community.communities(base, t.edges))
        texts = community.community_texts(base, t.properties, t.edges, membership)
        found = cut(community.findings(texts, self.providers.summarizer))
        nodes, props, children, links = community.rollup(membership, found)
        crossing = community.community_edges(t.edges, membership.withColumn("community", derived_id(F.lit("community"), F.lit(1), "community")))
        nothing = F.array().cast(f"array<{METADATA}>")
        cross = crossing.select(derived_id(F.lit("crossing"), "edge_id").alias("id"), "frm", "to", F.lit("").alias("description"), nothing.alias("metadata"))
        t = gs.put_nodes(t, cut(nodes))
        t = gs.put_edges(t, cut(cross))
        t = gs.put_properties(t, cut(props))
        linked = t.nodes.drop("community_id").join(links, "id", "left").select(*t.nodes.columns)
        self.tables = self._kept(replace(t, nodes=linked, node_children=t.node_children.unionByName(children).distinct()))

    def _add_document_nodes(self, full: DataFrame, names: DataFrame) -> None:
        """A level-2 node for each document: summary, keywords as properties, and the communities with a node of it as children."""
        t, e = self.tables, self.providers.extractor
        ddl = "doc_id string, summary string, keywords array<string>"

        def run(frames):
            import pandas as pd

            for frame in frames:
                yield pd.DataFrame({"doc_id": frame["doc_id"], "summary": [e.summary(x) for x in frame["full_text"]], "keywords": [e.keywords(x) for x in frame["full_text"]]})

        said = cut(full.where("trim(full_text) <> ''").mapInPandas(run, ddl))
        meta = F.array(F.struct(F.col("doc_id").alias("document_id"), F.lit(None).cast("int").alias("chunk_id"), F.lit(None).alias("visual")).cast(METADATA))
        nodes = said.join(names, "doc_id").select(F.col("doc_id").alias("id"), "name", F.col("summary").alias("description"), F.lit(2).alias("level"), F.lit(False).alias("is_visual"), F.lit(None).cast("string").alias("community_id"), meta.alias("metadata"))
        words = said.select("doc_id", F.posexplode("keywords").alias("pos", "description")).select(derived_id(F.lit("keyword"), "doc_id", "pos").alias("id"), F.col("doc_id").alias("node_id"), "pos", "description", meta.alias("metadata"))
        reach = index.document_of(t.nodes, t.node_children).select("id", F.explode("document_ids").alias("doc_id"))
        own = t.nodes.where("level = 1").select("id").join(reach, "id").join(said.select("doc_id"), "doc_id").select(F.col("doc_id").alias("parent_id"), F.col("id").alias("child_id"))
        t = gs.put_properties(gs.put_nodes(t, cut(nodes)), cut(words))
        parent = own.groupBy("child_id").agg(F.min("parent_id").alias("p")).withColumnRenamed("child_id", "id")
        linked = t.nodes.join(parent, "id", "left").withColumn("community_id", F.coalesce("p", "community_id")).select(*t.nodes.columns)
        self.tables = self._kept(replace(t, nodes=linked, node_children=t.node_children.unionByName(own).distinct()))

    # index

    def sync(self) -> None:
        """Brings the index up to date with the changes since the last time."""
        t = self.tables
        log = t.change_log.where(F.col("seq") > self.synced_seq)
        texts = index.object_texts(t.nodes, t.edges, t.properties, t.node_children)
        insert, delete = index.sync_delta(log, texts)
        self.index = cut(index.apply_delta(self.index, insert, delete, self.providers.embedder))
        last = t.change_log.agg(F.max("seq")).first()[0]
        self.synced_seq = self.synced_seq if last is None else last

    def save(self) -> None:
        if not self.folder:
            return
        gs.save(self.tables, self.folder)
        v = gs.current_version(self.spark, self.folder)
        self.index.write.mode("overwrite").partitionBy("level").parquet(f"{self.folder}/index/v{v:06d}")
        self.spark.createDataFrame([(v,)], "v long").coalesce(1).write.mode("append").json(f"{self.folder}/index/CURRENT")

    # asking

    def _documents(self, names: list[str] | None) -> list[str] | None:
        search.check(self.tables)
        return search.document_ids(self.tables.documents, names) if names else None

    def search(self, query: str, filter_filenames: list[str] | None = None) -> search.Answer:
        return search.local_search(self.index, self.tables, query, self.providers, self._documents(filter_filenames))

    def global_search(self, query: str, filter_filenames: list[str] | None = None) -> str:
        return search.global_search(self.index, self.tables, query, self.providers, self._documents(filter_filenames))

    # changing

    def add_node(self, name: str, description: str, level: int, document_id: str | None = None, chunk_id: int | None = None) -> str:
        meta = [(document_id, chunk_id, None)] if document_id else []
        row = self.spark.createDataFrame([(name, description, level, meta)], f"name string, description string, level int, metadata array<{METADATA}>")
        row = row.select(derived_id(F.lit("node"), F.lit(document_id), F.lower("name"), F.lit(level)).alias("id"), "name", "description", "level", F.lit(False).alias("is_visual"), F.lit(None).cast("string").alias("community_id"), "metadata")
        self.tables = self._kept(gs.put_nodes(self.tables, row))
        return row.first().id

    def add_edge(self, frm: str, to: str, description: str, document_id: str | None = None, chunk_id: int | None = None) -> str:
        meta = [(document_id, chunk_id, None)] if document_id else []
        row = self.spark.createDataFrame([(frm, to, description, meta)], f"frm string, `to` string, description string, metadata array<{METADATA}>")
        row = row.select(derived_id(F.lit("edge"), "frm", "to", "description").alias("id"), "frm", "to", "description", "metadata")
        self.tables = self._kept(gs.put_edges(self.tables, row))
        return row.first().id

    def add_property(self, node_id: str, description: str, document_id: str | None = None, chunk_id: int | None = None) -> str:
        """A further property of a node, after those it has."""
        meta = [(document_id, chunk_id, None)] if document_id else []
        row = self.spark.createDataFrame([(node_id, description, meta)], f"node_id string, description string, metadata array<{METADATA}>")
        last = self.tables.properties.where(F.col("node_id") == node_id).agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("pos"))
        row = row.join(F.broadcast(last)).select(derived_id(F.lit("property"), "node_id", "description", "pos").alias("id"), "node_id", F.col("pos").cast("int").alias("pos"), "description", "metadata")  # one row with one row
        row = cut(row)
        self.tables = self._kept(gs.put_properties(self.tables, row))
        return row.first().id

    def get_document_by_id(self, document_id: str):
        """The document's row, or None."""
        return self.tables.documents.where(F.col("id") == document_id).first()

    def get_document_by_name(self, name: str):
        return self.tables.documents.where(F.col("name") == name).first()

    def remove_document(self, name: str) -> None:
        self.tables = self._kept(gs.delete_document(self.tables, search.document_ids(self.tables.documents, [name])[0]))

    def set_tags(self, name: str, tags: dict[str, object]) -> None:
        """Tags of a document; values keep the name of their type in tag_types."""
        m = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)).cast("map<string, string>") if d else F.create_map().cast("map<string, string>")
        here = F.col("name") == name
        docs = self.tables.documents.withColumn("tags", F.when(here, m({k: str(v) for k, v in tags.items()})).otherwise(F.col("tags"))).withColumn("tag_types", F.when(here, m({k: type(v).__name__ for k, v in tags.items()})).otherwise(F.col("tag_types")))
        self.tables = self._kept(replace(self.tables, documents=docs))

    # reporting

    def get_all_documents(self) -> DataFrame:
        return self.tables.documents

    def dashboard(self) -> str:
        return report.dashboard(self.tables)

    def visualize(self, path: str, level: int = 0) -> None:
        report.write_html(self.tables, path, level)

    def build_info(self, chunks: int, tokens: int, model: str = "gpt-4o") -> str:
        return f"{chunks} chunks, {tokens} tokens, about ${cost(tokens, model)} and {time_text(chunks, model)} with {model}"
