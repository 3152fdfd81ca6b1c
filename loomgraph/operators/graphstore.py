"""Graph tables: lookups, upserts, cascading deletes, tags, the change log, and versioned storage.

A Graph is a set of DataFrames; an operation gives a new one. Changes are written to the change log with
ascending numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.errors import InvalidObject
from loomgraph.schemas import GRAPH_TABLES, empty, schema
from loomgraph.sources.readers import read_graph


@dataclass(frozen=True)
class Tables:
    nodes: DataFrame
    edges: DataFrame
    properties: DataFrame
    node_children: DataFrame
    documents: DataFrame
    change_log: DataFrame

    @staticmethod
    def new(spark: SparkSession) -> Tables:
        return Tables(**{t: empty(spark, ddl) for t, ddl in GRAPH_TABLES.items()})


# lookups


def by_id(table: DataFrame, ids: list[str]) -> DataFrame:
    return table.where(F.col("id").isin(ids))


def by_name(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Level-0 nodes of wanted (document_id, name)."""
    own = nodes.where("level = 0").select("*", F.explode(F.array_distinct(F.transform("metadata", lambda m: m["document_id"]))).alias("document_id"))
    return own.join(wanted, ["document_id", "name"], "left_semi")


def at_level(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.where(F.col("level") == level)


def max_level(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.max("level").alias("max_level"))


def node_view(t: Tables, load: str) -> DataFrame:
    """Nodes with the columns of a load level: reference, core, connected (with edge ids), full (with properties and children)."""
    if load == "reference":
        return t.nodes.select("id")
    core = t.nodes.select("id", "name", "description", "level", "is_visual", "metadata")
    if load == "core":
        return core
    edges = both_ends(t.edges).groupBy("node_id").agg(F.collect_set("edge_id").alias("edge_ids"))
    out = core.join(t.nodes.select("id", "community_id"), "id").join(edges.withColumnRenamed("node_id", "id"), "id", "left")
    if load == "connected":
        return out
    props = t.properties.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "description"))), lambda p: p["description"]).alias("properties"))
    children = t.node_children.groupBy("parent_id").agg(F.array_sort(F.collect_set("child_id")).alias("child_ids"))
    return out.join(props.withColumnRenamed("node_id", "id"), "id", "left").join(children.withColumnRenamed("parent_id", "id"), "id", "left")


def both_ends(edges: DataFrame) -> DataFrame:
    """node_id, edge_id, other: each edge from either end."""
    return edges.select(F.explode(F.array(F.struct(F.col("frm").alias("node_id"), F.col("to").alias("other")), F.struct(F.col("to").alias("node_id"), F.col("frm").alias("other")))).alias("e"), F.col("id").alias("edge_id")).select("e.node_id", "edge_id", "e.other")


# change log


def logged(t: Tables, changes: DataFrame) -> Tables:
    """changes: id, action, type, level, attributes; they are numbered on from the log's end, in order of their columns."""
    last = t.change_log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last")).scalar()
    spread = changes.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(256)))
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    start = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # 256 rows at most
    w = Window.partitionBy("_part").orderBy("id", "type", "action")
    new = spread.join(F.broadcast(start), "_part").withColumn("_at", F.row_number().over(w))
    new = new.select((last + F.col("_start") + F.col("_at")).alias("seq"), "id", "action", "type", "level", "attributes")
    return replace(t, change_log=t.change_log.unionByName(new))


def change(rows: DataFrame, action: str, kind: str, level: Column | None = None, attributes: Column | None = None) -> DataFrame:
    return rows.select("id", F.lit(action).alias("action"), F.lit(kind).alias("type"), (F.lit(0) if level is None else level).cast("int").alias("level"), (F.array().cast("array<string>") if attributes is None else attributes).alias("attributes"))


def clear_log(t: Tables) -> Tables:
    return replace(t, change_log=t.change_log.limit(0))


# upserts


def upsert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows of new ids added and those of known ids replaced."""
    return table.join(rows.select("id"), "id", "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def put_nodes(t: Tables, nodes: DataFrame, check: bool = True) -> Tables:
    """Adds nodes, or replaces those of the same id. A level-0 node needs metadata, and its name is unique within a document."""
    if check:
        own = nodes.where("level = 0")
        if own.where("metadata is null or size(metadata) = 0").limit(1).count():
            raise InvalidObject("a level-0 node needs metadata")
        named = own.select("id", "name", F.explode(F.array_distinct(F.transform("metadata", lambda m: m["document_id"]))).alias("document_id"))
        known = t.nodes.where("level = 0").select(F.col("id").alias("other"), "name", F.explode(F.array_distinct(F.transform("metadata", lambda m: m["document_id"]))).alias("document_id"))
        clash = named.join(known, ["document_id", "name"]).where("id <> other").select("name").unionByName(named.groupBy("document_id", "name").agg(F.count_distinct("id").alias("n")).where("n > 1").select("name"))
        if found := clash.limit(3).collect():
            raise InvalidObject("names are taken: " + ", ".join(r.name for r in found))
    is_new = nodes.join(t.nodes.select("id"), "id", "left_anti")
    old = nodes.join(t.nodes.select("id"), "id", "left_semi")
    changes = change(is_new, "create", "node", F.col("level")).unionByName(change(old, "update", "node", F.col("level"), F.array(F.lit("name"), F.lit("description"), F.lit("metadata"))))
    return logged(replace(t, nodes=upsert(t.nodes, nodes)), changes)


def put_edges(t: Tables, edges: DataFrame, missing: DataFrame | None = None) -> Tables:
    """Adds edges. Self-edges are refused, and edges neither end of which is known; an end that is missing is added from `missing` (node rows)."""
    if edges.where("frm = `to`").limit(1).count():
        raise InvalidObject("an edge needs two nodes")
    ends = edges.select("id", F.explode(F.array("frm", "to")).alias("node_id"))
    known = ends.join(t.nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    if edges.join(known.select("id"), "id", "left_anti").limit(1).count():
        raise InvalidObject("neither end of an edge is known")
    absent = ends.join(t.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select(F.col("node_id").alias("id")).distinct()
    if missing is not None:
        t = put_nodes(t, missing.join(absent, "id", "left_semi"))
    elif absent.limit(1).count():
        raise InvalidObject("an end of an edge is unknown")
    is_new = edges.join(t.edges.select("id"), "id", "left_anti")
    old = edges.join(t.edges.select("id"), "id", "left_semi")
    return logged(replace(t, edges=upsert(t.edges, edges)), change(is_new, "create", "edge").unionByName(change(old, "update", "edge", attributes=F.array(F.lit("description")))))


def put_properties(t: Tables, properties: DataFrame) -> Tables:
    if properties.join(t.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").limit(1).count():
        raise InvalidObject("a property's node is unknown")
    is_new = properties.join(t.properties.select("id"), "id", "left_anti")
    old = properties.join(t.properties.select("id"), "id", "left_semi")
    return logged(replace(t, properties=upsert(t.properties, properties)), change(is_new, "create", "property").unionByName(change(old, "update", "property", attributes=F.array(F.lit("description")))))


def sync_children(t: Tables, node_ids: DataFrame, edges: DataFrame, properties: DataFrame) -> Tables:
    """The edges and properties of nodes (id) become those given: absent ones are deleted, others put."""
    own_edges = both_ends(t.edges).join(node_ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.col("edge_id").alias("id")).distinct()
    own_props = t.properties.join(node_ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("id")
    t = delete_edges(t, own_edges.join(edges.select("id"), "id", "left_anti"))
    t = delete_properties(t, own_props.join(properties.select("id"), "id", "left_anti"))
    return put_properties(put_edges(t, edges), properties)


# deletes


def delete_edges(t: Tables, ids: DataFrame) -> Tables:
    """Deletes edges (id); the nodes at their ends are logged as updated."""
    gone = t.edges.join(ids.select("id").distinct(), "id", "left_semi")
    ends = gone.select(F.explode(F.array("frm", "to")).alias("id")).distinct().join(t.nodes.select("id", "level"), "id")
    changes = change(gone, "delete", "edge").unionByName(change(ends, "update", "node", F.col("level"), F.array(F.lit("edges"))))
    return logged(replace(t, edges=t.edges.join(ids.select("id").distinct(), "id", "left_anti").select(*t.edges.columns)), changes)


def delete_properties(t: Tables, ids: DataFrame) -> Tables:
    gone = t.properties.join(ids.select("id").distinct(), "id", "left_semi")
    return logged(replace(t, properties=t.properties.join(ids.select("id").distinct(), "id", "left_anti").select(*t.properties.columns)), change(gone, "delete", "property"))


def delete_nodes(t: Tables, ids: DataFrame) -> Tables:
    """Deletes nodes (id) with their edges, properties and community links; children of a deleted community have none any more."""
    ids = ids.select("id").distinct()
    gone = t.nodes.join(ids, "id", "left_semi")
    edges = both_ends(t.edges).join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select(F.col("edge_id").alias("id")).distinct()
    props = t.properties.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("id")
    left = t.edges.join(edges, "id", "left_semi").select(F.explode(F.array("frm", "to")).alias("id")).distinct().join(ids, "id", "left_anti").join(t.nodes.select("id", "level"), "id")
    changes = change(gone, "delete", "node", F.col("level")).unionByName(change(edges, "delete", "edge")).unionByName(change(props, "delete", "property")).unionByName(change(left, "update", "node", F.col("level"), F.array(F.lit("edges"))))
    lost = ids.select(F.col("id").alias("community_id"), F.lit(True).alias("_lost"))
    nodes = t.nodes.join(ids, "id", "left_anti").join(lost, "community_id", "left").withColumn("community_id", F.when(F.col("_lost").isNull(), F.col("community_id"))).select(*t.nodes.columns)
    children = t.node_children.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").join(ids.select(F.col("id").alias("child_id")), "child_id", "left_anti").select(*t.node_children.columns)
    out = replace(
        t, nodes=nodes, node_children=children,
        edges=t.edges.join(edges, "id", "left_anti").select(*t.edges.columns),
        properties=t.properties.join(props, "id", "left_anti").select(*t.properties.columns),
    )
    return logged(out, changes)


def only_from(document_id: str) -> Column:
    """The row's metadata names this document and no other."""
    return F.array_distinct(F.transform("metadata", lambda m: m["document_id"])) == F.array(F.lit(document_id))


def delete_document(t: Tables, document_id: str) -> Tables:
    """Deletes a document: nodes, edges and properties that come from it alone, its level-2 node, communities that are left without a child;
    what other documents share loses its metadata of this one."""
    doomed = t.nodes.where(((F.col("level") == 0) & only_from(document_id)) | ((F.col("level") == 2) & (F.col("id") == document_id))).select("id")
    t = delete_nodes(t, doomed)
    t = delete_edges(t, t.edges.where(only_from(document_id)).select("id"))
    t = delete_properties(t, t.properties.where(only_from(document_id)).select("id"))
    empty_communities = t.nodes.where("level = 1").select("id").join(t.node_children.select(F.col("parent_id").alias("id")), "id", "left_anti")
    t = delete_nodes(t, empty_communities)
    strip = lambda table: table.withColumn("metadata", F.filter("metadata", lambda m: m["document_id"] != document_id))
    return replace(t, nodes=strip(t.nodes), edges=strip(t.edges), properties=strip(t.properties), documents=t.documents.where(F.col("id") != document_id))


# documents and tags


def put_documents(t: Tables, documents: DataFrame) -> Tables:
    return replace(t, documents=upsert(t.documents, documents))


def tag_registry(documents: DataFrame) -> DataFrame:
    """tag, type (of the least document id that has it), count."""
    each = documents.select("id", F.explode("tags").alias("tag", "value"), "tag_types").where("value is not null")
    return each.groupBy("tag").agg(F.min_by(F.try_element_at("tag_types", F.col("tag")), F.col("id")).alias("type"), F.count("*").alias("count"))


def filter_by_tags(documents: DataFrame, wanted: dict[str, str], ignore_missing: bool = False) -> DataFrame:
    """Documents that have all the values; with ignore_missing, a document without a tag passes for that tag."""
    ok = F.lit(True)
    for tag, value in wanted.items():
        own = F.try_element_at("tags", F.lit(tag))
        same = F.coalesce(own == value, F.lit(False))
        ok = ok & (same | own.isNull() if ignore_missing else same)
    return documents.where(ok)


# storage


def save(t: Tables, folder: str) -> str:
    """Writes a new version below the folder, and only then makes it the current one. The path of the version."""
    spark = t.nodes.sparkSession
    version = (current_version(spark, folder) or 0) + 1
    path = f"{folder}/v{version:06d}"
    for name, ddl in GRAPH_TABLES.items():
        own = getattr(t, name).select(*schema(ddl).names)
        writer = own.write.mode("overwrite")
        (writer.partitionBy("level") if name == "nodes" else writer).parquet(f"{path}/{name}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").json(f"{folder}/CURRENT")
    return path


def current_version(spark: SparkSession, folder: str) -> int | None:
    from loomgraph.sources.readers import _exists

    if not _exists(spark, f"{folder}/CURRENT"):
        return None
    return spark.read.schema("version long").json(f"{folder}/CURRENT").agg(F.max("version")).first()[0]


def load(spark: SparkSession, folder: str) -> Tables | None:
    version = current_version(spark, folder)
    if version is None:
        return None
    got = read_graph(spark, f"{folder}/v{version:06d}")
    return None if got is None else Tables(**{n: d.select(*schema(GRAPH_TABLES[n]).names) for n, d in got.items()})
