"""The driver's order tables seen as a graph and as build logs, so that every graph operator has a large input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators.graphstore import Tables
from loomgraph.schemas import CHANGE_LOG, METADATA, empty
from loomgraph.session import kept, table


def meta(*docs: F.Column) -> F.Column:
    one = lambda d: F.struct(d.cast("string").alias("document_id"), F.lit(None).cast("int").alias("chunk_id"), F.lit(None).alias("visual")).cast(METADATA)
    return F.array(*map(one, docs)) if docs else F.array().cast(f"array<{METADATA}>")


def graph(spark: SparkSession, d: str) -> Tables:
    """Customers, suppliers and parts are level-0 nodes, nations communities, regions the level above; part-supplier pairs
    are edges, orders properties. A nation is the document that its customers and suppliers come from; parts come from those of all their suppliers.
    What is aggregated from the line items is written once, as every use of nodes and edges would aggregate it again."""
    t = lambda n: table(spark, d, n)
    nothing = F.lit(None).cast("string")
    node = lambda i, name, text, level, up, m: (i.alias("id"), name.alias("name"), text.alias("description"), F.lit(level).alias("level"), F.lit(False).alias("is_visual"), up.alias("community_id"), m.alias("metadata"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    sold = t("lineitem").select("l_partkey", "l_suppkey", "l_returnflag").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    pairs = kept(sold.groupBy("l_partkey", "l_suppkey", "s_nationkey").agg(F.max("l_returnflag").alias("flag")), "pairs")
    docs = pairs.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_set(key("d", "s_nationkey"))).alias("docs"))
    parts = kept(t("part").select("p_partkey", "p_name", "p_brand").join(docs, "p_partkey", "left"), "parts")
    many = F.transform(F.coalesce("docs", F.array().cast("array<string>")), lambda x: F.struct(x.alias("document_id"), F.lit(None).cast("int").alias("chunk_id"), F.lit(None).alias("visual")).cast(METADATA))
    nodes = (
        t("region").select(*node(key("r", "r_regionkey"), F.col("r_name"), F.lit(""), 2, nothing, meta()))
        .unionByName(t("nation").select(*node(key("n", "n_nationkey"), F.col("n_name"), F.lit(""), 1, key("r", "n_regionkey"), meta())))
        .unionByName(t("customer").select(*node(key("c", "c_custkey"), F.lower("c_name"), F.col("c_mktsegment"), 0, key("n", "c_nationkey"), meta(key("d", "c_nationkey")))))
        .unionByName(t("supplier").select(*node(key("s", "s_suppkey"), F.lower("s_name"), F.lit("supplier"), 0, key("n", "s_nationkey"), meta(key("d", "s_nationkey")))))
        .unionByName(parts.select(*node(key("p", "p_partkey"), F.lower("p_name"), F.col("p_brand"), 0, nothing, many)))
    )
    edges = pairs.select(F.concat(key("e", "l_partkey"), key("_", "l_suppkey")).alias("id"), key("p", "l_partkey").alias("frm"), key("s", "l_suppkey").alias("to"), F.col("flag").alias("description"), meta(key("d", "s_nationkey")).alias("metadata"))
    orders = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    properties = orders.select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("node_id"), (F.row_number().over(w) - 1).alias("pos"), F.col("o_orderpriority").alias("description"), meta(key("d", "c_nationkey")).alias("metadata"))
    children = nodes.where("community_id is not null").select(F.col("community_id").alias("parent_id"), F.col("id").alias("child_id"))
    tags = documents_with_tags(spark, d)
    return Tables(nodes, edges, properties, children, tags, empty(spark, CHANGE_LOG))


def documents_with_tags(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the tags lang and source, and quality and toxic where they are labelled."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    whole = F.map_from_arrays(F.array(*map(F.lit, ("lang", "source", "quality", "toxic"))), F.array("lang", "source", F.col("quality").cast("string"), F.col("toxic").cast("string")))
    kinds = F.create_map(*(F.lit(x) for x in ("lang", "str", "source", "str", "quality", "int", "toxic", "int")))
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc"), "doc_id").alias("name"), F.lit(1).alias("chunk_num"), F.col("n_chars").alias("token_num"), F.map_filter(whole, lambda _, v: v.isNotNull()).alias("tags"), kinds.alias("tag_types"))


def build_log(spark: SparkSession, d: str) -> DataFrame:
    """A log for each order: its parts as entities, each part with the next one as relations, flags as properties; a nation is the document."""
    t = lambda n: table(spark, d, n)
    items = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    own = items.groupBy("l_orderkey", "c_nationkey").agg(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_brand", "l_returnflag"))).alias("x"))
    nodes = F.transform("x", lambda i: F.struct(i["p_name"].alias("name"), i["p_brand"].alias("description")))
    edges = F.transform(F.when(F.size("x") > 1, F.sequence(F.lit(0), F.size("x") - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get("x", i)["p_name"].alias("source"), F.get("x", i + 1)["p_name"].alias("target"), F.get("x", i)["l_returnflag"].alias("relationship")))
    props = F.transform("x", lambda i: F.struct(i["p_name"].alias("entity_name"), F.array(i["l_returnflag"]).alias("properties")))
    visual = F.lit(None).cast("struct<id: string, content: string, save_location: string, page_num: int, type: string>")
    return own.select(F.lpad(F.col("l_orderkey").cast("string"), 12, "0").alias("log_id"), F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("document_id"), F.lit(0).alias("chunk_id"), F.lit("").alias("chunk_text"), nodes.alias("nodes"), edges.alias("edges"), props.alias("properties"), F.lit(None).cast("string").alias("main_visual_entity_name"), visual.alias("visual"))
