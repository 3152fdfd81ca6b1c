"""Row types of the property graph and the derivation of ids.

Ids are digests of natural keys, so that a task that runs again makes the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEPARATOR = "\u0001"

VISUAL = "struct<id: string, content: string, save_location: string, page_num: int, type: string>"
METADATA = f"struct<document_id: string, chunk_id: int, visual: {VISUAL}>"

NODES = f"id string, name string, description string, level int, is_visual boolean, community_id string, metadata array<{METADATA}>"
EDGES = f"id string, frm string, `to` string, description string, metadata array<{METADATA}>"
PROPERTIES = f"id string, node_id string, pos int, description string, metadata array<{METADATA}>"
NODE_CHILDREN = "parent_id string, child_id string"
DOCUMENTS = "id string, name string, chunk_num int, token_num long, tags map<string, string>, tag_types map<string, string>"
CHANGE_LOG = "seq long, id string, action string, type string, level int, attributes array<string>"
CHUNKS = "doc_id string, chunk_id int, text string, page_num int"
PARAGRAPHS = "doc_id string, id int, role string, content string, page_num int"
VISUAL_ELEMENTS = "doc_id string, content string, caption string, save_location string, page_num int, type string"
VECTOR_INDEX = "id string, text string, embedding array<float>, level int, type string, document_id string, document_ids array<string>"
SEARCH_HITS = "id string, chunk string, type string, distance double"

NODE_EXT = "array<struct<name: string, description: string>>"
EDGE_EXT = "array<struct<source: string, target: string, relationship: string>>"
PROPERTY_EXT = "array<struct<entity_name: string, properties: array<string>>>"
BUILD_LOG = f"log_id string, document_id string, chunk_id int, chunk_text string, nodes {NODE_EXT}, edges {EDGE_EXT}, properties {PROPERTY_EXT}, main_visual_entity_name string, visual {VISUAL}"

_REGION = "struct<page_number: int, polygon: array<double>>"
_CELL = f"struct<row_index: int, column_index: int, content: string, bounding_regions: array<{_REGION}>>"
ANALYSIS = (
    f"tables array<struct<id: int, row_count: int, column_count: int, caption: string, page_num: int, bounding_regions: array<{_REGION}>, cells: array<{_CELL}>>>, "
    f"figures array<struct<id: string, caption: string, page_num: int, bounding_regions: array<{_REGION}>>>, "
    "paragraphs array<struct<id: int, role: string, content: string, page_num: int>>"
)
SEGMENTS = "doc_id string, `left` double, top double, width double, height double, page_number int, page_width int, page_height int, text string, type string"

GRAPH_TABLES = {"nodes": NODES, "edges": EDGES, "properties": PROPERTIES, "node_children": NODE_CHILDREN, "documents": DOCUMENTS, "change_log": CHANGE_LOG}


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def derived_id(*parts: Column | str) -> Column:
    """An id from the columns of a natural key. A null part counts as a mark of its own, not as the empty string."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(c.cast("string"), F.lit("\u0002")) for c in cols)), 256)


def empty(spark, ddl: str):
    return spark.createDataFrame([], schema(ddl))
