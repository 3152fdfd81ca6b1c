"""Tables and figures of analysed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_table(rows: Column, columns: Column, cells: Column) -> Column:
    """A dense grid of row_count x column_count; missing cells are empty, the last cell of a place wins, row 0 is the header."""

    def content(r: Column, c: Column) -> Column:
        here = F.filter(cells, lambda x: (x["row_index"] == r) & (x["column_index"] == c))
        return F.coalesce(F.try_element_at(here, F.lit(-1))["content"], F.lit(""))

    def line(parts: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))

    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    body = F.transform(upto(rows), lambda r: line(F.transform(upto(columns), lambda c: content(r, c))))
    rule = line(F.transform(upto(columns), lambda _: F.lit("---")))
    whole = F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(rows - 1, F.lit(0))))
    return F.when((rows > 0) & (columns > 0), F.array_join(whole, "\n")).otherwise(F.lit(""))


def bounding_box(polygon: Column) -> Column:
    """[x0, y0, x1, y1] of a polygon's first and third corner; null with fewer than six numbers."""
    return F.when(F.size(polygon) >= 6, F.array(*(F.get(polygon, F.lit(i)) for i in (0, 1, 4, 5))))


def crop_box(box: Column, width: Column, height: Column, scale: float = 72.0) -> Column:
    """The box with corners in order, held within the page and scaled; null without area."""
    x0, x1 = F.least(box[0], box[2]), F.greatest(box[0], box[2])
    y0, y1 = F.least(box[1], box[3]), F.greatest(box[1], box[3])
    held = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    a, b, c, d = held(x0, width), held(y0, height), held(x1, width), held(y1, height)
    return F.when((c > a) & (d > b), F.array(a * scale, b * scale, c * scale, d * scale))


def _elements(analysis: DataFrame, kind: str, items: str, content: Column) -> DataFrame:
    own = analysis.select("doc_id", F.posexplode(items).alias("_i", "item")).select("doc_id", "_i", "item", F.posexplode("item.bounding_regions").alias("_j", "region"))
    name = F.concat(F.lit(f"{kind.lower()}_"), F.col("_i"), F.when(F.col("_j") > 0, F.concat(F.lit("_"), F.col("_j"))).otherwise(F.lit("")), F.lit(".png"))
    return own.select(
        "doc_id",
        content.alias("content"),
        F.col("item.caption").alias("caption"),
        F.when(bounding_box(F.col("region.polygon")).isNull(), F.lit("")).otherwise(name).alias("save_location"),
        F.coalesce("region.page_number", "item.page_num").alias("page_num"),
        F.lit(kind).alias("type"),
    )


def table_elements(analysis: DataFrame) -> DataFrame:
    """One row for each table and bounding region; the content is the caption, a line break and the grid."""
    grid = markdown_table(F.col("item.row_count"), F.col("item.column_count"), F.col("item.cells"))
    return _elements(analysis, "TABLE", "tables", F.concat(F.coalesce("item.caption", F.lit("None")), F.lit("\n"), grid))


def figure_elements(analysis: DataFrame) -> DataFrame:
    return _elements(analysis, "FIGURE", "figures", F.lit(""))


def visual_elements(analysis: DataFrame) -> DataFrame:
    """Tables, then figures."""
    return table_elements(analysis).unionByName(figure_elements(analysis))


def analysis_paragraphs(analysis: DataFrame) -> DataFrame:
    return analysis.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.id", "p.role", "p.content", "p.page_num")


ENTITIES = "struct<entities: array<struct<main_node: boolean, name: string, description: string>>>"


def visual_nodes(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """nodes array<struct<name, description>>, main (the last entity marked as main), is_valid, from a model's JSON answers."""
    parsed = F.from_json(answer, ENTITIES)
    es = F.col("_p.entities")
    whole = es.isNotNull() & F.forall(es, lambda e: e["main_node"].isNotNull() & e["name"].isNotNull() & e["description"].isNotNull())
    out = answers.withColumn("_p", parsed).withColumn("is_valid", F.coalesce(whole, F.lit(False)))
    main = F.try_element_at(F.filter(es, lambda e: e["main_node"]), F.lit(-1))["name"]
    nodes = F.transform(es, lambda e: F.struct(e["name"].alias("name"), e["description"].alias("description")))
    return out.withColumn("nodes", F.when(F.col("is_valid"), nodes)).withColumn("main", F.when(F.col("is_valid"), main)).drop("_p")


def visuals_of_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Visual nodes among the parents of search hits, once each. hits: parent_nodes array<string>, document_id."""
    each = hits.select("document_id", F.explode("parent_nodes").alias("name"))
    own = nodes.where("is_visual").select("id", "name", F.explode("metadata").alias("m")).select("id", "name", F.col("m.document_id").alias("document_id"), F.col("m.visual").alias("visual"))
    return own.join(each, ["document_id", "name"], "left_semi").distinct()
