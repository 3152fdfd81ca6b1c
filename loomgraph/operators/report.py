"""Statistics and plots of a graph."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphstore import Tables, both_ends


def degrees(t: Tables) -> DataFrame:
    """id, name, level, degree of all nodes."""
    d = both_ends(t.edges).groupBy("node_id").agg(F.count("*").alias("degree")).withColumnRenamed("node_id", "id")
    return t.nodes.select("id", "name", "level").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def top_nodes(t: Tables, level: int = 0, k: int = 5) -> DataFrame:
    return degrees(t).where(F.col("level") == level).orderBy(F.desc("degree"), "id").limit(k)


def totals(t: Tables) -> DataFrame:
    """One row: nodes (levels 0 and 1), communities, total_degree (each edge twice), edges, properties, documents."""
    d = degrees(t).agg(F.sum(F.when(F.col("level") <= 1, 1).otherwise(0)).alias("total_nodes"), F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).alias("communities"), F.sum(F.when(F.col("level") <= 1, F.col("degree")).otherwise(0)).alias("total_degree"))
    e = t.edges.agg(F.count("*").alias("total_edges"))
    p = t.properties.agg(F.count("*").alias("total_properties"))
    s = t.nodes.select(F.explode("metadata").alias("m")).agg(F.count_distinct("m.document_id").alias("documents"))
    rows = d.unionByName(e, allowMissingColumns=True).unionByName(p, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)
    return rows.agg(*(F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in rows.columns))


def dashboard(t: Tables, model: str = "offline") -> str:
    """The statistics as text."""
    row = totals(t).first()
    lines = [f"model: {model}", *(f"{k}: {v}" for k, v in row.asDict().items()), "top nodes:"]
    lines += [f"  {r['name']} ({r.degree})" for r in top_nodes(t, 0, 5).collect()]
    lines += ["top communities:", *(f"  {r['name']} ({r.degree})" for r in top_nodes(t, 1, 3).collect())]
    return "\n".join(lines)


def plot_rows(t: Tables, level: int = 0) -> tuple[DataFrame, DataFrame]:
    """name, title, value (degree), color_idx of nodes of a level, and frm, to, title of edges between them. Nodes of one name are one."""
    d = degrees(t).where(F.col("level") == level)
    own = d.join(t.nodes.select("id", "description", "community_id"), "id")
    nodes = own.groupBy("name").agg(F.min_by("description", "id").alias("title"), F.sum("degree").alias("value"), F.min_by("community_id", "id").alias("community"))
    nodes = nodes.withColumn("color_idx", F.pmod(F.xxhash64(F.coalesce("community", "name")), F.lit(12)).cast("int")).drop("community")
    names = own.select("id", "name")
    edges = t.edges.join(names.select(F.col("id").alias("frm"), F.col("name").alias("a")), "frm").join(names.select(F.col("id").alias("to"), F.col("name").alias("b")), "to").select(F.col("a").alias("frm"), F.col("b").alias("to"), F.col("description").alias("title"))
    return nodes, edges


def write_html(t: Tables, path: str, level: int = 0, most: int = 2000) -> None:
    """A page that draws the `most` nodes of the highest degree and the edges between them, on a circle by colour."""
    nodes, edges = plot_rows(t, level)
    shown = nodes.orderBy(F.desc("value"), "name").limit(most)
    rows = [r.asDict() for r in shown.orderBy("color_idx", "name").collect()]
    names = F.broadcast(shown.select("name"))  # `most` rows
    kept = edges.join(names.withColumnRenamed("name", "frm"), "frm", "left_semi").join(names.withColumnRenamed("name", "to"), "to", "left_semi")
    links = [(r.frm, r.to) for r in kept.select("frm", "to").distinct().limit(10 * most).collect()]
    page = (
        "<!doctype html><meta charset=utf-8><title>graph</title><canvas id=c width=1200 height=1200></canvas><script>"
        f"const N={json.dumps(rows, ensure_ascii=True)},L={json.dumps(links, ensure_ascii=True)};".replace("</", "<\\/")
        + "const g=c.getContext('2d'),at={};N.forEach((n,i)=>{const a=2*Math.PI*i/N.length;at[n.name]=[600+500*Math.cos(a),600+500*Math.sin(a)]});"
        "g.strokeStyle='#ccc';L.forEach(([a,b])=>{g.beginPath();g.moveTo(...at[a]);g.lineTo(...at[b]);g.stroke()});"
        "N.forEach(n=>{g.fillStyle=`hsl(${30*n.color_idx},70%,50%)`;g.beginPath();g.arc(...at[n.name],3+Math.sqrt(n.value),0,7);g.fill();g.fillText(n.name,at[n.name][0]+6,at[n.name][1])})</script>"
        f"<noscript>{html.escape(str(len(rows)))} nodes</noscript>"
    )
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
