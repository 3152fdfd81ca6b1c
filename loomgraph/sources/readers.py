"""Scans: text files, layout XML, analysis JSON, and stored graph tables."""

from __future__ import annotations

import os
import subprocess
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import TablesMissing, UnsupportedFile
from loomgraph.functions.text import stripped
from loomgraph.schemas import ANALYSIS, GRAPH_TABLES, derived_id, schema

KINDS = ("txt", "pdf")


def file_name(path: str = "path") -> F.Column:
    return F.element_at(F.split(F.col(path), "/"), -1)


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, path, name, kind of files; an unsupported kind raises."""
    rows = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("name", file_name()).withColumn("kind", F.lower(F.element_at(F.split("name", r"\."), -1)))
    odd = rows.where(~F.col("kind").isin(*KINDS)).select("path").limit(5).collect()
    if odd:
        raise UnsupportedFile(", ".join(r.path for r in odd))
    return rows.withColumn("doc_id", derived_id(F.lit("document"), "name"))


def read_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, path, name, text: whole files, stripped."""
    own = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), stripped(F.col("value")).alias("text"))
    return own.withColumn("name", file_name()).withColumn("doc_id", derived_id(F.lit("document"), "name"))


def read_pdf_xml(spark: SparkSession, paths: list[str], command: str = "pdftohtml") -> DataFrame:
    """doc_id, path, name, content (layout XML) of PDF files, by an external converter, each call in a folder of its own.

    A file in which the converter finds no text is converted again with hidden text.
    """

    def run(frames):
        for frame in frames:
            xml = []
            for raw in frame["content"]:
                with tempfile.TemporaryDirectory() as d:
                    with open(os.path.join(d, "in.pdf"), "wb") as f:
                        f.write(raw)
                    out = b""
                    for hidden in ([], ["-hidden"]):
                        subprocess.run([command, "-i", "-xml", "-zoom", "1.0", *hidden, "in.pdf", "out.xml"], cwd=d, check=True, capture_output=True, timeout=300)
                        with open(os.path.join(d, "out.xml"), "rb") as f:
                            out = f.read()
                        if b"<text" in out:
                            break
                    xml.append(out.decode("utf-8", "replace"))
            yield pd.DataFrame({"path": frame["path"], "content": xml})

    own = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, content string")
    return own.withColumn("name", file_name()).withColumn("doc_id", derived_id(F.lit("document"), "name"))


def read_xml(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, path, name, content of layout XML files."""
    own = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return own.withColumn("name", file_name()).withColumn("doc_id", derived_id(F.lit("document"), "name"))


def read_analysis(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id, path, and tables, figures, paragraphs of analysis JSON files, read with a fixed schema."""
    own = spark.read.schema(schema(ANALYSIS)).json(paths, multiLine=True).select("*", F.col("_metadata.file_path").alias("path"))
    return own.withColumn("name", file_name()).withColumn("doc_id", derived_id(F.lit("document"), "name"))


def read_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The tables of a stored version; None where none is, an error where only some are."""
    there = {t: _exists(spark, f"{folder}/{t}") for t in GRAPH_TABLES}
    if not any(there.values()):
        return None
    if not all(there.values()):
        raise TablesMissing(", ".join(t for t, ok in there.items() if not ok))
    return {t: spark.read.schema(schema(ddl)).parquet(f"{folder}/{t}") for t, ddl in GRAPH_TABLES.items()}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
