"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh, numbered, remainder
from loomgraph.llm.decontamination import keep_clean
from loomgraph.llm.linededup import dedup_lines
from loomgraph.llm.neardups import first_rows
from loomgraph.llm.quality import fit, keep_good
from loomgraph.llm.sentencepieces import model_path, token_digests
from loomgraph.session import scratch, table


#: A document of which line dedup leaves a smaller share of the characters is a copy's remainder and goes.
LEAST_LEFT = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject (score >= 0.7).

    Null is scored as the empty text; repeated rows are kept or rejected alike, and so are texts under a null id.
    """
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    return keep_good(docs, fit(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one. A document that loses more than LEAST_LEFT allows goes: what is left of a copy is no text.

    Null and empty texts, having no lines to lose, stay as they are. Rows that share id and text lose the same lines; n_chars, where there is one, follows the text.
    """
    removed, before = fresh("_removed", docs), fresh("_before", docs)
    out = dedup_lines(docs.withColumn(before, F.length("text")), removed_col=removed)
    changed = F.col(removed).isNotNull()
    out = out.where(~changed | (F.length("text") >= F.lit(LEAST_LEFT) * F.col(before)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near duplicates; of rows that share it or have none, one.

    Null and empty texts and those without words are no duplicates and all stay.
    """
    rows, row = numbered(docs)
    return rows.join(first_rows(rows, row), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole benchmark window, however long they are, and with less than a twentieth of their words, or none, in items that are shorter than a window.

    Null and empty texts have no words and stay; repeated rows are treated alike.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"), whole_windows=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and the decoded text: one row per row; null is encoded as the empty text."""
    return token_digests(docs, model_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encode),
]

#: Compression sizes and piece ids can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage gives is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i:
            path = scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
