"""What the operators on texts share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import scratch, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """Lets Python workers get at most `rows` rows at once: texts may be long, and two workers share an executor."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; whatever else the table has can't clash."""
    return small_batches(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")))


#: Stands for a null id where ids are compared: after all others.
NO_ID = (1 << 63) - 1


def with_ids(texts: DataFrame) -> DataFrame:
    """doc_id, text of id_and_text() with NO_ID for null."""
    return texts.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def fresh(want: str, *frames: DataFrame) -> str:
    """A column name, `want` or a longer one, that none of the frames has in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while want.lower() in taken:
        want += "_"
    return want


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs are the rows of files, perhaps filtered and with other columns, so that each row has a place in a file."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.deterministic():
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a 64-bit number of each row, the same in every pass; and the number's column.

    A Parquet row is told by its place (a hash of its file and number there). Other rows are written once.
    """
    spark, row = docs.sparkSession, fresh("_row", docs)
    if _is_scan(docs) and "_metadata" not in {c.lower() for c in docs.columns}:
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(row)), row
        except AnalysisException:  # files of a format without row numbers
            pass
    path = scratch(spark, "numbered")
    with_row = docs.withColumn(row, F.monotonically_increasing_id())
    with_row.write.parquet(path)
    return spark.read.schema(with_row.schema).parquet(path), row


def remainder(of: str, by: int) -> F.Column:
    """crc32 of an id as text, modulo `by`; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit("")).cast("binary")) % by


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
