"""Documents that keep arriving: each micro-batch goes through the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.functions.text import keep_good_chunks, split_documents


def stream_texts(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """path, name, text of files as they appear in a folder."""
    own = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return own.select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("text"))


def chunk_stream(texts: DataFrame) -> DataFrame:
    """Good chunks of a stream of texts; no state is kept."""
    return keep_good_chunks(split_documents(texts, "name"))


def ingest(texts: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls add(batch, batch_id) for each micro-batch. Batch ids let `add` pass over a batch that it has seen before a restart."""
    writer = texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def change_feed(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Changes (ts, id, action) per id and hour, compacted as the index needs them, with late rows up to `late`."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "id").agg(
        F.max((F.col("action") == "create").cast("int")).alias("created"), F.max((F.col("action") == "delete").cast("int")).alias("deleted"), F.count("*").alias("n")
    )
