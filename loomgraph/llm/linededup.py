"""Line dedup: lines whose word sets match an earlier line's are taken out of their documents.

Two lines match where 100 * shared >= percent * united words (lower-cased A-Z, split at white space). A line goes
when any line before it, in order of document id and line number, matches it. The join is the exact
set-similarity join of .setjoin: words ordered by rarity, prefix, length, positional and suffix
filters, and a verification of each pair of distinct word sets.

Defined results: blank lines stay. Null text stays null and the empty text empty. Rows that share an
id and the text are one document told twice: each loses the lines that the other loses, and neither counts as the
other's earlier. Rows that share the id only, or have none, are documents of their own, each of which only loses its own lines;
a null id is after all others, in the order of rows, and texts of one id are in the order of their hash. A text that loses all its lines becomes empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import cut

from .common import NO_ID, documents, fresh, numbered, small_batches, with_ids
from .setjoin import SetJoin, lines

PERCENT = 80


def _later_of(members: dict, a: tuple, b: tuple) -> tuple:
    """The class whose first line is later, which one earlier match is enough for."""
    return a if members[a][:3] > members[b][:3] else b


def _later(members: dict, linked: list) -> list[tuple]:
    """The first lines of classes that match a class with an earlier first line."""
    return [(*members[m][:3],) for m in {_later_of(members, a, b) for a, b in linked}]


def _document(id_col: str, text_col: str, row: str) -> F.Column:
    """Tells documents of one id apart: by their text, and without an id by the row."""
    return F.when(F.col(f"`{id_col}`").isNull(), F.col(row)).otherwise(F.xxhash64(F.col(f"`{text_col}`").cast("string")))


def removed_lines(docs: DataFrame, row: str | None = None, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, row, removed array<int>: the line numbers (from 0) that a document loses, for documents that lose any. `row` is the column that numbered() gave; without it rows are numbered here."""
    if row is None:
        docs, row = numbered(docs)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), _document(id_col, text_col, row).alias("row"))
    join = SetJoin(with_ids(small_batches(texts)), lines, percent, small=True)
    classes = cut(join.classes())
    pairs = join.candidates()
    place = ["doc", "row", "part"]
    later = join.verified(pairs, classes, _later, pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("part", pa.int32())]), "doc long, row long, part int", _later_of).distinct()
    gone = classes.join(later.withColumn("gone", F.lit(True)), place, "left").where("copies > 1 or gone")
    lost = join.items().where("n > 0").join(gone.select("k", "n", F.col("doc").alias("d"), F.col("row").alias("r"), F.col("part").alias("p"), "gone"), ["k", "n"]).where("gone or doc <> d or row <> r or part <> p")
    return lost.groupBy("doc", "row").agg(F.array_sort(F.collect_set("part")).alias("removed"))


def dedup_lines(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "_removed") -> DataFrame:
    """All columns of `docs`, the text without its removed lines, and the removed line numbers in `removed_col` (null: none), which replaces a column of that name."""
    rows, row = numbered(docs.drop(removed_col))
    lost = removed_lines(rows, row, percent=percent, id_col=id_col, text_col=text_col)
    doc, document = fresh("_doc", rows, docs), fresh("_document", rows, docs)
    # hashed by the removed lists, so that texts aren't sorted
    lost = lost.select(F.col("doc").alias(doc), F.col("row").alias(document), F.col("removed").alias(removed_col)).hint("shuffle_hash")
    same = (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)) == F.col(doc)) & (_document(id_col, text_col, row) == F.col(document))
    both = rows.join(lost, same, "left").drop(doc, document, row)
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda line, i: ~F.array_contains(removed_col, i)), "\n")
    return both.withColumn(text_col, F.when(F.col(removed_col).isNull(), F.col(f"`{text_col}`")).otherwise(kept))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the lines removed (comma-joined numbers), how many, and the SHA-256 of the text that is left."""
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id",
        F.coalesce(F.size("_removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("_removed", lambda i: i.cast("string")), ","), F.lit("")).alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
