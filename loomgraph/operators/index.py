"""Vector index: synchronisation from the change log, and filtered nearest-neighbour search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.providers import Embedder
from loomgraph.session import cut


def compacted(change_log: DataFrame) -> DataFrame:
    """id, type, level (of the first entry), to_create, to_delete: what an index that saw none of the entries has to do."""
    return change_log.groupBy("id").agg(
        F.min_by("type", "seq").alias("type"), F.min_by("level", "seq").alias("level"),
        (~F.bool_or(F.col("action") == "delete")).alias("to_create"), (~F.bool_or(F.col("action") == "create")).alias("to_delete"),
    )


def document_of(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """id, document_ids (sorted), document_id (the least): of a level-0 node its own documents, of others those of all nodes below, however deep.

    Each step climbs one level; what was reached before isn't climbed again, so a cycle ends too.
    """
    own = nodes.where("level = 0").select("id", F.explode(F.transform("metadata", lambda m: m["document_id"])).alias("document_id")).distinct()
    up_links = children.select(F.col("child_id").alias("id"), "parent_id")
    reached = up = own = cut(own)
    while True:
        up = cut(up.join(up_links, "id").select(F.col("parent_id").alias("id"), "document_id").distinct().join(reached, ["id", "document_id"], "left_anti"))
        if not up.limit(1).count():
            break
        reached = reached.unionByName(up)
    return reached.groupBy("id").agg(F.array_sort(F.collect_set("document_id")).alias("document_ids")).withColumn("document_id", F.col("document_ids")[0])


def object_texts(nodes: DataFrame, edges: DataFrame, properties: DataFrame, children: DataFrame) -> DataFrame:
    """id, type, text, document_id, document_ids of all objects: `name, description` of nodes, the description of edges, `node name, description` of properties."""
    docs = document_of(nodes, children)
    n = nodes.join(docs, "id", "left").select("id", F.lit("node").alias("type"), F.concat_ws(", ", "name", "description").alias("text"), "document_id", "document_ids")
    by_meta = lambda t: t.withColumn("document_ids", F.array_sort(F.array_distinct(F.transform("metadata", lambda m: m["document_id"])))).withColumn("document_id", F.try_element_at("document_ids", F.lit(1)))
    e = by_meta(edges).select("id", F.lit("edge").alias("type"), F.col("description").alias("text"), "document_id", "document_ids")
    named = nodes.select(F.col("id").alias("node_id"), "name").join(docs.withColumnRenamed("id", "node_id"), "node_id", "left")
    p = properties.join(named, "node_id").select("id", F.lit("property").alias("type"), F.concat_ws(", ", "name", "description").alias("text"), "document_id", "document_ids")
    return n.unionByName(e).unionByName(p)


def sync_delta(change_log: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to insert (id, text, level, type, document_id, document_ids) and ids to delete. An object that is no more is left out."""
    what = compacted(change_log)
    insert = what.where("to_create").select("id", "level").join(texts, "id").select("id", "text", "level", "type", "document_id", "document_ids")
    return insert, what.where("to_delete").select("id")


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text") -> DataFrame:
    """The rows with `embedding`; blank texts count as "null"."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        found = []
        for lo in range(0, len(texts), 256):  # lists of Python numbers are eight times as large as what is kept
            found += [np.array(v, dtype=np.float32) for v in embedder.embed(texts.iloc[lo : lo + 256].to_list())]
        return pd.Series(found, dtype=object)

    shown = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", F.lit("null")).otherwise(F.col(text))
    return rows.withColumn(text, shown).withColumn("embedding", run(shown))


def apply_delta(index: DataFrame, insert: DataFrame, delete: DataFrame, embedder: Embedder) -> DataFrame:
    """The index without what is deleted and with what is new; an id that is there is kept as it is."""
    left = index.join(delete.select("id").distinct(), "id", "left_anti")
    new = insert.join(left.select("id"), "id", "left_anti")
    return left.select(*index.columns).unionByName(embedded(new, embedder).select(*index.columns))


def where(filters: dict[str, object] | None) -> Column:
    """Equality for a value, membership for a list, all together; document_id also finds rows that several documents share."""
    ok = F.lit(True)
    for name, value in (filters or {}).items():
        ok = ok & (F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return ok


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def nearest(index: DataFrame, query: list[float], k: int, filters: dict[str, object] | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The k rows (fewer if there are fewer) with the smallest squared distance, ties by id; filtered first."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return index.where(where(filters)).withColumn("distance", squared_distance(F.col(vector), q)).orderBy("distance", id_col).limit(k)


def _ranked(query: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k least distances (ties by id, NaN last), in order."""
    order = np.lexsort((ids, d, query))
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    return order[np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k]


#: Vectors of either side that are met at once, and pairs of them whose distances are taken at once.
SIDE, PAIRS = 1024, 1 << 16


class _Nearest:
    """The k nearest of all rows seen for queries q. Products rule a row out when its distance is above the k-th so far by more than their error can be;
    the distances of other rows are taken exactly. What is held grows with the queries and k, not with the rows."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.norm = (q * q).sum(axis=1)
        self.query, self.d, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0), None
        self.limit = np.full(len(q), np.inf)

    def add(self, m: np.ndarray, ids: np.ndarray) -> None:
        new = [(self.query, self.d, ids[:0] if self.ids is None else self.ids)]
        norm = (m * m).sum(axis=1)
        with np.errstate(all="ignore"):
            about = self.norm[:, None] + norm - 2 * (self.q @ m.T)
            error = 8 * (m.shape[1] + 8) * np.finfo(float).eps * (self.norm + norm.max(initial=0.0))
            limit = self.limit
            if len(m) >= self.k and np.isinf(limit).any():
                limit = np.fmin(limit, np.partition(about, self.k - 1, axis=1)[:, self.k - 1] + error)
            qi, mi = np.nonzero(~(about > (limit + error)[:, None]))
            for lo in range(0, len(qi), PAIRS):
                a, b = qi[lo : lo + PAIRS], mi[lo : lo + PAIRS]
                new.append((a, ((m[b] - self.q[a]) ** 2).sum(axis=1), ids[b]))
                if len(new) > 16:
                    new = [self._best(new)]
        self.query, self.d, self.ids = self._best(new)
        last = np.flatnonzero(np.r_[self.query[1:] != self.query[:-1], True]) if len(self.query) else self.query
        full = last[np.bincount(self.query, minlength=len(self.q))[self.query[last]] == self.k]
        self.limit[self.query[full]] = self.d[full]

    def _best(self, found):
        query, d, ids = (np.concatenate(x) for x in zip(*found))
        top = _ranked(query, d, ids, self.k)
        return query[top], d[top], ids[top]


def nearest_batch(index: DataFrame, queries: DataFrame, k: int, filters: dict[str, object] | None = None, id_col: str = "id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, id, distance, rank of each query's k nearest rows. queries: query_id, query (array). They are met with the index in
    blocks, each small enough to be broadcast; each partition keeps a query's k nearest only, from batch to batch."""
    own = index.where(where(filters)).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    id_type = dict(own.dtypes)["id"]
    spark = index.sparkSession
    held, found = [], None

    def search(part) -> DataFrame:
        shared = spark.sparkContext.broadcast(([q for q, _ in part], np.array([v for _, v in part], dtype=np.float64)))

        def run(frames):
            ids, q = shared.value
            sides = [_Nearest(q[lo : lo + SIDE], k) for lo in range(0, len(q), SIDE)]
            for frame in frames:
                names = frame["id"].to_numpy()
                for lo in range(0, len(frame), SIDE):
                    m = np.stack(frame["v"].iloc[lo : lo + SIDE].to_list())
                    for side in sides:
                        side.add(m, names[lo : lo + SIDE])
            for i, side in enumerate(sides):
                if side.ids is not None:
                    yield pd.DataFrame({"query_id": [ids[i * SIDE + j] for j in side.query], "id": side.ids, "distance": side.d})

        return own.mapInPandas(run, f"query_id long, id {id_type}, distance double")

    for r in queries.select("query_id", F.col("query").cast("array<double>").alias("query")).toLocalIterator():
        held.append((r.query_id, r["query"]))
        if len(held) == block:
            found = search(held) if found is None else found.unionByName(search(held))
            held = []
    if held or found is None:
        if not held:
            return spark.createDataFrame([], f"query_id long, id {id_type}, distance double, rank int")
        found = search(held) if found is None else found.unionByName(search(held))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
