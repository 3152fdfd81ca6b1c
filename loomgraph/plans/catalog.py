"""Every registered query of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import estimates, fuzzy, text
from loomgraph.operators import community, extract, graphstore, index, layout, multimodal, report, resolve, search
from loomgraph.operators.components import connected_components
from loomgraph.providers import HashedEmbedder, OverlapReranker, Providers
from loomgraph.session import cut, table

from . import shop

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents, embedded, the nearest to a question, reranked and cut at the local threshold."""
    docs = table(spark, sf_dir, "documents")
    chunks = text.keep_good_chunks(text.split_documents(docs))
    p = Providers()
    rows = index.embedded(chunks.select(F.concat_ws(":", "doc_id", "chunk_id").alias("id"), "text", "doc_id"), p.embedder)
    question = "the nation and the order of that"
    hits = index.nearest(rows, p.embedder.embed([question])[0], 40).select("id", "text", "doc_id", "distance")
    return search.reranked(hits, question, p.reranker, 0.1).select("rank", "id", "doc_id", "text", "score")


# --- vectors

_DIST = """(select q.vec_id as query_id, v.vec_id, sum((a - b) * (a - b)) as d from
(select vec_id, unnest(embedding)::double as a, generate_subscripts(embedding, 1) as i from embeddings) v
join (select vec_id, unnest(embedding)::double as b, generate_subscripts(embedding, 1) as i from embeddings where {which}) q using (i) group by 1, 2)"""


def _zero(spark, d):
    rows = table(spark, d, "embeddings")
    return rows, [float(x) for x in rows.where("vec_id = 0").first().embedding]


@query(f"select vec_id, round(d, 6) as distance from {_DIST.format(which='vec_id = 0')} order by d, vec_id limit 10")
def vector_topk(spark, d):
    rows, q = _zero(spark, d)
    return index.nearest(rows, q, 10, id_col="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"select vec_id, round(d, 6) as distance from {_DIST.format(which='vec_id = 0')} join embeddings using (vec_id) where label in (1, 2, 3) and vec_id <> 0 order by d, vec_id limit 10")
def vector_topk_filtered(spark, d):
    rows, q = _zero(spark, d)
    return index.nearest(rows.where("vec_id <> 0"), q, 10, {"label": [1, 2, 3]}, id_col="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"select vec_id, round(d, 6) as distance from {_DIST.format(which='vec_id = 0')} join embeddings using (vec_id) where label = 3 order by d, vec_id limit 1000000")
def vector_topk_short(spark, d):
    rows, q = _zero(spark, d)
    return index.nearest(rows, q, 1_000_000, {"label": 3}, id_col="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


_BATCH = f"select query_id, vec_id, d, row_number() over (partition by query_id order by d, vec_id) as rank from {_DIST.format(which='vec_id % 20 = 0')}"


def _batch(spark, d, k):
    rows = table(spark, d, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return index.nearest_batch(rows, queries, k, id_col="vec_id").withColumnRenamed("id", "vec_id")


@query(f"select query_id, vec_id, round(d, 6) as distance, rank from ({_BATCH}) where rank <= 5")
def vector_topk_batch(spark, d):
    return _batch(spark, d, 5).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"select query_id, vec_id, rank, round(s, 6) as score from (select *, min(s) over (partition by query_id order by rank) as least from (select *, 1 / (1 + d) as s from ({_BATCH}) where rank <= 15)) where least > 0.5")
def rerank_threshold_prefix(spark, d):
    hits = _batch(spark, d, 15).withColumn("score", 1 / (1 + F.col("distance")))
    return search.above_threshold(hits, 0.5, by=["query_id"]).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# --- texts

_RATIO = "case when length(replace({0}, ' ', '')) = 0 then 0.0 else length(regexp_replace(replace({0}, ' ', ''), '\\p{{L}}', '', 'g'))::double / length(replace({0}, ' ', '')) end"


@query(f"select 'documents' as origin, doc_id as id, round({_RATIO.format('text')}, 9) as ratio from documents union all select 'pages', page_id, round({_RATIO.format('html')}, 9) from pages")
def non_alpha_ratio(spark, d):
    own = lambda n, i, c: table(spark, d, n).select(F.lit(n).alias("origin"), F.col(i).alias("id"), F.round(text.non_alpha_ratio(F.col(c)), 9).alias("ratio"))
    return own("documents", "doc_id", "text").unionByName(own("pages", "page_id", "html"))


@query(f"select doc_id, length(text) as n from documents where length(text) >= 100 and {_RATIO.format('text')} <= 0.4")
def chunk_filter(spark, d):
    return table(spark, d, "documents").where(text.is_good_chunk(F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))


@query()
def chunk_split(spark, d):
    return text.keep_good_chunks(text.split_documents(table(spark, d, "documents")))


def _paragraphs(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("id", "content"))
    return rows.select("doc_id", "id", F.when(F.length("content") < 40, F.lit("sectionHeading")).alias("role"), "content", (F.col("id") / 20).cast("int").alias("page_num"))


@query()
def chunk_pack(spark, d):
    return text.chunk_paragraphs(_paragraphs(spark, d))


@query("select doc_id::varchar as doc_id, sha256(text || chr(10)) as digest from documents")
def full_text(spark, d):
    return text.full_texts(_paragraphs(spark, d).withColumn("role", F.lit(None).cast("string"))).select("doc_id", F.sha2("full_text", 256).alias("digest"))


@query()
def doc_stats(spark, d):
    chunks = chunk_split(spark, d).withColumn("tokens", text.token_count(F.col("text")))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_num"), F.sum("tokens").alias("token_num"))


@query("select doc_id, len(regexp_extract_all(coalesce(text, ''), '" + text.TOKEN.replace("'", "''") + "'))::bigint as tokens from documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query("select source, n, t, round((t / 1e6 * 5.0 + t / 1e6 * 15.0 / 4) * 2.5, 4) as cost, case when n <= 2 then 4 else ceil(n / 2.0)::bigint * 4 end + 8 * n as seconds from (select source, count(*) as n, sum(n_chars // 4)::bigint as t from documents group by source)")
def cost_and_time_estimate(spark, d):
    own = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n_chars") / 4)).cast("long").alias("t"))
    return own.select("source", "n", "t", estimates.cost_column(F.col("t"), "gpt-4o").alias("cost"), estimates.seconds_column(F.col("n"), "gpt-4o").alias("seconds"))


@query("select text_sha as digest, n from (select sha256(text) as text_sha, count(*) as n from documents group by 1) where n > 1")
def duplicate_names(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n")).where("n > 1")


# --- build logs

_ITEMS = "(select distinct lpad(l_orderkey::varchar, 12, '0') as log_id, 'd' || c_nationkey as doc, l_linenumber, l_partkey, l_suppkey, p_name, p_brand, l_returnflag from lineitem join part on p_partkey = l_partkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey)"
_PLACED = f"(select *, row_number() over (partition by log_id order by l_linenumber, l_partkey, l_suppkey, p_name, p_brand, l_returnflag) - 1 as i from {_ITEMS})"
_NEXT = f"(select *, lead(p_name) over (partition by log_id order by i) as next from {_PLACED})"
_NODES = f"(select doc, lower(p_name) as name, arg_min(p_brand, (log_id, i)) as description from {_PLACED} group by 1, 2)"


@query(f"select distinct lower(p_name) as name from {_ITEMS}")
def entity_names_distinct(spark, d):
    return resolve.unique_names(shop.build_log(spark, d))


@query(f"select doc as document_id, name, description from {_NODES}")
def first_wins_nodes(spark, d):
    return extract.graph_nodes(shop.build_log(spark, d)).select("document_id", "name", "description")


def _known(spark, d):
    """Logs and nodes, those of one brand left out, so that some relations have an unknown end."""
    log = cut(shop.build_log(spark, d))
    return log, cut(extract.graph_nodes(log).where("description <> 'Brand#1'"))


_KNOWN = f"(select * from {_NODES} where description <> 'Brand#1')"
_ENDS = f"(select e.*, a.name as a, b.name as b from {_NEXT} e left join {_KNOWN} a on a.doc = e.doc and a.name = lower(e.p_name) left join {_KNOWN} b on b.doc = e.doc and b.name = lower(e.next) where e.next is not null)"


@query(f"select doc as document_id, a as source, b as target, l_returnflag as description, count(*) as n from {_ENDS} where a is not null and b is not null and a <> b group by all")
def edge_resolution(spark, d):
    log, nodes = _known(spark, d)
    edges, _, _ = extract.graph_edges(log, nodes)
    names = nodes.select("id", "name", "document_id")
    out = edges.join(names.select(F.col("id").alias("frm"), F.col("name").alias("source"), "document_id"), "frm").join(names.select(F.col("id").alias("to"), F.col("name").alias("target")), "to")
    return out.groupBy("document_id", "source", "target", "description").agg(F.count("*").alias("n"))


@query(f"select doc as document_id, p_name as source, next as target, count(*) as n from {_ENDS} where a is null or b is null group by all")
def edge_rejects(spark, d):
    log, nodes = _known(spark, d)
    return extract.graph_edges(log, nodes)[2].groupBy("document_id", "source", "target").agg(F.count("*").alias("n"))


@query(f"select doc as document_id, a as name, count(*) as n from {_ENDS} where a = b group by all")
def self_edge_property(spark, d):
    log, nodes = _known(spark, d)
    loops = extract.graph_edges(log, nodes)[1]
    return loops.join(nodes.select(F.col("id").alias("node_id"), "name", "document_id"), "node_id").groupBy("document_id", "name").agg(F.count("*").alias("n"))


_OWN_PROPERTIES = f"select k.doc, k.name, p.l_returnflag from {_PLACED} p join {_KNOWN} k on k.doc = p.doc and k.name = lower(p.p_name)"


@query(f"select doc as document_id, name, l_returnflag as description, count(*) as n from ({_OWN_PROPERTIES} union all select doc, a, l_returnflag from {_ENDS} where a = b) group by all")
def property_resolution(spark, d):
    log, nodes = _known(spark, d)
    loops = extract.graph_edges(log, nodes)[1]
    own = extract.graph_properties(log, nodes, loops)
    return own.join(nodes.select(F.col("id").alias("node_id"), "name", "document_id"), "node_id").groupBy("document_id", "name", "description").agg(F.count("*").alias("n"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), -1) as k, json_valid(props) as is_valid from events")
def llm_json_validate(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.lit(-1).cast("bigint")).alias("k"), v.isNotNull().alias("is_valid"))


# --- resolution

_NAMES = "(select distinct lower(p_name) as name from part union select distinct lower(split_part(p_name, ' ', 1)) from part)"
_TOKENS = f"(select distinct name, unnest(string_split(name, ' ')) as token from {_NAMES})"


def _names(spark, d):
    p = table(spark, d, "part")
    return p.select(F.lower("p_name").alias("name")).unionByName(p.select(F.lower(F.split("p_name", " ")[0]).alias("name"))).distinct()


@query(f"select s.name as small, b.name as big from {_TOKENS} s join {_TOKENS} b on s.token = b.token and s.name <> b.name group by 1, 2 having count(*) = (select count(*) from {_TOKENS} t where t.name = s.name)".replace("group by 1, 2 having count(*) = (select count(*) from " + _TOKENS + " t where t.name = s.name)", f"join (select name, count(*) as n from {_TOKENS} group by 1) c on c.name = s.name group by 1, 2, c.n having count(*) = c.n"))
def fuzzy_subset_pairs(spark, d):
    return fuzzy.subset_pairs(_names(spark, d))


@query()
def fuzzy_pairs(spark, d):
    return fuzzy.similar_pairs(_names(spark, d))


@query()
def match_sets(spark, d):
    return resolve.match_sets(_names(spark, d))


_CHAIN = "(select 'o' || o_orderkey as v, c_nationkey as g from orders join customer on c_custkey = o_custkey union select 'c' || c_custkey, c_nationkey from customer union select 'n' || c_nationkey, c_nationkey from customer)"


@query(f"select v as vertex, min(v) over (partition by g) as component from {_CHAIN}")
def components(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), "c_custkey")
    o = table(spark, d, "orders").join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    return connected_components(o.unionByName(c.select("src", "dst")))


# --- graph tables

_PS = "(select distinct l_partkey, l_suppkey, s_nationkey from lineitem join supplier on s_suppkey = l_suppkey)"
_DEGREES = f"""(select 'c' || c_custkey as id, lower(c_name) as name, 0 as level, 0::bigint as degree from customer
union all select 'n' || n_nationkey, n_name, 1, 0 from nation union all select 'r' || r_regionkey, r_name, 2, 0 from region
union all select 's' || s_suppkey, lower(s_name), 0, (select count(*) from {_PS} e where e.l_suppkey = s_suppkey) from supplier
union all select 'p' || p_partkey, lower(p_name), 0, (select count(*) from {_PS} e where e.l_partkey = p_partkey) from part)"""


@query(f"select level, count(*) as n, (select max(level) from {_DEGREES}) as max_level from {_DEGREES} group by level")
def levels(spark, d):
    nodes = shop.graph(spark, d).nodes
    top = graphstore.max_level(nodes)
    return nodes.groupBy("level").agg(F.count("*").alias("n")).join(F.broadcast(top), F.lit(True))  # one row


@query("select 's' || s_suppkey as id from supplier join nation on n_nationkey = s_nationkey where n_name is not null")
def name_lookup(spark, d):
    wanted = table(spark, d, "supplier").select(F.concat(F.lit("d"), "s_nationkey").alias("document_id"), F.lower("s_name").alias("name"))
    return graphstore.by_name(shop.graph(spark, d).nodes, wanted).select("id")


@query(f"select * from {_DEGREES}")
def degree(spark, d):
    return report.degrees(shop.graph(spark, d))


@query(f"select id, name, degree from {_DEGREES} where level = 0 order by degree desc, id limit 5")
def degree_topk(spark, d):
    return report.top_nodes(shop.graph(spark, d)).select("id", "name", "degree")


@query(f"select (select count(*) from {_DEGREES} where level <= 1)::bigint as total_nodes, (select count(*) from nation)::bigint as communities, 2 * (select count(*) from {_PS}) as total_degree, (select count(*) from {_PS}) as total_edges, (select count(*) from orders join customer on c_custkey = o_custkey) as total_properties, (select count(*) from (select c_nationkey from customer union select s_nationkey from supplier)) as documents")
def graph_totals(spark, d):
    return report.totals(shop.graph(spark, d))


@query(f"select 'e' || l_partkey || '_' || l_suppkey as id from {_PS} join part on p_partkey = l_partkey where p_brand = 'Brand#2'")
def induced_subgraph(spark, d):
    t = shop.graph(spark, d)
    nodes = t.nodes.where("description = 'Brand#2' or description = 'supplier'")
    return community.induced_edges(t.edges, nodes).select("id")


_MEMBER = "(select 's' || s_suppkey as node_id, 'n' || s_nationkey as community from supplier union all select 'p' || p_partkey, p_brand from part)"


def _membership(t):
    return t.nodes.where("level = 0 and (description = 'supplier' or community_id is null)").select(F.col("id").alias("node_id"), F.coalesce("community_id", "description").alias("community"))


@query(f"select 'e' || l_partkey || '_' || l_suppkey as edge_id, p_brand as frm, 'n' || s_nationkey as to from {_PS} join part on p_partkey = l_partkey".replace(" as to ", ' as "to" '))
def community_edges(spark, d):
    t = shop.graph(spark, d)
    return community.community_edges(t.edges, _membership(t))


@query(f"select community, count(*) as n from (select distinct community, l_partkey, l_suppkey from {_PS} join {_MEMBER} on node_id in ('p' || l_partkey, 's' || l_suppkey)) group by 1".replace("on node_id in ('p' || l_partkey, 's' || l_suppkey)", "on node_id = 'p' || l_partkey union select distinct community, l_partkey, l_suppkey from " + _PS + " join " + _MEMBER + " on node_id = 's' || l_suppkey"))
def edges_touching_community(spark, d):
    t = shop.graph(spark, d)
    return community.edges_touching(t.edges, _membership(t)).groupBy("community").agg(F.count("*").alias("n"))


@query(f"select community as name, count(*) as children from {_MEMBER} group by 1")
def community_rollup(spark, d):
    t = shop.graph(spark, d)
    m = _membership(t)
    found = m.select("community").distinct().select("community", F.col("community").alias("title"), F.lit("").alias("summary"), F.array(F.lit("found")).alias("findings"))
    nodes, _, children, _ = community.rollup(m, found)
    return children.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children")).join(nodes.select("id", "name"), "id").select("name", "children")


@query()
def communities(spark, d):
    t = shop.graph(spark, d)
    return community.communities(t.nodes.where("level = 0").select("id"), t.edges)


@query("select 'n' || n_nationkey as id, string_agg('d' || n_nationkey, ',') as document_ids from nation where n_nationkey in (select c_nationkey from customer union select s_nationkey from supplier) group by 1 union all select 'r' || n_regionkey, string_agg('d' || n_nationkey, ',' order by 'd' || n_nationkey) from nation where n_nationkey in (select c_nationkey from customer union select s_nationkey from supplier) group by 1")
def doc_id_descent(spark, d):
    t = shop.graph(spark, d)
    return index.document_of(t.nodes, t.node_children).join(t.nodes.where("level > 0").select("id"), "id", "left_semi").select("id", F.array_join("document_ids", ",").alias("document_ids"))


_LOG = "(select event_id as seq, event_id // 6 as id, case event_type when 'signup' then 'create' when 'error' then 'delete' else 'update' end as action, event_type as type, (event_id % 3)::int as level from events)"


def _log(spark, d):
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 6).alias("id"), action.alias("action"), F.col("event_type").alias("type"), (F.col("event_id") % 3).cast("int").alias("level"), F.array().cast("array<string>").alias("attributes"))


_COMPACT = f"(select id, arg_min(type, seq) as type, arg_min(level, seq) as level, not bool_or(action = 'delete') as to_create, not bool_or(action = 'create') as to_delete from {_LOG} group by id)"


@query(f"select * from {_COMPACT}")
def changelog_compaction(spark, d):
    return index.compacted(_log(spark, d))


@query(f"select 'insert' as what, c.id, c.level, o_orderpriority as text from {_COMPACT} c join orders on o_orderkey = c.id where to_create union all select 'delete', id, null, null from {_COMPACT} where to_delete")
def sync_delta(spark, d):
    texts = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.lit("property").alias("type"), F.lit(None).cast("string").alias("document_id"), F.array().cast("array<string>").alias("document_ids"))
    insert, delete = index.sync_delta(_log(spark, d), texts)
    return insert.select(F.lit("insert").alias("what"), "id", "level", "text").unionByName(delete.select(F.lit("delete").alias("what"), "id", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text")))


@query(f"""select type, action, count(*) as n from (select 'node' as type, 'delete' as action, s_suppkey as x from supplier where s_acctbal < 0
union all select 'edge', 'delete', l_partkey from {_PS} where l_suppkey in (select s_suppkey from supplier where s_acctbal < 0)
union all select distinct 'node', 'update', l_partkey from {_PS} where l_suppkey in (select s_suppkey from supplier where s_acctbal < 0)) group by 1, 2
union all select 'edge', 'left', count(*) from {_PS} where l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)""")
def delete_node_cascade(spark, d):
    t = shop.graph(spark, d)
    poor = table(spark, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    after = graphstore.delete_nodes(t, poor)
    return after.change_log.groupBy("type", "action").agg(F.count("*").alias("n")).unionByName(after.edges.agg(F.lit("edge").alias("type"), F.lit("left").alias("action"), F.count("*").alias("n")))


_ALONE = f"(select l_partkey from {_PS} group by 1 having count(distinct s_nationkey) = 1 and max(s_nationkey) = 3)"


@query(f"""select 'nodes' as what, (select count(*) from customer where c_nationkey <> 3) + (select count(*) from supplier where s_nationkey <> 3) + (select count(*) from part where p_partkey not in {_ALONE}) as n
union all select 'edges', count(*) from {_PS} where s_nationkey <> 3 and l_partkey not in {_ALONE}
union all select 'properties', count(*) from orders join customer on c_custkey = o_custkey where c_nationkey <> 3
union all select 'mentions', 0""")
def delete_document(spark, d):
    t = graphstore.delete_document(shop.graph(spark, d), "d3")
    count = lambda df, n: df.agg(F.lit(n).alias("what"), F.count("*").alias("n"))
    level0 = t.nodes.where("level = 0")
    mentions = level0.where(F.exists("metadata", lambda m: m["document_id"] == "d3"))
    return count(level0, "nodes").unionByName(count(t.edges, "edges")).unionByName(count(t.properties, "properties")).unionByName(count(mentions, "mentions"))


@query("select tag, case when tag in ('lang', 'source') then 'str' else 'int' end as type, count(*) as count from (select 'lang' as tag from documents where lang is not null union all select 'source' from documents where source is not null union all select 'quality' from documents join labels using (doc_id) where quality is not null union all select 'toxic' from documents join labels using (doc_id) where toxic is not null) group by 1")
def tag_registry(spark, d):
    return graphstore.tag_registry(shop.documents_with_tags(spark, d))


@query("select doc_id::varchar as id from documents join labels using (doc_id) where lang = 'en' and quality = 1")
def tag_filter(spark, d):
    return graphstore.filter_by_tags(shop.documents_with_tags(spark, d), {"lang": "en", "quality": "1"}).select("id")


@query("select doc_id::varchar as id from documents left join labels using (doc_id) where lang = 'en' and (quality = 1 or quality is null)")
def tag_filter_ignore_missing(spark, d):
    return graphstore.filter_by_tags(shop.documents_with_tags(spark, d), {"lang": "en", "quality": "1"}, ignore_missing=True).select("id")


@query(f"select 'c' || c_custkey as id, 'node' as type, lower(c_name) as parents from customer union all select 's' || s_suppkey, 'node', lower(s_name) from supplier union all select 'e' || l_partkey || '_' || l_suppkey, 'edge', lower(s_name) || '|' || lower(p_name) from {_PS} join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey union all select 'o' || o_orderkey, 'property', lower(c_name) from orders join customer on c_custkey = o_custkey union all select 'none' || r_regionkey, 'node', '' from region")
def search_enrich(spark, d):
    t = shop.graph(spark, d)
    kind = lambda df, k: df.select("id", F.lit(k).alias("type"))
    people = t.nodes.where("level = 0 and (description = 'supplier' or id like 'c%')")
    lost = table(spark, d, "region").select(F.concat(F.lit("none"), "r_regionkey").alias("id"), F.lit("node").alias("type"))
    hits = kind(people, "node").unionByName(kind(t.edges, "edge")).unionByName(kind(t.properties, "property")).unionByName(lost)
    return search.enriched(hits, t).select("id", "type", F.array_join("parent_nodes", "|").alias("parents"))


@query("select r_name as name, string_agg(n_name, chr(10) order by n_nationkey) || chr(10) as context from nation join region on r_regionkey = n_regionkey group by 1")
def context_concat(spark, d):
    hits = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), F.col("n_nationkey").alias("rank"), F.col("n_name").alias("text"))
    return search.context(hits, by=["name"])


_NODE_TEXTS = (
    "select 'r' || r_regionkey as id, r_name as name, '' as text, 2 as level, 0 as edges from region union all select 'n' || n_nationkey, n_name, '', 1, 0 from nation"
    " union all select 'c' || c_custkey, lower(c_name), c_mktsegment, 0, 0 from customer"
    f" union all select 's' || s_suppkey, lower(s_name), 'supplier', 0, coalesce(n, 0) from supplier left join (select l_suppkey, count(*) as n from {_PS} group by 1) on l_suppkey = s_suppkey"
    f" union all select 'p' || p_partkey, lower(p_name), p_brand, 0, coalesce(n, 0) from part left join (select l_partkey, count(*) as n from {_PS} group by 1) on l_partkey = p_partkey"
)


@query(
    f"select id, 'node' as type, name || ', ' || text as text from ({_NODE_TEXTS})"
    " union all select 'e' || l_partkey || '_' || l_suppkey, 'edge', max(l_returnflag) from lineitem join supplier on s_suppkey = l_suppkey group by 1"
    " union all select 'o' || o_orderkey, 'property', lower(c_name) || ', ' || o_orderpriority from orders join customer on c_custkey = o_custkey"
)
def object_texts(spark, d):
    t = shop.graph(spark, d)
    return index.object_texts(t.nodes, t.edges, t.properties, t.node_children).select("id", "type", "text")


@query(f"select id, name, level, edges::bigint as edges from ({_NODE_TEXTS})")
def node_views(spark, d):
    full = graphstore.node_view(shop.graph(spark, d), "full")
    return full.select("id", "name", "level", F.coalesce(F.size("edge_ids"), F.lit(0)).cast("long").alias("edges"))


def _upserted(spark, d):
    """Suppliers are there; every other one comes again with a new description, and all customers are new."""
    t = shop.graph(spark, d)
    there = t.nodes.where("id like 's%'")
    again = there.where(F.substring("id", 2, 20).cast("long") % 2 == 0).withColumn("description", F.lit("changed"))
    return graphstore.put_nodes(replace(graphstore.Tables.new(spark), nodes=there), again.unionByName(t.nodes.where("id like 'c%'")))


@query("select 's' || s_suppkey as id, case when s_suppkey % 2 = 0 then 'changed' else 'supplier' end as description from supplier union all select 'c' || c_custkey, c_mktsegment from customer")
def node_upsert(spark, d):
    return _upserted(spark, d).nodes.select("id", "description")


@query("select 's' || s_suppkey as id, 'update' as action, 'node' as type from supplier where s_suppkey % 2 = 0 union all select 'c' || c_custkey, 'create', 'node' from customer")
def node_upsert_log(spark, d):
    return _upserted(spark, d).change_log.select("id", "action", "type")


# --- layout and visuals


def _tokens(spark, d):
    """Events as layout tokens: a user is a document, an event type ends a paragraph."""
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").alias("idx"), F.col("event_type").alias("content"), F.upper("event_type").alias("type"), (F.col("event_type") != "error").cast("int").alias("joined"), F.col("value").alias("left"), F.col("value").alias("top"), (F.col("value") + 1).alias("right"), (F.col("value") + 1).alias("bottom"), F.lit(100).alias("page_width"), F.lit(100).alias("page_height"))


_ISLANDS = "(select *, sum(case when coalesce(before, 'error') = 'error' then 1 else 0 end) over (partition by user_id order by event_id) as paragraph from (select *, lag(event_type) over (partition by user_id order by event_id) as before from events))"


@query(f"select user_id::varchar as doc_id, paragraph::bigint as paragraph, string_agg(event_type, ' ' order by event_id) as text, round(min(value), 9) as \"left\", round(max(value) + 1, 9) as \"right\" from {_ISLANDS} group by 1, 2")
def layout_islands(spark, d):
    s = layout.segments(layout.islands(_tokens(spark, d)))
    return s.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "text", F.round("left", 9).alias("left"), F.round(F.col("left") + F.col("width"), 9).alias("right"))


@query(f"select user_id::varchar as doc_id, paragraph::bigint as paragraph, upper(arg_max(event_type, (n, -first))) as type from (select user_id, paragraph, event_type, count(*) as n, min(event_id) as first from {_ISLANDS} group by all) group by 1, 2")
def layout_mode(spark, d):
    return layout.segments(layout.islands(_tokens(spark, d))).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "type")


@query("select user_id::varchar as doc_id, event_id as idx, length(event_type)::bigint as length, (lead(length(event_type)) over w)::bigint as next_length, round(lead(value) over w - (value + 1), 9) as gap_right from events window w as (partition by user_id order by event_id)")
def layout_pairs(spark, d):
    t = _tokens(spark, d).withColumns({"font_id": F.lit("f"), "font_size": F.lit(10.0), "bold": F.lit(False), "italic": F.lit(False), "color": F.lit("#000000")})
    return layout.pair_features(t).select("doc_id", "idx", F.col("length").cast("long").alias("length"), F.col("next_length").cast("long").alias("next_length"), F.round("gap_right", 9).alias("gap_right"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, round(least(l_quantity, l_discount * 100), 6) as x0, round(greatest(l_quantity, l_discount * 100), 6) as x1, round(100.0 * greatest(0, least(greatest(l_quantity, l_discount * 100), 25.0) - least(l_quantity, l_discount * 100)) / nullif(greatest(l_quantity, l_discount * 100) - least(l_quantity, l_discount * 100), 0), 4) as covered from lineitem where abs(l_quantity - l_discount * 100) > 0.001 and least(l_quantity, l_discount * 100) < 25")
def bounding_boxes(spark, d):
    polygon = F.array(F.col("l_quantity"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("l_discount") * 100, F.lit(1.0))
    own = table(spark, d, "lineitem").withColumn("box", multimodal.bounding_box(polygon)).where("abs(l_quantity - l_discount * 100) > 0.001 and least(l_quantity, l_discount * 100) < 25")
    own = own.withColumns({"a_left": F.least(F.col("box")[0], F.col("box")[2]), "a_right": F.greatest(F.col("box")[0], F.col("box")[2]), "a_top": F.lit(0.0), "a_bottom": F.lit(1.0), "b_left": F.lit(0.0), "b_right": F.lit(25.0), "b_top": F.lit(0.0), "b_bottom": F.lit(1.0)})
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.round("a_left", 6).alias("x0"), F.round("a_right", 6).alias("x1"), F.round(layout.overlap_percent("a_", "b_"), 4).alias("covered"))


@query("select e.user_id::varchar as doc_id, e.event_id as idx, round(coalesce(max(m.value + 1) + min(m.value) - 2 * (e.value + 1), e.below - (e.value + 1)), 6) as gap from (select *, lead(value) over (partition by user_id order by event_id) as below from events) e left join events m on m.user_id = e.user_id and m.value >= e.value + 1 and m.value < e.below where below is not null group by e.user_id, e.event_id, e.value, e.below")
def layout_gap(spark, d):
    return layout.gap_without_between(_tokens(spark, d)).select("doc_id", "idx", F.round("gap", 6).alias("gap"))


_LINES = "(select a.user_id, a.event_id, a.value, coalesce(max(b.value + 1) filter (b.value + 1 < a.value + 1), 0) as left_of, coalesce(min(b.value) filter (b.value < a.value), 0) as left_most, coalesce(min(b.value) filter (b.value > a.value), 0) as right_of, coalesce(max(b.value + 1) filter (b.value > a.value), 0) as right_most from events a left join events b on b.user_id = a.user_id and b.event_id <> a.event_id and ((a.value <= b.value and b.value < a.value + 1) or (a.value < b.value + 1 and b.value + 1 <= a.value + 1)) group by 1, 2, 3)"


@query(f"select user_id::varchar as doc_id, event_id as idx, round(greatest(value + 1, right_most), 6) as line_right, round(right_of - (value + 1), 6) as right_gap, round(lead(value - left_of) over w, 6) as next_left_gap, round(lead(value) over w - (value + 1), 6) as top_distance, round(abs(greatest(value + 1, right_most) - lead(greatest(value + 1, right_most)) over w), 6) as line_end_change, round(least(value, left_most) - lead(least(value, left_most)) over w, 6) as line_start_change from {_LINES} window w as (partition by user_id order by event_id) qualify lead(value) over w is not null")
def layout_positions(spark, d):
    names = ("line_right", "right_gap", "next_left_gap", "top_distance", "line_end_change", "line_start_change")
    return layout.position_features(_tokens(spark, d)).select("doc_id", "idx", *(F.round(n, 6).alias(n) for n in names))


@query("select doc_id, l as line_space, r as \"right\", f as font_size from (select user_id::varchar as doc_id, 10.0::double as f, arg_max(x, (n, -x)) as r from (select user_id, round(value + 1, 2) as x, count(*) as n from events group by all) group by user_id) left join (select user_id::varchar as doc_id, arg_max(x, (n, -x)) as l from (select user_id, round(below - (value + 1), 2) as x, count(*) as n from (select *, lead(value) over (partition by user_id order by event_id) as below from events) where below is not null group by all) group by user_id) using (doc_id)")
def layout_modes(spark, d):
    return layout.document_modes(_tokens(spark, d).withColumn("font_size", F.lit(10.0)))


@query("select r_name as name, '| key | nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) order by n_nationkey) as grid from nation join region on r_regionkey = n_regionkey group by 1")
def markdown_table(spark, d):
    own = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    cell = lambda r, c, v: F.struct(r.cast("int").alias("row_index"), F.lit(c).alias("column_index"), v.cast("string").alias("content"))
    head = F.array(cell(F.lit(0), 0, F.lit("key")), cell(F.lit(0), 1, F.lit("nation")))
    body = F.flatten(F.transform("x", lambda v, i: F.array(cell(i + 1, 0, v["n_nationkey"]), cell(i + 1, 1, v["n_name"]))))
    return own.select(F.col("r_name").alias("name"), multimodal.markdown_table(F.size("x") + 1, F.lit(2), F.concat(head, body)).alias("grid"))


@query()
def retrieval(spark, d):
    return flagship(spark, d)


@query()
def embedding_topk(spark, d):
    """The nearest other document of each benchmark item, by hashed embeddings."""
    e = HashedEmbedder(64)
    docs = index.embedded(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), e)
    items = index.embedded(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), e).select("query_id", F.col("embedding").alias("query"))
    return index.nearest_batch(docs, items, 3)


@query("select item_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')), ['the', 'nation', 'and', 'order', 'of', 'that'])) / 6.0::double as score from benchmark")
def rerank_items(spark, d):
    """Overlap scores of benchmark items with the fixed question of the flagship query."""
    score = search.score_column(F.lit("the nation and the order of that"), F.col("text"), OverlapReranker())
    return table(spark, d, "benchmark").select("item_id", score.alias("score"))
