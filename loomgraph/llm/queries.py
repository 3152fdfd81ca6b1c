"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .classlm import op5_class_lm
from .decontamination import op7_decontamination
from .linededup import op4_line_dedup
from .neardups import op8_ngram_jaccard
from .pii import op2_pii
from .quality import op9_quality
from .sentencepieces import op1_sentencepiece
from .sharding import op6_sharding
from .topk import op10_topk
from .toxicity import op3_toxicity

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_class_lm": op5_class_lm,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_quality": op9_quality,
    "op10_topk": op10_topk,
}

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_LINE_DEDUP = f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as part from documents where text is not null),
s as (select doc_id, part, line, list_sort(list_distinct({_WORDS.format('line')})) as w from l),
c as (select w, min((doc_id, part)) as first, len(w) as n from s where len(w) > 0 group by w),
t as (select first, n, unnest(w) as token from c),
later as (select distinct case when x.first > y.first then x.first else y.first end as first
  from t x join t y on x.token = y.token and x.first < y.first and x.n * 100 >= y.n * 80 and y.n * 100 >= x.n * 80
  group by x.first, y.first, x.n, y.n having count(*) * 100 >= 80 * (x.n + y.n - count(*))),
r as (select s.doc_id, s.part, s.line, coalesce(len(s.w) > 0 and (c.first <> (s.doc_id, s.part) or c.first in (select first from later)), false) as gone from s left join c using (w)),
d as (select doc_id, count(*) filter (gone) as n_removed, coalesce(string_agg(part, ',' order by part) filter (gone), '') as removed, coalesce(string_agg(line, chr(10) order by part) filter (not gone), '') as kept from r group by doc_id)
select doc_id, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed, sha256(coalesce(kept, '')) as text_sha256 from documents left join d using (doc_id)
"""

_DECONTAMINATION = f"""
with dw as (select doc_id, {_ALNUM.format('text')} as w from documents),
bw as (select item_id, {_ALNUM.format('text')} as w from benchmark),
win as (select distinct item_id, m, array_to_string(w[i:i + m - 1], ' ') as g from (select item_id, w, least(13, len(w)) as m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from bw where len(w) > 0)),
ms as (select distinct m from win),
pos as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') as g from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from dw cross join ms where len(w) >= m)),
occ as (select distinct doc_id, m, i, item_id from pos join win using (m, g)),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + m)) as j from occ) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from occ) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join hit using (doc_id) left join it using (doc_id)
"""

_NGRAM_JACCARD = f"""
with recursive a as (select doc_id, {_WORDS.format('text')} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as g from a),
t as (select doc_id, len(g) as n, unnest(g) as token from s),
links as materialized (select x.doc_id as x, y.doc_id as y from t x join t y on x.token = y.token and x.doc_id <> y.doc_id and x.n * 100 >= y.n * 60 and y.n * 100 >= x.n * 60
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 60 * (x.n + y.n - count(*))),
reach as (select doc_id as x, doc_id as y from s union select r.x, l.y from reach r join links l on r.y = l.x)
select doc_id, len(g)::bigint as n_shingles, coalesce(n_similar, 0) as n_similar, component_id from s
left join (select x as doc_id, count(*) as n_similar from links group by 1) using (doc_id) left join (select x as doc_id, min(y) as component_id from reach group by 1) using (doc_id)
"""

_TOPK = """
with e as (select vec_id, unnest(embedding)::double as c, generate_subscripts(embedding, 1) as i from embeddings
  where embedding is not null and vec_id not in (select vec_id from (select vec_id, unnest(embedding) as c from embeddings) where c is null or not isfinite(c))),
v as (select vec_id, i, floor(256 * c)::bigint as x from e),
p as (select q.vec_id as query_id, v.vec_id, sum(q.x * v.x)::bigint as score from v join v q using (i) where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id group by 1, 2)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 5
"""

ORACLES: dict[str, str] = {
    "op4_line_dedup": _LINE_DEDUP,
    "op7_decontamination": _DECONTAMINATION,
    "op8_ngram_jaccard": _NGRAM_JACCARD,
    "op10_topk": _TOPK,
}
