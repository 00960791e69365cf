"""DuckDB twins of the queries that SQL can express; plain joins, no filters of the operators' kind but a prefix for lines."""

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select item_id, least(10, len(w)) as n, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as s from bw),
lengths as (select distinct n from windows),
dw as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, lengths where len(w) >= n),
hits as (select doc_id, item_id, i, dw.n from dw join windows on windows.n = dw.n and s = array_to_string(w[i : i + dw.n - 1], ' ')),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct coalesce('i' || item_id::varchar, '')) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""

OP2 = """
with l as (select doc_id, i - 1 as line_no, list_distinct(list_filter(string_split(lower(ls[i]), ' '), lambda x: x <> '')) as w, len(list_filter(string_split(ls[i], ' '), lambda x: x <> '')) as n_words
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))),
e as (select * from l where n_words >= 1),
sets as (select list_sort(w) as w, min((doc_id, line_no)) as first, row_number() over () as k from e group by list_sort(w)),
tokens as (select k, unnest(w) as t, len(w) as n from sets),
df as (select t, count(*) as c from tokens group by t),
ranked as (select k, t, n, row_number() over (partition by k order by c, t) as r from tokens join df using (t)),
prefix as (select k, t, n from ranked where r <= n - ceil(0.8 * n) + 1),
pairs as (select distinct a.k as a, b.k as b from prefix a join prefix b on a.t = b.t and a.k < b.k and least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4),
alike as (select x.first as fa, y.first as fb, a, b from pairs join sets x on x.k = a join sets y on y.k = b where len(list_intersect(x.w, y.w)) * 9 >= (len(x.w) + len(y.w)) * 4),
gone as (select distinct case when fa < fb then b else a end as k from alike),
kept as (select first from sets where k not in (select k from gone)),
removed as (select doc_id, line_no from e where (doc_id, line_no) not in (select first from kept))
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(ids, '') as removed from documents d
left join (select doc_id, count(*) as n_removed, string_agg(line_no::varchar, ',' order by line_no) as ids from removed group by doc_id) using (doc_id)
left join (select doc_id, count(*) as n_lines from e group by doc_id) using (doc_id)"""

OP10 = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 3], chr(32)) as g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
half as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
links as (select a, b from half union all select b, a from half),
reach(a, b) as (select a, b from links union select reach.a, links.b from reach join links on links.a = reach.b),
least_ as (select a as doc_id, min(b) as m from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id from d left join n using (doc_id) left join least_ using (doc_id)"""

OP12 = """
with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end::bigint as label, list_transform(embedding, lambda c: floor(256 * c::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.id as a, b.id as b, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as s from v a join v b on a.id % 100 = 0 and a.id <> b.id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by s.s desc, s.b)::int as rank, s.b as negative_id, p.s as positive_score, s.s as negative_score
from p join s on s.a = p.a and not same and 30 * p.s <= 100 * s.s and 100 * s.s <= 90 * p.s
qualify row_number() over (partition by p.a, p.b order by s.s desc, s.b) <= 10"""

ORACLES = {"op1_decontamination": OP1, "op2_line_dedup": OP2, "op2_line_dedup_whole": OP2, "op10_ngram_join": OP10, "op12_hard_negatives": OP12}
