"""DuckDB counterparts of the queries that SQL can express.

op2, op3, op5, op6, op7, op8 and the pipeline depend on trained models, seeded
hashes or rank merges, or are too slow in SQL; tests hold them against brute
force instead.
"""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"

#: All pairs of documents that share a run of five words, and what their links reach.
OP1 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
sh as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as s from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select x, y from common join n p on p.doc_id = x join n q on q.doc_id = y where c / (p.n + q.n - c) >= 0.8),
reach as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y),
class as (select doc_id, least(doc_id, coalesce(min(y), doc_id)) as class_id from documents left join reach on x = doc_id group by doc_id)
select doc_id, class_id, count(*) over (partition by class_id) as class_size, doc_id = class_id as kept from class
"""

OP9 = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y),
c as (select vec_id, least(vec_id, coalesce(min(y), vec_id)) as component_id from v left join reach on x = vec_id group by vec_id),
d as (select vec_id, count(y) as n_links from v left join links on x = vec_id group by vec_id)
select vec_id, n_links, component_id, vec_id = component_id as kept from c join d using (vec_id)
"""

OP4 = rf"""
with t as (
  select doc_id, length(coalesce(text, '')) as len,
         sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) as text_sha256
  from documents),
g as (
  select text_sha256, count(*) as group_size, arg_min(doc_id, (-len, doc_id)) as keep_id
  from t group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from t join g using (text_sha256)
"""

OP10 = r"""
with p as (
  select page_id, coalesce(url, '') as u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
c as (
  select *, concat(regexp_replace(host, '^(www|m)\.', ''), regexp_replace(path, '(\.html?)?/*$', '')) as canonical from p),
listed as (select distinct canonical from c where regexp_matches(u, '[?&]utm_source=') and canonical <> ''),
r as (
  select c.*, case
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/'
  end as rule from c)
select page_id, host, path, rule,
       case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
            when l.canonical is not null then 'block' else 'allow' end as verdict,
       rule is null and l.canonical is not null as listed
from r left join listed l on l.canonical = r.canonical
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc32(text: str) -> str:
    """CRC-32 of a string of code points below U+0800, bit by bit: -1 stands for a shift, other numbers are bytes."""
    byte = f"flatten(list_transform(string_split({text}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [192 + (unicode(c)::bigint >> 6), 128 + (unicode(c)::bigint & 63)] end))"
    steps = f"list_prepend(4294967295::bigint, flatten(list_transform({byte}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda c, b: case when b >= 0 then xor(c, b) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295)"


OP11 = rf"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as r
  from conversations where conv_id is not null),
s as (select conv_id, list(struct_pack(role := role, text := text) order by r) as own from t group by conv_id),
h as (select conv_id, conv_id - conv_id % 5 as base, {_crc32("conv_id::varchar")} % 9 as h, own from s),
c as (select a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) as seq from h a left join h b on b.conv_id = a.base),
p as (select conv_id, seq, unnest(range(0, len(seq) + 1)) as depth from c),
n as (
  select seq[1:depth] as k, depth, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(seq) = depth), '')) as ends_sha256
  from p group by all),
kids as (select k[1:depth - 1] as k, count(*) as n_children from n where depth > 0 group by all),
m as (
  select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * octet_length(encode(n.k[depth].text)) end as own
  from n left join kids on kids.k = n.k),
up as (
  select k[1:a] as k, count(*) filter (where n_children = 0) as n_leaves, sum(own)::bigint as saved_tokens
  from (select k, n_children, own, unnest(range(0, depth + 1)) as a from m) group by all)
select m.conv_id, m.depth, f.conv_id as parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
from m join up on up.k = m.k left join m f on m.depth > 0 and f.k = m.k[1:m.depth - 1]
"""

#: Near words have a text with one gap in common, or one is the other without a letter.
OP12 = rf"""
with recursive r as (select doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-z\x{{C0}}-\x{{FF}}]+')) as w from documents),
g as (select coalesce(doc_id::varchar, '') as i, w, count(*) as k from r where length(w) >= 6 group by all),
h as (select w, k, {_crc32("i || ':' || w")} as h from g),
c as (select k, case when h % 199 = 0 then left(w, h % length(w)) || substr(w, h % length(w) + 2) else w end as word from h),
v as (select word, sum(k)::bigint as n from c where length(word) >= 6 group by word having sum(k) >= 5),
cut as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
gap as (select word, n, left(word, i - 1) || '*' || substr(word, i + 1) as g from cut),
del as (select distinct word, n, left(word, i - 1) || substr(word, i + 1) as d from cut),
one as (select x.word as a, x.n as an, y.word as b, y.n as bn from gap x join gap y on x.g = y.g and x.word <> y.word),
two as (select x.word as a, x.n as an, y.word as b, y.n as bn from del x join v y on x.d = y.word),
near as (select a, an, b, bn from one union select a, an, b, bn from two union select b, bn, a, an from two),
best as (select a, count(*) as n_near, arg_min(b, (-bn, b)) as form, max(bn) as form_n from near group by a),
f as (
  select word, n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * n then form end as form, case when form_n >= 5 * n then form_n end as form_n
  from v left join best on a = word),
chain as (
  select word, word as now, 0 as step from f
  union all select chain.word, f.form, step + 1 from chain join f on f.word = chain.now where f.form is not null),
root as (select word, arg_max(now, step) as root from chain group by word)
select word, form, root, n, n_near, form_n from f join root using (word)
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13 = rf"""
with d as (select row_number() over () as uid, doc_id, {_WORDS.format(_LOWER.format('text'))} as w from documents),
i as (select item_id::varchar as item, {_WORDS.format(_LOWER.format('text'))} as w from benchmark),
win as (select distinct item, least(len(w), 10) as l, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda k: array_to_string(w[k:k + 9], ' '))) as win from i where len(w) > 0),
lens as (select distinct l from win),
occ as (select uid, l, unnest(list_transform(range(1, len(w) - l + 2), lambda k: struct_pack(k := k, win := array_to_string(w[k:k + l - 1], ' ')))) as o from d join lens on l <= len(w)),
hit as (select uid, l, o.k as k, o.win as win from occ where o.win in (select win from win)),
hits as (select uid, count(distinct place) as n_hit from (select uid, unnest(range(k, k + l)) as place from hit) group by uid),
items as (select uid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct uid, item from hit join win using (win) where item is not null) group by uid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join hits using (uid) left join items using (uid)
"""

ORACLE_SQL = {"op1_minhash_near_dedup": OP1, "op9_nn_descent": OP9, "op4_exact_dedup": OP4, "op10_url_filter": OP10, "op11_prefix_trie": OP11, "op12_spelling_variants": OP12, "op13_decontamination": OP13}
