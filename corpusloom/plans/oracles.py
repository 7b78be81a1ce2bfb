"""DuckDB SQL for the queries of the catalogue: written from the definitions, over the same tables."""

from __future__ import annotations

from corpusloom.operators.sampler import permutation_sql

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_DIGIT = r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"
_TERMS = "escort|eskort|porno|sikis|casino|rulet|viagra|cialis|bahis|iddaa|bonus veren|deneme bonusu|bedava bonus|guvenilir site|giris adresi|canli mac izle|takipci satin al|slot oyun|betting"
_STEMS = "sex|seks|gay|kumar|bet|bets|porn|kacak|jigolo|sohbet hatti"
_FOLD = "strip_accents(lower(replace(replace({}, 'İ', 'i'), 'I', 'i')))"
_NORM = rf"regexp_replace(lower({_strip('text')}), '[{_WS}]+', ' ', 'g')"
_WORDS = f"list_filter(string_split({_NORM}, ' '), lambda w: w <> '')"
_LINES = rf"list_filter(list_transform(regexp_split_to_array(t, '{_END}'), lambda s: {_strip('s')}), lambda s: s <> '')"


def _judged(min_length: int = 200, min_turkish: float = 0.005) -> str:
    return rf"""
t0 as (select *, {_strip('text')} as t from documents),
t1 as (select *, length(t) as n, {_FOLD.format('t')} as folded, {_LINES} as lines from t0),
judged as (select * exclude (t, n, folded, lines), t, case
    when n < {min_length} then 'short'
    when regexp_matches(folded, '{_TERMS}') then 'spam_term'
    when regexp_matches(folded, '(^|[^\p{{L}}\p{{N}}_])({_STEMS})($|[^\p{{L}}\p{{N}}_])') then 'spam_stem'
    when (n - length(regexp_replace(t, '[{_DIGIT}]', '', 'g'))) / n > 0.15 then 'digits'
    when (n - length(regexp_replace(t, '[çğıöşüÇĞİÖŞÜ]', '', 'g'))) / n < {min_turkish} then 'turkish'
    when len(lines) > 4 and len(list_distinct(lines)) / len(lines) < 0.5 then 'repeats'
  end as reason from t1)"""


_HASH = "('0x' || substr(md5({}), 1, 16))::ubigint"
_SIGNED = "(case when {0} >= 9223372036854775808 then ({0}::hugeint - 18446744073709551616)::bigint else {0}::bigint end)"
_SIGS = f"""
ws as (select doc_id, unnest(list_slice({_WORDS}, 1, 200)) as w from documents),
wh as (select doc_id, {_HASH.format('w')} as h from ws),
bits as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then 1 else -1 end) as vote from wh, range(64) as r(b) group by doc_id, b),
sims as (select doc_id, sum(case when vote > 0 then (1::hugeint << b::int) else 0 end)::ubigint as sig from bits group by doc_id),
sigs as (select doc_id, {_HASH.format(_NORM)} as "full", coalesce(sig, 0::ubigint) as sig from documents left join sims using (doc_id) where {_strip('text')} <> '')"""


def _pass(i: int, k: int) -> str:
    rot = "sig" if k == 0 else f"((sig >> {k}) | ((sig & {(1 << k) - 1}::ubigint) << {64 - k}))"
    return f"""
p{i} as (select *, {rot} as r from a{i}),
q{i} as (select *, coalesce(not dead and not lag(dead) over o and bit_count(xor(sig, lag(sig) over o)) <= 8, false) as edge,
         lag(doc_id) over o as pid, lead(doc_id) over o as nid, row_number() over o as rn from p{i} window o as (order by r, doc_id)),
s{i} as (select *, coalesce(lead(edge) over (order by rn), false) and nid < doc_id as nd,
         sum(case when edge and pid < doc_id then 0 else 1 end) over (order by rn) as run from q{i}),
a{i + 1} as (select doc_id, sig, dead or coalesce(nd, false) or (row_number() over (partition by run order by rn) - 1) % 2 = 1 as dead from s{i})"""


_FLAGS = f"""
{_SIGS},
firsts as (select *, min(doc_id) over (partition by "full") as first_id from sigs),
a0 as (select doc_id, sig, false as dead from firsts where doc_id = first_id),
{','.join(_pass(i, 16 * i) for i in range(4))},
flags as (select f.doc_id, f.doc_id <> f.first_id as exact_dup, coalesce(a4.dead, false) as near_dup from firsts f left join a4 using (doc_id))"""

_MIX_BASE = f"""
{_judged(100, 0.0)},
src as (select doc_id, case lang when 'en' then 0 when 'fr' then 1 when 'de' then 2 end as source_id, reason from judged where lang in ('en', 'fr', 'de')),
good as (select doc_id, source_id, row_number() over (partition by source_id order by doc_id) - 1 as k,
         case source_id when 0 then 70 when 1 then 20 else 10 end as p from src where reason is null),
placed as (select *, k // p as r, row_number() over (order by k // p, source_id, k) - 1 as mix_pos from good)"""

#: Three quarters of the accepted documents, so that the source of the greatest weight runs dry.
_TARGET = "(select greatest(1, count(*) * 3 // 4) from good)"

_TOK = f"""
tk as (select doc_id, list_concat(list_transform({_WORDS}, lambda w: (length(w) % 997 + 3)::int), [2]) as tokens from documents),
placed as (select doc_id, tokens, len(tokens) as n, (coalesce(sum(len(tokens)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0))::bigint as off from tk),
tot as (select sum(n)::bigint as n from placed),
flat as (select off + i - 1 as pos, tokens[i] as tok from placed, range(1, n + 1) as g(i))"""

_LOGITS = "logits as (select vec_id as step_id, (i - 1)::int as token_id, embedding[i]::double as logit from embeddings, range(1, 65) as g(i))"
_PENAL = "pen as (select step_id, token_id, case when (step_id + token_id) % 3 <> 0 then logit when logit > 0 then logit / 1.3 else logit * 1.3 end as logit from logits)"


def _soft(source: str, expr: str = "logit") -> str:
    return f"sm as (select step_id, token_id, exp({expr} - max({expr}) over w) / sum(exp({expr} - mx)) over w as p from (select *, max({expr}) over (partition by step_id) as mx from {source}) window w as (partition by step_id))"


_NUCLEUS = "np as (select *, coalesce(sum(p) over (partition by step_id order by p desc, token_id rows between unbounded preceding and 1 preceding), 0) as b from sm), kept as (select step_id, token_id, p / sum(p) over (partition by step_id) as p from np where b <= 0.9)"

_PLAN = """
c as (select source, count(*) as n from documents where source is not null group by source),
s as (select (row_number() over (order by source) - 1)::int as source_id, source || '/part' as label, n::double as weight, n, sum(n) over () as total from c),
p as (select *, greatest(1, round_even(weight / total * 100, 0))::int as quota, greatest(1, floor((total // 2) * weight / total))::bigint as target, greatest(1, least(round_even(40 * weight / total, 0)::int, 6))::int as workers from s)"""

ORACLE_SQL: dict[str, str] = {
    "quality_report": f"with {_judged()} select source, count(*) filter (reason is null) as written, count(*) filter (reason is not null) as rejected, round(count(*) filter (reason is not null) / greatest(1, count(*)) * 100, 6) as rejected_pct from judged group by source",
    "quality_pass_docs": f"with {_judged()} select doc_id, md5(t) as text_md5 from judged where reason is null",
    "reject_reason": f"with {_judged()} select doc_id, reason from judged",
    "unfiltered_docs": f"select source, count(*) filter (length({_strip('text')}) >= 50) as written, count(*) filter (length({_strip('text')}) < 50) as rejected from documents group by source",
    "text_stats": rf"""with t0 as (select doc_id, text, {_strip('text')} as t from documents)
        select doc_id, length(t) as chars, length(t) - length(regexp_replace(t, '[{_DIGIT}]', '', 'g')) as digits, length(t) - length(regexp_replace(t, '[çğıöşüÇĞİÖŞÜ]', '', 'g')) as turkish,
        len({_WORDS})::bigint as words, len({_LINES})::bigint as lines, len(list_distinct({_LINES}))::bigint as distinct_lines, strlen(t) as bytes from t0""",
    "folded_text": f"select doc_id, md5({_FOLD.format('text')}) as folded_md5 from documents",
    "collapse_blank_lines": r"select doc_id, md5(regexp_replace(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n[ \t]*\n+', chr(10), 'g')) as text_md5 from documents",
    "exact_dedup_keep": f"select doc_id, min(doc_id) over (partition by {_NORM}) as first_id from documents",
    "simhash_signature": f"""with {_SIGS} select doc_id, {_SIGNED.format('"full"')} as "full", {_SIGNED.format('sig')} as sig from sigs""",
    "near_dup_flags": f"with {_FLAGS} select * from flags",
    "dedup_summary": f"with {_FLAGS} select count(*) as docs, count(*) filter (exact_dup) as exact_dups, round(count(*) filter (exact_dup) / nullif(count(*), 0) * 100, 6) as exact_pct, count(*) filter (near_dup) as near_dups, round(count(*) filter (near_dup) / nullif(count(*), 0) * 100, 6) as near_pct, count(*) filter (not exact_dup and not near_dup) as kept, round(count(*) filter (not exact_dup and not near_dup) / nullif(count(*), 0) * 100, 6) as kept_pct from flags",
    "dedup_corpus": f"with {_FLAGS} select doc_id, md5(text) as text_md5 from documents join flags using (doc_id) where not exact_dup and not near_dup",
    "mix_serial": f"with {_MIX_BASE} select doc_id, source_id::int as source_id, k, mix_pos from placed where mix_pos < {_TARGET}",
    "mix_parallel": f"with {_MIX_BASE} select doc_id, source_id::int as source_id, k, mix_pos from placed where r <= coalesce((select r from placed where mix_pos = {_TARGET} - 1), (select max(r) from placed))",
    "mix_reject_counts": f"""with {_MIX_BASE},
        goal as (select {_TARGET} as target),
        acc as (select source_id, max(p) as p, count(*) as a, count(*) filter (mix_pos < (select target from goal)) as taken from good join placed using (doc_id, source_id, k, p) group by source_id),
        dry as (select a.source_id, a.taken, (select count(*) from placed q where (q.r, q.source_id, q.k) < (a.a // a.p, a.source_id, a.a)) < (select target from goal) as dry from acc a),
        ranked as (select *, count(*) filter (reason is null) over (partition by source_id order by doc_id rows between unbounded preceding and 1 preceding) as before from src)
        select r.source_id::int as source_id, count(*) filter (reason is null and before < taken) as written, count(*) filter (reason is not null and (dry or before < taken)) as rejected, bool_and(dry) as dry
        from ranked r join dry using (source_id) group by r.source_id""",
    "worker_limited_docs": f"with {_MIX_BASE}, w as (select doc_id, (doc_id % 8)::int as worker, row_number() over (partition by doc_id % 8 order by doc_id) - 1 as k from good) select * from w where k < {_TARGET} // 8 + 1",
    "source_plan": f"""with {_PLAN} select source_id, label, weight, quota, target, workers, (target // workers + 1)::bigint as worker_limit from p""",
    "shard_lists": f"""with {_PLAN}, l as (select source_id, workers, unnest(range(8, n)) as shard from p) select source_id, ((shard - 8) % workers)::int as worker, shard::int as shard from l""",
    "shard_assignment": "select doc_id, (doc_id % 30)::int as shard, case when doc_id % 30 >= 8 then (doc_id % 30 % 8)::int end as worker from documents",
    "prefix_sample": "with b as (select doc_id, strlen(coalesce(text, '')) as bytes, coalesce(sum(strlen(coalesce(text, '')) + 2) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from documents) select doc_id, bytes, start from b where start + bytes + 2 <= 1000000",
    "word_frequency": f"with w as (select unnest({_WORDS}) as word from documents) select word, count(*) as n from w group by word having count(*) >= 2",
    "token_lookup": f"""with w as (select doc_id, unnest({_WORDS}) as word from documents), c as (select word, count(*) as n from w where word not in ('<eos>', '<pad>') group by word),
        v as (select word, row_number() over (order by n desc, word) + 1 as id from c order by n desc, word limit 200)
        select doc_id, count(*) as words, count(*) filter (id is null) as unknown, coalesce(sum(id), 0)::bigint as id_sum from w left join v using (word) group by doc_id""",
    "pair_frequency": f"with w as (select unnest({_WORDS}) as word from documents), c as (select word, count(*) as n from w group by word), i as (select n, word, unnest(range(1, length(word))) as i from c), p as (select n, substr(word, i, 2) as pair from i) select pair, sum(n)::bigint as n from p group by pair having sum(n) >= 2",
    "token_offsets": f"with {_TOK} select doc_id, n, off from placed",
    "token_windows": f"""with {_TOK}, w as (select pos // 64 as win, pos % 64 as i, tok from flat), nw as (select case when n - 65 >= 0 then (n - 65) // 64 + 1 else 1 end as c from tot),
        x as (select win, string_agg(tok::varchar, ' ' order by i) as x from w group by win), y as (select (pos - 1) // 64 as win, string_agg(tok::varchar, ' ' order by pos) as y from flat where pos > 0 group by 1)
        select win, x, y from x join y using (win) where win < (select c from nw)""",
    "overlapping_windows": f"""with {_TOK}, c as (select (n - 33) // 8 + 1 as c from tot), p as (select pos, tok, pos // 8 - k as win from flat, range(5) as g(k))
        select win, sum(tok) filter (pos < win * 8 + 32)::bigint as sum_x, max(tok) filter (pos = win * 8 + 32)::bigint as last_y from p where win >= 0 and win < (select c from c) and pos <= win * 8 + 32 group by win""",
    "next_token_pairs": f"with {_TOK}, nw as (select (n - 65) // 64 + 1 as c from tot), p as (select pos, tok, lead(tok) over (order by pos) as next_tok from flat) select tok, next_tok, count(*) as n from p where pos < 64 * (select c from nw) group by tok, next_tok",
    "split_train_val": f"""with {_TOK}, s as (select floor(n * (1 - 0.1::double))::bigint as cutpos, n as total from tot),
        c as (select 'train' as part, 0 as a, cutpos as b from s union all select 'val', cutpos, total from s)
        select part, doc_id, greatest(off, a) - a as off, least(off + n, b) - greatest(off, a) as n from placed, c where off < b and off + n > a""",
    "resume_skip": f"""with {_TOK}, nw as (select (n - 65) // 64 + 1 as c from tot), st as (select c, ceil(ceil(c / 8) / 4)::bigint as per from nw), w as (select i from range((select c from st)) as g(i)),
        p as {permutation_sql("i", "(select c from nw)", 42, 1)} select y as win, i as rank from p where i >= (select (per // 3) * 32 from st)""",
    "replica_samples": f"""with {_TOK}, nw as (select (n - 65) // 64 + 1 as c from tot), w as (select i from range((select c // 3 * 3 from nw)) as g(i)),
        p as {permutation_sql("i", "(select c from nw)", 42, 0)} select i // 3 as rank, y as win, (i % 3)::int as replica from p""",
    "token_store": f"""with {_TOK}, third as (select n // 3 as third from tot), p as (select pos - third as pos, tok from flat, third where pos >= third and pos < 2 * third)
        select pos // 1000 as part, count(*) as n, sum(tok)::bigint as tok_sum, sum(tok * (pos % 1000))::bigint as place_sum from p group by 1""",
    "arrivals_dedup": f"""with k as (select doc_id, (doc_id % 3)::int as arrival, {_NORM} as key from documents)
        select doc_id, arrival, first_value(doc_id) over w as first_id, first_value(arrival) over w as first_arrival from k window w as (partition by key order by arrival, doc_id)""",
    "corpus_files": rf"""with t as (select (doc_id % 2)::int as file_no, {_strip(r"regexp_replace(coalesce(text, ''), '\n[ \t]*\n+', chr(10), 'g')")} as t from documents)
        select file_no, md5(t) as text_md5, count(*) as n from t where t <> '' group by all""",
    "worker_files": "select doc_id, (doc_id % 30)::int as shard, (doc_id % 30 % 8)::int as worker from documents where doc_id % 30 >= 8",
    "pulled_docs": f"""with {_MIX_BASE}, lim as (select source_id, (select count(*) // 4 from good) * p // 100 + 1 as most from (select distinct source_id, p from good))
        select doc_id, source_id::int as source_id, k from good join lim using (source_id) where k < most""",
    "decoded_docs": "select doc_id, md5(coalesce(text, '')) as text_md5 from documents",
    "prepared_corpus": f"""with {_MIX_BASE}, mixdocs as (select doc_id, source_id, mix_pos, t as text from placed join judged using (doc_id) where mix_pos < {_TARGET}),
        {_FLAGS.replace('from documents', 'from (select mix_pos as doc_id, text from mixdocs)')}
        select m.source_id::int as source_id, m.doc_id as id, m.mix_pos, md5(m.text) as text_md5 from mixdocs m join flags f on f.doc_id = m.mix_pos where not exact_dup and not near_dup""",
    "byte_pair_frequency": f"""with w as (select unnest({_WORDS}) as word from documents), c as (select ' ' || word as word, count(*) as n from w group by 1),
        b as (select n, unnest(list_zip(range(1, len(x)), range(2, len(x) + 1))) as i, x from (select n, string_split_regex(rtrim(regexp_replace(hex(encode(word)), '(..)', '\\1 ', 'g')), ' ') as x from c)),
        v as (select list_concat(range(33, 127), range(161, 173), range(174, 256)) as v), t as (select list_concat(v, list_filter(range(256), lambda k: not list_contains(v, k))) as t, len(v) as m from v),
        s as (select list_transform(range(256), lambda k: case when list_position(t, k) <= m then chr(k::int) else chr((255 + list_position(t, k) - m)::int) end) as s from t),
        p as (select n, s[('0x' || x[i[1]])::int + 1] || s[('0x' || x[i[2]])::int + 1] as pair from b, s)
        select pair, sum(n)::bigint as n from p group by pair having sum(n) >= 2""",
    "lr_schedule": f"""with {_TOK}, nw as (select (n - 65) // 64 + 1 as c from tot), st as (select (3 * ceil(ceil(c / 8) / 4))::bigint as total from nw), w as (select total, greatest(1, floor(0.02 * total))::bigint as warm from st),
        s as (select unnest(range(total)) as s, total, warm from w)
        select s as step, round(case when s < warm then (s + 1) / warm else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (s - warm) / greatest(1, total - warm)))) end, 6) as mult from s""",
    "layer_placement": """with m as (select distinct p_size::bigint as old from part where p_size > 0), n as (select old as model, old, old + (old + 1) // 2 as "new" from m), i as (select model, old, "new", unnest(range(old)) as s from n),
        want as (select model, s, round_even(s * ("new" - 1) / greatest(1, old - 1), 0)::bigint as want from i), p as (select model, s, s + max(want - s) over (partition by model order by s) as layer from want),
        every as (select model, unnest(range("new")) as layer from n) select model, layer, coalesce(s, -1) as source from every left join p using (model, layer)""",
    "rope_table": f"with n as (select max(len({_WORDS})) as n from documents), a as (select unnest(range(n)) as pos from n) select pos, i, round(cos(pos * power(10000.0::double, -(i * 2.0) / 32)), 6) as cos, round(sin(pos * power(10000.0::double, -(i * 2.0) / 32)), 6) as sin from a, range(16) as b(i)",
    "running_best": "with e as (select event_id % 50 as step, round(avg(value), 6) as loss from events group by 1) select step, loss, coalesce(loss < min(loss) over (order by step rows between unbounded preceding and 1 preceding), true) as improved, min(loss) over (order by step) as best from e",
    "rep_penalty": f"with {_LOGITS}, {_PENAL} select step_id, token_id, round(logit / 0.8::double, 6) as logit from pen",
    "top_k_ties": f"with {_LOGITS}, r as (select step_id, token_id, round(logit, 1) as logit from logits), k as (select *, rank() over (partition by step_id order by logit desc) as rk from r) select step_id, token_id, logit from k where rk <= 5",
    "softmax": f"with {_LOGITS}, {_soft('logits')} select step_id, token_id, round(p, 6) as p from sm",
    "top_p_nucleus": f"with {_LOGITS}, {_soft('logits', '(logit / 0.05::double)')}, {_NUCLEUS} select step_id, token_id, round(p, 6) as p from kept",
    "next_token_distribution": f"with {_LOGITS}, {_PENAL}, tk as (select step_id, token_id, logit / 0.1::double as logit, rank() over (partition by step_id order by logit / 0.1::double desc) as rk from pen), cut as (select * from tk where rk <= 20), {_soft('cut')}, {_NUCLEUS} select step_id, token_id, round(p, 6) as p from kept",
    "masked_ce": f"with {_LOGITS}, l as (select step_id, ln(sum(exp(logit - mx))) + max(mx) - max(logit) filter (token_id = step_id % 7) as loss from (select *, max(logit) over (partition by step_id) as mx from logits) group by step_id) select count(*) as n, round(avg(loss), 6) as loss from l where step_id % 7 <> 1",
    "eval_loss": f"with {_LOGITS}, l as (select step_id, ln(sum(exp(logit - mx))) + max(mx) - max(logit) filter (token_id = step_id % 7) as loss from (select *, max(logit) over (partition by step_id) as mx from logits) group by step_id), b as (select step_id // 8 as batch, avg(loss) as loss from l where step_id % 7 <> 1 group by 1 order by 1 limit 16) select count(*) as batches, round(coalesce(sum(loss), 0) / greatest(1, count(*)), 6) as loss from b",
    "pool_mean": "with g as (select label as seq_id, (i - 1)::int as i, embedding[i]::double as x, vec_id % 5 <> 0 as m from embeddings, range(1, 65) as r(i)) select seq_id, i, round(coalesce(sum(x) filter (m), 0) / greatest(count(*) filter (m), 1e-9), 6) as v from g group by seq_id, i",
    "pool_last": "with h as (select vec_id // 8 as seq_id, vec_id % 8 as pos, embedding, (vec_id % 8 < (vec_id / 8) % 8)::int as mask from embeddings), n as (select seq_id, greatest(sum(mask) - 1, 0) as lastpos from h group by seq_id) select h.seq_id, (i - 1)::int as i, round(embedding[i]::double, 6) as v from h join n on h.seq_id = n.seq_id and h.pos = n.lastpos, range(1, 65) as r(i)",
    "l2_normalize": "with n as (select vec_id, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 1e-12) as l from embeddings) select vec_id, (i - 1)::int as i, round(embedding[i]::double / l, 6) as v from n, range(1, 65) as r(i)",
    "dot_self": "with n as (select vec_id, list_sum(list_transform(embedding, lambda x: x::double * x::double)) as d from embeddings) select vec_id, round(d, 6) as dot, round(sqrt(d), 6) as norm, case when d > 0 then 1.0::double else 0.0::double end as self_similarity from n",
    "layer_norm": "with g as (select vec_id, (i - 1)::int as i, embedding[i]::double as x from embeddings, range(1, 65) as r(i)), z as (select vec_id, i, (x - avg(x) over w) / sqrt(var_pop(x) over w + 1e-5) as v from g window w as (partition by vec_id)) select vec_id, i, round(v, 6) as v, round(0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715 * v * v * v))), 6) as gelu from z",
    "rope_apply": "with g as (select vec_id, i, embedding[i + 1]::double as a, embedding[i + 33]::double as b, (vec_id % 128) * power(10000.0::double, -(i * 2.0) / 64) as t from embeddings, range(32) as r(i)) select vec_id, i::int as i, round(a * cos(t) - b * sin(t), 6) as v from g union all select vec_id, (i + 32)::int, round(a * sin(t) + b * cos(t), 6) from g",
    "context_slices": f"""with {_TOK}, c as (select doc_id, tokens, doc_id // 32 as batch, list_slice(tokens, 1, 24) as cut from placed), m as (select batch, max(len(cut)) as longest from c group by batch)
        select doc_id, list_sum(list_slice(tokens, 1, 16))::bigint as left_sum, list_sum(list_slice(tokens, greatest(len(tokens) - 15, 1), len(tokens)))::bigint as right_sum, (list_sum(cut) + longest - len(cut))::bigint as padded_sum, len(cut)::bigint as mask_sum, longest::bigint as padded_len from c join m using (batch)""",
}
