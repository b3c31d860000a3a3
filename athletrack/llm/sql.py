"""Queries of this subpackage in SQL, where SQL can say them and runs over whole tables."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEARDUP = rf"""
with recursive w as (select doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as sh from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) as i from w where len(w) > 0) t),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as u, b.doc_id as v, count(*) as common from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select u, v from i join n x on x.doc_id = u join n y on y.doc_id = v where 100 * common >= 85 * (x.n + y.n - common)),
b as (select u, v from e union all select v as u, u as v from e),
r as (select distinct u as node, u as reach from b union select r.node, b.v from r join b on b.u = r.reach),
c as (select node, min(reach) as c from r group by node)
select w.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, w.doc_id) as component_id, w.doc_id = coalesce(c, w.doc_id) as kept
from w left join n on n.doc_id = w.doc_id left join c on c.node = w.doc_id
"""

_ESCAPED = r"regexp_replace({}, '(\\|###|</turn>)', '\\\1', 'g')"
_ROLE = r"regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')"

CHAT = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
 cast(sum(4 + length({_ROLE}) + 2 + length({_ESCAPED.format('text')}) + 8) as bigint) as formatted_chars
from c group by conv_id
"""

_TERMS = rf"coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATION = rf"""
with d as (select doc_id, {_TERMS} as w from documents), q as (select item_id, {_TERMS} as w from benchmark),
p as (select item_id, n, list_slice(w, i, i + n - 1) as phrase from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from q where len(w) > 0) t),
k as (select doc_id, n, i, list_slice(w, i, i + n - 1) as phrase from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from p) l where len(w) >= n) t),
m as (select doc_id, i, k.n, item_id from k join p on p.n = k.n and p.phrase = k.phrase),
h as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from m) t group by doc_id),
o as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from m) t group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join h on h.doc_id = d.doc_id left join o on o.doc_id = d.doc_id
"""

RULES = rf"""
with d as (select doc_id, source as host, coalesce(text, '') as text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
k as (select doc_id, i, count(*) over (partition by doc_id, win) as n from (select doc_id, i, list_slice(w, i, i + 7) as win from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8) t) u),
r as (select doc_id, count(distinct pos) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as pos from k where n > 1) t group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from d) t where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select d.doc_id, host, len(w) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
 from d left join r on r.doc_id = d.doc_id left join l on l.doc_id = d.doc_id),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m),
g as (select host, cast(count(*) as double) as n_docs, cast(count(case when base_failed then 1 end) as double) as n_failed from f group by host),
s as (select sum(n_failed) / sum(n_docs) as mean, var_samp(n_failed / n_docs) as spread, avg(1 / n_docs) as inverse from g),
b as (select mean, greatest(least(coalesce(case when spread - mean * (1 - mean) * inverse > 0 then mean * (1 - mean) / (spread - mean * (1 - mean) * inverse) - 1 else 10000 end, 10000), 10000), 2) as weight from s),
v as (select host, (n_failed + mean * weight) / (n_docs + weight) as shrunk from g, b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and shrunk <= 0.5 as kept, f.host, round(shrunk, 9) as host_rate
from f join v on f.host is not distinct from v.host
"""

_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_VALUE = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

MERKLE = f"""
with recursive l as (select doc_id, lang, {_LEAF.format(n='n_chars')} as leaf, case when {_CRC} % 7 = 0 then {_LEAF.format(n='(n_chars + 1)')} end as claimed from documents),
g as (select lang, row_number() over (order by encode(lang) nulls first) - 1 as tree from (select distinct lang from l) q),
p as (select doc_id, leaf, claimed, tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from l join g on g.lang is not distinct from l.lang),
t as (select tree, 0 as level, pos as idx, leaf as h, n from p union all select tree, level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (n + 1) // 2 from t where n > 1 group by tree, level, idx // 2, n),
r as (select tree, h as subroot from t where n = 1),
u as (select 0 as level, tree as idx, subroot as h, count(*) over () as n from r union all select level + 1, idx // 2, sha256(string_agg(h, '' order by idx)), (n + 1) // 2 from u where n > 1 group by level, idx // 2, n),
a as (select tree, level, idx, h, n, 0 as up from t union all select x.tree, 1000 + u.level, u.idx, u.h, u.n, 1 from u, r x),
path as (select p.tree, p.pos, a.level, a.h, a.idx & 1 as lft, a.n, a.idx from p join a on a.tree = p.tree and a.idx = xor(case when a.up = 0 then p.pos else p.tree end >> (a.level % 1000), 1)),
f as (select p.tree, p.pos, coalesce(claimed, leaf) as h, 0 as level, n from p
 union all select f.tree, f.pos, case when s.h is null then sha256(f.h) when s.lft = 1 then sha256(f.h || s.h) else sha256(s.h || f.h) end, f.level + 1, (f.n + 1) // 2 from f left join path s on s.tree = f.tree and s.pos = f.pos and s.level = f.level where f.n > 1),
v as (select tree, pos, h, 1000 as level, (select count(*) from r) as n from f where n = 1
 union all select v.tree, v.pos, case when s.h is null then sha256(v.h) when s.lft = 1 then sha256(v.h || s.h) else sha256(s.h || v.h) end, v.level + 1, (v.n + 1) // 2 from v left join path s on s.tree = v.tree and s.pos = v.pos and s.level = v.level where v.n > 1),
d as (select p.tree, p.pos, sha256(coalesce(string_agg(path.h, '' order by path.level), '')) as proof_sha256 from p left join path on path.tree = p.tree and path.pos = p.pos group by p.tree, p.pos)
select p.doc_id, p.leaf, r.subroot, u.h as root, d.proof_sha256, v.h as folded_root, v.h = u.h as verified
from p join r on r.tree = p.tree join u on u.n = 1 join d on d.tree = p.tree and d.pos = p.pos join v on v.tree = p.tree and v.pos = p.pos and v.n = 1
"""

ORACLES = {"op1_neardup": NEARDUP, "op2_chat": CHAT, "op6_decontamination": DECONTAMINATION, "op8_rules": RULES, "op12_merkle": MERKLE}
