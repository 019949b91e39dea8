"""SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

import re

from weftline.llm import chat, secrets, urlfilter

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DECONTAMINATION = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
cut as (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from i where len(w) > 0),
win as (select distinct item_id, k, w[s : s + k - 1] as words from cut),
sizes as (select distinct k from win),
dw as (select rid, k, s, w[s : s + k - 1] as words from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as s from d, sizes where len(w) >= k)),
occ as (select rid, s, dw.k, item_id from dw join win on dw.words = win.words and dw.k = win.k),
hits as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + k)) as p from occ) group by rid),
found as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item_id::varchar as item from occ) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (rid) left join found using (rid)"""

_CONTROL = "|".join(f"{re.escape(c[0])}{chat.MARK}*{re.escape(c[1:])}" for c in chat.CONTROL)

_ROLE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"

CHAT = f"""
with rows as (select conv_id, turn, role, text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(length('<|im_start|>' || {_ROLE} || chr(10) || text || '<|im_end|>' || chr(10)) + len(regexp_extract_all({_ROLE}, {_quoted(_CONTROL)})) + len(regexp_extract_all(text, {_quoted(_CONTROL)})))::bigint as formatted_chars,
  0::bigint as n_attachments, 0::bigint as attachment_tokens
from t group by conv_id"""

TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings),
s as (select q.vec_id as query_id, v.vec_id as vec_id, list_dot_product(q.e, v.e)::bigint as score from v as q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""

NEAR_DUPLICATES = rf"""
with recursive w as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from sh as a join sh as b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from p join n as x on x.doc_id = u join n as y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, root) as (select doc_id, doc_id from documents union select v, root from r join links on u = r.doc_id)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(root) as component_id, min(root) = doc_id as kept from r left join n using (doc_id) group by doc_id"""


def _spans(rule: secrets.Rule, rank: int) -> str:
    pattern = _quoted(rule.pattern)
    return f"""select rid, {rank} as rank, '{rule.kind}' as kind, list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) as s, length(m[i]) as n
  from (select rid, p, m, g, unnest(range(1, len(m) + 1)) as i from (select rid, string_split_regex(t, {pattern}) as p, regexp_extract_all(t, {pattern}) as m, regexp_extract_all(t, {pattern}, {rule.group}) as g from d))
  where length(g[i]) >= {rule.least}"""


SECRET_SCAN = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
x as ({" union all ".join(_spans(r, k) for k, r in enumerate(secrets.RULES))}),
y as (select rid, {", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)},
  string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, rank) filter (rank < {len(secrets.BASE)}) as base,
  string_agg(kind || ':' || s::bigint || ':' || (s + n)::bigint, ',' order by s, rank) as spans from x group by rid)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join y using (rid)"""


def url_rules(rules: tuple[urlfilter.Rule, ...]) -> str:
    """Hosts, paths and the longest rule that fits each URL."""
    ranked = sorted(rules, key=lambda r: (-len(r.pattern), -len(r.host)))
    fits = [f"when (host = {_quoted(r.host)} or ends_with(host, {_quoted('.' + r.host)})) and starts_with(path, {_quoted(r.path)})" for r in ranked]
    pick = lambda of: "case " + " ".join(f"{f} then {_quoted(of(r))}" for f, r in zip(fits, ranked, strict=True)) + " end"
    return f"""
with s as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from s),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h)
select page_id, host, path, {pick(lambda r: r.pattern)} as rule, {pick(lambda r: r.verdict)} as rule_verdict from p"""
