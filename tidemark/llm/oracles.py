"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_BREAK = "replace(replace(replace({0}, '\\', '\\\\'), '</turn>', '<\\/turn>'), '### ', '#\\## ')"

CHAT_TREE = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
),
sized as (select *, 14 + length(replace({_BREAK.format("role")}, ':', '\\:')) + length({_BREAK.format("text")}) as n from rows),
placed as (select *, cast(coalesce(sum(n) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0) as bigint) as pos from sized)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars,
  sha256(string_agg(cast(pos as varchar), ',' order by pos)) as positions_sha256,
  cast(sum(pos) as bigint) as ancestor_chars
from placed group by conv_id
"""

DECONTAMINATE = f"""
with items as (select coalesce(cast(item_id as varchar), 'null') as item, {_WORDS} as w from benchmark where text is not null),
wins as (
  select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select item, w, least(10, len(w)) as n, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)
),
docs as (select row_number() over () as rid, doc_id, case when text is null then [] else {_WORDS} end as w from documents),
sizes as (select distinct n from wins),
grams as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)
),
hits as (select g.rid, g.i, g.n, x.item from grams g join wins x on g.n = x.n and g.gram = x.gram),
covered as (select rid, count(distinct place) as n_hit from (select rid, unnest(range(i, i + n)) as place from hits) group by rid),
named as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from hits) group by rid)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(m.n_items, 0) as n_items,
  sha256(coalesce(m.items, '')) as items_sha256, c.n_hit is not null as contaminated
from docs d left join covered c using (rid) left join named m using (rid)
"""

NEAR = f"""
with items as (select coalesce(cast(item_id as varchar), 'null') as item, {_WORDS} as w from benchmark where text is not null),
wins as (
  select row_number() over () as win, item, list_distinct(w[i : i + 9]) as terms
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)
),
asked as (select win, len(terms) as n, unnest(terms) as term from wins),
docs as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents where text is not null),
spots as (select rid, generate_subscripts(w, 1) - 1 as place, unnest(w) as word from docs),
has as (select s.rid, a.win, a.n from (select distinct rid, word from spots) s join asked a on s.word = a.term group by all having count(*) = a.n),
there as (select h.rid, h.win, h.n, s.place, s.word from has h join asked a using (win) join spots s on s.rid = h.rid and s.word = a.term),
full_ones as (
  select x.rid, x.win, x.place as first, y.place as last from there x join there y on x.rid = y.rid and x.win = y.win and y.place between x.place and x.place + 19
  join there z on z.rid = x.rid and z.win = x.win and z.place between x.place and y.place group by x.rid, x.win, x.n, x.place, y.place having count(distinct z.word) = x.n
),
ends as (select rid, win, first, min(last) as last from full_ones group by 1, 2, 3),
shortest as (select rid, win, max(first) as first, last from ends group by rid, win, last),
stretches as (select distinct s.rid, w.item, s.first, s.last from shortest s join wins w using (win))
select d.doc_id, s.item as item_id, count(*) as n_near, cast(min(s.first) as bigint) as first, cast(min_by(s.last, s.first * 100 + s.last - s.first) as bigint) as last
from stretches s join docs d using (rid) group by s.rid, d.doc_id, s.item
"""

SUFFIX_DEDUP = """
with docs as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
wins as (select rid, i, md5_number(substr(h, 2 * i + 1, 400)) as k from (select rid, h, unnest(range(0, n - 199)) as i from docs where n >= 200)),
again as (select k from wins group by k having count(*) > 1),
hits as (select rid, i, lag(i) over (partition by rid order by i) as before from wins semi join again using (k)),
runs as (select rid, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by rid order by i) as run from hits),
gone as (select rid, run, min(i) as lo, max(i) + 200 as hi from runs group by rid, run),
gaps as (
  select rid, coalesce(lag(hi) over (partition by rid order by lo), 0) as a, lo as b from gone
  union all select rid, max(hi), null from gone group by rid
),
kept as (select g.rid, string_agg(substr(d.h, 2 * g.a + 1, 2 * (coalesce(g.b, d.n) - g.a)), '' order by g.a) as h from gaps g join docs d using (rid) group by g.rid),
sums as (select rid, sum(hi - lo) as n_removed, count(*) as n_spans from gone group by rid)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(s.n_removed, 0) as bigint) as n_removed, coalesce(s.n_spans, 0) as n_spans,
  sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
from docs d left join sums s using (rid) left join kept k using (rid)
"""
