"""DuckDB SQL of the text queries that SQL can express."""

import re

from .quality_rules import LEAST_DOCS, RATES, REACH
from .secret_scan import ADDED, BASE, KINDS, MOST_OWNERS, MOST_REPOSITORIES, PLACEHOLDERS

MIX = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight,
             row_number() over (order by source nulls last) as place from d group by source),
r as (select *, sum(source_size) over ()::bigint as total,
             coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as filled,
             sum(weight) over (o rows between current row and unbounded following)::bigint as open
      from s window o as (order by source_size::double / weight, place)),
f as (select *, 3 * source_size * open < (total - filled) * weight as is_full from r),
c as (select *, coalesce(sum(case when is_full then 3 * source_size end) over (), 0)::bigint as gone,
             coalesce(sum(case when not is_full then weight end) over (), 0)::bigint as share from f),
t as (select *, case when is_full then (3 * source_size)::double else ((total - gone) * weight)::double / share end as target,
             case when is_full then 3 * source_size else (total - gone) * weight // share end as whole,
             case when is_full then 0 else (total - gone) * weight % share end as over_ from c),
u as (select *, total - sum(whole) over () as extra, row_number() over (order by over_ desc, place) as turn from t),
n as (select source, source_size, target, whole + case when over_ > 0 and turn <= extra then 1 else 0 end as demand from u),
k as (select d.*, n.source_size, n.target, n.demand,
             sum(d.size) over (partition by d.source order by md5('42:' || d.doc_id), d.doc_id rows between unbounded preceding and current row) - d.size as before
      from d join n on d.source is not distinct from n.source)
select doc_id, size, source_size, target,
       (case when source_size = 0 then 0 else demand // source_size * size + greatest(0, least(size, demand % source_size - before)) end)::bigint as taken
from k
"""

DECONTAMINATION = r"""
with low(kind, id, text) as (
  select 0, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from documents
  union all select 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
w as (select kind, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from low),
p as (select id as item_id, least(10, len(ws)) as n, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from w where kind = 1 and len(ws) > 0),
phrase as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as g from p),
place as (select id as doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select distinct n from phrase) where kind = 0 and len(ws) >= n),
hit as (select doc_id, i, n, item_id from (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as g from place) join phrase using (n, g)),
word as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hit) group by doc_id),
item as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id)
select id as doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join word on word.doc_id = id left join item on item.doc_id = id where kind = 0
"""

SUBSTRINGS = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w)),
late as (select doc_id, i from (select *, min(doc_id) over (partition by g) as least_id from win) where least_id < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from late),
tok as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from tok anti join gone using (doc_id, i) group by doc_id),
n as (select doc_id, count(*) as n_removed from gone group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from w left join n using (doc_id) left join kept using (doc_id)
"""


def _quality_rules() -> str:
    rates = "\nunion all ".join(f"select lang, source, '{r}' as rate, {r} as v from s where not base_failed" for r in RATES)
    low = ", ".join(f"max(case when rate = '{r}' then {f'q1 - {REACH} * greatest(q3 - q1, {least})' if two_sided else 0} end) as {r}_low, "
                    f"max(case when rate = '{r}' then q3 + {REACH} * greatest(q3 - q1, {least}) end) as {r}_high"
                    for r, (two_sided, least) in RATES.items())
    inside = " and ".join(f"{r} between (case when o.total >= {LEAST_DOCS} then o.{r}_low when g.total >= {LEAST_DOCS} then g.{r}_low else a.{r}_low end) "
                          f"and (case when o.total >= {LEAST_DOCS} then o.{r}_high when g.total >= {LEAST_DOCS} then g.{r}_high else a.{r}_high end)"
                          for r in RATES)
    return rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
tok as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d),
tri as (select doc_id, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g from tok window o as (partition by doc_id order by i)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from tri where g is not null) where c > 1),
cov as (select doc_id, count(distinct i + k) as n_repeat_words from rep, range(3) as r(k) group by doc_id),
lin as (select doc_id, unnest(string_split(text, chr(10))) as l from d),
dup as (select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from lin
        where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
c as (select doc_id, lang, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0)::bigint as n_lines
      from d left join dup using (doc_id) left join cov using (doc_id)),
s as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             coalesce(100 * word_chars // nullif(n_words, 0), 0) as word_length, coalesce(1000 * n_symbols // nullif(n_words, 0), 0) as symbol_rate,
             coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) as duplicate_line_rate,
             coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) as repeat_rate from c),
v as ({rates}),
b as (select lang, source, rate, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) as bin from v),
k as (select lang, source, rate, bin, count(*) as n, grouping(lang) * 2 + grouping(source) as level
      from b group by grouping sets ((lang, source, rate, bin), (lang, rate, bin), (rate, bin))),
u as (select *, sum(n) over (partition by level, lang, source, rate order by bin) as upto, sum(n) over (partition by level, lang, source, rate) as total from k),
q as (select level, lang, source, rate, min(case when upto * 4 >= total then bin end) as q1, min(case when upto * 4 >= total * 3 then bin end) as q3,
             max(total) as total from u group by level, lang, source, rate),
f as (select level, lang, source, max(total) as total, {low} from q group by level, lang, source)
select s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({inside}, true) as kept
from s left join f o on o.level = 0 and s.lang is not distinct from o.lang and s.source is not distinct from o.source
left join f g on g.level = 1 and s.lang is not distinct from g.lang left join f a on a.level = 3
"""


def _secrets() -> str:
    """Matches of each kind from the gaps before them: a lazy gap and the pattern, over and over, place every match."""
    parts = []
    for number, (kind, (pattern, group, *least)) in enumerate({**BASE, **ADDED}.items()):
        head, bar, tail = pattern.partition(")")
        either = re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + bar + tail  # (?i) would take letters beyond ASCII
        p = {"assign": either, "hex": "[0-9a-f]{24,}"}.get(kind, pattern).replace("'", "''")
        n_gap = f"(?s:(.*?))({p})"
        parts.append(rf"""
select row, source, doc_id, {number} as kind, u.gap, u.hit, u.i, regexp_extract(u.hit, '^(?:{p})', {group}) as value, {least[0] if least else 0} as least
from (select row, source, doc_id, unnest(list_zip(regexp_extract_all(text, '{n_gap}', 1), regexp_extract_all(text, '{n_gap}', 2), range(1, 1 + len(regexp_extract_all(text, '{n_gap}', 1))))) as z from d) t,
lateral (select z[1] as gap, z[2] as hit, z[3] as i) u""")
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    bad = " or ".join(f"contains(lower(value), '{p}')" for p in PLACEHOLDERS)
    n_base, opaque = len(BASE), KINDS.index("opaque")
    return rf"""
with d as (select row_number() over () as row, doc_id, source, coalesce(text, '') as text from documents),
raw as ({" union all ".join(parts)}),
pos as (select *, sum(length(gap) + length(hit)) over (partition by row, kind order by i) as stop from raw),
every as (select row, source, doc_id, kind, (stop - length(hit))::bigint as start, stop::bigint as stop, value from pos where length(value) >= least),
m as (select * from every where kind < {n_base} or not exists (
        select 1 from every b where b.row = every.row and b.kind < case when every.kind = {opaque} then {opaque} else {n_base} end
                                and b.start < every.stop and every.start < b.stop)),
own as (select value, count(distinct coalesce('=' || source, '')) as n_owners, count(distinct coalesce('=' || doc_id, '')) as n_repositories from m group by value),
j as (select m.*, n_owners > {MOST_OWNERS} or n_repositories > {MOST_REPOSITORIES} as copied,
             not ({bad}) and len(list_distinct(string_split(value, ''))) >= least(10, length(value) * 2 // 3)
             and (kind <> {opaque} or regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[0-9]')) as live
      from m join own using (value)),
s as (select *, kind < {n_base} as base, kind >= {n_base} and live and not copied as added,
        {names}[kind + 1] || ':' || start || ':' || stop as span from j),
g as (select row, count_if(kind = 0) as n_assign, count_if(kind = 1) as n_access, count_if(kind = 2) as n_hex,
             string_agg(span, ',' order by start, kind) filter (where base) as base, string_agg(span, ',' order by start, kind) filter (where base or added) as spans,
             count_if(copied) as n_copied, count_if(live and not copied) as n_specific from s group by row)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_copied, 0)::bigint as n_copied, coalesce(n_specific, 0)::bigint as n_specific
from d left join g using (row)
"""


PERIODIC_RUNS = r"""
with recursive bits(v, c, k) as (select i, i, 0 from range(256) r(i) union all
  select v, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc_table as (select v, c::bigint as c from bits where k = 8),
crc(doc_id, s, i, c) as (select distinct doc_id, doc_id::varchar, 0, 4294967295::bigint from documents where doc_id is not null union all
  select doc_id, s, i + 1, xor(crc.c >> 8, t.c) from crc join crc_table t on t.v = xor(crc.c, ord(substr(s, i + 1, 1))) & 255 where i < length(s)),
h as (select doc_id, xor(c, 4294967295) as h from crc where i = length(s)),
d as (select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as ws from documents),
p as (select d.*, len(ws) as n, coalesce(h.h % 10 = 0, false) and len(ws) > 0 as hit, h.h // 10 as g from d left join h using (doc_id)),
q as (select *, case when hit then g % n else 0 end as a, case when hit then 1 + (n - g % n) // (3 + g % 8) else 1 end as period from p),
w as (select row, i, case when hit and i >= a then ws[1 + a + (i - a) % period] else ws[1 + i] end as w
      from (select row, ws, hit, a, period, unnest(range(n)) as i from q)),
e as (select x.row, x.i, y.i - x.i as d from w x join w y on x.row = y.row and x.w = y.w and x.i < y.i),
f as (select row, d, min(i) as start, count(*) + d as length
      from (select *, i - row_number() over (partition by row, d order by i) as k from e) group by row, d, k),
r as (select row, start, length, min(d) as period from f where length >= greatest(12, 2 * d) group by row, start, length),
gone as (select distinct row, unnest(range(start + period, start + length)) as i from r),
kept as (select row, string_agg(w, ' ' order by i) as text from w anti join gone using (row, i) group by row),
b as (select row, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs,
             first({'start': start, 'length': length, 'period': period} order by length desc, start, period) as l from r group by row)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, l.start::bigint as start, l.length::bigint as length, l.period::bigint as period,
       (1000 * l.length // l.period)::bigint as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
from d left join b using (row) left join kept using (row)
"""


ORACLES = {"op1_decontamination": DECONTAMINATION, "op5_substring_dedup": SUBSTRINGS, "op8_quality_rules": _quality_rules(), "op10_mix": MIX,
           "op11_secrets": _secrets(), "op13_periodic_runs": PERIODIC_RUNS}
