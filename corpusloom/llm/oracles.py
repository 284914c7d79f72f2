"""DuckDB SQL with the same rows as the queries, written from their contracts.  For small tables: it joins and groups a row for each word."""

from __future__ import annotations

import re

from .license_scan import PHRASES, SEPARATORS, TEMPLATES, THRESHOLD
from .lm_scoring import SMOOTHING
from .quality_rules import LEAST_GROUP, SPREADS, STATISTICS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN, ALNUM = r"'[^\x20\x09-\x0D]+'", r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP1 = f"""
with d as (select doc_id, regexp_extract_all({LOW}, {PLAIN}) as ws, doc_id in (select doc_id from labels where quality = 1) as inside from documents),
t as (select doc_id, inside, unnest(range(1, len(ws) + 1)) as i, ws from d),
p as (select doc_id, inside, ws[i] as w, case when i = 1 then '' else ws[i - 1] end as v from t),
own_w as (select doc_id, w, count(*) as n from p group by all), own_v as (select doc_id, v, count(*) as n from p group by all), own_p as (select doc_id, v, w, count(*) as n from p group by all),
all_w as (select w, count(*) as b, count(*) filter (inside) as t from p group by all), all_v as (select v, count(*) as b, count(*) filter (inside) as t from p group by all),
all_p as (select v, w, count(*) as b, count(*) filter (inside) as t from p group by all),
total as (select (select count(*) from p) as b, (select count(*) from p where inside) as t, (select count(*) from all_w) as vocabulary),
c as (select p.doc_id, all_w.b - own_w.n as bw, all_v.b - own_v.n as bv, all_p.b - own_p.n as bp,
  all_w.t - case when inside then own_w.n else 0 end as tw, all_v.t - case when inside then own_v.n else 0 end as tv, all_p.t - case when inside then own_p.n else 0 end as tp
  from p join own_w using (doc_id, w) join own_v using (doc_id, v) join own_p using (doc_id, v, w) join all_w using (w) join all_v using (v) join all_p using (v, w)),
loss as (select doc_id, avg(-ln((tp + {SMOOTHING} * (tw + 1.0::double) / (total.t + vocabulary)) / (tv + {SMOOTHING}))) as target, avg(-ln((bp + {SMOOTHING} * (bw + 1.0::double) / (total.b + vocabulary)) / (bv + {SMOOTHING}))) as background from c, total group by doc_id)
select d.doc_id, len(ws)::bigint as n_tokens, round(coalesce(target, 0), 6)::double as target_loss, round(coalesce(background, 0), 6)::double as background_loss,
  round(coalesce(target - background, 0), 6)::double as score from d left join loss using (doc_id)
"""

OP3 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select doc_id, h, unnest(range(0, length(h) // 2)) as i from d),
g as (select doc_id, i, substr(h, 2 * i + 1, 2) as byte, case when 2 * i + 100 <= length(h) then md5(substr(h, 2 * i + 1, 100)) end as g from b),
f as (select doc_id, i, byte, coalesce(g is not null and min(doc_id) over (partition by g) < doc_id, false) as bad from g),
r as (select doc_id, i, byte, bool_or(bad) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from f),
s as (select doc_id, i, byte, gone, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as head from r),
k as (select doc_id, count(*) as n_bytes, count(*) filter (gone) as n_removed, count(*) filter (head) as n_spans, string_agg(byte, '' order by i) filter (not gone) as kept from s group by doc_id)
select d.doc_id, coalesce(n_bytes, 0)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join k using (doc_id)
"""

OP4 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {PLAIN}) as ws from documents),
b as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d),
g as (select doc_id, i, ws[i] as w, case when i + 49 <= len(ws) then md5(array_to_string(ws[i:i + 49], ' ')) end as g from b),
f as (select doc_id, i, w, coalesce(g is not null and min(doc_id) over (partition by g) < doc_id, false) as bad from g),
r as (select doc_id, i, w, bool_or(bad) over (partition by doc_id order by i rows between 49 preceding and current row) as gone from f),
k as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(w, ' ' order by i) filter (not gone) as kept from r group by doc_id)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""


def quality_sql() -> str:
    """The quantiles are exact, as the sketches are up to their size."""
    expressions = {k: re.sub(r"(\w+) / greatest", r"\1::double / greatest", e) for k, (e, _, _) in STATISTICS.items()}
    sketches = ", ".join(f"quantile_disc({k}, 0.5) filter (not base_failed) as m_{k}, quantile_disc({k}, {0.5 - side * 0.4!r}::double) filter (not base_failed) as q_{k}" for k, (_, side, _) in STATISTICS.items())
    pick = lambda c: f"case when mine.n >= {LEAST_GROUP} then mine.{c} when l.n >= {LEAST_GROUP} then l.{c} when whole.n > 0 then whole.{c} end"
    limit = lambda k, side, least: f"{pick('m_' + k)} + {side} * {SPREADS} * greatest(abs({pick('m_' + k)} - {pick('q_' + k)}), {least})"
    fails = ", ".join(f"case when ({k} - ({limit(k, side, least)})) * {side} > 0 then '{k}' end" for k, (_, side, least) in STATISTICS.items())
    count = lambda chars: f"length(regexp_replace(t, '[^{chars}]', '', 'g'))"
    return rf"""
with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, {PLAIN}) as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {PLAIN})) as ls from d),
tri as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as c from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select doc_id, count(distinct i + k) as n from tri, (select unnest([0, 1, 2]) as k) where c > 1 group by doc_id),
s as (select w.doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, {count('#*$%&|<>')}::bigint as n_symbols,
  len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, {count('A-Z')} as n_upper, {count('!?')} as n_marks
  from w left join rep using (doc_id)),
x as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {", ".join(f"{e} as {k}" for k, e in expressions.items())} from s),
mine as (select lang, source, count(*) filter (not base_failed) as n, {sketches} from x group by lang, source),
l as (select lang, count(*) filter (not base_failed) as n, {sketches} from x group by lang),
whole as (select count(*) filter (not base_failed) as n, {sketches} from x),
j as (select x.*, list_filter([{fails}], lambda y: y is not null) as failed from x
  join mine on x.lang is not distinct from mine.lang and x.source is not distinct from mine.source join l on x.lang is not distinct from l.lang cross join whole)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(failed) = 0 as kept, array_to_string(failed, ',') as failed_rules from j
"""


OP8 = f"""
with recursive d as (select doc_id, regexp_extract_all({LOW}, {PLAIN}) as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from (select doc_id, ws, unnest(case when len(ws) >= 5 then range(1, len(ws) - 3) when len(ws) > 0 then [1::bigint] else []::bigint[] end) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from s a join s b using (g) join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id where a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach as (select a, b from links union select reach.a, links.b from reach join links on links.a = reach.b),
least as (select a as doc_id, min(b) as m from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::bigint as component_id from d left join n using (doc_id) left join least using (doc_id)
"""


def license_sql() -> str:
    rows, size = [], {}
    for k, (label, text) in enumerate(TEMPLATES):
        words = [x for x in re.split(SEPARATORS, text.lower()) if x]
        size[k] = len(set(words))
        rows += [f"({k}, '{label}', '{w}', {size[k]}, {-(-round(THRESHOLD * 100) * size[k] // 100)}, {len(words)})" for w in dict.fromkeys(words)]
    phrases = " union all ".join(
        f"select doc_id, i - 1 as i, '{label}' as label from w where " + " and ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    return f"""
with d as (select doc_id, {LOW} as t from documents),
a as (select doc_id, t, regexp_extract_all(t, {ALNUM}) as ws from d),
w as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from a),
base as (select doc_id, count(*) as n, min(i) as first, max(i) as last, list(distinct label) as labels from ({phrases}) group by doc_id),
templates(k, label, word, size, need, width) as (values {", ".join(rows)}),
occ as (select doc_id, i, k, label, size, need, width, word from w join templates on word = ws[i]),
runs as (select x.doc_id, x.k, x.label, x.size, x.need, count(distinct y.word) as n from occ x join occ y on y.doc_id = x.doc_id and y.k = x.k and y.i between x.i and x.i + x.width - 1 group by x.doc_id, x.k, x.label, x.size, x.need, x.i),
lines as (select doc_id, generate_subscripts(l, 1) as j, unnest(l) as line from (select doc_id, string_split(t, chr(10)) as l from d)),
of_lines as (select doc_id, j, unnest(list_distinct(regexp_extract_all(line, {ALNUM}))) as word from lines),
sets as (select doc_id, k, label, size, need, count(*) as n from of_lines join templates using (word) group by doc_id, j, k, label, size, need),
found as (select doc_id, label, n::double / size as c from runs where n >= need union all select doc_id, label, n::double / size from sets where n >= need),
extra as (select doc_id, list(distinct label) as labels, max(c) as best from found group by doc_id)
select a.doc_id, len(ws)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, base.first::bigint as first_word, base.last::bigint as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(extra.labels, [])))), ','), '') as labels,
  (case when base.n > 0 then 1.0 else coalesce(best, 0.0) end)::double as score
from a left join base using (doc_id) left join extra using (doc_id)
"""


OP10 = f"""
with d as (select doc_id, regexp_extract_all({LOW}, {ALNUM}) as ws from documents),
b as (select item_id, regexp_extract_all({LOW}, {ALNUM}) as ws from benchmark),
g as (select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + 9], ' ') as g from (select item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as i from b where len(ws) > 0)),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d),
h as (select doc_id, i, g.n, item_id from (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as g from p, (select distinct n from g) where i + n - 1 <= len(ws)) q join g using (n, g)),
hits as (select doc_id, count(distinct i + k) as n_hit from h, (select unnest(range(0, 10)) as k) where k < n group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as l from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_cross_entropy_difference": OP1,
    "op3_run_length_dedup": OP3,
    "op4_recompression_dedup": OP4,
    "op6_adaptive_quality_rules": quality_sql(),
    "op8_token_combination_jaccard": OP8,
    "op9_license_set_join": license_sql(),
    "op10_suffix_automaton_decontamination": OP10,
}
