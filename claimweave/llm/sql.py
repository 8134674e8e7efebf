"""DuckDB SQL of the operators that SQL can express, from their contracts rather than their code."""

from __future__ import annotations

import math

from .licenses import PHRASES, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUFFIX_DEDUP = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
b as (select doc_id, h, length(h) // 2 as n from d),
w as (select doc_id, s, substr(h, 2 * s + 1, 100) as k from (select doc_id, h, unnest(range(0, n - 49)) as s from b where n >= 50)),
m as (select k, min(doc_id) as least from w group by k),
dup as (select w.doc_id, w.s from w join m using (k) where m.least < w.doc_id),
isl as (select *, sum(fresh) over (partition by doc_id order by s rows unbounded preceding) as g from (select *, case when s <= lag(s) over (partition by doc_id order by s) + 50 then 0 else 1 end as fresh from dup)),
spans as (select doc_id, g, min(s) as lo, max(s) + 50 as hi from isl group by doc_id, g),
gaps as (select s.doc_id, s.lo, s.hi, coalesce(lag(hi) over (partition by s.doc_id order by s.lo), 0) as last from spans s),
kept as (select g.doc_id, count(*) as n_spans, sum(hi - lo) as n_removed, string_agg(substr(h, 2 * last + 1, 2 * (lo - last)), '' order by lo) || substr(any_value(h), 2 * max(hi) + 1) as k from gaps g join b using (doc_id) group by g.doc_id)
select b.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256 from b left join kept using (doc_id)"""

QUALITY_RULES = r"""with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, s, array_to_string(list_slice(w, s, s + 4), ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 3)) as s from w where len(w) >= 5)),
twice as (select doc_id, s from (select *, count(*) over (partition by doc_id, k) as c from win) where c > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(s, s + 5)) as p from twice) group by doc_id),
lines as (select doc_id, l from (select doc_id, unnest(string_split(text, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]')),
dups as (select doc_id, count(*) - count(distinct l) as n from lines group by doc_id),
m as (select w.doc_id, source, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(dups.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words from w left join dups using (doc_id) left join rep using (doc_id)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m),
h as (select source, count(*) as n, count(*) filter (where base_failed) as k from f group by source),
t as (select sum(k) / sum(n) as mean, sum(n * (k / n) * (k / n)) / sum(n) as sq from h),
p as (select mean, greatest(1.0, least(1e6, case when sq - mean * mean > 1e-12 then mean * (1 - mean) / (sq - mean * mean) - 1 else 1e6 end)) as weight from t),
v as (select source, (mean * weight + k) / (weight + n) > 0.5 as host_failed from h, p)
select f.doc_id, n_words, coalesce(word_chars, 0)::bigint as word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not host_failed as kept from f join v on v.source is not distinct from f.source"""

NEAR_DEDUP = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from w),
n as (select doc_id, len(s)::bigint as n from s),
e as (select doc_id, unnest(s) as k from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.k = b.k and a.doc_id < b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id where 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join both_ways l on l.a = r.b),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select n.doc_id, n as n_shingles, component_id, n.doc_id = component_id as kept from n join c using (doc_id)"""


def license_scan(threshold: float = 0.9) -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    starts = []
    for phrase, _ in PHRASES:
        parts = phrase.split()
        test = " and ".join(f"w[i + {k}] = '{p}'" if k else f"w[i] = '{p}'" for k, p in enumerate(parts))
        starts.append(f"list_filter(range(1, len(w) - {len(parts) - 2}), lambda i: {test})")
    hits = ",\n".join(f"{s} as p{k}" for k, s in enumerate(starts))
    every = "p0"
    for k in range(1, len(PHRASES)):
        every = f"list_concat({every}, p{k})"
    base = "list_filter([" + ", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, (_, label) in enumerate(PHRASES)) + "], lambda x: x is not null)"
    sets = [sorted(set(text.split())) for text, _ in TEMPLATES]
    needs = [math.ceil(round(threshold * len(own), 9)) for own in sets]
    reach = max(len(text.split()) for text, _ in TEMPLATES)
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    rows = [f"({k}, '{label}', {listed(sets[k])}, {needs[k]}, {len(text.split())})" for k, (text, label) in enumerate(TEMPLATES)]
    rival = [f"({i}, {listed(sets[j])})" for i in range(len(sets)) for j in range(len(sets)) if i != j and len(set(sets[i]) & set(sets[j])) >= needs[i]]
    outdone = "exists (select 1 from rival where rival.t = m.t and len(list_intersect(held, r)) = len(held) and len(list_intersect(near, r))::double / len(r) > c)"
    return rf"""with t(t, label, own, need, size) as (values {", ".join(rows)}),
rival(t, r) as (values {", ".join(rival)}),
d as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '{word}') as w from d),
p as (select doc_id, len(w)::bigint as n_words, {hits} from w),
q as (select doc_id, n_words, {every} as starts, {base} as bl from p),
lines as (select doc_id, list_distinct(regexp_extract_all(l, '{word}')) as s from (select doc_id, unnest(string_split(text, chr(10))) as l from d)),
in_line as (select doc_id, t, label, list_intersect(s, own) as held, s as near, len(list_intersect(s, own))::double / len(own) as c from lines, t where len(list_intersect(s, own)) >= need),
wide as (select doc_id, w, t.* from w, t where contains(text, chr(10)) and len(list_intersect(list_distinct(w), own)) >= need),
spots as (select *, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(own, w[i]))) as i from wide),
windows as (select doc_id, t, label, need, len(own) as n, list_intersect(list_distinct(list_slice(w, i, i + size - 1)), own) as held, list_distinct(list_slice(w, greatest(i - {reach}, 1), greatest(i - {reach}, 1) + size + {2 * reach - 1})) as near from spots),
m as (select * from in_line union all select doc_id, t, label, held, near, len(held)::double / n as c from windows where len(held) >= need),
f as (select doc_id, list(distinct label) as more, max(c) as best from m where not {outdone} group by doc_id)
select q.doc_id, n_words, len(starts)::bigint as n_base, (list_min(starts) - 1)::bigint as first_word, (list_max(starts) - 1)::bigint as last_word, array_to_string(list_sort(list_distinct(bl)), ',') as base_labels,
array_to_string(list_sort(list_distinct(list_concat(bl, coalesce(more, []::varchar[])))), ',') as labels, case when len(starts) > 0 then 1.0 else coalesce(best, 0) end::double as score from q left join f using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """Query name to SQL."""
    return {"op2_suffix_dedup": SUFFIX_DEDUP, "op5_quality_rules": QUALITY_RULES, "op6_near_dedup": NEAR_DEDUP, "op9_license_scan": license_scan()}
