"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from .mixing import WEIGHTS
from .quality_rules import BASE_FAILED, KEEP_FROM, ROUNDS, RULES, SMOOTHING

_WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""with d as (select doc_id, source, coalesce('s' || source, 'n') skey, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) size, md5('mix-1|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) digest from documents),
s as (select skey, cast(sum(size) as bigint) source_size, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() over (order by skey = 'n', skey) - 1) % {len(WEIGHTS)}] w from d group by skey),
a as (select *, 3 * source_size cap, cast(sum(source_size) over () as bigint) total from s),
b as (select *, coalesce(sum(cap) over (order by cast(cap as double) / w, skey = 'n', skey rows between unbounded preceding and 1 preceding), 0) gone, sum(w) over (order by cast(cap as double) / w, skey = 'n', skey rows between current row and unbounded following) w_left from a),
c as (select *, cap * w_left < w * (total - gone) capped from b),
e as (select *, sum(case when not capped then w end) over () free, total - coalesce(sum(case when capped then cap end) over (), 0) rest_all from c),
t as (select *, case when capped then cast(cap as double) else cast(w * rest_all as double) / cast(free as double) end target from e),
u as (select *, case when capped then 3 when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end whole from t),
k as (select skey, digest, sum(size) size from d group by all),
f as (select skey, digest, 2 * sum(size) over (partition by skey order by digest) - size twice from k)
select d.doc_id, d.size, u.source_size, u.target, cast(d.size * (u.whole + case when f.twice <= 2 * (u.target - u.whole * u.source_size) then 1 else 0 end) as bigint) taken
from d join u using (skey) join f using (skey, digest)"""


def rules() -> str:
    k = len(RULES)
    cast_votes = " + ".join(f"{3**j} * case when {bad} then 0 when {good} then 2 else 1 end" for j, (good, bad) in enumerate(RULES.values()))
    start = " + ".join(f"case (pattern // {3**j}) % 3 when 0 then -2.5 when 2 then 0.5 else 0 end" for j in range(k))
    digits = ", ".join(f"{3 * j} + (pattern // {3**j}) % 3" for j in range(k))
    mine = lambda q: f"list_sum(list_transform(range(1, m + 1), lambda i: case when list_contains(votes[i], e) then n[i] * {q} else 0 end))"
    return rf"""with recursive d as (select row_number() over () rid, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') words, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') tight,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) lines from documents),
x as (select rid, unnest(words) a, generate_subscripts(words, 1) i from d),
y as (select rid, i, a, lead(a) over (partition by rid order by i) b, lead(a, 2) over (partition by rid order by i) c from x),
z as (select rid, i, count(*) over (partition by rid, a, b, c) n from y where c is not null),
r as (select rid, count(distinct i + j) n from z, (select unnest([0, 1, 2]) j) where n > 1 group by rid),
f as (select rid, doc_id, len(words) n_words, length(tight) word_chars, length(tight) - length(regexp_replace(tight, '[#*$%&|<>]', '', 'g')) n_symbols, len(lines) n_lines, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(r.n, 0) n_repeat_words,
  length(tight) - length(regexp_replace(tight, '\p{{Lu}}', '', 'g')) n_upper, length(tight) - length(regexp_replace(tight, '\p{{L}}', '', 'g')) n_letters, length(tight) - length(regexp_replace(tight, '[!?]', '', 'g')) n_exclaim,
  len(list_filter(words, lambda w: regexp_matches(w, '[.!?]\z'))) n_ends, len(list_distinct(words)) n_distinct from d left join r using (rid)),
v as (select *, {BASE_FAILED} as base_failed, {cast_votes} as pattern from f),
p as (select pattern, cast(count(*) as double) n, [{digits}] votes, 1 / (1 + exp(-(1.0 + {start}))) q from v where not base_failed group by pattern),
one as (select list(pattern order by pattern) pattern, list(n order by pattern) n, list(votes order by pattern) votes, list(q order by pattern) q, sum(n) total, count(*) m from p),
em as (select 0 as turn, pattern, n, votes, total, m, q from one where m > 0
  union all
  select turn + 1, pattern, n, votes, total, m, list_transform(range(1, m + 1), lambda i: 1 / (1 + exp(-(ln((good + 1) / (total - good + 1)) + list_sum(list_transform(votes[i], lambda e: ratio[e + 1])))))) from (
    select *, list_transform(range(0, {3 * k}), lambda e: ln(({mine('q[i]')} + {SMOOTHING}) / (good + {3 * SMOOTHING})) - ln(({mine('(1 - q[i])')} + {SMOOTHING}) / (total - good + {3 * SMOOTHING}))) ratio
    from (select *, list_sum(list_transform(range(1, m + 1), lambda i: n[i] * q[i])) good from em where turn < {ROUNDS}))),
g as (select unnest(pattern) as pattern, unnest(q) q from em where turn = {ROUNDS})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(round(q, 6) >= {KEEP_FROM}, false) as kept from v left join g using (pattern)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": rules(), "op6_mixing": MIXING}
