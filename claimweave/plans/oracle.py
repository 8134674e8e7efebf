"""DuckDB SQL fragments that say what the operators compute, independently of them."""

from __future__ import annotations

# Fixed values, written here again, so that a fault in the operators' lists shows.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "vs", "etc"]
COMPOUND = [", and ", ", but ", ", while ", ", whereas ", ", although ", ", which ", ", who ", ", where ", "; ", " — ", " – "]
LETTERS = [chr(c) for c in range(97, 123)]
NEGATIONS = ["no", "not", "never", "none", "cannot", "nicht", "kein", "pas", "ne", "nunca"]
WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NEG = "[" + ",".join(f"'{w}'" for w in NEGATIONS) + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def hidden(x: str) -> str:
    once = f"regexp_replace({x}, '([0-9])[.]([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    twice = f"regexp_replace({once}, '([0-9])[.]([0-9])', '\\1' || chr(1) || '\\2', 'g')"
    return f"regexp_replace({twice}, '({'|'.join(ABBREVIATIONS)})[.]', '\\1' || chr(1), 'g')"


def pieces(x: str) -> str:
    return f"regexp_extract_all({hidden(x)}, '[^.!?;]*[.!?;]|[^.!?;]+')"


def shown(x: str) -> str:
    return f"replace({trimmed(x)}, chr(1), '.')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform({pieces(x)}, lambda p: {shown('p')}), lambda s: s <> '')"


def normalized(x: str) -> str:
    flat = trimmed(f"regexp_replace(lower({x}), '{WHITE}+', ' ', 'g')")
    return f"""regexp_replace({flat}, '^[.!?,;:"'']+|[.!?,;:"'']+$', '', 'g')"""


def compound(x: str) -> str:
    return "(" + " or ".join(f"contains({x}, {quoted(m)})" for m in COMPOUND) + ")"


def adaptive_k(x: str, k: int) -> str:
    return f"least(greatest(ceil(length({x}) / 40)::int, 3), {k})"


def letters(x: str) -> str:
    return "[" + ",".join(f"(length(lower({x})) - length(replace(lower({x}), '{c}', '')))::double" for c in LETTERS) + "]"


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


EVALS = """evals as (
  select c.conv_id * 2147483648 + c.turn as eval_id, c.conv_id, c.turn, coalesce(c.text, '') as output,
    coalesce((select string_agg(coalesce(p.text, ''), chr(10) || chr(10) order by p.turn) from conversations p where p.conv_id = c.conv_id and p.turn < c.turn), '') as context
  from conversations c where c.role = 'assistant')"""


def split(name: str, source: str, key: str, column: str, idx: str, text: str, least: int = 0) -> str:
    """name(key, idx, text, text_norm): the sentences of source.column."""
    return f"""{name} as (
  select {key}, i - 1 as {idx}, s as {text}, {normalized('s')} as {text}_norm from (
    select {key}, unnest(l) as s, generate_subscripts(l, 1) as i from (select {key}, {sentences(column)} as l from {source}))
  where strlen(s) >= {least})"""


CLAIMS = EVALS + ",\n" + split("claims", "evals", "eval_id", "output", "claim_idx", "claim", 10) + ",\n" + split("ctx", "evals", "eval_id", "context", "ctx_idx", "ctx")
FAST = CLAIMS + """,
fast as (select eval_id, claim_idx, min(ctx_idx) as ctx_idx from claims join ctx using (eval_id) where strlen(claim_norm) >= 12 and contains(ctx_norm, claim_norm) group by all),
resid as (select * from claims anti join fast using (eval_id, claim_idx))"""


def candidates(k: int = 5, floor: float = 0.1, adaptive: bool = False) -> str:
    """cand(eval_id, claim_idx, claim, ctx_idx, ctx, sim, rank), after FAST."""
    if k == 0:
        return """,
cand as (select eval_id, claim_idx, claim, ctx_idx, ctx, null::double as sim, row_number() over (partition by eval_id, claim_idx order by ctx_idx) as rank from resid join ctx using (eval_id))"""
    limit = f"rank <= {k}" + (f" and rank <= {adaptive_k('claim', k)}" if adaptive else "")
    return f""",
av as (select *, {letters('claim')} as a from resid), bv as (select *, {letters('ctx')} as b from ctx),
sims as (select eval_id, claim_idx, claim, ctx_idx, ctx, list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 0) as sim from av join bv using (eval_id)),
cand as (select * from (select *, row_number() over (partition by eval_id, claim_idx order by sim desc, ctx_idx) as rank from sims where sim >= {floor}) where {limit})"""


LEXICAL = f""",
worded as (select *, {words('claim')} as w, {words('ctx')} as v from cand),
lexed as (select *, coalesce(len(list_intersect(w, v))::double / nullif(len(w), 0), 0) as o, list_has_any(w, {NEG}) <> list_has_any(v, {NEG}) as neg from worded),
scored as (select eval_id, claim_idx, claim, ctx_idx, ctx, sim, rank, case when neg then 0 else o end::double as e, 1.0::double - o as n, case when neg then o else 0 end::double as c from lexed)"""


def fixed(e: float, n: float, c: float) -> str:
    return f""",
scored as (select *, {e}::double as e, {n}::double as n, {c}::double as c from cand)"""


def verdicts(threshold: float = 0.7, strict: bool = False) -> str:
    """final(eval_id, claim_idx, claim, label, e, n, c, supported, ctx_idx, evidence, evaluated, is_compound, supporting, verbatim), after scored."""
    return f""",
best as (select * from (select *, row_number() over (partition by eval_id, claim_idx order by greatest(e, c) desc, rank) as b from scored where greatest(e, c) > 0 or sim is not null) where b = 1),
sums as (select eval_id, claim_idx, count(*) as evaluated, max(case when c >= {threshold} and c > 0 then c end) as against,
  count(*) filter (where e >= 0.2 and e > c and n <= 0.65 and (sim is null or sim >= 0.7)) as supporting, avg(e) filter (where e >= 0.2 and e > c and n <= 0.65 and (sim is null or sim >= 0.7)) as mean_e from scored group by all),
probs as (select r.eval_id, r.claim_idx, r.claim, coalesce(b.e, 0) as e, coalesce(b.n, 0) as n, coalesce(b.c, 0) as c, b.ctx_idx, b.ctx as evidence, s.against, coalesce(s.supporting, 0) as supporting, s.mean_e,
  coalesce(s.evaluated, 0) as evaluated, {compound('r.claim')} as is_compound, len({sentences('v.context')}) = 0 as bare
  from resid r left join best b using (eval_id, claim_idx) left join sums s using (eval_id, claim_idx) join evals v on v.eval_id = r.eval_id),
labelled as (select *, case when bare then 'neutral' when c >= e and c >= n and c >= {threshold} then 'contradiction' when e >= n and e >= c then 'entailment' else 'neutral' end as base from probs),
judged as (select *, base = 'neutral' and not bare and is_compound and against is null and supporting >= 2 as part from labelled),
final as (
  select eval_id, claim_idx, claim, case when part then 'partial' else base end as label, case when part then mean_e else e end as e, case when bare then 1 else n end as n, c,
    part or base = 'entailment' or (base = 'neutral' and {'false' if strict else 'true'}) as supported, ctx_idx, evidence, evaluated, is_compound, case when part then supporting else 0 end as supporting, false as verbatim from judged
  union all
  select claims.eval_id, claims.claim_idx, claim, 'entailment', 1, 0, 0, true, fast.ctx_idx, ctx.ctx, 0, {compound('claim')}, 0, true
  from claims join fast using (eval_id, claim_idx) join ctx on ctx.eval_id = fast.eval_id and ctx.ctx_idx = fast.ctx_idx)"""


SCORE = """,
totals as (select eval_id, count(*) as total, count(*) filter (where supported) as supported, count(*) filter (where label = 'entailment') as entailed, count(*) filter (where label = 'neutral') as neutral,
  count(*) filter (where label = 'contradiction') as contradicted, count(*) filter (where label = 'partial') as partial, count(*) filter (where verbatim) as skipped from final group by all),
results as (select v.eval_id, coalesce(total, 0) as total, coalesce(supported, 0) as supported, coalesce(entailed, 0) as entailed, coalesce(neutral, 0) as neutral, coalesce(contradicted, 0) as contradicted,
  coalesce(partial, 0) as partial, coalesce(skipped, 0) as skipped, case when total is null then 1.0 else supported::double / total end as score from evals v left join totals using (eval_id))"""
