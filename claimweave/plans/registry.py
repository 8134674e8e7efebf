"""The queries of the evaluation engine, each beside the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, grounding, policy, report, robustness, schemas, spans, tool_guard
from ..sources import evaluations
from ..sources.tables import table
from . import oracle as O

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable (spark, sf_dir) -> DataFrame."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return dict(_SQL)


def _docs(spark, d):
    return table(spark, d, "documents")


def _evals(spark, d):
    return evaluations.from_conversations(table(spark, d, "conversations"))


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


SENT = f"select doc_id, i - 1 as idx, s as sentence from (select doc_id, unnest(l) as s, generate_subscripts(l, 1) as i from (select doc_id, {O.sentences('text')} as l from documents))"


# --- texts ---------------------------------------------------------------------------------------------------


@query(f"select doc_id, idx::int as idx, sentence from ({SENT})")
def split_claims(spark, d):
    return claims.explode_sentences(_docs(spark, d), ["doc_id"], "text")


@query(f"""with p as (select doc_id, unnest(l) as piece, generate_subscripts(l, 1) as pos from (select doc_id, {O.pieces('text')} as l from documents)),
q as (select *, {O.shown('piece')} as sentence, sum(strlen(piece)) over w as e, sum(length(piece)) over w as ce, case when pos > 1 then regexp_extract(piece, '^{O.WHITE}*') else '' end as lead from p window w as (partition by doc_id order by pos))
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as idx, sentence, (e - strlen(piece) + strlen(lead))::bigint as "start", e::bigint as "end", (ce - length(piece) + length(lead))::bigint as char_start, ce::bigint as char_end from q where sentence <> ''""")
def claim_spans(spark, d):
    return claims.sentence_spans(_docs(spark, d), ["doc_id"], "text")


@query(f"select doc_id, idx::int as idx, sentence from ({SENT}) where strlen(sentence) >= 40")
def min_length_filter(spark, d):
    return claims.long_enough(claims.explode_sentences(_docs(spark, d), ["doc_id"], "text"), 40)


@query(f"select doc_id, idx::int as idx, {O.compound('sentence')} as is_compound from ({SENT})")
def compound_flag(spark, d):
    return claims.explode_sentences(_docs(spark, d), ["doc_id"], "text").select("doc_id", "idx", T.is_compound(F.col("sentence")).alias("is_compound"))


@query(f"select doc_id, idx::int as idx, {O.normalized('sentence')} as norm from ({SENT})")
def normalize_substring(spark, d):
    return claims.explode_sentences(_docs(spark, d), ["doc_id"], "text").select("doc_id", "idx", T.normalized(F.col("sentence")).alias("norm"))


@query(f"select doc_id, idx::int as idx, {O.adaptive_k('sentence', 10)} as k from ({SENT})")
def adaptive_top_k(spark, d):
    return claims.explode_sentences(_docs(spark, d), ["doc_id"], "text").select("doc_id", "idx", T.adaptive_k(F.col("sentence"), 10).alias("k"))


@query("""select doc_id, (s // 462)::int as chunk_idx, substr(text, s + 1, 512) as chunk, s::int as char_offset from (
  select doc_id, text, unnest(case when length(text) <= 512 then [0] else range(0, length(text), 462) end) as s from documents where length(text) > 0)""")
def token_chunks(spark, d):
    return claims.token_chunks(_docs(spark, d), ["doc_id"], "text", 512, 50)


def _word_counter():
    import re

    word = re.compile("[A-Za-z0-9]+")
    return lambda texts: [len(word.findall(t)) for t in texts]


_N = lambda x: f"len(regexp_extract_all({x}, '[A-Za-z0-9]+'))"


@query(f"""with recursive s as (select doc_id, text, {O.sentences('text')} as l from documents where text is not null),
c as (select doc_id, text, l, {_N('text')} as n, list_prepend(0::hugeint, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: {_N('x')})))) as t from s),
g as (select doc_id, 0 as chunk_idx, 0::bigint as a, greatest(1, len(list_filter(t, lambda x: x <= 60)) - 1)::bigint as b from c where n > 60 and len(l) > 0
union all select doc_id, chunk_idx + 1, a2, greatest(b + 1, len(list_filter(t, lambda x: x <= t[a2 + 1] + 60)) - 1)::bigint from (
  select g.doc_id, g.chunk_idx, g.b, c.t, len(c.l) as m, greatest(g.a, least(g.b - 1, len(list_filter(c.t, lambda x: x <= c.t[g.b + 1] - 15)) - 1))::bigint as a2 from g join c on c.doc_id = g.doc_id) where b < m)
select doc_id, 0 as chunk_idx, text as chunk from c where n <= 60 or len(l) = 0 union all select g.doc_id, g.chunk_idx::int, array_to_string(c.l[g.a + 1:g.b], ' ') from g join c on c.doc_id = g.doc_id""")
def budget_chunks(spark, d):
    """Sentences packed into chunks of 60 tokens, here words of letters and digits, with an overlap of 15."""
    return claims.budget_chunks(_docs(spark, d), ["doc_id"], "text", _word_counter, "words", 60, 15)


@query(f"""select page_id, {O.trimmed(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script[^>]*>', '', 'g'), '(?is)<style[^>]*>.*?</style[^>]*>', '', 'g'), '<[^>]*>', '', 'g'), '{O.WHITE}+', ' ', 'g')")} as text from pages""")
def strip_html(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("""select page_id, case when host like '%example.org' and t <> '' then t end as title from (
  select page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+/en/([^/?#]+)', 1) as t from pages)""")
def url_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.article_title(F.col("url"), "example.org", "en").alias("title"))


@query("select conv_id, turn, sha256(coalesce(role, '') || '|' || coalesce(text, '') || '|' || conv_id::varchar) as input_hash from conversations")
def input_hash(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.input_hash(F.col("role"), F.col("text"), F.col("conv_id").cast("string")).alias("input_hash"))


# --- sources -------------------------------------------------------------------------------------------------


@query(f"with {O.EVALS} select eval_id, strlen(context)::int as context_bytes, strlen(output)::int as output_bytes, case when trim(context, ' ') = '' then 'empty_context' when trim(output, ' ') = '' then 'empty_output' when strlen(context) > 500000 then 'context_too_large' when strlen(output) > 50000 then 'output_too_large' end as error from evals")
def request_validation(spark, d):
    return _evals(spark, d).select("eval_id", F.octet_length("context").alias("context_bytes"), F.octet_length("output").alias("output_bytes"), evaluations.request_error().alias("error"))


@query("""with c as (select *, row_number() over (order by value, event_id) - 1 as r, count(*) over () as n from events where event_type = 'purchase')
select 'mean' as stat, round(avg(value), 4) as value from c union all select 'p95', round(max(value) filter (where r = floor(n * 0.95)::bigint), 4) from c union all select 'p99', round(max(value) filter (where r = floor(n * 0.99)::bigint), 4) from c""")
def latency_percentiles(spark, d):
    """Percentiles by truncated index, as a latency report takes them: of the counts of each value, not of sorted rows."""
    rows = table(spark, d, "events").where("event_type = 'purchase'")
    counts = rows.groupBy("value").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    total = counts.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("value")).alias("sum"))
    # Sums over ranges first, so that no task orders all values.
    ranged = counts.withColumn("_range", F.floor("value"))
    ranges = ranged.groupBy("_range").agg(F.sum("n").alias("_all"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_all").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = F.sum("n").over(Window.partitionBy("_range").orderBy("value")) + F.col("_before")
    placed = ranged.join(ranges, "_range").withColumn("upto", upto).join(F.broadcast(total))  # one row
    pick = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("value")))
    one = placed.agg(F.max(F.col("sum") / F.col("total")).alias("mean"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))
    return one.select(F.explode(F.create_map(*[x for n in ("mean", "p95", "p99") for x in (F.lit(n), F.round(n, 4))])).alias("stat", "value"))


# --- evidence ------------------------------------------------------------------------------------------------


def _split(spark, d, config=grounding.Config()):
    evals = _evals(spark, d)
    own, context = grounding.split_claims(evals, config), grounding.split_context(evals)
    matched = grounding.fast_path(own, context, config)
    return evals, own, context, matched, grounding.residue(own, matched)


@query(f"with {O.FAST} select eval_id, claim_idx::int as claim_idx, ctx_idx::int as ctx_idx from fast")
def fast_path_match(spark, d):
    return _split(spark, d)[3]


@query(f"with {O.FAST} select eval_id, claim_idx::int as claim_idx, claim from resid")
def fast_path_residue(spark, d):
    return _split(spark, d)[4].select("eval_id", "claim_idx", "claim")


@query(f"with {O.CLAIMS} select eval_id, claim_idx::int as claim_idx, array_to_string(list_transform({O.letters('claim')}, lambda x: x::int), ',') as embedding from claims")
def letter_embedding(spark, d):
    own = grounding.split_claims(_evals(spark, d))
    return own.select("eval_id", "claim_idx", F.array_join(F.transform(T.letter_vector(F.col("claim")), lambda x: x.cast("int").cast("string")), ",").alias("embedding"))


@query("""select a.vec_id as a_id, b.vec_id as b_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as cosine
from (select vec_id, embedding::double[] as e from embeddings) a join (select vec_id, embedding::double[] as e from embeddings) b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0""")
def cosine_pairs(spark, d):
    """Query vectors (every fiftieth) against all other vectors."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    a, b = rows.where("vec_id % 50 = 0").alias("a"), rows.alias("b")
    near = a.join(b, F.col("a.vec_id") != F.col("b.vec_id"))
    return near.select(F.col("a.vec_id").alias("a_id"), F.col("b.vec_id").alias("b_id"), F.round(T.cosine(F.col("a.e"), F.col("b.e")), 6).alias("cosine"))


_PAIRS = "select eval_id, claim_idx::int as claim_idx, ctx_idx::int as ctx_idx, round(sim, 6) as sim, rank::int as rank from cand"


def _pairs(df):
    return df.select("eval_id", "claim_idx", "ctx_idx", r6("sim"), "rank")


@query(f"with {O.FAST}{O.candidates()} {_PAIRS}")
def top_k_candidates(spark, d):
    _, _, context, _, left = _split(spark, d)
    return _pairs(grounding.candidates(left, context))


@query(f"with {O.FAST}{O.candidates(10, 0.25, True)} {_PAIRS}")
def adaptive_candidates(spark, d):
    _, _, context, _, left = _split(spark, d, grounding.SERVICE)
    return _pairs(grounding.candidates(left, context, grounding.SERVICE))


ALL_PAIRS = grounding.Config(top_k=0)


@query(f"with {O.FAST}{O.candidates(0)} {_PAIRS}")
def full_cross_pairs(spark, d):
    _, _, context, _, left = _split(spark, d, ALL_PAIRS)
    return _pairs(grounding.candidates(left, context, ALL_PAIRS))


@query(f"with {O.FAST}{O.candidates()}{O.LEXICAL} select eval_id, claim_idx::int as claim_idx, ctx_idx::int as ctx_idx, round(e, 6) as e, round(n, 6) as n, round(c, 6) as c, case when c >= e and c >= n then 'contradiction' when n >= e then 'neutral' else 'entailment' end as label from scored")
def entailment_matrix(spark, d):
    rows = _scored(spark, d)
    return rows.select("eval_id", "claim_idx", "ctx_idx", r6("e"), r6("n"), r6("c"), grounding.argmax_label(F.col("e"), F.col("n"), F.col("c")).alias("label"))


def _scored(spark, d, config=grounding.Config(), backend=grounding.lexical):
    _, _, context, _, left = _split(spark, d, config)
    return grounding.scored(grounding.candidates(left, context, config), backend)


@query("""with z as (select *, greatest(a, b, c) as m from (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings)),
x as (select vec_id, exp(a - m) as a, exp(b - m) as b, exp(c - m) as c from z)
select vec_id, round(a / (a + b + c), 6) as e, round(b / (a + b + c), 6) as n, round(c / (a + b + c), 6) as c, case when c >= a and c >= b then 'contradiction' when b >= a then 'neutral' else 'entailment' end as label from x""")
def softmax_logits(spark, d):
    """The first three numbers of each vector as logits."""
    logits = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    e, n, c = grounding.softmax(logits)
    rows = table(spark, d, "embeddings").select("vec_id", e.alias("e"), n.alias("n"), c.alias("c"))
    return rows.select("vec_id", r6("e"), r6("n"), r6("c"), grounding.argmax_label(F.col("e"), F.col("n"), F.col("c")).alias("label"))


_SCORED = f"{O.FAST}{O.candidates()}{O.LEXICAL}"


@query(f"with {_SCORED}{O.verdicts()} select eval_id, claim_idx::int as claim_idx, ctx_idx::int as ctx_idx, round(sim, 6) as sim, round(e, 6) as e, round(c, 6) as c from best")
def best_evidence(spark, d):
    best = grounding.best_evidence(_scored(spark, d)).where("best is not null")
    return best.select("eval_id", "claim_idx", F.col("best.ctx_idx").alias("ctx_idx"), r6("best.sim", "sim"), r6("best.e", "e"), r6("best.c", "c"))


@query(f"with {_SCORED} select eval_id, claim_idx::int as claim_idx, ctx_idx::int as ctx_idx, round(c, 6) as c from (select *, row_number() over (partition by eval_id, claim_idx order by c desc, rank) as r from scored where c >= 0.3 and c > 0) where r = 1")
def strongest_contradiction(spark, d):
    rows = grounding.strongest_contradiction(_scored(spark, d), grounding.Config(contradiction=0.3))
    return rows.select("eval_id", "claim_idx", F.col("against.ctx_idx").alias("ctx_idx"), r6("against.c", "c"))


@query(f"with {_SCORED} select eval_id, claim_idx::int as claim_idx, ctx_idx::int as ctx_idx, round(e, 6) as e from scored where e >= 0.2 and e > c and n <= 0.65 and sim >= 0.7")
def partial_evidence(spark, d):
    return grounding.partial_evidence(_scored(spark, d)).select("eval_id", "claim_idx", "ctx_idx", r6("e"))


_VERDICT = "select eval_id, claim_idx::int as claim_idx, label, round(e, 6) as e, round(n, 6) as n, round(c, 6) as c, supported, ctx_idx::int as ctx_idx, evaluated::bigint as evaluated, is_compound, supporting::bigint as supporting, verbatim from final"


def _verdict(df):
    return df.select("eval_id", "claim_idx", "label", r6("e"), r6("n"), r6("c"), "supported", "ctx_idx", "evaluated", "is_compound", "supporting", "verbatim")


@query(f"with {_SCORED}{O.verdicts()} {_VERDICT}")
def claim_verdicts(spark, d):
    return _verdict(grounding.verdicts(_evals(spark, d)))


STRICT = grounding.Config(neutral_unsupported=True, contradiction=0.3)


@query(f"with {_SCORED}{O.verdicts(0.3, True)} {_VERDICT}")
def strict_verdicts(spark, d):
    return _verdict(grounding.verdicts(_evals(spark, d), STRICT))


@query(f"with {O.FAST}{O.candidates(0)}{O.fixed(0.45, 0.5, 0.05)}{O.verdicts()} {_VERDICT}")
def partial_verdicts(spark, d):
    return _verdict(grounding.verdicts(_evals(spark, d), ALL_PAIRS, grounding.fixed(0.45, 0.5, 0.05)))


@query(f"with {_SCORED}{O.verdicts()}{O.SCORE} select eval_id, total::bigint as total, supported::bigint as supported, entailed::bigint as entailed, neutral::bigint as neutral, contradicted::bigint as contradicted, partial::bigint as partial, skipped::bigint as skipped, round(score, 6) as score from results")
def faithfulness_score(spark, d):
    evals = _evals(spark, d)
    return grounding.scores(evals, grounding.verdicts(evals)).withColumn("score", F.round("score", 6))


@query(f"""with {O.FAST}{O.candidates()},
k as (select eval_id, count(*) as calls from cand group by all), l as (select eval_id, count(*) as n from resid group by all), m as (select eval_id, count(*) as n from ctx group by all), f as (select eval_id, count(*) as n from fast group by all)
select e.eval_id, coalesce(calls, 0)::bigint as calls, (coalesce(l.n, 0) * coalesce(m.n, 0) - coalesce(calls, 0))::bigint as saved, coalesce(f.n, 0)::bigint as skipped from evals e left join k using (eval_id) left join l using (eval_id) left join m using (eval_id) left join f using (eval_id)""")
def call_counters(spark, d):
    return grounding.call_counters(_evals(spark, d))


def _bare(evals):
    return evals.withColumn("context", F.lit(""))


@query(f"with {O.FAST} select eval_id, claim_idx::int as claim_idx, 'neutral' as label, 1.0::double as n, true as supported from claims")
def no_context_result(spark, d):
    return grounding.verdicts(_bare(_evals(spark, d))).select("eval_id", "claim_idx", "label", "n", "supported")


@query(f"with {O.EVALS} select eval_id, 0::bigint as total, 1.0::double as score from evals")
def empty_output_result(spark, d):
    evals = _evals(spark, d).withColumn("output", F.lit(""))
    return grounding.scores(evals, grounding.verdicts(evals)).select("eval_id", "total", "score")


@query(f"""with {O.FAST}, lv as (select *, {O.letters('claim')} as a from resid), cv as (select *, {O.letters('ctx')} as b from ctx),
s as (select eval_id, claim_idx, ctx_idx, list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 0) as sim from lv join cv using (eval_id)),
r as (select *, row_number() over (partition by eval_id, claim_idx order by sim desc, ctx_idx) as rank from s where sim >= 0.1)
select eval_id, claim_idx::int as claim_idx, ctx_idx::int as ctx_idx, rank::int as rank from r where rank <= 5 and rank <= 1 + eval_id % 4""")
def overrides_per_row(spark, d):
    """A request's own top_k: here 1 to 4, by its id."""
    _, _, context, _, left = _split(spark, d)
    rows = grounding.candidates(left, context, k_col=(1 + F.col("eval_id") % 4).cast("int"))
    return rows.select("eval_id", "claim_idx", "ctx_idx", "rank")


@query(f"with {_SCORED}{O.verdicts(0.3, True)} select eval_id, claim_idx::int as claim_idx, claim as text, case when label = 'contradiction' then 'contradiction' else 'unsupported' end as issue_type, case when label = 'contradiction' then 'high' else 'medium' end as severity, round(case when label = 'contradiction' then c else 1 - e end, 6) as confidence from final where not supported")
def issues(spark, d):
    return grounding.issues(grounding.verdicts(_evals(spark, d), STRICT)).withColumn("confidence", F.round("confidence", 6))


@query(f"with {_SCORED}{O.verdicts(0.3, True)}{O.SCORE} select eval_id, round(score, 6) as score, score >= 0.7 as pass from results")
def pass_flag(spark, d):
    evals = _evals(spark, d)
    return grounding.scores(evals, grounding.verdicts(evals, STRICT)).select("eval_id", F.round("score", 6).alias("score"), (F.col("score") >= STRICT.pass_threshold).alias("pass"))


@query(f"""with {_SCORED}{O.verdicts()}
select f.eval_id, f.claim_idx::int as claim_idx, (select 'turn-' || min(p.turn)::varchar from conversations p join evals v on v.conv_id = p.conv_id and p.turn < v.turn where v.eval_id = f.eval_id and contains(coalesce(p.text, ''), f.evidence)) as chunk_id from final f where f.evidence is not null""")
def chunk_ids(spark, d):
    evals = _evals(spark, d)
    rows = grounding.verdicts(evals).where("evidence is not null").join(evals.select("eval_id", "chunks"), "eval_id")
    return rows.select("eval_id", "claim_idx", grounding.chunk_id(F.col("chunks"), F.col("evidence")).alias("chunk_id"))


@query(f"with {_SCORED}{O.verdicts()}{O.SCORE} select eval_id, round(case when total = 0 then null else (entailed + contradicted)::double / total end, 6) as confidence from results")
def engine_confidence(spark, d):
    evals = _evals(spark, d)
    rows = grounding.scores(evals, grounding.verdicts(evals))
    return rows.select("eval_id", F.round(F.try_divide((F.col("entailed") + F.col("contradicted")).cast("double"), F.col("total")), 6).alias("confidence"))


@query(f"with {_SCORED}{O.verdicts()} select eval_id, claim_idx::int as claim_idx, 'claim' as kind, label, round(case label when 'contradiction' then c when 'neutral' then n else e end, 6) as confidence from final")
def module_details(spark, d):
    rows = grounding.verdicts(_evals(spark, d))
    value = F.when(F.col("label") == "contradiction", F.col("c")).when(F.col("label") == "neutral", F.col("n")).otherwise(F.col("e"))
    return rows.select("eval_id", "claim_idx", F.lit("claim").alias("kind"), "label", F.round(value, 6).alias("confidence"))


@query(f"""with {_SCORED}{O.verdicts()}{O.SCORE}, m as (select eval_id, 'groundedness' as module, score, score >= 0.7 as passed from results union all select eval_id, 'size', case when strlen(output) <= 400 then 1.0 else 0.0 end, strlen(output) <= 400 from evals)
select eval_id, count(*)::bigint as modules, count(*) filter (where passed)::bigint as passed, bool_and(passed) as all_passed, string_agg(module, ',' order by module) as names from m group by all""")
def report_rollup(spark, d):
    """Module results of an evaluation made one report."""
    evals = _evals(spark, d)
    grounded = grounding.scores(evals, grounding.verdicts(evals)).select("eval_id", F.lit("groundedness").alias("module"), (F.col("score") >= 0.7).alias("passed"))
    size = evals.select("eval_id", F.lit("size").alias("module"), (F.octet_length("output") <= 400).alias("passed"))
    return grounded.unionByName(size).groupBy("eval_id").agg(
        F.count("*").alias("modules"), F.count(F.when(F.col("passed"), 1)).alias("passed"), F.bool_and("passed").alias("all_passed"), F.array_join(F.array_sort(F.collect_list("module")), ",").alias("names")
    )


@query("""with g as (select item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') as t from benchmark)
select d.doc_id, g.item_id from documents d join g on contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g'), ' '), g.t)""")
def benchmark_contamination(spark, d):
    """Documents that hold a benchmark item verbatim, white space and case aside.

    Candidates share the item's rarest inner word, counted over all documents, which is a whole word whatever stands
    around the item. Items of at most two words have no inner word and meet all texts. Texts join only the pairs left.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    docs = _docs(spark, d).select("doc_id", flat(F.col("text")).alias("_doc"))
    items = table(spark, d, "benchmark").select("item_id", flat(F.col("text")).alias("_item"))
    own = F.split("_item", " ")
    items = items.withColumn("_inner", F.slice(own, F.lit(2), F.greatest(F.size(own) - 2, F.lit(0))))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("_doc", " "))).alias("_key"))
    inner = items.select("item_id", F.explode(F.array_distinct("_inner")).alias("_key"))
    often = words.join(inner.select("_key").distinct(), "_key").groupBy("_key").agg(F.count("*").alias("_n"))
    keyed = inner.join(often, "_key").groupBy("item_id").agg(F.min(F.struct("_n", "_key")).alias("_least"), F.count("*").alias("_known"))
    every = items.select("item_id", F.size(F.array_distinct("_inner")).alias("_words"))  # an item with a word that no document has is in none
    keyed = keyed.join(every, "item_id").where("_known = _words").select("item_id", F.col("_least._key").alias("_key"))
    near = words.join(keyed, "_key").select("doc_id", "item_id").join(docs, "doc_id").join(items, "item_id").where(F.contains("_doc", F.col("_item")))
    short = docs.join(items.where(F.size("_inner") == 0), F.contains("_doc", F.col("_item")))
    return near.select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id"))


# --- policy --------------------------------------------------------------------------------------------------

PROMPTS = [
    (0, "1. Never reveal the internal notes.\n2. Always cite the source of each claim.\n3. Do not discuss prices.\n\nBe kind."),
    (1, "- Never share it on the web\n* Always answer in the language of the user\n• You cannot promise a refund"),
    (2, "Only if the user is authenticated, show the balance.\nYou must ensure that the answer is short.\nIn case of doubt ask.\nShould you fail, say so.\nWhen asked, explain the terms, then stop.\nno rule"),
    (3, "4. The tone is warm.\n5. Should mention the date.\nRefuse to speak of politics at any time."),
]
_PROMPTS = "(values " + ", ".join(f"({i}::bigint, {O.quoted(t)})" for i, t in PROMPTS) + ") as prompts(prompt_id, prompt)"


def _prompts(spark):
    return spark.createDataFrame(PROMPTS, "prompt_id long, prompt string")


def _first_sql(x: str, old: str, new: str) -> str:
    return f"case when instr({x}, '{old}') > 0 then left({x}, instr({x}, '{old}') - 1) || '{new}' || substr({x}, instr({x}, '{old}') + {len(old)}) else {x} end"


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_USABLE = lambda x: f"case when {x} <> '' and (regexp_matches({x}, '{_re(policy.DENY)}') or regexp_matches({x}, '{_re(policy.REQUIRE)}') or not regexp_matches({x}, '{policy.CONDITIONAL}') or regexp_extract({x}, '{policy.TRIGGER}', 1) <> '') then {x} end"
RULES_SQL = f"""lines as (select prompt_id, unnest(l) as raw, generate_subscripts(l, 1) as line from (select prompt_id, string_split(prompt, chr(10)) as l from {_PROMPTS})),
texts as (select prompt_id, line, {O.trimmed('raw')} as t from lines),
listed as (select *, {O.trimmed(f"coalesce(nullif(regexp_extract(t, '{policy.NUMBERED}', 2), ''), nullif(regexp_extract(t, '{policy.BULLET}', 1), ''))")} as item from texts where t <> ''),
chosen as (select prompt_id, line, coalesce({_USABLE('item')}, case when regexp_matches(t, '{policy.RULE_LINE}') and strlen(t) > 15 then {_USABLE('t')} end) as r from listed),
kinds as (select prompt_id, (row_number() over (partition by prompt_id order by line) - 1)::int as rule_idx, r, lower(r) as low, case when regexp_matches(r, '{_re(policy.DENY)}') then 'deny' when regexp_matches(r, '{_re(policy.REQUIRE)}') then 'require' when regexp_matches(r, '{policy.CONDITIONAL}') then 'conditional' else 'inform' end as k from chosen where r is not null),
trig as (select *, case when k = 'conditional' then trim(regexp_extract(r, '{policy.TRIGGER}', 1), ' ') end as tr from kinds),
rules as (select prompt_id, rule_idx, r as rule_text, k as constraint_type, tr as "trigger", case
  when k = 'deny' and (contains(low, 'must not') or contains(low, 'cannot')) then r
  when k = 'deny' and starts_with(low, 'never') then {_first_sql(f"({_first_sql('r', 'never', 'must never')})", 'Never', 'Must never')}
  when k = 'deny' and (starts_with(low, 'do not') or starts_with(low, 'don''t')) then 'The agent must not ' || substr(r, greatest(instr(r, ' '), 1))
  when k = 'deny' then 'The agent must not: ' || r
  when k = 'require' and contains(low, 'must') then r
  when k = 'require' and starts_with(low, 'always') then {_first_sql(f"({_first_sql('r', 'always', 'must always')})", 'Always', 'Must always')}
  when k = 'require' and starts_with(low, 'should') then {_first_sql(f"({_first_sql('r', 'should', 'must')})", 'Should', 'Must')}
  when k = 'require' then 'The agent must: ' || r
  when k = 'conditional' then 'When ' || tr || ', the agent must: ' || r else r end as assertion from trig)"""


@query(f'with {RULES_SQL} select prompt_id, rule_idx, rule_text, constraint_type, "trigger" from rules')
def policy_rules(spark, d):
    return policy.extract_rules(_prompts(spark)).drop("assertion")


@query(f"with {RULES_SQL} select prompt_id, rule_idx, assertion from rules")
def policy_assertions(spark, d):
    return policy.extract_rules(_prompts(spark)).select("prompt_id", "rule_idx", "assertion")


def _outputs(spark, d):
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    return rows.select((F.col("conv_id") * (1 << 31) + F.col("turn")).alias("output_id"), (F.col("conv_id") % len(PROMPTS)).alias("prompt_id"), F.coalesce("text", F.lit("")).alias("output"))


_POLICY = f"""{RULES_SQL},
outs as (select conv_id * 2147483648 + turn as output_id, conv_id % {len(PROMPTS)} as prompt_id, coalesce(text, '') as output from conversations where role = 'assistant'),
{O.split('oc', 'outs', 'output_id', 'output', 'claim_idx', 'claim', 10)},
held as (select o.output_id, r.rule_idx, r.prompt_id, r.constraint_type, r.assertion, (o.output_id, r.rule_idx) as eval_id from outs o join rules r using (prompt_id)),
claims as (select h.eval_id, c.claim_idx, c.claim, c.claim_norm from held h join oc c using (output_id)),
{O.split('rc', 'rules', 'prompt_id * 1000 + rule_idx', 'assertion', 'ctx_idx', 'ctx').replace('prompt_id * 1000 + rule_idx, i', 'rid, i').replace('select prompt_id * 1000 + rule_idx, unnest', 'select rid, unnest').replace('(select prompt_id * 1000 + rule_idx, ', '(select prompt_id * 1000 + rule_idx as rid, ')},
ctx as (select h.eval_id, ctx_idx, ctx, ctx_norm from held h join rc on rc.rid = h.prompt_id * 1000 + h.rule_idx),
evals as (select eval_id, assertion as context from held),
fast as (select eval_id, claim_idx, min(ctx_idx) as ctx_idx from claims join ctx using (eval_id) where strlen(claim_norm) >= 12 and contains(ctx_norm, claim_norm) group by all),
resid as (select * from claims anti join fast using (eval_id, claim_idx)){O.candidates()}{O.LEXICAL}{O.verdicts(0.7, True).replace("not bare and is_compound", "false")},
broken as (select h.output_id, h.rule_idx, f.claim_idx, f.claim, f.label, greatest(f.c, f.n) as confidence from final f join held h using (eval_id) where not f.verbatim and case h.constraint_type
  when 'deny' then f.label in ('contradiction', 'neutral') and f.c >= 0.7 when 'require' then f.label <> 'entailment' and greatest(f.n, f.c) >= 0.7 when 'conditional' then f.label = 'contradiction' and f.c >= 0.7 else false end)"""


@query(f"with {_POLICY} select output_id, rule_idx::int as rule_idx, claim_idx::int as claim_idx, label, round(confidence, 6) as confidence from broken")
def policy_violations(spark, d):
    rows = policy.violations(policy.extract_rules(_prompts(spark)), _outputs(spark, d))
    return rows.select("output_id", "rule_idx", "claim_idx", "label", r6("confidence"))


@query(f"with {_POLICY} select o.output_id, count(b.output_id)::bigint as n_violations, count(b.output_id) = 0 as compliant from outs o left join broken b on b.output_id = o.output_id group by o.output_id")
def policy_compliance(spark, d):
    outputs = _outputs(spark, d)
    return policy.compliance(outputs, policy.violations(policy.extract_rules(_prompts(spark)), outputs))


# --- tool guard ----------------------------------------------------------------------------------------------

GUARD = tool_guard.Policy(
    denied=("error",), allowed=("signup", "click", "view", "purchase"), ordering=(tool_guard.Ordering("click", "purchase", "click first"),),
    parameters=(tool_guard.Parameter("view", "/k", "range", 10, 90), tool_guard.Parameter("click", "/k", "not_contains", text="7"), tool_guard.Parameter("signup", "/k", "regex", text="^[0-4]")),
)


def tool_calls(spark, d):
    """Events as tool calls: a session is a user."""
    from pyspark.sql.window import Window

    rows = table(spark, d, "events")
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return rows.select(F.col("user_id").cast("string").alias("session_id"), index.cast("long").alias("call_index"), F.col("event_type").alias("tool_name"), F.col("props").alias("arguments"))


_CALLS = "calls as (select user_id::varchar as session_id, row_number() over (partition by user_id order by ts, event_id) - 1 as call_index, event_type as tool_name, json_extract_string(props, '$.k') as k from events)"


def _guarded(spark, d, p):
    return tool_guard.judge_log(tool_calls(spark, d), p).select("session_id", "call_index", "tool_name", "reason", "allowed")


_DENY = "when tool_name = 'error' then 'Tool ''error'' is explicitly denied by policy'"
_ALLOW = "when tool_name not in ('signup', 'click', 'view', 'purchase') then 'Tool ''' || tool_name || ''' is not in the allowed list'"
_ORDER = "when tool_name = 'purchase' and coalesce(clicked, 0) = 0 then 'Tool ''purchase'' requires ''click'' to be called first: click first'"
_PARAMS = """when tool_name = 'view' and try_cast(k as double) < 10 then 'Parameter ''/k'' in tool ''view'' is ' || k || ', which is below minimum 10' when tool_name = 'view' and try_cast(k as double) > 90 then 'Parameter ''/k'' in tool ''view'' is ' || k || ', which exceeds maximum 90'
when tool_name = 'click' and contains(k, '7') then 'Parameter ''/k'' in tool ''click'' contains forbidden value ''7''' when tool_name = 'signup' and not regexp_matches(k, '^[0-4]') then 'Parameter ''/k'' in tool ''signup'' does not match required pattern'"""


def _guard_sql(*rules: str) -> str:
    return f"with {_CALLS}, past as (select *, max((tool_name = 'click')::int) over (partition by session_id order by call_index rows between unbounded preceding and 1 preceding) as clicked from calls), judged as (select session_id, call_index::bigint as call_index, tool_name, case {' '.join(rules)} end as reason from past)"


_JUDGED = " select *, reason is null as allowed from judged"


@query(_guard_sql(_DENY) + _JUDGED)
def tool_guard_denied(spark, d):
    return _guarded(spark, d, tool_guard.Policy(denied=GUARD.denied))


@query(_guard_sql(_ALLOW) + _JUDGED)
def tool_guard_allowlist(spark, d):
    return _guarded(spark, d, tool_guard.Policy(allowed=GUARD.allowed))


@query(_guard_sql(_ORDER) + _JUDGED)
def tool_guard_ordering(spark, d):
    return _guarded(spark, d, tool_guard.Policy(ordering=GUARD.ordering))


@query(_guard_sql(_PARAMS) + _JUDGED)
def tool_guard_params(spark, d):
    return _guarded(spark, d, tool_guard.Policy(parameters=GUARD.parameters))


@query(_guard_sql(_DENY, _ALLOW, _ORDER, _PARAMS) + " select session_id, count(*)::bigint as total_calls, count(reason)::bigint as violations, min(call_index) filter (where reason is not null) as first_violation, count(reason) = 0 as compliant from judged group by all")
def tool_log_result(spark, d):
    return tool_guard.log_results(tool_guard.judge_log(tool_calls(spark, d), GUARD))


# --- robustness ----------------------------------------------------------------------------------------------


@query("with t as (select * from (values " + ", ".join(f"({i}, {O.quoted(t)})" for i, t in enumerate(robustness.TEMPLATES[:3])) + ") as t(variant_idx, template)) select conv_id, variant_idx::int as variant_idx, replace(template, '{prompt}', text) as variant from conversations, t where role = 'user' and turn = 0")
def adversarial_variants(spark, d):
    prompts = table(spark, d, "conversations").where("role = 'user' and turn = 0").select("conv_id", F.col("text").alias("prompt"))
    return robustness.variants(prompts, 3).drop("prompt")


_SOURCES = "(select distinct source as rule_id from documents)"
_SAMPLES = "samples as (select l.doc_id as ord, l.doc_id % 2 = 1 as adversarial, case when l.toxic = 1 then d.source end as rule_id, d.text as response from labels l join documents d using (doc_id))"


def _samples(spark, d):
    rows = table(spark, d, "labels").join(_docs(spark, d).select("doc_id", "source", "text"), "doc_id")
    return rows.select(F.col("doc_id").alias("ord"), (F.col("doc_id") % 2 == 1).alias("adversarial"), F.when(F.col("toxic") == 1, F.array("source")).otherwise(F.array().cast("array<string>")).alias("violated"), F.col("text").alias("response"))


_RATES = f"""with {_SAMPLES}, t as (select count(*) as total, count(*) filter (where not adversarial) as nb, count(*) filter (where adversarial) as na from samples),
g as (select rule_id, count(*) filter (where not adversarial) as vb, count(*) filter (where adversarial) as va, list(response order by ord)[1:3] as bypasses from samples where rule_id is not null group by all),
r as (select s.rule_id, total, coalesce(vb, 0) + coalesce(va, 0) as v, coalesce(vb, 0)::double / nb as base_rate, coalesce(va, 0)::double / na as adv_rate, bypasses from {_SOURCES} s left join g using (rule_id), t),
w as (select *, v::double / total as rate, (total - v)::double / total as p, total::double as n from r),
i as (select *, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) as centre, (1.96 / (1 + 3.8416 / n)) * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) as margin from w)"""


@query(_RATES + " select rule_id, total::bigint as total, v::bigint as violations, round(rate, 6) as violation_rate, round(base_rate, 6) as base_rate, round(adv_rate, 6) as adversarial_rate, case when rate <= 0.05 then 'robust' when rate <= 0.5 then 'fragile' when rate <= 0.9 then 'weak' else 'broken' end as classification, bypasses[1] as bypass_1, bypasses[2] as bypass_2, bypasses[3] as bypass_3 from i")
def rule_robustness(spark, d):
    rules = _docs(spark, d).select(F.col("source").alias("rule_id")).distinct()
    rows = robustness.rule_scores(rules, _samples(spark, d))
    return rows.select("rule_id", "total", "violations", r6("violation_rate"), r6("base_rate"), r6("adversarial_rate"), "classification", *[F.get("bypasses", F.lit(k)).alias(f"bypass_{k + 1}") for k in range(3)])


@query(_RATES + " select rule_id, round(greatest(centre - margin, 0), 6) as ci_low, round(least(centre + margin, 1), 6) as ci_high from i")
def wilson_interval(spark, d):
    rules = _docs(spark, d).select(F.col("source").alias("rule_id")).distinct()
    return robustness.rule_scores(rules, _samples(spark, d)).select("rule_id", r6("ci_low"), r6("ci_high"))


@query(_RATES + " select (select count(*) from samples)::bigint as total_samples, (select count(*) from samples where rule_id is not null)::bigint as total_violations, round(avg(1 - rate), 6) as overall_score from i")
def robustness_report(spark, d):
    rules, samples = _docs(spark, d).select(F.col("source").alias("rule_id")).distinct(), _samples(spark, d)
    return robustness.report(robustness.rule_scores(rules, samples), samples).withColumn("overall_score", F.round("overall_score", 6))


# --- spans ---------------------------------------------------------------------------------------------------

_TOKENS = f"""{O.EVALS}, parts as (select eval_id, context, unnest(l) as part, generate_subscripts(l, 1) as pos from (select eval_id, context, regexp_extract_all(output, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') as l from evals)),
placed as (select *, sum(length(part)) over (partition by eval_id order by pos) as e from parts),
toks as (select eval_id, row_number() over (partition by eval_id order by pos) - 1 as tok_idx, e - length(part) as s, e, not list_contains(regexp_extract_all(lower(context), '[\\p{{L}}\\p{{N}}]+'), lower(part)) as hit from placed where regexp_matches(part, '^[\\p{{L}}\\p{{N}}]')),
marked as (select *, case when hit then 0.9 else 0.1 end as p1, row_number() over (partition by eval_id order by tok_idx) - sum(hit::int) over (partition by eval_id order by tok_idx) as isl from toks),
islands as (select eval_id, min(s) as s, max(e) as e, avg(p1) as p from marked where hit group by eval_id, isl)"""


def _answer_tokens(spark, d):
    return spans.unsupported_tokens(_evals(spark, d), ["eval_id"], "context", "output")


@query(f'with {_TOKENS} select eval_id, s::bigint as "start", e::bigint as "end", round(p, 6) as p from islands where p >= 0.5 and e - s >= 3')
def token_span_merge(spark, d):
    rows = spans.kept(spans.merge_tokens(_answer_tokens(spark, d), ["eval_id"]))
    return rows.select("eval_id", "start", "end", r6("p"))


@query(f"with {_TOKENS} select i.eval_id, string_agg(substr(v.output, s::int + 1, (e - s)::int) || '@' || s::bigint || '-' || e::bigint, '|' order by s) as details, count(*)::bigint as n from islands i join evals v using (eval_id) where p >= 0.5 and e - s >= 3 group by all")
def span_details(spark, d):
    """The details of a report on unsupported spans."""
    found = spans.kept(spans.merge_tokens(_answer_tokens(spark, d), ["eval_id"]))
    rows = report.span_details(found, _evals(spark, d), "output")
    shown = F.transform("details", lambda x: F.concat(x["label"], F.lit("@"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return rows.select("eval_id", F.array_join(shown, "|").alias("details"), F.size("details").cast("long").alias("n"))


_INTERVALS = """with x as (select user_id, event_id, floor(value)::bigint as s, floor(value)::bigint + 1 + event_id % 3 as e, (event_id % 10) / 10.0 as p from events),
y as (select *, max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) as reach from x),
z as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by user_id order by s, e rows unbounded preceding) as isl from y)
select user_id, min(s)::bigint as "start", max(e)::bigint as "end", round(max(p)::double, 6) as p from z group by user_id, isl"""


@query(_INTERVALS)
def interval_merge(spark, d):
    low = F.floor("value").cast("long")
    rows = table(spark, d, "events").select("user_id", low.alias("start"), (low + 1 + F.col("event_id") % 3).alias("end"), ((F.col("event_id") % 10) / 10.0).alias("p"))
    return spans.merge_intervals(rows, ["user_id"]).select("user_id", "start", "end", r6("p"))


@query(f"with {_TOKENS} select eval_id, count(*)::bigint as total_tokens, count(*) filter (where hit)::bigint as hallucinated_tokens, round(count(*) filter (where hit)::double / count(*), 6) as ratio from toks group by all")
def hallucination_score(spark, d):
    return spans.ratio(_answer_tokens(spark, d), ["eval_id"]).withColumn("ratio", F.round("ratio", 6))


@query(f'with {_TOKENS} select eval_id, greatest(s - 50, 0)::bigint as "start", (e - 50)::bigint as "end", round(p, 6) as p from islands where e > 50')
def rag_span_clip(spark, d):
    """Spans of a text whose first 50 characters are not the answer's."""
    rows = spans.merge_tokens(_answer_tokens(spark, d), ["eval_id"]).withColumn("_at", F.lit(50))
    return spans.clip(rows, "_at").select("eval_id", "start", "end", r6("p"))


# --- schemas -------------------------------------------------------------------------------------------------

EVENT_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 5, "exclusiveMaximum": 95, "not": {"enum": [42]}}}, "additionalProperties": False}
ORDER_SCHEMA = {
    "type": "object", "required": ["id", "status"],
    "properties": {"id": {"type": "integer", "minimum": 1}, "status": {"enum": ["O", "F"]}, "tags": {"type": "array", "items": {"type": "string", "minLength": 3, "maxLength": 15}, "minItems": 1, "maxItems": 2, "uniqueItems": True}},
}


@query("""select event_id, coalesce(json_extract_string(props, '$.k')::int >= 5 and json_extract_string(props, '$.k')::int < 95 and json_extract_string(props, '$.k')::int <> 42, false) as valid,
((json_extract_string(props, '$.k')::int < 5)::int + (json_extract_string(props, '$.k')::int >= 95)::int + (json_extract_string(props, '$.k')::int = 42)::int)::bigint as n_errors from events""")
def schema_flat(spark, d):
    return schemas.validate(table(spark, d, "events"), ["event_id"], "props", EVENT_SCHEMA).select("event_id", "valid", "n_errors")


@query("""with k as (select event_id, json_extract_string(props, '$.k')::int as k from events), l as (select event_id, list_filter([case when k < 5 then '/k: minimum' end, case when k >= 95 then '/k: exclusiveMaximum' end, case when k = 42 then '/k: not' end], lambda x: x is not null) as l from k)
select event_id as eval_id, array_to_string(list_sort(l), '|') as details from l where len(l) > 0""")
def schema_details(spark, d):
    """The details of a report on JSON that breaks its schema."""
    made = schemas.validate(table(spark, d, "events").withColumn("eval_id", F.col("event_id")), ["eval_id"], "props", EVENT_SCHEMA)
    rows = report.schema_details(made)
    return rows.select("eval_id", F.array_join(F.array_sort(F.transform("details", lambda x: x["label"])), "|").alias("details"))


@query("""with o as (select o_orderkey, o_orderstatus, o_orderpriority as a, case when o_orderkey % 3 = 0 then o_orderpriority else 'xx' end as b from orders),
e as (select o_orderkey, list_filter([case when o_orderkey < 1 then '/id:minimum' end, case when o_orderstatus not in ('O', 'F') then '/status:enum' end, case when a = b then '/tags:uniqueItems' end,
  case when least(length(a), length(b)) < 3 or greatest(length(a), length(b)) > 15 then '/tags/*:items' end], lambda x: x is not null) as l from o)
select o_orderkey, len(l) = 0 as valid, len(l)::bigint as n_errors, array_to_string(list_sort(l), ',') as errors from e""")
def schema_nested(spark, d):
    """Orders as nested JSON: objects, arrays and unique items."""
    rows = table(spark, d, "orders")
    tags = F.array(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.lit("x" * 2)))
    made = rows.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), tags.alias("tags"))).alias("doc"))
    return schemas.validate(made, ["o_orderkey"], "doc", ORDER_SCHEMA).select("o_orderkey", "valid", "n_errors", F.array_join(F.array_sort(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["kind"]))), ",").alias("errors"))


@query("select event_id, 1 as depth from events where props is not null")
def json_depth(spark, d):
    return table(spark, d, "events").where("props is not null").select("event_id", T.json_depth(F.col("props")).alias("depth"))


TYPED = tool_guard.Policy(
    parameters=(
        tool_guard.Parameter("view", "/k", "range", 10, 90), tool_guard.Parameter("view", "/v/0", "not_contains", text='"x'), tool_guard.Parameter("click", "/k", "allowed", values=(5, "7", None, True)),
        tool_guard.Parameter("signup", "/k", "regex", text="^[0-4n]"), tool_guard.Parameter("purchase", "/k", "regex", text="(?P<x>9"),
    )
)
_TYPES = ["json_extract_string(props, '$.k')", "'\"' || json_extract_string(props, '$.k') || '\"'", "'null'", "'true'", "'[1,\"a\"]'"]


@query(f"""with c as (select event_id, event_type as tool_name, case event_id % 6 {' '.join(f'when {i} then {t}' for i, t in enumerate(_TYPES))} end as k, event_id % 4 = 0 as x from events),
t as (select *, case when k like '"%' then substr(k, 2, length(k) - 2) else k end as s, regexp_matches(k, '^[0-9]') as num from c)
select event_id, case when tool_name = 'view' and num and k::double < 10 then 'Parameter ''/k'' in tool ''view'' is ' || k || ', which is below minimum 10' when tool_name = 'view' and num and k::double > 90 then 'Parameter ''/k'' in tool ''view'' is ' || k || ', which exceeds maximum 90'
when tool_name = 'view' and x then 'Parameter ''/v/0'' in tool ''view'' contains forbidden value ''"x''' when tool_name = 'click' and k not in ('5', '"7"', 'null', 'true') then 'Parameter ''/k'' in tool ''click'' has invalid value: ' || k
when tool_name = 'signup' and not regexp_matches(s, '^[0-4n]') then 'Parameter ''/k'' in tool ''signup'' does not match required pattern' when tool_name = 'purchase' and k is not null then 'Invalid regex pattern: (?P<x>9' end as reason from t""")
def tool_guard_types(spark, d):
    """Rules on numbers, strings, null, booleans, arrays and missing values, and a pattern that is refused."""
    rows, k = table(spark, d, "events"), F.get_json_object("props", "$.k")
    kinds = F.array(k, F.concat(F.lit('"'), k, F.lit('"')), F.lit("null"), F.lit("true"), F.lit('[1,"a"]'), F.lit(None).cast("string"))
    made = F.get(kinds, (F.col("event_id") % 6).cast("int"))
    first = F.when(F.col("event_id") % 4 == 0, '"v":["xy"]').otherwise('"v":{"0":"a"}')
    arguments = F.concat(F.lit("{"), F.coalesce(F.concat(F.lit('"k":'), made, F.lit(",")), F.lit("")), first, F.lit("}"))
    calls = rows.select("event_id", F.col("event_id").cast("string").alias("session_id"), F.lit(0).alias("call_index"), F.col("event_type").alias("tool_name"), arguments.alias("arguments"))
    return tool_guard.judge_log(calls, TYPED).select("event_id", "reason")


@query(_guard_sql(_DENY, _ALLOW, _ORDER, _PARAMS) + " select session_id, call_index, tool_name, reason, reason is null as allowed from judged")
def tool_guard_full(spark, d):
    return _guarded(spark, d, GUARD)
