"""The text functions under SQL names: temporary functions whose bodies are SQL, so they are planned as expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as T


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    """Function name to its signature and body."""
    sentences = f"filter(transform(split(t, {_quoted(T.SENTENCE_END)}, -1), p -> btrim(p, {_quoted(T.WHITE)})), s -> s <> '')"
    flat = f"btrim(regexp_replace(lower(t), {_quoted(chr(40) + '?U)' + chr(92) + 's++')}, ' '), ' ')"
    marks = " or ".join(f"contains(t, {_quoted(m)})" for m in T.COMPOUND)
    return {
        "claim_sentences": f"(t string) returns array<string> return {sentences}",
        "claim_normalized": f"(t string) returns string return btrim({flat}, {_quoted(T.STRIPPED)})",
        "claim_is_compound": f"(t string) returns boolean return {marks}",
        "claim_adaptive_k": "(t string, k int) returns int return case when k = 0 then 0 else least(greatest(cast(ceil(length(t) / 40) as int), 3), k) end",
        "claim_input_hash": "(context string, question string, answer string) returns string return sha2(concat_ws('|', coalesce(context, ''), coalesce(question, ''), coalesce(answer, '')), 256)",
        "vector_cosine": "(a array<double>, b array<double>) returns double return try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))",
        "claims_of": f"(t string) returns table (idx int, sentence string) return select pos, col from posexplode({sentences})",
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; their names."""
    found = definitions()
    for name, body in found.items():
        spark.sql(f"create or replace temporary function {name} {body}")
    return list(found)
