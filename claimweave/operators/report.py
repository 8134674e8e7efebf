"""Reports: module results of an evaluation rolled up, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

DETAIL = "struct<kind:string,label:string,confidence:double,start:bigint,end:bigint>"
RESULT = f"struct<module:string,score:double,threshold:double,passed:boolean,details:array<{DETAIL}>>"
SCHEMA = f"version string, created string, input_hash string, models map<string,string>, results array<{RESULT}>, all_passed boolean"


def module_result(rows: DataFrame, module: str, score: Column, threshold: float, details: Column | None = None) -> DataFrame:
    """eval_id, module, score, threshold, passed, details."""
    own = details if details is not None else F.array().cast(f"array<{DETAIL}>")
    return rows.select("eval_id", F.lit(module).alias("module"), score.cast("double").alias("score"), F.lit(float(threshold)).alias("threshold"), (score >= threshold).alias("passed"), own.alias("details"))


def verdict_details(judged: DataFrame) -> DataFrame:
    """eval_id, details of its claims, in order."""
    sure = F.when(F.col("label") == "contradiction", F.col("c")).when(F.col("label") == "neutral", F.col("n")).otherwise(F.col("e"))
    one = F.struct(F.lit("claim").alias("kind"), F.col("label"), sure.alias("confidence"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    rows = judged.groupBy("eval_id").agg(F.array_sort(F.collect_list(F.struct(F.col("claim_idx"), one.alias("d")))).alias("_d"))
    return rows.select("eval_id", F.transform("_d", lambda x: x["d"]).alias("details"))


def span_details(spans: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """eval_id, details of the spans (eval_id, start, end, p) found in a text, in order; the label is the span's text."""
    one = F.struct(F.lit("span").alias("kind"), F.substring(F.col(text_col), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("label"), F.col("p").alias("confidence"), F.col("start"), F.col("end"))
    rows = spans.join(texts.select("eval_id", text_col), "eval_id").groupBy("eval_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", one.alias("d")))).alias("_d"))
    return rows.select("eval_id", F.transform("_d", lambda x: x["d"]).alias("details"))


def schema_details(validated: DataFrame) -> DataFrame:
    """eval_id, details of the errors of a validated JSON text; the label is the path and the keyword broken."""
    none = F.lit(None).cast("long")
    one = F.transform("errors", lambda e: F.struct(F.lit("schema").alias("kind"), F.concat_ws(": ", e["path"], e["kind"]).alias("label"), F.lit(None).cast("double").alias("confidence"), none.alias("start"), none.alias("end")))
    return validated.where(F.size("errors") > 0).select("eval_id", one.alias("details"))


def reports(evals: DataFrame, results: DataFrame, version: str, models: dict[str, str] | None = None, created: str | None = None, question: Column | None = None) -> DataFrame:
    """A report for each evaluation: its input's hash, its module results in order of name, all_passed (true without results)."""
    one = F.struct("module", "score", "threshold", "passed", "details")
    rolled = results.groupBy("eval_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["module"] < b["module"], -1).when(a["module"] > b["module"], 1).otherwise(0)).alias("results"))
    pairs = [F.lit(x) for kv in sorted((models or {}).items()) for x in kv]
    held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    out = evals.select("eval_id", T.input_hash(F.col("context"), question if question is not None else F.lit(""), F.col("output")).alias("input_hash")).join(rolled, "eval_id", "left")
    results_ = F.coalesce("results", F.array().cast(f"array<{RESULT}>"))
    return out.select(
        "eval_id", F.lit(version).alias("version"), F.lit(created).cast("string").alias("created"), "input_hash", held.alias("models"),
        results_.alias("results"), F.forall(results_, lambda r: r["passed"]).alias("all_passed"),
    )


def to_json(rows: DataFrame) -> DataFrame:
    """eval_id, json of each report."""
    return rows.select("eval_id", F.to_json(F.struct(*[c for c in rows.columns if c != "eval_id"])).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Reports of their JSON."""
    return rows.select("eval_id", F.from_json("json", SCHEMA).alias("_r")).select("eval_id", "_r.*")
