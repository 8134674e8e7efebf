"""Evaluation requests: from conversations, and checks of raw requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_CONTEXT_BYTES, MAX_OUTPUT_BYTES = 500_000, 50_000


def from_conversations(turns: DataFrame) -> DataFrame:
    """eval_id, chunks, context, output: each assistant turn, with the turns before it as its context."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.struct(F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.withColumn("chunks", F.collect_list(chunk).over(before)).where(F.col("role") == "assistant")
    return rows.select(
        (F.col("conv_id") * (1 << 31) + F.col("turn")).alias("eval_id"), "conv_id", "turn", "chunks",
        F.array_join(F.transform("chunks", lambda c: c["text"]), "\n\n").alias("context"), F.coalesce("text", F.lit("")).alias("output"),
    )


def request_error(context: str = "context", output: str = "output", granularity: str | None = None, most: tuple[int, int] = (MAX_CONTEXT_BYTES, MAX_OUTPUT_BYTES)):
    """Why a request is rejected, or null."""
    out = F.when(F.trim(context) == "", "empty_context").when(F.trim(output) == "", "empty_output")
    out = out.when(F.octet_length(context) > most[0], "context_too_large").when(F.octet_length(output) > most[1], "output_too_large")
    if granularity:
        out = out.when(F.col(granularity).isNotNull() & (F.col(granularity) != "sentence"), "unsupported_granularity")
    return out


REQUEST = "struct<context:array<struct<id:string,text:string>>,question:string,output:string,granularity:string,top_k:int,adaptive_top_k:boolean>"


def from_requests(lines: DataFrame, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(requests, rejected) of a table or stream of request JSON, one to a row.

    requests has chunks, context (their texts with an empty line between), question, output, top_k, adaptive_top_k;
    rejected has the text and why. A text that is no JSON object is malformed.
    """
    told = lines.select(F.col(text_col).alias("request"), F.from_json(text_col, REQUEST, {"mode": "PERMISSIVE"}).alias("_r"), F.try_parse_json(text_col).alias("_v"))
    chunks = F.coalesce("_r.context", F.array().cast("array<struct<id:string,text:string>>"))
    rows = told.select(
        "request", "_v", chunks.alias("chunks"), F.array_join(F.transform(chunks, lambda c: F.coalesce(c["text"], F.lit(""))), "\n\n").alias("context"),
        F.col("_r.question").alias("question"), F.coalesce("_r.output", F.lit("")).alias("output"), F.col("_r.granularity").alias("granularity"), F.col("_r.top_k").alias("top_k"), F.col("_r.adaptive_top_k").alias("adaptive_top_k"),
    )
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    checked = rows.withColumn("error", F.when(~is_object, "malformed").otherwise(request_error(granularity="granularity"))).drop("_v")
    return checked.where("error is null").drop("request", "granularity", "error"), checked.where("error is not null").select("request", "error")
