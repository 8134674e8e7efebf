"""Token predictions to spans: islands of tokens, merged intervals, ratios, clipping to an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import claims

#: Where letters and digits meet anything else.
TOKEN_EDGE = r"(?<=[\p{L}\p{N}])(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?=[\p{L}\p{N}])"


def tokens(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, tok_idx, token, start, end (characters) of the runs of letters and digits in a text."""
    parts = df.select(*keys, F.posexplode(F.array_remove(F.split(F.col(text_col), TOKEN_EDGE, -1), "")).alias("_pos", "_part"))
    upto = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("end", F.sum(F.length("_part")).over(upto)).withColumn("_word", F.col("_part").rlike(r"^[\p{L}\p{N}]"))
    placed = placed.withColumn("_n", F.sum(F.col("_word").cast("int")).over(upto)).where("_word")
    return placed.select(*keys, (F.col("_n") - 1).cast("int").alias("tok_idx"), F.col("_part").alias("token"), (F.col("end") - F.length("_part")).alias("start"), "end")


def unsupported_tokens(answers: DataFrame, keys: list[str], context_col: str, answer_col: str) -> DataFrame:
    """tokens of the answer with class 1 and probability 0.9 where the context lacks the word, else 0 and 0.1."""
    known = answers.select(*keys, F.array_distinct(F.array_remove(F.split(F.lower(context_col), r"[^\p{L}\p{N}]+", -1), "")).alias("_known"))
    rows = tokens(answers, keys, answer_col).join(known, keys)
    missing = ~F.array_contains("_known", F.lower("token"))
    return rows.select(*keys, "tok_idx", "token", "start", "end", missing.cast("int").alias("cls"), F.when(missing, 0.9).otherwise(0.1).alias("p1"))


def merge_tokens(rows: DataFrame, keys: list[str], target: int = 1) -> DataFrame:
    """keys, start, end, p of runs of target tokens, p being their mean; tokens of no width do not break a run."""
    wide = rows.where(F.col("end") > F.col("start"))
    order = Window.partitionBy(*keys).orderBy("tok_idx")
    hit = (F.col("cls") == target).cast("int")
    marked = wide.withColumns({"_island": F.row_number().over(order) - F.sum(hit).over(order), "_hit": hit}).where("_hit = 1")
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("p1").alias("p")).drop("_island")


def merge_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, p of intervals made one where they overlap or touch, p being the largest.

    Nulls sort last: an interval without a start joins the last one of its keys if any there has an end, else it stays alone.
    Both windows share one sort, so intervals of equal places keep their order between them and ties change nothing.
    """
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("_fresh", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    island = fresh.withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("p").alias("p")).drop("_island")


def kept(spans: DataFrame, threshold: float = 0.5, least: int = 3) -> DataFrame:
    """Spans that are sure and long enough."""
    return spans.where((F.col("p") >= threshold) & (F.col("end") - F.col("start") >= least))


def ratio(rows: DataFrame, keys: list[str], target: int = 1) -> DataFrame:
    """keys, total_tokens, hallucinated_tokens and their ratio."""
    hit = F.count(F.when((F.col("cls") == target) & (F.col("end") > F.col("start")), 1))
    return rows.groupBy(*keys).agg(F.count("*").alias("total_tokens"), hit.alias("hallucinated_tokens"), (hit / F.count("*")).alias("ratio"))


def clip(spans: DataFrame, answer_start: str) -> DataFrame:
    """Spans of a text of context, question and answer, as far as they lie in the answer and counted from its start."""
    at = F.col(answer_start)
    return spans.where(F.col("end") > at).withColumns({"start": F.greatest(F.col("start") - at, F.lit(0)), "end": F.col("end") - at})


def rag_text(context, question, answer):
    """(text, answer_start) Columns of context, question and answer put together; an empty question leaves no blank."""
    asked = F.coalesce(question, F.lit(""))
    head = F.when(asked == "", F.concat(context, F.lit(" "))).otherwise(F.concat(context, F.lit(" "), asked, F.lit(" ")))
    return F.concat(head, answer), F.length(head)


def detect_rag(rows: DataFrame, keys: list[str], scored_tokens: DataFrame, threshold: float = 0.5, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(spans in the answer, ratio over the whole text) from the tokens of rag_text; rows has keys and answer_start."""
    found = kept(merge_tokens(scored_tokens, keys), threshold, least).join(rows.select(*keys, "answer_start"), keys)
    return clip(found, "answer_start").drop("answer_start"), ratio(scored_tokens, keys)


def chunked_tokens(df: DataFrame, keys: list[str], text_col: str, length: int, overlap: int, predict) -> DataFrame:
    """keys, chunk_idx, tok_idx, start, end, cls, p1: predictions on overlapping chunks of long texts, in places of the whole text.

    `predict` takes rows of keys, chunk_idx and chunk and gives keys, chunk_idx, tok_idx, start, end, cls, p1 with places in the chunk.
    """
    parts = claims.token_chunks(df, keys, text_col, length, overlap)
    told = predict(parts.select(*keys, "chunk_idx", "chunk"))
    placed = told.join(parts.select(*keys, "chunk_idx", "char_offset"), [*keys, "chunk_idx"])
    return placed.withColumns({"start": F.col("start") + F.col("char_offset"), "end": F.col("end") + F.col("char_offset")}).drop("char_offset")


def detect(df: DataFrame, keys: list[str], text_col: str, predict, length: int = 4096, overlap: int = 256, threshold: float = 0.5, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(spans, ratio) of texts of any length.

    A text of one chunk has its runs of target tokens as spans, with their mean; of a longer one the target tokens of all
    chunks are merged where they overlap or touch, with the largest probability, and tokens of overlaps count twice in the ratio.
    """
    rows = chunked_tokens(df, keys, text_col, length, overlap, predict)
    long = df.where(F.length(text_col) > length).select(*keys)
    whole = kept(merge_tokens(rows.join(long, keys, "left_anti"), keys), threshold, least)
    hits = rows.join(long, keys, "left_semi").where((F.col("cls") == 1) & (F.col("end") > F.col("start")))
    merged = kept(merge_intervals(hits.select(*keys, "start", "end", F.col("p1").alias("p")), keys), threshold, least)
    return whole.unionByName(merged), ratio(rows, keys)
