"""Texts to rows of sentences, with places in bytes and characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import backends


def explode_sentences(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, idx, sentence: a row for each sentence; no shuffle."""
    return df.select(*keys, F.posexplode(T.sentences(F.col(text_col))).alias("idx", "sentence"))


def sentence_spans(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, idx, sentence, and its span start, end in UTF-8 bytes and char_start, char_end.

    A span begins after the white space that follows the sentence before; the first one keeps its own.
    """
    pieces = df.select(*keys, F.posexplode(T.raw_pieces(F.col(text_col))).alias("_pos", "_piece"))
    rest = F.ltrim("_piece", F.lit(T.WHITE))
    pieces = pieces.select(
        *keys, "_pos", T.trimmed(F.col("_piece")).alias("sentence"),
        F.octet_length("_piece").alias("_bytes"), F.length("_piece").alias("_chars"),
        F.when(F.col("_pos") > 0, F.octet_length("_piece") - F.octet_length(rest)).otherwise(0).alias("_lead"), F.when(F.col("_pos") > 0, F.length("_piece") - F.length(rest)).otherwise(0).alias("_lead_chars"),
    )
    upto = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumns({"end": F.sum("_bytes").over(upto), "char_end": F.sum("_chars").over(upto), "_full": F.sum((F.col("sentence") != "").cast("int")).over(upto)})
    placed = placed.where(F.col("sentence") != "")
    return placed.select(
        *keys, (F.col("_full") - 1).cast("int").alias("idx"), "sentence",
        (F.col("end") - F.col("_bytes") + F.col("_lead")).alias("start"), "end",
        (F.col("char_end") - F.col("_chars") + F.col("_lead_chars")).alias("char_start"), "char_end",
    )


def long_enough(claims: DataFrame, least: int = 10) -> DataFrame:
    """Claims of at least `least` bytes; they keep their index."""
    return claims.where(F.octet_length("sentence") >= least)


def token_chunks(df: DataFrame, keys: list[str], text_col: str, length: int, overlap: int) -> DataFrame:
    """keys, chunk_idx, chunk, char_offset: overlapping character windows, one every length - overlap characters."""
    stride, n = length - overlap, F.length(text_col)
    starts = F.when(n <= length, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(stride)))
    rows = df.where(n > 0).select(*keys, F.col(text_col).alias("_text"), F.posexplode(starts).alias("chunk_idx", "char_offset"))
    return rows.select(*keys, "chunk_idx", F.substring(F.col("_text"), F.col("char_offset") + 1, F.lit(length)).alias("chunk"), "char_offset")


def packed(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of runs of sentences of at most `most` tokens, or of one that is longer.

    A run begins with the shortest end of the run before it that has `overlap` tokens, at least its last sentence,
    and always goes on to a new sentence.
    """
    total = np.append(0, np.cumsum(np.asarray(sizes, np.int64)))
    out, first, end = [], 0, 0
    while end < len(sizes):
        end = max(end + 1, int(np.searchsorted(total, total[first] + most, "right")) - 1)
        out.append((first, end))
        first = max(first, min(end - 1, int(np.searchsorted(total, total[end] - overlap, "right")) - 1))
    return out


def budget_chunks(df: DataFrame, keys: list[str], text_col: str, make: Callable[[], Callable], key: str, most: int, overlap: int) -> DataFrame:
    """keys, chunk_idx, chunk: runs of whole sentences within a budget of tokens, a blank between them; null texts have none.

    `make` gives a counter (texts to numbers of tokens) in a worker. A text within the budget, one without a sentence,
    and any text where `most` is 0, is its only chunk, as it stands.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = backends.once(key, make)
        for frame in frames:
            whole, rows = count(frame["_text"].tolist()), []
            for own, text, sentences, n in zip(frame[keys].itertuples(index=False, name=None), frame["_text"], frame["_sentences"], whole, strict=True):
                listed = list(sentences)
                if not most or n <= most or not listed:
                    rows.append((*own, 0, text))
                else:
                    rows += [(*own, i, " ".join(listed[a:b])) for i, (a, b) in enumerate(packed(count(listed), most, overlap))]
            yield pd.DataFrame(rows, columns=[*keys, "chunk_idx", "chunk"])

    texts = df.where(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).alias("_text"), T.sentences(F.col(text_col)).alias("_sentences"))
    return texts.mapInPandas(run, f"{kinds}, chunk_idx int, chunk string")
