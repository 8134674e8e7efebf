"""Operator 5: quality rules with host-level verdicts.

Each document gets its rule measures; failures are aggregated by host, each host's failure rate is shrunk
with a beta prior whose two parameters come from the hosts' own rates (method of moments), and the host's
verdict is joined back to its documents.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows give
a row each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import store

#: Words in a window, and the hosts' limit: a host fails if its shrunk failure rate is above it.
WINDOW, HOST_LIMIT = 5, 0.5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words; the last size - 1 words start none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = K.mix(out ^ words[i : i + n])
    return out


def repeated_windows(number: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Where windows of `size` words start that stand twice or more in their text; equal numbers are equal words."""
    n = len(number) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = np.flatnonzero(text[:n] == text[size - 1 :])
    keys = window_hashes(number.astype(np.uint64), size)[hit] ^ K.mix(text[hit].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    near = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    one, two = hit[order[near]], hit[order[near + 1]]
    same = text[one] == text[two]
    for i in range(size):
        same &= number[one + i] == number[two + i]
    if not same.all():  # different windows of one hash: told apart one by one
        places: dict = {}
        for k in hit.tolist():
            places.setdefault((int(text[k]), *number[k : k + size].tolist()), []).append(k)
        return np.array(sorted(k for v in places.values() if len(v) > 1 for k in v), np.int64)
    return np.unique(np.concatenate([one, two]))


def measures(buf: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the texts of a slice."""
    n = len(at) - 1
    if not len(buf):
        return [np.zeros(n, np.int64) for _ in range(5)]
    inside = ~K.WHITE[buf]
    starts, ends = K.word_spans(buf, at, inside)
    text = np.searchsorted(at, starts, side="right") - 1
    n_words = np.bincount(text, minlength=n)
    word_chars = K.per_text(at, inside & K.code_points(buf))
    n_symbols = K.per_text(at, _SYMBOL[buf])
    hit = repeated_windows(K.distinct_spans(buf, starts, ends), text, WINDOW)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    n_repeat = np.bincount(text, weights=np.cumsum(cover)[:-1] > 0, minlength=n).astype(np.int64)
    breaks = np.flatnonzero(buf == 0x0A)
    lo = np.sort(np.concatenate([at[:-1][np.diff(at) > 0], breaks + 1]))
    hi = np.sort(np.concatenate([at[1:][np.diff(at) > 0], breaks]))
    running = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(inside, out=running[1:])
    worded = running[hi] > running[lo]
    lo, hi = lo[worded], hi[worded]
    line_text = np.searchsorted(at, lo, side="right") - 1
    _, first = np.unique(K.distinct_spans(buf, lo, hi, line_text), return_index=True)
    n_dup = np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each document: id, host, the measures and base_failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("quality_rules")
        for batch in K.bounded(batches):
            parts = [measures(buf, at) for _, _, buf, at in K.slices(batch.column(2))]
            found = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5)]
            failed = (found[0] < 10) | (100 * found[4] > 20 * found[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x.astype(np.int64)) for x in found], pa.array(failed)], names=["id", "host", *NAMES, "base_failed"])

    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, host_col)]
    return docs.select(id_col, host_col, text_col).mapInArrow(run, f"id {kinds[0]}, host {kinds[1]}, {', '.join(f'{x} long' for x in NAMES)}, base_failed boolean")


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failures, shrunk rate and host_failed; the prior's mean and weight come from all hosts."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    total = hosts.agg((F.sum("failures") / F.sum("n")).alias("_mean"), F.sum(F.col("n") * rate * rate).alias("_square"), F.sum("n").alias("_n"), F.count("*").alias("_hosts"))
    mean, spread = F.col("_mean"), F.col("_square") / F.col("_n") - F.col("_mean") * F.col("_mean")
    weight = F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.when(spread > 1e-12, mean * (1 - mean) / spread - 1).otherwise(F.lit(1e6))))
    prior = total.select(mean.alias("_mean"), weight.alias("_weight"))  # one row
    shrunk = (F.col("_mean") * F.col("_weight") + F.col("failures")) / (F.col("_weight") + F.col("n"))
    return hosts.join(F.broadcast(prior)).select("host", "n", "failures", shrunk.alias("rate"), (shrunk > limit).alias("host_failed"))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """A row for each document: id, the measures, base_failed, kept and its host's rate."""
    measured = store.write(measure(docs, id_col, text_col, host_col), "rules")
    hosts = host_verdicts(measured, limit).select(F.col("host").alias("_host"), "rate", "host_failed")
    both = measured.join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    return both.select(F.col("id").alias(id_col), *NAMES, "base_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), F.col("rate").alias("host_rate"))
