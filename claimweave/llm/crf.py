"""Operator 3: document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's score comes from its own features and those of the lines beside it;
neighbouring labels are coupled. Forward-backward marginals, weighted by line length, give the document's
share of good text, which a two-parameter logistic map turns into its score.

The model is fitted on at most TRAIN_DOCUMENTS labelled documents of at most TRAIN_LINES lines, none of them
held out; its inputs are features of the text alone. Everything else covers all rows and whole texts.

Defined results: null and empty texts get the score of a document without good text; repeated rows give a
row each; an empty table gives an empty result, without labels every score is 0.5; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

TRAIN_DOCUMENTS, TRAIN_LINES, EPOCHS = 4000, 512, 150
HELD_OUT_OF, THRESHOLD = 5, 0.3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>!=@^~{}[]_\\/", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".!?", np.uint8)] = True
N_OWN = 14


def line_features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, text, bytes) of the lines with a word, in order, over the texts of a slice."""
    if not len(buf):
        return np.zeros((0, N_OWN)), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~K.WHITE[buf]
    breaks = np.flatnonzero(buf == 0x0A)
    full = np.diff(at) > 0
    lo = np.sort(np.concatenate([at[:-1][full], breaks + 1]))
    hi = np.sort(np.concatenate([at[1:][full], breaks]))

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[hi] - total[lo]

    n_inside = per_line(inside)
    keep = n_inside > 0
    lo, hi, n_inside = lo[keep], hi[keep], n_inside[keep].astype(float)
    text = np.searchsorted(at, lo, side="right") - 1
    starts, ends = K.word_spans(buf, at, inside)
    words = np.searchsorted(starts, hi) - np.searchsorted(starts, lo)
    line = np.searchsorted(lo, starts, side="right") - 1
    hashes = K.span_hashes(buf, starts, ends)
    same = np.zeros(len(starts))
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    keyed = hashes ^ K.mix(line.astype(np.uint64))
    _, first = np.unique(keyed, return_index=True)
    distinct = np.bincount(line[first], minlength=len(lo))
    whole = K.span_hashes(buf, lo, hi) ^ K.mix(text.astype(np.uint64))
    _, kind, copies = np.unique(whole, return_inverse=True, return_counts=True)
    symbol, letter = per_line(_SYMBOL[buf]), np.maximum(per_line(_LETTER[buf] & K.code_points(buf)), 1)
    upper = per_line(_UPPER[buf])
    long_word = np.bincount(line, weights=(ends - starts) > 20, minlength=len(lo))
    stops = per_line(_STOP[buf])
    digits = per_line((buf >= 48) & (buf <= 57))
    pairs = _pair_repeats(hashes, line, len(lo))
    out = np.stack(
        [
            np.ones(len(lo)),
            np.log1p(n_inside) / 8,
            np.minimum(symbol / n_inside * 4, 2),
            np.minimum(symbol / words, 3) / 3,
            upper / letter,
            np.bincount(line, weights=same, minlength=len(lo)) / words,
            1 - distinct / words,
            pairs / words,
            np.minimum(np.log2(copies[kind]), 4) / 4,
            np.minimum(digits / n_inside * 4, 2),
            np.minimum(n_inside / words / 10, 2),
            long_word / words,
            np.minimum(stops / words * 4, 2),
            (words <= 3).astype(float),
        ],
        axis=1,
    )
    return out, text, hi - lo


def _pair_repeats(hashes: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """Word pairs of a line that occur there before."""
    if len(hashes) < 2:
        return np.zeros(n)
    own = line[1:] == line[:-1]
    keys = (K.mix(hashes[1:] + np.uint64(7)) ^ hashes[:-1])[own] ^ K.mix(line[1:][own].astype(np.uint64) + np.uint64(3))
    _, first = np.unique(keys, return_index=True)
    every = np.bincount(line[1:][own], minlength=n)
    return (every - np.bincount(line[1:][own][first], minlength=n)).astype(float)


def with_neighbours(own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its text, and whether there are any."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = text[1:] == text[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after], axis=1)


@dataclass
class Model:
    """Weights of the field: emission of `good` against `bad`, coupling of neighbours, and the map to a score."""

    emission: np.ndarray
    transition: np.ndarray
    slope: float
    shift: float


def marginals(emission: np.ndarray, transition: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and expected transitions summed over all, by forward-backward.

    All texts take a step at once, the longest first, so the loop is as long as the longest text has lines.
    """
    n = len(text)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0]), side="left")
    potential = np.exp(np.stack([np.zeros(n), np.clip(emission, -30, 30)], axis=1))
    potential /= potential.sum(axis=1, keepdims=True)
    step = np.exp(transition)
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    forward[first] = potential[first]
    forward[first] /= forward[first].sum(axis=1, keepdims=True)
    for t in range(1, size[0]):
        at = first[: live[t]] + t
        f = (forward[at - 1] @ step) * potential[at]
        forward[at] = f / f.sum(axis=1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(size[0] - 1, 0, -1):
        at = first[: live[t]] + t
        b = (potential[at] * backward[at]) @ step.T
        joint = forward[at - 1][:, :, None] * step * (potential[at] * backward[at])[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
    good = forward * backward
    return good[:, 1] / good.sum(axis=1), expected


def document_share(good: np.ndarray, text: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; 0 for texts without a line."""
    weight = np.bincount(text, weights=size, minlength=n)
    return np.bincount(text, weights=size * good, minlength=n) / np.maximum(weight, 1)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(own: np.ndarray, text: np.ndarray, size: np.ndarray, quality: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Maximises the likelihood of the lines' labels (their document's) with Adam, then fits the map to a score."""
    x, n = with_neighbours(own, text), len(quality)
    y = quality[text].astype(float)
    pairs = text[1:] == text[:-1]
    seen = np.array([[np.sum(pairs & (y[:-1] == a) & (y[1:] == b)) for b in (0, 1)] for a in (0, 1)], float)
    weight, step = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (weight, step)]
    for k in range(1, epochs + 1):
        good, expected = marginals(x @ weight, step, text)
        slopes = [x.T @ (y - good) / len(y) - 1e-4 * weight, (seen - expected) / len(y) - 1e-3 * step]
        for v, g, (m, s) in zip((weight, step), slopes, moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    good, _ = marginals(x @ weight, step, text)
    share = _logit(document_share(good, text, size, n))
    a, b = 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))
        d = quality - p
        a += 0.05 * float(np.mean(d * share)) - 0.0005 * (a - 1)
        b += 0.1 * float(np.mean(d))
    return Model(weight, step, a, b)


def score_slice(model: Model | None, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of the texts of a slice."""
    n = len(at) - 1
    if model is None:
        return np.full(n, 0.5)
    own, text, size = line_features(buf, at)
    good, _ = marginals(with_neighbours(own, text) @ model.emission, model.transition, text)
    return 1 / (1 + np.exp(-np.clip(model.slope * _logit(document_share(good, text, size, n)) + model.shift, -30, 30)))


def remainder(column) -> F.Column:
    """crc32 of the id as text, modulo HELD_OUT_OF."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(HELD_OUT_OF))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCUMENTS) -> Model | None:
    """The model of a bounded sample: the `most` labelled documents that are first in hash order and not held out."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    chosen = chosen.groupBy(id_col).agg(F.max("quality").alias("_quality")).orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(chosen), id_col)  # `most` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("crf")
        for batch in K.bounded(batches):
            for lo, hi, buf, at in K.slices(batch.column(1)):
                own, text, size = line_features(buf, at)
                short = np.bincount(text, minlength=hi - lo) <= TRAIN_LINES
                some = short[text]
                own, text, size = own[some], text[some], size[some]
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                blobs = [own[a:b].astype(np.float32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                sizes = [size[a:b].astype(np.int64).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo).cast(pa.int64()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())], names=["id", "quality", "own", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select(id_col, text_col, "_quality").mapInArrow(run, f"id {kind}, quality long, own binary, size binary").toPandas()
    found = found[found["own"].map(len) > 0].sort_values(["id", "quality"], kind="stable")
    if found["quality"].nunique() < 2:
        return None
    own = [np.frombuffer(b, np.float32).reshape(-1, N_OWN).astype(float) for b in found["own"]]
    text = np.repeat(np.arange(len(own)), [len(x) for x in own])
    size = np.concatenate([np.frombuffer(b, np.int64) for b in found["size"]])
    return fit(np.concatenate(own), text, size, found["quality"].to_numpy())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("crf")
        for batch in K.bounded(batches):
            found = [score_slice(model, buf, at) for _, _, buf, at in K.slices(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["id", "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col), (remainder(F.col(id_col)) == 0).alias("_held"), F.col(text_col)).mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("crf")
        for batch in K.bounded(batches):
            found = [score_slice(model, buf, at) for _, _, buf, at in K.slices(batch.column(where))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= threshold))

    return docs.mapInArrow(run, docs.schema)
