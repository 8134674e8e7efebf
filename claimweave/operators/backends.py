"""Model backends behind Arrow batches: each worker loads a model once and scores batches of a fixed size.

A model is a function of a list of inputs; `onnx_classifier` makes one of an exported sequence classifier.
Pairs are scored once each however often they occur, and sorted by length so that padding stays small.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANONICAL = ("entailment", "neutral", "contradiction")
_models: dict[str, Callable] = {}


def softmax(logits: np.ndarray) -> np.ndarray:
    """Rows of logits as probabilities."""
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def label_order(id2label: dict) -> list[int]:
    """Where entailment, neutral and contradiction stand in a model's output, by name."""
    at = {str(v).lower(): int(k) for k, v in id2label.items()}
    return [at[name] for name in CANONICAL]


def longest_input(config: dict, default: int = 512) -> int:
    """Tokens that a model takes; models of the RoBERTa kind reserve two positions."""
    n = int(config.get("max_position_embeddings", default))
    return n - 2 if config.get("model_type") in ("roberta", "xlm-roberta", "camembert") else n


def once(key: str, make: Callable[[], Callable]) -> Callable:
    """A model that a worker process makes on first use."""
    if key not in _models:
        _models[key] = make()
    return _models[key]


def onnx_classifier(folder: str) -> Callable[[list[str], list[str]], np.ndarray]:
    """Scores (premises, hypotheses) with model.onnx, tokenizer.json and config.json of a folder."""
    import onnxruntime
    from tokenizers import Tokenizer

    config = json.loads(Path(folder, "config.json").read_text())
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # partitions give the parallelism
    options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
    session = onnxruntime.InferenceSession(str(Path(folder, "model.onnx")), options)
    tokenizer = Tokenizer.from_file(str(Path(folder, "tokenizer.json")))
    tokenizer.enable_truncation(longest_input(config))
    tokenizer.enable_padding(pad_id=config.get("pad_token_id") or 0)
    names, order = {i.name for i in session.get_inputs()}, label_order(config["id2label"])

    def score(premises: list[str], hypotheses: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch(list(zip(premises, hypotheses, strict=True)))
        feed = {"input_ids": [x.ids for x in found], "attention_mask": [x.attention_mask for x in found], "token_type_ids": [x.type_ids for x in found]}
        out = session.run(None, {k: np.array(v, np.int64) for k, v in feed.items() if k in names})[0]
        return softmax(np.asarray(out, np.float64))[:, order]

    return score


def mean_pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Token vectors averaged over the mask and made of length one."""
    weight = mask[:, :, None].astype(np.float64)
    mean = (hidden * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def score_texts(pairs: DataFrame, make: Callable[[], Callable], key: str, batch: int = 16) -> DataFrame:
    """The distinct ctx and claim of pairs, and e, n, c of the model that `make` makes in a worker."""
    distinct = pairs.select("ctx", "claim").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(key, make)
        for frame in frames:
            frame = frame.iloc[np.argsort(frame["ctx"].str.len().to_numpy() + frame["claim"].str.len().to_numpy(), kind="stable")]
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                p = np.asarray(model(part["ctx"].tolist(), part["claim"].tolist()))
                yield part.assign(e=p[:, 0], n=p[:, 1], c=p[:, 2])

    return distinct.mapInPandas(run, "ctx string, claim string, e double, n double, c double")


def score_pairs(pairs: DataFrame, make: Callable[[], Callable], key: str, batch: int = 16) -> DataFrame:
    """pairs (with ctx and claim) and e, n, c of the model that `make` makes in a worker."""
    return pairs.join(score_texts(pairs, make, key, batch), ["ctx", "claim"]).select(*pairs.columns, "e", "n", "c")


def embed_texts(df: DataFrame, column: str, name: str, make: Callable[[], Callable], key: str, batch: int = 64) -> DataFrame:
    """df with `name`_v, the vector that a model (a function of texts to an array of rows) gives each distinct text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(key, make)
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                yield part.assign(v=list(np.asarray(model(part["_text"].tolist()), np.float64)))

    told = df.select(F.col(column).alias("_text")).where("_text is not null").distinct().mapInPandas(run, "_text string, v array<double>")
    return df.join(told.withColumnRenamed("v", f"{name}_v"), F.col(column) == F.col("_text"), "left").drop("_text")


def onnx_embedder(folder: str) -> Callable[[list[str]], np.ndarray]:
    """Mean-pooled vectors of length one from model.onnx, tokenizer.json and config.json of a folder."""
    import onnxruntime
    from tokenizers import Tokenizer

    config = json.loads(Path(folder, "config.json").read_text())
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    session = onnxruntime.InferenceSession(str(Path(folder, "model.onnx")), options)
    tokenizer = Tokenizer.from_file(str(Path(folder, "tokenizer.json")))
    tokenizer.enable_truncation(longest_input(config))
    tokenizer.enable_padding(pad_id=config.get("pad_token_id") or 0)
    names = {i.name for i in session.get_inputs()}

    def embed(texts: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch(texts)
        feed = {"input_ids": [x.ids for x in found], "attention_mask": [x.attention_mask for x in found], "token_type_ids": [x.type_ids for x in found]}
        feed = {k: np.array(v, np.int64) for k, v in feed.items()}
        return mean_pooled(session.run(None, {k: v for k, v in feed.items() if k in names})[0], feed["attention_mask"])

    return embed


def classify_tokens(texts: DataFrame, keys: list[str], text_col: str, make: Callable[[], Callable], key: str, batch: int = 32) -> DataFrame:
    """keys, tok_idx, start, end, cls, p1 of a token model: a function of texts to lists of (start, end, probability)."""
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(key, make)
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                rows = [(*own, i, s, e, int(p >= 0.5), float(p)) for own, found in zip(part[keys].itertuples(index=False, name=None), model(part["_text"].tolist()), strict=True) for i, (s, e, p) in enumerate(found)]
                yield pd.DataFrame(rows, columns=[*keys, "tok_idx", "start", "end", "cls", "p1"])

    return texts.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInPandas(run, f"{kinds}, tok_idx long, start long, end long, cls int, p1 double")


def tokenizer(path: str) -> Callable:
    """`make` of a tokenizer from its tokenizer.json."""

    def make():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return make


def token_counter(make: Callable[[], Callable]) -> Callable:
    """`make` of a function of texts to their numbers of tokens, without special ones."""

    def counter():
        found = make()
        return lambda texts: [len(x.ids) for x in found.encode_batch(texts, add_special_tokens=False)]

    return counter


def tokenize(texts: DataFrame, keys: list[str], text_col: str, make: Callable[[], Callable], key: str, most: int = 512, special: bool = True) -> DataFrame:
    """keys, ids, starts, ends (characters), n_tokens: the first `most` tokens of each text, and how many it has; a null text is empty."""
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = once(key, make)
        for frame in frames:
            told = found.encode_batch(frame["_text"].tolist(), add_special_tokens=special)
            at = [x.offsets[:most] for x in told]
            yield frame[keys].assign(ids=[x.ids[:most] for x in told], starts=[[s for s, _ in x] for x in at], ends=[[e for _, e in x] for x in at], n_tokens=[len(x.ids) for x in told])

    rows = texts.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInPandas(run, f"{kinds}, ids array<int>, starts array<int>, ends array<int>, n_tokens long")


def decode(rows: DataFrame, keys: list[str], ids_col: str, make: Callable[[], Callable], key: str, skip_special: bool = True) -> DataFrame:
    """keys, text of lists of token ids; a null list gives null."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = once(key, make)
        for frame in frames:
            yield frame[keys].assign(text=[None if x is None else found.decode([int(i) for i in x], skip_special_tokens=skip_special) for x in frame["_ids"]])

    return rows.select(*keys, F.col(ids_col).alias("_ids")).mapInPandas(run, f"{kinds}, text string")
