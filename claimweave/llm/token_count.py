"""Operator 7: token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces; in each piece the lowest-ranked adjacent pair is popped from a heap and
merged in a doubly linked list of symbols until no mergeable pair is left. The count is the initial
symbols less the merges; no identifiers are emitted. A piece met before is looked up in a bounded table.

Defined results: a null text has 0 bytes and 0 tokens; a repeated row gives a row each; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import pretokens as P

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 as is, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The merges of a byte-level vocabulary file: (left, right) symbol pair to (rank, merged symbol)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, alphabet = data["model"], byte_alphabet()
        vocab = model["vocab"]
        self.byte_symbol = [0] * 256
        for char, byte in alphabet.items():
            self.byte_symbol[byte] = vocab[char]
        self.special = [t["content"] for t in data.get("added_tokens") or []]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))

    def count(self, piece: bytes) -> int:
        """Symbols left after all merges of the piece."""
        symbols = [self.byte_symbol[b] for b in piece]
        n, pairs = len(symbols), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, found[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (found := pairs.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, merged, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one side was merged meanwhile
            symbols[i], symbols[j] = merged, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((merged, symbols[k])):
                    heapq.heappush(heap, (found[0], i, found[1], merged, symbols[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbols[h], merged))):
                heapq.heappush(heap, (found[0], h, found[1], symbols[h], merged))
        return left


def _counter(path: str) -> tuple[Merger, P.PieceTable]:
    """One merger and table of counts for each worker process and vocabulary."""
    loaded = K.cache("token_count")
    if path not in loaded:
        merger = Merger(path)
        loaded[path] = merger, P.PieceTable(lambda pieces: (np.array([merger.count(p) for p in pieces], np.int32), None))
    return loaded[path]


def _count_slice(table: P.PieceTable, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(at) - 1, np.int64)
    for texts, part, off in P.parts(buf, at):
        starts = P.piece_starts(part, off)
        ends = np.append(starts[1:], len(part))
        rows = table.look_up(part, starts, ends)
        running = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(table.counts.array[rows], out=running[1:])
        per = running[np.searchsorted(starts, off[1:])] - running[np.searchsorted(starts, off[:-1])]
        total[texts] += per
    return total


def count_texts(column: pa.Array, path: str) -> np.ndarray:
    """Token counts of the texts of a column."""
    merger, table = _counter(path)
    out = np.zeros(len(column), np.int64)
    for lo, hi, buf, at in K.slices(column):
        out[lo:hi] = _count_slice(table, buf, at)
    for special in merger.special:
        for row, parts in P.without_special(column, special):
            out[row] = int(count_texts(pa.array(parts), path).sum()) + len(parts) - 1
    return out


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each document: its id, n_bytes, n_tokens and whether these are over the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        for batch in K.bounded(batches):
            tokens = count_texts(batch.column(1), path)
            _, at = K.texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
