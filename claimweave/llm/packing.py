"""Operator 1: packing documents into token sequences, shortest pack first over the length histogram.

A document's tokens are cut into pieces of the sequence length and one remainder. Lengths are placed
longest first, each into the pack with the most room left (the shortest), by counts of packing patterns:
what is planned on the driver has a row for each length at most, not for each document. Pieces get a rank
within their length, and ranks are joined to the runs of the patterns' copies.

Defined results: a null or empty text is its end token alone; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from . import pretokens as P
from . import store
from .token_count import VOCABULARY, vocabulary_path

#: Pieces in a sub-group in which those of one length are ranked, expected, so that a hot length is not one task's.
RANK_ROWS = 10_000


def _encoder(path: str) -> tuple:
    """The tokenizer and a table of the ids of pieces, one for each worker process and vocabulary."""
    loaded = K.cache("packing")
    if path not in loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model = tokenizer.model
        standing = dict(zip(range(256), _byte_characters(), strict=True))

        def value(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # A piece is one pre-token, so the model sees it as the library would show it.
            ids = [[t.id for t in model.tokenize(p.decode("latin-1").translate(standing))] for p in pieces]
            return np.fromiter(map(len, ids), np.int32, len(ids)), np.fromiter((i for x in ids for i in x), np.int32)

        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        loaded[path] = special, P.PieceTable(value)
    return loaded[path]


def _byte_characters() -> list[str]:
    from .token_count import byte_alphabet

    return [c for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]


def _slice_ids(table: P.PieceTable, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a slice end to end, and their offsets."""
    found, sizes = [], np.zeros(len(at) - 1, np.int64)
    for texts, part, off in P.parts(buf, at):
        starts = P.piece_starts(part, off)
        rows = table.look_up(part, starts, np.append(starts[1:], len(part)))
        counts = table.counts.array[rows]
        running = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=running[1:])
        shift = np.repeat(table.first.array[rows] - running[:-1], counts)
        shift += np.arange(running[-1])
        found.append(table.symbols.array[shift])
        sizes[texts] += running[np.searchsorted(starts, off[1:])] - running[np.searchsorted(starts, off[:-1])]
    offsets = np.zeros(len(at), np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), offsets


def _ids_of(text: str, path: str) -> np.ndarray:
    """The ids of one text that may hold special strings."""
    special, table = _encoder(path)
    for word, number in special.items():
        if word in text:
            parts = [_ids_of(x, path) for x in text.split(word)]
            return np.concatenate([x for p in parts for x in (p, [number])][:-1]).astype(np.int32)
    raw = np.frombuffer(text.encode(), np.uint8)
    return _slice_ids(table, raw, np.array([0, len(raw)]))[0]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, end_id: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece: id, start, length, ids (little-endian unsigned 32-bit) and the document's doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_path(vocabulary)
        special, table = _encoder(path)
        for batch in K.bounded(batches):
            column = batch.column(1)
            odd = {row: None for word in special for row, _ in P.without_special(column, word)}
            for lo, hi, buf, at in K.slices(column):
                ids, off = _slice_ids(table, buf, at)
                if hit := [r for r in odd if lo <= r < hi]:
                    each = [ids[off[i] : off[i + 1]] for i in range(hi - lo)]
                    for r in hit:
                        each[r - lo] = _ids_of(column[r].as_py(), path)
                    ids, off = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
                tokens = np.diff(off) + 1
                own = np.full(len(ids) + hi - lo, end_id, np.uint32)
                keep = np.ones(len(own), bool)
                first = off[:-1] + np.arange(hi - lo)
                keep[first + tokens - 1] = False
                own[keep] = ids
                n = (tokens + length - 1) // length
                row = np.repeat(np.arange(hi - lo), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(tokens[row] - start, length)
                edges = np.append(first[row] + start, len(own)).astype(np.int32) * 4
                blobs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(size), blobs, pa.array(tokens[row])], names=[id_col, "start", "length", "ids", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long")


def plan(histogram: dict[int, int], length: int = 1024) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first sequence, offset) of a packing of the histogram, and its number of sequences.

    Shortest pack first: for each length, longest first, the packs with the most room left get it, as many
    copies at a time as the pattern has. Work and result grow with the number of lengths only.
    """
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    free: list[int] = []

    def put(room: int, pattern: tuple[int, ...], copies: int) -> None:
        if not rooms[room]:
            heapq.heappush(free, -room)
        rooms[room].append((pattern, copies))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and free and -free[0] >= size:
            room = -free[0]
            pattern, copies = rooms[room].pop()
            if not rooms[room]:
                heapq.heappop(free)
            taken = min(copies, left)
            left -= taken
            if copies > taken:
                put(room, pattern, copies - taken)
            put(room - size, (*pattern, size), taken)
        if left:  # new packs, which take the same length while it fits
            per = length // size
            full, rest = divmod(left, per)
            if full:
                put(length - per * size, (size,) * per, full)
            if rest:
                put(length - rest * size, (size,) * rest, 1)
    runs, ranks, sequence = [], defaultdict(int), 0
    for room in sorted(rooms):
        for pattern, copies in rooms[room]:
            offset = 0
            for size in pattern:
                runs.append((size, ranks[size], ranks[size] + copies, sequence, offset))
                ranks[size] += copies
                offset += size
            sequence += copies
    return runs, sequence


def assign(pieces: DataFrame, order: list[str], length: int = 1024) -> DataFrame:
    """pieces (a written table with a `length` column) with sequence_id and offset; `order` breaks ties of rank."""
    spark = pieces.sparkSession
    group = F.pmod(F.xxhash64(*order), F.lit(max(1, pieces.count() // RANK_ROWS)))
    grouped = pieces.withColumn("_group", group)
    counts = grouped.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "_group", F.coalesce(before, F.lit(0)).alias("_base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # `length` rows at most
    runs, _ = plan(histogram, length)
    table = spark.createDataFrame(runs, "length long, _lo long, _hi long, _sequence long, offset long")
    ranked = grouped.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_group").orderBy(*order)) - 1)
    ranked = ranked.join(base, ["length", "_group"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row"))
    # The runs depend on the number of lengths alone, so they can be broadcast.
    table = F.broadcast(table.withColumnRenamed("length", "_length"))
    placed = ranked.join(table, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    out = [c for c in pieces.columns]
    return placed.select(*out, (F.col("_sequence") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, keep_ids: bool = True, **options) -> DataFrame:
    """The pieces with ids_crc32 and their place (sequence_id, offset); with keep_ids also their ids."""
    pieces = token_pieces(docs, id_col, text_col, length, **options).withColumn("ids_crc32", F.crc32("ids"))
    pieces = pieces.select(id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids)
    return assign(store.write(pieces, "pieces"), [id_col, "start", "ids_crc32"], length)


def sequences(packed: DataFrame, length: int = 1024, end_id: int = 0) -> DataFrame:
    """A row for each sequence of pack(keep_ids=True): its ids (binary, padded with end_id) and n_tokens."""
    part = F.struct("offset", "ids")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: F.hex(x["ids"])), "")
    n = F.sum("length")
    padded = F.rpad(joined, length * 8, bytes([end_id, 0, 0, 0]).hex())
    return packed.groupBy("sequence_id").agg(F.unhex(padded).alias("ids"), n.alias("n_tokens"))
