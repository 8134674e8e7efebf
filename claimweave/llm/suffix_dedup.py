"""Operator 2: exact removal of repeated passages by a depth-limited radix sort of suffixes.

Suffixes (at anchors, see suffix_runs) are ordered by most-significant-digit passes through DEPTH bytes:

1. The first digit is the anchor's run of DIGIT bytes. Suffixes are dealt into buckets by it and put in byte
   order there; groups of one document end there. In a group, runs with equal bytes throughout are equal
   already: all but those of the smallest document are repeated.
2. Groups that hold several documents and different bytes go on: their windows are ordered by all DEPTH bytes,
   eight at a time, each pass over what the passes before left equal. Equal groups are exactly the repeated windows.

The second pass compares bytes. In the first a run's bytes beyond the anchor's DIGIT ones are compared by a
keyed 64-bit hash of them, since whole runs are four times the text. Anchors that are in many documents have
their windows ordered through all bytes at once, so that none of their groups is large; which ones is told by a
sample and changes no result. Before each deal a task keeps, of runs that are equal in its own rows, those of the
smallest document.

Defined results: ids are integers that identify documents; a null text is an empty one; rows without an id
neither lose nor give bytes; a row repeated with its id gives a row with the same result; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import store
from .suffix_runs import DEPTH, digits, radix_order, runs

#: Documents in the sample, and the share of them from which an anchor counts as common.
SAMPLE_DOCUMENTS, COMMON_SHARE = 2000, 0.02
#: Runs that a task holds before it deals them out, buckets for each shuffle partition, and runs whose windows are ordered at once.
HELD_RUNS, BUCKETS_PER_PARTITION, HELD_CONTENTS = 1 << 19, 8, 20_000
_FIELDS = (("high", np.uint64), ("low", np.uint64), ("context", np.uint64), ("doc", np.int64), ("start", np.int64), ("more", np.int32))


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns as zstd-compressed byte planes."""
    planes = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        c = np.ascontiguousarray(c)
        planes.append(c.view(np.uint8).reshape(len(c), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _, kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).ravel())
        at += n * width
    return out


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document, in order, those that overlap or touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    reach = np.maximum.accumulate(end + (np.cumsum(np.append(0, doc[1:] != doc[:-1])) << 40)) & ((1 << 40) - 1)
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(doc) - 1)
    return doc[fresh], start[fresh], reach[last]


def _least(doc: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """For each row the smallest document of its group; groups begin where fresh is set."""
    first = np.flatnonzero(fresh)
    return np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))


def _deal(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return K.mix(high ^ K.mix(low))


def _document_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))


def common_keys(rows: DataFrame, n: int) -> np.ndarray:
    """Anchors in COMMON_SHARE of a sample's documents; as many as a document has anchors, divided by that share, at most."""
    most = 1 << 32
    chosen = rows.where(F.pmod(F.xxhash64("doc"), F.lit(most)) < F.lit(min(most, -(-SAMPLE_DOCUMENTS * most // max(n, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.bounded(batches):
            for _, _, buf, at in K.slices(batch.column(1)):
                high, low, _, text, _, _ = runs(buf, at)
                key = _deal(high, low)
                _, first = np.unique(key ^ K.mix(text.astype(np.uint64)), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64))], names=["key"])

    least = max(10, int(COMMON_SHARE * min(n, SAMPLE_DOCUMENTS)))
    found = chosen.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], np.int64).view(np.uint64))


def first_pass(rows: DataFrame, common: np.ndarray, partitions: int) -> DataFrame:
    """(kind, doc, start, end, high, low): repeated intervals (kind 0) and runs left for the last digit (kind 1)."""
    buckets = partitions * BUCKETS_PER_PARTITION

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            high, low, context, doc, start, more = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, level = radix_order([high, low, context])
            beaten = doc[order] > _least(doc[order], level < 3)
            out, order = order[beaten], order[~beaten]

            def blobs_of(name: np.ndarray, rows: np.ndarray, columns: tuple) -> tuple[list[int], list[bytes]]:
                of = (name >> np.uint64(32)).astype(np.int64) * buckets >> 32
                rows = rows[np.argsort(of, kind="stable")]
                cut = np.searchsorted(np.sort(of), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cut))
                return full.tolist(), [_pack([x[rows[cut[b] : cut[b + 1]]] for x in columns]) for b in full]

            at, blobs = blobs_of(_deal(high[order], low[order]), order, (high, low, context, doc, start, more))
            if len(out):  # intervals found already, dealt by document
                d, s, e = merged(doc[out], start[out], start[out] + more[out] + DEPTH)
                nil = np.zeros(len(d), np.uint64)
                to, own = blobs_of(K.mix(d.view(np.uint64)), np.arange(len(d)), (nil, nil, nil, d, s, (e - s).astype(np.int32)))
                at, blobs = at + [buckets + x for x in to], blobs + own
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        total = 0
        for batch in K.bounded(batches):
            ids = batch.column(0).to_numpy()
            for lo, _, buf, at in K.slices(batch.column(1)):
                high, low, context, text, start, more = runs(buf, at)
                if not len(high):
                    continue
                if len(common):
                    key = _deal(high, low)
                    spot = np.minimum(np.searchsorted(common, key), len(common) - 1)
                    wide = common[spot] == key
                    if wide.any():  # one row for each window, told by a hash of its bytes and by its first bytes
                        n = more[wide] + 1
                        t = np.repeat(text[wide], n)
                        s = np.repeat(start[wide], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        words, p = K.loads(buf), at[t] + s
                        held.append((K.span_hashes(buf, p, p + DEPTH, words), *digits(words, p, 16), ids[lo + t], s, np.zeros(len(s), np.int64)))
                        total += len(s)
                    high, low, context, text, start, more = (x[~wide] for x in (high, low, context, text, start, more))
                held.append((high, low, context, ids[lo + text], start, more))
                total += len(high)
                if total >= HELD_RUNS:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc", "start", "end", "high", "low"]

        def batch_of(kind: int, *columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(np.asarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in columns)], names=names)

        def solve(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            high, low, context, doc, start, more = (np.concatenate(x) for x in zip(*(_unpack(b, _FIELDS) for b in blobs), strict=True))
            order, level = radix_order([high, low, context])
            first = np.flatnonzero(level < 2)
            size = np.diff(np.append(first, len(order)))
            several = np.repeat(size > 1, size)
            order, level = order[several], level[several]
            if not len(order):
                return
            d, s, m = doc[order], start[order], more[order]
            first = np.flatnonzero(level < 2)
            size = np.diff(np.append(first, len(order)))
            many = np.repeat(np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first), size)
            various = np.repeat(np.add.reduceat((level == 2).astype(np.int64), first) > 0, size)
            beaten = many & (d > _least(d, level < 3))
            found = merged(d[beaten], s[beaten], s[beaten] + m[beaten] + DEPTH)
            nil = np.zeros(len(found[0]), np.int64)
            yield batch_of(0, *found, nil, nil)
            left = many & various & ~beaten
            yield batch_of(1, d[left], s[left], s[left] + m[left] + DEPTH, high[order[left]], low[order[left]])

        now, blobs = None, []
        for batch in K.bounded(batches):
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = blob.as_buffer().to_pybytes()
                if bucket >= buckets:
                    _, _, _, d, s, m = _unpack(blob, _FIELDS)
                    yield batch_of(0, d, s, s + m, np.zeros(len(d), np.int64), np.zeros(len(d), np.int64))
                    continue
                if bucket != now and blobs:
                    yield from solve(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from solve(blobs)

    dealt = rows.mapInArrow(deal, "bucket int, blob binary")
    return dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(order, "kind int, doc long, start long, end long, high long, low long")


def last_pass(rows: DataFrame, left: DataFrame) -> DataFrame:
    """(doc, start, end): repeated intervals of the runs (doc, start, end, high, low) that the first pass left."""
    per = left.groupBy("doc").agg(F.collect_list(F.struct("high", "low", "start", "end")).alias("runs"))
    joined = rows.join(per, "doc").select("doc", F.col("text").cast("binary").alias("raw"), F.explode("runs").alias("run"))
    start, end = F.col("run.start"), F.col("run.end")
    content = joined.select(F.col("run.high").alias("high"), F.col("run.low").alias("low"), "doc", start.alias("start"), F.substring(F.col("raw"), (start + 1).cast("int"), (end - start).cast("int")).alias("content"))

    def solve(doc: np.ndarray, start: np.ndarray, content: pa.Array) -> pa.RecordBatch:
        buf, at = _bytes(content)
        n = np.diff(at) - DEPTH + 1
        row = np.repeat(np.arange(len(n)), n)
        spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys = digits(K.loads(buf), at[row] + spot, DEPTH)
        order, level = radix_order(keys)
        own = doc[row[order]]
        hit = order[own > _least(own, level < len(keys))]
        d, s, e = merged(doc[row[hit]], start[row[hit]] + spot[hit], start[row[hit]] + spot[hit] + DEPTH)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                c = table.combine_chunks()
                yield solve(c["doc"].to_numpy(), c["start"].to_numpy(), c["content"])

        for batch in K.bounded(batches):
            held.append(batch)
            if sum(len(b) for b in held) >= HELD_CONTENTS:
                table = pa.Table.from_batches(held)
                high, low = table["high"].to_numpy(), table["low"].to_numpy()
                other = np.flatnonzero((high != high[-1]) | (low != low[-1]))  # the last key may go on
                if len(other):
                    cut = int(other[-1]) + 1
                    yield from emit(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))

    sorted_ = content.repartition("high", "low").sortWithinPartitions("high", "low")
    return sorted_.mapInArrow(run, "doc long, start long, end long")


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, spans): for each document with repeated windows intervals [start, end) in bytes, in order; they may overlap."""
    spark = docs.sparkSession
    rows = _document_runs(docs, id_col, text_col)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = common_keys(rows, rows.count())
    first = store.write(first_pass(rows, common, partitions), "first-pass")
    last = store.write(last_pass(rows, first.where("kind = 1").drop("kind")), "last-pass")
    every = first.where("kind = 0").select("doc", "start", "end").unionByName(last)
    grouped = every.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    return grouped.select("doc", F.col("found").alias("spans"))


def _cut(raw: bytes, spans: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    runs_: list[list[int]] = []
    for s in spans:
        lo, hi = s["start"], min(s["end"], len(raw))
        if lo >= hi:
            continue
        if runs_ and lo <= runs_[-1][1]:
            runs_[-1][1] = max(runs_[-1][1], hi)
        else:
            runs_.append([lo, hi])
    kept, last = [], 0
    for lo, hi in runs_:
        kept.append(raw[last:lo])
        last = hi
    return b"".join([*kept, raw[last:]]), runs_


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """A row for each document: id, n_bytes, n_removed, n_spans, kept_sha256 and, with_bytes, the kept bytes and the removed spans."""
    found = repeats(docs, id_col, text_col)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = source.join(found, F.col("id") == F.col("doc"), "left").select("id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", kept binary, removed array<struct<start:bigint,end:bigint>>" * with_bytes
    listed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("suffix_dedup")
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"]
        for batch in K.bounded(batches):
            for lo in range(0, len(batch), 256):  # so that few texts are held as Python objects
                part = batch.slice(lo, 256)
                out: list[list] = [[] for _ in names[1:]]
                for text, spans in zip(part.column(1), part.column(2), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    kept, own = _cut(raw, spans.as_py() or [])
                    found = (len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest())
                    for c, v in zip(out, (*found, kept, [{"start": a, "end": b} for a, b in own]) if with_bytes else found, strict=False):
                        c.append(v)
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
                if with_bytes:
                    columns += [pa.array(out[4], pa.binary()), pa.array(out[5], listed)]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    result = joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
    return result.withColumnRenamed("id", id_col)
