"""Operator 6: near-duplicates by circulant MinHash.

A document's set is its distinct shingles of SHINGLE words, or of as many as the caller asks for. One permutation places shingles on a ring of 2^20
places, a second one gives each place a value; the k-th signature coordinate is the smallest value after
the ring is turned by k places, so two permutations generate all coordinates. BANDS bands of ROWS
coordinates make candidates: a pair of similarity 0.8 misses all bands with probability below 3e-7.

Documents with equal sets are represented by one of them. In a bucket, documents are compared with one
leader rather than with each other: the one that meets most documents over all buckets. Documents of buckets that still hold several components then go through an
exact prefix join of what they have apart from their leader (see rare_pairs), which finds every similar pair among
them without a bucket's pairs being listed. Links are confirmed on full sets, which hold a 64-bit keyed hash for
each shingle.

Defined results: a text without words (or null) has an empty set and is linked with nothing; a row without
an id is linked with nothing, has no component and is kept; rows that share an id share a component; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import store
from .components import components
from .quality_rules import window_hashes
from .skew import join_counted, join_salted

BANDS, ROWS, RING_BITS = 50, 6, 20
SHINGLE = 2
#: Items of a document that are compared before a pair is listed.
HEAD = 128
PERCENT = 80


def shingle_sets(buf: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, offsets): each text's set, sorted. With fewer words, all of them are one shingle."""
    n = len(at) - 1
    buf = K.FOLD[buf]
    starts, ends = K.word_spans(buf, at, ~K.WHITE[buf])
    text = np.searchsorted(at, starts, side="right") - 1
    words = K.span_hashes(buf, starts, ends)
    count = np.bincount(text, minlength=n)
    windows = window_hashes(words, size)
    own = text[: len(windows)] == text[size - 1 :] if len(windows) else np.zeros(0, bool)
    found, of = windows[own], text[: len(windows)][own]
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = count[short].astype(np.uint64)
        for i in range(size - 1):
            on = np.flatnonzero(count[short] > i)
            whole[on] = K.mix(whole[on] ^ words[first[short[on]] + i])
        found, of = np.concatenate([found, whole]), np.concatenate([of, short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(of[fresh], minlength=n), out=offsets[1:])
    return found[fresh], offsets


def _ring_values(coordinates: int) -> np.ndarray:
    """The second permutation, with its beginning again after its end."""
    ring = K.cache("near_dedup")
    if coordinates not in ring:
        values = np.random.default_rng(20).permutation(1 << RING_BITS).astype(np.int32)
        ring[coordinates] = np.concatenate([values, values[: coordinates - 1]])
    return ring[coordinates]


def signatures(shingles: np.ndarray, offsets: np.ndarray, coordinates: int = BANDS * ROWS, chunk: int = 2048) -> np.ndarray:
    """The circulant MinHash signature of each set; sets must not be empty."""
    turns = np.lib.stride_tricks.sliding_window_view(_ring_values(coordinates), coordinates)
    place = (K.mix(shingles ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(64 - RING_BITS)).astype(np.int64)
    out = np.full((len(offsets) - 1, coordinates), np.iinfo(np.int32).max, np.int32)
    for lo in range(0, len(place), chunk):
        hi = min(lo + chunk, len(place))
        a, b = np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi, side="left")
        least = np.minimum.reduceat(turns[place[lo:hi]], np.maximum(offsets[a:b], lo) - lo, axis=0)
        np.minimum(out[a:b], least, out=out[a:b])
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each set and band."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        out = K.mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(id, n, s1, s2, bands) of each document: its set's size and two sums that identify the set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("near_dedup")
        for batch in K.bounded(batches):
            for lo, hi, buf, at in K.slices(batch.column(1)):
                sets, off = shingle_sets(buf, at, size)
                n = np.diff(off)
                sums = []
                for salt in (1, 2):
                    total = np.zeros(len(sets) + 1, np.uint64)
                    np.cumsum(K.mix(sets + np.uint64(salt)), out=total[1:])
                    sums.append((total[off[1:]] - total[off[:-1]]).view(np.int64))
                full = n > 0
                keys = np.zeros((hi - lo, BANDS), np.uint64)
                if full.any():
                    keys[full] = band_keys(signatures(sets, np.append(off[:-1][full], off[-1])))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), *map(pa.array, sums), bands], names=["id", "n", "s1", "s2", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, bands array<bigint>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(id, n, items) with a document's sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("near_dedup")
        for batch in K.bounded(batches):
            for lo, hi, buf, at in K.slices(batch.column(1)):
                sets, off = shingle_sets(buf, at, size)
                raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((off * 8).astype(np.int32)), pa.py_buffer(sets)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), raw], names=["id", "n", "items"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, items binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the sets of both; b may be a leader of many."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("_items_a"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("_items_b"))
    return join_salted(pairs, right, "b").join(left, "a")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("near_dedup")
        for batch in K.bounded(batches):
            x, y = batch.column(2), batch.column(3)
            ok = [similar(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    joined = with_sets(pairs.select("a", "b"), sets)
    return joined.select("a", "b", "_items_a", "_items_b").mapInArrow(run, f"a {kind}, b {kind}")


def _size_fits(a, b):
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * PERCENT)


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, item, id, n, component, d) for members (a, b = their leader, component): a row for each of the d items that only one of the two has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("near_dedup")
        for batch in K.bounded(batches):
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                x, y = part.column(3), part.column(4)
                own = [np.frombuffer(v.as_buffer(), np.uint64) for v in x]
                items = [np.setxor1d(o, np.frombuffer(v.as_buffer(), np.uint64), assume_unique=True) for o, v in zip(own, y, strict=True)]
                d = np.array([len(v) for v in items], np.int64)
                row = np.repeat(np.arange(len(part)), d)
                at = pa.array(row)
                found = pa.array(np.concatenate(items).view(np.int64))
                n = np.array([len(o) for o in own], np.int64)[row]
                yield pa.RecordBatch.from_arrays([part.column(1).take(at), found, part.column(0).take(at), pa.array(n), part.column(2).take(at), pa.array(d[row])], names=["lead", "item", "id", "n", "component", "d"])

    kind = members.schema["a"].dataType.simpleString()
    joined = with_sets(members.select("a", "b", "component"), sets).select("a", "b", "component", "_items_a", "_items_b")
    return joined.mapInArrow(run, f"lead {kind}, item long, id {kind}, n long, component {kind}, d long")


def rare_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): candidates for every similar pair of different components among members (a, b = their leader, component).

    Sets of sizes n and m are similar if they differ in at most (n + m) / 9 items; so do the sets X and Y of what
    they have apart from a leader of both. With |X| <= |Y| they share at least |X| - n / 8 items, hence one of the
    first n / 8 + 1 of X and one of the first m / 4 + 1 of Y, in any order of items that is one for the leader. Or
    they need share none, but then both are similar to the leader. Most items that near copies share are their
    leader's too, so what is left tells them apart. The order has first the items of one component alone, which
    start no pair, then the rarest. Of a pair's order the first HEAD items are compared before it is listed. In a
    group of one leader and item, only documents outside its most frequent component look for partners, since of
    two documents in different components one is outside.
    """
    rows = store.write(differences(members, sets), "differences")
    group = ["lead", "item"]
    often = rows.groupBy(*group).agg(F.count("*").alias("df"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select(*group, "df")
    alive = join_counted(rows, store.write(often, "often"), group, "df")
    held = alive.groupBy("lead", "id", "n", "component", "d").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("live"))
    held = held.withColumn("dead", F.col("d") - F.size("live"))
    width = F.floor(F.col("n") / 4) + 1 - F.col("dead")
    held = held.where(width > 0).withColumns({
        "head": F.transform(F.slice("live", 1, HEAD), lambda x: x["item"]), "edge": F.element_at("live", F.least(F.size("live"), F.lit(HEAD))),
        "rest": F.greatest(F.size("live") - HEAD, F.lit(0)), "start": F.slice("live", F.lit(1), width.cast("int")),
    })
    spread = held.select("lead", "id", "n", "component", "d", "dead", "head", "edge", "rest", F.posexplode("start").alias("spot", "found"))
    spread = spread.withColumns({"item": F.col("found.item"), "spot": F.col("spot") + F.col("dead")}).drop("found", "dead")
    spread = store.write(spread.withColumn("first", F.col("spot") <= F.floor(F.col("n") / 8)), "prefixes")
    main = spread.groupBy(*group).agg(F.mode("component").alias("main"), F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select(*group, "main")
    mixed = store.write(spread.join(main, group), "mixed")
    x, y = mixed.where(F.col("component") != F.col("main")).alias("x"), mixed.alias("y")
    met = x.join(y, group).where((F.col("x.component") != F.col("y.component")) & _size_fits(F.col("x.n"), F.col("y.n")))
    before = (F.col("x.d") < F.col("y.d")) | ((F.col("x.d") == F.col("y.d")) & (F.col("x.id") < F.col("y.id")))
    met = met.where(F.when(before, F.col("x.first")).otherwise(F.col("y.first")))

    def near_enough(shared):
        return (F.col("x.d") + F.col("y.d") - 2 * shared) * (100 + PERCENT) <= (F.col("x.n") + F.col("y.n")) * (100 - PERCENT)

    met = met.where(near_enough(F.least("x.spot", "y.spot") + F.least(F.col("x.d") - F.col("x.spot"), F.col("y.d") - F.col("y.spot"))))
    # What both have up to the smaller edge is in both heads.
    met = met.where(near_enough(F.size(F.array_intersect("x.head", "y.head")) + F.when(F.col("x.edge") <= F.col("y.edge"), F.col("x.rest")).otherwise(F.col("y.rest"))))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """A row for each document: id, n_shingles, component_id, kept. Shingles have `size` words."""
    whole = ["n", "s1", "s2"]
    sketched = store.write(sketch(docs, id_col, text_col, size), "sketch")
    live = sketched.where((F.col("n") > 0) & F.col("id").isNotNull())
    # Equal sets have equal bands.
    classes = store.write(live.groupBy(*whole).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    rows = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key"))
    shared = store.write(rows.groupBy("key").agg(F.count("*").alias("met"), F.count_distinct("id").alias("_ids")).where("_ids > 1").select("key", "met"), "shared")
    met = store.write(join_counted(rows, shared, ["key"], "met").select("key", "id", "n", "met").distinct(), "met")
    degree = met.groupBy("id").agg(F.sum("met").alias("degree"))
    buckets = store.write(met.join(degree, "id").select("key", "id", "n", "degree"), "buckets")
    ids = store.write(degree.select(F.col("id").alias("_id")), "ids")
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id") == F.col("_id"), "left_semi")
    sets = store.write(full_sets(chosen, "id", "text", size).dropDuplicates(["id", "n", "items"]), "sets")
    best = F.struct("degree", F.xxhash64("id"), "id", "n")
    first = store.write(buckets.groupBy("key").agg(F.max(best).alias("lead"), F.count("*").alias("met")), "leaders")
    led = store.write(join_counted(buckets, first.select("key", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n"), "met"), ["key"], "met").drop("met", "degree"), "led")
    pairs = led.where((F.col("id") != F.col("lead")) & _size_fits(F.col("n"), F.col("lead_n"))).select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    edges = store.write(confirm(store.write(pairs, "pairs"), sets), "links")
    labels = components(edges)
    now = store.write(led.join(labels, "id", "left").select("key", "id", "lead", F.coalesce("component", "id").alias("component")), "labelled")
    mixed = store.write(now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("met")).where("lo < hi").select("key", "met"), "mixed-keys")
    open_ = store.write(join_counted(now, mixed, ["key"], "met").select(F.col("id").alias("a"), F.col("lead").alias("b"), "component").distinct(), "open")
    if open_.limit(1).count():  # what no leader has joined
        more = store.write(confirm(store.write(rare_pairs(open_, sets), "pairs"), sets), "more-links")
        if more.limit(1).count():
            labels = components(edges.unionByName(more))
    known = classes.select("rep", *whole, "copies").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    known = store.write(known.select(*whole, "copies", F.coalesce("component", "rep").alias("component")), "known")
    own = join_counted(live.select("id", *whole), known, whole, "copies").select("id", "n", "component")
    alone = sketched.where((F.col("n") == 0) | F.col("id").isNull()).select("id", "n", F.col("id").alias("component"))
    final = own.unionByName(alone)
    return final.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay when one document of each component does, with all their columns."""
    gone = store.write(link(docs, id_col, text_col, size).where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
