"""Vectorised text kernels: bytes of many texts at once, without an object per word.

All work on slices of an Arrow batch: the UTF-8 bytes of its texts end to end, and each text's
offsets. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


_caches: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """What an operator keeps in a worker process from task to task.

    Workers are used again by later stages, so asking for one operator's cache empties those of the others:
    a worker holds one operator's tables at a time.
    """
    for other, held in _caches.items():
        if other != owner and held:
            held.clear()
            release()
    return _caches.setdefault(owner, {})


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def loads(buf: np.ndarray) -> np.ndarray:
    """The bytes as aligned 64-bit words, with zeros after the end; see load."""
    room = np.zeros((len(buf) + 23) // 8, U64)
    room.view(np.uint8)[: len(buf)] = buf
    return room


def load(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, little-endian, of words made by loads."""
    spot, shift = at >> 3, ((at & 7) << 3).astype(U64)
    return (words[spot] >> shift) | (words[spot + 1] << U64(1) << (U64(63) - shift))


#: Spans above this many bytes are hashed block by block, then over their blocks' hashes.
_BLOCK = 256
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(8)], U64)
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte strings buf[start:end]; equal strings have equal hashes anywhere.

    Bytes are mixed in eight at a time by a bijection that is not linear, so strings of up to eight bytes never
    collide with others of their length and structured ones have no common pattern to collide by.
    """
    words = loads(buf) if words is None else words
    starts, size = np.asarray(starts), np.asarray(ends) - np.asarray(starts)
    out = mix(size.astype(U64) + U64(0xA24BAED4963EE407))
    long = np.flatnonzero(size > _BLOCK)
    if len(long):
        blocks = -(-size[long] // _BLOCK)
        of = np.repeat(np.arange(len(long)), blocks)
        lo = starts[long][of] + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * _BLOCK
        inner = span_hashes(buf, lo, np.minimum(lo + _BLOCK, (starts + size)[long][of]), words)
        edge = 8 * np.append(0, np.cumsum(blocks))
        over = span_hashes(inner.view(np.uint8), edge[:-1], edge[1:])
        out[long] = mix(out[long] ^ over)
    live, done = np.flatnonzero((size > 0) & (size <= _BLOCK)), 0
    while len(live):
        left = size[live] - done
        chunk = load(words, starts[live] + done)
        chunk &= np.where(left < 8, _TAILS[np.minimum(left, 7)], _FULL)
        out[live] = mix(out[live] ^ chunk)
        done += 8
        live = live[left > 8]
    return out


def equal_spans(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a's `size` bytes from each place on are b's; the places' arrays come from loads."""
    same = np.ones(len(size), bool)
    todo, done = np.flatnonzero(size > 0), 0
    while len(todo):
        left = size[todo] - done
        keep = np.where(left < 8, _TAILS[np.minimum(left, 7)], _FULL)
        equal = ((load(a, a_at[todo] + done) ^ load(b, b_at[todo] + done)) & keep) == 0
        same[todo[~equal]] = False
        done += 8
        todo = todo[equal & (left > 8)]
    return same


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """A number for each span, equal exactly for spans of equal bytes (and of one group). Hashes sort, bytes decide."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    words, size = loads(buf), ends - starts
    h = span_hashes(buf, starts, ends, words)
    order = np.argsort(h, kind="stable") if group is None else np.lexsort((h, group))
    one, two = order[:-1], order[1:]
    near = h[one] == h[two]
    if group is not None:
        near &= group[one] == group[two]
    hit = np.flatnonzero(near)
    same = (size[one[hit]] == size[two[hit]]) & equal_spans(words, starts[one[hit]], words, starts[two[hit]], np.minimum(size[one[hit]], size[two[hit]]))
    if not same.all():  # different bytes of one hash: told apart one by one
        known: dict = {}
        raw = buf.tobytes()
        return np.array([known.setdefault((0 if group is None else int(group[i]), raw[starts[i] : ends[i]]), len(known)) for i in range(n)], np.int64)
    number = np.zeros(n, np.int64)
    number[order] = np.cumsum(np.append(0, ~near))
    return number


_trim = None


def release() -> None:
    """Gives memory that is free inside the worker back to the system; called when a task's batches end."""
    global _trim
    pa.default_memory_pool().release_unused()
    if _trim is None:
        try:
            _trim = ctypes.CDLL("libc.so.6").malloc_trim
        except (OSError, AttributeError):  # another C library
            _trim = lambda _: 0
    _trim(0)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches as they come; release() when there are no more."""
    try:
        yield from batches
    finally:
        release()


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end and len + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes; a longer text is a run of its own."""
    buf, at = texts(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(buf: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes; none goes over the end of a text."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1


def code_points(buf: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (buf & 0xC0) != 0x80


def per_text(at: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
