"""Sampled suffixes of texts, and the radix order of suffixes by their bytes.

Each window of DEPTH bytes has one anchor: its run of DIGIT bytes with the smallest hash, the leftmost of
equals. Equal windows have equal anchors at equal places, wherever they stand, so only suffixes at anchors
need sorting. Windows that follow one another mostly share their anchor; such a run of windows is a row.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

DEPTH, DIGIT = 50, 16
#: Texts above this many bytes are cut into parts that overlap by DEPTH - 1 bytes; places in a part fit in 24 bits.
PART = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)


def digits(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The `size` bytes from each place on as numbers of eight bytes, in byte order; the last digit may have fewer."""
    out = []
    for lo in range(0, size, 8):
        digit = K.load(words, at + lo).byteswap()
        out.append(digit >> np.uint64(8 * (lo + 8 - size)) if lo + 8 > size else digit)
    return out


def radix_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, level) of rows by their digits, the most significant first.

    A pass orders only the rows that the passes before left equal to others. level tells the first digit in
    which a row differs from the one before it in the order; it is len(keys) where none does.
    """
    order = np.argsort(keys[0], kind="stable")
    first = keys[0][order]
    level = np.zeros(len(order), np.int8)
    level[1:][first[1:] == first[:-1]] = 1
    for depth, key in enumerate(keys[1:], 1):
        equal = level == depth
        spot = np.flatnonzero(equal | np.append(equal[1:], False))
        if not len(spot):
            break
        group = np.cumsum(~equal[spot])
        rows = order[spot]
        rows = rows[np.lexsort((key[rows], group))]
        order[spot] = rows
        same = np.append(False, (key[rows][1:] == key[rows][:-1]) & (group[1:] == group[:-1]))
        level[spot[same]] = depth + 1
    return order, level


def _gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of DIGIT bytes at the first n places."""
    at = np.arange(n)
    return K.mix(K.mix(K.load(words, at)) ^ K.load(words, at + 8))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    length = 1
    while 2 * length <= width:
        v = np.minimum(v[:-length], v[length:])
        length *= 2
    return np.minimum(v[: len(v) - (width - length)], v[width - length :]) if length < width else v


def runs(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(high, low, context, text, start, more) of each run of windows with one anchor.

    The windows start at start ... start + more (places in the text). high and low are the anchor's bytes,
    context a hash of all bytes that the run's windows cover and of the anchor's place in them.
    """
    parts = []
    if len(at) > 2 or len(buf) <= PART:
        parts.append((0, 0, buf, at))
    else:
        for lo in range(0, max(1, len(buf) - DEPTH + 1), PART):
            piece = buf[lo : lo + PART + DEPTH - 1]
            parts.append((0, lo, piece, np.array([0, len(piece)])))
    out = []
    for first, base, piece, off in parts:
        if len(piece) < DEPTH:
            continue
        words = K.loads(piece)
        grams = _gram_hashes(words, len(piece) - DIGIT + 1)
        width = DEPTH - DIGIT + 1
        v = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_sliding_min(v, width) & _PLACE).astype(np.int32)
        n = len(anchor)
        ok = np.ones(n, bool)
        for end in off[1:]:  # windows that go over the end of a text
            ok[max(0, end - DEPTH + 1) : end] = False
        head = ok.copy()
        edge = np.zeros(len(piece) + 1, bool)
        edge[off] = True
        head[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1] | edge[1:n]
        tail = ok.copy()
        tail[:-1] &= (anchor[1:] != anchor[:-1]) | ~ok[1:] | edge[1:n]
        s0, s1 = np.flatnonzero(head), np.flatnonzero(tail)
        p = anchor[s0]
        context = K.mix(K.span_hashes(piece, s0, s1 + DEPTH, words) + (p - s0).astype(np.uint64))
        text = np.searchsorted(off, s0, side="right") - 1
        out.append((*digits(words, p.astype(np.int64), DIGIT), context, text + first, s0 - off[text] + base, s1 - s0))
    if not out:
        empty = np.zeros(0, np.int64)
        return *(np.zeros(0, np.uint64) for _ in range(3)), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
