"""Splitting bytes into the pieces that byte-level byte-pair merging works on, and a table of pieces.

The pieces are those of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np

from . import kernels as K

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_classes: dict[str, np.ndarray] = {}
LONG_TEXT = 1 << 22


def class_table() -> np.ndarray:
    """The class of each code point, by the rule of its Unicode category and White_Space."""
    if "all" not in _classes:
        import regex

        every = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        text = "".join(map(chr, (i for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(pattern, text):
                every[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        _classes["all"] = every
    return _classes["all"]


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """The class of the code point that each byte belongs to."""
    table = class_table()
    out = table[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b0 = buf[lead].astype(np.uint32)
        tail = [np.where(lead + i < len(buf), buf[np.minimum(lead + i, len(buf) - 1)], 0).astype(np.uint32) & 0x3F for i in (1, 2, 3)]
        two, three = b0 < 0xE0, b0 < 0xF0
        cp = np.where(two, (b0 & 0x1F) << 6 | tail[0], np.where(three, (b0 & 0x0F) << 12 | tail[0] << 6 | tail[1], (b0 & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        kind = table[np.minimum(cp, sys.maxunicode)]
        out[lead] = kind
        for i, some in ((1, slice(None)), (2, ~two), (3, ~three)):
            at = lead[some] + i
            ok = at < len(buf)
            out[at[ok]] = kind[some][ok]
    return out


def piece_starts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The byte positions where pieces start, over all texts of a slice."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls, first = byte_classes(buf), np.zeros(n + 1, bool)
    first[at] = True
    head = K.code_points(buf)
    space = cls == SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, cls[:-1]
    previous = np.empty(n, np.uint8)
    previous[0], previous[1:] = 0, buf[:-1]
    start = (cls != before) & ~space & ~((before == SPACE) & (previous == 0x20))
    start |= space & (before != SPACE)
    if np.any(space & (buf >= 0x80) & head):  # white space of several bytes
        size = np.where(buf >= 0xF0, 4, np.where(buf >= 0xE0, 3, np.where(buf >= 0xC0, 2, 1)))
        nxt = np.arange(n) + size
    else:
        nxt = np.arange(1, n + 1)
    p = np.flatnonzero(space & head & (before == SPACE))
    q = nxt[p]
    inner = p[(q < n) & ~first[np.minimum(q, n)] & (cls[np.minimum(q, n - 1)] != SPACE)]
    start[inner] = True
    start[first[:n]] = True
    quote = np.flatnonzero(buf == 0x27)
    if len(quote):
        here = start[quote]
        quote = quote[here]
        text = np.searchsorted(at, quote, side="right")
        left = at[text] - quote
        one = buf[np.minimum(quote + 1, n - 1)]
        two = buf[np.minimum(quote + 2, n - 1)]
        short = (left > 1) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (left > 2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            start[hit + 1] = False
            end = hit + size
            start[end[end < n]] = True
    start &= head
    return np.flatnonzero(start)


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self._room, self.n = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) + 16 > len(self._room):
            room = np.zeros((self.n + max(len(values), self.n) + 1024) // 8 * 8, self._room.dtype)
            room[: self.n] = self._room[: self.n]
            self._room = room
        self._room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def array(self) -> np.ndarray:
        return self._room[: self.n]

    @property
    def words(self) -> np.ndarray:
        """The bytes as kernels.loads gives them."""
        return self._room.view(np.uint64)


class PieceTable:
    """Open-addressed hash table from pieces to token sequences; when full it starts anew, so its memory is bounded.

    value(pieces) gives (counts, symbols of all pieces end to end or None); it is asked once for a piece
    between two such starts. Hashes are the keys, but a row counts for a piece only if its bytes are the piece's.
    """

    def __init__(self, value: Callable[[list[bytes]], tuple], bits: int = 21):
        self.value, self.bits = value, bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.counts, self.first, self.symbols = Growing(np.int32), Growing(np.int64), Growing(np.int32)
        self.raw, self.at, self.size = Growing(np.uint8), Growing(np.int64), Growing(np.int64)

    def _add(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of new pieces, without keys."""
        pieces = [buf[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        row0, size = self.counts.n, ends - starts
        counts, symbols = self.value(pieces)
        self.counts.extend(counts)
        self.at.extend(self.raw.n + np.cumsum(size) - size)
        self.size.extend(size)
        self.raw.extend(np.frombuffer(b"".join(pieces), np.uint8))
        if symbols is not None:
            self.first.extend(self.symbols.n + np.cumsum(counts) - counts)
            self.symbols.extend(symbols)
        return np.arange(row0, row0 + len(pieces), dtype=np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.keys[at]
        out = np.where(got == h, self.rows[at], -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            got = self.keys[at[open_]]
            hit = got == h[open_]
            out[open_[hit]] = self.rows[at[open_[hit]]]
            open_ = open_[~hit & (got != 0)]
        return out

    def look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each piece in `counts` and `first`; pieces not met before are added."""
        words = K.loads(buf)
        h = K.span_hashes(buf, starts, ends, words) | np.uint64(1)
        out = self._find(h)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            fresh, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            if self.counts.n + len(fresh) > (1 << self.bits) * 6 // 10:
                if self.counts.n:
                    self.clear()
                    return self.look_up(buf, starts, ends)
                self.bits += 1
                self.clear()
                return self.look_up(buf, starts, ends)
            rows = self._add(buf, starts[missing[first]], ends[missing[first]])
            mask, at = (1 << self.bits) - 1, (fresh >> np.uint64(64 - self.bits)).astype(np.int64)
            todo = np.arange(len(fresh))
            while len(todo):
                spot = at[todo]
                free = self.keys[spot] == 0
                _, lead = np.unique(spot[free], return_index=True)
                winners = todo[free][lead]
                self.keys[at[winners]] = fresh[winners]
                self.rows[at[winners]] = rows[winners]
                placed = np.zeros(len(fresh), bool)
                placed[winners] = True
                todo = todo[~placed[todo]]
                at[todo] = (at[todo] + 1) & mask
            out[missing] = rows[inverse]
        size = ends - starts
        same = self.size.array[out] == size
        fits = np.flatnonzero(same)
        same[fits] = K.equal_spans(words, starts[fits], self.raw.words, self.at.array[out[fits]], size[fits])
        other = np.flatnonzero(~same)
        if len(other):  # other bytes of the same hash
            out[other] = self._add(buf, starts[other], ends[other])
        return out


def parts(buf: np.ndarray, at: np.ndarray, most: int = LONG_TEXT) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(texts, bytes, offsets): all of a slice at once or, for a single text above `most` bytes, in parts.

    Parts meet where a cut leaves all pieces as they are, at a space between two ASCII letters; where a
    long text has none, it stays whole.
    """
    if len(at) > 2 or len(buf) <= most:
        if len(buf):
            yield slice(None), buf, at
        return
    lo, pos = 0, most
    while pos < len(buf) - 2:
        window = buf[pos : pos + 65536]
        low = window | 0x20
        letter = (low >= 0x61) & (low <= 0x7A)
        ok = np.flatnonzero((window[1:-1] == 0x20) & letter[:-2] & letter[2:])
        if len(ok):
            hi = pos + 1 + int(ok[0])
            yield slice(0, 1), buf[lo:hi], np.array([0, hi - lo])
            lo, pos = hi, hi + most
        else:
            pos += 65534
    yield slice(0, 1), buf[lo:], np.array([0, len(buf) - lo])


def without_special(column, special: str) -> Iterator[tuple[int, list[str]]]:
    """(row, parts) of the texts that hold the special string, parts being what lies around it."""
    import pyarrow.compute as pc

    for i in np.flatnonzero(pc.fill_null(pc.match_substring(column, special), False).to_numpy(zero_copy_only=False)):
        yield int(i), column[int(i)].as_py().split(special)
