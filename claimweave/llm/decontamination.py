"""Operator 10: benchmark decontamination by template canonicalisation.

Words are lower-cased; numbers, names (capitalised words that do not begin a sentence; several in a row are
one; words all in capitals are none) and units after a number become typed placeholders. Windows of WINDOW template words of a document are
hash-joined to those of the benchmark. Hits of an item that lie on one diagonal are a candidate passage;
there each slot value of the item must always stand for one value of the document, or the hit counts no
further than it is consistent. Windows of placeholders alone count only beside others; an item that has no others
is matched whole. An item is found if at least CONTAINMENT of its windows, or RUN words on
end, are.

Defined results: null and empty texts hold nothing; an item of fewer than WINDOW template words is matched
whole if it has LEAST words, else never; rows without an id are searched too; repeated rows give their rows
each; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .quality_rules import window_hashes

WINDOW, CONTAINMENT, RUN, LEAST = 5, 0.8, 13, 3
#: Bytes of benchmark text that one pass over the documents holds in memory.
BLOCK_BYTES = 8 << 20
# Units.
UNITS = "kg g mg km m cm mm mi ft in lb lbs oz l ml s sec min h hr hrs hours hour minutes minute seconds second days day weeks week months month years year dollars dollar cents euros euro pounds pound percent degrees miles mile meters metres kilometers kilometres grams kilograms liters litres".split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_SIGN = np.zeros(256, bool)
_SIGN[np.frombuffer(b".!?\n:;\"", np.uint8)] = True


def folded(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ASCII and Latin-1 capitals lower-cased, and where a capital begins."""
    out = K.FOLD[buf]
    capital = (buf >= 65) & (buf <= 90)
    second = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
    out[1:][second] += 0x20
    capital[:-1] |= second
    return out, capital


class Templates:
    """The template words of the texts of a slice: text, hash, and start and end byte of each."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        low, capital = folded(buf) if len(buf) else (buf, np.zeros(0, bool))
        inside = _WORD[buf]
        digit = _DIGITS[buf]
        if len(buf) > 2:  # a point or comma between digits belongs to the number
            joint = np.zeros(len(buf), bool)
            joint[1:-1] = digit[:-2] & digit[2:] & np.isin(buf[1:-1], np.frombuffer(b".,", np.uint8))
            joint[at[1:-1][at[1:-1] < len(buf)]] = False
            inside = inside | joint
        s, e = K.word_spans(buf, at, inside)
        h = K.span_hashes(low, s, e)
        text = np.searchsorted(at, s, side="right") - 1
        number = digit[s] if len(s) else np.zeros(0, bool)
        signs = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_SIGN[buf], out=signs[1:])
        begins = np.ones(len(s), bool)
        if len(s) > 1:
            begins[1:] = (text[1:] != text[:-1]) | (signs[s[1:]] > signs[e[:-1]])
        name = ~number & ~begins & (capital[s] if len(s) else number)
        if len(s):  # words in capitals throughout, and single letters, are none
            second = s + 1 + (buf[s] == 0xC3)
            name &= (second < e) & ~capital[np.minimum(second, len(buf) - 1)]
        unit = np.zeros(len(s), bool)
        if len(s) > 1:
            known = _unit_hashes()
            unit[1:] = number[:-1] & (text[1:] == text[:-1]) & (known[np.minimum(np.searchsorted(known, h[1:]), len(known) - 1)] == h[1:])
        name &= ~unit
        self.raw = h.copy()
        h[number], h[name], h[unit] = _NUMBER, _NAME, _UNIT
        keep = np.ones(len(s), bool)
        if len(s) > 1:
            keep[1:] = ~(name[1:] & name[:-1] & (text[1:] == text[:-1]))
        last = np.append(np.flatnonzero(keep)[1:] - 1, len(s) - 1) if len(s) else np.zeros(0, np.int64)
        self.text, self.hash, self.start, self.end = text[keep], h[keep], s[keep], e[last] if len(s) else e
        self.slot = (number | name | unit)[keep]
        self.low = low

    def value(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        raw = [np.frombuffer(u.encode(), np.uint8) for u in UNITS]
        _units.append(np.sort(np.array([K.span_hashes(r, np.array([0]), np.array([len(r)]))[0] for r in raw], np.uint64)))
    return _units[0]


class Benchmark:
    """Window hashes of a block of items, and their template words."""

    def __init__(self, ids: list, texts: list[str | None]):
        column = pa.array(texts, pa.string())
        buf, at = K.texts(column)
        self.ids, self.words, self._known = ids, Templates(buf, at), {}
        self.first = np.searchsorted(self.words.text, np.arange(len(ids) + 1))
        count = np.diff(self.first)
        self.size = [min(WINDOW, int(c)) for c in count]
        self.count = [int(c) - s + 1 for c, s in zip(count, self.size, strict=True)]
        # Windows of placeholders alone stand anywhere; they count beside windows with a word, and begin no search.
        plain = np.append(0, np.cumsum(~self.words.slot))
        places = defaultdict(list)
        for item in np.flatnonzero(count >= LEAST).tolist():
            first, size, n = int(self.first[item]), self.size[item], int(count[item])
            begins = [i for i in range(n - size + 1) if plain[first + i + size] > plain[first + i]]
            if not begins:  # no word at all: all of it or nothing
                self.size[item], self.count[item], begins, size = n, 1, [0], n
            found = self._hashes(size)
            for i in begins:
                places[size, int(found[first + i])].append((item, i))
        self.windows = {size: np.sort(np.array([h for s, h in places if s == size], np.uint64)) for size in {k[0] for k in places}}
        self.places = dict(places)

    def _hashes(self, size: int) -> np.ndarray:
        if size not in self._known:
            self._known[size] = window_hashes(self.words.hash, size)
        return self._known[size]

    def search(self, buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, windows found, longest run in words, slots) of the items found in the texts of a slice."""
        words = Templates(buf, at)
        hits: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        hashes: dict[int, np.ndarray] = {}
        for size, keys in self.windows.items():
            h = hashes[size] = window_hashes(words.hash, size)
            if not len(h):
                continue
            spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = np.flatnonzero((keys[spot] == h) & (words.text[: len(h)] == words.text[size - 1 :]))
            for j in found.tolist():
                for item, i in self.places[size, int(h[j])]:
                    hits[int(words.text[j]), item][j - i].append(i)
        for (text, item), diagonals in hits.items():
            size, seen, longest, slots = self.size[item], set(), 0, 0
            first, own, h = int(self.first[item]), self._hashes(size), hashes[size]
            for diagonal, starts in diagonals.items():
                known = set(starts)
                beside = [i for i in range(self.count[item]) if i not in known and 0 <= diagonal + i < len(h) and h[diagonal + i] == own[first + i] and words.text[diagonal + i] == words.text[diagonal + i + size - 1] == text]
                starts = sorted([*starts, *beside])
                for run in _runs(starts):
                    good, n = self._consistent(words, item, diagonal, run, size)
                    slots = max(slots, n)
                    for part in _runs(good):
                        longest = max(longest, part[-1] - part[0] + size)
                    seen.update(good)
                if len(seen) == self.count[item]:  # all of it; further places add nothing
                    break
            if len(seen) >= CONTAINMENT * self.count[item] or longest >= RUN:
                yield text, item, len(seen), longest, slots

    def _consistent(self, words: Templates, item: int, diagonal: int, run: list[int], size: int) -> tuple[list[int], int]:
        """The windows of a run whose slots agree with those before them, and the number of slots."""
        base, there, back, bad, slots = int(self.first[item]), {}, {}, set(), 0
        for i in range(run[0], run[-1] + size):
            if not self.words.slot[base + i]:
                if self.words.value(base + i) != words.value(diagonal + i):  # another word of the same hash
                    bad.add(i)
            else:
                slots += 1
                kind = int(self.words.hash[base + i])
                own, other = (kind, self.words.value(base + i)), (kind, words.value(diagonal + i))
                if there.setdefault(own, other) != other or back.setdefault(other, own) != own:
                    bad.add(i)
        return [i for i in run if not any(k in bad for k in range(i, i + size))] if bad else run, slots


def _runs(sorted_: list[int]) -> Iterator[list[int]]:
    """Maximal runs of consecutive numbers."""
    run: list[int] = []
    for i in sorted_:
        if run and i != run[-1] + 1:
            yield run
            run = []
        run.append(i)
    if run:
        yield run


def _held(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[Broadcast]:
    """The benchmark's blocks (ids, texts) for the workers."""
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(blocks)) == b).select(item_col, item_text).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item found in it: id, item, n_windows, n_item_windows, longest_run, n_slots.

    The benchmark is held in blocks of BLOCK_BYTES; each block takes one pass over the documents.
    """
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    names = ["_doc", "_item", "n_windows", "n_item_windows", "longest_run", "n_slots"]
    out = None
    for held in _held(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            K.cache("decontamination")
            items = Benchmark(*held.value)
            for batch in K.bounded(batches):
                for lo, _, buf, at in K.slices(batch.column(1)):
                    found = list(items.search(buf, at))
                    if found:
                        own = batch.column(0).take(pa.array([lo + f[0] for f in found]))
                        item = pa.array([items.ids[f[1]] for f in found])
                        counts = [[f[2] for f in found], [items.count[f[1]] for f in found], [f[3] for f in found], [f[4] for f in found]]
                        yield pa.RecordBatch.from_arrays([own, item, *(pa.array(c, pa.int64()) for c in counts)], names=names)

        part = docs.select(id_col, text_col).mapInArrow(run, f"_doc {kinds[0]}, _item {kinds[1]}, {', '.join(f'{n} long' for n in names[2:])}")
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"_doc": id_col, "_item": item_col})


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, with all their columns. Each row goes by its own text, whatever its id."""
    where = docs.columns.index(text_col)
    for held in _held(benchmark, item_col, item_text):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            K.cache("decontamination")
            items = Benchmark(*held.value)
            for batch in K.bounded(batches):
                clean = np.ones(len(batch), bool)
                for lo, _, buf, at in K.slices(batch.column(where)):
                    clean[[lo + f[0] for f in items.search(buf, at)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
