"""Operator 4: personal data, also where it is disguised.

Base detectors run on the text as it is. Transducers then rewrite a text - look-alike characters,
spelled digits, at/dot disguises - and keep for each character of the result the source characters it
stands for; the detectors run on what each of them gives and their spans are mapped back. A mapped span that
overlaps a base span is not added, nor is one that overlaps a span of a later transducer.

At and dot may be spoken, in brackets or plain in any mixture, but one dot has to be disguised: a spoken at
before plain dots ("look at example.com", "at 3.5") is no address. Digits and spelled digits count alike;
the detectors decide whether they make a number.

Defined results: null and empty texts have no spans; repeated rows give a row each; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

KINDS = ("email", "ip", "card", "phone")
_LOCAL_BYTES = np.zeros(256, bool)
_LOCAL_BYTES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-", np.uint8)] = True
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Possessive, and begun where digits begin: the same matches in time that grows with the text.
_IP = re.compile(rb"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[^0-9]+")

# Spelled digits, and letters of other scripts that look like Latin ones.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "‐": "-", "‑": "-", "–": "-", "․": ".", "。": ".", "·": ".",
}
_SPOKEN_WORDS = (*SPELLED, "point")
INVISIBLE = {"​", "‌", "‍", "⁠", "﻿", "­"}
#: Digits that the shortest number (an IP) has.
LEAST_DIGITS = 4

_AT_DOT = re.compile(r"(?:\[\s*+(?P<a>at|dot|@|\.)\s*+\]|\(\s*+(?P<b>at|dot|@|\.)\s*+\)|\{\s*+(?P<c>at|dot|@|\.)\s*+\}|<\s*+(?P<d>at|dot|@|\.)\s*+>)\s*+", re.I)
_SPOKEN = re.compile(r"(?<![\w.%+-])([A-Za-z0-9._%+-]++)(\s++at\s++|\s*+@\s*+)([A-Za-z0-9-]++)((?:(?:\s++dot\s++|\.)[A-Za-z0-9-]++)+)", re.I)
_SPOKEN_DOT = re.compile(r"\s+dot\s+|\.", re.I)
_SPELLED_RUN = re.compile(r"(?<!\w)(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9]++)(?:[\s,-]+|(?=[.]))?(?:(?:dot|point)\s+|[.]\s*)?)+(?!\w)", re.I)
_SPELLED_WORD = re.compile(r"zero|oh|one|two|three|four|five|six|seven|eight|nine|dot|point|[0-9]|\.", re.I)
_PLUS = re.compile(r"(?:\+|(?<!\w)plus)\s*\Z", re.I)
_LETTER = re.compile(r"[A-Za-z]")


def luhn(digits: bytes) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = d - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def detect(raw: bytes) -> list[tuple[int, int, int]]:
    """Base spans (kind's index, start byte, end byte) in UTF-8 bytes, leftmost and not overlapping for each kind."""
    out, last, at = [], 0, raw.find(b"@")
    while at >= 0:
        lo = at
        while lo > last and _LOCAL_BYTES[raw[lo - 1]]:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(raw, at)):
            out.append((0, lo, last := m.end()))
        at = raw.find(b"@", max(at + 1, last))
    for m in _IP.finditer(raw):
        if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p[:-3].strip(b"0")) for p in m[0].split(b".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(raw):
        digits = _DIGIT.sub(b"", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if b"+" in raw:
        for m in _PHONE.finditer(raw):
            if 9 <= len(_DIGIT.sub(b"", m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class Mapped:
    """A text under rewriting: its characters, and for each the source characters [lo, hi) that it stands for."""

    def __init__(self, text: str):
        self.source = text
        self.text, self.lo, self.hi = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces text[start:end] by a string for each edit; edits are in order and do not overlap."""
        if not edits:
            return
        parts, lo, hi, last = [], [], [], 0
        for start, end, new in edits:
            parts += [self.text[last:start], new]
            lo += self.lo[last:start]
            hi += self.hi[last:start]
            if end > start:
                lo += [self.lo[start]] * len(new)
                hi += [self.hi[end - 1]] * len(new)
            last = end
        self.text = "".join([*parts, self.text[last:]])
        self.lo, self.hi = [*lo, *self.lo[last:]], [*hi, *self.hi[last:]]


def plain_character(c: str) -> str:
    """What a disguised character stands for; itself if it is none."""
    if c in INVISIBLE:
        return ""
    if c in LOOK_ALIKE:
        return LOOK_ALIKE[c]
    if not c.isascii() and len(n := unicodedata.normalize("NFKC", c)) == 1 and n.isascii():
        return n
    if not c.isascii() and unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    return c


@functools.cache
def rewritten() -> np.ndarray:
    """For each code point whether plain_character changes it."""
    out = np.zeros(sys.maxunicode + 1, bool)
    out[[c for c in range(128, len(out)) if not 0xD800 <= c < 0xE000 and plain_character(chr(c)) != chr(c)]] = True
    return out


def _odd_characters(buf: np.ndarray) -> np.ndarray:
    """True at the first byte of each character that plain_character changes."""
    out = np.zeros(len(buf), bool)
    at = np.flatnonzero(buf >= 0xC2)
    if len(at):
        tail = np.append(buf, np.zeros(3, np.uint8))
        lead, b, c, d = (tail[at + k].astype(np.int64) for k in range(4))
        two, three = (lead & 0x1F) << 6 | b & 0x3F, (lead & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F
        four = (lead & 0x07) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F
        code = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
        out[at] = rewritten()[np.minimum(code, sys.maxunicode)]
    return out


def homoglyphs(m: Mapped) -> None:
    if m.text.isascii():
        return
    plain = {c: p for c in set(m.text) if not c.isascii() and (p := plain_character(c)) != c}
    if plain:
        m.rewrite([(x.start(), x.end(), plain[x[0]]) for x in re.finditer("[" + "".join(map(re.escape, plain)) + "]", m.text)])


def at_and_dot(m: Mapped) -> None:
    edits = []
    for x in _AT_DOT.finditer(m.text) if any(c in m.text for c in "[({<") else ():
        word, start = next(g for g in x.groups() if g).lower(), x.start()
        while start > (edits[-1][1] if edits else 0) and m.text[start - 1].isspace():
            start -= 1
        edits.append((start, x.end(), "@" if word in ("at", "@") else "."))
    m.rewrite(edits)
    if m.text == m.source and "dot" not in m.text.lower():
        return
    edits = []
    for x in _SPOKEN.finditer(m.text):
        dots = [(x.start(4) + d.start(), x.start(4) + d.end()) for d in _SPOKEN_DOT.finditer(x[4])]
        if all(m.source[m.lo[a] : m.hi[b - 1]] == "." for a, b in dots):
            continue
        edits.append((x.start(2), x.end(2), "@"))
        edits += [(a, b, ".") for a, b in dots]
    m.rewrite(edits)


def spelled_digits(m: Mapped) -> None:
    edits = []
    for x in _SPELLED_RUN.finditer(m.text):
        if not _LETTER.search(x[0]):  # digits alone are no disguise
            continue
        found = list(_SPELLED_WORD.finditer(x[0]))
        first = x.start()
        if sign := _PLUS.search(m.text[max(0, first - 8) : first]):
            edits.append((max(0, first - 8) + sign.start(), first, "+"))
        for k, w in enumerate(found):
            lo = first + w.start()
            hi = first + (found[k + 1].start() if k + 1 < len(found) else w.end())
            word = w[0].lower()
            edits.append((lo, first + w.end(), SPELLED.get(word, "." if word in ("dot", "point") else word)))
            if hi > first + w.end():
                edits.append((first + w.end(), hi, ""))
    m.rewrite(edits)


def _shown(m: Mapped, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the text as it is rewritten so far, in code points of the source, that overlap none of `base`."""
    raw = m.text.encode("utf-8", "surrogatepass")
    found = detect(raw)
    if not found:
        return []
    place = np.cumsum(K.code_points(np.frombuffer(raw, np.uint8))) - 1
    spans = [(kind, m.lo[int(place[lo])], m.hi[int(place[hi - 1])]) for kind, lo, hi in found]
    return _apart(spans, base)


def _apart(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of the others."""
    if not others:
        return spans
    covered: list[list[int]] = []
    for _, s, e in sorted(others, key=lambda x: x[1]):
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    starts = [s for s, _ in covered]

    def free(span: tuple[int, int, int]) -> bool:
        k = bisect.bisect_left(starts, span[2]) - 1  # the last that begins before the span's end
        return k < 0 or covered[k][1] <= span[1]

    return [x for x in spans if free(x)]


def disguised(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (kind's index, start, end in code points) that show after rewriting and overlap none of `base`."""
    m, out = Mapped(text), []
    for rewrite in (homoglyphs, at_and_dot, spelled_digits):
        before = m.text
        rewrite(m)
        if m.text != before:  # what a later rewriting hides stays found
            own = _shown(m, base)
            out = own + _apart(out, own)
    return sorted(out)


def _suspicious(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a slice that may have base spans, and texts that a transducer may change."""
    digit = (buf >= 0x30) & (buf <= 0x39)
    base = K.per_text(at, digit | (buf == 0x40)) > 0
    odd = _odd_characters(buf)
    bracket = np.isin(buf, np.frombuffer(b"[({<", np.uint8))
    low = buf | 0x20
    dot = np.zeros(len(buf), bool)
    if len(buf) > 2:
        dot[:-2] = (low[:-2] == ord("d")) & (low[1:-1] == ord("o")) & (low[2:] == ord("t"))
    letter = (low >= 0x61) & (low <= 0x7A)
    starts, ends = K.word_spans(buf, at, letter)
    folded = np.where(letter, low, buf).astype(np.uint8)
    # Words that begin like a spelled digit, also those run together; each spelled digit has two letters at least.
    hit = np.zeros(len(starts), bool)
    for n in sorted({len(w) for w in _SPOKEN_WORDS}):
        known = np.sort(np.array([_word_hash(w) for w in _SPOKEN_WORDS if len(w) == n], np.uint64))
        own = np.flatnonzero(ends - starts >= n)
        h = K.span_hashes(folded, starts[own], starts[own] + n)
        hit[own] |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    text = np.searchsorted(at, starts[hit], side="right") - 1
    words = np.bincount(text, weights=(ends - starts)[hit] // 2, minlength=len(at) - 1)
    spelled = (words > 0) & (words + K.per_text(at, digit) >= LEAST_DIGITS)
    return base, (K.per_text(at, odd | bracket | dot) > 0) | spelled


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(K.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def find_spans(column: pa.Array) -> Iterator[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and the added ones, in code points."""
    for lo, hi, buf, at in K.slices(column):
        base, odd = _suspicious(buf, at)
        for i in range(hi - lo):
            if not (base[i] or odd[i]):
                yield [], []
                continue
            own = buf[at[i] : at[i + 1]]
            raw = own.tobytes()
            found = detect(raw) if base[i] else []
            if found:
                place = np.zeros(len(own) + 1, np.int64)
                np.cumsum(K.code_points(own), out=place[1:])
                found = sorted((k, int(place[s]), int(place[e])) for k, s, e in found)
            yield found, (disguised(raw.decode("utf-8", "replace"), found) if odd[i] else [])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, base and added spans as array<struct<kind, start, end>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("pii")
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in K.bounded(batches):
            both = list(find_spans(batch.column(1)))
            named = [[[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in x[j]] for x in both] for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named[0], kind), pa.array(named[1], kind)], names=["id", "base", "added"])

    own = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"id {own}, base {spans}, added {spans}").withColumnRenamed("id", id_col)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans count as one."""
    merged: list[list[int]] = []
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    parts, last = [], 0
    for kind, start, end in merged:
        parts += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = end
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data replaced in the text; n_chars, where there is such a column, is set anew."""
    where = docs.columns.index(text_col)
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.cache("pii")
        for batch in K.bounded(batches):
            columns, column = list(batch.columns), batch.column(where)
            changed = {i: redact_text(column[i].as_py(), base + added) for i, (base, added) in enumerate(find_spans(column)) if base or added}
            if changed:
                texts = column.to_pylist()
                for i, new in changed.items():
                    texts[i] = new
                columns[where] = pa.array(texts, column.type)
                if count is not None:
                    sizes = columns[count].to_pylist()
                    for i, new in changed.items():
                        sizes[i] = len(new)
                    columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
