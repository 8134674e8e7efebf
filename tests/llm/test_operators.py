"""Each operator against a brute-force version or an exact round trip, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimweave.llm import crf, decontamination, kernels, licenses, near_dedup, packing, pii, pretokens, quality_rules, queries, sharding, suffix_dedup, token_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_count.vocabulary_path())


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


THUE = [0]
while len(THUE) < 1024:
    THUE += [1 - x for x in THUE]
TWINS = ["".join("ab"[x] for x in THUE), "".join("ba"[x] for x in THUE)]


def test_structured_texts_are_told_apart(spark, library):
    """Thue-Morse strings collide under every polynomial hash modulo 2**64."""
    both = spark.createDataFrame([(0, TWINS[0]), (1, TWINS[1]), (2, TWINS[0] + "\n" + TWINS[1])], "doc_id long, text string")
    packed = by_id(packing.pack(both.where("doc_id < 2")))
    for i in range(2):
        ids = np.array([*library.encode(TWINS[i], add_special_tokens=False).ids, 0], "<u4")
        assert packed[i].ids_crc32 == zlib.crc32(ids.tobytes())
    assert [r.n_tokens for r in token_count.count_tokens(both).orderBy("doc_id").collect()] == [len(library.encode(t, add_special_tokens=False).ids) for t in (*TWINS, TWINS[0] + "\n" + TWINS[1])]
    buf, at = kernels.texts(pa.array([TWINS[0] + "\n" + TWINS[1]]))
    assert quality_rules.measures(buf, at)[3].tolist() == [0]
    assert [r.component_id for r in near_dedup.link(both.where("doc_id < 2")).orderBy("doc_id").collect()] == [0, 1]
    assert [(r.n_removed, r.kept_sha256) for r in suffix_dedup.remove(both).orderBy("doc_id").collect()] == [(w[1], w[3]) for w in cut([*TWINS, TWINS[0] + "\n" + TWINS[1]])]


def test_equal_hashes_do_not_make_equal_spans(monkeypatch):
    rng = random.Random(9)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(600)]
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    want = {w: i for i, w in enumerate(dict.fromkeys(words))}
    for weak in (False, True):
        if weak:  # hashes of two bits: bytes decide
            true = kernels.span_hashes
            monkeypatch.setattr(kernels, "span_hashes", lambda *a: true(*a) & np.uint64(3))
        got = kernels.distinct_spans(buf, starts, ends).tolist()
        assert len({(w, g) for w, g in zip(words, got, strict=True)}) == len(want) == len(set(got))
        table = pretokens.PieceTable(lambda ps: (np.array([len(p) + 1 for p in ps], np.int32), None), bits=12)
        rows = table.look_up(buf, starts, ends)
        assert table.counts.array[rows].tolist() == [len(w) + 1 for w in words]


def test_radix_order_is_byte_order():
    from claimweave.llm import suffix_runs

    rng = random.Random(10)
    raw = bytes(rng.choice(b"ab\x00\xff") for _ in range(3000)) * 2
    at = np.arange(len(raw) - 49)
    order, level = suffix_runs.radix_order(suffix_runs.digits(kernels.loads(np.frombuffer(raw, np.uint8)), at, 50))
    own = [raw[i : i + 50] for i in order]
    assert own == sorted(own) and [a == b for a, b in zip(own, own[1:], strict=False)] == (level[1:] == 7).tolist()


# --- 7 and 1 ---------------------------------------------------------------------------------------------------


def test_counts_equal_the_library(library):
    rng = random.Random(2)
    parts = ["'s", "'re", "'", " ", "  ", "\n", "\t", "a", "bc", "é", "　", "\x85", "\x1c", "12", "٣", "½", "!", "...", "😀", "中文", "́", "<|endoftext|>", "l", "_", "Ⅷ"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in made]
    assert token_count.count_texts(pa.array(made), token_count.vocabulary_path()).tolist() == want


def test_parts_and_a_full_table_change_nothing(library):
    text = " ".join(f"word{i} and" for i in range(3000))
    merger = token_count.Merger(token_count.vocabulary_path())
    table = pretokens.PieceTable(lambda ps: (np.array([merger.count(p) for p in ps], np.int32), None), bits=6)
    raw = np.frombuffer(text.encode(), np.uint8)
    pieces = list(pretokens.parts(raw, np.array([0, len(raw)]), 1000))
    assert len(pieces) > 10 and b"".join(p.tobytes() for _, p, _ in pieces) == text.encode()
    total = 0
    for _, part, off in pieces:
        starts = pretokens.piece_starts(part, off)
        rows = table.look_up(part, starts, np.append(starts[1:], len(part)))
        total += int(table.counts.array[rows].sum())
    assert total == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts(docs, empty, texts, library):
    got = by_id(token_count.count_tokens(docs))
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_count.count_tokens(empty).count() == 0
    assert token_count.count_tokens(docs.unionByName(docs)).count() == 2 * len(texts)


def test_packing_round_trip(docs, empty, texts, library):
    got = packing.pack(docs).collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(r.ids for r in own) == ids.tobytes()
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)  # gapless
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024 and sorted(fill) == list(range(len(fill)))
    assert packing.pack(empty).count() == 0
    whole = packing.sequences(packing.pack(docs)).collect()
    assert all(len(r.ids) == 4096 for r in whole) and sum(r.n_tokens for r in whole) == sum(fill.values())


def test_plan_is_tight():
    rng = random.Random(1)
    h = Counter(rng.randrange(1, 1024) for _ in range(20000)) + Counter({1024: 3})
    runs, n = packing.plan(h)
    placed = Counter()
    for size, lo, hi, _, _ in runs:
        placed[size] += hi - lo
    assert placed == h and 1 - sum(k * v for k, v in h.items()) / 1024 / n < 0.01
    assert packing.plan({}) == ([], 0)


# --- 2 ---------------------------------------------------------------------------------------------------------


def cut(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = bytearray(len(b))
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, f in zip(b, gone, strict=True) if not f)
        out.append((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("common", [0.02, 1e-9])
def test_suffix_dedup(docs, empty, texts, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON_SHARE", common)  # also with hot anchors ordered through all bytes at once
    got = by_id(suffix_dedup.remove(docs))
    want = cut(texts)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.values())
    assert suffix_dedup.remove(empty).count() == 0


def test_suffix_dedup_repeated_rows(docs):
    once, twice = by_id(suffix_dedup.remove(docs)), suffix_dedup.remove(docs.unionByName(docs)).collect()
    assert len(twice) == 2 * len(once) and all(r.kept_sha256 == once[r.doc_id].kept_sha256 for r in twice)


# --- 3 ---------------------------------------------------------------------------------------------------------


def test_marginals_are_exact():
    rng = np.random.default_rng(3)
    text = np.repeat([0, 1, 2], [1, 4, 3])
    emission, step = rng.normal(size=8), rng.normal(size=(2, 2))
    good, _ = crf.marginals(emission, step, text)
    for t in range(3):
        own = emission[text == t]
        weights = np.zeros((len(own), 2))
        for code in range(2 ** len(own)):
            y = [(code >> i) & 1 for i in range(len(own))]
            w = np.exp(sum(own[i] for i in range(len(own)) if y[i]) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False)))
            for i, v in enumerate(y):
                weights[i, v] += w
        assert np.allclose(good[text == t], weights[:, 1] / weights.sum(axis=1))


def features(text):
    """The features of each line with a word, by plain Python."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    out = []
    for line in lines:
        words, raw = WORD.findall(line), line.encode()
        inside = sum(len(w.encode()) for w in words)
        pairs = list(zip(words, words[1:], strict=False))
        letters = max(1, sum(1 for c in line if (c.isascii() and c.isalpha()) or ord(c) > 127))
        count = lambda chars, own=line: sum(c in chars for c in own)
        out.append([
            1, np.log1p(inside) / 8, min(count("#*$%&|<>!=@^~{}[]_\\/") / inside * 4, 2), min(count("#*$%&|<>!=@^~{}[]_\\/") / len(words), 3) / 3,
            sum(c.isascii() and c.isupper() for c in line) / letters, sum(a == b for a, b in pairs) / len(words), 1 - len(set(words)) / len(words), (len(pairs) - len(set(pairs))) / len(words),
            min(np.log2(lines.count(line)), 4) / 4, min(count("0123456789") / inside * 4, 2), min(inside / len(words) / 10, 2), sum(len(w.encode()) > 20 for w in words) / len(words), min(count(".!?") / len(words) * 4, 2), float(len(words) <= 3),
        ])
        assert len(raw) >= inside
    return out


def test_line_features_and_scores_by_brute_force(texts):
    some = [t for t in texts if t and len(t) < 2000]
    buf, at = kernels.texts(pa.array(some))
    own, text, size = crf.line_features(buf, at)
    want = [features(t) for t in some]
    assert np.allclose(own, np.array([x for f in want for x in f])) and np.bincount(text, minlength=len(some)).tolist() == list(map(len, want))
    rng = np.random.default_rng(5)
    model = crf.Model(rng.normal(size=3 * crf.N_OWN), rng.normal(size=(2, 2)), 1.3, -0.2)
    got = crf.score_slice(model, buf, at)
    for t, (doc, rows) in enumerate(zip(some, want, strict=True)):
        if not 0 < len(rows) <= 6:
            continue
        nil = [0.0] * crf.N_OWN
        emission = [np.dot(model.emission, [*r, *(rows[i - 1] if i else nil), *(rows[i + 1] if i + 1 < len(rows) else nil)]) for i, r in enumerate(rows)]
        good, every = np.zeros(len(rows)), 0.0
        for code in range(2 ** len(rows)):
            y = [(code >> i) & 1 for i in range(len(rows))]
            w = np.exp(sum(e for e, v in zip(emission, y, strict=True) if v) + sum(model.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
            good, every = good + w * np.array(y), every + w
        weight = np.array([len(x.encode()) for x in doc.split("\n") if WORD.search(x)])
        share = np.clip((good / every * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        assert np.isclose(got[t], 1 / (1 + np.exp(-(1.3 * np.log(share / (1 - share)) - 0.2))))


def test_quality(spark, docs, empty, texts):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice("river stone bright window carries morning".split()) for _ in range(60)]
        lines = [" ".join(x + ("###" if bad else "") for x in w[k : k + 12]) + "." for k in range(0, 60, 12)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    model = crf.train(made, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = by_id(crf.score(made, model))
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(got[i].predicted == int(i % 4 != 0) for i in held)
    odd = by_id(crf.score(docs, model))
    assert len(odd) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd.values())
    assert crf.score(empty, model).count() == 0
    nothing = crf.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert nothing is None and crf.score(docs, nothing).first().score == 0.5


# --- 4 ---------------------------------------------------------------------------------------------------------

KINDS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s).encode()), lambda s: 9 <= len(digits(s)) <= 15]
    return [(k, m.start(), m.end()) for k in range(4) for m in re.finditer(KINDS[k], t) if ok[k](m[0])]


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    parts = ["a", "B", "@", "@", ".", " ", "-", "1", "0", "00", "255", "256", "1.2.3.4", "+4", "(", "é", "x@y.z", "4111 1111 1111 1111", "++", "+1 (555) 010-9999", "_"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(5000)]
    assert [b for b, _ in pii.find_spans(pa.array(made))] == [base_spans(t) for t in made]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john (at) example [dot] com now", [("email", "john (at) example [dot] com")]),
        ("john.doe at mail dot example dot com", [("email", "john.doe at mail dot example dot com")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("card ４１１１ １１１１ １１１１ １１１１.", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("ip one nine two dot one six eight dot one dot one ok", [("ip", "one nine two dot one six eight dot one dot one")]),
        ("call plus four four two zero seven nine four six zero now", [("phone", "plus four four two zero seven nine four six zero")]),
        ("look at one dot", []), ("one two three", []), ("plain text", []), ("(at) [dot]", []),
    ],
)
def test_disguises(text, found):
    _, added = next(pii.find_spans(pa.array([text])))
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in added] == found


def test_no_character_that_is_rewritten_is_passed_over():
    own = [chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(own), 1 << 16):
        part = own[k : k + (1 << 16)]
        for lo, hi, buf, at in kernels.slices(pa.array(part)):
            assert pii._suspicious(buf, at)[1].tolist() == [pii.plain_character(c) != c for c in part[lo:hi]]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("bob@example。com", "email"), ("4111\u00a01111\u00a01111\u00a01111", "card"), ("4111\u30001111\u30001111\u30001111", "card"), ("+1\u00a0555\u00a0010\u00a09999", "phone"),
        ("bob@ex\u00aample.\u00baom.\u1d9cx", "email"), ("bob@\u017fite.com", "email"),
    ],
)
def test_look_alikes_are_found_without_company(text, kind):
    (_, alone), (_, beside) = pii.find_spans(pa.array([text, text + " (α)"]))
    assert alone == beside == [(pii.KINDS.index(kind), 0, len(text))]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("ip 192 dot 168 dot 0 dot 1 ok", [("ip", "192 dot 168 dot 0 dot 1")]), ("ip 192 point 168 point 0 point 1 ok", [("ip", "192 point 168 point 0 point 1")]), ("ip 192.168.zero.1 ok", [("ip", "192.168.zero.1")]),
        ("call +1 555 one two three 4567 now", [("phone", "+1 555 one two three 4567")]), ("call +1 (555) 010 nine nine 99 now", [("phone", "+1 (555) 010 nine nine 99")]), ("call +fourfourtwozerosevenninefoursixzero", [("phone", "+fourfourtwozerosevenninefoursixzero")]),
        ("card 4111 one one one one 1111 1 one 11 ok", [("card", "4111 one one one one 1111 1 one 11")]),
        ("to john [at] example dot com now", [("email", "john [at] example dot com")]), ("to john@example dot com now", [("email", "john@example dot com")]), ("to john at example [dot] com now", [("email", "john at example [dot] com")]),
        ("to john at mail.example dot com now", [("email", "john at mail.example dot com")]), ("to john @ example dot com now", [("email", "john @ example dot com")]), ("to john at example。com now", [("email", "john at example。com")]), ("to john (at) example.com now", [("email", "john (at) example.com")]),
        ("one ４１１１ １１１１ １１１１ １１１１", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("look at example.com (here), it grew at 3.5 in one or two years", []), ("at 1, 2, 3, 4 (one) of 5", []), ("1" * 60 + "a one 22", []),
    ],
)
def test_mixed_disguises(text, found):
    _, added = next(pii.find_spans(pa.array([text])))
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in added] == found


def test_the_prefilter_changes_nothing():
    rng = random.Random(12)
    parts = ["john", "@", " at ", "(at)", "[dot]", " dot ", "example", ".com", "one", " two ", "three", "4", "192", ".", " ", "+", "plus ", "４", "а", "ｅ", "\u200b", "。", "4111 1111 1111 111", "l", "oh", "zero-", "\n", "<", "é", "中", "point "]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    want = []
    for t in made:
        base = base_spans(t)
        want.append((sorted(base), pii.disguised(t, base)))
    got = [(b, a) for b, a in pii.find_spans(pa.array(made))]
    assert got == want and sum(1 for _, a in want if a) > 100


def mapped_brute(text):
    """Look-alikes alone, one character at a time: spans of the plain text, put back by place."""
    plain, place = "", []
    for i, c in enumerate(text):
        p = pii.plain_character(c)
        plain += p
        place += [i] * len(p)
    return [(k, place[s], place[e - 1] + 1) for k, s, e in base_spans(plain)] if plain != text else []


def test_added_spans_of_look_alikes_by_brute_force():
    rng = random.Random(13)
    parts = ["jo", "ｈｎ", "@", "ex", "а", ".", "сom", "４１", "11-", "1111", "1", "+4", "\u200b", "é", "。", "-"]
    hits = 0
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))
        base = base_spans(t)
        want = sorted(x for x in mapped_brute(t) if not any(x[1] < e and s < x[2] for _, s, e in base))
        assert pii.disguised(t, base) == want
        hits += bool(want)
    assert hits > 50


@pytest.mark.parametrize(
    "text",
    ["1" * 300_000, " " * 300_000 + "one dot", "< " + "1" * 300_000 + "a", "1 " * 100_000 + "one", "(at " + " " * 300_000, "a at b" + " dot b" * 50_000, "ab@cd.ef " * 30_000 + "one dot", "one" * 100_000 + "x (at)"],
)
def test_time_grows_with_the_text(text):
    import time

    began = time.perf_counter()
    list(pii.find_spans(pa.array([text])))
    assert time.perf_counter() - began < 10


def test_pii_query_and_redaction(spark, docs, empty, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.op4_pii(spark, str(tmp_path)))
    for i, t in enumerate(texts):
        own = base_spans(t or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in own)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == j for x in own) for j in range(4)]
    clean = by_id(pii.redact(docs))
    assert set(pii.redact(docs).columns) == set(docs.columns)
    last = clean[len(texts) - 3].text
    assert last == "mail [EMAIL] or [PHONE], ip [IP], card [CARD]" and clean[len(texts) - 3].n_chars == len(last)
    assert clean[len(texts) - 2].text == "write to [EMAIL] now"
    assert pii.redact(empty).count() == pii.find(empty).count() == 0


# --- 5 ---------------------------------------------------------------------------------------------------------


def test_quality_rules(docs, empty, texts):
    got = by_id(quality_rules.apply_rules(docs))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        twice = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 10 or 100 * len(twice) > 20 * len(w))
    assert quality_rules.apply_rules(empty).count() == 0


def test_a_bad_host_takes_its_documents(spark):
    rows = [(i, "short" if h < 30 else " ".join(f"w{j}" for j in range(20)), f"bad{h % 2}" if h < 34 else f"good{h % 10}") for i, h in enumerate([*range(34)] + [40 + k for k in range(300)])]
    got = by_id(quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not any(got[i].kept for i in range(34)) and all(got[i].kept for i in range(34, 334))


# --- 6 ---------------------------------------------------------------------------------------------------------


def components(texts, size=2):
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(fold))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def test_near_dedup(docs, empty, texts):
    got = by_id(near_dedup.link(docs))
    want = components(texts)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == want
    assert len({c for _, c, _ in want}) < len(texts) - 10
    assert near_dedup.link(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if w[2]]


@pytest.mark.parametrize("head", [3, 128])
def test_what_leaders_leave_is_found(spark, monkeypatch, head):
    monkeypatch.setattr(near_dedup, "HEAD", head)
    rng = random.Random(8)
    base = [f"w{rng.randrange(300)}" for _ in range(60)]
    made = []
    for k in range(80):
        w = list(base)
        for _ in range(k % 12):
            w[rng.randrange(60)] = f"w{rng.randrange(300)}"
        made.append(" ".join(w[: 60 - k % 5]))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    words = [m.split() for m in made]
    own = [set(zip(w, w[1:], strict=False)) for w in words]
    alike = lambda a, b: 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])
    for lead in (0, 11):
        members = spark.createDataFrame([(i, lead, i) for i in range(80)], "a long, b long, component long")
        found = {(r.a, r.b) for r in near_dedup.rare_pairs(members, near_dedup.full_sets(df, "doc_id", "text")).collect()}
        want = {(a, b) for b in range(80) for a in range(b) if alike(a, b) and not (alike(a, lead) and alike(b, lead))}
        assert want <= found and (lead == 0 or len(want) > 100)


def test_candidates_grow_in_proportion(spark, monkeypatch):
    listed, confirm = [], near_dedup.confirm

    def counted(pairs, sets):
        listed.append(pairs.count())
        return confirm(pairs, sets)

    monkeypatch.setattr(near_dedup, "confirm", counted)
    per = []
    for n in (150, 600):
        rng = random.Random(3)
        base = [f"w{rng.randrange(200)}" for _ in range(120)]
        made = []
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(4, 11)):
                w[rng.randrange(120)] = f"w{rng.randrange(200)}"
            made.append(" ".join(w))
        listed.clear()
        got = by_id(near_dedup.link(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")))
        assert [got[i].component_id for i in range(n)] == [c for _, c, _ in components(made)]
        per.append(sum(listed) / n)
    assert per[1] < 1.5 * per[0]


def least_similar(texts, size):
    """The least index that each text is linked with, by brute force over shingles of `size` words."""
    words = [WORD.findall((t or "").lower()) for t in texts]
    sets = [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for w in words]
    least = list(range(len(texts)))
    for _ in texts:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    return [(len(s), least[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_by_shingle_size(spark, tmp_path, size):
    import corpus_pipeline

    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    made = [" ".join(base), None, "", "one", "one", "a b c d", "a b c d", "a b c e"]
    for k in (2, 4, 6, 8, 20):  # scattered edits: 1, 2, 3, 4 and 10 percent of the words
        made.append(" ".join(f"x{k}y{i}" if i % (200 // k) == 7 else w for i, w in enumerate(base)))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    want = least_similar(made, size)
    got = by_id(near_dedup.link(df, size=size))
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(made))] == want
    kept = [i for i, (_, c) in enumerate(want) if c == i]
    assert sorted(r.doc_id for r in near_dedup.keep_one(df, size=size).collect()) == kept
    df.write.parquet(str(tmp_path / "documents.parquet"))
    if size == 5:
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()) == kept and len(kept) > len({c for _, c in least_similar(made, 2)})
    else:
        assert by_id(queries.op6_near_dedup(spark, str(tmp_path))) == got


def test_circulant_coordinates():
    sets = [np.arange(5, dtype=np.uint64), np.arange(3000, dtype=np.uint64)]
    offsets = np.array([0, 5, 3005])
    whole = near_dedup.signatures(np.concatenate(sets), offsets, 12)
    ring = near_dedup._ring_values(12)
    place = (kernels.mix(sets[0] ^ np.uint64(0x6A09E667F3BCC909)) >> np.uint64(64 - near_dedup.RING_BITS)).astype(int)
    assert whole[0].tolist() == [int(ring[place + k].min()) for k in range(12)]
    assert (near_dedup.signatures(np.concatenate(sets), offsets, 12, chunk=7) == whole).all()


# --- 8 and 9 ---------------------------------------------------------------------------------------------------


def test_sharding(docs, empty, texts, tmp_path):
    got = sharding.shard(docs, shards=5).collect()
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    places = {}
    for r in got:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and len(places) == 5
    assert max(map(len, places.values())) - min(map(len, places.values())) <= 1
    for n, adaptive in ((3, "true"), (9, "false")):  # the same places however the rows are dealt
        docs.sparkSession.conf.set("spark.sql.shuffle.partitions", n)
        docs.sparkSession.conf.set("spark.sql.adaptive.enabled", adaptive)
        assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.shard(docs.repartition(7), shards=5).collect()))
    docs.sparkSession.conf.set("spark.sql.shuffle.partitions", 4)
    docs.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(docs.unionByName(docs)).count() == 2 * len(texts)
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), shards=5)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.shard) for r in back) == sorted((r.doc_id, r.shard) for r in got)


def test_small_buckets_scatter_uniformly(spark):
    got = sharding.place(spark.range(2000).withColumnRenamed("id", "doc_id"), ["doc_id"], 4, bucket_rows=50).collect()
    assert Counter(r["shard"] for r in got) == {0: 500, 1: 500, 2: 500, 3: 500}
    assert abs(np.corrcoef([r.doc_id for r in got], [r.slot for r in got])[0, 1]) < 0.1


def test_shuffle_is_fisher_yates(spark):
    from pyspark.sql import functions as F

    seeds = spark.range(400).select("id", sharding.permutation(F.lit(6), F.lit(1), F.col("id")).alias("p"), F.array(*[F.pmod(F.xxhash64(F.lit(1), F.col("id"), F.lit(i)), F.lit(i + 1)) for i in range(1, 6)]).alias("draws")).collect()
    for r in seeds:
        own = [0]
        for i, j in enumerate(r.draws, 1):
            own.append(i)
            own[i], own[j] = own[j], own[i]
        assert r.p == own
    assert len({tuple(r.p) for r in seeds}) > 250 and all(60 > sum(r.p[k] == 0 for r in seeds) * 6 / 8 > 30 for k in range(6))


def test_many_equal_rows_are_scattered(spark):
    from pyspark.sql import functions as F

    got = sharding.place(spark.range(3000).select(F.lit(1).alias("doc_id")), ["doc_id"], 4, bucket_rows=50).collect()
    assert Counter(r["shard"] for r in got) == {0: 750, 1: 750, 2: 750, 3: 750} and len({(r.shard, r.slot) for r in got}) == 3000


LICENSE_TEXTS = [
    "Released under the MIT License.", "x under the  MIT-license and again UNDER THE MIT LICENSE", "undering the mit license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0", "cc by ncx",
    "This work is licensed under the GNU General Public License, version 3.", "under the GNU General Public License, version 3 this work is licensed", "the gnu is a public animal", None, "", "Kunder the mit license", "éunder the mit license",
]


def test_license_scan(spark, docs, empty):
    df = spark.createDataFrame(list(enumerate(LICENSE_TEXTS)), "doc_id long, text string")
    got = by_id(licenses.scan(df))
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for i, t in enumerate(LICENSE_TEXTS):
        low = (t or "").translate(fold)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        more = set(labels)
        for line in low.split("\n"):
            own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
            share = [(len(own & set(text.split())) / len(set(text.split())), label) for text, label in licenses.TEMPLATES]
            more |= {label for c, label in share if c >= 0.9 and c == max(share)[0]}
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(labels)), ",".join(sorted(more)))
        assert 0 <= r.score <= 1
    assert got[6].labels == got[7].labels == "gpl-3" and got[8].labels == ""
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs.unionByName(docs)).count() == 2 * docs.count()


def test_a_line_gets_every_notice_it_holds(spark):
    gpl = "This work is licensed under the GNU General Public License, version "
    bsd = "Redistribution and use in source and binary forms, with or without modification, are allowed"
    rows = ["Released under the MIT License. " + bsd, gpl + "3", gpl + "2", gpl + "3. " + gpl + "2", bsd]
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert [got[i].labels for i in range(len(rows))] == ["bsd,mit", "gpl-3", "gpl-2", "gpl-2,gpl-3", "bsd"]


def test_notices_broken_over_lines(spark):
    mit = "Permission is hereby granted, free of charge, to any person\n obtaining a copy of this software\n# and associated documentation files"
    gpl = "the\nThis work is licensed under the GNU General\nPublic License, version "
    rows = [f"code\n\n{mit} (the Software)", gpl + "3\nmore", gpl + "2", "Redistribution and use in source\nand binary forms, with or without\nmodification, are allowed", "released far\nfrom what is under\nthe sun of any MIT\nstudent and a license"]
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert [got[i].labels for i in range(len(rows))] == ["mit", "gpl-3", "gpl-2", "bsd", ""] and got[0].score == 1.0


# --- 10 --------------------------------------------------------------------------------------------------------

ITEMS = [(1, "If Tom buys 3 apples and Mary buys 12 apples at 4 dollars each, how much does Tom pay for 3 apples?"), (2, "The quick brown fox jumps over the lazy dog near a river bank today."), (3, None), (4, "two words")]


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [
        "zzz. If Anna buys 5 apples and Bob Lee buys 20 apples at 7 euros each, how much does Anna pay for 5 apples? yes", "THE QUICK brown fox, jumps over the lazy dog near a river bank today", "quick brown fox jumps high", None, "",
        "If Anna buys 5 apples and Anna buys 20 apples at 7 euros each, then Carl pay for 9 apples?",
    ]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(df, items).collect()) == [(0, 1), (1, 2)]
    assert sorted(r.doc_id for r in decontamination.keep_clean(df, items).collect()) == [2, 3, 4, 5]
    assert decontamination.find_leaks(docs, items).count() == 0
    assert decontamination.find_leaks(empty, items).count() == 0 and decontamination.find_leaks(df, items.where("false")).count() == 0


WORDS = ["add", "the", "Tom", "Mary", "river", "3", "12", "kg", "apples", "4.5", "USA", "and", "Bob", "Lee", "7"]


def template(text):
    """(placeholder or word, value) of each template word, by plain Python."""
    found = [(m[0], m.start(), m.end()) for m in re.finditer(r"(?:[0-9](?:[.,](?=[0-9]))?|[A-Za-z])+", text)]
    out, last, before = [], 0, ""
    for w, s, e in found:
        begins = not out or any(c in ".!?\n:;\"" for c in text[last:s])
        if w[0].isdigit():
            kind = "NUMBER"
        elif out and before == "NUMBER" and w.lower() in decontamination.UNITS:
            kind = "UNIT"
        elif not begins and w[0].isupper() and len(w) > 1 and not w[1].isupper():
            kind = "NAME"
        else:
            kind = w.lower()
        if kind == before == "NAME":
            out[-1] = ("NAME", text[out[-1][2] : e].lower(), out[-1][2])
        else:
            out.append((kind, w.lower(), s))
        last, before = e, kind
    return [(k, v) for k, v, _ in out]


def leaked(doc, item):
    """Whether the item is found, by comparing every diagonal word by word."""
    d, q = template(doc), template(item)
    placeholder = ("NUMBER", "NAME", "UNIT")
    if len(q) < decontamination.LEAST:
        return False
    size = min(decontamination.WINDOW, len(q))
    if not any(k not in placeholder for k, _ in q):
        size = len(q)
    whole = len(q) - size + 1
    seen, longest = set(), 0
    for shift in range(-len(q), len(d) + 1):
        same = [0 <= shift + i < len(d) and d[shift + i][0] == k for i, (k, _) in enumerate(q)]
        hits = [i for i in range(whole) if all(same[i : i + size])]
        if not any(any(k not in placeholder for k, _ in q[i : i + size]) or size == len(q) for i in hits):
            continue
        runs = []
        for i in hits:
            if runs and i == runs[-1][-1] + 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            there, back, bad = {}, {}, set()
            for i in range(run[0], run[-1] + size):
                if q[i][0] in placeholder:
                    a, b = q[i], d[shift + i]
                    if there.setdefault(a, b) != b or back.setdefault(b, a) != a:
                        bad.add(i)
            good = [i for i in run if not any(k in bad for k in range(i, i + size))]
            seen.update(good)
            n = 0
            for k, i in enumerate(good):
                n = n + 1 if k and i == good[k - 1] + 1 else 1
                longest = max(longest, n - 1 + size)
    return len(seen) >= decontamination.CONTAINMENT * whole or longest >= decontamination.RUN


def test_decontamination_by_brute_force():
    rng = random.Random(14)
    prose = lambda n: " ".join(rng.choice(WORDS) + (". " if rng.random() < 0.08 else "") for _ in range(n))
    items = [prose(rng.randrange(3, 14)) for _ in range(12)]
    docs = []
    for _ in range(400):
        own = [prose(rng.randrange(0, 8))]
        words = rng.choice(items).split(" ")
        if rng.random() < 0.5:
            words = [str(rng.randrange(3, 6)) if w.isdigit() and rng.random() < 0.7 else w for w in words]
        if rng.random() < 0.3 and words:
            words[rng.randrange(len(words))] = "xyz"
        docs.append(" ".join([*own, *words, prose(rng.randrange(0, 5))]))
    search = decontamination.Benchmark(list(range(len(items))), items)
    buf, at = kernels.texts(pa.array(docs))
    got = {(t, i) for t, i, *_ in search.search(buf, at)}
    want = {(t, i) for t, doc in enumerate(docs) for i, item in enumerate(items) if leaked(doc, item)}
    assert got == want and 100 < len(want) < 3000


def test_numbers_alone_cost_no_more_than_they_are(spark):
    items = spark.createDataFrame([(i, " ".join(str(k + i) for k in range(30))) for i in range(50)] + [(99, "add 3 4 5 6 7 8 9 and then stop")], "item_id long, text string")
    table = " ".join(map(str, range(100, 2100)))
    df = spark.createDataFrame([(0, table), (1, " ".join(str(k + 7) for k in range(30))), (2, "well: add 13 14 15 16 17 18 19 and then stop"), (3, "add 13 14 15")], "doc_id long, text string")
    got = decontamination.find_leaks(df, items).collect()
    assert {r.doc_id for r in got if r.item_id == 99} == {2} and {r.item_id for r in got if r.doc_id == 1} == set(range(50))


@pytest.mark.parametrize("block", [40, 8 << 20])
def test_rows_without_an_id_are_cleaned_too(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(None, ITEMS[0][1], "a"), (None, "a clean row", "b"), (1, ITEMS[1][1], "c"), (2, None, "d")]
    kept = decontamination.keep_clean(spark.createDataFrame(rows, "doc_id long, text string, _leak string"), items)
    assert kept.columns == ["doc_id", "text", "_leak"] and sorted(r._leak for r in kept.collect()) == ["b", "d"]


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame([(i, t) for i, t in ITEMS], "doc_id long, text string")
    whole = sorted(map(tuple, decontamination.find_leaks(df, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 40)
    assert sorted(map(tuple, decontamination.find_leaks(df, items).collect())) == whole and len(whole) == 2


# --- odd rows of every operator ---


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = [(1, "one two three four five six seven", "s"), (1, "one two three four five six seven", "s"), (None, "no id here at all, none", "s"), (None, None, None), (2, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(7, "one two three four five")], "item_id long, text string")
    ids = [1, 1, 2, None, None]

    def same(got):
        assert sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x)) == ids

    for got in (packing.pack(df), crf.score(df, crf.train(df, labels)), pii.find(df), quality_rules.apply_rules(df), near_dedup.link(df), token_count.count_tokens(df), sharding.shard(df), licenses.scan(df), suffix_dedup.remove(df)):
        same(got)
    assert sorted(r.doc_id for r in decontamination.find_leaks(df, items).collect()) == [1, 1]
    kept = near_dedup.keep_one(df).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 1, 1, 2]  # rows of one id stay together


def test_long_texts_in_parts(spark, monkeypatch):
    from claimweave.llm import suffix_runs

    monkeypatch.setattr(suffix_runs, "PART", 512)
    rng = random.Random(15)
    long = "".join(rng.choice("abcd ") for _ in range(3000))
    buf, at = kernels.texts(pa.array([long]))
    high, low, _, _, start, more = suffix_runs.runs(buf, at)
    covered = sorted(s + k for s, m in zip(start.tolist(), more.tolist(), strict=True) for k in range(m + 1))
    assert covered == list(range(len(long) - 49)) and len(high) == len(low)


# --- pipeline --------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs, texts, tmp_path, library):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
    last = now.select("doc_id").collect()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in last}
    # The stages by brute force, but for the classifier, whose marginals and features have tests of their own.
    model = crf.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    left = sorted(i for i, r in by_id(crf.score(docs, model)).items() if r.score >= 0.3)
    left = [left[k] for k, (_, c, _) in enumerate(components([texts[i] for i in left], 5)) if c == k]
    left = [i for i in left if not any(leaked(texts[i] or "", item or "") for _, item in ITEMS)]
    clean = {}
    for i in left:
        base = base_spans(texts[i] or "")
        clean[i] = pii.redact_text(texts[i] or "", base + pii.disguised(texts[i] or "", base))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert {r.doc_id: r.doc_tokens for r in out} == want
    total = Counter()
    for r in out:
        total[r.doc_id] += r.length
    assert dict(total) == want and 0 < len(want) < len(texts)
