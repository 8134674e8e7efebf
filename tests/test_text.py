"""Text functions against plain Python and literal cases."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimweave.functions import text as T
from claimweave.operators import backends, claims

ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "vs.", "etc.")


def split(text):
    """A direct simulation: (sentence, start byte, end byte)."""
    out, begin, i, n = [], 0, 0, len(text)
    size = lambda k: len(text[:k].encode())
    while i < n:
        c = text[i]
        ends = c in ".!?;"
        if c == ".":
            if text[: i + 1].endswith(ABBREVIATIONS):
                ends = False
            elif 0 < i < n - 1 and re.match("[0-9]", text[i - 1]) and re.match("[0-9]", text[i + 1]):
                ends = False
        if ends:
            piece = text[begin : i + 1]
            if piece.strip():
                out.append((piece.strip(), size(begin), size(i + 1)))
            i += 1
            while i < n and text[i].isspace():
                i += 1
            begin = i
            continue
        i += 1
    if text[begin:].strip():
        out.append((text[begin:].strip(), size(begin), size(n)))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def rows(spark, texts):
    found = claims.sentence_spans(frame(spark, texts), ["id"], "text").orderBy("id", "idx").collect()
    return [[(r.sentence, r.start, r.end) for r in found if r.id == i] for i in range(len(texts))]


CASES = [
    "First one. Second one.", "Dr. Smith came. He left.", "It is 3.14 percent. Revenue grew.", "Revenue grew 15%; costs declined 3%.", "no mark at the end", "", "The U.S. economy", "i.e. this",
    "Wait...", "ATMs. Foo.", "é. ü", "  lead. next", "a!? b", "x.　y.", "1.2.3 done. ok",
]


def test_splitter_cases(spark):
    got = rows(spark, CASES)
    assert [[s for s, _, _ in g] for g in got] == [[s for s, _, _ in split(t)] for t in CASES]
    assert got[6] == [("The U.", 0, 6), ("S.", 6, 8), ("economy", 9, 16)]
    assert got[8] == [("Wait.", 0, 5), (".", 5, 6), (".", 6, 7)]
    assert [(a, b) for _, a, b in got[10]] == [(0, 3), (4, 6)]
    assert got[11][0] == ("lead.", 0, 7)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1. !?;éDr\n", max_size=30), min_size=20, max_size=40))
def test_splitter_matches_simulation(spark, texts):
    assert [[s for s, _, _ in g] for g in rows(spark, texts)] == [[s for s, _, _ in split(t)] for t in texts]


def test_splitter_does_not_depend_on_partitions(spark):
    df = frame(spark, CASES * 5)
    first = None
    for n in (1, 4, 16):
        got = sorted(map(tuple, claims.sentence_spans(df.repartition(n), ["id"], "text").collect()))
        first = first or got
        assert got == first


@pytest.mark.parametrize(("text", "want"), [("Revenue Grew.", "revenue grew"), ('"Quoted claim."', "quoted claim"), ("a \t  b", "a b"), ("It cost $4.2 billion, he said!", "it cost $4.2 billion, he said"), ("  ", "")])
def test_normalized(spark, text, want):
    assert frame(spark, [text]).select(T.normalized(F.col("text"))).first()[0] == want


def test_compound_and_k(spark):
    texts = ["It rose, and it fell.", "It, which rose, fell.", "a; b", "a — b", "plain sentence.", "x" * 81, "x" * 1000]
    got = frame(spark, texts).select(T.is_compound(F.col("text")), T.adaptive_k(F.col("text"), 10), T.adaptive_k(F.col("text"), 10, False), T.adaptive_k(F.col("text"), 0)).collect()
    assert [r[0] for r in got] == [True, True, True, True, False, False, False]
    assert [r[1] for r in got] == [3, 3, 3, 3, 3, 3, 10]
    assert {(r[2], r[3]) for r in got} == {(10, 0)}


def test_json_depth_and_pointer(spark):
    cases = [("1", 0), ("[]", 1), ("{}", 1), ("[[1,2],[3,4]]", 2), ('{"a":{"b":{}}}', 3), ('[{"a":[{"b":1}]}]', 4), ('"{[("', 0), ('{"a\\"}{":1}', 1)]
    got = frame(spark, [c for c, _ in cases]).select(T.json_depth(F.col("text"))).collect()
    assert [r[0] for r in got] == [d for _, d in cases]
    one = frame(spark, ['{"a":{"b/c":[5,6]}}']).select(T.json_pointer(F.col("text"), "/a/b~1c/1"), T.json_pointer(F.col("text"), "/x")).first()
    assert tuple(one) == ("6", None)


def test_html_and_title(spark):
    html = '<style>p{}</style><p>One <b>two</b>\n\n three<script>var x="</p>";</script></p>'
    assert frame(spark, [html]).select(T.strip_html(F.col("text"))).first()[0] == "One two three"
    urls = ["https://en.example.org/wiki/Some_Title?x=1#y", "https://other.net/wiki/A", "https://en.example.org/w/A"]
    got = frame(spark, urls).select(T.article_title(F.col("text"), "example.org", "wiki")).collect()
    assert [r[0] for r in got] == ["Some_Title", None, None]


def test_token_chunks(spark):
    texts = ["", "x" * 10, "abcdefghijklmnopqrstuvwxyz"]
    got = claims.token_chunks(frame(spark, texts), ["id"], "text", 10, 3).orderBy("id", "chunk_idx").collect()
    assert [(r.id, r.char_offset, r.chunk) for r in got] == [(1, 0, "x" * 10), (2, 0, "abcdefghij"), (2, 7, "hijklmnopq"), (2, 14, "opqrstuvwx"), (2, 21, "vwxyz")]


def test_control_characters_stay(spark):
    assert rows(spark, ["a\x01b c. d"]) is not None
    got = spark.createDataFrame([("a\x01b c. Pay 3.5\x01 to Dr. No.",)], "text string").select(T.sentences(F.col("text")).alias("s")).first().s
    assert got == ["a\x01b c.", "Pay 3.5\x01 to Dr. No."]


def test_sql_names(spark):
    from claimweave.functions import sql

    assert "claims_of" in sql.register(spark)
    texts = ["Dr. No paid 3.5 dollars. Why?  Because; he can.", " A, and B, but not \u00a0 'C'!", "", "x" * 200]
    df = spark.createDataFrame([(i, t, [1.0, float(i)]) for i, t in enumerate(texts)], "id long, t string, v array<double>")
    df.createOrReplaceTempView("sql_texts")
    got = spark.sql("select id, claim_sentences(t) as s, claim_normalized(t) as n, claim_is_compound(t) as c, claim_adaptive_k(t, 10) as k, claim_input_hash(t, null, t) as h, vector_cosine(v, array(1D, 1D)) as x from sql_texts").orderBy("id").collect()
    t = F.col("t")
    want = df.select("id", T.sentences(t).alias("s"), T.normalized(t).alias("n"), T.is_compound(t).alias("c"), T.adaptive_k(t, 10).alias("k"), T.input_hash(t, F.lit(None).cast("string"), t).alias("h"), T.cosine(F.col("v"), F.array(F.lit(1.0), F.lit(1.0))).alias("x"))
    assert got == want.orderBy("id").collect()
    assert [r.sentence for r in spark.sql("select * from claims_of('One. Two.') order by idx").collect()] == ["One.", "Two."]


def test_budget_chunks(spark):
    assert claims.packed([], 5, 1) == []
    assert claims.packed([3, 3, 3], 6, 0) == [(0, 2), (1, 3)]  # the last sentence stays, whatever the overlap
    assert claims.packed([9, 1, 1], 5, 2) == [(0, 1), (0, 2), (0, 3)]  # so does a sentence that the overlap has to reach
    assert claims.packed([1, 1, 1], 2, 99) == [(0, 2), (0, 3)]  # an overlap beyond the budget keeps all

    def words():
        return lambda texts: [len(t.split()) for t in texts]

    texts = ["One two. Three four. Five six.", "", "  short one", None, "a b c d e f g"]
    got = sorted(map(tuple, claims.budget_chunks(frame(spark, texts), ["id"], "text", words, "test words", 4, 2).collect()))
    assert got == [(0, 0, "One two. Three four."), (0, 1, "Three four. Five six."), (1, 0, ""), (2, 0, "  short one"), (4, 0, "a b c d e f g")]
    assert [r.chunk for r in claims.budget_chunks(frame(spark, texts[:1]), ["id"], "text", words, "test words", 0, 2).collect()] == texts[:1]


def test_tokens(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    def make():
        t = Tokenizer(models.WordLevel({"[UNK]": 0, "red": 1, "fox": 2, "\u00e9": 3}, unk_token="[UNK]"))
        t.pre_tokenizer = pre_tokenizers.Whitespace()
        return t

    df = frame(spark, ["red \u00e9 fox cat", "", None, "fox"])
    told = backends.tokenize(df, ["id"], "text", make, "tiny", most=3)
    got = {r.id: (r.ids, r.starts, r.ends, r.n_tokens) for r in told.collect()}
    assert got == {0: ([1, 3, 2], [0, 4, 6], [3, 5, 9], 4), 1: ([], [], [], 0), 2: ([], [], [], 0), 3: ([2], [0], [3], 1)}
    assert {r.id: r.text for r in backends.decode(told, ["id"], "ids", make, "tiny").collect()} == {0: "red \u00e9 fox", 1: "", 2: "", 3: "fox"}
    assert backends.token_counter(make)()(["red fox", ""]) == [2, 0]
