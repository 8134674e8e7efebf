"""Verdicts and scores on literal evaluations."""

import dataclasses

from pyspark.sql import functions as F

from claimweave.operators import grounding as G


def evals(spark, *rows):
    return spark.createDataFrame([(i, c, o) for i, (c, o) in enumerate(rows)], "eval_id long, context string, output string")


def judged(spark, rows, config=G.Config(), backend=G.lexical):
    found = G.verdicts(evals(spark, *rows), config, backend).orderBy("eval_id", "claim_idx").collect()
    return [r.asDict() for r in found]


PLAIN = ("The tall cat sat on the mat near a door. Dogs run fast in the park.", "A cat with a hat sat down there.")


def test_fixed_backends(spark):
    assert [(r["label"], r["supported"]) for r in judged(spark, [PLAIN], backend=G.fixed(0.9, 0.05, 0.05))] == [("entailment", True)]
    assert [(r["label"], r["supported"]) for r in judged(spark, [PLAIN], backend=G.fixed(0.05, 0.1, 0.85))] == [("contradiction", False)]
    assert [(r["label"], r["supported"]) for r in judged(spark, [PLAIN], backend=G.fixed(0.1, 0.8, 0.1))] == [("neutral", True)]
    strict = G.Config(neutral_unsupported=True)
    assert [(r["label"], r["supported"]) for r in judged(spark, [PLAIN], strict, G.fixed(0.1, 0.8, 0.1))] == [("neutral", False)]


def test_ties(spark):
    assert judged(spark, [PLAIN], G.Config(contradiction=0.3), G.fixed(0.4, 0.2, 0.4))[0]["label"] == "contradiction"
    assert judged(spark, [PLAIN], G.Config(contradiction=0.7), G.fixed(0.4, 0.2, 0.4))[0]["label"] == "entailment"
    row = spark.range(1).select(G.argmax_label(F.lit(0.4), F.lit(0.2), F.lit(0.4)), G.argmax_label(F.lit(0.4), F.lit(0.4), F.lit(0.2))).first()
    assert tuple(row) == ("contradiction", "neutral")


def test_verbatim_claims_skip_the_backend(spark):
    rows = [("Revenue grew in the year. Costs fell too.", "revenue grew in the year! The moon is made of cheese.")]
    got = judged(spark, rows, backend=G.fixed(0.0, 0.0, 1.0))
    assert [(r["label"], r["e"], r["verbatim"]) for r in got] == [("entailment", 1.0, True), ("contradiction", 0.0, False)]
    counters = G.call_counters(evals(spark, *rows)).first()
    assert (counters.calls, counters.saved, counters.skipped) == (2, 0, 1)


def test_short_claims_do_not_match_verbatim(spark):
    assert not judged(spark, [("The cat sat. The cat is here.", "The cat is.")])[0]["verbatim"]


def test_no_candidate_is_entailed_unless_told_otherwise(spark):
    rows = [("zzzz zzzz zzzz.", "abc abc abc abc abc.")]
    got = judged(spark, rows)[0]
    assert (got["label"], got["e"], got["evaluated"], got["supported"]) == ("entailment", 0.0, 0, True)
    assert judged(spark, rows, G.Config(no_evidence_label="neutral"))[0]["label"] == "neutral"


def test_partial(spark):
    compound = ("One fact is here now. Another fact is there now.", "One fact is green, and another fact is blue.")
    plain = (compound[0], "One fact is green for the other fact.")
    single = ("One fact is here now.", compound[1])
    every = G.Config(top_k=0)
    score = G.fixed(0.45, 0.5, 0.05)
    got = judged(spark, [compound, plain, single], every, score)
    assert [(r["label"], r["supporting"]) for r in got] == [("partial", 2), ("neutral", 0), ("neutral", 0)]
    assert got[0]["e"] == 0.45
    assert judged(spark, [compound], dataclasses.replace(every, contradiction=0.5), G.fixed(0.4, 0.0, 0.6))[0]["label"] == "contradiction"


def test_partial_rows(spark):
    rows = [(0.6, 0.3, 0.1, 0.8), (0.27, 0.6, 0.13, 0.75), (0.2, 0.7, 0.1, 0.8), (0.25, 0.45, 0.3, 0.8), (0.25, 0.7, 0.05, 0.8), (0.5, 0.4, 0.1, 0.4), (0.5, 0.4, 0.1, None), (0.05, 0.5, 0.04, 0.9)]
    df = spark.createDataFrame(rows, "e double, n double, c double, sim double")
    assert [r[0] for r in df.select(G.is_partial()).collect()] == [True, True, False, False, False, False, True, False]


def test_candidates_and_counters(spark):
    context = "Ab cd one x. Ab cd two y. Ab cd three z. Ab cd four w. Ab cd five v."
    rows = [(context, "Ab cd something else.")]
    for k, calls, saved in ((2, 2, 3), (0, 5, 0)):
        c = G.call_counters(evals(spark, *rows), G.Config(top_k=k)).first()
        assert (c.calls, c.saved) == (calls, saved)


def test_empty_output_and_context(spark):
    df = evals(spark, ("Something is here.", ""), ("", "A claim of some length. Another claim of length."))
    got = {r.eval_id: r for r in G.scores(df, G.verdicts(df)).collect()}
    assert (got[0].total, got[0].score) == (0, 1.0)
    assert (got[1].total, got[1].neutral, got[1].score) == (2, 2, 1.0)


def test_softmax(spark):
    row = spark.range(1).select(*G.softmax([F.lit(1000.0), F.lit(1000.0), F.lit(-1000.0)])).first()
    assert tuple(row) == (0.5, 0.5, 0.0)


def test_issues_and_chunks(spark):
    got = G.issues(G.verdicts(evals(spark, PLAIN), G.Config(), G.fixed(0.05, 0.1, 0.85))).first()
    assert (got.issue_type, got.severity, got.confidence) == ("contradiction", "high", 0.85)
    chunks = F.array(F.struct(F.lit("a").alias("id"), F.lit("x y").alias("text")), F.struct(F.lit("b").alias("id"), F.lit("y z").alias("text")))
    row = spark.range(1).select(G.chunk_id(chunks, F.lit("y")), G.chunk_id(chunks, F.lit("z")), G.chunk_id(chunks, F.lit("q"))).first()
    assert tuple(row) == ("a", "b", None)
