"""Configuration, registry, command line, reports and model backends."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave import __main__ as cli
from claimweave import __version__, config, service
from claimweave.operators import backends, grounding, report
from claimweave.sources import evaluations


def test_config_round_trip(tmp_path):
    c = config.EngineConfig(models={"m": config.ModelConfig("hub/m", sha256="0" * 64)})
    c.save(tmp_path / "c.json")
    assert config.load(tmp_path / "c.json") == c
    for bad in ({"pass_threshold": 2}, {"max_memory_mb": 0}, {"odd": 1}, {"models": {"m": {"source": ""}}}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises((ValueError, TypeError)):
            config.load(tmp_path / "bad.json")


def test_registry(tmp_path):
    (tmp_path / "m").write_bytes(b"weights")
    right = config.file_sha256(tmp_path / "m")
    reg = config.ModelRegistry(config.EngineConfig(cache_dir=str(tmp_path), models={"m": config.ModelConfig("s", sha256=right), "n": config.ModelConfig("s")}))
    assert reg.names() == ["m", "n"] and reg.available("m") and not reg.available("n") and not reg.available("x")
    assert reg.verify("m") == right and reg.hashes == {"m": right}
    reg.models["m"].sha256 = "1" * 64
    with pytest.raises(ValueError, match="checksum"):
        reg.verify("m")


def test_command_line(tmp_path, capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == __version__
    (tmp_path / "c.json").write_text("{}")
    assert cli.main(["validate-config", str(tmp_path / "c.json")]) == 0
    assert cli.main(["validate-config", str(tmp_path / "none.json")]) == 1
    assert cli.main(["show-config"]) == 0


def test_command_line_with_spark(spark, capsys):
    assert cli.main(["validate-schema", '{"a":1}', '{"type":"object","required":["b"]}']) == 1
    assert json.loads(capsys.readouterr().out)["errors"] == [{"path": "/", "kind": "required"}]
    assert cli.main(["eval-hallucination", "the cat sat", "the dog sat"]) == 0
    assert json.loads(capsys.readouterr().out)["spans"] == [{"start": 4, "end": 7, "confidence": 0.9}]


def test_reports(spark):
    evals = spark.createDataFrame([(1, "c", "o"), (2, "c", "p")], "eval_id long, context string, output string")
    results = report.module_result(evals.where("eval_id = 1"), "b", F.lit(0.5), 0.7).unionByName(report.module_result(evals.where("eval_id = 1"), "a", F.lit(0.9), 0.7))
    made = report.reports(evals, results, "1", {"m": "x"}, "2024-01-01")
    got = {r.eval_id: r for r in made.collect()}
    assert [x.module for x in got[1].results] == ["a", "b"] and not got[1].all_passed and got[2].all_passed and got[2].results == []
    assert got[1].input_hash != got[2].input_hash
    back = {r.eval_id: r for r in report.from_json(report.to_json(made)).collect()}
    assert {i: r.asDict(True) for i, r in back.items()} == {i: r.asDict(True) for i, r in got.items()}


def test_model_backend(spark):
    def make():
        return lambda premises, hypotheses: np.array([[0.1, 0.2, 0.7] if "x" in p else [0.8, 0.1, 0.1] for p in premises])

    pairs = spark.createDataFrame([(1, "x y", "a"), (2, "z", "a"), (3, "z", "a")], "k long, ctx string, claim string")
    got = {r.k: (r.e, r.n, r.c) for r in backends.score_pairs(pairs, make, "test").collect()}
    assert got == {1: (0.1, 0.2, 0.7), 2: (0.8, 0.1, 0.1), 3: (0.8, 0.1, 0.1)}

    def token_model():
        return lambda texts: [[(0, 1, 0.9)] if t else [] for t in texts]

    rows = backends.classify_tokens(pairs, ["k"], "ctx", token_model, "tok").collect()
    assert sorted((r.k, r.tok_idx, r.cls) for r in rows) == [(1, 0, 1), (2, 0, 1), (3, 0, 1)]


def test_model_helpers():
    assert backends.label_order({"0": "CONTRADICTION", "1": "neutral", "2": "Entailment"}) == [2, 1, 0]
    assert backends.longest_input({"max_position_embeddings": 514, "model_type": "roberta"}) == 512
    assert backends.longest_input({"max_position_embeddings": 512, "model_type": "bert"}) == 512
    assert np.allclose(backends.softmax(np.array([[1000.0, 1000.0], [0.0, np.log(3)]])), [[0.5, 0.5], [0.25, 0.75]])
    v = backends.mean_pooled(np.array([[[3.0, 0], [0, 4.0], [9, 9]]]), np.array([[1, 1, 0]]))
    assert np.allclose(v, [[0.6, 0.8]])


def test_requests(spark):
    rows = [("c", "o", None, None), (" ", "o", None, "empty_context"), ("c", "", None, "empty_output"), ("c" * 500_001, "o", None, "context_too_large"), ("c", "o" * 50_001, None, "output_too_large"), ("c", "o", "token", "unsupported_granularity")]
    df = spark.createDataFrame(rows, "context string, output string, granularity string, want string")
    assert all(r[0] == r[1] for r in df.select(evaluations.request_error(granularity="granularity"), "want").collect())
    turns = spark.createDataFrame([(7, 0, "user", "Hello."), (7, 1, "assistant", None), (7, 2, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    got = {r.eval_id: r for r in evaluations.from_conversations(turns).collect()}
    assert got[7 * 2**31 + 1].output == "" and got[7 * 2**31 + 2].context == "Hello.\n\n" and grounding.Config().top_k == 5


def test_evaluations_of_long_conversations_keep_apart(spark):
    turns = spark.createDataFrame([(1, 1000, "assistant", "a."), (2, 0, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    assert len({r.eval_id for r in evaluations.from_conversations(turns).collect()}) == 2


def test_requests_from_json(spark):
    lines = ['{"context":[{"id":"a","text":"One."},{"text":"Two."}],"output":"One.","top_k":3}', '{"context":[],"output":"x"}', "not json", "[1]", '{"context":[{"text":"c"}],"output":"o","granularity":"token"}', None]
    good, bad = evaluations.from_requests(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = good.collect()
    assert len(r) == 1 and (r[0].context, r[0].output, r[0].top_k, r[0].chunks[0].id) == ("One.\n\nTwo.", "One.", 3, "a")
    assert sorted(x.error for x in bad.collect()) == ["empty_context", "malformed", "malformed", "malformed", "unsupported_granularity"]


def test_models_and_embeddings_plug_into_verdicts(spark):
    rows = [(1, "The cat sat on the mat. A dog ran far away.", "The dog ran quickly away. The cat never slept at all.")]
    evals = spark.createDataFrame(rows, "eval_id long, context string, output string")

    def nli():
        return lambda premises, hypotheses: np.array([[0.9, 0.05, 0.05] if "dog" in p and "dog" in h else [0.05, 0.05, 0.9] for p, h in zip(premises, hypotheses, strict=True)])

    def vectors():
        return lambda texts: np.array([[float("dog" in t), float("cat" in t)] for t in texts])

    def embed(df, column, name):
        return backends.embed_texts(df, column, name, vectors, "pets")

    got = {r.claim_idx: r for r in grounding.verdicts(evals, grounding.Config(), grounding.ModelBackend(nli, "nli"), embed).collect()}
    assert [(got[i].label, got[i].evaluated, got[i].ctx_idx) for i in (0, 1)] == [("entailment", 1, 1), ("contradiction", 1, 0)]


def test_service_settings(tmp_path):
    file = tmp_path / "service.toml"
    file.write_text('[server]\nport = 1\n[faithfulness]\ndefault_top_k = 3\nadaptive_top_k = false\npartial_threshold = 0.3\nmax_output_chars = 9\n[models]\nnli_model_path = "m"\n[workers]\nqueue_depth = 1\nbatch_size = 4\n')
    got = service.load(file, {})
    assert (got.check.top_k, got.check.adaptive, got.check.partial, got.limits, got.nli_model, got.batch_size) == (3, False, (0.3, 0.65, 0.7), (500_000, 9), "m", 4)
    env = {"CLAIMWEAVE_FAITHFULNESS__DEFAULT_TOP_K": "7", "CLAIMWEAVE_FAITHFULNESS__ADAPTIVE_TOP_K": "TRUE", "CLAIMWEAVE_SERVER__PORT": "x", "OTHER": "1"}
    assert (service.load(file, env).check.top_k, service.load(file, env).check.adaptive) == (7, True)
    assert service.load(None, {}).check == grounding.SERVICE
    for bad in ("[odd]\n", "[faithfulness]\nodd = 1\n", "[faithfulness]\ndefault_top_k = 1.5\n", "[faithfulness]\ndefault_threshold = 2\n", "[faithfulness]\nadaptive_top_k = 1\n"):
        file.write_text(bad)
        with pytest.raises(ValueError):
            service.load(file, {})
    for name, value in (("CLAIMWEAVE_FAITHFULNESS__ODD", "1"), ("CLAIMWEAVE_FAITHFULNESS__ADAPTIVE_TOP_K", "1"), ("CLAIMWEAVE_FAITHFULNESS__DEFAULT_TOP_K", "x")):
        with pytest.raises(ValueError):
            service.load(None, {name: value})


def test_request_limits(spark):
    rows = spark.createDataFrame([("ccc", "o"), ("c", "ooo"), ("c", "o")], "context string, output string")
    assert [r[0] for r in rows.select(evaluations.request_error(most=(2, 2))).collect()] == ["context_too_large", "output_too_large", None]
