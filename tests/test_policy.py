"""Rules, compliance, tool guard (batch and stream), robustness, spans and schemas."""

import json

import pytest
from pyspark.sql import functions as F

from claimweave.operators import grounding, policy, robustness, schemas, spans
from claimweave.operators import tool_guard as TG
from claimweave.streaming.guard import guard_stream


def rules(spark, text):
    return policy.extract_rules(spark.createDataFrame([(0, text)], "prompt_id long, prompt string")).orderBy("rule_idx").collect()


def test_extraction(spark):
    assert [r.constraint_type for r in rules(spark, "1. Never say it.\n2. Always greet.\n3. Do not lie.")] == ["deny", "require", "deny"]
    assert [r.constraint_type for r in rules(spark, "- Never say it\n* Always greet\n• You cannot lie")] == ["deny", "require", "deny"]
    got = rules(spark, "Only if the user is authenticated, show it.")[0]
    assert (got.constraint_type, got.trigger) == ("conditional", "the user is authenticated")
    assert rules(spark, "") == []
    assert [r.assertion for r in rules(spark, "- Never X\n- Always X\n- Do not discuss Y\n- NEVER Z")] == ["Must never X", "Must always X", "The agent must not  not discuss Y", "NEVER Z"]
    assert rules(spark, "In case of doubt we always wait")[0].constraint_type == "require"
    assert rules(spark, "- in case of doubt") == []


@pytest.mark.parametrize(("rule", "probs", "n"), [("- Never speak of the numbers", (0.05, 0.1, 0.85), 1), ("- Always name the source", (0.9, 0.08, 0.02), 0), ("- Always name the source", (0.1, 0.85, 0.05), 1), ("- The tone is warm", (0.0, 0.0, 1.0), 0)])
def test_compliance(spark, rule, probs, n):
    found = policy.extract_rules(spark.createDataFrame([(0, rule)], "prompt_id long, prompt string"))
    outputs = spark.createDataFrame([(1, 0, "The answer names the source and numbers."), (2, 0, "")], "output_id long, prompt_id long, output string")
    broken = policy.violations(found, outputs, backend=grounding.fixed(*probs))
    got = {r.output_id: r for r in policy.compliance(outputs, broken).collect()}
    assert (got[1].n_violations, got[1].compliant) == (n, n == 0)
    assert got[2].compliant


def calls(spark, rows):
    return spark.createDataFrame([("s", i, t, json.dumps(a)) for i, (t, a) in enumerate(rows)], "session_id string, call_index long, tool_name string, arguments string")


def allowed(spark, rows, p):
    return [r.allowed for r in TG.judge_log(calls(spark, rows), p).orderBy("call_index").collect()]


def test_guard(spark):
    assert allowed(spark, [("delete_database", {})], TG.Policy(denied=("delete_database",))) == [False]
    assert allowed(spark, [("safe", {}), ("unsafe", {})], TG.Policy(allowed=("safe",))) == [True, False]
    order = TG.Policy(ordering=(TG.Ordering("verify", "transfer"),))
    assert allowed(spark, [("transfer", {}), ("verify", {}), ("transfer", {})], order) == [False, True, True]
    assert allowed(spark, [("t", {"y": 20}), ("t", {"y": 42})], TG.Policy(parameters=(TG.Parameter("t", "/y", "not_contains", text="42"),))) == [True, False]
    amount = TG.Policy(parameters=(TG.Parameter("t", "/amount", "range", 0, 10000),))
    assert allowed(spark, [("t", {"amount": x}) for x in (500, 15000, -100, "text")] + [("t", {})], amount) == [True, False, False, True, True]
    kinds = TG.Policy(parameters=(TG.Parameter("t", "/type", "allowed", values=("transfer", "payment")),))
    assert allowed(spark, [("t", {"type": "withdrawal"}), ("t", {"type": "payment"})], kinds) == [False, True]
    assert allowed(spark, [("t", {"a": "x"})], TG.Policy(parameters=(TG.Parameter("t", "/a", "regex", text="("),))) == [False]
    denied_first = TG.Policy(denied=("verify",), ordering=(TG.Ordering("verify", "transfer"),))
    assert allowed(spark, [("verify", {}), ("transfer", {})], denied_first) == [False, True]
    log = TG.log_results(TG.judge_log(calls(spark, [("transfer", {}), ("verify", {})]), order)).first()
    assert (log.total_calls, log.violations, log.first_violation, log.compliant) == (2, 1, 0, False)


def test_parameters_have_types(spark):
    own = lambda kind, **rule: TG.Policy(parameters=(TG.Parameter("t", "/k", kind, **rule),))
    values = [95, "95", 9.5, None, True, [1], {"a": 1}, "x1"]
    rows = [("t", {"k": v}) for v in values]
    assert allowed(spark, rows, own("range", low=10, high=90)) == [False, True, False, True, True, True, True, True]
    assert allowed(spark, rows, own("allowed", values=(95, None, [1]))) == [True, False, False, True, False, True, False, False]
    assert allowed(spark, rows, own("not_contains", text='"')) == [True, False, True, True, True, True, False, False]
    assert allowed(spark, rows, own("regex", text="^[0-9x]")) == [True, True, True, False, False, False, False, True]
    assert allowed(spark, rows, own("regex", text="(?P<x>9)")) == [False] * 8  # the engine refuses it
    assert allowed(spark, [("t", {"j": 1})], own("allowed", values=(2,))) == [True]
    nested = TG.Policy(parameters=(TG.Parameter("t", "/k/0", "range", high=5),))
    assert allowed(spark, [("t", {"k": [9]}), ("t", {"k": {"0": 9}}), ("t", {"k": [1]})], nested) == [False, False, True]
    reason = TG.judge_log(calls(spark, [("t", {"k": 95})]), own("range", low=10, high=90)).first().reason
    assert reason == "Parameter '/k' in tool 't' is 95, which exceeds maximum 90"


def test_history_and_transcripts(spark):
    made = TG.calls_from_json(spark.createDataFrame([('{"session_id":"s","calls":[{"tool":"a","arguments":{"x":[1,"y"]}},{"tool":"b"}]}',), ("no",)], "value string"))
    got = TG.call_history(made).orderBy("call_index").collect()
    assert [(r.session_id, r.tool_name, r.arguments, r.history) for r in got] == [("s", "a", '{"x":[1,"y"]}', []), ("s", "b", None, ["a"])]


def test_stream_forgets_on_reset(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from claimweave.streaming.guard import RESET

    p = TG.Policy(ordering=(TG.Ordering("verify", "transfer", "first"),))
    rows = calls(spark, [("verify", {}), ("transfer", {}), (RESET, {}), ("transfer", {})])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = guard_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), p, keep_ms=3_600_000)
    q = stream.writeStream.format("memory").queryName("after_reset").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.call_index, r.allowed) for r in spark.table("after_reset").orderBy("call_index").collect()] == [(0, True), (1, True), (3, False)]


def test_stream_agrees_with_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    p = TG.Policy(denied=("bad",), ordering=(TG.Ordering("verify", "transfer", "first"),), parameters=(TG.Parameter("pay", "/n", "range", 1, 9),))
    rows = calls(spark, [("transfer", {}), ("bad", {}), ("verify", {}), ("pay", {"n": 10}), ("transfer", {}), ("pay", {"n": 5})])
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = guard_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), p)
    q = stream.writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("verdicts").orderBy("call_index").collect()
    want = TG.judge_log(rows, p).orderBy("call_index").collect()
    assert [(r.call_index, r.reason, r.allowed) for r in got] == [(r.call_index, r.reason, r.allowed) for r in want]


def test_robustness(spark):
    low, high = robustness.wilson(F.col("s"), F.col("n"))
    got = spark.createDataFrame([(90, 100), (0, 100), (0, 0)], "s long, n long").select(low, high).collect()
    assert got[0][0] > 0.8 and got[0][1] <= 1 and got[1][0] == 0 and tuple(got[2]) == (0.0, 1.0)
    rates = spark.createDataFrame([(x,) for x in (0.02, 0.25, 0.75, 0.95, 0.05, 0.5, 0.9)], "r double")
    assert [r[0] for r in rates.select(robustness.classify(F.col("r"))).collect()] == ["robust", "fragile", "weak", "broken", "robust", "fragile", "weak"]
    made = robustness.variants(spark.createDataFrame([("tell me",)], "prompt string"), 3).collect()
    assert len(made) == 3 and all("tell me" in r.variant for r in made)
    samples = spark.createDataFrame([(0, False, ["a"], "x"), (1, True, ["a", "b"], "y"), (2, True, [], "z")], "ord long, adversarial boolean, violated array<string>, response string")
    got = {r.rule_id: r for r in robustness.rule_scores(spark.createDataFrame([("a",), ("b",), ("c",)], "rule_id string"), samples).collect()}
    assert (got["a"].base_rate, got["a"].adversarial_rate, got["a"].bypasses) == (1.0, 0.5, ["x", "y"])
    assert (got["b"].violations, got["c"].violation_rate) == (1, 0.0)


def test_long_texts_are_detected_in_chunks(spark):
    def predict(chunks):  # each digit is a token; those above 4 are unsupported
        return chunks.select("id", "chunk_idx", F.posexplode(F.split("chunk", "")).alias("tok_idx", "_c")).where("_c rlike '[0-9]'").select(
            "id", "chunk_idx", "tok_idx", F.col("tok_idx").alias("start"), (F.col("tok_idx") + 1).alias("end"), (F.col("_c") > "4").cast("int").alias("cls"), (F.col("_c").cast("double") / 10).alias("p1")
        )

    df = spark.createDataFrame([(0, "a5679b"), (1, "a1b56789c777d")], "id long, text string")
    found, share = spans.detect(df, ["id"], "text", predict, length=6, overlap=2)
    assert sorted((r.id, r.start, r.end, round(r.p, 6)) for r in found.collect()) == [(0, 1, 5, 0.675), (1, 3, 8, 0.9), (1, 9, 12, 0.7)]
    got = {r.id: (r.total_tokens, r.hallucinated_tokens) for r in share.collect()}
    assert got[0] == (4, 4) and got[1][0] > 9  # overlaps count twice


def test_spans(spark):
    def merged(rows):
        df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "id long, tok_idx long, start long, end long, cls int, p1 double")
        return sorted((r.start, r.end, round(r.p, 6)) for r in spans.merge_tokens(df, ["id"]).collect())

    assert merged([(0, 4, 1, 0.8)]) == [(0, 4, 0.8)]
    assert merged([(0, 3, 1, 0.8), (4, 11, 1, 0.7)]) == [(0, 11, 0.75)]
    assert merged([(0, 3, 1, 0.8), (4, 6, 0, 0.1), (7, 12, 1, 0.9)]) == [(0, 3, 0.8), (7, 12, 0.9)]
    assert merged([(0, 3, 1, 0.8), (3, 3, 0, 0.1), (4, 6, 1, 0.6)]) == [(0, 6, 0.7)]
    assert merged([(0, 3, 0, 0.2)]) == []
    df = spark.createDataFrame([(0, 0, 5, 0.6), (0, 5, 9, 0.9), (0, 12, 15, 0.7), (1, 0, 3, 0.1), (1, 4, 11, 0.2)], "id long, start long, end long, p double")
    assert sorted(map(tuple, spans.merge_intervals(df, ["id"]).collect())) == [(0, 0, 9, 0.9), (0, 12, 15, 0.7), (1, 0, 3, 0.1), (1, 4, 11, 0.2)]
    clipped = spans.clip(df.where("id = 0").withColumn("at", F.lit(7)), "at").orderBy("start").collect()
    assert [(r.start, r.end) for r in clipped] == [(0, 2), (5, 8)]


def test_intervals_without_a_place_come_last(spark):
    rows = [(0, 5, None, 0.2), (0, 5, 6, 0.3), (0, 1, 2, 0.4), (0, None, None, 0.9), (1, None, None, 0.1), (1, None, None, 0.2)]
    df = spark.createDataFrame(rows, "id long, start long, end long, p double")
    got = sorted(map(tuple, spans.merge_intervals(df, ["id"]).collect()), key=str)
    assert got == [(0, 1, 2, 0.4), (0, 5, 6, 0.9), (1, None, None, 0.1), (1, None, None, 0.2)]


def test_equal_intervals_merge_whatever_their_order(spark):
    rows = [(k % 3, 4 * (k * 7 % 50), 4 * (k * 7 % 50) + 1 + k % 6, (k % 10) / 10) for k in range(6000)]
    want = []
    for key, start, end, p in sorted(rows):
        if want and want[-1][0] == key and start <= want[-1][2]:
            want[-1][2:] = [max(want[-1][2], end), max(want[-1][3], p)]
        else:
            want.append([key, start, end, p])
    made = spans.merge_intervals(spark.createDataFrame(rows, "id long, start long, end long, p double").repartition(13), ["id"])
    assert made._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1  # both windows read one order
    assert sorted(map(list, made.collect())) == want and len(want) > 3


USER = {"type": "object", "required": ["name", "age"], "properties": {"name": {"type": "string", "minLength": 1, "pattern": "^[A-Z]"}, "age": {"type": "integer", "minimum": 0, "maximum": 150}, "role": {"enum": ["a", "b"]}, "tags": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 2, "uniqueItems": True}}, "additionalProperties": False}


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ('{"name":"Al","age":3}', []), ('{"name":"Al"}', ["required"]), ('{"name":"al","age":3}', ["pattern"]), ('{"name":"Al","age":"x"}', ["type"]), ('{"name":"Al","age":200}', ["maximum"]),
        ('{"name":"Al","age":3,"role":"c"}', ["enum"]), ('{"name":"Al","age":3,"tags":[]}', ["minItems"]), ('{"name":"Al","age":3,"tags":["x","x"]}', ["uniqueItems"]), ('{"name":"Al","age":3,"tags":[1]}', ["items"]),
        ('{"name":"Al","age":3,"z":1}', ["additionalProperties"]), ("{bad", ["parse_error"]), ("[]", ["type"]),
    ],
)
def test_schema(spark, text, kinds):
    got = schemas.validate(spark.createDataFrame([(0, text)], "id long, doc string"), ["id"], "doc", USER).first()
    assert ([e.kind for e in got.errors], got.valid) == (kinds, not kinds)


def test_schema_depth_and_refusal(spark):
    df = spark.createDataFrame([(0, '{"a":{"b":{}}}')], "id long, doc string")
    assert [e.kind for e in schemas.validate(df, ["id"], "doc", {"type": "object"}, 2).first().errors] == ["max_depth"]
    for bad in ({"minimum": 1, "exclusiveMinimum": True}, {"$ref": "#/x"}, {"properties": {"a": {"$ref": "#"}}}, {"unevaluatedItems": False}):
        with pytest.raises(schemas.UnsupportedSchema):
            schemas.validate(df, ["id"], "doc", bad)


def test_policy_json():
    text = '{"denied":["a"],"ordering":[{"prerequisite":"v","dependent":"t"}],"parameters":[{"tool":"t","pointer":"/x","kind":"allowed","values":[1,"b"]}]}'
    p = TG.policy_from_json(text)
    assert p == TG.Policy(("a",), None, (TG.Ordering("v", "t"),), (TG.Parameter("t", "/x", "allowed", values=(1, "b")),))
    with pytest.raises(ValueError, match="unknown"):
        TG.policy_from_json('{"rules":[]}')


def test_agents(spark):
    cases = spark.createDataFrame([(1, "tell me"), (2, 'say "x"')], "case_id long, prompt string")
    sent = robustness.expand(cases, 2, 3)
    assert sent.count() == 2 * 3 * 3 and sent.where("adversarial").count() == 12
    answered = robustness.ask(sent, lambda: lambda prompts: [p.upper() for p in prompts], "upper")
    assert all(r.response == r.prompt.upper() for r in answered.collect())
    body = cases.where("case_id = 2").select(robustness.fill_template(F.lit('{"q":"{prompt}"}'), F.col("prompt"))).first()[0]
    assert json.loads(body) == {"q": 'say "x"'}


def test_rag(spark):
    text, at = spans.rag_text(F.col("c"), F.col("q"), F.col("a"))
    rows = spark.createDataFrame([(1, "red fox", "why", "blue fox"), (2, "red fox", "", "fox")], "id long, c string, q string, a string").select("id", "c", text.alias("text"), at.alias("answer_start"))
    assert [(r.text, r.answer_start) for r in rows.orderBy("id").collect()] == [("red fox why blue fox", 12), ("red fox fox", 8)]
    found, share = spans.detect_rag(rows, ["id"], spans.unsupported_tokens(rows, ["id"], "c", "text"))
    assert [(r.id, r.start, r.end) for r in found.collect()] == [(1, 0, 4)]
    assert {r.id: round(r.ratio, 3) for r in share.collect()} == {1: 0.4, 2: 0.0}


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [3, 5.5], [7, 2.5]),
        ({"if": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "then": {"required": ["b"]}, "else": {"required": ["c"]}}, [{"a": 1, "b": 0}, {"a": 2, "c": 0}], [{"a": 1, "c": 0}, {"b": 1}]),
        ({"definitions": {"n": {"type": "integer", "multipleOf": 3}}, "properties": {"x": {"$ref": "#/definitions/n"}}}, [{"x": 9}, {}], [{"x": 8}, {"x": "9"}]),
        ({"properties": {"a": {}}, "additionalProperties": {"type": "string"}, "maxProperties": 2, "minProperties": 1}, [{"a": 1}, {"a": 1, "b": "x"}], [{"b": 1}, {}, {"a": 1, "b": "x", "c": "y"}]),
        ({"contains": {"type": "string"}}, [["a", 1], "x"], [[1], []]),
        ({"patternProperties": {"^n_": {"type": "integer"}, "_s$": {"minLength": 2}}, "properties": {"a": {}}, "additionalProperties": False}, [{"n_a": 1, "a": "x"}, {"b_s": "xy"}, {}, [1]], [{"n_a": "1"}, {"b_s": "x"}, {"b": 1}]),
        ({"propertyNames": {"pattern": "^[a-z]+$", "maxLength": 3}}, [{"ab": 1}, {}, "AB"], [{"A": 1}, {"abcd": 1}]),
        ({"dependencies": {"a": ["b"], "c": {"required": ["d"], "minProperties": 3}}}, [{"b": 1}, {"a": 1, "b": None}, {"c": 1, "d": 1, "e": 1}, [], "a"], [{"a": 1}, {"c": 1, "d": 1}]),
        ({"items": [{"type": "integer"}, {"type": "string"}], "additionalItems": {"type": "null"}}, [[1, "a", None], [1], [], "x"], [["a"], [1, 2], [1, "a", 0]]),
        ({"items": [{"type": "integer"}], "additionalItems": False}, [[1], []], [[1, 2]]),
    ],
)
def test_more_keywords(spark, schema, good, bad):
    rows = [(i, json.dumps(v)) for i, v in enumerate([*good, *bad])]
    got = {r.id: r.valid for r in schemas.validate(spark.createDataFrame(rows, "id long, doc string"), ["id"], "doc", schema).collect()}
    assert [got[i] for i in range(len(rows))] == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [
        ("date", ["2024-02-29", 5], ["2023-02-29", "2024-2-01", "2024-02-01\n", ""]),
        ("date-time", ["2024-02-29T12:00:00Z", "2024-01-01t23:59:60.5+02:00"], ["2024-02-29 12:00:00Z", "2024-13-01T00:00:00Z", "2024-01-01T24:00:00Z", "2024-01-01T00:00:00"]),
        ("time", ["00:00:00Z"], ["00:00Z", "25:00:00Z"]),
        ("email", ["a.b+c@d-e.org"], ["a..b@c.d", ".a@b", "a@", "a@-b", "a b@c"]),
        ("hostname", ["a.b-c.d", "x" * 63], ["a..b", "-a", "x" * 64, "a_b", ""]),
        ("ipv4", ["0.0.0.0", "255.10.1.99"], ["256.0.0.1", "1.2.3", "01.2.3.4", "1.2.3.4.5"]),
        ("ipv6", ["::", "::1", "1:2:3:4:5:6:7:8", "1::8", "fe80::1:2", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:1.2.3.4"], [":", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "1:2:3:4::5:6:7:8", ":::", "1.2.3.4"]),
        ("uri", ["http://a.b/c?d#e", "urn:x:y%20z"], ["/a", "http://a b", "1x:y", "a:%2"]),
        ("json-pointer", ["", "/a~0/b~1"], ["a", "/~2"]),
        ("color", ["anything"], []),
    ],
)
def test_formats(spark, name, good, bad):
    rows = [(i, json.dumps(v)) for i, v in enumerate([*good, *bad])]
    got = {r.id: r.valid for r in schemas.validate(spark.createDataFrame(rows, "id long, doc string"), ["id"], "doc", {"format": name}).collect()}
    assert [got[i] for i in range(len(rows))] == [True] * len(good) + [False] * len(bad)


def test_agent_behind_http(spark):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    class Echo(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["q"]
            out = {"choices": [{"text": prompt[::-1]}]} if prompt != "odd" else {"choices": [{"text": 5}]}
            self.send_response(500 if prompt == "fail" else 200)
            self.end_headers()
            self.wfile.write(b"no json" if prompt == "broken" else json.dumps(out).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Echo)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/"
        rows = spark.createDataFrame([(x,) for x in ('say "\u00e9"\n', "odd", "fail", "broken", None)], "prompt string")
        got = {r.prompt: r.response for r in robustness.ask(rows, robustness.http_agent(url, '{"q":"{prompt}"}', "/choices/0/text"), "echo").collect()}
        assert got == {'say "\u00e9"\n': '\n"\u00e9" yas', "odd": None, "fail": None, "broken": None, None: None}
    finally:
        server.shutdown()
    assert robustness.http_agent(url, "{prompt}", "", timeout=1)()(["x"]) == [None]
    assert [robustness.pointed({"a/b": [{"~": 1}]}, p) for p in ("/a~1b/0/~0", "/a~1b/1", "/x", "")] == [1, None, None, {"a/b": [{"~": 1}]}]
