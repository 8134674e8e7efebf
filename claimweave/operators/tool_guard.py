"""Tool-call policies over logs: denied and allowed tools, order of calls, parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


@dataclass(frozen=True)
class Ordering:
    """`dependent` needs an earlier call of `prerequisite`."""

    prerequisite: str
    dependent: str
    description: str = ""


@dataclass(frozen=True)
class Parameter:
    """A rule on what a JSON pointer names in a tool's arguments: range, not_contains, allowed or regex."""

    tool: str
    pointer: str
    kind: str
    low: float | None = None
    high: float | None = None
    text: str = ""
    values: tuple = ()


@dataclass(frozen=True)
class Policy:
    denied: tuple[str, ...] = ()
    allowed: tuple[str, ...] | None = None
    ordering: tuple[Ordering, ...] = ()
    parameters: tuple[Parameter, ...] = field(default_factory=tuple)


def policy_from_json(text: str) -> Policy:
    """A policy of its JSON form: denied, allowed, ordering and parameters, named as the classes' fields."""
    raw = json.loads(text)
    if odd := set(raw) - {"denied", "allowed", "ordering", "parameters"}:
        raise ValueError(f"unknown keys: {sorted(odd)}")
    parameters = tuple(Parameter(**{k: tuple(v) if k == "values" else v for k, v in p.items()}) for p in raw.get("parameters", []))
    allowed = raw.get("allowed")
    return Policy(tuple(raw.get("denied", [])), None if allowed is None else tuple(allowed), tuple(Ordering(**o) for o in raw.get("ordering", [])), parameters)


def _plain(number: Column) -> Column:
    """A number without a needless fraction."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.try_cast("long").cast("string")).otherwise(number.cast("string"))


def is_pattern(text: str) -> bool:
    """Whether the engine that will run the pattern takes it."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(text)
    except (Py4JError, IllegalArgumentException):  # what a syntax error of a pattern comes as
        return False
    return True


def parameter_reason(rule: Parameter, value: Column, tool: Column) -> Column:
    """Why the value (a variant) breaks the rule, or null; a missing value breaks none, JSON's null is a value.

    Ranges look at numbers only, allowed values compare types too, the other rules look at the JSON text, patterns at
    a string's own text.
    """
    where = F.concat(F.lit(f"Parameter '{rule.pointer}' in tool '"), tool, F.lit("'"))
    kind, shown = F.schema_of_variant(value), F.to_json(value)
    if rule.kind == "range":
        number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
        out = F.lit(None).cast("string")
        if rule.high is not None:
            out = F.when(number > rule.high, F.concat(where, F.lit(" is "), _plain(number), F.lit(f", which exceeds maximum {rule.high:g}"))).otherwise(out)
        if rule.low is not None:
            out = F.when(number < rule.low, F.concat(where, F.lit(" is "), _plain(number), F.lit(f", which is below minimum {rule.low:g}"))).otherwise(out)
        return out
    if rule.kind == "not_contains":
        return F.when(F.contains(shown, F.lit(rule.text)), F.concat(where, F.lit(f" contains forbidden value '{rule.text}'")))
    if rule.kind == "allowed":
        texts = [json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in rule.values]
        return F.when(value.isNotNull() & ~shown.isin(*texts), F.concat(where, F.lit(" has invalid value: "), shown))
    if rule.kind == "regex":
        if not is_pattern(rule.text):
            return F.when(value.isNotNull(), F.lit(f"Invalid regex pattern: {rule.text}"))
        text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(shown)
        return F.when(value.isNotNull() & ~text.rlike(rule.text), F.concat(where, F.lit(" does not match required pattern")))
    raise ValueError(rule.kind)


def stateless_reasons(policy: Policy, tool: Column, arguments: Column) -> tuple[list[Column], list[Column]]:
    """Reasons that need no history: those checked before the order of calls, and those after it."""
    before = []
    if policy.denied:
        before.append(F.when(tool.isin(*policy.denied), F.concat(F.lit("Tool '"), tool, F.lit("' is explicitly denied by policy"))))
    if policy.allowed is not None:
        before.append(F.when(~tool.isin(*policy.allowed), F.concat(F.lit("Tool '"), tool, F.lit("' is not in the allowed list"))))
    after = [F.when(tool == p.tool, parameter_reason(p, T.json_value(arguments, p.pointer), tool)) for p in policy.parameters]
    return before, after


def ordering_text(o: Ordering) -> str:
    return f"Tool '{o.dependent}' requires '{o.prerequisite}' to be called first: {o.description}"


def judge_log(calls: DataFrame, policy: Policy, session: str = "session_id", index: str = "call_index") -> DataFrame:
    """calls with reason (null if allowed) and allowed. Denied calls count as history, too."""
    tool, arguments = F.col("tool_name"), F.col("arguments")
    before, after = stateless_reasons(policy, tool, arguments)
    earlier = Window.partitionBy(session).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    order = [
        F.when((tool == o.dependent) & ~F.coalesce(F.max(tool == o.prerequisite).over(earlier), F.lit(False)), F.lit(ordering_text(o)))
        for o in policy.ordering
    ]
    reasons = [*before, *order, *after]
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    return calls.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def log_results(judged: DataFrame, session: str = "session_id") -> DataFrame:
    """A row for each session: calls, violations, first violation's index, compliant."""
    denied = ~F.col("allowed")
    return judged.groupBy(session).agg(
        F.count("*").alias("total_calls"), F.count(F.when(denied, 1)).alias("violations"),
        F.min(F.when(denied, F.col("call_index"))).alias("first_violation"), F.bool_and("allowed").alias("compliant"),
    )


def call_history(calls: DataFrame, session: str = "session_id", index: str = "call_index") -> DataFrame:
    """calls with history: the tools called before in the session, in order, denied calls among them."""
    earlier = Window.partitionBy(session).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("history", F.collect_list("tool_name").over(earlier))


def calls_from_json(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """session_id, call_index, tool_name, arguments of transcripts: a JSON text for each session, {"session_id", "calls": [{"tool", "arguments"}]}."""
    shape = "struct<session_id:string,calls:array<struct<tool:string,arguments:variant>>>"
    told = lines.select(F.from_json(text_col, shape).alias("_t")).where("_t.session_id is not null")
    rows = told.select(F.col("_t.session_id").alias("session_id"), F.posexplode("_t.calls").alias("_at", "_call"))
    return rows.select("session_id", F.col("_at").cast("long").alias("call_index"), F.col("_call.tool").alias("tool_name"), F.to_json("_call.arguments").alias("arguments"))
