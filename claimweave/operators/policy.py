"""Policy rules: extraction from system prompts, assertions, and compliance of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import claims, grounding

# The words that make a line a rule, and that tell its kind.
RULE_LINE = r"(?i)\b(never|always|must|should|do not|cannot|require|deny|refuse|only if|when)\b"
DENY = r"(?i)\b(never|do not|don't|cannot|can't|must not|shouldn't|should not|deny|refuse|reject|prohibit|forbid)\b"
REQUIRE = r"(?i)\b(always|must|should|need to|required|ensure|include)\b"
CONDITIONAL = r"(?i)\b(only if|when|if|only when|in case)\b"
TRIGGER = r"(?i)(?:only if|when|if)\s+([^,]+)"
NUMBERED, BULLET = r"^([0-9]+)\.\s+(.+)$", r"^[-*•]\s+(.+)$"
CONFIDENCE = 0.85


def constraint_type(text: Column) -> Column:
    """deny, require, conditional or inform; the first that fits."""
    return F.when(text.rlike(DENY), "deny").when(text.rlike(REQUIRE), "require").when(text.rlike(CONDITIONAL), "conditional").otherwise("inform")


def trigger(text: Column) -> Column:
    """What follows only if, when or if, up to a comma; null if nothing does."""
    found = F.trim(F.regexp_extract(text, TRIGGER, 1))
    return F.when(found != "", found)


def _first(text: Column, old: str, new: str) -> Column:
    """The text with the first place of a word replaced."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))).otherwise(text)


def assertion(text: Column, kind: Column, when: Column) -> Column:
    """A rule as a statement that an output can be held against."""
    low = F.lower(text)
    rest = F.substring(text, F.greatest(F.instr(text, " "), F.lit(1)), F.length(text))
    deny = (
        F.when(F.contains(low, F.lit("must not")) | F.contains(low, F.lit("cannot")), text)
        .when(low.startswith("never"), _first(_first(text, "never", "must never"), "Never", "Must never"))
        .when(low.startswith("do not") | low.startswith("don't"), F.concat(F.lit("The agent must not "), rest))
        .otherwise(F.concat(F.lit("The agent must not: "), text))
    )
    require = (
        F.when(F.contains(low, F.lit("must")), text)
        .when(low.startswith("always"), _first(_first(text, "always", "must always"), "Always", "Must always"))
        .when(low.startswith("should"), _first(_first(text, "should", "must"), "Should", "Must"))
        .otherwise(F.concat(F.lit("The agent must: "), text))
    )
    conditional = F.concat(F.lit("When "), when, F.lit(", the agent must: "), text)
    return F.when(kind == "deny", deny).when(kind == "require", require).when(kind == "conditional", conditional).otherwise(text)


def extract_rules(prompts: DataFrame, key: str = "prompt_id", text_col: str = "prompt") -> DataFrame:
    """key, rule_idx, rule_text, constraint_type, trigger, assertion of every rule, in the order of its lines."""
    lines = prompts.select(key, F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("_line", "_raw"))
    line = T.trimmed(F.col("_raw"))
    lines = lines.select(key, "_line", line.alias("_text")).where(F.col("_text") != "")
    numbered, bullet = F.regexp_extract("_text", NUMBERED, 2), F.regexp_extract("_text", BULLET, 1)
    listed = F.when(numbered != "", numbered).when(bullet != "", bullet)
    speaks = F.col("_text").rlike(RULE_LINE) & (F.octet_length("_text") > 15)

    def usable(text: Column) -> Column:
        return F.when((text != "") & ((constraint_type(text) != "conditional") | trigger(text).isNotNull()), text)

    rule = F.coalesce(usable(T.trimmed(listed)), F.when(speaks, usable(F.col("_text"))))
    rules = lines.withColumn("rule_text", rule).where(F.col("rule_text").isNotNull())
    order = Window.partitionBy(key).orderBy("_line")
    rules = rules.withColumns({"rule_idx": F.row_number().over(order) - 1, "constraint_type": constraint_type(F.col("rule_text"))})
    rules = rules.withColumn("trigger", F.when(F.col("constraint_type") == "conditional", trigger(F.col("rule_text"))))
    return rules.select(key, "rule_idx", "rule_text", "constraint_type", "trigger", assertion(F.col("rule_text"), F.col("constraint_type"), F.col("trigger")).alias("assertion"))


def violations(rules: DataFrame, outputs: DataFrame, key: str = "prompt_id", threshold: float = 0.7, strict: bool = True, backend: grounding.Backend = grounding.lexical) -> DataFrame:
    """output_id, rule_idx, claim_idx, claim, label, confidence of claims that break a rule of their prompt.

    Outputs are split once; each rule's assertion is the context that their claims are held against.
    """
    config = grounding.Config(neutral_unsupported=strict, flag_compound=False, contradiction=threshold)
    own = claims.long_enough(claims.explode_sentences(outputs, ["output_id", key], "output"), config.min_claim_bytes)
    own = own.select("output_id", key, F.col("idx").alias("claim_idx"), F.col("sentence").alias("claim"), T.normalized(F.col("sentence")).alias("claim_norm"))
    context = claims.explode_sentences(rules, [key, "rule_idx", "constraint_type"], "assertion")
    context = context.select(key, "rule_idx", "constraint_type", F.col("idx").alias("ctx_idx"), F.col("sentence").alias("ctx"), T.normalized(F.col("sentence")).alias("ctx_norm"))
    pairs = grounding.embedded(own, "claim", "a").join(grounding.embedded(context, "ctx", "b"), key)
    both = grounding.judge(pairs, ["output_id", "rule_idx", "constraint_type"], config, backend)
    against = F.col("label") == "contradiction"
    off = (F.col("label") == "neutral") & F.lit(strict)
    broken = (
        F.when(F.col("constraint_type") == "deny", (against | off) & (F.col("c") >= threshold))
        .when(F.col("constraint_type") == "require", (F.col("label") != "entailment") & (F.greatest("n", "c") >= threshold))
        .when(F.col("constraint_type") == "conditional", against & (F.col("c") >= threshold))
        .otherwise(False)
    )
    return both.where(broken).select("output_id", "rule_idx", "claim_idx", "claim", "label", F.greatest("c", "n").alias("confidence"))


def explanation(kind: Column, text: Column) -> Column:
    """A sentence on what a violation is."""
    how = F.when(kind == "deny", "violated (provided forbidden information for)").when(kind == "require", "failed to satisfy (missing required information for)").otherwise("contradicts")
    return F.concat(F.lit("Agent output "), how, F.lit(" the policy rule: "), text)


def compliance(outputs: DataFrame, broken: DataFrame) -> DataFrame:
    """output_id, n_violations, compliant for every output; without rules an output complies."""
    counts = broken.groupBy("output_id").agg(F.count("*").alias("n_violations"))
    joined = outputs.select("output_id").join(counts, "output_id", "left")
    n = F.coalesce("n_violations", F.lit(0))
    return joined.select("output_id", n.alias("n_violations"), (n == 0).alias("compliant"))
