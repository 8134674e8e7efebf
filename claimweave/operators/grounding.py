"""Groundedness: claims against context sentences, verdicts and scores.

All of it is keyed by eval_id: sentences, candidates, verdicts and results share that partitioning. What a
backend adds are three columns e, n, c of a pair; the lexical and the fixed one are Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from . import backends, claims

# Fixed value: words that negate.
NEGATIONS = ["no", "not", "never", "none", "cannot", "nicht", "kein", "pas", "ne", "nunca"]


@dataclass(frozen=True)
class Config:
    """Settings of a check, with the library's defaults."""

    contradiction: float = 0.7
    neutral_unsupported: bool = False
    min_claim_bytes: int = 10
    min_match_bytes: int = 12
    top_k: int = 5
    min_similarity: float = 0.1
    adaptive: bool = False
    flag_compound: bool = True
    partial: tuple[float, float, float] = (0.2, 0.65, 0.7)
    pass_threshold: float = 0.7
    #: What a claim without any candidate is: "entailment" as evaluators of this kind do, or "neutral".
    no_evidence_label: str = "entailment"


SERVICE = Config(contradiction=0.5, top_k=10, min_similarity=0.25, adaptive=True)

Backend = Callable[[Column, Column], tuple[Column, Column, Column]]


def lexical(premise: Column, hypothesis: Column) -> tuple[Column, Column, Column]:
    """Word overlap as entailment, or as contradiction where exactly one side negates. A test scorer, not a model."""
    own, other = T.words(hypothesis), T.words(premise)
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(own, other)).cast("double"), F.size(own)), F.lit(0.0))
    negation = F.array(*map(F.lit, NEGATIONS))
    differs = F.arrays_overlap(own, negation) != F.arrays_overlap(other, negation)
    return F.when(differs, 0.0).otherwise(overlap), 1.0 - overlap, F.when(differs, overlap).otherwise(0.0)


def fixed(e: float, n: float, c: float) -> Backend:
    """The same probabilities for every pair."""
    return lambda premise, hypothesis: (F.lit(e), F.lit(n), F.lit(c))


def argmax_label(e: Column, n: Column, c: Column) -> Column:
    """The label of the largest probability, the last one of equals."""
    return F.when((c >= e) & (c >= n), "contradiction").when(n >= e, "neutral").otherwise("entailment")


def softmax(logits: list[Column]) -> list[Column]:
    """Probabilities of logits, with the largest subtracted first."""
    top = F.greatest(*logits)
    exps = [F.exp(x - top) for x in logits]
    total = sum(exps[1:], exps[0])
    return [x / total for x in exps]


def split_claims(evals: DataFrame, config: Config = Config()) -> DataFrame:
    """eval_id, claim_idx, claim, claim_norm of the outputs."""
    rows = claims.long_enough(claims.explode_sentences(evals, ["eval_id"], "output"), config.min_claim_bytes)
    return rows.select("eval_id", F.col("idx").alias("claim_idx"), F.col("sentence").alias("claim"), T.normalized(F.col("sentence")).alias("claim_norm"))


def split_context(evals: DataFrame) -> DataFrame:
    """eval_id, ctx_idx, ctx, ctx_norm of the contexts."""
    rows = claims.explode_sentences(evals, ["eval_id"], "context")
    return rows.select("eval_id", F.col("idx").alias("ctx_idx"), F.col("sentence").alias("ctx"), T.normalized(F.col("sentence")).alias("ctx_norm"))


def fast_path(own: DataFrame, context: DataFrame, config: Config = Config()) -> DataFrame:
    """eval_id, claim_idx, ctx_idx: the first context sentence that holds the claim verbatim."""
    long = own.where(F.octet_length("claim_norm") >= config.min_match_bytes)
    met = long.join(context, "eval_id").where(F.contains(F.col("ctx_norm"), F.col("claim_norm")))
    return met.groupBy("eval_id", "claim_idx").agg(F.min("ctx_idx").alias("ctx_idx"))


def residue(own: DataFrame, matched: DataFrame) -> DataFrame:
    """Claims that no context sentence holds verbatim."""
    return own.join(matched, ["eval_id", "claim_idx"], "left_anti")


#: Vectors of a text column: (df, column, name) gives df with `name`_v, an array of doubles.
Embedder = Callable[[DataFrame, str, str], DataFrame]


def letters(df: DataFrame, column: str, name: str) -> DataFrame:
    """The deterministic embedding for tests and offline runs."""
    return df.withColumn(f"{name}_v", T.letter_vector(F.col(column)))


def embedded(df: DataFrame, column: str, name: str, embed: Embedder = letters) -> DataFrame:
    """df with the vector of a text column and its length."""
    v = F.col(f"{name}_v")
    return embed(df, column, name).withColumn(f"{name}_norm", F.sqrt(T.dot(v, v)))


@dataclass(frozen=True)
class ModelBackend:
    """An entailment model behind Arrow batches: `make` is called once in a worker and gives a scorer of (premises, hypotheses)."""

    make: Callable[[], Callable]
    key: str
    batch: int = 16

    def scored(self, rows: DataFrame, where: Column) -> DataFrame:
        """rows with e, n, c, which are null where `where` is false; the model sees each pair of texts once."""
        told = backends.score_texts(rows.where(where).select("ctx", "claim"), self.make, self.key, self.batch)
        told = told.select(F.col("ctx").alias("_ctx"), F.col("claim").alias("_claim"), "e", "n", "c")
        return rows.join(told, where & (F.col("ctx") == F.col("_ctx")) & (F.col("claim") == F.col("_claim")), "left").drop("_ctx", "_claim")


def candidates(left: DataFrame, context: DataFrame, config: Config = Config(), k_col: Column | None = None, embed: Embedder = letters) -> DataFrame:
    """eval_id, claim_idx, claim, ctx_idx, ctx, sim, rank: each claim's best context sentences, or all with sim null for top_k 0.

    Equal similarities keep the order of the context. The rank limit is planned below the window's shuffle.
    """
    k = F.lit(config.top_k) if k_col is None else k_col
    pairs = embedded(left, "claim", "a", embed).join(embedded(context, "ctx", "b", embed), "eval_id")
    sim = T.cosine(F.col("a_v"), F.col("b_v"), F.col("a_norm"), F.col("b_norm"))
    every = pairs.select("eval_id", "claim_idx", "claim", "ctx_idx", "ctx", sim.alias("sim"), T.adaptive_k(F.col("claim"), k, config.adaptive).alias("k"))
    if config.top_k == 0:
        every = every.withColumn("sim", F.lit(None).cast("double"))
        order = Window.partitionBy("eval_id", "claim_idx").orderBy("ctx_idx")
        return every.withColumn("rank", F.row_number().over(order)).drop("k")
    order = Window.partitionBy("eval_id", "claim_idx").orderBy(F.col("sim").desc(), "ctx_idx")
    ranked = every.where(F.col("sim") >= config.min_similarity).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= config.top_k) & (F.col("rank") <= F.col("k"))).drop("k")


def scored(pairs: DataFrame, backend: Backend | ModelBackend = lexical) -> DataFrame:
    """pairs with e, n, c, for premise ctx and hypothesis claim."""
    if isinstance(backend, ModelBackend):
        return backend.scored(pairs, F.lit(True))
    e, n, c = backend(F.col("ctx"), F.col("claim"))
    return pairs.withColumns({"e": e, "n": n, "c": c})


def best_evidence(rows: DataFrame) -> DataFrame:
    """eval_id, claim_idx and the pair `best` with the largest of e and c, the first of equals; without any the most similar one."""
    score = F.greatest("e", "c")
    pair = F.struct("ctx_idx", "ctx", "sim", "e", "n", "c")
    usable = F.when((score > 0) | F.col("sim").isNotNull(), F.struct(score, -F.col("rank")))
    return rows.groupBy("eval_id", "claim_idx").agg(F.max_by(pair, usable).alias("best"), F.max(usable).alias("_u"), F.count("*").alias("evaluated")).withColumn("best", F.when(F.col("_u").isNotNull(), F.col("best"))).drop("_u")


def strongest_contradiction(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """eval_id, claim_idx, c, ctx_idx of the strongest pair that reaches the contradiction threshold."""
    met = rows.where((F.col("c") >= config.contradiction) & (F.col("c") > 0))
    return met.groupBy("eval_id", "claim_idx").agg(F.max_by(F.struct("ctx_idx", "c"), F.struct("c", -F.col("rank"))).alias("against"))


def is_partial(config: Config = Config()) -> Column:
    """Pairs that support a part of a compound claim."""
    floor, ceiling, near = config.partial
    return (F.col("e") >= floor) & (F.col("e") > F.col("c")) & (F.col("n") <= ceiling) & (F.col("sim").isNull() | (F.col("sim") >= near))


def partial_evidence(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """eval_id, claim_idx, ctx_idx, e of supporting pairs, each context sentence once with its strongest pair."""
    kept = rows.where(is_partial(config))
    return kept.groupBy("eval_id", "claim_idx", "ctx_idx").agg(F.max("e").alias("e"))


def classify(e: Column, n: Column, c: Column, config: Config = Config()) -> Column:
    """contradiction, entailment or neutral."""
    return F.when((c >= e) & (c >= n) & (c >= config.contradiction), "contradiction").when((e >= n) & (e >= c), "entailment").otherwise("neutral")


def verdicts(evals: DataFrame, config: Config = Config(), backend: Backend | ModelBackend = lexical, embed: Embedder = letters) -> DataFrame:
    """A row for each claim: verbatim ones are entailed, the others go through candidates and the backend.

    One join of claims and context on eval_id carries all of it: the windows and the aggregate that follow
    are keyed by eval_id and claim_idx, which that partitioning satisfies. The backend sees only the
    candidates of claims without a verbatim match.
    """
    pairs = embedded(split_claims(evals, config), "claim", "a", embed).join(embedded(split_context(evals), "ctx", "b", embed), "eval_id", "left")
    return judge(pairs, ["eval_id"], config, backend)


def judge(pairs: DataFrame, keys: list[str], config: Config = Config(), backend: Backend | ModelBackend = lexical) -> DataFrame:
    """A row for each claim of `keys`, from all its pairs (embedded claims left-joined to embedded context)."""
    hit = (F.octet_length("claim_norm") >= config.min_match_bytes) & F.contains(F.col("ctx_norm"), F.col("claim_norm"))
    sim = F.lit(None).cast("double") if config.top_k == 0 else T.cosine(F.col("a_v"), F.col("b_v"), F.col("a_norm"), F.col("b_norm"))
    rows = pairs.select(*keys, "claim_idx", "claim", "ctx_idx", "ctx", sim.alias("sim"), F.coalesce(hit, F.lit(False)).alias("hit"))
    near = F.col("ctx_idx").isNotNull() if config.top_k == 0 else F.coalesce(F.col("sim") >= config.min_similarity, F.lit(False))
    per = Window.partitionBy(*keys, "claim_idx")
    # The first verbatim sentence comes first, so that a constant limit on the rank (planned below the window, on each
    # task's own rows) keeps it, or else the best candidates, or else one row of a claim without any.
    first = per.orderBy(F.when(F.col("hit"), F.col("ctx_idx")).asc_nulls_last(), F.col("near").desc(), F.col("sim").desc(), "ctx_idx")
    rows = rows.withColumn("near", near).withColumn("rank", F.row_number().over(first))
    if config.top_k:
        rows = rows.where(F.col("rank") <= config.top_k)
        rows = rows.withColumn("near", F.col("near") & (F.col("rank") <= T.adaptive_k(F.col("claim"), config.top_k, config.adaptive)))
    rows = rows.withColumn("at", F.min(F.when(F.col("hit"), F.col("ctx_idx"))).over(per))
    rows = rows.withColumn("near", F.col("near") & F.col("at").isNull()).where(F.col("near") | (F.col("rank") == 1))
    if isinstance(backend, ModelBackend):
        rows = backend.scored(rows, F.col("near"))
    else:
        e, n, c = (F.when(F.col("near"), x) for x in backend(F.col("ctx"), F.col("claim")))
        rows = rows.withColumns({"e": e, "n": n, "c": c})
    score = F.greatest("e", "c")
    usable = F.when(F.col("near") & ((score > 0) | F.col("sim").isNotNull()), F.struct(score, -F.col("rank")))
    part, strong = F.col("near") & is_partial(config), F.col("near") & (F.col("c") >= config.contradiction) & (F.col("c") > 0)
    grouped = rows.groupBy(*keys, "claim_idx", "claim").agg(
        F.max_by(F.struct("ctx_idx", "ctx", "sim", "e", "n", "c"), usable).alias("best"),
        F.max(usable).alias("_usable"),
        F.max(F.when(F.col("ctx_idx") == F.col("at"), F.struct("ctx_idx", "ctx"))).alias("_hit"),
        F.max(F.when(strong, F.col("c"))).alias("against"),
        F.count(F.when(part, 1)).alias("supporting"),
        F.avg(F.when(part, F.col("e"))).alias("_mean"),
        F.count(F.when(F.col("near"), 1)).alias("evaluated"),
        (F.count("ctx_idx") == 0).alias("_bare"),
    )
    grouped = grouped.withColumns({"best": F.when(F.col("_usable").isNotNull(), F.col("best")), "verbatim": F.col("_hit").isNotNull()})
    e, n, c = (F.coalesce(F.col(f"best.{x}"), F.lit(0.0)) for x in "enc")
    label = F.when(F.col("evaluated") == 0, config.no_evidence_label).otherwise(classify(e, n, c, config))
    label = F.when(F.col("verbatim"), "entailment").when(F.col("_bare"), "neutral").otherwise(label)
    compound = T.is_compound(F.col("claim")) if config.flag_compound else F.lit(False)
    out = grouped.withColumns({"label": label, "is_compound": compound})
    partial = ~F.col("_bare") & F.col("is_compound") & (F.col("label") == "neutral") & F.col("against").isNull() & (F.col("supporting") >= 2)
    out = out.withColumn("_partial", partial)
    exact = F.col("verbatim")
    return out.select(
        *keys, "claim_idx", "claim",
        F.when(F.col("_partial"), "partial").otherwise(F.col("label")).alias("label"),
        F.when(exact, 1.0).when(F.col("_partial"), F.col("_mean")).otherwise(e).alias("e"), F.when(F.col("_bare"), 1.0).otherwise(n).alias("n"), c.alias("c"),
        (F.col("_partial") | (F.col("label") == "entailment") | ((F.col("label") == "neutral") & F.lit(not config.neutral_unsupported))).alias("supported"),
        F.when(exact, F.col("_hit.ctx_idx")).otherwise(F.col("best.ctx_idx")).alias("ctx_idx"), F.when(exact, F.col("_hit.ctx")).otherwise(F.col("best.ctx")).alias("evidence"),
        F.col("best.sim").alias("sim"), "against", "evaluated", "is_compound", F.when(F.col("_partial"), F.col("supporting")).otherwise(0).alias("supporting"), "verbatim",
    )


def scores(evals: DataFrame, judged: DataFrame) -> DataFrame:
    """A row for each evaluation: claim counts by label and the supported share; 1.0 without claims."""
    count = lambda label: F.count(F.when(F.col("label") == label, 1))
    grouped = judged.groupBy("eval_id").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("supported"), 1)).alias("supported"), count("entailment").alias("entailed"), count("neutral").alias("neutral"),
        count("contradiction").alias("contradicted"), count("partial").alias("partial"), F.count(F.when(F.col("verbatim"), 1)).alias("skipped"),
    )
    names = ["total", "supported", "entailed", "neutral", "contradicted", "partial", "skipped"]
    joined = evals.select("eval_id").join(grouped, "eval_id", "left")
    out = joined.select("eval_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in names])
    return out.withColumn("score", F.when(F.col("total") == 0, 1.0).otherwise(F.col("supported") / F.col("total")))


def call_counters(evals: DataFrame, config: Config = Config()) -> DataFrame:
    """eval_id, calls (pairs scored), saved (pairs that the pre-filter spared) and skipped (verbatim claims)."""
    own, context = split_claims(evals, config), split_context(evals)
    matched = fast_path(own, context, config)
    left = residue(own, matched)
    per = lambda df, name: df.groupBy("eval_id").agg(F.count("*").alias(name))
    joined = evals.select("eval_id")
    for df, name in ((candidates(left, context, config), "calls"), (left, "_left"), (context, "_contexts"), (matched, "skipped")):
        joined = joined.join(per(df, name), "eval_id", "left")
    joined = joined.fillna(0)
    return joined.select("eval_id", "calls", (F.col("_left") * F.col("_contexts") - F.col("calls")).alias("saved"), "skipped")


def issues(judged: DataFrame) -> DataFrame:
    """Unsupported claims as issues with type, severity and confidence."""
    against = F.col("label") == "contradiction"
    return judged.where(~F.col("supported")).select(
        "eval_id", "claim_idx", F.col("claim").alias("text"), F.when(against, "contradiction").otherwise("unsupported").alias("issue_type"),
        F.when(against, "high").otherwise("medium").alias("severity"), F.when(against, F.col("c")).otherwise(1 - F.col("e")).alias("confidence"),
    )


def chunk_id(chunks: Column, sentence: Column) -> Column:
    """The id of the first chunk (struct of id, text) whose text holds the sentence."""
    return F.get(F.filter(chunks, lambda c: F.contains(c["text"], sentence)), F.lit(0))["id"]
