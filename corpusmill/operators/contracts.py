"""What an answer may say, and whether it does: contracts, audits, claims, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

#: Answer types with their words, token limits and retry limits.
NUMERIC_QUESTIONS = ("what budget", "what is the budget", "how much", "budget amount", "include the budget", "with the budget")
TYPES = {"numeric_fact": (64, 32), "project_name": (32, 24), "short_explanation": (128, 96), "source_grounded_json": (96, 64)}


def answer_type(question: Column) -> Column:
    q = T.plain_answer(question)
    return (
        F.when(T.contains_any(q, NUMERIC_QUESTIONS), "numeric_fact").when(F.contains(q, F.lit("which project")), "project_name")
        .when(T.contains_any(q, ("why", "explain")), "short_explanation").otherwise("source_grounded_json")
    )


def compiled(packs: DataFrame) -> DataFrame:
    """``packs`` (qid, question, blocks: array<struct<source_file, text>>) with the
    contract of each: type, limits, and the sources, amounts and projects it may name."""
    texts = F.transform("blocks", lambda b: b["text"])
    facts = lambda pattern: F.array_sort(F.array_distinct(F.flatten(F.transform(texts, lambda t: T.matches(t, pattern)))))
    kind = answer_type(F.col("question"))
    limits = lambda i: F.coalesce(*[F.when(F.col("answer_type") == k, F.lit(v[i])) for k, v in TYPES.items()])
    rows = packs.withColumn("answer_type", kind)
    return rows.withColumns({
        "sources_allowed": F.array_sort(F.array_distinct(F.filter(F.transform("blocks", lambda b: b["source_file"]), lambda s: s != ""))),
        "amounts_allowed": facts(T.MONEY_PATTERN), "projects_allowed": facts(T.PROJECT_PATTERN),
        "max_output_tokens": limits(0), "retry_tokens": limits(1),
    })


def audited(rows: DataFrame) -> DataFrame:
    """Contracts with answers (answer, null if it couldn't be parsed; sources, expected,
    output_tokens) and their verdict: the first of parse, hallucination, source, budget
    and quality failures that applies, else PASS."""
    answer, expected = F.coalesce("answer", F.lit("")), F.col("expected")
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    strange = F.exists(sources, lambda s: ~F.array_contains("sources_allowed", s))
    amounts_ok = F.forall(T.matches(answer, T.MONEY_PATTERN), lambda x: F.array_contains("amounts_allowed", x))
    named = T.matches(answer, T.PROJECT_PATTERN)
    projects_ok = F.forall(named, lambda x: F.array_contains("projects_allowed", x))
    same = expected.isNotNull() & (expected != "") & (T.plain_answer(answer) == T.plain_answer(expected))
    wanted = T.matches(F.coalesce(expected, F.lit("")), T.PROJECT_PATTERN)
    project_ok = (F.size(named) > 0) & F.when(F.coalesce(expected, F.lit("")) != "", (F.size(wanted) > 0) & (F.lower(F.get(named, F.lit(0))) == F.lower(F.get(wanted, F.lit(0))))).otherwise(F.array_contains("projects_allowed", F.get(named, F.lit(0))))
    amount_ok = F.exists("amounts_allowed", lambda x: F.contains(answer, x))
    inside = F.contains(T.plain_answer(expected), T.plain_answer(answer)) | F.contains(T.plain_answer(answer), T.plain_answer(expected))
    context = T.plain_answer(F.array_join(F.transform("blocks", lambda b: b["text"]), " "))
    grounded = F.when(F.coalesce(expected, F.lit("")) != "", inside).otherwise((F.trim(answer) != "") & F.contains(context, T.plain_answer(answer)))
    satisfied = same | F.coalesce(F.when(F.col("answer_type") == "project_name", project_ok).when(F.col("answer_type") == "numeric_fact", amount_ok).otherwise(grounded), F.lit(False))
    cited = F.size(F.array_intersect(sources, "sources_allowed")) > 0
    verdict = (
        F.when(F.col("answer").isNull(), "MODEL_PARSE_FAIL").when(~amounts_ok | ~projects_ok, "HALLUCINATION_FAIL").when(strange | ~cited, "SOURCE_FAIL")
        .when(F.col("output_tokens") > F.col("max_output_tokens"), "OUTPUT_BUDGET_FAIL").when(~satisfied, "QUALITY_FAIL").otherwise("PASS")
    )
    return rows.withColumns({"verdict": verdict, "exact": same})


def route(action: Column, guard_answer: Column, category: Column, n_tokens: Column, limit: int = 3000) -> Column:
    """How a question is answered, by its guard's decision."""
    return (
        F.when(category == "synthesis", "LLM_SYNTHESIS").when((action == "BYPASS_LLM") & (guard_answer == "NOT_FOUND"), "NOT_FOUND")
        .when(category == "comparison", "COMPUTE_COMPARISON").when(category == "aggregation", "COMPUTE_AGGREGATION")
        .when((action != "BYPASS_LLM") & (n_tokens > limit), "LONG_CONTEXT_FALLBACK").when(action != "BYPASS_LLM", "LLM_COMPILED").otherwise("DETERMINISTIC")
    )


def verified_output(answer: Column, proof: Column, bypassed_absent: Column, evidence: Column, forbidden: Column) -> Column:
    """Reasons against an answer; none if it may stand."""
    absent, none_found = (proof == "ABSENT") | bypassed_absent, F.contains(answer, F.lit("NOT_FOUND"))
    text = F.replace(F.lower(evidence), F.lit(","), F.lit(""))
    loose = F.filter(T.grounding_terms(answer), lambda t: ~F.contains(text, F.regexp_replace(F.lower(t), "[$,]", "")))
    named = F.filter(forbidden, lambda f: T.mentions(answer, f))
    reasons = F.concat(F.transform(named, lambda f: F.concat(F.lit("forbidden: "), f)), F.transform(loose, lambda t: F.concat(F.lit("not grounded: "), t)))
    nothing = F.array().cast("array<string>")
    return (
        F.when(absent, F.when(none_found, nothing).otherwise(F.array(F.lit("should be NOT_FOUND"))))
        .when(none_found, F.when(proof == "COMPLETE", F.array(F.lit("evidence was complete"))).otherwise(nothing)).otherwise(reasons)
    )


def verified_claims(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """``claims`` (claim_id, entity, field, value) against ``facts`` (entity, field, value,
    status): active, obsolete, wrong value, or unknown entity. Both sides are compared as
    normalised answers; a claim's many facts are an aggregate, not a list."""
    known = facts.groupBy("entity").agg(F.max(F.col("status") == "active").alias("alive"))
    hit = facts.select("entity", "field", T.plain_answer(F.col("value")).alias("_v"), (F.col("status") == "active").alias("active")).groupBy("entity", "field", "_v").agg(F.max("active").alias("active"))
    rows = claims.withColumn("_v", T.plain_answer(F.col("value"))).join(hit, ["entity", "field", "_v"], "left").join(known, "entity", "left")
    state = F.when(~F.coalesce("alive", F.lit(False)), "unknown_entity").when(F.col("active"), "active").when(F.col("active").isNotNull(), "obsolete").otherwise("wrong_value")
    return rows.select("claim_id", "entity", "field", "value", state.alias("state"))


def prompt(instruction: str, question: Column, blocks: Column) -> Column:
    """Instruction, sources with their texts, question; one string."""
    shown = F.transform(blocks, lambda b: F.concat(F.lit("["), b["source_file"], F.lit("]\n"), b["text"]))
    return F.concat_ws("\n\n", F.lit(instruction), F.array_join(shown, "\n\n"), F.concat(F.lit("Question: "), question))
