"""Answers of a model: reading them out of what was sent, the form asked for, and what kind
of error they hold; accuracy of a resolver and rates of retrieval over many questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Examples of the form of an answer, and gates of the resolver in percent.
COMPARISON_EXAMPLE, LISTING_EXAMPLE, PLAIN_EXAMPLE = "Project NAME (budget of BUDGET)", "PROJECT_1, PROJECT_2", "VALUE"
RESOLVER_GATES = {"C": 95.0, "F": 100.0}
ABSTAINED = "NOT_FOUND"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _first_value(json: Column) -> Column:
    """The first value of a JSON object, null if it isn't one or is empty."""
    return F.get(F.map_values(F.from_json(json, "map<string,string>")), 0)


def _object_answer(json: Column) -> Column:
    fields = F.from_json(json, "map<string,string>")
    return F.when(F.map_contains_key(fields, "answer"), F.coalesce(F.element_at(fields, "answer"), F.lit("null"))).otherwise(_first_value(json))


def envelope_answer(text: Column, primed: bool = False) -> Column:
    """The answer inside a reply: out of its code fence, then the JSON object's ``answer`` or
    first value, or a list's items (of objects the first value) joined by commas; else
    what a pattern finds behind "answer"; else the whole. ``primed`` replies go on from
    an opened object. Values that aren't strings keep their JSON spelling; null is empty.
    """
    whole = _stripped(F.coalesce(text, F.lit("")))
    fenced = F.startswith(whole, F.lit("```"))
    inside = F.regexp_replace(F.regexp_replace(whole, r"^```[^\n]*(\n|$)", ""), r"(^|\n)[^\S\n]*```[^\S\n]*$", "")
    body = F.when(fenced, _stripped(inside)).otherwise(whole)
    is_object = F.regexp_like(body, F.lit(r"(?s)^[^\[{]*\{"))
    found = F.when(is_object, _object_answer(T.found(body, r"(?s)\{.*\}")))
    items = F.from_json(F.when(~is_object, T.found(body, r"(?s)\[.*\]")), "array<string>")
    listed = F.array_join(F.transform(items, lambda x: _stripped(F.coalesce(F.when(F.startswith(x, F.lit("{")), _first_value(x)), x, F.lit("null")))), ", ")
    tries = [found, listed, T.found(body, r'(?i)"answer"\s*:\s*"([^"]+)"', 1)]
    if primed:
        opened = F.when(~F.regexp_like(body, F.lit(r"^[{\[]")), F.concat(F.lit('{"answer": "'), body))
        tries = [_object_answer(opened), _object_answer(F.concat(opened, F.lit('"}'))), *tries]
        body = F.regexp_replace(F.regexp_replace(body, r'"\s*\}\s*$', ""), r'^\s*"', "")
    return _stripped(F.coalesce(*tries, body))


def schema_example(intent: Column, fields: Column) -> Column:
    """An example of the answer's form, by the question's intent and required fields."""
    shown = F.transform(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.when(f == "deadline", "DATE").otherwise(F.upper(f)))
    return (
        F.when(intent == "comparison", COMPARISON_EXAMPLE).when(intent == "aggregation", LISTING_EXAMPLE)
        .when(intent == "multi_fact_extraction", F.array_join(shown, " and ")).otherwise(F.coalesce(F.get(shown, 0), F.lit(PLAIN_EXAMPLE)))
    )


def error_flags(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answers (qid, category, answer, expected) with right, suffix_error (a wrong one of
    category F that a look-alike's text holds) and abstained (of category E, right to).

    ``candidates``: (qid, state, text). They are reduced to a flag in place: the answers
    are joined to them, a flag per question and task is shuffled.
    """
    said = T.token_sorted_answer(F.col("answer"))
    rows = answers.withColumns({"said": said, "right": said == T.token_sorted_answer(F.col("expected"))})
    wrong = rows.where("category = 'F' AND NOT right").select("qid", "said")
    alike = candidates.where(F.col("state") == "suffix_distractor").join(wrong, "qid")
    held = alike.groupBy("qid").agg(F.max(F.contains(T.token_sorted_answer(F.lower("text")), F.col("said"))).alias("held"))
    return rows.join(held, "qid", "left").select(
        "qid", "category", "right", F.coalesce("held", F.lit(False)).alias("suffix_error"),
        ((F.col("category") == "E") & F.coalesce(F.contains("answer", F.lit(ABSTAINED)), F.lit(False))).alias("abstained"),
    )


def resolver_accuracy(states: DataFrame, questions: DataFrame) -> DataFrame:
    """(category, n, n_right, accuracy, gate) over ``questions`` (qid, category, target) for
    ``states`` (qid, source_file, state, alike). C is right if an amendment is active and
    the base isn't, or is obsolete somewhere; F if the target is active and no look-alike
    is. A question without candidates is wrong."""
    file, active = F.lower(F.col("source_file")), F.col("state") == "active"
    any_of = lambda flag: F.coalesce(F.max(F.coalesce(flag, F.lit(False))), F.lit(False))
    amended, base = F.contains(file, F.lit("amendment")), F.contains(file, F.lit("base"))
    rows = questions.join(states, "qid", "left").groupBy("qid", "category").agg(
        any_of(active & amended).alias("amended"), any_of((F.col("state") == "obsolete") & base).alias("gone"), any_of(active & base).alias("base"),
        any_of(active & F.col("alike")).alias("alike"), any_of(active & (F.replace("source_file", F.lit("\\"), F.lit("/")) == F.replace("target", F.lit("\\"), F.lit("/")))).alias("target"),
    )
    right = F.when(F.col("category") == "C", F.col("amended") & (F.col("gone") | ~F.col("base"))).when(F.col("category") == "F", F.col("target") & ~F.col("alike"))
    out = rows.where(F.col("category").isin(*RESOLVER_GATES)).groupBy("category").agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"))
    accuracy = 100.0 * F.col("n_right") / F.col("n")
    gate = F.when(F.col("category") == "C", RESOLVER_GATES["C"]).otherwise(RESOLVER_GATES["F"])
    return out.select("category", "n", "n_right", F.round(accuracy, 6).alias("accuracy"), F.when(accuracy >= gate, "PASS").otherwise("FAIL").alias("gate"))


def retrieval_rates(found: DataFrame, units: DataFrame) -> DataFrame:
    """Per question of ``units`` (qid, id, expected, utilised, relevant, own: whether the
    unit is of the question's case) what ``found`` (qid, id) means: share of distractors,
    whether a unit of the case and an expected one were found, and recall of utilised and
    relevant units (1 where there are none). Found units that aren't in ``units`` are
    distractors; one found twice counts once."""
    flags = ("expected", "utilised", "relevant", "own")
    hits = found.select("qid", "id").distinct().withColumn("hit", F.lit(True))
    rows = units.select("qid", "id", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags]).join(hits, ["qid", "id"], "full").fillna(False, [*flags, "hit"])
    sums = rows.groupBy("qid").agg(F.count_if("hit").alias("n_found"), *[F.count_if(F.col("hit") & F.col(f)).alias(f"{f}_hits") for f in flags], *[F.count_if(f).alias(f) for f in ("utilised", "relevant")])
    share = lambda n, of, none: F.round(F.when(F.col(of) > 0, n / F.col(of)).otherwise(none), 6)
    return sums.join(units.select("qid").distinct(), "qid", "left_semi").select(
        "qid", "n_found", share(F.col("n_found") - F.col("expected_hits"), "n_found", 0.0).alias("distractor_rate"), (F.col("own_hits") > 0).alias("case_hit"),
        (F.col("expected_hits") > 0).alias("doc_hit"), share(F.col("utilised_hits"), "utilised", 1.0).alias("utilised_recall"), share(F.col("relevant_hits"), "relevant", 1.0).alias("relevant_recall"),
    )
