"""Replies, their errors, and accuracy over the driver's tables: items' texts in several
envelopes; customers as questions, with the blocks of their own and look-alike names."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import top_k
from corpusmill.jobs import fact_jobs, text_jobs
from corpusmill.operators import answers, resolve


def _replies(spark, sf_dir):
    """Seven envelopes around the items' texts."""
    t, kind = F.coalesce("text", F.lit("")), F.col("item_id") % 7
    as_object = lambda key: F.to_json(F.struct(t.alias(key)))
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), as_object("answer"), F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here: "), F.to_json(F.array(t, F.lit("other")))))
        .when(kind == 2, F.concat(F.lit("["), as_object("name"), F.lit(', {"name": "y"}]'))).when(kind == 3, F.to_json(F.struct(F.lit("z").alias("first"), t.alias("answer"))))
        .when(kind == 4, as_object("result")).when(kind == 5, F.concat(F.lit('{"Answer": "'), F.substring_index(t, " ", 2), F.lit('", then'))).otherwise(t)
    )
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", reply.alias("reply"))


def envelope_answers(spark, sf_dir):
    return _replies(spark, sf_dir).select("item_id", answers.envelope_answer(F.col("reply")).alias("answer"))


def schema_examples(spark, sf_dir):
    rows = text_jobs.question_parse(spark, sf_dir)
    fields = F.filter(F.split("fields", ","), lambda f: f != "")
    return rows.select("conv_id", "turn", answers.schema_example(F.col("intent"), fields).alias("example"))


def _states(spark, sf_dir):
    asked = fact_jobs._asked(spark, sf_dir)
    other = F.regexp_extract("text", r"Project C(\d+)", 1).cast("long") != F.col("qid")
    return asked.select("qid", "block_id", "source_file", "text", other.alias("alike")).join(resolve.resolved(asked), ["qid", "block_id"])


def resolver_accuracy(spark, sf_dir):
    """Even customers ask what supersedes what, odd ones for their first order's file."""
    states = _states(spark, sf_dir)
    category = F.when(F.col("qid") % 2 == 0, "C").otherwise("F")
    first = states.groupBy("qid").agg(F.min_by(F.when(~F.col("alike"), F.col("source_file")), F.struct("alike", "block_id")).alias("target"))
    return answers.resolver_accuracy(states, first.select("qid", category.alias("category"), "target"))


def answer_errors(spark, sf_dir):
    """The amount of a question's last candidate as its answer, of its last active one as
    expected; every fourth question is not answered."""
    states = _states(spark, sf_dir).withColumn("amount", T.budget_string(F.col("text")))
    said = states.groupBy("qid").agg(F.max_by("amount", "block_id").alias("last"), F.max_by("amount", F.when(F.col("state") == "active", F.col("block_id"))).alias("expected"))
    category = F.element_at(F.array(F.lit("E"), F.lit("F"), F.lit("F")), (F.col("qid") % 3 + 1).cast("int"))
    rows = said.select("qid", category.alias("category"), F.when(F.col("qid") % 4 == 0, answers.ABSTAINED).otherwise(F.col("last")).alias("answer"), "expected")
    return answers.error_flags(rows, states)


def retrieval_rates(spark, sf_dir):
    """Of a question's candidates the five latest are found; files of contracts are
    expected, amendments utilised, all of the own name relevant."""
    asked = fact_jobs._asked(spark, sf_dir)
    own = F.regexp_extract("text", r"Project C(\d+)", 1).cast("long") == F.col("qid")
    of = lambda start: own & F.startswith("source_file", F.lit(start))
    units = asked.select("qid", F.col("block_id").alias("id"), of("contracts/").alias("expected"), of("contracts/amendment").alias("utilised"), own.alias("relevant"), own.alias("own"))
    found = top_k(units.select("qid", "id"), ["qid"], [F.col("id").desc()], 5)
    return answers.retrieval_rates(found, units)


QUERIES = {f.__name__: f for f in (envelope_answers, schema_examples, resolver_accuracy, answer_errors, retrieval_rates)}

_STATES = f"""{fact_jobs._ASKED},
st AS (SELECT ca.*, entity <> 'C' || qid AS alike, CASE WHEN entity <> 'C' || qid AND starts_with(entity, 'C' || qid) THEN 'suffix_distractor' WHEN entity <> 'C' || qid THEN 'unrelated_entity' WHEN reason IS NOT NULL THEN 'obsolete' ELSE 'active' END AS state FROM ca)"""
_SORTED = "array_to_string(list_sort(list_filter(regexp_split_to_array(lower(regexp_replace({0}, '[$,]', '', 'g')), '\\s+'), lambda x: x NOT IN ('', 'project'))), ' ')"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
ORACLES = {
    "envelope_answers": f"""
        WITH b AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark),
        r AS (SELECT item_id, CASE item_id % 7 WHEN 0 THEN '```json' || chr(10) || json_object('answer', t)::VARCHAR || chr(10) || '```' WHEN 1 THEN 'Here: ' || json_array(t, 'other')::VARCHAR
          WHEN 2 THEN '[' || json_object('name', t)::VARCHAR || ', {{"name": "y"}}]' WHEN 3 THEN json_object('first', 'z', 'answer', t)::VARCHAR WHEN 4 THEN json_object('result', t)::VARCHAR
          WHEN 5 THEN '{{"Answer": "' || array_to_string(string_split(t, ' ')[1:2], ' ') || '", then' ELSE t END AS reply FROM b),
        o AS (SELECT item_id, CASE WHEN starts_with(reply, '```') THEN regexp_replace(regexp_replace(reply, '^```[^\\n]*\\n', ''), '\\n```$', '') ELSE {_TRIM.format("reply")} END AS s FROM r),
        p AS (SELECT *, nullif(regexp_extract(s, '(?s)\\{{.*\\}}'), '') AS obj, nullif(regexp_extract(s, '(?s)\\[.*\\]'), '') AS arr, regexp_matches(s, '(?s)^[^\\[{{]*\\{{') AS is_object FROM o),
        j AS (SELECT *, CASE WHEN is_object AND json_valid(obj) THEN obj::JSON END AS jo, CASE WHEN NOT is_object AND json_valid(arr) THEN arr::JSON END AS ja FROM p)
        SELECT item_id, {_TRIM.format('''coalesce(
          CASE WHEN jo IS NOT NULL THEN CASE WHEN list_contains(json_keys(jo), 'answer') THEN jo->>'answer' ELSE jo->>(json_keys(jo)[1]) END END,
          CASE WHEN ja IS NOT NULL THEN array_to_string(list_transform(ja::JSON[], lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN x->>(json_keys(x)[1]) ELSE x->>'$' END), ', ') END,
          nullif(regexp_extract(s, '(?i)"answer"\\s*:\\s*"([^"]+)"', 1), ''), s)''')} AS answer FROM j""",
    "schema_examples": f"""
        WITH p AS ({text_jobs.ORACLES["question_parse"]}),
        s AS (SELECT conv_id, turn, intent, list_transform(list_filter(string_split(fields, ','), lambda x: x <> ''), lambda x: CASE WHEN x = 'deadline' THEN 'DATE' ELSE upper(x) END) AS f FROM p)
        SELECT conv_id, turn, CASE intent WHEN 'comparison' THEN '{answers.COMPARISON_EXAMPLE}' WHEN 'aggregation' THEN '{answers.LISTING_EXAMPLE}' WHEN 'multi_fact_extraction' THEN array_to_string(f, ' and ') ELSE coalesce(f[1], 'VALUE') END AS example FROM s""",
    "resolver_accuracy": f"""
        WITH {_STATES}, q AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN 'C' ELSE 'F' END AS category, arg_min(source_file, block_id) FILTER (NOT alike) AS target FROM st GROUP BY qid),
        a AS (SELECT qid, category, bool_or(state = 'active' AND contains(source_file, 'amendment')) AS amended, bool_or(state = 'obsolete' AND contains(source_file, 'base')) AS gone, bool_or(state = 'active' AND contains(source_file, 'base')) AS base,
              bool_or(state = 'active' AND alike) AS alike, bool_or(state = 'active' AND coalesce(source_file = target, false)) AS target FROM q JOIN st USING (qid) GROUP BY qid, category),
        n AS (SELECT category, count(*) AS n, count_if(CASE category WHEN 'C' THEN amended AND (gone OR NOT base) ELSE target AND NOT alike END)::BIGINT AS n_right FROM a GROUP BY category)
        SELECT *, round(100.0::DOUBLE * n_right / n, 6) AS accuracy, CASE WHEN 100.0::DOUBLE * n_right / n >= CASE category WHEN 'C' THEN 95 ELSE 100 END THEN 'PASS' ELSE 'FAIL' END AS gate FROM n""",
    "answer_errors": f"""
        WITH {_STATES}, am AS (SELECT *, regexp_extract(text, '\\$[0-9,]*[0-9]') AS amount FROM st),
        q AS (SELECT qid, CASE qid % 3 WHEN 0 THEN 'E' ELSE 'F' END AS category, CASE WHEN qid % 4 = 0 THEN 'NOT_FOUND' ELSE arg_max(amount, block_id) END AS answer, arg_max(amount, block_id) FILTER (state = 'active') AS expected FROM am GROUP BY qid),
        s AS (SELECT *, {_SORTED.format("coalesce(answer, '')")} AS said, {_SORTED.format("coalesce(expected, '')")} AS wanted FROM q),
        h AS (SELECT qid, bool_or(contains({_SORTED.format("text")}, said)) AS held FROM am JOIN s USING (qid) WHERE state = 'suffix_distractor' AND category = 'F' AND said <> wanted GROUP BY qid)
        SELECT qid, category, said = wanted AS right, coalesce(held, false) AS suffix_error, category = 'E' AND contains(answer, 'NOT_FOUND') AS abstained FROM s LEFT JOIN h USING (qid)""",
    "retrieval_rates": f"""
        WITH {_STATES}, u AS (SELECT qid, NOT alike AS own, NOT alike AND starts_with(source_file, 'contracts/') AS expected, NOT alike AND starts_with(source_file, 'contracts/amendment') AS utilised, row_number() OVER (PARTITION BY qid ORDER BY block_id DESC) <= 5 AS hit FROM st)
        SELECT qid, count_if(hit)::BIGINT AS n_found, round(count_if(hit AND NOT expected)::DOUBLE / count_if(hit), 6) AS distractor_rate, bool_or(hit AND own) AS case_hit, bool_or(hit AND expected) AS doc_hit,
          round(CASE WHEN count_if(utilised) > 0 THEN count_if(hit AND utilised)::DOUBLE / count_if(utilised) ELSE 1.0 END, 6) AS utilised_recall, round(CASE WHEN count_if(own) > 0 THEN count_if(hit AND own)::DOUBLE / count_if(own) ELSE 1.0 END, 6) AS relevant_recall
        FROM u GROUP BY qid""",
}
