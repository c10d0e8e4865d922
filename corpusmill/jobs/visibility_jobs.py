"""Contexts read whole and in part, over the driver's tables: a conversation is a context,
its turns are blocks. The longest turn is gold, the shortest deprecated; an answer is
the number and first line of the longest turn that a mode keeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import written
from corpusmill.jobs.search_jobs import CASE_BM25
from corpusmill.operators import retrieval, visibility
from corpusmill.operators import selection as S

#: Tokens before a context's first block.
SYSTEM = 20


def _turns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("group"), F.col("turn").alias("id"), "role", "text")


def fixed_width_layout(spark, sf_dir):
    rows = visibility.laid_out(_turns(spark, sf_dir).select("group", "id", T.words(F.col("text")).alias("tokens")), start=SYSTEM)
    return rows.select(F.col("group").alias("conv_id"), F.col("id").alias("turn"), "block_id", "token_start", "token_end", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), "n_padded", "n_cut")


def _scored(spark, sf_dir):
    """(group, id, visible, score): turns kept by the retention label, and their BM25 for
    the conversation's first user turn."""
    turns = _turns(spark, sf_dir)
    asked = turns.where("role = 'user'").groupBy(F.col("group").alias("case")).agg(F.min_by("text", "id").alias("text"))
    scores = retrieval.bm25_case_scores(turns.select(F.col("group").alias("case"), "id", "text"), asked).withColumnRenamed("case", "group")
    label = S.retained(turns.withColumn("score", F.coalesce(F.length("text"), F.lit(0))), 2, 2, "the").withColumnRenamed("keep", "visible")
    return label.join(scores, ["group", "id"], "left")


def replay_selections(spark, sf_dir):
    return visibility.same_size(_scored(spark, sf_dir)).withColumnsRenamed({"group": "conv_id", "id": "turn"})


def _runs(spark, sf_dir):
    line = F.concat(F.lit("turn "), F.col("id").cast("string"), F.lit(": "), F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), 1))
    turns = _turns(spark, sf_dir).select("group", "id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.coalesce(F.size(T.words(F.col("text"))), F.lit(0)).alias("n_tokens"), line.alias("line"))
    longest, shortest = F.struct("chars", -F.col("id")), F.struct("chars", "id")
    ends = turns.groupBy("group").agg(F.max_by("id", longest).alias("gold"), F.max_by("line", longest).alias("expected"), F.min_by("id", shortest).alias("old"), F.min_by("line", shortest).alias("stale"))
    category = F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("group") % 5 + 1).cast("int"))
    flags = turns.join(ends, "group").select("group", "id", "n_tokens", (F.col("id") == F.col("gold")).alias("gold"), (F.col("id") == F.col("old")).alias("deprecated"))
    kept = written(visibility.same_size(_scored(spark, sf_dir)), "kept")
    answers = kept.join(turns, ["group", "id"]).groupBy("group", "mode").agg(F.max_by("line", longest).alias("answer"))
    return visibility.judged(kept, flags, ends.select("group", category.alias("category"), "expected", "stale"), answers)


def visibility_runs(spark, sf_dir):
    return _runs(spark, sf_dir).withColumnRenamed("group", "conv_id")


def visibility_gates(spark, sf_dir):
    return visibility.gates(_runs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (fixed_width_layout, replay_selections, visibility_runs, visibility_gates)}

_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
_BARE = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the')), ' ')"
_KEPT = f"""{CASE_BM25},
lb AS (SELECT conv_id AS c, turn AS id, coalesce(row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(length(text), 0) DESC, turn) <= 2
       OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 OR contains(lower(text), 'the'), false) AS visible FROM conversations),
sc AS (SELECT lb.c, lb.id, visible, count_if(visible) OVER (PARTITION BY lb.c) AS n, row_number() OVER (PARTITION BY lb.c ORDER BY coalesce(score, 0) DESC, lb.id) AS by_score,
       row_number() OVER (PARTITION BY lb.c ORDER BY sha256('42|' || lb.c || '|' || lb.id), lb.id) AS by_draw FROM lb LEFT JOIN r ON r.c = lb.c AND r.id = lb.id),
kept AS (SELECT c, 'full' AS mode, id FROM sc UNION ALL SELECT c, 'visibility', id FROM sc WHERE visible UNION ALL SELECT c, 'random', id FROM sc WHERE by_draw <= n UNION ALL SELECT c, 'bm25', id FROM sc WHERE by_score <= n)
"""
_RUNS = f"""{_KEPT},
tn AS (SELECT conv_id AS c, turn AS id, coalesce(length(text), 0) AS chars, coalesce(len({_WORDS.format("text")}), 0) AS nt, 'turn ' || turn || ': ' || split_part(coalesce(text, ''), chr(10), 1) AS line FROM conversations),
rk AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY chars DESC, id) AS up, row_number() OVER (PARTITION BY c ORDER BY chars, id) AS down FROM tn),
sm AS (SELECT c, count(*) AS total_blocks, max(line) FILTER (up = 1) AS expected, max(line) FILTER (down = 1) AS stale FROM rk GROUP BY c),
kb AS (SELECT c, mode, count(*) AS kept_blocks, sum(nt)::BIGINT AS input_tokens, bool_or(up = 1) AS gold_recall, bool_or(down = 1) AS wrong_retention, arg_min(line, up) AS answer FROM kept JOIN rk USING (c, id) GROUP BY c, mode),
j AS (SELECT *, substr('ABCDE', (c % 5)::INT + 1, 1) AS category, {_BARE.format("answer")} AS a, {_BARE.format("expected")} AS e FROM kb JOIN sm USING (c)),
m AS (SELECT *, e <> '' AND (a = e OR (contains(a, e) AND length(a) < 4 * length(e) + 30)) AS exact_match FROM j),
runs AS (SELECT c AS conv_id, mode, category, exact_match, len(list_filter(regexp_extract_all(expected, '\\d+'), lambda x: NOT list_contains(regexp_extract_all(answer, '\\d+'), x))) = 0 AS numeric_preservation, gold_recall, wrong_retention,
  exact_match AND NOT (category = 'C' AND contains(answer, stale)) AS active_truth, input_tokens, input_tokens * {visibility.KV_BYTES} AS kv_bytes, kept_blocks, total_blocks FROM m)
"""


def _share(mode: str, flag: str) -> str:
    return f"avg(100.0::DOUBLE * {flag}::INT) FILTER (mode = '{mode}')"


_VALUES = {
    "gold_recall": _share("visibility", "gold_recall"), "exact_match": _share("visibility", "exact_match"), "numeric_preservation": _share("visibility", "numeric_preservation"),
    "kv_reduction": "100.0::DOUBLE * avg(1 - kept_blocks / total_blocks) FILTER (mode = 'visibility')",
    "token_reduction": "100.0::DOUBLE * (1 - (avg(input_tokens) FILTER (mode = 'visibility')) / (avg(input_tokens) FILTER (mode = 'full')))",
    "random_gap": f"{_share('visibility', 'exact_match')} - {_share('random', 'exact_match')}", "bm25_gap": f"{_share('visibility', 'exact_match')} - {_share('bm25', 'exact_match')}",
    "contradiction": "coalesce(avg(100.0::DOUBLE * active_truth::INT) FILTER (mode = 'visibility' AND category = 'C'), 100)",
}
_LINES = " UNION ALL ".join(f"SELECT '{g}' AS gate, (SELECT round({v}, 6) FROM runs) AS value, {visibility.TARGETS[g]}::DOUBLE AS target" for g, v in _VALUES.items())
ORACLES = {
    "fixed_width_layout": f"""
        WITH t AS (SELECT conv_id, turn, coalesce({_WORDS.format("text")}, []) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block_id FROM conversations)
        SELECT conv_id, turn, block_id, block_id * 128 + {SYSTEM} AS token_start, block_id * 128 + {SYSTEM + 128} AS token_end, md5(array_to_string(list_resize(w, 128, chr(10)), ' ')) AS tokens_md5,
               greatest(0, 128 - len(w))::INT AS n_padded, greatest(0, len(w) - 128)::INT AS n_cut FROM t""",
    "replay_selections": f"WITH {_KEPT} SELECT c AS conv_id, mode, id AS turn FROM kept",
    "visibility_runs": f"WITH {_RUNS} SELECT * FROM runs",
    "visibility_gates": f"""
        WITH {_RUNS}, lines AS ({_LINES}), states AS (SELECT *, CASE WHEN coalesce(value >= target, false) THEN 'PASS' ELSE 'FAIL' END AS status FROM lines)
        SELECT * FROM states UNION ALL SELECT 'overall', NULL, NULL, CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END FROM states""",
}
