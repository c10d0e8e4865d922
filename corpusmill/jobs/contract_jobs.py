"""Contracts, guards, output checks and code context over the driver's tables: customers
are questions about their orders' evidence, conversations patches, documents files that
passages ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.plans import top_k
from corpusmill.jobs.fact_jobs import _ASKED, _EV, _asked, evidence
from corpusmill.operators import code, contracts, facts, resolve

PACK = 4  # blocks of a pack


def _own(spark, sf_dir):
    """Evidence with its customer's key."""
    return evidence(spark, sf_dir).withColumn("qid", F.regexp_extract("text", r"Project C(\d+)", 1).cast("long"))


def answer_audit(spark, sf_dir):
    """Answers audited against contracts. A pack holds a customer's first blocks; the
    answer names the amount of the last order, or that of another project for every fifth
    customer; every seventh couldn't be parsed; the first order's amount is expected."""
    rows, key = _own(spark, sf_dir), F.col("qid")
    pack = top_k(rows, ["qid"], [F.col("block_id")], PACK).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("block_id", "source_file", "text"))).alias("blocks"))
    money = F.regexp_extract("text", r"(\$[0-9,]*[0-9])", 1)
    ends = rows.select("qid", "block_id", "source_file", money.alias("money")).groupBy("qid").agg(
        F.max_by("money", "block_id").alias("last"), F.max_by("source_file", "block_id").alias("file"), F.min_by("money", "block_id").alias("expected"),
    )
    named = F.concat(F.lit("Project C"), (key + (key % 5 == 0).cast("long")).cast("string"))
    asked = pack.join(ends, "qid").select(
        "qid", "blocks", F.concat(F.lit("What is the budget of Project C"), key.cast("string"), F.lit("?")).alias("question"), F.when(key % 7 != 0, F.concat(named, F.lit(" has "), F.col("last"))).alias("answer"),
        F.array("file").alias("sources"), "expected", (key % 70).cast("int").alias("output_tokens"),
    )
    out = contracts.audited(contracts.compiled(asked))
    return out.select("qid", "answer_type", F.size("amounts_allowed").alias("n_amounts"), F.size("projects_allowed").alias("n_projects"), F.size("sources_allowed").alias("n_sources"), "verdict")


def guard_routes(spark, sf_dir):
    """How each question would be answered, from its blocks' states; a guard knows the
    answer where one block is left."""
    active = F.count_if(F.col("state") == "active")
    rows = resolve.resolved(_asked(spark, sf_dir)).groupBy("qid").agg(active.alias("n_active"), (F.count("*") - active).alias("n_suppressed"))
    proof = facts.proof_status(F.col("n_active"), F.col("n_suppressed"), F.col("n_active") / (F.col("n_active") + F.col("n_suppressed")))
    bypass = F.when(F.col("n_active") == 1, "known").when(F.col("n_active") == 0, "NOT_FOUND")
    rows = rows.withColumn("proof", proof).withColumn("bypass", bypass)
    rows = rows.withColumn("action", facts.guard_action(F.col("proof"), F.lit("single_fact_lookup"), F.lit(1), F.col("n_active"), F.col("bypass")))
    category = F.when(F.col("qid") % 11 == 0, "synthesis").when(F.col("qid") % 13 == 0, "comparison").otherwise("lookup")
    return rows.select("qid", "n_active", "n_suppressed", "proof", "action", contracts.route(F.col("action"), F.col("bypass"), category, F.col("n_active") * 1000).alias("route"))


def output_checks(spark, sf_dir):
    """An answer per order against its text: every third amount is one too high, every
    seventh answer is NOT_FOUND, every tenth order's entity is absent, even keys' names
    are forbidden."""
    key, amount = F.col("block_id"), F.regexp_replace(F.regexp_extract("text", r"\$([0-9,]*[0-9])", 1), ",", "").cast("long")
    rows = _own(spark, sf_dir).withColumn("amount", amount + (key % 3 == 0).cast("long"))
    answer = F.when(key % 7 == 0, "NOT_FOUND").otherwise(F.concat(F.lit("Project C"), F.col("qid").cast("string"), F.lit(" costs $"), F.col("amount").cast("string")))
    proof = F.when(key % 10 == 0, "ABSENT").when(key % 2 == 0, "COMPLETE").otherwise("PARTIAL")
    forbidden = F.array(F.concat(F.lit("C"), (F.col("qid") - F.col("qid") % 2).cast("string")))
    reasons = contracts.verified_output(answer, proof, F.lit(False), F.col("text"), forbidden)
    return rows.select("block_id", F.array_join(reasons, "; ").alias("reasons"))


def conversation_diffs(spark, sf_dir):
    """Conversations as patches, a turn a line: the user's lines are added, the
    assistant's stay, others are removed. The new file's numbers of the added ones."""
    mark = F.when(F.col("role") == "user", "+").when(F.col("role") == "assistant", " ").otherwise("-")
    line = F.concat(mark, F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda t: t["line"]), "\n")
    head = F.concat(F.lit("--- a/chat\n+++ b/chat_"), F.col("conv_id").cast("string"), F.lit(".txt\n@@ -1,1 +5,1 @@\n"))
    patches = turns.groupBy("conv_id").agg(body.alias("body")).select(F.col("conv_id").alias("id"), F.concat(head, F.col("body")).alias("patch"))
    return code.changed_lines(patches).select(F.col("id").alias("conv_id"), "file", "line")


def code_file_topk(spark, sf_dir):
    """The ten files that passages speak of most."""
    path = F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(path.alias("path"), "text")
    issues = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return code.best_files(issues, files, 10).select(F.col("id").alias("item_id"), "rank", "path", "score")


QUERIES = {f.__name__: f for f in (answer_audit, guard_routes, output_checks, conversation_diffs, code_file_topk)}

_KEYED = f"{_EV}, ek AS (SELECT *, regexp_extract(text, 'Project C(\\d+)', 1)::BIGINT AS qid, regexp_extract(text, '(\\$[0-9,]*[0-9])', 1) AS money FROM ev)"

ORACLES = {
    "answer_audit": f"""WITH {_KEYED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY block_id) AS k FROM ek),
        p AS (SELECT qid, list(DISTINCT money) FILTER (k <= {PACK}) AS amounts, list(DISTINCT source_file) FILTER (k <= {PACK}) AS files, arg_max(money, block_id) AS last, arg_max(source_file, block_id) AS file FROM r GROUP BY ALL)
        SELECT qid, 'numeric_fact' AS answer_type, len(amounts) AS n_amounts, 1 AS n_projects, len(files) AS n_sources,
          CASE WHEN qid % 7 = 0 THEN 'MODEL_PARSE_FAIL' WHEN qid % 5 = 0 OR NOT list_contains(amounts, last) THEN 'HALLUCINATION_FAIL' WHEN NOT list_contains(files, file) THEN 'SOURCE_FAIL' WHEN qid % 70 > 64 THEN 'OUTPUT_BUDGET_FAIL' ELSE 'PASS' END AS verdict FROM p""",
    "guard_routes": f"""WITH {_ASKED}, s AS (SELECT qid, count(*) FILTER (entity = 'C' || qid AND reason IS NULL) AS n_active, count(*) AS n FROM ca GROUP BY ALL),
        p AS (SELECT *, CASE WHEN n_active = 0 THEN 'INSUFFICIENT' WHEN n_active = n THEN 'COMPLETE' ELSE 'PARTIAL' END AS proof FROM s),
        g AS (SELECT *, CASE WHEN n_active = 0 OR (proof = 'COMPLETE' AND n_active = 1) THEN 'BYPASS_LLM' WHEN proof = 'PARTIAL' THEN 'PROCEED_WITH_WARNING' ELSE 'PROCEED' END AS action FROM p)
        SELECT qid, n_active, n - n_active AS n_suppressed, proof, action, CASE WHEN qid % 11 = 0 THEN 'LLM_SYNTHESIS' WHEN n_active = 0 THEN 'NOT_FOUND' WHEN qid % 13 = 0 THEN 'COMPUTE_COMPARISON'
          WHEN action = 'BYPASS_LLM' THEN 'DETERMINISTIC' WHEN n_active > 3 THEN 'LONG_CONTEXT_FALLBACK' ELSE 'LLM_COMPILED' END AS route FROM g""",
    "output_checks": f"""WITH {_KEYED}, a AS (SELECT block_id, qid, replace(text, ',', '') AS t, (replace(replace(money, '$', ''), ',', '')::BIGINT + (block_id % 3 = 0)::INT)::VARCHAR AS amount FROM ek)
        SELECT block_id, CASE WHEN block_id % 10 = 0 THEN CASE WHEN block_id % 7 = 0 THEN '' ELSE 'should be NOT_FOUND' END WHEN block_id % 7 = 0 THEN CASE WHEN block_id % 2 = 0 THEN 'evidence was complete' ELSE '' END
          ELSE concat_ws('; ', CASE WHEN qid % 2 = 0 THEN 'forbidden: C' || qid END, CASE WHEN NOT contains(t, amount) THEN 'not grounded: ' || amount END) END AS reasons FROM a""",
    "conversation_diffs": """WITH n AS (SELECT conv_id, turn, role, sum(CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
        SELECT conv_id, 'chat_' || conv_id || '.txt' AS file, (4 + k)::INT AS line FROM n WHERE role = 'user'""",
    "code_file_topk": """WITH f AS (SELECT 'src/doc_' || doc_id || '.py' AS path, coalesce(text || ' ', '') || 'src/doc_' || doc_id || '.py' AS t FROM documents),
        k AS (SELECT path, token, count(*) AS tf FROM (SELECT path, lower(unnest(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'))) AS token FROM f) GROUP BY ALL),
        a AS (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'))) AS token FROM benchmark),
        s AS (SELECT item_id, path, round(sum(ln(1.0::DOUBLE + tf)), 6) AS score FROM k JOIN a USING (token) GROUP BY ALL)
        SELECT item_id, rank, path, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path)::INT AS rank FROM s) WHERE rank <= 10""",
}
