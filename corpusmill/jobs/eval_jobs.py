"""Evaluation queries: events stand for timed records (type: mode, user: category),
benchmark passages for questions whose gold documents hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import broadcast_if_small, top_k
from corpusmill.jobs.indexes import index_of
from corpusmill.jobs.search_jobs import _bm25, _DOCS, blocks, questions
from corpusmill.jobs.sql import names_sql
from corpusmill.operators import evaluation as E
from corpusmill.operators import lexical_index as L
from corpusmill.operators import sampling, sessions


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def percentile_latency(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), *E.latency(F.col("value")))


def mode_category_rollup(spark, sf_dir):
    """Counts and means by mode and category, by mode, and over all."""
    rows = _events(spark, sf_dir).select("event_type", (F.col("user_id") % 8).alias("category"), "value")
    out = rows.groupingSets([["event_type", "category"], ["event_type"], []], "event_type", "category").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("category", F.lit(-1)).alias("category"), "level", "n", "mean")


def rate_metrics(spark, sf_dir):
    """Rates of conditions per category, and both ways to average a ratio."""
    k = T.found(F.get_json_object("props", "$.k"), r"^\d+$").cast("double")
    rows = _events(spark, sf_dir).select((F.col("user_id") % 8).alias("category"), "event_type", "value", k.alias("k"))
    return rows.groupBy("category").agg(
        E.percent(F.col("event_type") == "error").alias("error_pct"), F.count_if(F.col("value") > 50).alias("n_slow"),
        F.round(F.avg("value") / F.avg("k"), 6).alias("ratio_of_averages"), F.round(F.avg(F.when(F.col("k") > 0, F.col("value") / F.col("k"))), 6).alias("mean_of_ratios"),
        F.round(F.sum("value") / F.nullif(F.count_if(F.col("event_type") == "purchase"), F.lit(0)), 6).alias("value_per_purchase"),
    )


def gates(spark, sf_dir):
    rows = _events(spark, sf_dir).groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("ok"), F.percentile("value", 0.95).alias("p95"))
    verdict = E.gate([F.col("ok") >= 0.8, F.col("p95") < 60])
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_users"))


def best_config(spark, sf_dir):
    """Per mode the category of the best mean among those under the mode's own median
    of maxima, and the most frequent one."""
    rows = _events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 8).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    best = top_k(rows, ["event_type"], [F.col("mean").desc(), F.col("category")], 1)
    most = top_k(rows, ["event_type"], [F.col("n").desc(), F.col("category")], 1)
    return best.select("event_type", F.col("category").alias("best_category"), "mean").join(most.select("event_type", F.col("category").alias("most_category"), "n"), "event_type")


def json_parse_lenient(spark, sf_dir):
    """Fields of JSON that other text surrounds."""
    messy = F.concat(F.lit("answer: "), F.col("props"), F.lit(" done"))
    k = F.get_json_object(T.json_object(messy), "$.k").cast("bigint")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count(k).alias("n_k"))


def token_economics(spark, sf_dir):
    """Economics of conversations: all turns as baseline, user turns as actual input."""
    n = F.size(T.words(F.col("text")))
    rows = _conversations(spark, sf_dir).groupBy("conv_id").agg(
        F.sum(n).alias("baseline"), F.sum(F.when(F.col("role") == "user", n).otherwise(0)).alias("actual"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("output"),
    )
    figures = E.economics(F.col("baseline"), F.col("actual"), F.col("output"), F.col("actual") * 0.5, F.col("output") * 8.0, 1.0, 2.0)
    return rows.select("conv_id", *[(F.round(c, 6) if name.endswith("tps") else c).alias(name) for name, c in figures.items()])


def session_fold(spark, sf_dir):
    rows = sessions.folded(_conversations(spark, sf_dir))
    return rows.select("conv_id", "turn_count", "words", F.array_join("roles", ",").alias("roles"), F.coalesce(F.array_join(F.array_sort("active"), "|"), F.lit("")).alias("active"))


def turn_plans(spark, sf_dir):
    return sessions.planned(_conversations(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("query")).alias("chars"))


def topic_switches(spark, sf_dir):
    """Along conversations, with the speaker as the topic."""
    return sessions.switches(_conversations(spark, sf_dir), "role").select("conv_id", "turn", "role", F.col("switches").cast("bigint").alias("switches"), "distance")


def _windows(w, n):
    """The distinct runs of ``n`` words of an array, each as one text."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))


def _gold(spark, sf_dir, width=10, share=0.5):
    """(qid, gold_group, id): documents that hold at least ``share`` of a passage's distinct
    windows of ``width`` words; a shorter passage is one window, one without words has no
    gold. Windows are found by an equi-join, not by searching every text."""
    w, n = T.lower_words(F.col("text")), F.least(F.size("w"), F.lit(width))
    passages = questions(spark, sf_dir).select("qid", w.alias("w")).where(F.size("w") > 0)
    keys = passages.select("qid", F.explode(_windows(F.col("w"), n)).alias("key"))
    needed = keys.groupBy("qid").agg((F.countDistinct("key") * share).alias("needed"))
    widths = [r.n for r in passages.select(n.alias("n")).distinct().collect()]  # at most ``width``
    runs = F.flatten(F.array(*[_windows(F.col("w"), F.lit(i)) for i in widths])) if widths else F.array().cast("array<string>")
    held = blocks(spark, sf_dir).select("id", w.alias("w")).select("id", F.explode(runs).alias("key")).join(broadcast_if_small(keys), "key")
    counts = held.groupBy("qid", "id").agg(F.countDistinct("key").alias("n"))
    return counts.join(broadcast_if_small(needed), "qid").where("n >= needed").select("qid", F.lit(0).alias("gold_group"), "id")


def recall_mrr(spark, sf_dir):
    found = L.best_bm25(index_of(spark, sf_dir, "document_words"), questions(spark, sf_dir), 50)
    rows = E.recall_at(found, _gold(spark, sf_dir), (1, 10, 50))
    return rows.agg(F.count("*").alias("n"), *[E.percent(F.col(f"hit_{k}")).alias(f"recall_{k}") for k in (1, 10, 50)], F.round(F.avg("rr"), 6).alias("mrr"))


def poison_anti_join(spark, sf_dir):
    """Without its gold documents, no question may find any: what is left per question."""
    gold = _gold(spark, sf_dir)
    found = L.best_bm25(index_of(spark, sf_dir, "document_words"), questions(spark, sf_dir), 10)
    left = found.join(gold, ["qid", "id"], "left_anti")
    return left.groupBy(F.col("qid").alias("item_id")).agg(F.count("*").alias("n_left"), F.round(F.max("score"), 6).alias("best_left"))


def leak_check(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    id_ = F.concat(F.lit("q_"), T.opaque_id(F.col("url")))
    path = F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1)
    return rows.select("page_id", id_.alias("opaque"), F.array_join(E.leak_reasons(id_, path), ",").alias("reasons"))


def resume_anti_join(spark, sf_dir):
    """Labelled documents that are still to be judged for quality: those not yet labelled."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return sampling.not_done(docs.select("doc_id", "lang"), done, ["doc_id"]).groupBy("lang").agg(F.count("*").alias("n_left"))


def stratified_sample(spark, sf_dir):
    """Fifty documents of each language in hash order: a sampling operator."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return sampling.stratified(docs, "lang", "doc_id", 50).select("doc_id", "lang", "sample_rank")


def context_trim(spark, sf_dir):
    """How many of a source's documents, longest first, fit a budget of characters, one at
    least; a null text has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", F.length("text").alias("n"))
    return sampling.trimmed(docs, "source", "n", 20_000)


def weighted_draws(spark, sf_dir):
    """5000 draws of orders with replacement, in proportion to their whole amounts."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    return sampling.drawn_with_replacement(orders, "o_orderkey", F.floor("o_totalprice"), 5000, "seed").select("draw", "o_orderkey")


QUERIES = {f.__name__: f for f in (
    percentile_latency, mode_category_rollup, rate_metrics, gates, best_config, json_parse_lenient, token_economics, session_fold, turn_plans, topic_switches,
    recall_mrr, poison_anti_join, leak_check, resume_anti_join, stratified_sample, context_trim, weighted_draws,
)}

_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"
_GOLD = """
gp AS (SELECT * FROM (SELECT item_id AS qid, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
gk AS (SELECT DISTINCT qid, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS key FROM (SELECT qid, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM gp)),
gn AS (SELECT qid, count(*) AS n FROM gk GROUP BY ALL),
gw AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
gs AS (SELECT DISTINCT least(len(w), 10) AS n FROM gp),
gx AS (SELECT DISTINCT id, array_to_string(w[i:i + n - 1], ' ') AS key FROM (SELECT id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM gw JOIN gs ON len(w) >= n)),
gold AS (SELECT qid, id FROM (SELECT qid, id, count(*) AS held FROM gx JOIN gk USING (key) GROUP BY ALL) JOIN gn USING (qid) WHERE held >= 0.5 * n)"""

_PLANNED = f"""
pn AS (SELECT *, {names_sql('text')} AS named FROM conversations),
pa AS (SELECT *, last_value(CASE WHEN len(named) > 0 THEN named END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS active FROM pn),
pl AS (SELECT *, lag(active) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM pa),
pk AS (SELECT *, CASE WHEN regexp_matches(lower(text), '\\bref_[0-9a-f]{{10}}\\b') THEN 'marker' WHEN len(named) > 0 THEN 'entity'
  WHEN before IS NOT NULL AND regexp_matches(lower(text), '\\b(and|also|too|its|their|that|those|same|previous|about it|what about)\\b') THEN 'follow_up' ELSE 'semantic' END AS kind FROM pl)"""

ORACLES = {
    "weighted_draws": """
        WITH w AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS w FROM orders WHERE floor(o_totalprice) > 0), e AS (SELECT o_orderkey, w, (sum(w) OVER (ORDER BY o_orderkey))::BIGINT AS stop FROM w),
        d AS (SELECT range AS draw, ('0x' || substr(sha256('seed|' || range), 1, 15))::BIGINT % (SELECT sum(w)::BIGINT FROM w) AS lot FROM range(5000))
        SELECT draw, o_orderkey FROM d JOIN e ON lot >= stop - w AND lot < stop""",
    "turn_plans": f"""WITH {_PLANNED} SELECT kind, count(*) AS n, sum(length(CASE WHEN kind = 'follow_up' THEN concat_ws(' ', array_to_string(list_transform(before, lambda x: 'Project ' || x), ' '), text) ELSE text END))::BIGINT AS chars FROM pk GROUP BY ALL""",
    "session_fold": f"""WITH {_PLANNED}, r AS (SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY ALL)
        SELECT conv_id, count(*) AS turn_count, sum({_WORDS})::BIGINT AS words, any_value(roles) AS roles, coalesce(array_to_string(list_sort(arg_max(active, turn)), '|'), '') AS active FROM pk JOIN r USING (conv_id) GROUP BY conv_id""",
    "percentile_latency": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most FROM events GROUP BY ALL",
    "mode_category_rollup": """SELECT coalesce(event_type, 'all') AS event_type, coalesce(category, -1) AS category, CASE WHEN g1 = 1 THEN 3 WHEN g2 = 1 THEN 1 ELSE 0 END::INT AS level, n, mean FROM (
        SELECT event_type, category, grouping(event_type) AS g1, grouping(category) AS g2, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT event_type, user_id % 8 AS category, value FROM events) GROUP BY GROUPING SETS ((event_type, category), (event_type), ()))""",
    "rate_metrics": """WITH r AS (SELECT user_id % 8 AS category, event_type, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events)
        SELECT category, round(avg((event_type = 'error')::INT::DOUBLE) * 100, 6) AS error_pct, count(*) FILTER (value > 50) AS n_slow, round(avg(value) / avg(k), 6) AS ratio_of_averages,
          round(avg(CASE WHEN k > 0 THEN value / k END), 6) AS mean_of_ratios, round(sum(value) / nullif(count(*) FILTER (event_type = 'purchase'), 0), 6) AS value_per_purchase FROM r GROUP BY ALL""",
    "gates": """WITH u AS (SELECT user_id, avg((event_type <> 'error')::INT::DOUBLE) AS ok, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL)
        SELECT CASE WHEN ok >= 0.8 AND p95 < 60 THEN 'VALIDATING' WHEN ok >= 0.8 THEN 'QUALITY_ONLY' ELSE 'NON_VALIDATING' END AS verdict, count(*) AS n_users FROM u GROUP BY ALL""",
    "best_config": """WITH r AS (SELECT event_type, user_id % 8 AS category, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY mean DESC, category) AS b, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, category) AS m FROM r)
        SELECT x.event_type, x.category AS best_category, x.mean, y.category AS most_category, y.n FROM k x JOIN k y ON x.event_type = y.event_type AND x.b = 1 AND y.m = 1""",
    "json_parse_lenient": "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS sum_k, count(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY ALL",
    "token_economics": f"""WITH r AS (SELECT conv_id, sum(n)::BIGINT AS b, sum(CASE WHEN role = 'user' THEN n ELSE 0 END)::BIGINT AS a, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS o FROM (SELECT conv_id, role, {_WORDS} AS n FROM conversations) GROUP BY ALL)
        SELECT conv_id, greatest(0, b - a) AS avoided, CASE WHEN a > 0 THEN round(a / (a * 0.5::DOUBLE / 1000.0), 6) ELSE 0.0 END::DOUBLE AS input_tps, CASE WHEN o > 0 THEN round(o / (o * 8.0::DOUBLE / 1000.0), 6) ELSE 0.0 END::DOUBLE AS output_tps,
          CASE WHEN a + o > 0 THEN round(b / ((a * 0.5::DOUBLE + o * 8.0::DOUBLE) / 1000.0), 6) ELSE 0.0 END::DOUBLE AS effective_tps, a * 98304 AS kv_bytes, greatest(0, b - a) * 98304 AS kv_avoided,
          round(a / 1000000.0::DOUBLE * 1.0 + o / 1000000.0::DOUBLE * 2.0, 12) AS cost, round(greatest(0, b - a) / 1000000.0::DOUBLE, 12) AS avoided_cost FROM r""",
    "topic_switches": """WITH l AS (SELECT *, CASE WHEN lag(role) OVER w <> role THEN 1 ELSE 0 END AS changed, min(turn) OVER (PARTITION BY conv_id, role) AS first FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, role, (sum(changed) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS switches, turn - first AS distance FROM l""",
    "recall_mrr": f"""WITH {_bm25(_DOCS)}, {_GOLD}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 50),
        h AS (SELECT qid, min(rank) AS first FROM gold LEFT JOIN f USING (qid, id) GROUP BY qid)
        SELECT count(*) AS n, round(avg(coalesce(first <= 1, false)::INT::DOUBLE) * 100, 6) AS recall_1, round(avg(coalesce(first <= 10, false)::INT::DOUBLE) * 100, 6) AS recall_10, round(avg(coalesce(first <= 50, false)::INT::DOUBLE) * 100, 6) AS recall_50, round(avg(coalesce(1.0::DOUBLE / first, 0.0)), 6) AS mrr FROM h""",
    "poison_anti_join": f"""WITH {_bm25(_DOCS)}, {_GOLD}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 10)
        SELECT qid AS item_id, count(*) AS n_left, round(max(score), 6) AS best_left FROM f ANTI JOIN gold USING (qid, id) GROUP BY ALL""",
    "leak_check": """WITH p AS (SELECT page_id, 'q_' || substr(sha256(url), 1, 16) AS opaque, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages)
        SELECT page_id, opaque, array_to_string(list_filter([CASE WHEN NOT regexp_full_match(opaque, 'q_[0-9a-f]{16}') THEN 'id_not_opaque' END, CASE WHEN contains(path, opaque) THEN 'id_in_path' END,
          CASE WHEN NOT regexp_full_match(path, '[a-z0-9_/.-]+') THEN 'path_not_plain' END, CASE WHEN regexp_matches(lower(path), 'gold|answer|expected') THEN 'path_names_answer' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p""",
    "resume_anti_join": "SELECT lang, count(*) AS n_left FROM documents ANTI JOIN labels USING (doc_id) GROUP BY ALL",
    "stratified_sample": "SELECT doc_id, lang, sample_rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || '|42'), doc_id)::INT AS sample_rank FROM documents) WHERE sample_rank <= 50",
    "context_trim": """WITH d AS (SELECT source, doc_id, coalesce(length(text), 0) AS n FROM documents),
        r AS (SELECT source, sum(n) OVER (PARTITION BY source ORDER BY n DESC, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d)
        SELECT source, greatest(1, count(*) FILTER (upto <= 20000)) AS kept, count(*) AS n FROM r GROUP BY ALL""",
}
