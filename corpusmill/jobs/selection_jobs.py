"""Selections over the driver's tables: turns of a conversation are blocks, a customer's
orders candidates (urgent ones gold), events records of modes, passages' first words a
dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions import text as T
from corpusmill.functions.plans import ranked
from corpusmill.jobs.indexes import index_of
from corpusmill.jobs.search_jobs import _RANK, _TERMS, _WEAK, TOP, _word_tables, blocks, questions
from corpusmill.operators import lexical_index as L
from corpusmill.operators import retrieval
from corpusmill.operators import selection as S


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("id"), "role", "text")


def entity_links(spark, sf_dir):
    """Documents linked to a dictionary: the first word, and the first two words, of every
    passage."""
    w = T.lower_words(F.col("text"))
    names = questions(spark, sf_dir).select(F.explode(F.array(F.array_join(F.slice(w, 1, 1), " "), F.array_join(F.slice(w, 1, 2), " "))).alias("entity")).where("entity <> ''")
    return S.linked_entities(blocks(spark, sf_dir), names).select(F.col("id").alias("doc_id"), "entity")


def entity_first_topk(spark, sf_dir):
    """Hits of a question's long capitalised words; of its strong terms where it has none."""
    asked = questions(spark, sf_dir)
    own = asked.select("qid", F.explode(T.matches(F.col("text"), "[A-Z][A-Za-z0-9_]{4,}")).alias("t")).select("qid", F.lower("t").alias("term")).distinct()
    strong = retrieval.strong_terms(retrieval.query_terms(asked)).select("qid", "term")
    terms = own.unionByName(strong.join(own.select("qid").distinct(), "qid", "left_anti"))
    return L.best_tf(index_of(spark, sf_dir, "documents"), terms, TOP).select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def pruned_sufficiency(spark, sf_dir):
    """How many candidates a question's capitalised words have, cut off at 200, and whether
    they suffice for the 10 best (else all terms are searched)."""
    asked = questions(spark, sf_dir)
    own = asked.select("qid", F.explode(T.matches(F.col("text"), "[A-Z][A-Za-z0-9_]*")).alias("t")).select("qid", F.lower("t").alias("term")).distinct()
    found = L.best_tf(index_of(spark, sf_dir, "documents"), own, 200).groupBy("qid").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return asked.select("qid").join(found, "qid", "left").select(F.col("qid").alias("item_id"), n.alias("n"), (n >= 10).alias("enough"))


def bm25_okapi_topk(spark, sf_dir):
    found = L.best_bm25_okapi(index_of(spark, sf_dir, "document_words"), questions(spark, sf_dir), TOP)
    return found.select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def block_features(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("group"), F.col("event_id").alias("id"), F.col("value").alias("score"))
    return S.ranked_features(rows).withColumnsRenamed({"group": "user_id", "id": "event_id"})


def retention_labels(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("score", F.coalesce(F.length("text"), F.lit(0)))
    return S.retained(rows, 2, 2, "the").withColumnsRenamed({"group": "conv_id", "id": "turn"})


def elided_context(spark, sf_dir):
    kept = _turns(spark, sf_dir).where("id % 3 <> 1").withColumn("text", F.coalesce("text", F.lit("")))
    return S.with_gaps(kept).select(F.col("group").alias("conv_id"), F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"), "n_gaps")


def attention_mass(spark, sf_dir):
    """Turns as blocks of words; a word's weight falls with its place."""
    words = F.size(T.words(F.coalesce("text", F.lit(""))))
    sized = _turns(spark, sf_dir).withColumn("n", words.cast("long"))
    stop = F.sum("n").over(Window.partitionBy("group").orderBy("id"))
    laid = sized.select("group", "id", (stop - F.col("n")).alias("start"), stop.alias("stop"))
    return S.block_mass(laid, lambda place: 1.0 / (place + 1)).withColumnsRenamed({"group": "conv_id", "id": "turn"})


def _orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.startswith("o_orderpriority", F.lit("1")).alias("expected"))


def case_candidates(spark, sf_dir):
    return S.restricted(_orders(spark, sf_dir).select("case", "id", "expected")).withColumnsRenamed({"case": "o_custkey", "id": "o_orderkey"})


def _selections(spark, sf_dir):
    """Per customer the orders by price as a ranked list, the urgent ones as gold."""
    rows = ranked(_orders(spark, sf_dir), ["case"], [F.col("price").desc(), F.col("id")])
    chosen = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return rows.groupBy("case").agg(chosen.alias("chosen"), F.array_sort(F.collect_list(F.when(F.col("expected"), F.col("id")))).alias("gold"))


def selection_metrics(spark, sf_dir):
    rows = _selections(spark, sf_dir).withColumn("chosen", F.slice("chosen", 1, 8))
    return rows.select(F.col("case").alias("o_custkey"), *[c.alias(n) for n, c in S.list_metrics(F.col("chosen"), F.col("gold")).items()])


def failure_diagnosis(spark, sf_dir):
    rows = _selections(spark, sf_dir)
    kind = S.diagnosis(F.col("gold"), F.slice("chosen", 1, 10), F.slice("chosen", 1, 5), F.size("gold") == 0)
    return rows.groupBy(kind.alias("lost_by")).agg(F.count("*").alias("n"))


def paired_modes(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("mode"), "value")
    return S.paired(rows, "view", "click").withColumnRenamed("key", "user_id")


def throughput_summary(spark, sf_dir):
    """Records, rate per second over the span, and mean, of each event type."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (F.max(micros) - F.min(micros)) / F.lit(1e6)
    rows = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), seconds.alias("s"), F.round(F.avg("value"), 6).alias("mean"))
    return rows.select("event_type", "n", F.round(F.when(F.col("s") > 0, F.col("n") / F.col("s")).otherwise(0.0), 9).alias("per_second"), "mean")


def duplicate_text_gate(spark, sf_dir):
    return S.id_gate(_table(spark, sf_dir, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("key")), "key")


def seeded_sample(spark, sf_dir):
    return S.seeded(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "seed-7", 50)


def code_token_counts(spark, sf_dir):
    t = T.code_tokens(F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def alnum_token_counts(spark, sf_dir):
    t = T.alnum_tokens(F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


def accent_fold(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_accents(text)).alias("folded_md5"), (T.fold_accents(text) != text).alias("changed"))


def answer_checks(spark, sf_dir):
    """A turn as the answer to the one before: equal or contained, and its digits kept."""
    rows = _turns(spark, sf_dir).withColumn("expected", F.lag("text").over(Window.partitionBy("group").orderBy("id"))).where("expected IS NOT NULL AND text IS NOT NULL")
    return rows.select(
        F.col("group").alias("conv_id"), F.col("id").alias("turn"), F.md5(T.bare_answer(F.col("text"))).alias("bare_md5"),
        T.contained_match(F.col("text"), F.col("expected")).alias("contained"), T.numbers_kept(F.col("text"), F.col("expected")).alias("numbers_kept"),
    )


def safe_ids(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select("page_id", T.safe_id(F.coalesce("url", F.lit(""))).alias("safe_id"))
    return ranked(rows, ["safe_id"], [F.col("page_id")], "copy")


QUERIES = {f.__name__: f for f in (
    entity_links, entity_first_topk, pruned_sufficiency, bm25_okapi_topk, block_features, retention_labels, elided_context, attention_mass, case_candidates,
    selection_metrics, failure_diagnosis, paired_modes, throughput_summary, duplicate_text_gate, seeded_sample, code_token_counts, alnum_token_counts,
    accent_fold, answer_checks, safe_ids,
)}

_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
_BARE = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the')), ' ')"
_LISTS = """
s AS (
  SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS chosen,
         coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE starts_with(o_orderpriority, '1')), []::BIGINT[]) AS gold
  FROM orders GROUP BY o_custkey
)"""


def _recall(k: int) -> str:
    return f"CASE WHEN len(gold) = 0 THEN 100.0 ELSE round(100.0::DOUBLE * len(list_intersect(chosen[1:{k}], gold)) / len(gold), 6) END::DOUBLE AS recall_{k}"


ORACLES = {
    "entity_links": f"""
        WITH w AS (SELECT {_WORDS.format('lower(text)')} AS w FROM benchmark),
        e AS (SELECT DISTINCT entity FROM (SELECT unnest([array_to_string(w[1:1], ' '), array_to_string(w[1:2], ' ')]) AS entity FROM w) WHERE entity <> ''),
        d AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format('lower(text)')}, ' ') || ' ' AS t FROM documents),
        f AS (SELECT doc_id, entity FROM d JOIN e ON contains(t, ' ' || entity || ' '))
        SELECT DISTINCT doc_id, entity FROM f WHERE NOT EXISTS (
          SELECT 1 FROM f g WHERE g.doc_id = f.doc_id AND g.entity <> f.entity AND contains(' ' || g.entity || ' ', ' ' || f.entity || ' '))""",
    "entity_first_topk": f"""
        WITH {_TERMS}, o AS (SELECT DISTINCT item_id AS qid, lower(t) AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9_]{{4,}}')) AS t FROM benchmark)),
        st AS (SELECT DISTINCT qid, term FROM q WHERE length(term) >= 5 AND term NOT IN ({_WEAK})),
        x AS (SELECT * FROM o UNION ALL SELECT * FROM st WHERE qid NOT IN (SELECT qid FROM o)),
        s AS (SELECT qid, id, sum(tf)::BIGINT AS score FROM post JOIN x USING (term) GROUP BY ALL)
        SELECT qid AS item_id, rank, id AS doc_id, score FROM (SELECT *, {_RANK} FROM s) WHERE rank <= 10""",
    "pruned_sufficiency": f"""
        WITH {_TERMS}, o AS (SELECT DISTINCT item_id AS qid, lower(t) AS term FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][A-Za-z0-9_]*')) AS t FROM benchmark)),
        s AS (SELECT qid, least(count(DISTINCT id), 200)::BIGINT AS n FROM post JOIN o USING (term) GROUP BY qid)
        SELECT item_id, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) >= 10 AS enough FROM benchmark LEFT JOIN s ON qid = item_id""",
    "bm25_okapi_topk": f"""
        WITH {_word_tables('SELECT doc_id AS id, text FROM documents')},
        ui AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM ud CROSS JOIN us),
        ua AS (SELECT avg(idf) AS mean FROM ui),
        uk AS (SELECT term, CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean ELSE idf END AS idf FROM ui CROSS JOIN ua),
        s AS (SELECT qid, ut.id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
              FROM ut JOIN uq USING (term) JOIN uk USING (term) JOIN ul ON ul.id = ut.id CROSS JOIN us GROUP BY ALL)
        SELECT qid AS item_id, rank, id AS doc_id, score FROM (SELECT *, {_RANK} FROM s) WHERE rank <= 10""",
    "block_features": """
        WITH w AS (SELECT user_id, event_id, value, max(value) OVER u AS top, count(*) OVER u AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
                          row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WINDOW u AS (PARTITION BY user_id))
        SELECT user_id, event_id, round(CASE WHEN top > 0 THEN value / top ELSE 0.0 END, 9) AS share, round(i / n, 9) AS position, round((n - 1 - i) / n, 9) AS recency,
               rank::INT AS rank, CASE WHEN rank <= 16 THEN 'HOT' WHEN rank <= 24 THEN 'WARM' ELSE 'COLD' END AS tier FROM w""",
    "retention_labels": """
        SELECT conv_id, turn, coalesce(row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(length(text), 0) DESC, turn) <= 2
               OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 OR contains(lower(text), 'the'), false) AS keep FROM conversations""",
    "elided_context": """
        WITH k AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(turn <> lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) + 1, false) AS gap FROM conversations WHERE turn % 3 <> 1),
        j AS (SELECT conv_id, string_agg(CASE WHEN gap THEN '[...]' || chr(10) || text ELSE text END, chr(10) ORDER BY turn) AS context, count_if(gap)::BIGINT AS n_gaps FROM k GROUP BY conv_id)
        SELECT conv_id, md5(context) AS context_md5, length(context)::INT AS n_chars, n_gaps FROM j""",
    "attention_mass": f"""
        WITH t AS (SELECT conv_id, turn, len({_WORDS.format("coalesce(text, '')")}) AS n FROM conversations),
        l AS (SELECT conv_id, turn, n, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS stop FROM t),
        m AS (SELECT conv_id, turn, coalesce(list_sum(list_transform(range((stop - n)::BIGINT, stop::BIGINT), lambda p: 1.0::DOUBLE / (p + 1))), 0) AS s FROM l)
        SELECT conv_id, turn, round(CASE WHEN sum(s) OVER c > 0 THEN s / sum(s) OVER c ELSE 0.0 END, 9) AS mass FROM m WINDOW c AS (PARTITION BY conv_id)""",
    "case_candidates": """
        SELECT * FROM (SELECT o_custkey, o_orderkey, starts_with(o_orderpriority, '1') AS expected,
               row_number() OVER (PARTITION BY o_custkey ORDER BY starts_with(o_orderpriority, '1') DESC, o_orderkey)::INT AS place FROM orders) WHERE place <= 5""",
    "selection_metrics": f"""
        WITH {_LISTS}, c AS (SELECT o_custkey, chosen[1:8] AS chosen, gold FROM s)
        SELECT o_custkey, {_recall(1)}, {_recall(3)}, {_recall(5)},
               CASE WHEN len(gold) = 0 THEN 100.0 ELSE round(100.0::DOUBLE * len(list_intersect(chosen[1:5], gold)) / least(5, len(chosen)), 6) END::DOUBLE AS precision_5,
               CASE WHEN len(gold) = 0 THEN 100.0 ELSE round(100.0::DOUBLE * len(list_intersect(chosen, gold)) / len(gold), 6) END::DOUBLE AS coverage,
               CASE WHEN len(gold) = 0 THEN 0.0 ELSE round(100.0::DOUBLE * len(list_filter(chosen, lambda x: NOT list_contains(gold, x))) / len(chosen), 6) END::DOUBLE AS irrelevant FROM c""",
    "failure_diagnosis": f"""
        WITH {_LISTS}
        SELECT CASE WHEN len(gold) = 0 THEN 'none' WHEN len(list_filter(gold, lambda x: NOT list_contains(chosen[1:10], x))) > 0 THEN 'retrieval'
                    WHEN len(list_filter(gold, lambda x: NOT list_contains(chosen[1:5], x))) > 0 THEN 'packing' ELSE 'answer' END AS lost_by, count(*) AS n FROM s GROUP BY ALL""",
    "paired_modes": """
        WITH b AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'click') AS o FROM events GROUP BY user_id)
        SELECT user_id, round(a, 6) AS one, round(o, 6) AS other, round(o - a, 6) AS delta, round(CASE WHEN a > 0 THEN 100.0::DOUBLE * (a - o) / a ELSE 0.0 END, 6) AS saved FROM b WHERE a IS NOT NULL AND o IS NOT NULL""",
    "throughput_summary": """
        WITH t AS (SELECT event_type, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS s, round(avg(value), 6) AS mean FROM events GROUP BY event_type)
        SELECT event_type, n, round(CASE WHEN s > 0 THEN n / s ELSE 0.0 END, 9) AS per_second, mean FROM t""",
    "duplicate_text_gate": """
        WITH c AS (SELECT count(*) AS n, count(DISTINCT md5(coalesce(text, ''))) AS n_distinct FROM documents)
        SELECT n, n_distinct, n - n_distinct AS n_repeated, CASE WHEN n > n_distinct THEN 'FAIL' ELSE 'PASS' END AS gate FROM c""",
    "seeded_sample": "SELECT doc_id, sha256('seed-7|' || doc_id) AS hash FROM documents ORDER BY hash, doc_id LIMIT 50",
    "code_token_counts": """
        WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda x: lower(x)) AS t FROM documents)
        SELECT doc_id, len(t)::INT AS n, len(list_distinct(t))::INT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t""",
    "alnum_token_counts": f"""
        WITH t AS (SELECT doc_id, {_WORDS.format("regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\s]', ' ', 'g')")} AS t FROM documents)
        SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t""",
    "accent_fold": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), '{T.ACCENTED}', '{T.PLAIN}') AS f FROM documents)
        SELECT doc_id, md5(f) AS folded_md5, f <> text AS changed FROM t""",
    "answer_checks": f"""
        WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM conversations),
        b AS (SELECT *, {_BARE.format('text')} AS a, {_BARE.format('expected')} AS e FROM t WHERE text IS NOT NULL AND expected IS NOT NULL)
        SELECT conv_id, turn, md5(a) AS bare_md5, a = e OR (e <> '' AND contains(a, e) AND length(a) < 4 * length(e) + 30) AS contained,
               list_has_all(regexp_extract_all(text, '\\d+'), regexp_extract_all(expected, '\\d+')) AS numbers_kept FROM b""",
    "safe_ids": """
        WITH s AS (SELECT page_id, substr(regexp_replace(coalesce(url, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 80) AS safe_id FROM pages)
        SELECT page_id, safe_id, row_number() OVER (PARTITION BY safe_id ORDER BY page_id)::INT AS copy FROM s""",
}
