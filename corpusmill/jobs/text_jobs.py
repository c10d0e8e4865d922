"""Text queries: blocks, sentences, names, answers, prompts, packed evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import broadcast_if_small, ranked, written
from corpusmill.jobs.indexes import index_of, sentence_rows
from corpusmill.jobs.search_jobs import _SENTS, doc_of, questions
from corpusmill.jobs.sql import any_in, bounded, names_sql, quoted
from corpusmill.operators import evidence_packing as packing
from corpusmill.operators import lexical_index as L


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def clean_text(spark, sf_dir):
    clean = T.clean_text(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(clean.cast("binary")).alias("digest"), F.length(clean).alias("n_chars"))


def chunk_128(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.chunks(T.words(F.col("text")))).alias("chunk_index", "w"))
    return rows.select("doc_id", "chunk_index", F.size("w").alias("token_count"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


def sentence_split(spark, sf_dir):
    return sentence_rows(spark, sf_dir).groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("n_sentences"), F.sum(F.size(T.words(F.col("text")))).alias("n_words"), F.max(F.length("text")).alias("longest"))


def entity_extract(spark, sf_dir):
    names = _docs(spark, sf_dir).select("doc_id", F.explode(T.entity_candidates(F.col("text"))).alias("entity"))
    return names.groupBy("entity").agg(F.count("*").alias("n_docs"))


def answer_normalise(spark, sf_dir):
    t = F.col("text")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.md5(T.plain_answer(t).cast("binary")).alias("plain"), F.md5(T.token_sorted_answer(t).cast("binary")).alias("sorted"), F.md5(T.bare_answer(t).cast("binary")).alias("bare"))


def question_parse(spark, sf_dir):
    """User turns as questions: fields, intent, and the hash that keys caches."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    t = F.col("text")
    rows = rows.withColumn("fields", T.required_fields(t)).withColumn("entities", T.unseen_entities(t))
    rows = rows.withColumn("intent", T.intent(t, F.col("fields"), F.size("entities")))
    key = T.canonical_hash(t, F.col("entities"), F.col("fields"), F.col("intent"), T.reference_marker(t))
    return rows.select("conv_id", "turn", F.array_join("fields", ",").alias("fields"), "intent", key.alias("cache_key"))


def prompt_audit(spark, sf_dir):
    """Prompts of a turn with all turns before it: hash and length."""
    from pyspark.sql.window import Window

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    history = F.collect_list("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    prompt = F.concat_ws("\n", F.lit("Context:"), F.array_join(history, "\n"), F.lit("Answer:"))
    return rows.select("conv_id", "turn", F.sha2(prompt, 256).alias("prompt_hash"), T.token_estimate(prompt).alias("n_tokens"))


def neighbours_lag_lead(spark, sf_dir):
    rows = packing.neighbours(sentence_rows(spark, sf_dir))
    flagged = rows.withColumn("needs", packing.needs_context(F.col("text")))
    return flagged.groupBy(doc_of(F.col("id")).alias("doc_id")).agg(F.count_if("needs").alias("n_needing"), F.count_if(F.col("needs") & F.col("before_id").isNotNull()).alias("n_with_before"), F.count_if(F.col("needs") & F.col("after_id").isNotNull()).alias("n_with_after"))


def _candidates(spark, sf_dir):
    """The forty best sentences per question by BM25, ranked by BM25, by hashed cosine and
    by their document's best sentence."""
    index, asked = index_of(spark, sf_dir, "sentences"), questions(spark, sf_dir)
    found = written(L.best_bm25(index, asked, 40).withColumn("bm25_rank", F.col("rank") - 1), "sentences")
    rows = index.blocks().select("id", "doc", "text").join(broadcast_if_small(found), "id").join(broadcast_if_small(asked.withColumnRenamed("text", "question")), "qid")
    q, s = T.feature_sets(F.col("question"))["tokens"], T.feature_sets(F.col("text"))["tokens"]
    near = F.size(F.array_intersect(q, s)) / F.greatest(F.lit(1.0), F.sqrt(F.size(q) * F.size(s).cast("double")))
    rows = ranked(rows.withColumn("near", F.round(near, 9)), ["qid"], [F.col("near").desc(), F.col("id")], "dense_rank").withColumn("dense_rank", F.col("dense_rank") - 1)
    best = rows.groupBy("qid", "doc").agg(F.min("bm25_rank").alias("first"))
    best = ranked(best, ["qid"], [F.col("first"), F.col("doc")], "block_rank").select("qid", "doc", (F.col("block_rank") - 1).alias("block_rank"))
    return rows.join(best, ["qid", "doc"]).select("qid", "question", "id", "doc", "text", "bm25_rank", "dense_rank", "block_rank")


def sentence_features(spark, sf_dir):
    rows = packing.scored(_candidates(spark, sf_dir))
    return rows.select(F.col("qid").alias("item_id"), F.col("id").alias("sentence_id"), "score", "n_tokens", "kept")


def pack_evidence(spark, sf_dir):
    """Packed, rescued and expanded evidence per question."""
    rows = packing.rescued(packing.packed(packing.scored(_candidates(spark, sf_dir))))
    wide = packing.expanded(rows, index_of(spark, sf_dir, "sentences").blocks())
    return wide.select(F.col("qid").alias("item_id"), "total", F.size("ids").alias("n_sentences"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("sentence_ids"))


QUERIES = {f.__name__: f for f in (
    clean_text, chunk_128, sentence_split, entity_extract, answer_normalise, question_parse, prompt_audit, neighbours_lag_lead, sentence_features, pack_evidence,
)}

_W = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"

_FIELDS = ", ".join(
    f"{{'at': list_min(list_filter([{', '.join(f'instr(l, {quoted([k])})' for k in keys)}], lambda p: p > 0)), 'n': {i}, 'field': '{name}'}}" for i, (name, keys) in enumerate(T.FIELD_KEYWORDS.items())
)

ORACLES = {
    "entity_extract": f"SELECT entity, count(*) AS n_docs FROM (SELECT unnest({names_sql('text')}) AS entity FROM documents) GROUP BY ALL",
    "answer_normalise": f"""WITH t AS (SELECT item_id, coalesce(text, '') AS t FROM benchmark),
        w AS (SELECT item_id, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS plain, regexp_split_to_array(lower(translate(regexp_replace(t, '[$,]', '', 'g'), '{T.ACCENTED}', '{T.PLAIN}')), '\\s+') AS s,
          regexp_split_to_array(regexp_replace(lower(t), '[^\\pL\\pN\\s]', '', 'g'), '\\s+') AS b FROM t)
        SELECT item_id, md5(plain) AS plain, md5(array_to_string(list_sort(list_filter(s, lambda x: x NOT IN ('', 'project'))), ' ')) AS sorted, md5(array_to_string(list_filter(b, lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')) AS bare FROM w""",
    "question_parse": f"""WITH q AS (SELECT conv_id, turn, text, lower(text) AS l, regexp_extract_all({bounded('text', 'q')}, '\\b[A-Z][A-Z0-9_\\-]+\\b') AS capitals FROM conversations WHERE role = 'user'),
        p AS (SELECT *, list_transform(list_sort(list_filter([{_FIELDS}], lambda x: x.at IS NOT NULL)), lambda x: x.field) AS f, CASE WHEN len(capitals) > 0 THEN capitals ELSE regexp_extract_all({bounded('text', '0')}, '\\b[A-Z][a-z]+\\b') END AS e FROM q),
        i AS (SELECT *, CASE WHEN len(e) = 0 THEN 'abstention_candidate' WHEN len(f) >= 2 THEN 'multi_fact_extraction' WHEN {any_in('l', T.COMPARISON_WORDS)} THEN 'comparison' WHEN {any_in('l', T.LISTING_WORDS)} THEN 'aggregation'
          WHEN {any_in('l', T.STATUS_WORDS)} THEN 'status_resolution' ELSE 'single_fact_lookup' END AS intent, nullif(regexp_extract(l, '\\bref_[0-9a-f]{{10}}\\b'), '') AS marker FROM p)
        SELECT conv_id, turn, array_to_string(f, ',') AS fields, intent, sha256('question:' || trim(regexp_replace(l, '\\s+', ' ', 'g')) || '|entities:' || array_to_string(list_sort(list_transform(e, lambda x: lower(x))), ',')
          || '|fields:' || array_to_string(list_sort(f), ',') || '|intent:' || intent || '|constraints:' || coalesce('reference_marker=' || marker || ',', '')
          || 'status_preference=' || CASE WHEN intent = 'status_resolution' THEN 'all' ELSE 'active' END || ',strict_entity=true,temporal_preference=latest') AS cache_key FROM i""",
    "clean_text": """WITH c AS (SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS t FROM documents)
        SELECT doc_id, md5(t) AS digest, length(t)::INT AS n_chars FROM c""",
    "chunk_128": f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 127) // 128)) AS i FROM w)
        SELECT doc_id, i::INT AS chunk_index, len(w[i * 128 + 1:i * 128 + 128])::INT AS token_count, md5(array_to_string(w[i * 128 + 1:i * 128 + 128], ' ')) AS digest FROM c""",
    "sentence_split": f"WITH s AS ({_SENTS}) SELECT id // 100000 AS doc_id, count(*) AS n_sentences, sum(len({_W}))::BIGINT AS n_words, max(length(text))::INT AS longest FROM s GROUP BY ALL",
    "prompt_audit": """WITH h AS (SELECT conv_id, turn, 'Context:' || chr(10) || string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) || chr(10) || 'Answer:' AS p FROM conversations)
        SELECT conv_id, turn, sha256(p) AS prompt_hash, greatest(1, len(list_filter(regexp_split_to_array(p, '\\s+'), lambda x: x <> '')))::INT AS n_tokens FROM h""",
    "neighbours_lag_lead": f"""WITH s AS ({_SENTS}), n AS (SELECT id, text, lag(id) OVER w AS b, lead(id) OVER w AS a, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS t FROM s WINDOW w AS (PARTITION BY id // 100000 ORDER BY id)),
        f AS (SELECT *, len(t) < 10 OR list_has_any(t, ['this', 'these', 'they', 'it', 'such']) OR regexp_matches(lower(text), '^(however|therefore|additionally|furthermore)') AS needs FROM n)
        SELECT id // 100000 AS doc_id, count(*) FILTER (needs) AS n_needing, count(*) FILTER (needs AND b IS NOT NULL) AS n_with_before, count(*) FILTER (needs AND a IS NOT NULL) AS n_with_after FROM f GROUP BY ALL""",
}
